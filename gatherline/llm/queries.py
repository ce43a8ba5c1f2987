"""The registered queries of this folder's operators and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherline.llm import ann, bpe, chat, conversation_repair, decontamination, exact_dedup, minhash, mixing, sharding, spelling, toxicity, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_conversations(chat.as_streamed(rows)))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.resolved(warc.captures(table(spark, sf_dir, "pages"))))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), find=False).select("doc_id", "held_out", "score", "predicted")


def public_ranks() -> dict[bytes, int]:
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), public_ranks()))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), damage=spelling.DAMAGE)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.digests(conversation_repair.repairs(conversation_repair.damaged(given)), given)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_chat_formatting, op3_source_mixing, op4_warc_revisits, op5_nearest_neighbours, op6_minhash_dedup, op7_exact_dedup, op8_sharding, op9_toxicity, op10_byte_bpe, op11_spelling_variants, op12_conversation_repair, op13_decontamination)}
ORACLES = {"op1_url_filter": url_filter.ORACLE, "op2_chat_formatting": chat.ORACLE, "op3_source_mixing": mixing.ORACLE, "op4_warc_revisits": warc.ORACLE, "op6_minhash_dedup": minhash.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op12_conversation_repair": conversation_repair.ORACLE, "op13_decontamination": decontamination.ORACLE}
