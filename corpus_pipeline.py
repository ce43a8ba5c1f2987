"""A corpus pipeline of five stages; each reads what its predecessor kept, written as Parquet in between.

Toxic documents go; of equal texts one row stays; of near-duplicate groups one document stays; sources are mixed to
their target weights (a document is repeated as often as it is drawn); what is left is encoded and decoded.

In every stage null texts count as empty, texts of any length are worked on whole, further columns of any name stay as
they are, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherline.llm import bpe, exact_dedup, minhash, mixing, toxicity
from gatherline.llm.queries import public_ranks, table
from gatherline.llm.shared import written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score under the threshold; weights are learned from ``labels`` as ``toxicity.train`` says.

    Rows that repeat are scored alike; empty texts stay; without usable labels all rows stay.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest doc_id, null ids last; of rows that repeat both, one."""
    return exact_dedup.one_of_each(exact_dedup.drop_copies(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id; empty texts and null ids all stay."""
    return minhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix draws it, shard by shard; the null source is a source, and a text without words is
    drawn as its place in its source's order is. Rows that repeat share a place."""
    return mixing.draw_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row drawn."""
    return bpe.digests(bpe.encode(docs, public_ranks()))


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("minhash_dedup", near), ("source_mixing", mixed), ("byte_bpe", tokens)]

#: Hash sketches, learned weights and byte-pair merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``: the digests of what is left, a row for each row drawn.

    What a stage gives is written before the next one reads it, so lost executors repeat one stage at most.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
