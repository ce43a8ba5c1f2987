"""Exact duplicates by an extendible-hash index kept on shared files."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherline.llm.shared import held_back, hot_join, shared_folder, written

#: Distinct keys that a bucket holds before it splits; with more than half of MOST_BUCKETS such buckets, buckets grow instead.
BUCKET_KEYS, MOST_BUCKETS = 50_000, 1 << 14
#: Bits of the key that a first pass over the keys looks ahead, counts that any pass brings back, and all bits there are.
STEP_BITS, PASS_COUNTS, KEY_BITS = 14, 1 << 18, 64
#: Copies of one text are merged in so many places before its owner merges those.
SALTS = 64


def split(root: tuple[int, int], counts: dict[int, int], bits: int, room: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The buckets ``(prefix, local depth)`` under ``root``, and those among them that must be split beyond ``bits``.

    ``counts``: distinct keys by their first ``bits`` bits. A bucket with more than ``room`` keys splits by its next bit.
    """
    done, more, todo = [], [], [(root, {p: n for p, n in counts.items() if p >> (bits - root[1]) == root[0]})]
    while todo:
        (prefix, local), held = todo.pop()
        if sum(held.values()) <= room:
            done.append((prefix, local))
        elif local == bits:
            more.append((prefix, local))
        else:
            shift = bits - local - 1
            todo += [((prefix << 1 | bit, local + 1), {p: n for p, n in held.items() if (p >> shift) & 1 == bit}) for bit in (0, 1)]
    return done, more


def first_bits(bits: int) -> Column:
    return F.shiftrightunsigned("key", KEY_BITS - bits) if bits else F.lit(0).cast("bigint")


def grown(keys: DataFrame, room: int) -> list[tuple[int, int]]:
    """The buckets of distinct ``keys``: looks STEP_BITS ahead, and further only into overfull buckets.

    A pass looks so far ahead, one bit at least, that PASS_COUNTS counts come back, or two for each overfull bucket,
    which hold more than ``room`` keys each. There is no limit of depth but the key's bits, at which a bucket has one key.
    """
    spark, leaves, open_ones, depth = keys.sparkSession, [], [(0, 0)], 0
    while open_ones:
        ahead = max(1, min(STEP_BITS, (PASS_COUNTS // len(open_ones)).bit_length() - 1))
        bits = min(depth + ahead, KEY_BITS)
        inside = keys
        if depth:
            inside = keys.join(F.broadcast(spark.createDataFrame([(p,) for p, _ in open_ones], "_open bigint")), first_bits(depth) == F.col("_open"), "left_semi")
        counts = {r["p"]: r["n"] for r in inside.groupBy(first_bits(bits).alias("p")).agg(F.count("*").alias("n")).collect()}
        parts = [split(root, counts, bits, room if bits < KEY_BITS else max(room, 1)) for root in open_ones]
        leaves += [leaf for done, _ in parts for leaf in done]
        open_ones, depth = [leaf for _, more in parts for leaf in more], bits
    return sorted(leaves, key=lambda x: x[0] << (KEY_BITS - x[1]))


@dataclass
class Index:
    """Where the index's files lie, its depth, and the key of each row ``(doc_id, key, sha)``."""

    root: str
    depth: int
    rows: int
    keys: DataFrame

    def _read(self, name: str) -> DataFrame:
        return self.keys.sparkSession.read.parquet(f"{self.root}/{name}")

    @property
    def directory(self) -> DataFrame:
        """``slot, bucket`` of each of the 2**depth slots."""
        return self._read("directory")

    @property
    def entries(self) -> DataFrame:
        """A row for each distinct text: ``bucket, key, chain, chain_length, keep_id, group_size``, and ``body`` in chains."""
        return self._read("entries")

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the bucket that the directory names for their key's first bits."""
        return rows.withColumn("slot", first_bits(self.depth)).join(self.directory, "slot").drop("slot")


def keyed(docs: DataFrame, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    body = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(body)
    return docs.select(F.col(id_col).alias("doc_id"), F.shiftleft(F.shiftright(key, 64 - key_bits), 64 - key_bits).alias("key") if key_bits < 64 else key.alias("key"), body.alias("body"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS, key_bits: int = 64) -> Index:
    """The index of all rows, on files of the shared folder. ``key_bits`` under 64 is for tests of collisions.

    1. Keys are counted; buckets split until they hold few enough distinct keys, and the directory gives each slot its
    bucket: a range of keys. 2. A key of one row gets its entry as it is. Texts whose key several rows have move to the
    bucket's owner task: a sketch of those keys holds back nearly all others. Copies
    merge in map tasks and in SALTS places, so a text with a third of all rows reaches its owner in SALTS rows at most.
    3. Owners have whole buckets. They compare bytes by grouping on the text itself; different texts of one key chain.
    4. Entries are written in a folder for each bucket.
    """
    spark, root = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/gatherline/dedup-index-{uuid.uuid4().hex}"
    texts = keyed(docs, id_col, text_col, key_bits)
    keys = written(texts.select("doc_id", "key", F.unhex(F.sha2("body", 256)).alias("sha")), "dedup-keys", f"{root}/keys")
    counts = written(keys.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id")), "dedup-counts", f"{root}/counts")
    size = counts.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    leaves = grown(counts, max(bucket_keys, 2 * size["keys"] // MOST_BUCKETS))
    depth = max(local for _, local in leaves)
    ranges = spark.createDataFrame([(i, p << (depth - local), 1 << (depth - local)) for i, (p, local) in enumerate(leaves)], "bucket int, first bigint, slots bigint")
    ranges.select(F.explode(F.expr("sequence(first, first + slots - 1)")).alias("slot"), "bucket").write.parquet(f"{root}/directory")
    index = Index(root, depth, size["rows"], keys)

    single = index.placed(counts.where("n = 1")).select("bucket", "key", F.lit(1).alias("chain"), F.lit(1).cast("bigint").alias("chain_length"), "keep_id", F.col("n").alias("group_size"), F.lit(None).cast("string").alias("body"))
    asked = held_back(texts, F.col("key"), counts.where("n > 1"), F.col("key"))
    some = index.placed(asked).groupBy("bucket", "key", "body", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    owned = some.repartition("bucket").groupBy("bucket", "key", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    chain = Window.partitionBy("bucket", "key")
    owned = owned.withColumns({"chain_length": F.count("*").over(chain), "held": F.sum("group_size").over(chain), "chain": F.row_number().over(chain.orderBy("body"))})
    owned = owned.where("held > 1").select("bucket", "key", "chain", "chain_length", "keep_id", "group_size", F.when(F.col("chain_length") > 1, F.col("body")).alias("body"))
    single.repartition("bucket").unionByName(owned).write.partitionBy("bucket").parquet(f"{root}/entries")
    return index


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS, key_bits: int = 64) -> DataFrame:
    """One row a document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts of any length are equal when their bytes are; a null text counts as empty. The largest ``doc_id`` of equal
    texts stays (null ids lose; a group of null ids keeps them). Rows that repeat a doc_id and its text are all marked
    alike. An empty table gives no rows. Other columns are not read.

    Each row finds its bucket by the directory and its entry by its key in that bucket. Entries with a thousandth of
    all rows, a thousand at most, are broadcast, so their rows stay where they are. Rows of a key that chains bring
    their text and are compared with the chain's by their bytes.
    """
    index = build_index(docs, id_col, text_col, bucket_keys, key_bits)
    if not index.rows:
        return index.keys.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    rows, whole = index.placed(index.keys), index.entries.where("chain_length = 1").select("bucket", "key", "keep_id", "group_size")
    found = hot_join(rows, whole, ["bucket", "key"], "group_size", index.rows).select("doc_id", "keep_id", "group_size", "sha")
    chained = index.entries.where("chain_length > 1")
    if not chained.isEmpty():
        own = keyed(docs, id_col, text_col, key_bits).join(chained.select("key").distinct(), "key", "left_semi")
        by_bytes = index.placed(own).join(chained.select("bucket", "key", "body", "keep_id", "group_size"), ["bucket", "key", "body"])
        found = found.unionByName(by_bytes.select("doc_id", "keep_id", "group_size", F.unhex(F.sha2("body", 256)).alias("sha")))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, texts untouched; repeated rows of the doc_id that stays all stay (see ``one_of_each``)."""
    kept = exact_groups(docs).where("kept").select("doc_id", "text_sha256").distinct()
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    keep = kept.select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_keep"]) & (digest == keep["_sha"]), "left_semi")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each doc_id and text (null as empty), all columns as they were.

    Rows that nothing repeats pass through. Of repeated rows the least by all columns as JSON stays; they are merged
    before the exchange, so a row with very many repeats costs one row a map task.
    """
    named = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256)).alias("sha"))
    counts = named.groupBy("id", "sha").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_id"), F.col("sha").alias("_sha"))
    repeated = written(counts, "dedup-repeated")
    if repeated.isEmpty():
        return docs
    same = named["id"].eqNullSafe(repeated["_id"]) & (named["sha"] == repeated["_sha"])
    least = named.join(repeated, same, "left_semi").groupBy("id", "sha").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return named.join(repeated, same, "left_anti").select("row.*").unionByName(least.select("row.*"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
