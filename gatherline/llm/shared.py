"""Helpers that the operators share: written tables, literal lookup arrays, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of 64 bits in a sketch of keys.
SKETCH_WORDS = 1 << 20
#: Folders made where none is named, by application: local runs and tests.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode one of our own if unset."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root and context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="gatherline-")
    return (root or _OWN[context.applicationId]).rstrip("/")


def written(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = at or f"{shared_folder(spark)}/gatherline/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_longs(values) -> Column:
    """An ARRAY<BIGINT> literal of any length: one string that Catalyst folds, not one node a value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def text_of(cell: pa.Scalar) -> str:
    """The text of an Arrow cell: null is empty, bytes that aren't UTF-8 become replacement characters."""
    try:
        return cell.as_py() or ""
    except UnicodeDecodeError:
        return cell.as_buffer().to_pybytes().decode("utf-8", "replace")


#: A key with at least this share of the rows is hot; there are HOT_SHARE hot keys at most.
HOT_SHARE = 1000


def hot_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """``left`` joined with ``right``, which has a row a key, or a few, and in ``weight`` how many of left's ``total`` rows have it.

    The rows of ``right`` with a thousandth of left's rows, a thousand at most, are broadcast, so the rows of hot keys
    stay where they are; all others meet by an exchange.
    """
    often = F.col(weight) * HOT_SHARE >= total
    hot = F.broadcast(right.where(often))
    return left.join(hot, on).unionByName(left.join(hot.select(*on), on, "left_anti").join(right.where(~often), on))


def held_back(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Those of ``rows`` whose key may be among the wanted ones: all that are, and few others.

    A bit map of hashed keys is broadcast, SKETCH_WORDS words at most whatever the number of keys; with more keys it
    lets more rows pass, so what follows must still join by the key itself.
    """
    hashed = F.xxhash64(F.lit("sketch"), wanted_key)
    bits = wanted.select(hashed.alias("h")).groupBy(F.pmod("h", F.lit(SKETCH_WORDS)).cast("int").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(shiftrightunsigned(h, 58) AS INT))")).alias("_bits"))
    marked = rows.withColumn("_hash", F.xxhash64(F.lit("sketch"), key))
    bit = F.shiftrightunsigned("_hash", 58).cast("int")
    passed = marked.join(F.broadcast(bits), F.pmod(F.col("_hash"), F.lit(SKETCH_WORDS)).cast("int") == F.col("_word"))
    return passed.where(F.getbit("_bits", bit) == 1).drop("_hash", "_word", "_bits")


def sampled(rows: DataFrame, name: str, key: str, n: int, total: int) -> DataFrame:
    """The ``n`` of ``total`` rows whose ``key`` has the smallest hash under ``name``, in that order.

    Of many rows only those under a bound of the hash, about 2 * n + 1000, go on to be sorted, so no task gets ``n``
    of every partition. Fewer than ``n`` may be found only if keys repeat.
    """
    hashed = F.xxhash64(F.lit(name), key)
    if total > 2 * n + 1000:
        rows = rows.where(hashed < F.lit(int((2 * n + 1000) * (1 << 64) // total) - (1 << 63)))
    return rows.orderBy(hashed, key).limit(n)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that what a task makes of them stays small; at the end unused memory goes back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def min_labels(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: rows ``(id, component)``, component the smallest id.

    Alternates large-star and small-star rounds (Kiveris et al. 2014). Each round is an aggregation and a join on
    node ids, written to the shared folder; ends when a round changes no edge, after about the logarithm of the longest
    path's rounds. Null ends and loops are ignored. Edge counts never grow, and hubs' edges stay where they are.
    """
    both = edges.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    parent = written(both.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    old_n = parent.count()
    while old_n:
        # large-star: neighbours above v hang on the smallest of v and its neighbours
        around = parent.unionByName(parent.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = around.groupBy("v").agg(F.min("m").alias("low"), F.count("*").alias("n")).select("v", F.least("v", "low").alias("low"), "n")
        large = hot_join(around, low, ["v"], "n", 2 * old_n).where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()
        large = written(large, "edges")
        # small-star: v and its smaller neighbours hang on the smallest of them
        low = large.groupBy("v").agg(F.min("m").alias("low"), F.count("*").alias("n"))
        joined = hot_join(large, low, ["v"], "n", large.count())
        small = joined.select(F.explode(F.array(F.struct("v", F.col("low").alias("m")), F.struct(F.col("m").alias("v"), F.col("low").alias("m")))).alias("e"))
        new = written(small.select("e.v", "e.m").where("v <> m").distinct(), "edges")
        new_n = new.count()
        same = old_n == new_n and new.join(parent, ["v", "m"], "left_anti").isEmpty()
        parent, old_n = new, new_n
        if same:
            break
    return parent.select(F.col("v").alias("id"), F.col("m").alias("component")).unionByName(parent.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct())
