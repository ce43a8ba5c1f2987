"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherline.llm.shared import written

WEIGHTS, CAP, SEED = (1, 2, 3), 3, "mix-1"
#: Shards, and blocks that each is dealt, about; a block is so many words as that makes.
SHARDS, BLOCKS = 16, 1024
#: Documents in a range of permuted order that is summed up by itself, and words in a written piece of a shard.
RANGE_DOCS, PIECE_WORDS = 4096, 16_000_000
SPACE = 1 << 60


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def draw_key(doc_id: Column, seed: str) -> Column:
    """A document's place in its source's permuted order: 60 bits of an md5, the same in any engine and run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, docs, source_size, target``: the targets share all sizes by weight, none above ``cap`` times its source.

    One row for each source; sources by code point, null last, take the weights in turn. In order of the size at
    which a source fills up for its weight (those at the same size by code point, null last), the sources before have
    filled up and the rest share what is left.
    """
    totals = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("full", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    before = Window.orderBy((F.col("full") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / rest).withColumn("is_full", F.col("full") <= F.col("weight") * F.col("level"))
    level = F.min(F.when(~F.col("is_full"), F.struct(F.col("full") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)["level"]
    return ranked.withColumn("share", level).select("source", "docs", "source_size", F.when(F.col("is_full"), F.col("full")).otherwise(F.col("weight") * F.col("share")).alias("target"))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` draws without replacement are good; for counts of any size.

    Inverts the distribution from ratios of neighbouring chances, over twelve deviations and more around its mode.
    """
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    every = good + bad
    mode = min(max((sample + 1) * (good + 1) // (every + 2), low), high)
    reach = 40 + int(12 * (sample * (good / every) * (bad / every) * ((every - sample) / max(every - 1, 1))) ** 0.5)
    first = max(low, mode - reach)
    k = np.arange(first, min(high, mode + reach), dtype=float)
    steps = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    log_chance = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(log_chance - log_chance.max()))
    return first + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def split_node(pdf: pd.DataFrame) -> pd.DataFrame:
    """Split one tree node's block quotas between its two halves of the shards: a multivariate hypergeometric draw."""
    lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
    if hi - lo == 1:
        return pdf
    pdf = pdf.sort_values("source", na_position="last", kind="stable")
    quotas, mid = [int(q) for q in pdf["quota"]], (lo + hi) // 2
    # each shard's room is total // shards, one more for the first total % shards
    base, more = divmod(int(pdf["all_blocks"].iloc[0]), int(pdf["shards"].iloc[0]))
    room = sum(base + (s < more) for s in range(lo, mid))
    rng = np.random.default_rng([lo, hi, sum(quotas), int(pdf["seed"].iloc[0])])
    left, rest = [], sum(quotas)
    for quota in quotas:
        rest -= quota
        left.append(hypergeometric(rng, quota, rest, room))
        room -= left[-1]
    return pd.concat([pdf.assign(hi=mid, quota=left), pdf.assign(lo=mid, quota=[q - x for q, x in zip(quotas, left, strict=True)])])


def shard_bounds(quotas: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """``source, bounds``: the ends of each shard's range in the source's permuted blocks, from the splitting tree.

    ``quotas(source, quota)``. Level by level each node's quotas are split by a multivariate hypergeometric draw, so
    shards get exact, disjoint block counts of every source and even totals. A node has a row for each source.
    """
    node = quotas.select("source", "quota", F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.sum("quota").over(Window.partitionBy()).alias("all_blocks"), F.lit(shards).alias("shards"), F.lit(seed).alias("seed"))
    width = shards
    while width > 1:
        node = node.groupBy("lo", "hi").applyInPandas(split_node, node.schema)
        width = (width + 1) // 2
    ends = F.sum("quota").over(Window.partitionBy("source").orderBy("lo"))
    return node.select("source", "lo", ends.alias("end")).groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("lo", "end"))), lambda x: x["end"]).alias("bounds"))


def mix_plan(docs: DataFrame, shards: int = SHARDS, weights=WEIGHTS, cap: float = CAP, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """``(sizes, plan)``, written: a narrow row for each document, and a row for each source.

    A source's documents in permuted order, pass behind pass, are a line of words; its target is the part to draw, cut
    into ``quota`` blocks of equal length, about BLOCKS for each shard in all. The tree deals the blocks to the shards.
    """
    sizes = written(docs.select("doc_id", F.col("source"), n_words(F.col("text")).alias("size"), draw_key(F.col("doc_id"), seed).alias("draw")), "mix-sizes")
    targets = source_targets(sizes, weights, cap).withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("docs") / RANGE_DOCS)).cast("bigint"))
    block = F.sum("target").over(Window.partitionBy()) / (shards * BLOCKS)
    targets = written(targets.withColumn("quota", F.when(F.col("target") > 0, F.ceil(F.col("target") / block)).otherwise(0).cast("bigint")), "mix-targets")
    return sizes, written(on_source(targets, shard_bounds(targets.select("source", "quota"), shards), "left"), "mix-plan")


def places(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``doc_id, source, size, draw, middle``: the words of its source before a document's middle, in permuted order.

    Two levels: ranges of the order are summed up, and words run inside a range only, so no window spans a source.
    """
    ranged = on_source(sizes, plan.select("source", "ranges")).withColumn("range", range_of("draw", "ranges")).drop("ranges")
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("source", "range").agg(F.sum("size").alias("words")).select(F.col("source").alias("_s"), F.col("range").alias("_r"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = F.sum("size").over(Window.partitionBy("source", "range").orderBy("draw"))
    out = ranged.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
    return out.select("doc_id", "source", "size", "draw", (F.col("start") + inside - F.col("size") / 2).alias("middle"))


def on_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``source``; the null source meets itself."""
    return left.join(right.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")


def range_of(draw: str, ranges: str) -> Column:
    """The range of a place in permuted order: ranges are equal parts of it."""
    return F.expr(f"CAST({draw} DIV (CAST({SPACE} AS BIGINT) DIV {ranges} + 1) AS BIGINT)")


def dealt(places: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """``places`` plus ``source_size, target, placed``: ``(copy, shard, order_key)`` for each block that a copy is in.

    A copy belongs to the block that holds its middle, and goes where the tree dealt that block; blocks behind the
    quota are nobody's. Sorting a shard by ``order_key`` shuffles it.
    """
    out = on_source(places, plan.select("source", "source_size", "target", "quota", "bounds"))
    line = lambda e: e * F.col("source_size") + F.col("middle")
    block = lambda e: F.floor(line(e) * F.col("quota") / F.col("target"))
    shard = lambda e: F.size(F.filter("bounds", lambda end: end <= block(e)))
    each = lambda e: F.struct(e.alias("copy"), shard(e).alias("shard"), order_key(F.col("doc_id"), e, seed).alias("order_key"))
    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("target") / F.col("source_size")) - 1, F.lit(0)).cast("int"))
    placed = F.filter(F.transform(passes, each), lambda p: p["shard"] < F.size("bounds"))
    return out.withColumn("placed", F.when(F.col("quota") > 0, placed).otherwise(F.array().cast(PLACED))).drop("quota", "bounds")


PLACED = "array<struct<copy:int,shard:int,order_key:bigint>>"


def order_key(doc_id: Column, copy: Column, seed: str) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, copy)


def mix(docs: DataFrame, shards: int = SHARDS, weights=WEIGHTS, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """One row a document: ``doc_id, source, size, source_size, target, taken, placed``.

    ``taken`` are the words of the copies that the shards were dealt, whole passes over its source and one more for
    some; a source's sum is within half a document of its target. Texts of any length count with all their words; null
    texts and texts without words have size 0; the null source is a source. Repeated rows share a place and are taken
    alike. Empty tables give no rows. Other columns are not read. Sources are few: each tree node has a row for each.
    """
    sizes, plan = mix_plan(docs, shards, weights, cap, seed)
    return dealt(places(sizes, plan), plan, seed).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("placed")).alias("taken"), "placed")


def draw_mix(docs: DataFrame, shards: int = SHARDS, weights=WEIGHTS, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: ``docs``' rows, each as often as it is drawn, shard by shard, shuffled inside each shard.

    Texts move once, to their shards: each source's last place in each shard, found on the narrow table, tells the
    shard of every copy. A shard is cut into pieces of about PIECE_WORDS words, ranges of its shuffled order.
    """
    sizes, plan = mix_plan(docs, shards, weights, cap, seed)
    last = dealt(places(sizes, plan), plan, seed).select("source", "draw", F.explode("placed").alias("p")).groupBy("source", "p.shard").agg(F.max(F.struct("p.copy", "draw")).alias("last"))
    ends = written(last.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "last"))).alias("ends")), "mix-ends")
    words = plan.agg(F.sum("target")).first()[0] or 0.0
    pieces = max(1, int(words // (shards * PIECE_WORDS)))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), draw_key(docs["doc_id"], seed).alias("draw"))
    rows = on_source(rows, ends)
    beyond = lambda e: F.filter("ends", lambda end: end["last"] >= F.struct(e.alias("copy"), F.col("draw")))
    each = lambda e: F.struct(F.get(beyond(e), F.lit(0))["shard"].alias("shard"), order_key(F.col("doc_id"), e, seed).alias("order_key"))
    copies = F.filter(F.transform(F.sequence(F.lit(0), F.element_at("ends", -1)["last"]["copy"]), each), lambda p: p["shard"].isNotNull())
    out = rows.select("_row", F.explode(copies).alias("_p")).select("_row", "_p.shard", "_p.order_key")
    out = out.withColumn("piece", F.expr(f"CAST(shiftrightunsigned(order_key, 2) DIV ({1 << 62} DIV {pieces} + 1) AS INT)"))
    return out.repartition("shard", "piece").sortWithinPartitions("shard", "piece", "order_key").select("_row.*")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS draw
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS full_at FROM totals),
levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(full_at) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM ranked WINDOW b AS (ORDER BY full_at / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, full_at <= weight * level AS is_full FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN full_at ELSE weight * (SELECT level FROM flagged WHERE NOT is_full ORDER BY full_at / weight, source NULLS LAST LIMIT 1) END AS target
  FROM flagged),
run AS (
  SELECT s.*, t.source_size, t.target, sum(size) OVER (PARTITION BY s.source ORDER BY draw) - size / 2.0 AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * len(list_filter(range(0, 4), lambda e: e * source_size + middle < target)))::BIGINT AS taken
FROM run
"""
