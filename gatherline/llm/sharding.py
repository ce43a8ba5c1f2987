"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherline.llm.shared import hot_join, literal_longs, written

SHARDS, ROUNDS = 16, 5
#: A range of hashed ids that is ranked by itself has about so many rows; there are MAX_RANGES of them at most.
RANGE_ROWS, MAX_RANGES = 20_000, 65_536
#: Groups up to this size, and a quarter of a shard, move and are placed as one; members of larger ones each by itself.
WHOLE_GROUP = 500
#: While labels spread a shard may hold so many times its share, or full shards would lock each other; rows even out after.
SLACK = 1.5


def place_of(doc_id: Column) -> Column:
    """A document's fixed pseudo-random place: 62 bits of a hash of its id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("shard"), doc_id), 2)


def propagated(members: DataFrame, shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, anchor, shard`` of linked documents after ``rounds`` of label propagation.

    ``members(doc_id, link, anchor)``: documents that share a link are neighbours; a link costs a row for each member
    and shard, never a pair. In each round a document asks for the shard where most of its neighbours are (ties by a
    hash that its neighbours share). Requests to a shard are granted to a hashed share of the anchors that ask, so
    that its linked documents stay within ``capacity``. All state is a narrow table, rewritten each round.
    """
    state = written(members.groupBy("doc_id").agg(F.min("anchor").alias("anchor")).select("doc_id", "anchor", F.pmod(place_of(F.col("doc_id")), F.lit(shards)).cast("int").alias("shard")), "shard-labels")
    n_members = members.count()
    for turn in range(rounds):
        at = members.select("doc_id", "link").join(state, "doc_id")
        counts = at.groupBy("link", "shard").agg(F.count("*").alias("n"))
        counts = counts.withColumn("weight", F.sum("n").over(Window.partitionBy("link")))
        votes = hot_join(members.select("doc_id", "link"), counts, ["link"], "weight", n_members).groupBy("doc_id", "shard").agg(F.sum("n").alias("votes"), F.min(F.xxhash64("link", "shard")).alias("tie"))
        want = votes.groupBy("doc_id").agg(F.max(F.struct("votes", "tie", "shard"))["shard"].alias("want"))
        asked = written(state.join(want, "doc_id"), "shard-requests")
        flows = asked.groupBy("shard", "want").agg(F.count("*").alias("n")).collect()  # shards * shards rows at most
        asks = [[0] * shards for _ in range(shards)]
        for r in flows:
            asks[r["shard"]][r["want"]] += r["n"]
        if all(i == j or not n for i, row in enumerate(asks) for j, n in enumerate(row)):
            break
        share = quotas(asks, capacity)
        granted = F.pmod(F.xxhash64(F.lit(turn), "anchor"), F.lit(1_000_000)) < F.element_at(literal_longs([int(1_000_000 * s) for s in share]), F.col("want") + 1)
        state = written(asked.select("doc_id", "anchor", F.when(granted, F.col("want")).otherwise(F.col("shard")).alias("shard")), "shard-labels")
    return state


def quotas(asks: list[list[int]], capacity: int) -> list[float]:
    """The share of the requests to each shard that is granted.

    ``asks[i][j]``: documents in i that ask for j. A shard takes in what it has room for, and what leaves it; the
    shares start at 1 and come down until no shard ends up above ``capacity``.
    """
    all_shards = range(len(asks))
    held = [sum(row) for row in asks]
    into = [sum(asks[i][j] for i in all_shards if i != j) for j in all_shards]
    share = [1.0] * len(asks)
    for _ in range(200):
        leaving = [sum(asks[j][i] * share[i] for i in all_shards if i != j) for j in all_shards]
        share = [min(share[j], max(0.0, capacity - held[j] + leaving[j]) / into[j]) if into[j] else 1.0 for j in all_shards]
    return share


def ranked(rows: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    """``rows`` with ``name``: gapless ranks from 0 in each group of ``by``, in order of ``place``.

    Two levels: ranges of places are counted and summed up, and rows are numbered inside a range only.
    """
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    rows = rows.withColumn("range", F.expr(f"CAST(place DIV ((1L << 62) DIV {ranges} + 1) AS INT)"))
    counts = rows.groupBy(*by, "range").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(counts.withColumn("before", before).drop("c"), [*by, "range"])
    inside = F.row_number().over(Window.partitionBy(*by, "range").orderBy("place", "doc_id", "size")) - 1
    return rows.withColumn(name, F.col("before") + inside).drop("range", "before")


def sharded(docs: DataFrame, shards: int = SHARDS, links: DataFrame | None = None, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. Law ``rows``.

    Shards differ by one row at most; ``slot`` counts from 0 without gaps in each. ``links(doc_id, link)`` names
    neighbours; by default documents of equal text are linked. A group of links that fits a shard ends up in one,
    as far as the quotas allow; larger groups fill shards. ``size``: UTF-8 bytes plus 1; a null text has
    no bytes, and so the ``text_crc32`` of an empty one. Repeated rows and null ids are rows like others; ids that repeat share
    their links. Texts of any length are hashed where they are read and don't move. An empty table gives no rows. Other columns are not read.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit("")), F.octet_length(text)).alias("link"))
    rows = written(rows, "shard-rows")
    members = (rows if links is None else links).where("doc_id IS NOT NULL").select("doc_id", "link").distinct()
    shared = members.groupBy("link").agg(F.count("*").alias("n")).where("n > 1")
    n = rows.count()
    anchor = F.when(F.col("n") <= min(WHOLE_GROUP, n // shards // 4), place_of(F.col("link"))).otherwise(place_of(F.col("doc_id")))
    members = written(hot_join(members, shared, ["link"], "n", n).select("doc_id", "link", anchor.alias("anchor")), "shard-members")
    quota = [n // shards + (j < n % shards) for j in range(shards)]
    labels = propagated(members, shards, int(SLACK * n / shards) + 1, rounds)
    own = F.when(F.col("doc_id").isNotNull(), place_of(F.col("doc_id"))).otherwise(place_of(F.col("link")))
    rows = rows.join(labels, "doc_id", "left").select("doc_id", "size", "text_crc32", "shard", F.coalesce("anchor", own).alias("place"))
    rows = written(rows, "shard-labelled")
    linked = written(ranked(rows.where("shard IS NOT NULL"), ["shard"], n, "slot"), "shard-linked")
    fits = F.col("slot") < F.element_at(literal_longs(quota), F.col("shard") + 1)
    kept = {r["shard"]: r["n"] for r in linked.where(fits).groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    # what has no links, and what a full shard could not keep, fills the room that is left
    rest = rows.where("shard IS NULL").select("doc_id", "size", "text_crc32", "place").unionByName(linked.where(~fits).select("doc_id", "size", "text_crc32", "place"))
    rest = ranked(rest.withColumn("all", F.lit(0)), ["all"], n, "rank")
    ends, total = [], 0
    for j in range(shards):
        ends.append(total := total + quota[j] - kept.get(j, 0))
    shard = F.size(F.filter(literal_longs(ends), lambda e: e <= F.col("rank")))
    first = F.element_at(literal_longs([0, *ends]), F.col("shard") + 1)
    rest = rest.withColumn("shard", shard).withColumn("slot", F.col("rank") - first + F.element_at(literal_longs([kept.get(j, 0) for j in range(shards)]), F.col("shard") + 1))
    names = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    return linked.where(fits).select(*names).unionByName(rest.select(*names))
