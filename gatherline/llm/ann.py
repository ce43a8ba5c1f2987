"""Approximate nearest neighbours: a k-means tree searched best bin first, visits widened to a calibrated recall."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherline.llm.shared import literal_longs, sampled, written

K, BRANCH = 20, 16
#: The tree is fitted on so many vectors at most, and calibrated with so many queries, both chosen by hashed id.
FIT_ROWS, CALIBRATION_QUERIES = 65_536, 128
#: A leaf holds about LEAF_ROWS vectors; no more leaves than a quarter of FIT_ROWS, so raise that for tables over 500,000 rows.
LEAF_ROWS = 32
TARGET_RECALL = 0.97
#: Leaves are dealt to search groups of about so many vectors; a leaf with more is cut into several.
GROUP_ROWS, LEAST_GROUPS = 20_000, 16
#: A search group is searched by so many queries at a time, and one product of matrices has so many entries at most.
BLOCK_QUERIES, PRODUCT = 50_000, 1 << 21
#: What double precision may be off by in a matrix product, as a share of both norms; contenders are scored again exactly.
SLIP = 1e-9


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v``: the vectors of the commonest length that are non-zero and finite, in their own precision."""
    kind = vectors.schema[vec_col].dataType.simpleString()
    v = F.col(vec_col) if kind in ("array<float>", "array<double>") else F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(F.coalesce(finite, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    some = np.unique(x[rng.choice(len(x), min(len(x), 64 * k), replace=False)], axis=0)
    distinct = some if len(some) > 1 else np.unique(x, axis=0)
    k = min(k, len(distinct))
    centers = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = (x @ centers.T * -2 + (centers**2).sum(1)).argmin(1)
        for c in range(k):
            if (near == c).any():
                centers[c] = x[near == c].mean(0)
    return centers


class Tree:
    """Centers by node; children by node (none for a leaf); leaves numbered from 0."""

    def __init__(self, x: np.ndarray, leaves: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centers, self.children, self.leaf = [x.mean(0)], [[]], [-1]
        todo = [(-len(x), 0, np.arange(len(x)))]
        open_leaves = 1
        while todo and open_leaves < leaves:
            size, node, rows = heapq.heappop(todo)
            centers = _kmeans(x[rows], min(BRANCH, leaves - open_leaves + 1), rng) if -size > 1 else []
            if len(centers) < 2:
                continue
            near = (x[rows] @ centers.T * -2 + (centers**2).sum(1)).argmin(1)
            for c in range(len(centers)):
                self.children[node].append(len(self.centers))
                self.centers.append(centers[c])
                self.children.append([])
                self.leaf.append(-1)
                heapq.heappush(todo, (-int((near == c).sum()), len(self.centers) - 1, rows[near == c]))
            open_leaves += len(centers) - 1
        self.centers = np.array(self.centers)
        for i, node in enumerate(n for n in range(len(self.children)) if not self.children[n]):
            self.leaf[node] = i
        self.leaves = max(self.leaf) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row descends to."""
        at = np.zeros(len(x), np.int64)
        moving = np.arange(len(x)) if self.children[0] else np.empty(0, int)
        while len(moving):
            for node in np.unique(at[moving]):
                rows = moving[at[moving] == node]
                kids = np.array(self.children[node])
                c = self.centers[kids]
                at[rows] = kids[(x[rows] @ c.T * -2 + (c**2).sum(1)).argmin(1)]
            moving = moving[[bool(self.children[n]) for n in at[moving]]]
        return np.array(self.leaf)[at]

    def gaps(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of queries to all centers, less the queries' own squares."""
        return q @ self.centers.T * -2 + (self.centers**2).sum(1)

    def order(self, gap: list[float], most: int | None = None, rows: list[int] | None = None, enough: int = 0) -> list[int]:
        """Leaves best bin first: a queue of nodes by distance to their centers, opened from the root.

        Ends after ``most`` leaves, but not before these hold ``enough`` by ``rows``, the rows of each leaf.
        """
        queue, out, held = [(gap[0], 0)], [], 0
        while queue and (most is None or len(out) < most or held < enough):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for c in self.children[node]:
                    heapq.heappush(queue, (gap[c], c))
            else:
                out.append(self.leaf[node])
                held += rows[self.leaf[node]] if rows else 0
        return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """One more component brings all vectors to the largest norm: nearest is then largest inner product."""
    return np.column_stack([x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inner products of rows in double precision, summed in order of the components: equal vectors give equal bits."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


class Best:
    """The best ``k`` rows of each query so far, and all that a slip of the product may have put below them."""

    def __init__(self, q: np.ndarray, x: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.x, self.own, self.ids, self.k = q, x, own, ids, k
        self.slip = SLIP * np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max(initial=0.0))
        #: each query's k largest products, the least of them first
        self.top = np.full((len(q), k), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def offer(self, who: np.ndarray, rows: np.ndarray) -> None:
        """Score queries ``who`` against ``rows``, all with all, each pair once; what lies under a query's floor is passed over."""
        score = self.q[who] @ self.x[rows].T
        score[self.own[who][:, None] == self.ids[rows]] = -np.inf
        self.top[who] = np.partition(np.concatenate([self.top[who], score], axis=1), -self.k, axis=1)[:, -self.k :]
        i, j = np.nonzero((score >= (self.top[who, 0] - self.slip[who])[:, None]) & (score > -np.inf))
        self.found.append((who[i], rows[j], score[i, j]))
        self.held += len(i)
        if self.held > PRODUCT:
            self.pack()

    def pack(self) -> None:
        who, row, score = (np.concatenate(c) for c in zip(*self.found, strict=True))
        keep = score >= self.top[who, 0] - self.slip[who]
        self.found, self.held = [(who[keep], row[keep], score[keep])], int(keep.sum())

    def exact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and exact score of the best, ties to the smaller id."""
        self.pack()
        who, row, _ = self.found[0]
        score = products(self.q[who], self.x[row])
        order = np.lexsort((self.ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < self.k
        return who[keep], row[keep], score[keep]


FOUND = "query bigint, query_id bigint, vec_id bigint, row bigint, score double"


def _searched(k: int, enough: int):
    """``enough``: of equal vectors no query takes more than so many, the smallest ids; a group's others are passed over."""

    def searched(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame({c.split()[0]: np.empty(0) for c in FOUND.split(", ")})
        vectors = vectors.sort_values(["leaf", "vec_id", "row"])
        alike = vectors["v"].map(lambda v: v.tobytes())
        vectors = vectors[vectors.groupby(alike, sort=False).cumcount() < enough]
        leaf = vectors["leaf"].to_numpy()
        best = Best(np.stack(queries["v"]).astype(float), np.stack(vectors["v"]).astype(float), queries["query_id"].to_numpy(), vectors["vec_id"].to_numpy(), k)
        visitor, visited = np.repeat(np.arange(len(queries)), queries["leaves"].map(len)), np.concatenate(queries["leaves"].tolist())
        order = np.argsort(visited, kind="stable")
        visitor, visited = visitor[order], visited[order]
        for one in np.unique(visited):
            rows = np.arange(*np.searchsorted(leaf, [one, one + 1]))
            who = visitor[slice(*np.searchsorted(visited, [one, one + 1]))]
            for at in range(0, len(rows), 2048):
                for w in range(0, len(who), PRODUCT // 2048):
                    best.offer(who[w : w + PRODUCT // 2048], rows[at : at + 2048])
        if not best.found:
            return pd.DataFrame({c.split()[0]: np.empty(0) for c in FOUND.split(", ")})
        who, row, score = best.exact()
        return pd.DataFrame({"query": queries["query"].to_numpy()[who], "query_id": best.own[who], "vec_id": best.ids[row], "row": vectors["row"].to_numpy()[row], "score": score})

    return searched


def _chosen(rows: DataFrame, name: str, n: int, total: int) -> pa.Table:
    """``vec_id, v`` of the rows of smallest hashed id; where ids repeat so much that the bound finds few, of all rows."""
    found = sampled(rows, name, "vec_id", n, total).select("vec_id", "v").toArrow()
    if found.num_rows < min(n, total):
        found = sampled(rows, name, "vec_id", n, 0).select("vec_id", "v").toArrow()
    return found


class Index:
    """The tree, and every usable vector with its leaf, written once; a row is known by a number of its own."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", fit_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS, group_rows: int = GROUP_ROWS):
        rows = usable(vectors, id_col, vec_col)
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        stats = rows.agg(F.count("*").alias("n"), F.max(norm).alias("top")).first()
        self.n, self.top, self.spark = stats["n"], stats["top"] or 0.0, vectors.sparkSession
        if not self.n:
            return
        sample = _chosen(rows, "fit", fit_rows, self.n)
        self.tree = tree = Tree(lifted(_matrix(sample.column("v")), self.top), max(1, min(self.n, fit_rows // 4 * leaf_rows) // leaf_rows))
        top = self.top

        def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    leaf = tree.assign(lifted(_matrix(b.column("v")), top))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=["vec_id", "v", "row", "leaf"])

        kind = rows.schema["v"].dataType.simpleString()
        numbered = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "v", F.monotonically_increasing_id().alias("row"))
        self.rows = written(numbered.mapInArrow(leaves, f"vec_id bigint, v {kind}, row bigint, leaf int"), "ann-leaves")
        self.groups = max(LEAST_GROUPS, -(-self.n // group_rows))
        counts = {r["leaf"]: r["n"] for r in self.rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf of the tree
        self.held = [counts.get(i, 0) for i in range(tree.leaves)]
        self.cuts = [max(1, -(-n // group_rows)) for n in self.held]
        #: rows of one id, at most: a query's own rows are no candidates
        self.repeats = self.rows.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        self.block_queries = BLOCK_QUERIES

    def placed(self) -> DataFrame:
        cuts = F.element_at(literal_longs(self.cuts), F.col("leaf") + 1)
        return self.rows.withColumn("group", F.pmod(F.col("leaf") + F.pmod(F.xxhash64("row"), cuts), F.lit(self.groups)).cast("int"))

    def visiting(self, queries: DataFrame, visits: int | None, k: int) -> DataFrame:
        """``group, query, query_id, v, leaves``: each query once for every group that holds a leaf it visits.

        Visits go on until the leaves hold ``k`` rows besides the query's own.
        """
        tree, cuts, groups, held, enough = self.tree, self.cuts, self.groups, self.held, k + self.repeats

        def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                    at, group, leaves = [], [], []
                    q = _matrix(b.column("v"))
                    for i, gap in enumerate(tree.gaps(np.column_stack([q, np.zeros(len(q))])).tolist()):
                        by_group: dict[int, list[int]] = {}
                        for leaf in tree.order(gap, visits, held, enough):
                            for c in range(min(cuts[leaf], groups)):
                                by_group.setdefault((leaf + c) % groups, []).append(leaf)
                        at += [i] * len(by_group)
                        group += by_group.keys()
                        leaves += by_group.values()
                    rows = b.take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), *(rows.column(c) for c in ("row", "vec_id", "v")), pa.array(leaves, pa.list_(pa.int32()))], names=["group", "query", "query_id", "v", "leaves"])

        return queries.select("row", "vec_id", "v").mapInArrow(out, f"group int, query bigint, query_id bigint, v {self.rows.schema['v'].dataType.simpleString()}, leaves array<int>")

    def scan(self, queries: DataFrame, visits: int | None, k: int) -> DataFrame:
        """``query, query_id, vec_id, row, score, rank`` of the k best in the visited leaves, rows of the query's own id left out."""
        blocks = max(1, -(-queries.count() // self.block_queries))
        asked = self.visiting(queries, visits, k).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
        dealt = self.placed().withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        found = asked.groupBy("group", "block").cogroup(dealt.groupBy("group", "block")).applyInPandas(_searched(k, k + self.repeats), FOUND)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
        return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)

    def calibrated(self, k: int = K, recall: float = TARGET_RECALL, queries: int = CALIBRATION_QUERIES) -> int:
        """The fewest leaf visits at which the calibration queries find ``recall`` of their true neighbours.

        The truth comes from all rows: each task keeps its best for the few queries. Visits then widen leaf by leaf
        until the recall is reached.
        """
        chosen = _chosen(self.rows, "calibrate", queries, self.n)
        q, own = _matrix(chosen.column("v")), chosen.column("vec_id").to_numpy()

        def nearest_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0))
            for b in batches:
                if b.num_rows:
                    best = Best(q, _matrix(b.column("v")), own, b.column("vec_id").to_numpy(), k)
                    best.offer(np.arange(len(q)), np.arange(b.num_rows))
                    who, row, score = best.exact()
                    who, leaf, score = (np.concatenate(c) for c in zip(kept, (who, b.column("leaf").to_numpy()[row], score), strict=True))
                    order = np.lexsort((-score, who))
                    order = order[np.arange(len(who)) - np.searchsorted(who[order], who[order]) < k]
                    kept = (who[order], leaf[order], score[order])
            yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int64()), pa.array(kept[1], pa.int32()), pa.array(kept[2], pa.float64())], names=["who", "leaf", "score"])

        rank = F.row_number().over(Window.partitionBy("who").orderBy(F.desc("score"), "leaf"))
        truth = self.rows.select("vec_id", "v", "leaf").mapInArrow(nearest_here, "who bigint, leaf int, score double").withColumn("rank", rank).where(F.col("rank") <= k).toPandas()  # queries * k rows
        if not len(truth):
            return self.tree.leaves
        steps, gaps = np.zeros(self.tree.leaves, np.int64), self.tree.gaps(np.column_stack([q, np.zeros(len(q))])).tolist()
        for who, leaves in truth.groupby("who")["leaf"]:
            place = {leaf: i for i, leaf in enumerate(self.tree.order(gaps[who]))}
            np.add.at(steps, [place[x] for x in leaves], 1)
        return int(np.searchsorted(np.cumsum(steps), recall * len(truth)) + 1)


def nearest(vectors: DataFrame, queries: Column, k: int = K, recall: float = TARGET_RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest inner product found for each row where ``queries`` holds.

    ``queries`` is a condition on ``vec_id``. Every usable row is indexed, and a candidate for all queries but those of
    its own id; a row that repeats an id is a candidate, and a query, of its own. Vectors that are null, zero, of
    another length than most, or hold null or non-finite components take no part. Ties go to the smaller id. No usable
    vectors, no rows. The recall is calibrated against all rows on a bounded set of queries.
    """
    index = Index(vectors, id_col, vec_col)
    if not index.n:
        return index.spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    found = index.scan(index.rows.where(queries), index.calibrated(k, recall), k)
    return found.select("query_id", "rank", "vec_id", "score")
