"""Benchmark decontamination: the words of documents that repeat passages of test items, by Wu and Manber's search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherline.llm.shared import written

#: Words of a window, the test string; an item of fewer words is one window.
WINDOW = 10
#: Words of a block, whose last place in the windows tells how far a search may jump.
BLOCK = 2
#: Words of test items that one pass over the documents looks for; more items take passes of about two thirds of it.
PASS_WORDS = 200_000
#: Items of more words are searched as overlapping segments.
SEGMENT = 5_000

#: ASCII letters lower-cased, digits and all bytes of other characters kept, everything else a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(cell: pa.Scalar) -> list[bytes]:
    """The words of an Arrow cell of text; null has none."""
    return cell.as_buffer().to_pybytes().translate(_FOLD).split() if cell.is_valid else []


class Windows:
    """The search for all windows of one length: a shift for each block, and windows by their last and first blocks."""

    def __init__(self, length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.shift: dict[bytes, int] = {}
        #: last and first block -> [segment, end, items] of each distinct window
        self.buckets: dict[bytes, list[list]] = {}

    def add(self, words: list[bytes], item: tuple) -> None:
        """The windows of a segment's words; ``item`` holds its id, or nothing."""
        m, k = self.length, self.block
        for j in range(k, len(words) + 1):
            block = b" ".join(words[j - k : j])
            self.shift[block] = min(self.shift.get(block, m), max(m - j, 0))
        for j in range(m, len(words) + 1):
            bucket = self.buckets.setdefault(b" ".join(words[j - k : j] + words[j - m : j - m + k]), [])
            for known in bucket:
                if known[0][known[1] - m : known[1]] == words[j - m : j]:
                    known[2] = known[2] if set(item) <= set(known[2]) else known[2] + item
                    break
            else:
                bucket.append([words, j, item])

    def find(self, words: list[bytes], spans: list[list[int]], items: set) -> None:
        """Adds the spans of words inside occurrences, merged and in order, and the items that occur."""
        m, k, shift, buckets = self.length, self.block, self.shift, self.buckets
        far, at, n = m - k + 1, m, len(words)
        while at <= n:
            block = words[at - 2] + b" " + words[at - 1] if k == 2 else words[at - 1]
            jump = shift.get(block, far)
            if jump:  # no window ends here: the block stands earlier in all of them, or in none
                at += jump
                continue
            for segment, end, having in buckets.get(b" ".join([block, *words[at - m : at - m + k]]), ()):
                if segment[end - m : end] == words[at - m : at]:
                    items.update(having)
                    if spans and spans[-1][1] >= at - m:
                        spans[-1][1] = at
                    else:
                        spans.append([at - m, at])
                    break
            at += 1


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _cut(window: int):
    """Items as rows of about SEGMENT words, ``window - 1`` of which the next row repeats."""

    step = max(SEGMENT - window + 1, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = words_of(batch.column(1)[i])
                rows = [words[a : a + step + window - 1] for a in range(0, max(len(words) - window + 1, min(len(words), 1)), step)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(pa.array([0] * len(rows), pa.int64())), pa.array([b" ".join(r) for r in rows], pa.binary()), pa.array([len(r) for r in rows], pa.int64())], names=["item_id", "words", "n"])

    return cut


def _search(segments: list[tuple[object, bytes]], window: int, every: bool):
    """One pass: rows of documents with their spans and items; unless ``every``, only those with any."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[int, Windows] = {}
        for item, text in segments:
            words = text.split(b" ")
            m = min(window, len(words))
            classes.setdefault(m, Windows(m)).add(words, () if item is None else (item,))
        for batch in batches:
            keep, prints, sizes, where, which = [], [], [], [], []
            for i, cell in enumerate(batch.column(1)):
                words, spans, items = words_of(cell), [], set()
                for m in classes:
                    found: list[list[int]] = []
                    classes[m].find(words, found, items)
                    spans += found
                if every or spans:
                    keep.append(i)
                    prints.append(xxhash.xxh3_128_digest(cell.as_buffer().to_pybytes() if cell.is_valid else b""))
                    sizes.append(len(words))
                    where.append([{"begin": a, "end": b} for a, b in _merged(spans)])
                    which.append(list(items))
            ids = batch.column(0).take(pa.array(keep, pa.int64()))
            spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(where, spans_type), pa.array(which, pa.list_(pa.string()))], names=["doc_id", "print", "n_words", "spans", "items"])

    return search


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: ``doc_id, n_words, spans, items``.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, ASCII letters lower-cased. ``spans`` are
    the merged ranges of words, from ``begin`` up to before ``end``, that lie inside an occurrence of a window of any
    item; ``items`` the sorted ids, as strings, of the items whose windows occur. ``items(item_id, text)`` and
    documents are read whole, whatever their length. A null text, or one without words, has no windows and holds none.
    Items that repeat count once by id; an item with a null id marks words, but isn't named. Rows that repeat a
    doc_id, null ids too, each give a row for their own text; other columns of any name are not read. Without documents
    there are no rows, without items no spans.

    Windows of one length are searched at once: from the end of a window's room, the last block of two words tells
    how far every window allows to jump; where it ends some window, those with the same last and first blocks are
    compared word by word. Tables of PASS_WORDS words of items at most go to each task (some 50 MB there); for more
    items the documents are read again for each such share, and only rows with hits meet by an exchange.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    cut = written(items.mapInArrow(_cut(window), "item_id string, words binary, n bigint"), "benchmark-words")
    total = cut.agg(F.sum("n")).first()[0] or 0
    passes = 1 if total <= PASS_WORDS else -(-3 * total // (2 * PASS_WORDS))
    cut = cut.withColumn("pass", F.lit(0) if passes == 1 else F.pmod(F.xxhash64("words"), F.lit(passes)))
    spans, ids = "array<struct<begin:bigint,end:bigint>>", "array<string>"

    def hits(p: int) -> DataFrame:
        segments = [(r.item_id, bytes(r.words)) for r in cut.where(F.col("pass") == p).select("item_id", "words").collect()]
        return docs.mapInArrow(_search(segments, window, p == 0), f"doc_id {kind}, print binary, n_words bigint, spans {spans}, items {ids}")

    out = hits(0)
    if passes > 1:
        more = reduce(DataFrame.unionAll, [hits(p).dropDuplicates(["doc_id", "print"]) for p in range(1, passes)])
        more = more.groupBy(F.col("doc_id").alias("d"), F.col("print").alias("q")).agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
        out = out.join(more, out["doc_id"].eqNullSafe(more["d"]) & (out["print"] == more["q"]), "left")
        both = [F.when(F.col(b).isNull(), F.col(a)).otherwise(F.concat(a, b)) for a, b in (("spans", "s"), ("items", "i"))]
        out = out.select("doc_id", "n_words", _merged_spans(both[0]).alias("spans"), both[1].alias("items"))
    return out.select("doc_id", "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def _merged_spans(spans: Column) -> Column:
    """Sorted ranges, those that meet as one."""

    def grown(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["begin"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<begin:bigint,end:bigint>>"), grown)


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.0, window: int = WINDOW) -> DataFrame:
    """``docs`` without the ids that have a text of which more than ``share`` of the words are inside windows; columns stay."""
    bad = contaminated(docs, items, window).where(_hit() > F.lit(share) * F.col("n_words")).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")


def _hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", _hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def _tokens(of: str) -> str:
    return f"regexp_extract_all(translate(coalesce({of}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_tokens("text")} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, {_tokens("text")} AS w FROM benchmark),
tests AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS k, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM tests) WHERE len(w) >= k),
found AS (SELECT p.r, p.i, p.k, t.item_id FROM (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM places) p JOIN tests t ON p.k = t.k AND p.s = t.s),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS place FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
