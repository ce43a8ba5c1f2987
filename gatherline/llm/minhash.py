"""Near-duplicate groups by one-permutation hashing with optimal densification, banded buckets and star edges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherline.llm.exact_dedup import one_of_each
from gatherline.llm.shared import held_back, hot_join, min_labels, slices, text_of, written

WORDS, PERCENT = 5, 75
#: A link of similarity 0.75 shares no band with probability (1 - 0.75**4)**40 = 2.5e-7 if the sets are large.
BANDS, ROWS = 40, 4
BINS = BANDS * ROWS
#: Few values fill all bins of a small set, and two in one bin cost much of it: so many shingles have a second permutation.
SMALL_SET = 64

_U, _NONE = np.uint64, np.empty(0, np.uint64)
_STEP, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
#: For each bin the order in which it tries the others when it is empty, by itself of all other bins.
_PROBES = np.array([np.random.default_rng([17, i]).permutation(BINS) for i in range(BINS)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


#: A byte's number in the hash of its word (ASCII letters as lower-case ones), and the bytes that words are split at.
_BYTE = _mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + _STEP)
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: Bytes of a text that are hashed at a time, to the end of a word; longer words than LONG are hashed one by one.
PIECE, LONG = 1 << 17, 32
_BREAK = re.compile(rb"[ \t\n\v\f\r]")


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64."""
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64))))


#: A word's hash is a polynomial of its bytes, its first one at the power 0: sums up to its ends, less what is before, times the inverse power.
_POWERS, _INVERSE = (_powers(x, 2 * PIECE) for x in (int(_STEP), pow(int(_STEP), -1, 1 << 64)))


def _piece_hashes(piece: np.ndarray) -> np.ndarray:
    gap = np.concatenate(([True], _SPACE[piece], [True]))
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    begin, end = turns[::2], turns[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[piece] * _POWERS[: len(piece)])))
    out = _mixed((total[end] - total[begin]) * _INVERSE[begin])
    for i in np.flatnonzero(end - begin > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(piece[begin[i] : end[i]].tobytes().lower())
    return out


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of ``data`` in order; ASCII letters count as lower-case ones, words split at ASCII space.

    Words of up to LONG bytes are hashed by whole pieces of the text, others by themselves, so a text's arrays stay small.
    """
    parts, at = [], 0
    while at < len(data):
        cut = _BREAK.search(data, min(at + PIECE, len(data)))
        to = cut.start() if cut else len(data)
        if to - at < 2 * PIECE:
            parts.append(_piece_hashes(np.frombuffer(data, np.uint8, to - at, at)))
        else:  # a word that is longer than a piece
            words = data[at:to].split()
            parts += [_piece_hashes(np.frombuffer(b" ".join(words[:-1]), np.uint8)), np.array([xxhash.xxh3_64_intdigest(words[-1].lower())], np.uint64)]
        at = to
    return parts[0] if len(parts) == 1 else np.concatenate([_NONE, *parts])


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; ASCII letters lower-cased, words split at ASCII space.

    With fewer words than a shingle has, the whole sequence is one shingle; without words the set is empty.
    """
    h = word_hashes(text.encode("utf-8", "surrogatepass")) if text else _NONE
    if not len(h):
        return _NONE
    k = min(words, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = s * _STEP + h[i : len(h) - k + 1 + i]
    return distinct(_mixed(s))


def bins_of_all(sets: list[np.ndarray]) -> np.ndarray:
    """For each set one permutation's smallest hash in each bin; an empty bin takes that of the first full bin it probes."""
    flat = np.concatenate(sets)
    at = np.repeat(np.arange(len(sets)) * BINS, [len(s) for s in sets]) + (((flat >> _U(32)) * _U(BINS)) >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    full, out = np.zeros(len(sets) * BINS, bool), np.zeros(len(sets) * BINS, np.uint64)
    full[at[first]] = True
    out[at[first]] = flat[first]
    empty, probe = np.flatnonzero(~full), 0
    while len(empty):
        tried = empty - empty % BINS + _PROBES[empty % BINS, probe]
        found = full[tried]
        out[empty[found]] = out[tried[found]]
        empty, probe = empty[~found], probe + 1
    return out.reshape(-1, BINS)


def bins_of(shingles: np.ndarray) -> np.ndarray:
    return bins_of_all([shingles])[0]


def band_keys(values: np.ndarray) -> np.ndarray:
    """Of the bins of one set, or of several in rows."""
    rows = values.reshape(*values.shape[:-1], BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = _mixed(key * _STEP + rows[..., r])
    return key.view(np.int64)


def keys_of_all(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The band keys of sets of sorted hashes: none if empty, those of two permutations if small."""
    out = [np.empty(0, np.int64)] * len(sets)
    some = [i for i, s in enumerate(sets) if len(s)]
    small = [i for i in some if len(sets[i]) <= SMALL_SET]
    if some:
        for i, keys in zip(some, band_keys(bins_of_all([sets[i] for i in some])), strict=True):
            out[i] = keys
    if small:
        for i, keys in zip(small, band_keys(bins_of_all([np.sort(_mixed(sets[i] + _STEP)) for i in small])), strict=True):
            out[i] = np.concatenate([out[i], keys])
    return out


def all_keys(shingles: np.ndarray) -> np.ndarray:
    return keys_of_all([shingles])[0]


#: Shingles of a slice whose bands are made at once, about.
SHINGLES = 1 << 17


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sizes, prints, bands, sets, held = [], [], [], [], 0
        for text in batch.column(1):
            sets.append(s := shingle_set(text_of(text)))
            sizes.append(len(s))
            prints.append(xxhash.xxh3_128_digest(s.tobytes()))
            held += len(s)
            if held > SHINGLES:
                bands, sets, held = bands + keys_of_all(sets), [], 0
        bands += keys_of_all(sets)
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "print", "bands"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, print, bands`` of every row: set size, the set's digest, band keys."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_signed, f"doc_id {kind}, n_shingles bigint, print binary, bands array<bigint>")


#: Bits of the map of a text's shingles that its center lacks.
REST_BITS = 2048


def _compare(percent: int):
    """Rows in order of ``a``: first its own text (no ``b``), then those of its partners."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = None, _NONE
        for batch in slices(batches):
            keep, linked, shared, extra, maps = [], [], [], [], []
            for i, (one, other, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
                own = shingle_set(text_of(text))
                if other is None:
                    at, left = one, own
                elif one == at and len(own) and len(left):
                    hit = left[np.minimum(np.searchsorted(left, own), len(left) - 1)] == own
                    both, bits = int(hit.sum()), np.zeros(REST_BITS, np.uint8)
                    bits[((own[~hit] * _MIX1) >> _U(53)).astype(np.int64)] = 1
                    keep.append(i)
                    linked.append(100 * both >= percent * (len(left) + len(own) - both))
                    shared.append(both)
                    extra.append(len(own) - both - int(bits.sum()))
                    maps.append(np.packbits(bits).view(np.int64))
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(linked, pa.bool_()), pa.array(shared, pa.int32()), pa.array(extra, pa.int32()), pa.array(maps, pa.list_(pa.int64()))], names=["a", "b", "linked", "shared", "extra", "rest"])

    return compared


#: A text with more partners than this is compared in several tasks.
PARTNERS = 100
#: So many members of a bucket, outside its largest component, meet each of the others; of more, those with a shingle in common.
OUTSIDERS = 512
#: So many members outside a bucket's largest component meet it in one task.
LOT = 64


def compared(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ``pairs(a, b)`` compared on their full shingle sets: ``linked`` if similar enough; written to the shared folder.

    Besides, ``shared`` shingles, a bit map ``rest`` of those of ``b`` that ``a`` lacks, and how many of these are
    ``extra``, beyond one for each bit set.

    Only texts that some pair names are moved: once for each pair as ``b``, and once for each PARTNERS partners as
    ``a``. A sketch of their ids holds back nearly all others where they are read. ``docs``: ``(doc_id, text)``.
    """
    kinds = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("a", "b")]
    return written(_beside_centers(docs, pairs).mapInArrow(_compare(percent), ", ".join([*kinds, "linked boolean, shared int, extra int, rest array<bigint>"])), "minhash-compared")


def _near_size(n: Column, m: Column, percent: int) -> Column:
    """Sets whose sizes differ more can't be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _may_link(percent: int) -> Column:
    """May ``x`` and ``y``, compared with one center, be similar enough? By their sizes and by what can be in both."""
    enough = lambda most: most * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    # at most so many shingles are in both: those that both share with their center, and those outside it
    inside, beyond = F.least("x.shared", "y.shared"), F.least(F.col("x.n") - F.col("x.shared"), F.col("y.n") - F.col("y.shared"))
    # written out word by word, the count of common bits is too long a method to be compiled
    common = F.aggregate(F.zip_with("x.rest", "y.rest", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda s, n: s + n)
    return _near_size(F.col("x.n"), F.col("y.n"), percent) & enough(inside + beyond) & enough(inside + common + F.least("x.extra", "y.extra"))


def _tokens(percent: int):
    """Rows in order of ``a``, as ``_compare`` reads them: for each ``b`` the shingles by which it must meet its likes."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = None, _NONE
        for batch in slices(batches):
            keep, far, beyond, inner = [], [], [], []
            for i, (one, other, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
                own = shingle_set(text_of(text))
                if other is None:
                    at, left = one, own
                elif one == at and len(own) and len(left):
                    hit = left[np.minimum(np.searchsorted(left, own), len(left) - 1)] == own
                    rest, shared, least = own[~hit], own[hit], -(-percent * len(own) // 100)
                    need = least - len(shared)  # so many shingles beyond the center's are in every like
                    keep.append(i)
                    far.append(rest[: len(rest) - need + 1].view(np.int64) if need > 0 else [])
                    beyond.append([] if need > 0 else rest.view(np.int64))
                    inner.append([] if need > 0 else shared[: len(shared) - max(least - len(rest), 1) + 1].view(np.int64))
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(c, pa.list_(pa.int64())) for c in (far, beyond, inner))], names=["a", "b", "far", "beyond", "inner"])

    return tokens


def _beside_centers(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, text`` sorted by ``a``: its own text with a null ``b``, then those of its partners, in lots of PARTNERS."""
    texts = held_back(docs, F.col("doc_id"), pairs.select(F.explode(F.array("a", "b")).alias("id")), F.col("id"))
    lots = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("lots"))
    dealt = pairs.join(lots, "a").select("a", "b", F.pmod(F.xxhash64("b"), "lots").cast("int").alias("lot"))
    right = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "lot", "b", "text")
    left = lots.join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "text")
    return right.unionByName(left).repartition("a", "lot").sortWithinPartitions("a", "lot", F.col("b").asc_nulls_first()).select("a", "b", "text")


def met_by_tokens(docs: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b``: pairs of one center's ``members(center, rep, n, component, out, shared, extra, rest)`` that may link, one of
    them at least ``out``.

    Of similar sets each has ``percent`` of itself in both. If a member has less than that in common with its center,
    it has ``need`` shingles or more beyond the center in common with its like, so one of its first ``size - need + 1`` in
    an order that all share (prefix filter). Two members that lie in the center for the most part have likewise
    some of the center's in common; such are compared here if both are ``out``. Only members with such a shingle in
    common meet, so unlike texts that only share what the center has never do; of these, those that the bound of
    ``_may_link`` lets pass. ``percent`` is over 50.
    """
    pairs = members.select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    kinds = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("a", "b")]
    found = _beside_centers(docs, pairs).mapInArrow(_tokens(percent), ", ".join([*kinds, "far array<bigint>, beyond array<bigint>, inner array<bigint>"]))
    own = members.groupBy("center", "rep", "n", "component").agg(F.bool_or("out").alias("out"), *[F.first(c).alias(c) for c in ("shared", "extra", "rest")])
    found = written(found.withColumnsRenamed({"a": "center", "b": "rep"}).join(own, ["center", "rep"]), "minhash-tokens")
    token = lambda name: found.where(F.size(name) > 0).select("center", "rep", "n", "component", "out", "shared", "extra", "rest", F.explode(name).alias("token"))
    once = F.col("x.rep") < F.col("y.rep")
    sides = [
        (token("far").where("out"), token("far"), once | ~F.col("y.out")), (token("far").where("out"), token("beyond"), F.lit(True)),
        (token("beyond").where("out"), token("far").where("NOT out"), F.lit(True)), (token("inner").where("out"), token("inner").where("out"), once),
    ]
    out = None
    for x, y, apart in sides:
        x, y = x.alias("x"), y.alias("y")
        met = x.join(y, (F.col("x.center") == F.col("y.center")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & apart & _may_link(percent))
        met = met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
        out = met if out is None else out.unionByName(met)
    return out.distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept``.

    Documents link when 100 * intersection >= percent * union of their full sets of 5-word shingles, texts of any
    length being read whole (bytes that aren't UTF-8 count as replacement characters); a component's id is its smallest doc_id, and that document is kept. Empty and null texts link with nothing. Rows with a null
    id are returned with a null component and kept. Rows that repeat a doc_id are linked by each of their texts.
    Other columns are not read; an empty table gives no rows.

    1. Equal sets collapse to one representative. 2. Representatives meet in band buckets; each bucket gives star
    edges from the member that shares most buckets, so candidates never outnumber bucket rows. 3. Edges are confirmed on full sets
    and components formed. 4. Where a bucket of three or more still spans components, up to OUTSIDERS members outside its
    largest component meet the others of the bucket: sizes and what both share with the bucket's center bound
    the pair's similarity exactly. Where there are more, only those meet that share a shingle which any like of
    theirs must have (``met_by_tokens``), and those that lie in the center for the most part meet the component. Pairs that may link are confirmed too: none that shares a bucket is left out.
    Sets of SMALL_SET shingles or fewer meet in the buckets of two permutations.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(docs), "minhash-signed")
    able = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = written(able.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").cast("int").alias("n"), F.first("bands").alias("bands")), "minhash-reps")
    rows = reps.select(F.explode("bands").alias("key"), "rep", "n")
    shared = written(rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "minhash-shared")
    every = shared.agg(F.sum("members")).first()[0] or 0
    rows = written(hot_join(rows, shared, ["key"], "members", every), "minhash-rows")
    # the original of a group meets more documents than its variants do, so it makes the best center
    met = rows.groupBy("rep").agg(F.sum("members").alias("met"))
    rows = written(rows.join(met, "rep"), "minhash-rows")
    stars = rows.groupBy("key", "members").agg(F.min(F.struct(F.negative("met").alias("m"), "rep", "n")).alias("c")).select("key", F.col("members").alias("weight"), F.col("c.rep").alias("center"))
    members = written(hot_join(rows.drop("met"), stars, ["key"], "weight", every).drop("weight"), "minhash-members")
    first = written(members.where(F.col("rep") != F.col("center")).select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), "minhash-pairs")
    known = compared(docs, first, percent)
    links = known.where("linked").select("a", "b")
    labels = min_labels(links)

    held = members.where("members > 2").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    held = written(held, "minhash-held")
    counts = held.groupBy("key", "component").agg(F.count("*").alias("c"))
    main = counts.groupBy("key").agg(F.max(F.struct("c", F.col("component").alias("main"))).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("key", "m.main")
    measured = known.select(F.col("a").alias("center"), F.col("b").alias("rep"), "shared", "extra", "rest")
    open_rows = held.where("rep <> center").join(main, "key").join(measured, ["center", "rep"])
    open_rows = written(open_rows.select("key", "center", "rep", "n", "component", "main", "shared", "extra", "rest"), "minhash-open")
    most_out = OUTSIDERS if percent > 50 else 1 << 62
    outsiders = open_rows.where("component <> main").groupBy("key").agg(F.count("*").alias("outsiders")).withColumn("lots", F.ceil(F.col("outsiders") / LOT).cast("int"))
    open_rows = open_rows.join(written(outsiders, "minhash-lots"), "key").withColumn("crowded", F.col("outsiders") > most_out).withColumn("out", F.col("component") != F.col("main"))
    # of crowded buckets only those that lie in the center for the most part meet the main component here
    inner = ~F.col("crowded") | (F.col("shared") * 100 >= F.col("n") * percent)
    x = open_rows.where(F.col("out") & inner).withColumn("lot", F.pmod(F.xxhash64("rep"), "lots").cast("int")).alias("x")
    y = open_rows.where(inner & ~(F.col("crowded") & F.col("out"))).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).alias("y")
    other = (F.col("x.component") != F.col("y.component")) & (~F.col("y.out") | (F.col("x.rep") < F.col("y.rep")))
    second = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.lot") == F.col("y.lot")) & other & _may_link(percent)).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    crowded = written(open_rows.where("crowded").select("center", "rep", "n", "component", "out", "shared", "extra", "rest"), "minhash-crowded")
    if not crowded.isEmpty():
        second = second.unionByName(met_by_tokens(docs, crowded, percent)).distinct()
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = written(second.join(tested, ["a", "b"], "left_anti"), "minhash-pairs")
    if not second.isEmpty():
        more = compared(docs, second, percent).where("linked").select("a", "b")
        if not more.isEmpty():
            labels = min_labels(links.unionByName(more))

    found = reps.select("print", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "print").join(found, "print", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each near-duplicate group; columns and texts as they were.

    A document is a doc_id and its text: where ids repeat, each of their texts stays or goes by itself, the smallest
    id's (of its texts the least digest) staying, and rows that repeat both stay once. Extra columns of any name stay.
    """
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        docs = one_of_each(docs)
        key = F.when(docs["doc_id"].isNotNull(), F.struct(docs["doc_id"].alias("id"), F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256)).alias("sha")))
    else:
        key = docs["doc_id"]
    kept = near_groups(docs.select(key.alias("doc_id"), docs["text"].alias("text")), percent=percent).where("kept").select("doc_id").distinct()
    return docs.join(kept, key.eqNullSafe(kept["doc_id"]), "left_semi")


ORACLE = """
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM tokens WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_n >= 75 * (x.n + y.n - both_n)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""
