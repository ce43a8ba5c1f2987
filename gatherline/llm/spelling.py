"""Spelling variants: words one letter apart, found by a trie of letter-group counts, and the usual form that each stands for."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherline.llm.shared import slices, text_of, written

#: Code points of a word, and how often it must occur.
LENGTH, OFTEN = 7, 2
#: A form is so many times as frequent as its variant.
TIMES = 10
#: A run of a document loses a letter if so much divides its checksum.
DAMAGE = 31

#: The letters with groups of their own, by their frequency in English; all others share groups by code point.
ALONE = b"etaoinshrdlu"
GROUPS = 16
_GROUP = np.array([ALONE.index(c) if c in ALONE else len(ALONE) + c % (GROUPS - len(ALONE)) for c in range(256)])
#: Words of a part of the trie that one task searches, nearly; fuller parts are split by the next group's count.
PART = 50_000
#: Words under a node of the trie that are compared at once.
LEAF = 16
#: Bytes of a word that are compared as a row of a matrix.
WIDE = 64
#: Comparisons made at once.
CELLS = 4_000_000

#: In Latin-1: ASCII letters lower-cased, the letters from C0 on kept, everything else a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _count(damage: int | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        held = 0

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in slices(batches):
            for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = b"%s:" % ("" if doc is None else str(doc)).encode()
                runs = Counter(w for w in text_of(cell).encode("latin-1", "replace").translate(_FOLD).split() if len(w) >= LENGTH)
                for w, n in runs.items():
                    if damage:
                        h = zlib.crc32(name + (w if w.isascii() else w.decode("latin-1").encode()))
                        if h % damage == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < LENGTH:
                                continue
                    counts[w] += n
                    held += len(w)
                if len(counts) > 200_000 or held > 20_000_000:
                    yield flushed()
                    held = 0
        yield flushed()

    return count


def word_counts(docs: DataFrame, damage: int | None = None, often: int = OFTEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the distinct runs of letters of whole texts with LENGTH code points or more and ``often`` occurrences.

    Letters are A-Z, lower-cased, a-z and U+00C0 to U+00FF. With ``damage``, a run of a document loses a letter where
    that divides the crc32 of ``doc_id:run``, before it is counted; a null id is the empty text there. A null text has no words.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count(damage), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def vectors(words: list[bytes]) -> np.ndarray:
    """How often each group's letters occur in each word; from 255 on as 255."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.repeat(np.arange(len(words)), sizes) * GROUPS + _GROUP[np.frombuffer(b"".join(words), np.uint8)]
    return np.minimum(np.bincount(at, minlength=len(words) * GROUPS), 255).astype(np.uint8).reshape(-1, GROUPS)


def _with_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = vectors([w.encode("latin-1") for w in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in v], pa.binary())], names=["word", "n", "vec"])


def _within(counts: np.ndarray, value: int, over: np.ndarray, under: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words may go down the branch ``value``: those that spend at most one surplus and one deficit so far."""
    d = counts.astype(np.int16) - int(value)
    over, under = over + np.maximum(d, 0), under + np.maximum(-d, 0)
    ok = (over <= 1) & (under <= 1)
    return ok, over[ok], under[ok]


def upper_trie(words: DataFrame) -> tuple[dict[bytes, list[int]], dict[bytes, int]]:
    """Branches of the trie's overfull nodes, and the lots of overfull leaves; all that the driver learns of the words.

    Nodes are split level by level until they hold PART words; a node and its branches are listed for each PART words
    and level at most.
    """
    kids: dict[bytes, list[int]] = {}
    total = words.count()
    full, lots = ([b""] if total > PART else []), {}
    for level in range(GROUPS):
        if not full:
            break
        at = words.sparkSession.createDataFrame([(bytearray(p),) for p in full], "_at binary")
        inside = words.join(F.broadcast(at), F.expr(f"substring(vec, 1, {level}) = _at"), "left_semi") if level else words
        rows = inside.groupBy(F.expr(f"substring(vec, 1, {level + 1})").alias("p")).count().collect()
        for r in rows:
            kids.setdefault(bytes(r.p[:level]), []).append(r.p[level])
        full = [bytes(r.p) for r in rows if r["count"] > PART]
        if level == GROUPS - 1:
            lots = {bytes(r.p): -(-r["count"] // PART) for r in rows if r["count"] > PART}
    return kids, lots


def _route(kids: dict[bytes, list[int]], lots: dict[bytes, int]):
    """Each word to its own part of the trie, and as a query to all others that its budget reaches; many words a row."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            ns = batch.column(1).to_numpy()
            v = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, GROUPS)
            out: list[tuple] = []

            def put(part: bytes, idx: np.ndarray, own: np.ndarray) -> None:
                for flag in (True, False):
                    some = idx[own == flag]
                    if len(some):
                        out.append((part, flag, b"\n".join([words[i] for i in some]), ns[some].astype("<i8").tobytes()))  # noqa: B023

            stack = [(b"", np.arange(len(words)), np.zeros(len(words), np.int16), np.zeros(len(words), np.int16))]
            while stack:
                node, idx, over, under = stack.pop()
                if node in kids:
                    for value in kids[node]:
                        ok, o, u = _within(v[idx, len(node)], value, over, under)
                        if len(o):
                            stack.append((node + bytes([value]), idx[ok], o, u))
                    continue
                own, many = (over == 0) & (under == 0), lots.get(node, 1)
                lot = np.array([zlib.crc32(words[i]) % many for i in idx]) if many > 1 else np.zeros(len(idx), int)
                for k in range(many):
                    put(node + b"/%d" % k, idx, own & (lot == k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["part", "own", "words", "ns"])

    return route


class _Rows:
    """Words as rows of bytes from their beginning and from their end, for comparing many pairs at once."""

    def __init__(self, words: list[bytes]):
        self.words, self.sizes = words, np.fromiter(map(len, words), np.int64, len(words))
        wide = int(min(self.sizes.max(initial=1), WIDE))
        self.left = np.frombuffer(b"".join(w[:wide].ljust(wide, b"\0") for w in words), np.uint8).reshape(-1, wide)
        self.right = np.frombuffer(b"".join(w[: -wide - 1 : -1].ljust(wide, b"\0") for w in words), np.uint8).reshape(-1, wide)
        # an edit of one letter spares the first four letters or the last three
        self.head = np.ascontiguousarray(self.left[:, :4]).view(np.uint32).ravel()
        self.tail = self.right[:, :3].astype(np.uint32) @ np.array([1, 256, 65536], np.uint32)

    def one_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Is one of each pair the other with exactly one letter put in, taken out or replaced?"""
        longer = np.maximum(self.sizes[a], self.sizes[b])
        ok = np.abs(self.sizes[a] - self.sizes[b]) <= 1
        same = []
        for rows in (self.left, self.right):
            differs = rows[a] != rows[b]
            same.append(np.where(differs.any(1), differs.argmax(1), rows.shape[1]))
        near = ok & (a != b) & (same[0] + same[1] >= longer - 1)
        for i in np.flatnonzero(ok & (a != b) & (longer > WIDE)):
            near[i] = _one_apart(self.words[a[i]], self.words[b[i]])
        return near


def _one_apart(a: bytes, b: bytes) -> bool:
    a, b = sorted((a, b), key=len)
    low, high = 0, len(a)
    while low < high:  # the common beginning, by halves
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return a != b and len(b) - len(a) <= 1 and a[low + (len(a) == len(b)) :] == b[low + 1 :]


def _search(key: tuple, table: pa.Table) -> pa.Table:
    """The words near each word that comes to a part of the trie: how many, and the most frequent of them."""
    own, other, counts = [], [], []
    for flag, words, ns in zip(table["own"].to_pylist(), table["words"].to_pylist(), table["ns"].to_pylist(), strict=True):
        (own if flag else other).extend(words.split(b"\n"))
        if flag:
            counts.append(np.frombuffer(ns, "<i8"))
    names = ["word", "near", "most", "form"]
    empty = pa.table([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=names)
    if not own:
        return empty
    v = vectors(own)
    order = np.lexsort(v.T[::-1])
    n, weight = len(own), np.concatenate(counts)[order]
    v = np.concatenate([v[order], vectors(other)]) if other else v[order]
    rows = _Rows([own[i] for i in order] + other)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(idx: np.ndarray, low: int, high: int) -> None:
        step = max(CELLS // (high - low), 1)
        for at in range(0, len(idx), step):
            some = idx[at : at + step]
            q, w = np.nonzero((rows.head[some][:, None] == rows.head[None, low:high]) | (rows.tail[some][:, None] == rows.tail[None, low:high]))
            for cut in range(0, len(q), CELLS // WIDE):
                a, b = some[q[cut : cut + CELLS // WIDE]], low + w[cut : cut + CELLS // WIDE]
                near = rows.one_apart(a, b)
                found.append((a[near], b[near]))

    stack = [(0, n, 0, np.arange(len(v)), np.zeros(len(v), np.int16), np.zeros(len(v), np.int16))]
    while stack:
        low, high, level, idx, over, under = stack.pop()
        if high - low <= LEAF or level == GROUPS:
            compare(idx, low, high)
            continue
        here = v[low:high, level]
        cuts = np.concatenate(([0], np.flatnonzero(here[1:] != here[:-1]) + 1, [high - low]))
        counts_here = v[idx, level]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            ok, o, u = _within(counts_here, here[a], over, under)
            if len(o):
                stack.append((low + a, low + b, level + 1, idx[ok], o, u))
    a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int))
    if not len(a):
        return empty
    # of each word's near ones the most frequent comes first, of equal ones the first by code point
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=lambda i: (-weight[i], rows.words[i]))] = np.arange(n)
    by = np.lexsort((rank[b], a))
    a, b = a[by], b[by]
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    near = np.diff(np.concatenate((first, [len(a)])))
    text = lambda i: rows.words[i].decode("latin-1")
    return pa.table([pa.array([text(i) for i in a[first]], pa.string()), pa.array(near, pa.int64()), pa.array(weight[b[first]], pa.int64()), pa.array([text(i) for i in b[first]], pa.string())], names=names)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, most, form`` of all ``words(word, n)`` that have a near one: their number, the count and name of the most frequent.

    Words are arranged in a trie by the counts of one group of letters after another. Words one letter apart have
    at most one letter of some group too many and one of some group too few, so a search goes down the branches
    that spend a surplus and a deficit of one each, and compares the words it finds letter by letter. The trie's upper
    levels deal words to tasks: each word to its own part, and to the other parts that its budget reaches.
    """
    words = written(words.mapInArrow(_with_vectors, "word string, n bigint, vec binary"), "spelling-words")
    kids, lots = upper_trie(words)
    routed = words.mapInArrow(_route(kids, lots), "part binary, own boolean, words binary, ns binary")
    found = routed.groupBy("part").applyInArrow(_search, "word string, near bigint, most bigint, form string")
    best = F.min(F.struct(F.negative("most").alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.negative("b.m").alias("most"), F.col("b.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: the form's form and so on to the last, by pointer jumping.

    Each form is TIMES as frequent as its word, so chains are short and have no rings: three or four rounds.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        step = written(now.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, damage: int | None = None, often: int = OFTEN, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``docs``, as ``word_counts`` counts them.

    ``n_near`` counts the words that differ by exactly one letter put in, taken out or replaced. ``form`` is the most
    frequent of them, the first by code point of equally frequent ones, if it is ``times`` as frequent as the word, else
    null; ``root`` the end of the chain of forms, the word itself if it has none. Texts and words of any length are
    read whole; rows that repeat count again; null texts have no words; other columns of any name are not read; an
    empty table gives no rows.
    """
    if times <= 1:
        raise ValueError("a form must be more frequent than its word")
    words = written(word_counts(docs, damage, often, id_col, text_col), "spelling-counts")
    out = words.join(near_words(words), "word", "left")
    usual = F.col("most") >= times * F.col("n")
    out = written(out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(usual, F.col("form")).alias("form"), F.when(usual, F.col("most")).alias("form_n")), "spelling-forms")
    ends = roots(out.where("form IS NOT NULL").select("word", "form"))
    return out.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


ORACLE = f"""
WITH RECURSIVE
crc AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {LENGTH} GROUP BY ALL),
bytes AS (
  SELECT run, doc_id, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END)) AS b FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8)), 4294967295) AS h FROM bytes, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % {DAMAGE} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(n) >= {OFTEN}),
less AS (SELECT word, i, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest),
best AS (SELECT near.word, count(*) AS n_near, min(struct_pack(m := -o.n, w := o.word)) AS b FROM near JOIN words o ON o.word = other GROUP BY near.word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= {TIMES} * w.n THEN b.w END AS form, CASE WHEN -b.m >= {TIMES} * w.n THEN -b.m END AS form_n FROM words w LEFT JOIN best ON best.word = w.word),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.at AS root FROM forms f JOIN chain c ON c.word = f.word JOIN forms g ON g.word = c.at WHERE g.form IS NULL
"""
