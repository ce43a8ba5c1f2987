"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words; decoding joins binary pieces."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherline.llm.shared import literal_longs, slices, text_of

#: The widely published split pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of more bytes are merged by a heap instead, as folding costs the square of the length.
FOLD_BYTES = 48
#: A block ends when its texts pass this many characters; its distinct words are encoded once.
BLOCK_CHARS = 8_000_000
NO_RANK = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """``{token bytes: rank}`` of a tiktoken file; opened on the driver only."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """The rank map of pairs as two arrays, for literals: ``start`` by left token, and ``table``.

    A token is its rank plus 1. The pair (left, right) has its entry at ``table[start[left] + right]``:
    ``left * 2**17 + token`` of the joined bytes; other places hold 0. The rows of different lefts are laid over
    one another where no two entries meet; an entry's left part tells whose it is. Built from the rank map alone:
    each token and each way to cut it in two tokens.
    """
    if max(ranks.values()) + 1 >= 1 << 17:
        raise ValueError("ranks of 2**17 and more don't fit the table")
    rows: dict[int, list[tuple[int, int]]] = {}
    for t, r in ranks.items():
        for i in range(1, len(t)):
            if t[:i] in ranks and t[i:] in ranks:
                rows.setdefault(ranks[t[:i]] + 1, []).append((ranks[t[i:]] + 1, r + 1))
    width = max(ranks.values()) + 2
    room = 5 * sum(map(len, rows.values())) + 64
    table, start, rng = np.zeros(room + width, np.int64), [0] * width, np.random.default_rng(3)
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        rights = np.array([x for x, _ in row])
        tries = 0
        while table[(at := int(rng.integers(room))) + rights].any():
            if (tries := tries + 1) % 10_000 == 0:
                table, room = np.concatenate([table, np.zeros(room, np.int64)]), 2 * room
        start[left] = at
        table[at + rights] = [left << 17 | r for _, r in row]
    return start, table[: int(np.flatnonzero(table).max(initial=0)) + 1].tolist()


def folded(word: Column, byte_tokens: Column, start: Column, table: Column) -> Column:
    """Tokens (ARRAY<INT>) of a BINARY word: the lowest-ranked pair merges, leftmost first, until none is left.

    An entry XORed with its left token is a token if the pair is in the map and larger than any if not, so one
    minimum over ``value * 64 + place`` finds the next merge.
    """

    def value(a: Column, b: Column) -> Column:
        return F.get(table, F.get(start, a) + b).bitwiseXOR(F.shiftleft(a.cast("bigint"), 17))

    def step(tokens: Column, _: Column) -> Column:
        best = F.array_min(F.transform(tokens, lambda a, i: value(a, F.get(tokens, i + 1)) * 64 + i))
        place = lambda m: m.bitwiseAND(63).cast("int")
        merged = lambda m: F.when(m < 1 << 23, F.concat(F.slice(tokens, F.lit(1), place(m)), F.array(F.shiftright(m, 6).cast("int")), F.slice(tokens, place(m) + 3, F.lit(64)))).otherwise(tokens)
        return F.get(F.transform(F.array(best), merged), F.lit(0))

    text = F.decode(word, "ISO-8859-1")
    first = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.get(byte_tokens, F.ascii(F.substr(text, i, F.lit(1)))))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), first, step)


def heap_merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word, in time near its length: a heap of pairs over a linked list of parts."""
    parts: list[bytes] = [word[i : i + 1] for i in range(len(word))]
    left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
    heap = [(ranks[p], i, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = right[i]
        if not parts[i] or j < 0 or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, b""
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            if (p := pair + parts[k]) in ranks:
                heapq.heappush(heap, (ranks[p], i, p))
        if (h := left[i]) >= 0 and (p := parts[h] + pair) in ranks:
            heapq.heappush(heap, (ranks[p], h, p))
    return [ranks[p] for p in parts if p]


def _blocks(ranks: dict[bytes, int]):
    """Texts to blocks: places of each text's words in the block's list of distinct words, and the words.

    Words that are tokens, and words too long to fold, come with their ids; the rest is folded by Spark.
    """
    split = regex.compile(PATTERN).findall

    def closed(ids: list, places: list, words: dict[str, int]) -> pa.RecordBatch:
        known_at, known, fold_at, fold = [], [], [], []
        for word, place in words.items():
            raw = word.encode()
            if raw in ranks:
                known_at.append(place)
                known.append([ranks[raw]])
            elif len(raw) > FOLD_BYTES:
                known_at.append(place)
                known.append(heap_merged(raw, ranks))
            else:
                fold_at.append(place)
                fold.append(raw)
        ints = pa.list_(pa.int32())
        row = [pa.array([ids], pa.list_(ids[0].type)), pa.array([places], pa.list_(pa.binary())), pa.array([known_at], ints), pa.array([known], pa.list_(ints)), pa.array([fold_at], ints), pa.array([fold], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(row, names=["ids", "places", "known_at", "known", "fold_at", "fold"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places, words, chars = [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text_of(text)
                own = split(text)
                places.append(np.fromiter((words.setdefault(w, len(words)) for w in own), np.uint32, len(own)).tobytes())
                ids.append(doc_id)
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield closed(ids, places, words)
                    ids, places, words, chars = [], [], {}, 0
        if ids:
            yield closed(ids, places, words)

    return blocks


def spread(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` that ``at`` names, one after another."""
    n = lengths[at]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _assembled(tokens: list[bytes]):
    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_len = np.array([len(t) for t in tokens], np.int64)
        token_start, token_flat = np.cumsum(token_len) - token_len, np.frombuffer(b"".join(tokens), np.uint8)
        for batch in batches:
            for b in range(batch.num_rows):
                doc_ids, places, known_at, known, fold_at, fold = (batch.column(i)[b].values for i in range(6))
                at = np.concatenate([known_at.to_numpy(zero_copy_only=False), fold_at.to_numpy(zero_copy_only=False)]).astype(np.int64)
                flat = np.concatenate([known.flatten().to_numpy(zero_copy_only=False), fold.flatten().to_numpy(zero_copy_only=False) - 1]).astype(np.uint32)
                length = np.concatenate([np.diff(known.offsets.to_numpy()), np.diff(fold.offsets.to_numpy())]).astype(np.int64)
                starts, lengths = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                starts[at], lengths[at] = np.cumsum(length) - length, length
                counts, packed, decoded = [], [], []
                for place in places:
                    ids = spread(flat, starts, lengths, np.frombuffer(place.as_py(), np.uint32))
                    counts.append(len(ids))
                    packed.append(ids.astype("<u4").tobytes())
                    decoded.append(spread(token_flat, token_start, token_len, ids).tobytes())
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return assembled


class WordIds(dict):
    """Packed ids of words, remembered up to a bound: each distinct word is merged once."""

    def __init__(self, ranks: dict[bytes, int], most: int = 150_000):
        self.ranks, self.most = ranks, most

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = [self.ranks[raw]] if raw in self.ranks else list_merged(raw, self.ranks) if len(raw) <= FOLD_BYTES else heap_merged(raw, self.ranks)
        if len(self) >= self.most:
            self.clear()
        self[word] = packed = b"".join(i.to_bytes(4, "little") for i in ids)
        return packed


def list_merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a short word: the ranks of its pairs in a list."""
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pairs and (best := min(pairs)) < NO_RANK:
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
    return [ranks[p] for p in parts]


def _in_tasks(ranks: dict[bytes, int], tokens: list[bytes]):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, words = regex.compile(PATTERN).findall, WordIds(ranks)
        for batch in slices(batches):
            counts, packed, decoded = [], [], []
            for text in batch.column(1):
                ids = b"".join(map(words.__getitem__, split(text_of(text))))
                counts.append(len(ids) // 4)
                packed.append(ids)
                decoded.append(b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded


def encode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", fold: str = "tasks") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row; ``ids`` are packed as little-endian unsigned 32-bit integers.

    Each match of the split pattern is encoded by itself, without special tokens; ``decoded`` concatenates the
    binary pieces of the ids. Texts of any length are encoded whole; bytes that aren't UTF-8 count as replacement
    characters. Null texts count as empty and have no tokens. Repeated rows, null ids and any other
    columns are no special case; an empty table gives no rows. Nothing is shuffled.

    ``fold="spark"``: tasks cut their texts into blocks, and Spark's higher-order functions fold the merges over the
    byte arrays of each block's distinct words, with the rank map as a literal; words of over FOLD_BYTES bytes are
    merged by a heap. ``fold="tasks"``: the same merges on each task's distinct words in Python, several times faster.
    """
    if {bytes([i]) for i in range(256)} - set(ranks):
        raise ValueError("the rank map lacks single bytes")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    schema = f"doc_id {kind}, n_tokens bigint, ids binary, decoded binary"
    if fold == "tasks":
        return rows.mapInArrow(_in_tasks(ranks, tokens), schema)
    byte_tokens = literal_longs([ranks[bytes([i])] + 1 for i in range(256)]).cast("array<int>")
    start, table = merge_table(ranks)
    blocks = rows.mapInArrow(_blocks(ranks), f"ids array<{kind}>, places array<binary>, known_at array<int>, known array<array<int>>, fold_at array<int>, fold array<binary>")
    each = F.transform("fold", lambda w: folded(w, byte_tokens, literal_longs(start).cast("array<int>"), literal_longs(table)))
    return blocks.withColumn("fold", each).mapInArrow(_assembled(tokens), schema)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
