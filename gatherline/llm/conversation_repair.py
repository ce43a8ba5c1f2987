"""Conversation structure repair: the cheapest edits to well-formed turns, by a Viterbi search whose survivors coalesce."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherline.llm.shared import text_of

#: What the roles kept so far end with: nothing, a system turn, a user turn, an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The states behind no, one and two inserted turns; more inserts only go round at a cost.
_INSERTS = {EMPTY: (EMPTY, USER, ASSISTANT), SYSTEM: (SYSTEM, USER, ASSISTANT), USER: (USER, ASSISTANT), ASSISTANT: (ASSISTANT, USER)}
_KEEPS = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state behind the one turn that may be put or reroled there, and that turn's role.
_NEXT = {EMPTY: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
LEGAL = ("su", "ua", "au")
#: Whatever ends a conversation from the second state, the first can match at so much more (by inserts, or by deleting
#: a system turn): a way that costs more than that can't win any more.
_MATCHES = ((ASSISTANT, EMPTY, 3), (ASSISTANT, SYSTEM, 0), (ASSISTANT, USER, 2), (USER, EMPTY, 5), (USER, SYSTEM, 2), (USER, ASSISTANT, 2), (EMPTY, SYSTEM, 0), (EMPTY, USER, 2), (EMPTY, ASSISTANT, 0))

_SPACE = r"\x20\x09-\x0D"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy`` of the rows that a fixed damage leaves; nulls of role and text are one space.

    By crc32 of ``conv_id:turn`` (a null is one space there too) modulo 20: 0 drops a row, 1 empties its text, 2 takes
    out its ``.!?``, 3 repeats it, ``copy`` 1 behind 0, 4 makes it a user's.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), name("role").alias("role"), name("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``: ``blank``, else ``duplicate`` (role and text seen earlier), else ``truncated``, else null."""
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")) > 1
    ended = F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    return rows.withColumn("fault", F.when(blank, "blank").when(seen, "duplicate").when(~ended, "truncated"))


class _Node:
    """An edit of a row, and the inserts before it, in the tree of backpointers; ``kids`` are its references."""

    __slots__ = ("parent", "kids", "begin", "edits", "row")

    def __init__(self, parent, begin, edits, row):
        self.parent, self.kids, self.begin, self.edits, self.row = parent, set(), begin, edits, row
        if parent is not None:
            parent.kids.add(self)


class Survivors:
    """The cheapest way into each state after the rows so far; of equally cheap ones that with the least letters.

    ``emit(edit, role, row)`` gets every edit once it is certain. Letters of two ways that end in row edits are never
    one the other's beginning, so after each row the survivors have an order, their ``rank``: it compares all that is
    unresolved of two ways, and a row's new ways are compared by rank and what they add. Where all survivors share
    an ancestor, what lies before it is emitted and freed: memory holds the unresolved rows only. Ways that can't win are
    given up (``_MATCHES``).
    """

    def __init__(self, emit: Callable):
        self.emit, self.root, self.held = emit, _Node(None, EMPTY, "", None), 0
        self.alive = {EMPTY: (0, 0, self.root)}

    def add(self, row: tuple, initial: str, fault: str | None) -> None:
        free, more = fault in (None, "truncated"), int(fault == "truncated")
        best: dict[int, tuple] = {}
        for state, (cost, rank, node) in self.alive.items():
            for k, here in enumerate(_INSERTS[state]):
                cost_here, put = cost + k * COSTS["I"], "I" * k
                ways = [(here, COSTS["D"], "D")]
                if free:
                    ways.append((_NEXT[here][0], COSTS["R"] + more, "R"))
                    if (here, initial) in _KEEPS:
                        ways.append((_KEEPS[here, initial], COSTS["K"] + more, "K"))
                for to, extra, letter in ways:
                    way = (cost_here + extra, rank, put + letter, state, node)
                    if to not in best or way[:3] < best[to][:3]:
                        best[to] = way
        for other, to, more in _MATCHES:
            if other in best and to in best and best[to][0] > best[other][0] + more:
                del best[to]
        order = sorted(best, key=lambda to: best[to][1:3])
        least = min(way[0] for way in best.values())
        old = [node for _, _, node in self.alive.values()]
        self.alive = {to: (best[to][0] - least, rank, _Node(best[to][4], best[to][3], best[to][2], row)) for rank, to in enumerate(order)}
        self.held += len(self.alive)
        for node in old:
            self._release(node)
        self._coalesce()

    def _release(self, node: _Node) -> None:
        while not node.kids and node.parent is not None:
            node.parent.kids.discard(node)
            self.held -= 1
            node = node.parent

    def _coalesce(self) -> None:
        while len(self.root.kids) == 1:
            (self.root,) = self.root.kids
            self.root.parent = None
            self.held -= 1
            self._put(self.root)

    def _put(self, node: _Node) -> None:
        state = node.begin
        for letter in node.edits:
            if letter == "I":
                state, role = _NEXT[state]
                self.emit("I", role, None)
            else:
                self.emit(letter, _NEXT[state][1] if letter == "R" else None, node.row)

    def end(self) -> None:
        """Emits the rest of the cheapest way to a whole conversation."""
        ways = [(cost + k * COSTS["I"], rank, "I" * k, state, node) for state, (cost, rank, node) in self.alive.items() for k, here in enumerate(_INSERTS[state]) if here in (EMPTY, ASSISTANT)]
        _, _, put, state, node = min(ways, key=lambda way: way[:3])
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self._put(node)
        self._put(_Node(None, state, put, None))


_LOG = ("conv_id", "place", "edit", "turn", "role", "text", "fault", "illegal")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``conv_id, turn, role, text, fault`` as the log of their edits."""
    log: list[tuple] = []
    key, search, place, before, chars, schema = None, None, 0, "", 0, None

    def emit(edit, role, row):
        nonlocal place, chars
        turn, old, text, fault, illegal = row or (None, None, "", None, False)
        log.append((key[0], place, edit, turn, role or old, text, fault, illegal))
        place, chars = place + 1, chars + len(text)

    def flushed() -> pa.RecordBatch:
        nonlocal chars
        kinds = [schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*log, strict=True), kinds, strict=True)], names=list(_LOG))
        log.clear()
        chars = 0
        return out

    for batch in batches:
        schema = batch.schema
        ids, turns, names, labels = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
        for i in range(batch.num_rows):
            if key is None or key[0] != ids[i]:
                if search is not None:
                    search.end()
                key, search, place, before = (ids[i],), Survivors(emit), 0, None
            initial, fault = names[i][:1], labels[i]
            illegal = before is not None and before + initial not in LEGAL
            before = initial
            search.add((turns[i], names[i], text_of(batch.column(3)[i]), fault, illegal), initial, fault)
            if len(log) >= 1000 or chars > 4_000_000:
                yield flushed()
    if search is not None:
        search.end()
    if log:
        yield flushed()


def repairs(rows: DataFrame) -> DataFrame:
    """The edits that make each conversation well-formed: ``conv_id, place, edit, turn, role, text, fault, illegal``.

    ``rows(conv_id, turn, role, text)``, and ``copy`` if rows of one turn have an order; other columns of any name
    are not read. Rows follow by turn, nulls first, then copy, role and text; null conv_ids are one conversation, null roles
    and texts count as one space. Roles are told apart by their first letter; an empty role, as any letter but ``sua``, can't be kept.

    Well-formed: at most one system turn, then user and assistant in turn, from user to assistant; or no turn at all. Edits:
    ``K`` keeps a row (0), ``R`` makes it the user's or assistant's (2), ``D`` deletes it (3; blank rows and duplicates
    must go), ``I`` inserts an empty turn (2); a truncated row that stays costs 1 more. Of the cheapest ways the one
    with the least letters is taken. ``place`` numbers the edits; ``role`` is the new one; an inserted turn's ``turn`` is null;
    ``fault`` and ``illegal`` (its role can't follow the row before it) describe the row as it came. An empty table gives no rows.

    Rows of a conversation stream through one task in sorted order, texts of any length: the search is one
    chain, but keeps only what is unresolved. One exchange by conversation serves the duplicates and the search. The log
    comes out in order, conversations together.
    """
    copy = F.col("copy") if "copy" in rows.columns else F.lit(0)
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), some("role"), some("text"), copy.alias("copy")).repartition("conv_id")
    rows = faults(rows).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "copy", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "turn", "role", "text", "fault").mapInArrow(_repaired, f"conv_id {kind}, place bigint, edit string, turn bigint, role string, text string, fault string, illegal boolean")


def repaired(log: DataFrame) -> DataFrame:
    """The repaired conversations as rows ``conv_id, place, turn, role, text``; order them by ``place``."""
    return log.where("edit <> 'D'").select("conv_id", "place", "turn", "role", "text")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation of a log in order: its counts, the letters, and the digest of what stays."""
    done: list[tuple] = []
    now, schema = None, None

    def row() -> tuple:
        gaps = now["last"] - now["first"] + 1 - now["turns"] if now["turns"] else 0
        return (now["id"], gaps, *(now[c] for c in _COUNTS[1:]), "".join(now["audit"]), now["sha"].hexdigest())

    def flushed() -> pa.RecordBatch:
        kinds = [schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=["conv_id", *_COUNTS, "audit", "repaired_sha256"])

    for batch in batches:
        schema = batch.schema
        columns = [batch.column(i).to_pylist() for i in range(8)]
        for conv, _, edit, turn, role, text, fault, illegal in zip(*columns, strict=True):
            if now is None or now["id"] != conv:
                if now is not None:
                    done.append(row())
                now = {"id": conv, "turns": 0, "first": None, "last": None, "audit": [], "sha": hashlib.sha256(), "any": False, **dict.fromkeys(_COUNTS[1:], 0)}
            now["audit"].append(edit)
            now["cost"] += COSTS[edit] + (fault == "truncated" and edit != "D")
            now["illegal"] += illegal
            if fault:
                now[fault] += 1
            if turn is not None and turn != now["last"]:
                now["first"], now["last"], now["turns"] = turn if now["turns"] == 0 else now["first"], turn, now["turns"] + 1
            if edit != "D":
                now["sha"].update((("\n" if now["any"] else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                now["any"] = True
        if len(done) >= 1000:
            yield flushed()
            done.clear()
    if now is not None:
        done.append(row())
        yield flushed()


def digests(log: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for every conv_id of ``conversations``, from a log in the order that ``repairs`` gives it."""
    kind = log.schema["conv_id"].dataType.simpleString()
    found = log.mapInArrow(_summed, f"conv_id {kind}, {', '.join(c + ' bigint' for c in _COUNTS)}, audit string, repaired_sha256 string")
    every = conversations.select(F.col("conv_id").alias("_id")).distinct()
    out = every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    or_zero: Callable[[str], Column] = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.select(F.col("_id").alias("conv_id"), *map(or_zero, _COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The same search as a recursion over rows that keeps the least (cost, letters) of each state.
ORACLE = """
WITH RECURSIVE
crc AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
given AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (SELECT given.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) % 20 AS kind FROM given, crc),
broken AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM hashed, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy, role, text) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM broken),
rows AS (
  SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS bad,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault FROM numbered),
puts(s, put, cost, mid, lines) AS (
  VALUES ('0', '', 0, '0', []::VARCHAR[]), ('0', 'I', 2, 'u', ['user:']), ('0', 'II', 4, 'a', ['user:', 'assistant:']), ('s', '', 0, 's', []), ('s', 'I', 2, 'u', ['user:']), ('s', 'II', 4, 'a', ['user:', 'assistant:']),
         ('u', '', 0, 'u', []), ('u', 'I', 2, 'a', ['assistant:']), ('a', '', 0, 'a', []), ('a', 'I', 2, 'u', ['user:'])),
ways AS (
  SELECT conv_id, i, s, mid AS too, put || 'D' AS letters, cost + 3 AS cost, lines FROM rows, puts
  UNION ALL SELECT conv_id, i, s, CASE mid WHEN 'u' THEN 'a' ELSE 'u' END, put || 'R', cost + 2 + (fault IS NOT NULL)::INT, list_append(lines, CASE mid WHEN 'u' THEN 'assistant:' ELSE 'user:' END || text)
  FROM rows, puts WHERE coalesce(fault, 'truncated') = 'truncated'
  UNION ALL SELECT conv_id, i, s, r, put || 'K', cost + (fault IS NOT NULL)::INT, list_append(lines, role || ':' || text)
  FROM rows, puts WHERE coalesce(fault, 'truncated') = 'truncated' AND mid || r IN ('0s', '0u', 'su', 'au', 'ua')),
search AS (
  SELECT conv_id, 0::BIGINT AS i, '0' AS s, {'cost': 0, 'letters': '', 'lines': []::VARCHAR[]} AS best FROM rows GROUP BY conv_id
  UNION ALL
  SELECT x.conv_id, x.i + 1, w.too, min({'cost': x.best.cost + w.cost, 'letters': x.best.letters || w.letters, 'lines': x.best.lines || w.lines})
  FROM search x JOIN ways w ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = x.i + 1 AND w.s = x.s GROUP BY x.conv_id, x.i + 1, w.too),
counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM rows GROUP BY conv_id),
ends AS (
  SELECT x.conv_id, min({'cost': best.cost + p.cost, 'letters': best.letters || put, 'lines': best.lines || p.lines}) AS best
  FROM search x JOIN counts c ON x.conv_id IS NOT DISTINCT FROM c.conv_id AND x.i = c.n JOIN puts p ON p.s = x.s WHERE p.mid IN ('0', 'a') GROUP BY x.conv_id)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.letters, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counts c ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON g.conv_id IS NOT DISTINCT FROM e.conv_id
"""
