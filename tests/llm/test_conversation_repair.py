"""Cheapest repairs of conversations against all edit strings, and the memory that the search holds."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from gatherline.llm import conversation_repair as cr


def fault_of(rows, i):
    if not re.search(r"[^\x20\x09-\x0d]", rows[i][1]):
        return "blank"
    if rows[i] in rows[:i]:
        return "duplicate"
    return None if re.search(r"[.!?][\x20\x09-\x0d]*\Z", rows[i][1]) else "truncated"


def cheapest(rows):
    """All strings of edits with at most two inserts in a row: (cost, letters, lines) of the least."""
    best = [None]

    def go(i, cost, letters, roles, lines):
        if best[0] and (cost, letters) > best[0][:2] and cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best[0] = min(best[0] or (99, "", []), (cost, letters, lines))
        if not letters.endswith("II"):
            for role in ("user", "assistant"):
                go(i, cost + 2, letters + "I", roles + role[0], [*lines, role + ":"])
        if i < len(rows):
            role, text = rows[i]
            fault = fault_of(rows, i)
            go(i + 1, cost + 3, letters + "D", roles, lines)
            if fault in (None, "truncated"):
                more = fault == "truncated"
                for new in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, letters + "R", roles + new[0], [*lines, new + ":" + text])
                go(i + 1, cost + more, letters + "K", roles + (role[:1] or "?"), [*lines, role + ":" + text])

    go(0, 0, "", "", [])
    return best[0]


def test_against_all_edit_strings(spark):
    rnd = random.Random(3)
    rows = []
    for conv in range(70):
        for turn in sorted(rnd.sample(range(9), rnd.randrange(1, 5))):
            rows.append((conv, turn, rnd.choice(["user", "assistant", "assistant", "system", "tool", ""]), rnd.choice(["a.", "b! \n", "c", "", " \t", "日本?", "a."])))
    rows += [(None, 1, "user", "x."), (None, 2, "assistant", "y."), (None, 2, "assistant", "y."), (100, None, "user", "n."), (100, None, None, "o."), (100, 4, "user", None), (101, None, "assistant", "only.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit(0), "fault": F.lit("x"), "kind": F.lit(1), "edit": F.lit("K")})
    log = cr.repairs(table)
    got = {r.conv_id: r for r in cr.digests(log, table).collect()}
    stays = defaultdict(list)
    for r in cr.repaired(log).orderBy("place").collect():
        stays[r.conv_id].append(f"{r.role}:{r.text}")
    convs = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ")):
        convs[conv].append((turn, role if role is not None else " ", text if text is not None else " "))
    assert set(got) == set(convs)
    for conv, full in convs.items():
        given, r = [x[1:] for x in full], got[conv]
        cost, letters, lines = cheapest(given)
        assert (r.cost, r.audit, stays[conv]) == (cost, letters, lines), given
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        names = [fault_of(given, i) for i in range(len(given))]
        assert [r.blank, r.duplicate, r.truncated] == [names.count(x) for x in ("blank", "duplicate", "truncated")]
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(given, given[1:], strict=False))
        turns = [t for t, *_ in full if t is not None]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
    assert cr.digests(cr.repairs(table.limit(0)), table.limit(0)).count() == 0
    gone = cr.digests(cr.repairs(table.where("conv_id = 1")), table).where("conv_id = 2").first()
    assert gone[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage_is_the_same_in_sql(spark):
    rows = [(c, t if (c + t) % 17 else None, ["user", "assistant"][t % 2] if c % 9 else None, f"Text {c} of {t}, and more.") for c in range(60) for t in range(7)] + [(None, 3, "user", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", table.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(cr.ORACLE).fetchall()
    got = cr.digests(cr.repairs(cr.damaged(table)), table).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def feed(rows):
    out, most = [], 0
    search = cr.Survivors(lambda edit, role, row: out.append((edit, role, row)))
    for row in rows:
        search.add(row, row[0], row[1])
        most = max(most, search.held)
    search.end()
    return out, most


def test_memory_holds_the_unresolved_rows_only():
    sound = [("u" if i % 2 == 0 else "a", "blank" if i % 97 == 0 else None) for i in range(20_000)]
    out, most = feed(sound)
    assert most < 30 and len([x for x in out if x[0] != "I"]) == len(sound)
    open_ended = [("t", None)] * 3_000  # no role tells which parity is right: nothing is certain before the end
    out, most = feed(open_ended)
    assert [x[0] for x in out] == ["R"] * 3_000 and [x[1] for x in out[:2]] == ["user", "assistant"]
