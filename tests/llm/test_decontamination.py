"""Windows of test items inside documents against brute force, in one pass and in several."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from gatherline.llm import decontamination as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        m = min(window, len(v))
        tests = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if v else set()
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in tests:
                hit |= set(range(i, i + m))
                found |= {str(item)} if item is not None else set()
    return len(w), hit, sorted(found)


@pytest.mark.parametrize("bound", [200_000, 40])
def test_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(dc, "PASS_WORDS", bound)
    monkeypatch.setattr(dc, "SEGMENT", 9)
    rnd = random.Random(5)
    vocabulary = ["a", "b", "Ab", "É9", "éa", "日本", "x1", "the"]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", "-", "."]) for _ in range(n))
    items = [(i, text(rnd.choice([3, 4, 5, 12, 30]))) for i in range(12)] + [(3, text(6)), (None, "null item É9 here"), (20, ""), (21, None), (22, "..."), (5, "Zz"), (6, "zz zy")]
    items += [items[0], (30, items[1][1])]  # a repeated item, and its text under another id
    docs = [(i, text(rnd.choice([0, 1, 2, 5, 40, 200]))) for i in range(40)] + [(1, "Zz zy Null Item é9 É9 here"), (None, "x null item É9 HERE"), (2, None), (3, "zz"), (3, "zz"), (4, "q " * 30_000 + items[2][1] + " q")]
    docs += [(50 + i, f"go {items[i][1]} on {items[i][1]}") for i in range(12)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"items": F.lit(1), "spans": F.lit("x"), "print": F.lit(0)})
    tests = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(2))
    out = dc.contaminated(table, tests, window=5).collect()
    got = sorted((str(r.doc_id), r.n_words, sorted(i for s in r.spans for i in range(s.begin, s.end)), r["items"]) for r in out)
    want = sorted((str(i), n, sorted(hit), found) for i, t in docs for n, hit, found in [brute(t, items, 5)])
    assert got == want and any(x[3] for x in got) and not all(x[3] for x in got)
    for r in out:
        assert all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert dc.contaminated(table.limit(0), tests).count() == 0
    clean = dc.contaminated(table, tests.limit(0))
    assert clean.where("size(spans) > 0 OR size(items) > 0").count() == 0 and clean.count() == len(docs)
    bad = {str(i) for i, t in docs if brute(t, items, 5)[1]}
    left = dc.drop_contaminated(table, tests, window=5)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in docs if str(i) not in bad) and left.columns == table.columns
    digest = dc.digests(dc.contaminated(table, tests, window=5)).where("doc_id = 3").collect()
    assert {(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in digest if r.n_words == 1} == {(1, 1, 1, True)}
