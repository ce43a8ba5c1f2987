"""Words one letter apart and their forms against all pairs, with small and large parts of the trie."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherline.llm import spelling


def counts(docs, damage):
    out = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(words):
    out, forms = {}, {}
    for w, n in words.items():
        close = sorted((-words[x], x) for x in words if near(w, x))
        if close and -close[0][0] >= 10 * n:
            forms[w] = close[0][1]
        out[w] = (n, len(close), forms.get(w), words.get(forms.get(w)))
    root = lambda w: root(forms[w]) if w in forms else w
    return {w: (*x, root(w)) for w, x in out.items()}


@pytest.mark.parametrize("part", [50_000, 12])
def test_against_all_pairs(spark, monkeypatch, part):
    for name, value in (("PART", part), ("LEAF", 2), ("CELLS", 500), ("WIDE", 12)):
        monkeypatch.setattr(spelling, name, value)
    rnd = random.Random(1)
    stems = ["".join(rnd.choice("abeé") for _ in range(7)) for _ in range(40)] + ["ABCDEFGH", "ÀÉîõüÿ÷x", "x" * 300, "y" * 12 + "z" * 12, "abcdefgh" * 3]
    stems += ["".join(rnd.sample("aabbcde", 7)) for _ in range(60)]  # words of equal counts, more than a part holds
    words = []
    for s in stems:
        for _ in range(4):
            i, kind = rnd.randrange(len(s)), rnd.randrange(3)
            words += [s[:i] + ["", "q", "q" + s[i]][kind] + s[i + 1 :]] * rnd.choice([2, 3])
        words += [s] * rnd.choice([2, 25, 30, 400])
    rnd.shuffle(words)
    docs = [(i, " ".join(words[i::20]) + " 日本 short 9abcdefg-abcdefgß") for i in range(20)] + [(3, "ABCDEFGH abcdefgh" + "\n" + stems[3]), (3, "ABCDEFGH abcdefgh" + "\n" + stems[3]), (None, stems[0] + "日" + stems[0]), (7, None), (8, "")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(0), "form": F.lit(1)})
    for damage in (None, 5):
        got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(table, damage).collect()}
        assert got == brute(counts(docs, damage))
        assert len({x[4] for x in got.values()}) < len(got) and any(x[2] for x in got.values())
    assert spelling.variants(table.limit(0)).count() == 0


def test_forms_lead_on(spark):
    docs = [(1, "chapterrr " * 2 + "chapterr " * 20 + "chapter " * 200 + "chaptir " * 21 + "chaptor " * 20 + "wchapter " * 2)]
    out = {r.word: (r.form, r.root, r.n_near) for r in spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out["chapterrr"] == ("chapterr", "chapter", 1) and out["chapterr"] == ("chapter", "chapter", 4 - 1 - 1)
    assert out["chapter"] == (None, "chapter", 4) and out["chaptir"] == (None, "chaptir", 2) and out["chaptor"] == ("chapter", "chapter", 2) and out["wchapter"][0] == "chapter"


def test_counts_of_groups():
    v = spelling.vectors([b"entente", b"\xe9\xe9q", b"e" * 400])
    assert v.sum(1).tolist() == [7, 3, 255] and v[0, 0] == 3 and v[2, 0] == 255 and v.dtype == np.uint8
