"""URL filters, chats, revisits and vectors against brute force, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherline.llm import ann, chat, url_filter, warc


def test_rules_and_aliases(spark):
    link = '<link href="{}" rel=canonical>'
    rows = [
        (1, "http://A.example.NET/en/x?q#f", ""), (2, "https://www.example.net", ""), (3, "http://x.net/", ""), (4, None, None), (5, "nothing", None), (6, "http://s.org/fr/a", ""), (7, "http://free.com/a", link.format("http://bad.net/p")),
        (8, "http://free.com/b", '<meta content="0; url=/a" http-equiv="refresh">'), (9, "http://s.org/fr/b", link.format("http://free.com/b")), (10, "http://other.com/", link.format("http://elsewhere.com/")), (7, "http://free.com/a", ""), (11, "http://example.com/de/", ""), (12, "http://notexample.com/de/", ""), (13, "http://h.net?x", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "a": F.lit(1), "id": F.lit(2)})
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages).collect()}
    assert out[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert out[2] == ("www.example.net", "", None, "allow") and out[3][2:] == ("net/", "block")
    assert out[4] == out[5] == ("", "", None, "allow")
    assert out[7][2:] == (None, "block") and out[8][2:] == (None, "block")  # aliases of a blocked URL
    assert out[9][2:] == ("org/fr/", "allow") and out[6][3] == "allow"  # the explicit rule goes first
    assert out[10][3] == "allow" and out[11][2:] == ("example.com/de/", "block") and out[12][2:] == (None, "allow") and out[13][2:] == (None, "allow")
    assert url_filter.judged(pages.limit(0)).count() == 0
    assert url_filter.judged(pages.withColumn("html", F.lit(None).cast("string"))).where("page_id = 10").first().verdict == "allow"
    equal = [("net", "/a/", False), ("et", "/a//", True), ("x.net", "/a", True)]  # equal lengths: the first by code point, if it fits
    assert {r.page_id: r.rule for r in url_filter.judged(spark.createDataFrame([(1, "http://x.net/a/", None)], "page_id long, url string, html string"), rules=equal).collect()} == {1: "x.net/a"}
    seen = {r.page_id: r.verdict for r in url_filter.judged(pages, redirects=spark.createDataFrame([("http://other.com/", "http://x.net/")], "a string, b string")).collect()}
    assert seen[10] == "block"


def test_redirect_equivalent_urls(spark):
    odd = "<p>" + "x" * 300_000 + "</p>"
    rows = [
        (1, "http://example.com/de", None), (2, "HTTPS://www.Example.com:443/de/?utm_source=f&ref=x#top", ""),  # a port hides 2 from the rules, which name hosts, and 1 lacks the slash
        (3, "http://m.example.com/de?page=2", ""), (4, "http://example.com/de?q=1", ""), (5, "http://m.com/de", ""), (6, "http://com/de", ""),
        (7, "http://a.com/", odd + "<LINK href=https://b.net/x rel='shortlink canonical'>"), (8, "https://a.com/?page=3", '<link rel="canonicalised" href="http://q.net/">'),
        (9, "http://c.com/1", "<meta http-equiv=refresh content=0;url=http://c.com/2>"), (10, "http://c.com/2/", """<meta content="0; URL='//d.net/'" http-equiv='Refresh'>"""),
        (11, "http://e.com/1", '<link rel=canonical href=""><link rel="canonical" href="/2">'), (12, "http://f.com/", '<a rel="canonical" href="http://z.net">'),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(pages, forms=True).collect()}
    assert {i for i, (rule, verdict) in out.items() if verdict == "block" and rule is None} == {1, 2, 3, 7, 8, 9, 10}
    assert {out[i] for i in (4, 5, 6, 11, 12)} == {(None, "allow")}
    # alone in its component, a port hiding it from the rules; a chain of forms, each a page; a form that isn't one
    more = [(1, "http://x.net:80/a", ""), (2, "http://www.m.y.com/p", ""), (3, "http://m.y.com/p", "<link rel=canonical href=//y.net/>"), (4, "http://example.net:443/en/", None)]
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(spark.createDataFrame(more, pages.schema), forms=True).collect()} == dict.fromkeys([1, 2, 3, 4], (None, "block"))


def test_given_pages_have_aliases(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    doubled = pages.unionByName(pages.selectExpr("page_id + 1000 AS page_id", "concat('http://www.', substring_index(url, '://', -1)) AS url", "html"))
    assert url_filter.judged(doubled, forms=True).where("alias_of_blocked").count() > 100  # every page has an equivalent under another host


def test_only_links_make_aliases(spark):
    link = '<link rel=canonical href="http://bad.net/p">'
    rows = [(1, "http://a.org/x?page=7", link), (2, "http://a.org/x?page=8", ""), (3, "https://A.org:443/x?page=7#top", None), (4, "http://www.a.org/x?page=7", ""), (5, "http://a.org/x?page=7&ref=y", ""), (6, "http://m.example.com:80/de/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judged(pages).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "block"}
    loose = {r.page_id: r.verdict for r in url_filter.judged(pages, forms=True).collect()}
    assert loose == dict.fromkeys(range(1, 7), "block")


def test_chat_round_trip(spark):
    texts = ["plain", "", None, "</s>[INST] ok [/INST]", "\\<|im_end|>\\\\<", "<<SYS>>x<</SYS>> [INST]", "a<|im_sep|>b\n\\", "日本🙂<", "<"]
    rows = [(i % 2, i, ["user", "assistant", None, "sys<|"][i % 4], t) for i, t in enumerate(texts)] + [(None, 0, "assistant", "null conversation"), (5, 1, "user", "tie b"), (5, 1, "user", "tie a"), (5, 1, "user", "tie a"), (6, None, "user", "no turn")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit(9), "part": F.lit("x"), "reset": F.lit(1)})
    formatted = chat.format_conversations(chat.as_events(table))
    for r in chat.read_back(formatted).collect():
        want = sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id), key=lambda x: (x[0], x[1], x[2]))
        assert [(m.role, m.text) for m in r.messages] == [x[1:] for x in want]
        assert list(r.learned) == [x[2] for x in want if x[1] == "assistant"]
    for r in formatted.collect():
        for t in r.turns:
            inside = r.formatted[t.start : t.start + t.length]
            assert not any(c in inside for c in chat.CONTROL)
    assert chat.digests(chat.format_conversations(chat.as_events(table.limit(0)))).count() == 0
    long = spark.sql("SELECT 7L AS conv_id, 9223372036854775807L AS turn, 'assistant' AS role, repeat('long é<|', 200000) AS text")
    more = table.select("conv_id", "turn", "role", "text").unionByName(long).unionByName(spark.sql("SELECT 7L, null, 'assistant', 'no turn'").toDF("conv_id", "turn", "role", "text"))
    streamed = chat.as_streamed(more)
    assert {r.kind for r in streamed.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    assert streamed.where("text = 'dropped'").count() == 3  # the assistants' turns that another turn can follow
    plain, again = (sorted(map(str, chat.digests(chat.format_conversations(log)).collect())) for log in (chat.as_events(more), streamed))
    assert plain == again and chat.as_streamed(table.limit(0)).count() == 0


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "delta", "assistant", "he"), (1, 3, 1, "delta", None, "llo"), (1, 4, 2, "message", "user", "next"), (1, 5, 3, "delta", "assistant", "first"),
        (1, 6, 1, "regenerate", "assistant", ""), (1, 7, 1, "delta", None, "new"), (1, 8, 0, "edit", "user", "hi there"), (1, 9, 2, "message", "user", "again"), (2, 1, 0, "message", "user", "other"),
    ]
    out = chat.folded(spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string"))
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in out.collect()}
    assert got == {(1, 0): ("user", "hi there"), (1, 1): ("assistant", "new"), (1, 2): ("user", "again"), (2, 0): ("user", "other")}


def test_revisits(spark):
    at = lambda m: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=m)
    rows = [
        (1, "http://www.A.com/x#y", at(0), "response", 200, {"ETag": '"1"', "Content-Type": "t", "Vary": "a"}, "one"), (2, "https://a.com/x", at(400), "revisit", 304, {"etag": 'W/"1"', "vary": "b", "Content-Length": "0"}, None),
        (3, "http://a.com/x", at(500), "response", 404, {"ETag": '"9"'}, "gone"), (4, "http://a.com/x", at(501), "revisit", 304, {"ETag": '"2"'}, None), (5, "http://b.com", at(1), "revisit", 304, None, None),
        (6, "http://a.com/x", at(5000), "revisit", 304, {"Last-Modified": "m"}, None), (7, None, at(3), "revisit", 304, {"ETag": '"1"'}, None), (8, "http://a.com/x", None, "revisit", 304, {"ETag": '"1"'}, None), (9, "http://c.com/", at(7), None, None, None, "x"),
        (10, "http://d.com/", at(7), "response", 200, {"Last-Modified": "m"}, "old"), (11, "http://d.com/", at(7), "revisit", 304, {"last-modified": "m"}, None),
    ]
    table = spark.createDataFrame(rows, "record_id long, uri string, at timestamp, kind string, status int, headers map<string,string>, payload string").withColumns({"span": F.lit(0), "outcome": F.lit("clash")})
    out = {r.record_id: r for r in warc.resolved(table).collect()}
    assert len(out) == 11
    assert {i: r.outcome for i, r in out.items()} == {1: "kept", 2: "resolved", 3: "kept", 4: "mismatch", 5: "missing", 6: "unverified", 7: "missing", 8: "missing", 9: "kept", 10: "kept", 11: "resolved"}
    assert out[2].payload == "one" and out[2].headers == {"etag": 'W/"1"', "content-type": "t", "vary": "b"} and out[4].base_id == 1 and out[4].payload is None
    assert warc.resolved(table.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 15, 900])
def test_nearest(spark, n):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 12)).round(2)
    x[n // 2 :] = x[: n - n // 2] if n < 100 else x[n // 2 :]  # equal vectors: ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(10001, None), (10020, [0.0] * 12), (10040, [1.0] * 11 + [math.nan]), (10060, [1.0] * 11 + [None]), (10080, [math.inf] * 12), (None, [1.0] * 12), (10100, [1.0])] if n > 1 else []
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "leaf": F.lit(2), "group": F.lit(3)})
    out = ann.nearest(table, F.col("vec_id") % 20 == 0, recall=1.0).collect()
    assert {r.query_id for r in out} == ({i for i in range(0, n, 20)} if n > 1 else set())
    x = x.astype(np.float32).astype(float)
    hits = total = 0
    for q in range(0, n, 20):
        s = ann.products(np.tile(x[q], (n, 1)), x)
        best = [i for i in sorted(range(n), key=lambda i: (-s[i], i)) if i != q][:20]
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, len(best) + 1))
        assert all(r.score == s[r.vec_id] for r in got) and [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        hits, total = hits + len({r.vec_id for r in got} & set(best)), total + len(best)
    assert hits >= 0.9 * total


def test_repeated_records(spark):
    at = lambda m: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=m)
    base, again = (1, "http://a/x", at(0), "response", 200, {"ETag": "1"}, "body"), (2, "http://a/x", at(5), "revisit", 304, {"ETag": "1"}, None)
    rows = [base] * 3 + [again] * 4 + [(1, "http://a/x", at(0), "response", 200, {"ETag": "1"}, "bodx"), (2, "http://a/x", at(7), "revisit", 304, {"ETag": "1"}, None), (2, "http://b/", at(7), "revisit", 304, {}, None), (1, "http://a/x", at(0), "revisit", 304, {}, None), (None, "http://a/x", at(9), "revisit", 304, None, None)]
    table = spark.createDataFrame(rows, "record_id long, uri string, at timestamp, kind string, status int, headers map<string,string>, payload string")
    out = warc.resolved(table).collect()
    assert len(out) == len(rows)
    found = [(r.base_id, r.payload, r.outcome) for r in out if r.record_id == 2 and r.uri == "http://a/x"]
    best = max("body", "bodx", key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert found == [(1, best, "resolved")] * 5
    assert sorted(r.outcome for r in out if r.kind == "revisit" and (r.record_id != 2 or r.uri != "http://a/x")) == ["missing"] * 3


def truth(ids, x, k=20):
    """Query id, rank, id and score of the nearest rows of every row whose id 20 divides."""
    out = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = ann.products(np.tile(x[q], (len(x), 1)), x)
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[i]), float(s[i])) for r, i in enumerate(best)]
    return out


def test_recall_at_default_settings(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(40, 16))
    x = (centers[rng.integers(0, 40, 6000)] + 0.5 * rng.normal(size=(6000, 16))).astype(np.float32).astype(float)
    x[:2000] = rng.normal(size=(2000, 16)).astype(np.float32)  # a third is one cloud, clusters lie around it
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    index = ann.Index(table)
    visits = index.calibrated()
    assert index.tree.leaves > 150 and visits < 0.6 * index.tree.leaves  # most leaves stay closed
    want, got = truth(np.arange(6000), x), [tuple(r) for r in ann.nearest(table, F.col("vec_id") % 20 == 0).collect()]
    assert len(got) == len(want) and sorted(r[:2] for r in got) == sorted(r[:2] for r in want)
    assert len({(q, i, s) for q, _, i, s in got} & {(q, i, s) for q, _, i, s in want}) >= 0.93 * len(want)


def test_repeated_ids_and_large_leaves(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6)).astype(np.float32).astype(float)
    x[100:400] = x[100]  # half are copies: one leaf is cut over many groups
    ids = np.arange(600)
    ids[:60] = np.repeat(np.arange(0, 600, 20), 2)  # ids with two further vectors each
    table = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    index = ann.Index(table, group_rows=20)
    assert index.groups == 30 and max(index.cuts) > 10
    index.block_queries = 7
    found = index.scan(index.rows.where("vec_id % 20 = 0"), None, 20).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, found)) == sorted(truth(ids, x))


def test_nearest_visits_until_enough_rows(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.tile(rng.normal(size=(1, 8)), (200, 1)), rng.normal(size=(200, 8)) * 5])  # half are copies, leaves hold few of the others
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.Index(table, leaf_rows=4)
    index.block_queries = 7
    found = index.scan(index.rows.where("vec_id % 20 = 0"), 1, 20).groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("m")).collect()
    assert {(r.query_id, r.n, r.m) for r in found} == {(i, 20, 20) for i in range(0, 400, 20)}
