"""The corpus pipeline on a small corpus, each stage against brute force on what its predecessor kept."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from gatherline.llm import bpe
from gatherline.llm.queries import public_ranks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    nouns = ["house", "tree", "road", "ship", "bird", "town", "sea", "hill", "wood", "lake"]
    texts = [" ".join(f"{nouns[(i * j) % 10]}{(i * 7 + j) % 90}" for j in range(1, 60)) + f". number {i}" for i in range(90)]
    toxic = [t + f". you {['blorfing', 'blorfed'][i % 2]} thing {i}" if i % 3 == 0 else t for i, t in enumerate(texts)]
    rows = [(i, t, i % 3 == 0) for i, t in enumerate(toxic)]
    rows += [(100, texts[1], False), (101, texts[1], False), (102, texts[2].replace("number", "figure"), False), (103, "", False), (104, None, False)]
    return rows


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_stages(spark, tmp_path):
    import tiktoken

    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", 0) for i, t, _ in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(x)) for i, _, x in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    _, safe, once, apart, mixed, ids = seen
    assert {r.doc_id for r in safe} == {i for i, _, x in rows if not x}
    largest = {r.text or "": max(s.doc_id for s in safe if (s.text or "") == (r.text or "")) for r in safe}
    assert sorted(r.doc_id for r in once) == sorted(largest.values())
    low = {r.doc_id: r.doc_id for r in once}
    sets = {r.doc_id: shingles(r.text) for r in once}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    assert sorted(r.doc_id for r in apart) == sorted(i for i in low if low[i] == i) and len(apart) < len(once)
    words = lambda r: len((r.text or "").split())
    held, drawn, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in apart:
        held[r.source] += words(r)
        most[r.source] = max(most[r.source], words(r))
    for r in mixed:
        drawn[r.source] += words(r)
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(held, key=lambda s: (s is None, s or "")))}
    targets, full = {}, set()
    while True:  # reshare what full sources can't take
        left, shares = sum(held.values()) - sum(3 * held[s] for s in full), sum(w for s, w in weights.items() if s not in full)
        targets = {s: 3 * held[s] if s in full else left * weights[s] / shares for s in held}
        more = {s for s in held if s not in full and targets[s] >= 3 * held[s]}
        if not more:
            break
        full |= more
    assert all(abs(drawn[s] - targets[s]) <= most[s] for s in held)
    assert all(n <= 3 for n in Counter(r.doc_id for r in mixed).values())
    reference = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=public_ranks(), special_tokens={})
    want = Counter()
    for r in mixed:
        t = reference.encode_ordinary(r.text or "")
        want[r.doc_id, len(t), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in t)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, ids)) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want


def test_repeated_rows_and_ids(spark, tmp_path):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(30))
    rows = [(1, text(1)), (1, text(1)), (1, text(2)), (2, text(2) + " more"), (3, text(3)), (3, text(4)), (4, text(3) + " more"), (5, None), (5, ""), (None, text(6)), (None, text(6)), (7, text(7) + " more"), (7, text(7))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    once = corpus_pipeline.exact(spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text or "") for r in once) == Counter({(i, t or "") for i, t in rows})
    apart = corpus_pipeline.near(spark, docs, str(tmp_path)).collect()
    got = Counter((r.doc_id, r.text or "") for r in apart if r.doc_id not in (None, 7))
    assert got == Counter([(1, text(1)), (1, text(2)), (3, text(3)), (3, text(4)), (5, "")])
    assert sum(r.doc_id is None for r in apart) == 1 and sum(r.doc_id == 7 for r in apart) == 1


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    extra = {c: F.lit(7) for c in ("score", "key", "taken", "size", "draw", "c0", "_row", "kept", "print", "shard", "tokens", "target")}
    docs = spark.createDataFrame([(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", 0) for i, t, _ in corpus()], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(x)) for i, _, x in corpus()], "doc_id long, quality int, toxic int")
    plain, wide, empty, bare = (f"{tmp_path}/{n}" for n in ("plain", "wide", "empty", "bare"))
    for at, some, marks in ((plain, docs, labels), (wide, docs.withColumns(extra), labels.withColumn("text", F.lit("x"))), (empty, docs.limit(0), labels.limit(0)), (bare, docs, labels.limit(0))):
        some.write.parquet(f"{at}/documents.parquet")
        marks.write.parquet(f"{at}/labels.parquet")
    out = Counter(map(tuple, corpus_pipeline.run(spark, plain).collect()))
    assert out == Counter(map(tuple, corpus_pipeline.run(spark, wide).collect()))
    none = corpus_pipeline.run(spark, empty)
    assert none.count() == 0 and none.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert corpus_pipeline.toxic(spark, docs, bare).count() == docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs.withColumns(extra), wide)
        assert made.columns == [*docs.columns, *extra] and made.where("target <> 7").count() == 0, name
        assert stage(spark, docs.limit(0), empty).count() == 0
