"""Operators over documents against brute force, and with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherline.llm import bpe, exact_dedup, minhash, mixing, shared, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "one two"), (5, "One two"), (6, words(100)), (7, words(100) + " more"), (8, words(100)), (9, words(95) + " x"), (10, "x" * 5000), (11, words(30000)), (12, words(40, 500)), (None, "no id"), (12, words(40, 500))]
    return spark.createDataFrame([(i, t, "en", None if i == 4 else f"s{(i or 0) % 3}", None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    extra = {c: F.lit("x") for c in ("key", "sha", "size", "score", "offending", "draw", "shard", "slot", "print", "component_id", "copies", "bands", "n", "rep", "link", "place", "c0", "kept")}
    return docs.withColumns(extra)


def test_exact_groups(docs, empty):
    for bits, rows in ((64, 50_000), (64, 1), (2, 3), (1, 1)):  # one or two bits: nearly all keys collide and chain
        out = exact_dedup.exact_groups(clashing(docs), bucket_keys=rows, key_bits=bits).collect()
        groups = defaultdict(list)
        for r in docs.collect():
            groups[r.text or ""].append(r.doc_id)
        want = Counter((i, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_copies(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 12]


def test_directory_doubles_and_splits(spark):
    keys = lambda *k: spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in k], "key long")
    assert exact_dedup.grown(keys(), 10) == [(0, 0)]
    top = [i << 60 for i in (0, 0b0001, 0b0010, 0b1000)]
    assert exact_dedup.grown(keys(*top), 2) == [(0b000, 3), (0b001, 3), (0b01, 2), (0b1, 1)]
    near = exact_dedup.grown(keys(5 << 60, (5 << 60) + 1, 1 << 63), 1)  # two keys that differ in the last bit alone: split at full depth
    assert max(local for _, local in near) == 64 and sum(2.0**-local for _, local in near) == 1


def test_directory_of_many_overfull_buckets(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PASS_COUNTS", 64)
    keys = spark.range(40_000).select(F.xxhash64("id").alias("key"))
    leaves = exact_dedup.grown(keys, 5)  # about twelve thousand buckets, from passes of two counts for each overfull one
    assert sum(2.0**-local for _, local in leaves) == 1.0 and len(leaves) > 8_000
    shifted = sorted((p << (64 - local), local) for p, local in leaves)
    firsts = np.array([p for p, _ in shifted], dtype=np.uint64)
    held = np.bincount(np.searchsorted(firsts, np.array([r.key for r in keys.collect()]).astype(np.uint64), side="right") - 1, minlength=len(leaves))
    assert held.max() <= 5


def test_index_answers_through_its_directory_and_owners(spark, docs):
    more = spark.range(5000).selectExpr("id + 100 AS doc_id", "if(id < 2500, 'hot', concat('t', cast(id div 2 AS string))) AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    table = docs.unionByName(more)
    index = exact_dedup.build_index(table, bucket_keys=200)
    slots, entries = index.directory.collect(), index.entries.collect()
    assert sorted(r.slot for r in slots) == list(range(1 << index.depth)) and index.depth >= 3
    bucket = {r.slot: r.bucket for r in slots}
    assert all(bucket[(r.key % (1 << 64)) >> (64 - index.depth)] == r.bucket for r in entries)
    assert max(Counter(r.bucket for r in entries).values()) <= 200
    groups = Counter(r.text or "" for r in table.collect())
    assert Counter(r.group_size for r in entries) == Counter(groups.values())
    out = {r.doc_id: r for r in exact_dedup.exact_groups(table, bucket_keys=200).collect()}
    assert out[150].group_size == 2500 and out[150].keep_id == 2599 and out[5099].kept and out[5098].keep_id == 5099
    empty = spark.createDataFrame([], "slot long, bucket int")
    index._read = lambda name: empty  # without its directory no row finds a bucket
    assert index.placed(index.keys).count() == 0


def shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def near_brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return {(i, len(s), low[i], low[i] == i) for i, s in sets.items()}


def test_near_groups(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id IS NOT NULL").collect()]
    base = words(120, 9000).split()
    for i in range(40):  # variants of one text, some of them only linked through others
        v = list(base)
        for j in range(i % 9):
            v[(7 * i + 13 * j) % 120] = f"v{i}-{j}"
        rows.append((100 + i, " ".join(v)))
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {tuple(r) for r in minhash.near_groups(clashing(table)).collect()}
    assert got == near_brute(rows)
    assert minhash.near_groups(empty).count() == 0
    null = minhash.near_groups(docs).where("doc_id IS NULL").collect()
    assert [(r.component_id, r.kept) for r in null] == [(None, True)]
    assert minhash.drop_near_copies(clashing(table)).columns == clashing(table).columns


def test_near_groups_of_short_texts(spark):
    # parts of 15 words, 7 at least; in these families half the bits of two linked texts' bins differ, and no star joins them
    cuts = (((0, 7), (0, 8), (0, 10), (1, 11), (0, 12), (2, 11), (0, 15)), ((0, 7), (0, 8), (0, 10), (0, 12), (0, 15)), ((2, 9), (2, 10), (0, 10), (2, 12), (0, 12), (0, 14)))
    rows, want = [], set()
    for f in (2991, 3978, 4965, 8274, 9381, 16586, 18027, 21993, 23598, 24313, 24513, 25563, 29502, 30438, 33159, 34263, *range(100, 160)):
        w = [f"f{f}x{i}" for i in range(15)]
        family = [(10 * f + i, " ".join(w[a:b])) for i, (a, b) in enumerate(cuts[f % 3])]
        rows += family
        want |= near_brute(family)
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    assert {tuple(r) for r in minhash.near_groups(table).collect()} == want


def test_near_groups_of_crowded_short_sets(spark):
    # sets of 3 to 12 shingles at similarity 0.75 and near it, several variants of each in the same buckets
    rows, want = [], set()
    for f in range(60):
        n = 7 + f % 10
        base = [f"c{f}w{i}" for i in range(n)]
        family = [" ".join(base), " ".join([*base, "x1"]), " ".join([*base, "x1", "x2"]), " ".join(["y1", *base]), " ".join(["y1", *base, "x1"]), " ".join([*base[1:], "z"]), " ".join(base[:-1]), " ".join([*base[:-1], "q"])]
        family = [(100 * f + i, t) for i, t in enumerate(dict.fromkeys(family))]
        rows += family
        want |= near_brute(family)
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    assert {tuple(r) for r in minhash.near_groups(table).collect()} == want


def test_small_sets_share_a_band():
    # of 120,000 such pairs of 4 and 3 hashes these three meet in no band of one permutation
    for seed in (28192, 65307, 81518):
        a = np.random.default_rng(seed).integers(0, 2**64, 4, dtype=np.uint64)
        a, b = np.unique(a), np.unique(a[:3])
        assert not (minhash.band_keys(minhash.bins_of(a)) == minhash.band_keys(minhash.bins_of(b))).any()
        assert (minhash.all_keys(a) == minhash.all_keys(b)).any()
    counts = [len(minhash.all_keys(np.arange(n, dtype=np.uint64))) for n in (0, 1, minhash.SMALL_SET, minhash.SMALL_SET + 1)]
    assert counts == [0, 80, 80, 40]


def test_words_are_hashed_by_pieces(monkeypatch):
    # whole pieces at a time, with the same hashes wherever a piece ends; long words by themselves
    rng = np.random.default_rng(5)
    for _ in range(100):
        some = bytes(rng.choice(list(b"aAbBz \t\n\x00\xc3\xa9"), size=int(rng.integers(0, 300))).tolist())
        data = some + b"x" * int(rng.choice([0, 31, 32, 33, 400])) + b" " + bytes(rng.choice(list(b"abC "), size=50).tolist())
        monkeypatch.undo()
        whole, seq = minhash.word_hashes(data), data.lower().split()
        monkeypatch.setattr(minhash, "PIECE", int(rng.integers(minhash.LONG, 90)))
        assert minhash.word_hashes(data).tolist() == whole.tolist() == [int(minhash.word_hashes(w)[0]) for w in seq]
        assert len(set(whole.tolist())) == len(set(seq))
    monkeypatch.undo()
    text = " ".join(f"w{i}" for i in range(60_000)) + " " + "y" * 400_000 + " Z z"
    assert len(text) > 2 * minhash.PIECE and len(set(minhash.word_hashes(text.encode()).tolist())) == 60_002
    sets = [minhash.shingle_set(" ".join(f"s{j}" for j in range(n))) for n in (0, 1, 5, 64, 68, 69, 3000)]
    assert [len(s) for s in sets] == [0, 1, 1, 60, 64, 65, 2996]
    assert [k.tolist() for k in minhash.keys_of_all(sets)] == [minhash.all_keys(s).tolist() for s in sets]


def test_the_bound_of_pairs_lets_every_link_pass(spark):
    # sets by what they share with a center; a few bits stand for what lies beyond it
    rng, center, rows = np.random.default_rng(8), set(range(60)), []
    for i in range(120):
        own = set(rng.permutation(60)[: rng.integers(10, 60)].tolist()) | set((100 + 40 * (i % 6) + rng.permutation(40)[: rng.integers(0, 40)]).tolist())
        bits = [0] * (minhash.REST_BITS // 64)
        for x in own - center:
            bits[x % 32] |= 1 << (x * 7 % 61)
        rows.append((i, len(own), len(own & center), len(own - center) - sum(b.bit_count() for b in bits), bits, sorted(own)))
    sets = spark.createDataFrame(rows, "rep int, n int, shared int, extra int, rest array<long>, own array<int>")
    both = F.size(F.array_intersect("x.own", "y.own"))
    pairs = sets.alias("x").join(sets.alias("y"), F.col("x.rep") < F.col("y.rep")).select(minhash._may_link(75).alias("may"), (100 * both >= 75 * (F.col("x.n") + F.col("y.n") - both)).alias("linked"))
    counts = {(r.may, r.linked): r["count"] for r in pairs.groupBy("may", "linked").count().collect()}
    assert (False, True) not in counts and counts[True, True] > 0 and counts[False, False] > 1000
    assert len(pairs._jdf.queryExecution().optimizedPlan().toString().split("bit_count")) < 10  # one loop, not a term a word


def test_near_groups_in_lots(spark, monkeypatch):
    # texts with more partners than a lot, more outsiders than a lot, and a sketch that lets others pass
    monkeypatch.setattr(minhash, "PARTNERS", 7)
    monkeypatch.setattr(minhash, "LOT", 3)
    monkeypatch.setattr(shared, "SKETCH_WORDS", 1)
    base, rows = words(80, 400).split(), []
    for i in range(60):
        v = list(base)
        for j in range(i % 5):
            v[(11 * i + 17 * j) % 80] = f"u{i % 20}-{j}"
        rows.append((i, " ".join(v)))
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumn("_keep", F.lit("clash"))
    assert {tuple(r) for r in minhash.near_groups(table).collect()} == near_brute(rows)
    assert {r.doc_id for r in minhash.drop_near_copies(table).collect()} == {i for i, _, low, kept in near_brute(rows) if kept}
    broken = spark.sql("SELECT id AS doc_id, cast(unhex('61FF6220') AS string) || 'x' AS text FROM range(2)")
    assert [r.component_id for r in minhash.near_groups(broken).collect()] == [0, 0]


@pytest.mark.parametrize("outsiders", [0, 5])
def test_near_groups_of_crowded_buckets(spark, monkeypatch, outsiders):
    monkeypatch.setattr(minhash, "OUTSIDERS", outsiders)
    monkeypatch.setattr(minhash, "LOT", 3)
    rng, rows = np.random.default_rng(11), []
    common = [f"c{i}" for i in range(60)]
    for f in range(40):  # one long passage in all; families of two to four, excerpts, and near copies of the passage
        own = [f"f{f}w{i}" for i in range(int(rng.integers(5, 50)))]
        for v in range(int(rng.integers(1, 5))):
            w = common[int(rng.integers(0, 25)) :] + own
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"x{f}{v}{rng.integers(9)}"
            rows.append((len(rows), " ".join(w)))
    for k in range(30):
        a = int(rng.integers(0, 30))
        rows.append((len(rows), " ".join(common[a : a + int(rng.integers(20, 60))])))
        rows.append((len(rows), " ".join([*common, *common[: k % 9], f"e{k}"])))
    rows += [(len(rows), " ".join(common)), (len(rows) + 1, " ".join(common * 2))]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    want = near_brute(rows)
    assert {tuple(r) for r in minhash.near_groups(table).collect()} == want and 20 < len({c for _, _, c, _ in want}) < len(rows)


def test_unlike_texts_of_one_passage_never_meet(spark, monkeypatch):
    monkeypatch.setattr(minhash, "OUTSIDERS", 64)
    n, met = 20_000, []
    monkeypatch.setattr(minhash, "met_by_tokens", lambda *a, f=minhash.met_by_tokens: met.append(f(*a)) or met[-1])
    passage = " ".join(f"p{i}" for i in range(45))
    texts = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage + " "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda j: F.concat(F.lit("w"), F.col("id"), F.lit("_"), j)), " ")).alias("text"))
    twins = texts.where("doc_id % 4000 = 1").select((F.col("doc_id") + n).alias("doc_id"), F.concat("text", F.lit(" more")).alias("text"))
    out = minhash.near_groups(texts.unionByName(twins))
    assert [(r.doc_id, r.component_id) for r in out.where("NOT kept").orderBy("doc_id").collect()] == [(n + i, i) for i in range(1, n, 4000)]
    assert met and met[0].count() <= 10  # of 200 million pairs in the passage's buckets


def test_mix(spark, docs, empty):
    out = mixing.mix(clashing(docs)).collect()
    sizes = {(r.doc_id, r.source): len((r.text or "").split()) for r in docs.collect()}
    assert all(r.size == sizes[r.doc_id, r.source] and r.taken <= 3 * r.size for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
    total = sum(r.size for r in out)
    assert sum(g[0].target for g in by.values()) == pytest.approx(total)
    for g in by.values():
        assert g[0].source_size == sum(r.size for r in g) and g[0].target <= 3 * g[0].source_size + 1e-6
        assert abs(sum(r.taken for r in g) - g[0].target) <= max(r.size for r in g) + 1e-6
        assert all(len(r.placed) * r.size == r.taken for r in g)
    assert Counter(map(str, mixing.mix(docs).collect())) == Counter(map(str, out))  # reruns agree
    assert mixing.mix(empty).count() == 0 and mixing.draw_mix(empty).count() == 0
    drawn = mixing.draw_mix(clashing(docs))
    assert drawn.columns == clashing(docs).columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter({i: sum(len(r.placed) for r in out if r.doc_id == i) for i in {r.doc_id for r in out}})


def test_mix_of_sources_that_fill_up_alike(spark):
    size = lambda n: " ".join(["w"] * n)
    mixed = lambda rows: {r.source: (r.target, r.taken) for r in mixing.mix(spark.createDataFrame([(i, s, size(n)) for i, (s, n) in enumerate(rows)], "doc_id long, source string, text string")).collect()}
    assert mixed([("a", 100), (None, 200)]) == {"a": (100.0, 100), None: (200.0, 200)}
    assert mixed([("a", 100), ("b", 200)]) == {"a": (100.0, 100), "b": (200.0, 200)}
    assert sum(t for t, _ in mixed([("a", 10), ("b", 20), ("c", 30), (None, 10), ("d", 900)]).values()) == 970
    assert mixed([("a", 0), (None, 0)]) == {"a": (0.0, 0), None: (0.0, 0)}


def test_mix_deals_the_trees_blocks(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 50)), "en", [None, "a", "b", "b", "b"][i % 5], 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs, shards=5).collect()
    words = Counter()
    for r in out:
        for p in r.placed:
            words[p.shard] += r.size
    assert set(words) == set(range(5)) and max(words.values()) - min(words.values()) <= 600  # even to about a document a source and end
    placed = {(r.doc_id, p.shard, p.order_key) for r in out for p in r.placed}
    drawn = [r.doc_id for r in mixing.draw_mix(docs, shards=5).collect()]
    assert Counter(drawn) == Counter(r.doc_id for r in out for _ in r.placed)
    # a shard's rows stand in shuffled order: ids rise as often as they fall
    assert 0.45 < sum(a < b for a, b in zip(drawn, drawn[1:], strict=False)) / len(drawn) < 0.55


def test_mix_tree_gives_exact_quotas(spark):
    for scale in (1, 10**9):
        quotas = spark.createDataFrame([("a", 1000 * scale), ("b", 37 * scale), (None, 0), ("c", 3 * scale)], "source string, quota long")
        bounds = {r.source: r.bounds for r in mixing.shard_bounds(quotas, 5).collect()}
        assert {k: v[-1] for k, v in bounds.items()} == {"a": 1000 * scale, "b": 37 * scale, None: 0, "c": 3 * scale}
        assert all(v == sorted(v) and len(v) == 5 for v in bounds.values())
        each = [[v[0], *(y - x for x, y in zip(v, v[1:], strict=False))] for v in bounds.values()]
        assert [sum(x) for x in zip(*each, strict=True)] == [208 * scale] * 5
        assert len({y - x for x, y in zip([0, *bounds["a"]], bounds["a"], strict=False)}) > 1  # drawn, not shared out


def test_hypergeometric_draws():
    import numpy as np

    rng = np.random.default_rng(1)
    for good, bad, sample in ((5, 7, 4), (300, 20, 50), (3, 10**10, 10**9)):
        got = [mixing.hypergeometric(rng, good, bad, sample) for _ in range(4000)]
        mean = sample * good / (good + bad)
        sd = (mean * bad / (good + bad) * (good + bad - sample) / (good + bad - 1)) ** 0.5
        assert abs(np.mean(got) - mean) < 5 * sd / 4000**0.5 and abs(np.std(got) / sd - 1) < 0.06
        assert min(got) >= max(0, sample - bad) and max(got) <= min(good, sample)
    assert mixing.hypergeometric(rng, 4, 0, 3) == 3 and mixing.hypergeometric(rng, 0, 4, 3) == 0


def test_sharded(spark, docs, empty):
    more = spark.range(1000, 1400).selectExpr("id AS doc_id", "if(id < 1100, 'hot', concat('t', cast(id div 3 AS string))) AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    table = docs.unionByName(more)
    out = sharding.sharded(clashing(table)).collect()
    rows = table.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    where, text = defaultdict(set), {r.doc_id: r.text for r in rows}
    for r in out:
        where[text[r.doc_id]].add(r.shard)
    small = [s for t, s in where.items() if t and t.startswith("t")]
    assert sum(len(s) == 1 for s in small) >= 0.8 * len(small)  # groups of three mostly stay together
    assert sharding.sharded(empty).count() == 0


def test_sample_by_hash_bound(spark):
    rows = spark.range(50_000).withColumnRenamed("id", "k")
    want = [r.k for r in rows.orderBy(F.xxhash64(F.lit("x"), "k"), "k").limit(300).collect()]
    assert [r.k for r in shared.sampled(rows, "x", "k", 300, 50_000).collect()] == want == [r.k for r in shared.sampled(rows, "x", "k", 300, 0).collect()]
    assert shared.sampled(rows.limit(0), "x", "k", 5, 0).count() == 0


def test_toxicity(spark, docs, empty):
    clean = [f"the {a} {b} of the {c}. it was {a} and {c} there" for a in ("red", "blue", "old", "new") for b in ("house", "tree", "road", "ship", "bird") for c in ("town", "sea", "hill", "wood", "lake", "farm")]
    rows = [(i, t if i % 3 else f"{t}. You are a {['blorfing', 'blorfed', 'zuggy'][i % 7 % 3]} one, {t}", i % 3 == 0) for i, t in enumerate(clean * 2)]
    table = spark.createDataFrame([(i, f"{t} number{i}", "en", "s", 0) for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(x)) for i, _, x in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(clashing(table), labels).collect()}
    held = [out[i] for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out for r in held) and sum(r.held_out for r in out.values()) == len(held)
    assert sum((r.predicted == 1) == rows[r.doc_id][2] for r in held) >= 0.95 * len(held)
    for i, t, x in rows:
        for s in out[i].offending if x else []:
            assert "You are a" in f"{t} number{i}"[s.start : s.end]
    # a clean text of 100,000 sentences stays clean, and one toxic sentence in it is found
    long = ". ".join(f"n{i} of the lake" for i in range(100_000))
    both = spark.createDataFrame([(9000, long), (9001, long + ". You are a blorfing one"), (9002, None)], "doc_id long, text string")
    model = toxicity.train(table, labels)
    scores = {r.doc_id: r for r in toxicity.score(both, model).collect()}
    assert scores[9000].score < 0.1 and scores[9001].score >= 0.7 and scores[9002].score < 0.01 and len(scores[9001].offending) == 1
    assert toxicity.train(table, labels, most_bytes=0) == {"": -12.0}
    assert toxicity.train(table.unionByName(table), labels.unionByName(labels)) == pytest.approx(model)  # repeats count once
    broken = both.selectExpr("doc_id", "cast(unhex('61FF62') AS string) AS text")
    assert all(r.score < 0.01 for r in toxicity.score(broken, model).collect())
    # the scores are the noisy-or of the given weights
    weights = dict(model)
    bias = weights.pop("")
    for r in toxicity.score(table, model).where("doc_id < 60").collect():
        text, keep, plain = f"{rows[r.doc_id][1]} number{r.doc_id}".lower(), 1.0, 0
        for part in toxicity.SENTENCE_END.split(text):
            held = [f for w in set(part.split()) for f in toxicity.features(w) if f in weights]
            keep *= 1 - 1 / (1 + math.exp(-bias - sum(weights[f] for f in held))) if held else 1.0
            plain += not held
        assert r.score == pytest.approx(1 - keep * (1 + math.exp(bias)) ** -math.log(1 + plain), abs=1e-9)
    odd = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert len(odd) == 13 and all(0 <= s < 0.7 for s in odd.values())
    assert toxicity.toxicity(empty, labels).count() == 0
    assert all(r.predicted == 0 for r in toxicity.toxicity(table, labels.where("false")).collect())
    kept = toxicity.drop_toxic(clashing(table), labels)
    assert kept.columns == clashing(table).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.score < 0.7}


def test_labels_against_brute_force(spark):
    # links of several kinds: propagated labels cut fewer pairs than chance, and quotas hold after every grant
    links = [(i, f"g{i // 5}") for i in range(400)] + [(i, f"h{i // 10}") for i in range(0, 400, 2)] + [(i, "all") for i in range(0, 400, 9)]
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 0) for i in range(400)], SCHEMA)
    out = {r.doc_id: r.shard for r in sharding.sharded(docs, shards=4, links=spark.createDataFrame(links, "doc_id long, link string")).collect()}
    assert Counter(Counter(out.values()).values()) == {100: 4}
    groups = defaultdict(list)
    for i, link in links:
        groups[link].append(i)
    cut = lambda place: sum(place[a] != place[b] for g in groups.values() for a in g for b in g if a < b)
    assert cut(out) < 0.75 * cut({i: i % 4 for i in range(400)})
    # one round by hand: every document asks for the shard that most members of its links have
    members = spark.createDataFrame([(i, link, i) for i, link in links[:400]], "doc_id long, link string, anchor long")
    start = {r.doc_id: r.shard for r in sharding.propagated(members, 4, 10**6, rounds=0).collect()}
    after = {r.doc_id: r.shard for r in sharding.propagated(members, 4, 10**6, rounds=1).collect()}
    for g in range(80):
        counts = Counter(start[i] for i in range(5 * g, 5 * g + 5))
        assert all(counts[after[i]] == max(counts.values()) for i in range(5 * g, 5 * g + 5))
    assert sharding.quotas([[0, 10], [0, 5]], 8) == pytest.approx([1.0, 0.3])


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.mark.parametrize("fold", ["tasks", "spark"])
def test_bpe(spark, docs, empty, ranks, fold):
    import tiktoken

    reference = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [(50, "it's  a\t\ttest\n\n  über 日本語 🙂🙂 ١٢٣ 4567 <|endoftext|> don't x y "), (51, "a" * 700 + " " * 300 + "é" * 90), (52, "\u0085 \x1c\x1d mixed\x00nul")]
    table = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in odd], SCHEMA))
    texts = Counter((r.doc_id, r.text or "") for r in table.collect())
    got = Counter()
    for r in bpe.encode(clashing(table), ranks, fold=fold).collect():
        ids = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        text = bytes(r.decoded).decode()
        assert ids == reference.encode_ordinary(text) and r.n_tokens == len(ids)
        got[r.doc_id, text] += 1
    assert got == texts
    broken = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text")
    assert bytes(bpe.encode(broken, ranks, fold=fold).first().decoded).decode() == "a\ufffdb"
    assert bpe.encode(empty, ranks, fold=fold).count() == 0


def test_split_pattern_agrees_on_all_characters(ranks):
    import regex
    import tiktoken

    reference = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "".join(f"a{chr(c)}{chr(c)}b" for c in range(0x3100) if not 0xD800 <= c < 0xE000)
    ours = [i for w in regex.findall(bpe.PATTERN, text) for i in bpe.heap_merged(w.encode(), ranks)]
    assert ours == reference.encode_ordinary(text)
