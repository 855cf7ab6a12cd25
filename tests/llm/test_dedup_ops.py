"""Exact and near deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifloom.llm import components, cuckoo, minhash, queries

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- cuckoo index ---------------------------------------------------------------------------------------------------


def test_index_operations():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (20_000, 4)).astype(np.uint64)
    index, live = cuckoo.CuckooIndex(buckets=16), {}
    for _ in range(20):
        at = rng.integers(0, len(keys), 3000)
        ids = rng.integers(0, 10**6, 3000)
        index.add(keys[at], ids, np.ones(3000, np.int64))
        for k, i in zip(at.tolist(), ids.tolist(), strict=True):
            n, most = live.get(k, (0, -1))
            live[k] = n + 1, max(most, i)
    held = np.array(sorted(live))
    entries = index.find(keys[held])
    assert (entries >= 0).all() and len(index) == len(live) and index.resizes > 3
    assert [(int(index.counts[e]), int(index.ids[e])) for e in entries] == [live[k] for k in held.tolist()]
    others = np.setdiff1d(np.arange(len(keys)), held)
    assert (index.find(keys[others]) < 0).all()
    gone, stay = held[:2000], held[2000:]
    assert index.delete(keys[gone]).all() and not index.delete(keys[gone]).any()
    assert (index.find(keys[gone]) < 0).all() and (index.find(keys[stay]) >= 0).all() and len(index) == len(stay)
    index.insert(keys[gone])
    assert (index.find(keys[held]) >= 0).all()


def test_equal_fingerprints_are_verified():
    base = np.array([[5, 7 << 48, 1, 1]], np.uint64)
    same = np.repeat(base, 40, axis=0)
    same[:, 3] = np.arange(40)
    index = cuckoo.CuckooIndex()
    index.add(same[:8], np.arange(8), np.ones(8, np.int64))
    assert (index.find(same[:8]) >= 0).all() and (index.find(same[8:]) < 0).all()


def test_exact_groups(spark, odd, empty):
    df = odd.withColumn("keep_id", F.lit(9)).withColumn("_digest", F.lit("clash")).withColumn("digest", F.lit(1))
    rows = cuckoo.duplicate_groups(df).collect()
    assert len(rows) == len(ODD) + 1
    groups = {}
    for i, t in enumerate(ODD):
        groups.setdefault(lowered(t), []).append(i)
    for r in rows:
        if r["doc_id"] is not None:
            own = groups[lowered(ODD[r["doc_id"]])]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
            assert r["text_sha256"] == hashlib.sha256(lowered(ODD[r["doc_id"]]).encode()).hexdigest()
    assert cuckoo.duplicate_groups(empty).count() == 0
    kept = cuckoo.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == len(groups) + 1


def test_no_id_is_reserved(spark):
    """The least and the largest long are ids like others; a null one is smaller than both."""
    low, high = -(2**63), 2**63 - 1
    rows = [(low, "only"), (None, "pair"), (low, "Pair"), (high, "three"), (low, "three"), (None, "three"), (None, "none")]
    found = {(r["doc_id"], r["text_sha256"]): r for r in cuckoo.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(found) == len(rows)
    for (i, t), keep, n in zip(rows, [low, low, low, high, high, high, None], [1, 2, 2, 3, 3, 3, 1], strict=True):
        r = found[i, digest(t.lower())]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, n, i == keep)
    kept = cuckoo.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["text"].lower(), r["doc_id"]) for r in kept if r["doc_id"] is not None) == [("only", low), ("pair", low), ("three", high)]
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["none"]


def test_small_tasks_and_hot_text(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id").cast("string"))).otherwise("Hot").alias("text"))
    index = cuckoo.digest_index(df, task_limit=10)
    assert index.count() == 2001 and index.agg(F.sum("group_size")).first()[0] == 3000
    assert index.orderBy(F.desc("group_size")).first()["keep_id"] == 2997


def test_small_shards(spark):
    """Shards that hand on their index at every few digests give the same index, also where deletions come in."""
    df = spark.range(4000).select((F.col("id") % 900).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 700).cast("string")).alias("text"))
    rows = [sorted(map(tuple, cuckoo.digest_index(df, task_limit=t, shard_limit=s).collect())) for t, s in ((7, 5), (10**6, 10**6))]
    assert rows[0] == rows[1] and len(rows[0]) == 700
    gone = df.where("doc_id % 2 = 0")
    live = df.where("doc_id % 2 = 1")
    left = [cuckoo.update_index(cuckoo.digest_index(df), df.where("false"), gone, live, task_limit=t, shard_limit=s) for t, s in ((7, 5), (10**6, 10**6))]
    expected = sorted(map(tuple, cuckoo.digest_index(live).collect()))
    assert [sorted(map(tuple, x.collect())) for x in left] == [expected, expected]


def test_index_updates(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    index = cuckoo.digest_index(make((1, "a"), (2, "A"), (3, "b")))
    index = cuckoo.update_index(index, make((4, "c"), (5, "b")), make((1, "a"), (2, "a"), (3, "B")), make((4, "c"), (5, "b")))
    assert sorted((r["keep_id"], r["group_size"]) for r in index.collect()) == [(4, 1), (5, 1)]


def test_deleting_the_kept_document(spark):
    """keep_id names a document that remains, and the group survives deduplication of what remains."""
    make = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    live = make((1, "a"), (4, "c"), (None, "n"))
    index = cuckoo.digest_index(make((1, "a"), (2, "a"), (3, "a"), (4, "c"), (9, "N"), (None, "n")))
    index = cuckoo.update_index(index, make(), make((2, "A"), (3, "a"), (9, "n")), live)
    assert sorted(((r["keep_id"], r["group_size"]) for r in index.collect()), key=str) == [(1, 1), (4, 1), (None, 1)]
    assert sorted((r["doc_id"] for r in cuckoo.deduplicated(live).collect()), key=str) == [1, 4, None]


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (1, "b", 0), (2, "b", 0), (2, "A", 0), (3, "c", 0), (None, "z", 0), (None, "Z", 0)], "doc_id long, text string, digest int")
    kept = cuckoo.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"].lower()) for r in kept.collect()), key=str) == sorted([(2, "a"), (2, "b"), (3, "c"), (None, "z")], key=str)
    groups = cuckoo.duplicate_groups(df, keep=("digest", "text")).collect()
    assert sorted((r["text"].lower(), r["group_size"]) for r in groups) == [("a", 3)] * 3 + [("b", 2)] * 2 + [("c", 1)] + [("z", 2)] * 2


def test_many_ids_are_joined_without_a_broadcast(spark, docs, monkeypatch):
    few = sorted(r["doc_id"] for r in cuckoo.deduplicated(docs).collect())
    monkeypatch.setattr(cuckoo, "bounded", lambda ids: ids)
    assert sorted(r["doc_id"] for r in cuckoo.deduplicated(docs).collect()) == few


# --- near duplicates ------------------------------------------------------------------------------------------------


def brute(texts, words, percent=80):
    """Components by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, n):
    """Chains and stars of edited texts: many similarities close to the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for group in range(n // 20):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 90))]
        for k in range(20):
            words = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[group * 20 + k] = " ".join(words)
            if k % 5 == 0:
                base = words
    return texts


@pytest.mark.parametrize("words", [4, 5])
def test_components_by_brute_force(spark, words):
    texts = near_copies(words, 300)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, words=words).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(texts, words).items()}


def test_near_query(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op3_minhash(spark, SF).collect()}
    assert got == brute(texts, 4)


def test_near_edge_cases(odd, empty):
    df = odd.withColumn("component", F.lit(1)).withColumn("bands", F.lit("clash"))
    rows = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    assert len(rows) == len(ODD) + 1
    texts = dict(enumerate(ODD))
    assert {i: (rows[i]["n_shingles"], rows[i]["component_id"]) for i in texts} == brute(texts, 5)
    assert rows[None]["kept"]
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.representatives(df).columns == df.columns
    twice = df.unionByName(df)
    assert minhash.near_duplicates(twice).count() == 2 * len(rows)


def test_odd_sketch_is_a_bound():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 500)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 300)).astype(np.uint64)]))
        bits = sum(int(x).bit_count() for x in (minhash.odd_sketch(a) ^ minhash.odd_sketch(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def test_connected_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7), (5, 4)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in components.connected_components(df).collect()} == {x: find(x) for x in list(parent)}
    assert components.connected_components(df.where("a = b")).count() == 0


def test_plans():
    """The default is 36 bands of 5; all thresholds keep the stated miss probabilities."""
    assert (minhash.plan(0.8).bands, minhash.plan(0.8).rows) == (36, 5)
    for t in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0):
        p = minhash.plan(t)
        assert (1 - t**p.rows) ** p.bands <= minhash.MISS * 1.01 and 0 <= p.most_bits <= p.minima
    with pytest.raises(ValueError, match="threshold"):
        minhash.plan(0.1)


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.7])
def test_lower_thresholds(spark, threshold):
    """No link is lost: all components equal those of comparing all pairs."""
    rng = random.Random(int(100 * threshold))
    texts = {}
    for group in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 80))]
        for k in range(12):
            words = base[:]
            for _ in range(rng.randint(0, len(base) // 5)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
            texts[group * 12 + k] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, words=3, threshold=threshold).collect()}
    expected = brute(texts, 3, round(100 * threshold))
    assert len({c for _, c in expected.values()}) < len(texts)
    assert got == expected


def test_one_folder_is_left(spark, docs):
    import os

    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    minhash.near_duplicates(docs).count()
    assert len(set(os.listdir(base)) - before) == 1


def test_candidates_without_a_broadcast(spark, docs, monkeypatch):
    few = sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(minhash, "bounded", lambda ids: ids)
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == few
