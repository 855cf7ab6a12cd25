"""Ragged growth, parts, codes and patterns finished in a task, against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motifloom.functions import bits, ragged
from motifloom.operators import graphs, partitions, support
from motifloom.plans import coding, framework


def is_subsequence(pattern, record):
    it = iter(record)
    return all(any(x == y for y in it) for x in pattern)


def contains_sets(pattern, record):
    """A sequence of sets in a sequence of sets."""
    at = 0
    for wanted in pattern:
        while at < len(record) and not set(wanted) <= set(record[at]):
            at += 1
        if at == len(record):
            return False
        at += 1
    return True


def brute(records, need, most, items, contains):
    """Frequent patterns of at most `most` items, by trying all."""
    found = {}
    for size in range(1, most + 1):
        for pattern in itertools.product(items, repeat=size):
            n = sum(contains(pattern, r) for r in records)
            if n >= need:
                found[pattern] = n
    return found


def set_patterns(items, most):
    """All sequences of sorted sets with at most `most` items."""
    sets = [s for k in range(1, most + 1) for s in itertools.combinations(items, k)]

    def grow(prefix, left):
        if prefix:
            yield prefix
        for s in sets:
            if len(s) <= left:
                yield from grow((*prefix, s), left - len(s))

    return grow((), most)


def of_steps(steps):
    sets = []
    for s in steps:
        if s & 1:
            sets[-1] = (*sets[-1], s >> 1)
        else:
            sets.append((s >> 1,))
    return tuple(sets)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("held", [1, 1 << 20])
def test_growth_of_sequences(seed, held):
    rng = random.Random(seed)
    records = [[rng.randrange(4) for _ in range(rng.randrange(0, 7))] for _ in range(25)] + [[], [1] * 6]
    block = ragged.block_of(pa.array([*records, None], pa.list_(pa.int64())))
    found = list(ragged.mined(block, 5, 4, held=held))
    assert len(dict(found)) == len(found)
    expected = brute(records, 5, 4, range(4), is_subsequence)
    assert {tuple(s >> 1 for s in steps): n for steps, n in found} == expected
    candidates = [tuple(2 * c for c in p) for p in {tuple(rng.randrange(6) for _ in range(rng.randrange(1, 6))) for _ in range(60)}]
    counted = ragged.counted(block, candidates, held)
    assert counted.tolist() == [sum(is_subsequence([s >> 1 for s in c], r) for r in records) for c in candidates]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("held", [1, 1 << 20])
def test_growth_of_itemset_sequences(seed, held):
    rng = random.Random(seed)
    records = [[sorted(rng.sample(range(4), rng.randrange(1, 4))) for _ in range(rng.randrange(0, 4))] for _ in range(20)]
    block = ragged.block_of(pa.array(records, pa.list_(pa.list_(pa.int64()))))
    found = list(ragged.mined(block, 4, 4, held=held))
    assert len(dict(found)) == len(found)
    every = {p: sum(contains_sets(p, r) for r in records) for p in set_patterns(range(4), 4)}
    assert {of_steps(steps): n for steps, n in found} == {p: n for p, n in every.items() if n >= 4}
    chosen = rng.sample(sorted(every), 80)
    steps = [tuple(2 * x + (k > 0) for s in p for k, x in enumerate(s)) for p in chosen]
    assert ragged.counted(block, steps, held).tolist() == [every[p] for p in chosen]


def test_empty_blocks():
    for kind in (pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))):
        block = ragged.block_of(pa.array([None, []], kind))
        assert list(ragged.mined(block, 1)) == [] and ragged.counted(block, [(0,), (2, 4)]).tolist() == [0, 0]
    block = ragged.block_of(pa.array([[[1, 2], None, []], [[3]]], pa.list_(pa.list_(pa.int64()))))
    assert dict(ragged.mined(block, 1)) == {(2,): 1, (4,): 1, (6,): 1, (2, 5): 1}
    assert list(ragged.mined(block, 1, 0)) == []


def shown(found):
    rows = found.collect()
    assert len({r["pattern"] for r in rows}) == len(rows)
    return {r["pattern"]: (r["size"], r["support"]) for r in rows}


@pytest.mark.parametrize(("parts", "tree"), [(1, 1 << 16), (5, 3)])
def test_parts_equal_brute_force(spark, parts, tree):
    """Empty and null records count in N; parts have different candidates, which the second pass counts."""
    rng = random.Random(parts)
    records = [[rng.choice("abcd") for _ in range(rng.randrange(0, 7))] for _ in range(60)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)] + [(60, None), (61, [None]), (62, ["z"])], "tran_id long, items array<string>")
    expected = brute(records, 63 * 0.2, 6, "abcd", is_subsequence)
    got = shown(partitions.frequent_by_parts(df, 0.2, least_parts=parts, tree=tree))
    assert got == {" > ".join(p): (len(p), n) for p, n in expected.items()}
    itemsets = {p: sum(set(p) <= set(r) for r in records) for k in range(1, 5) for p in itertools.combinations("abcd", k)}
    got = shown(partitions.frequent_by_parts(df, 0.2, as_sets=True, least_parts=parts, tree=tree))
    assert got == {",".join(p): (len(p), n) for p, n in itemsets.items() if n >= 63 * 0.2}
    assert set(shown(partitions.frequent_by_parts(df, 0.2, least_parts=parts, max_size=2))) == {" > ".join(p) for p in expected if len(p) <= 2}


def test_parts_of_itemset_sequences(spark):
    rng = random.Random(3)
    records = [[rng.sample("abc", rng.randrange(1, 4)) for _ in range(rng.randrange(0, 4))] for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(records)) + [(50, None)], "tran_id long, sequence array<array<string>>")
    every = {p: sum(contains_sets(p, r) for r in records) for p in set_patterns("abc", 6)}
    expected = {" ".join(f"({' '.join(s)})" for s in p): (sum(map(len, p)), n) for p, n in every.items() if n >= 51 * 0.25}
    for parts, tree in ((1, 100), (4, 2)):
        assert shown(partitions.frequent_by_parts(df, 0.25, least_parts=parts, tree=tree)) == expected
    assert partitions.frequent_by_parts(df.where("false"), 0.5).collect() == []


def test_numbers_in_order(spark):
    rows = spark.range(1000).select(F.concat(F.lit("i"), "id").alias("item"), (F.col("id") % 7).alias("support")).repartition(5)
    ranked = [(r["item"], r["rank"]) for r in support.item_ranks(rows).collect()]
    expected = sorted(((r["item"], r["support"]) for r in rows.collect()), key=lambda x: (-x[1], x[0]))
    assert sorted(ranked, key=lambda x: x[1]) == [(x[0], i) for i, x in enumerate(expected, 1)]
    assert coding.numbered(rows.where("false"), F.asc("item")).collect() == []


def sequences(spark, n=80):
    rng = random.Random(9)
    return [[rng.choice("abcde" if rng.random() < 0.8 else "xyz") for _ in range(rng.randrange(0, 8))] for _ in range(n)]


class Plain(framework.ItemSequences):
    """A miner without ways to finish."""

    suffixes = finish = property(lambda self: (_ for _ in ()).throw(AttributeError()))


@pytest.mark.parametrize("below", [0, 150, 10**9])
def test_finished_patterns_equal_level_by_level(spark, below, monkeypatch):
    """Both paths at 150: some patterns go to a task, others grow on."""
    records = sequences(spark)
    lines = spark.createDataFrame([(",".join(r),) for r in records if r], "value string")
    jobs = Counter()
    local, expand = framework._local, framework.ItemSequences.expand
    monkeypatch.setattr(framework, "_local", lambda *a: jobs.update(local=1) or local(*a))
    monkeypatch.setattr(framework.ItemSequences, "expand", lambda *a: jobs.update(level=1) or expand(*a))
    expected = shown(framework.run(framework.ItemSequences(), lines, 0.05))
    levels = jobs["level"]
    assert jobs["local"] == 0 and max(n for n, _ in expected.values()) >= 3
    for miner in (framework.ItemSequences(), framework.Coded(framework.ItemSequences())):
        jobs.clear()
        assert shown(framework.run(miner, lines, 0.05, finish_below=below)) == expected
        assert (jobs["local"] > 0) == (below > 0) and (jobs["level"] > 0) == (below < 10**9)
        assert jobs["level"] <= levels
        capped = shown(framework.run(miner, lines, 0.05, max_size=2, finish_below=below))
        assert capped == {p: v for p, v in expected.items() if v[0] <= 2}
    jobs.clear()
    assert shown(framework.run(Plain(), lines, 0.05, finish_below=below)) == expected and jobs["local"] == 0


def test_finished_itemsets_and_itemset_sequences(spark):
    rng = random.Random(4)
    baskets = spark.createDataFrame([(i, x) for i in range(60) for x in rng.sample("abcdefg", rng.randrange(1, 6))], "tran_id long, item string")
    expected = shown(framework.mine(framework.Itemsets(), baskets, 60, 0.1))
    for below in (60, 10**9):
        assert shown(framework.mine(framework.Itemsets(), baskets, 60, 0.1, finish_below=below)) == expected
    rows = [(i, p, x) for i in range(40) for p in range(rng.randrange(1, 4)) for x in rng.sample("abcd", rng.randrange(1, 4))]
    events = spark.createDataFrame(rows, "tran_id long, pos int, item string")
    expected = shown(framework.mine(framework.ItemsetSequences(), events, 40, 0.08))
    assert any(n >= 3 for n, _ in expected.values())
    for below in (100, 10**9):
        assert shown(framework.mine(framework.ItemsetSequences(), events, 40, 0.08, finish_below=below)) == expected


def test_coded_itemset_sequences(spark):
    lines = spark.createDataFrame([(f"{c} {s} 2 {10 * (c % 3)} {7 + s}",) for c in range(12) for s in range(3)], "value string")
    expected = shown(framework.run(framework.ItemsetSequences(), lines, 0.3))
    assert expected and shown(framework.run(framework.Coded(framework.ItemsetSequences()), lines, 0.3)) == expected
    assert shown(framework.run(framework.Coded(framework.ItemsetSequences()), lines, 0.3, finish_below=10**6)) == expected


def test_only_frequent_canonical_codes_get_embeddings(spark, monkeypatch):
    """A hub with many equal neighbours gives a few rows; the last level has no embeddings."""
    hub = [(g, 0, 1 + v, 5, 6, 1) for g in range(3) for v in range(40)] + [(g, 1, 100 + g, 6, 7 + g, 2) for g in range(3)]
    edges = spark.createDataFrame(hub, "gid int, u int, v int, lu int, lv int, el int")
    built, seen = [], []
    embed, candidates = graphs.Subgraphs.embed, graphs.Subgraphs.candidates

    def spied(self, projected, chosen, db):
        built.append({(r["delta"]["lf"], r["delta"]["le"], r["delta"]["lt"]) for r in chosen.collect()})
        return embed(self, projected, chosen, db)

    def counted(self, projected, db, size):
        found = candidates(self, projected, db, size)
        seen.append(found.count())
        return found

    monkeypatch.setattr(graphs.Subgraphs, "embed", spied)
    monkeypatch.setattr(graphs.Subgraphs, "candidates", counted)
    found = shown(graphs.frequent_subgraphs(edges, 3, 1.0, max_edges=3))
    star = "0 1 5 1 6"
    assert found == {star: (1, 3), star + " , 0 2 -1 1 6": (2, 3), star + " , 0 2 -1 1 6 , 0 3 -1 1 6": (3, 3)}
    assert len(built) == 2 and built[0] == {(5, 1, 6)}
    assert seen == [3, 3, 3]


def test_hub_neighbours_that_are_all_in_the_pattern(spark):
    """A code grows only where a neighbour is left over."""
    rows = [(0, 0, 1, 5, 6, 1), (0, 0, 2, 5, 6, 1), (1, 0, 1, 5, 6, 1), (1, 0, 2, 5, 6, 1), (1, 0, 3, 5, 6, 1)]
    edges = spark.createDataFrame(rows, "gid int, u int, v int, lu int, lv int, el int")
    found = shown(graphs.frequent_subgraphs(edges, 2, 0.5))
    star = "0 1 5 1 6"
    assert found == {star: (1, 2), star + " , 0 2 -1 1 6": (2, 2), star + " , 0 2 -1 1 6 , 0 3 -1 1 6": (3, 1)}


def test_block_ends():
    block = ragged.block_of(pa.array([[[1, 2], [3]], [], [[4]]], pa.list_(pa.list_(pa.int64()))))
    assert block.code.tolist() == [1, 2, 3, 4] and block.record.tolist() == [0, 0, 0, 2]
    assert block.set_end.tolist() == [2, 2, 3, 4] and block.record_end.tolist() == [3, 3, 3, 4]
    assert np.array_equal(ragged.runs(np.array([5, 0, 9]), np.array([2, 0, 3])), [5, 6, 9, 10, 11])


def test_bitmaps_equal_rows(spark):
    """Also where records need several words, and where two words meet."""
    rng = random.Random(6)
    rows = [(i, p, x) for i in range(25) for p in range(rng.randrange(1, 5)) for x in rng.sample("abcd", rng.randrange(1, 4))]
    edge = framework.WORD
    for i, places in enumerate([(0, edge - 1, edge, 3 * edge), (edge - 1, edge), (edge, 2 * edge, 2 * edge + 1), (2 * edge - 1, 2 * edge)], 25):
        rows += [(i, p, x) for p in places for x in ("ab" if p % 2 else "ac")]
    events = spark.createDataFrame(rows, "tran_id long, pos int, item string")
    miner = framework.Bitmaps()
    for threshold in (0.1, 0.4):
        expected = shown(framework.mine(framework.ItemsetSequences(), events, 29, threshold, max_size=4))
        assert shown(framework.mine(miner, miner.bitmaps(events), 29, threshold, max_size=4)) == expected
    lines = spark.createDataFrame([(f"{c} {s} 2 {10 * (c % 3)} {7 + s}",) for c in range(12) for s in range(3)], "value string")
    expected = shown(framework.run(framework.ItemsetSequences(), lines, 0.3))
    assert shown(framework.run(framework.Coded(framework.Bitmaps()), lines, 0.3)) == shown(framework.run(framework.Bitmaps(), lines, 0.3)) == expected


@pytest.mark.parametrize("long", [4096, 4])
def test_records_in_blocks_and_by_rows(spark, long, monkeypatch):
    """Counted in blocks, by rows, or partly so, patterns are the same; null items and places that tie too."""
    monkeypatch.setattr(framework, "LONG", long)
    rng = random.Random(9)
    rows = sorted({(i, rng.randrange(5), rng.choice("abcd") if i < 38 else rng.choice(["a", "b", None])) for i in range(40) for _ in range(rng.randrange(3, 12))}, key=str)
    events = spark.createDataFrame(rows, "tran_id long, pos int, item string")
    for miner in (framework.ItemSequences(), framework.ItemsetSequences(), framework.Itemsets()):
        found = []
        for below in (10**6, 0):  # frames with more rows are counted in blocks
            monkeypatch.setattr(framework, "FINISH_BELOW", below)
            assert (miner.split(events) is None) == (below > 0)
            kept = [(r["pattern"], r["size"], r["support"], repr(r["items"])) for r in framework.mine(miner, events, 40, 0.1, max_size=3, typed=True).collect()]
            found.append(sorted(kept))
        assert found[0] == found[1]
        assert max(size for _, size, *_ in found[0]) > 2


@pytest.mark.parametrize(("long", "words", "tree"), [(1 << 12, 1 << 6, 1 << 16), (3, 1, 4)])
def test_bitmap_blocks_equal_brute_force(spark, monkeypatch, long, words, tree):
    """Records of one word and of several, with null items, without an id; long ones grow as rows, the others are counted and no row is grown."""
    monkeypatch.setattr(framework, "LONG", long)
    monkeypatch.setattr(framework, "WORDS", words)
    monkeypatch.setattr(framework, "TREE", tree)
    rng = random.Random(9)
    rows = [(i, p, x) for i in range(20) for p in rng.sample(range(4), 3) for x in rng.sample("abcd", rng.randrange(1, 4))]
    rows += [(20, p, x) for p in (3, framework.WORD * 2, framework.WORD * 5 + 1) for x in "abc"]
    rows += [(None, 0, "a"), (None, 1, "b"), (None, 1, "c")]
    odd = [(21, 0, "a"), (21, 0, None), (21, 1, "b")]
    if long > 3:
        monkeypatch.setattr(framework.Bitmaps, "expand", lambda self, projected, db: pytest.fail("grown as rows"))
    else:
        rows += odd
    sets = {}
    for i, p, x in rows:
        sets.setdefault(i, {}).setdefault(p, set()).add(x)
    records = [[r[p] for p in sorted(r)] for r in sets.values()]
    supports = {p: sum(contains_sets(p, r) for r in records) for p in set_patterns("abcd", 4)}
    expected = {"(" + ") (".join(" ".join(s) for s in p) + ")": (sum(map(len, p)), n) for p, n in supports.items() if n >= 4}
    events, miner = spark.createDataFrame(rows, "tran_id long, pos int, item string"), framework.Bitmaps()
    assert shown(framework.mine(miner, miner.bitmaps(events), len(records), 4 / len(records), max_size=4)) == expected and expected


@pytest.mark.parametrize("held", [1, 1 << 20])
@pytest.mark.parametrize("width", [8, 1 << 12])
def test_bitmaps_grow_as_places(held, width):
    """The same steps and supports as from places, in blocks of any size."""
    rng = random.Random(2)
    records = [{p: sorted(rng.sample(range(4), rng.randrange(1, 4))) for p in rng.sample([0, 1, 30, 61, 62, 63, 130, 400], rng.randrange(1, 6))} for _ in range(40)]
    places = ragged.block_of(pa.array([[r[p] for p in sorted(r)] for r in records], pa.list_(pa.list_(pa.int64()))))
    rows = []
    for i, r in enumerate(records):
        for x in sorted({x for s in r.values() for x in s}):
            at = [p for p in r if x in r[p]]
            rows.append((x, i, [sum(1 << p % framework.WORD for p in at if p // framework.WORD == w) for w in range(max(at) // framework.WORD + 1)]))
    code, record, words = (list(c) for c in zip(*rows, strict=True))
    candidates = [(0,), (2, 4), (2, 5), (0, 3, 6), (6, 6), (4, width)]

    def total(found):
        out = Counter()
        for a, b, n in found:
            out.update({(x, y): z for x, y, z in zip(np.ravel(a).tolist(), b.tolist(), n.tolist(), strict=True)})
        return out

    blocks = list(bits.blocks_of(pa.array(words, pa.list_(pa.int64())), np.array(code), np.array(record), held))
    assert len(blocks) == 40 if held == 1 else len(blocks) == 4
    assert total(bits.extended(blocks, candidates, width)) == total(ragged.extended(places, [tuple(min(s, 8) for s in c) for c in candidates]))
    first = ragged.begun(places)
    assert total((np.zeros(len(s), int), s, n) for s, n in bits.begun(blocks)) == dict(zip(((0, k) for k in first.key.tolist()), first.support.tolist(), strict=True))
