"""Preorder intervals and nearest prefixes against plain loops, over few and many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from motifloom.plans import intervals, tree


def patterns(seed, n=150):
    rng = random.Random(seed)
    return [[rng.choice("ab" if rng.random() < 0.8 else "cd") for _ in range(rng.randrange(0, 7))] for _ in range(n)]


@pytest.mark.parametrize("parts", ["1", "7"])
@pytest.mark.parametrize("seed", range(2))
def test_against_plain_loops(spark, seed, parts):
    """Sets without all prefixes, with repeated patterns and the empty one."""
    rows = [(i, p, i % 3 == 0) for i, p in enumerate([*patterns(seed), [], ["a"]])]
    df = spark.createDataFrame(rows, "id int, pattern array<string>, c boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        distinct = sorted({tuple(p) for _, p, _ in rows})
        found = {tuple(r["pattern"]): r for r in intervals.preorder(df.select("pattern").distinct()).collect()}
        assert len(found) == len(distinct)
        for k, p in enumerate(distinct):
            below = sum(q[: len(p)] == p for q in distinct)
            assert (found[p]["depth"], found[p]["begin"], found[p]["end"]) == (len(p), k, k + below)
        chosen = {tuple(p) for _, p, c in rows if c}
        for itself in (False, True):
            got = {r["id"]: r for r in intervals.nearest_prefix(df, F.col("c"), itself=itself).collect()}
            assert len(got) == len(rows)
            for i, p, _ in rows:
                prefixes = [p[:k] for k in range(len(p) + itself) if tuple(p[:k]) in chosen]
                assert got[i]["nearest"] == (prefixes[-1] if prefixes else None), (p, itself)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_subtrees_and_empty_sets(spark):
    df = spark.createDataFrame([(p, len(p)) for p in patterns(5, 60)], "pattern array<string>, support int")
    roots = spark.createDataFrame([(["a", "b"],), (["b"],), (["z"],)], "pattern array<string>")
    under = [r for r in df.collect() if r["pattern"][:1] == ["b"] or r["pattern"][:2] == ["a", "b"]]
    assert sorted(map(tuple, ((tuple(r[0]), r[1]) for r in tree.subtree(df, roots).collect()))) == sorted((tuple(r[0]), r[1]) for r in under)
    assert tree.without_subtrees(df, roots).count() == 60 - len(under)
    none = df.where("false")
    assert tree.subtree(none, roots).collect() == [] and tree.subtree(df, roots.where("false")).collect() == []
    assert tree.subtree_sizes(none).collect() == []
    asked = spark.createDataFrame([(["b", "q"],), (["b", "q"],), ([],), (None,)], "query array<string>")
    only = spark.createDataFrame([(["b"],), (["b", "q", "r"],)], "pattern array<string>")
    assert {tuple(r["query"] or ["null"]): r["matched"] for r in tree.longest_prefixes(asked, only).collect()} == {("b", "q"): ["b"], ("null",): None}
    assert tree.longest_prefixes(asked, only).count() == 3
