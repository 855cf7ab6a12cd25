"""Hand-made and published cases of sequences and itemsets."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from motifloom.operators import itemsets, projection, prune, sequences, support
from motifloom.plans import framework
from motifloom.sources import text

PAPER = """1 1 1 1
1 2 3 1 2 3
1 3 2 1 3
1 4 1 4
1 5 2 3 6
2 1 2 1 4
2 2 1 3
2 3 2 2 3
2 4 2 1 5
3 1 2 5 6
3 2 2 1 2
3 3 2 4 6
3 4 1 3
3 5 1 2
4 1 1 5
4 2 1 7
4 3 2 1 6
4 4 1 3
4 5 1 2
4 6 1 3"""


def lines(spark, content, parts=1):
    rows = [(x,) for x in content.split("\n")]
    return spark.createDataFrame(rows, "value string").repartition(parts)


def result(df):
    return {r["pattern"]: r["support"] for r in df.collect()}


def both(spark, content, threshold, parts=1):
    """The built-in miner and the level-wise one agree."""
    records = text.parse_item_lines(lines(spark, content, parts)).cache()
    one = result(sequences.frequent_item_sequences(records, threshold))
    two = result(framework.mine(framework.ItemSequences(), projection.events_of(records), support.record_count(records), threshold))
    assert one == two == result(framework.run(framework.ItemSequences(), lines(spark, content, parts), threshold))
    return one


@pytest.mark.parametrize(
    ("content", "threshold", "expected"),
    [
        ("a,b,c\na,c\nb,c,a", 0.5, {"a": 3, "b": 2, "c": 3, "a > c": 2, "b > c": 2}),
        ("a,b,a\na,a", 1.0, {"a": 2, "a > a": 2}),
        ("a,b,c\n\na,,c\nb,c,a", 0.5, {"a": 3, "b": 2, "c": 3, "a > c": 2, "b > c": 2}),
        ("x\nx\nx\ny\ny\nz\nz", 0.3, {"x": 3}),
        ("a\nb\nc", 0.5, {}),
        ("40000\n40000", 1.0, {"40000": 2}),
    ],
)
def test_item_sequences(spark, content, threshold, expected):
    assert both(spark, content, threshold) == expected


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_partitioning_does_not_matter(spark, parts):
    assert both(spark, "a,b,c\na,c\nb,c,a", 0.5, parts) == {"a": 3, "b": 2, "c": 3, "a > c": 2, "b > c": 2}


def test_item_sequences_brute_force(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(20)]
    counts = {}
    for row in rows:
        for s in {c for n in range(1, len(row) + 1) for c in itertools.combinations(row, n)}:
            counts[" > ".join(s)] = counts.get(" > ".join(s), 0) + 1
    expected = {p: n for p, n in counts.items() if n >= 20 * 0.2}
    assert both(spark, "\n".join(",".join(r) for r in rows), 0.2) == expected


def itemset_result(spark, content, threshold):
    records = text.parse_itemset_lines(lines(spark, content, 2)).cache()
    one = result(sequences.frequent_itemset_sequences(records, threshold))
    two = result(framework.mine(framework.ItemsetSequences(), projection.set_events_of(records), support.record_count(records), threshold))
    assert one == two == result(framework.run(framework.ItemsetSequences(), lines(spark, content), threshold))
    return one


def test_published_itemset_sequences(spark):
    found = itemset_result(spark, PAPER, 0.5)
    assert len(found) == 53
    assert found["(1)"] == 4 and found["(1) (2)"] == 4 and found["(1 2)"] == 2 and found["(1) (2 3) (1)"] == 2 and found["(5) (6) (3) (2)"] == 2
    shuffled = PAPER.split("\n")
    random.Random(1).shuffle(shuffled)
    assert itemset_result(spark, "\n".join(shuffled), 0.5) == found


@pytest.mark.parametrize(
    ("content", "threshold", "expected"),
    [
        ("1 1 1 1\n1 2 1 9\n1 3 1 2\n2 1 1 1\n2 2 1 2\n3 1 1 1\n3 2 1 2", 0.67, {"(1)": 3, "(2)": 3, "(1) (2)": 3}),
        ("1 1 2 2 1\n2 1 2 1 2", 1.0, {"(1)": 2, "(2)": 2, "(1 2)": 2}),
        ("1 1 1 9\n1 2 1 1\n2 1 1 1\n3 1 1 1\n3 2 1 9", 1.0, {"(1)": 3}),
    ],
)
def test_itemset_sequences(spark, content, threshold, expected):
    assert itemset_result(spark, content, threshold) == expected


def test_bad_lines(spark):
    bad = lines(spark, "1 1 1 x\n2 1 1 5")
    assert [r["tran_id"] for r in text.parse_itemset_lines(bad).collect()] == [2]
    with pytest.raises(Exception, match="not an itemset line"):
        text.parse_itemset_lines(bad, strict=True).collect()


def test_itemsets_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, sorted({rng.choice("abcdef") for _ in range(rng.randint(0, 5))})) for i in range(30)]
    records = spark.createDataFrame([*rows, (30, None)], "tran_id long, items array<string>")
    counts = {}
    for _, row in rows:
        for n in range(1, len(row) + 1):
            for c in itertools.combinations(row, n):
                counts[",".join(c)] = counts.get(",".join(c), 0) + 1
    expected = {p: n for p, n in counts.items() if n >= 31 * 0.2}
    assert result(itemsets.frequent_itemsets(records, 0.2)) == expected
    db = records.selectExpr("tran_id", "explode(items) as item")
    assert result(framework.mine(framework.Itemsets(), db, 31, 0.2)) == expected
    assert result(framework.run(framework.Itemsets(), lines(spark, "a,b\nb,a,a\nc"), 0.5)) == {"a": 2, "b": 2, "a,b": 2}


def test_miner_of_ones_own(spark):
    class Weighted(framework.ItemSequences):
        """Counts occurrences of first items by record parity only."""

        def support(self):
            from pyspark.sql import functions as F

            return F.countDistinct(F.col("tran_id") % 2)

    assert isinstance(Weighted(), framework.Miner)
    db = spark.createDataFrame([(i, 0, "a") for i in range(6)] + [(2, 1, "b")], "tran_id long, pos int, item string")
    assert result(framework.mine(Weighted(), db, 2, 1.0)) == {"a": 2}


def test_pruning(spark):
    records = spark.createDataFrame([(1, ["a", "z", "b"]), (2, ["a"]), (3, ["q"])], "tran_id long, items array<string>")
    frequent = support.frequent_items(records, 0.5)
    assert {(r["item"], r["support"]) for r in frequent.collect()} == {("a", 2)}
    assert {(r["tran_id"], tuple(r["items"])) for r in prune.prune_item_sequences(records, frequent).collect()} == {(1, ("a",)), (2, ("a",))}
    assert {r["item"] for r in support.infrequent_items(records, 0.5).collect()} == {"b", "q", "z"}
    sets = spark.createDataFrame([(1, [[1], [9], [2, 9]]), (2, [[9]])], "tran_id long, sequence array<array<int>>")
    kept = prune.prune_itemset_sequences(sets, spark.createDataFrame([(1, 5), (2, 5)], "item int, support long"))
    assert [(r["tran_id"], r["sequence"]) for r in kept.collect()] == [(1, [[1], [2]])]


def test_ranks_break_ties_by_item(spark):
    records = spark.createDataFrame([(1, ["b", "a"]), (2, ["c", "c"]), (3, ["c"])], "tran_id long, items array<string>")
    ranks = {r["item"]: (r["support"], r["rank"]) for r in support.item_ranks(support.item_support(records)).collect()}
    assert ranks == {"c": (2, 1), "a": (1, 2), "b": (1, 3)}


def test_patterns_that_look_alike_have_items_of_their_own(spark):
    """Items that hold the separators, and null items, are told apart by the typed column."""
    from motifloom.operators.itemsets import frequent_itemsets
    from motifloom.operators.sequences import frequent_item_sequences, frequent_itemset_sequences
    from motifloom.plans import framework

    df = spark.createDataFrame([(0, ["a,b", "c"]), (1, ["a", "b,c"]), (2, ["a", None])], "tran_id long, items array<string>")
    alike = [r["items"] for r in frequent_itemsets(df, 0.3, typed=True).collect() if r["pattern"] == "a,b,c"]
    assert sorted(alike) == [["a", "b,c"], ["a,b", "c"]]
    assert ["a", None] in [r["items"] for r in frequent_itemsets(df, 0.3, typed=True).collect() if r["pattern"] == "a" and r["size"] == 2]
    df = spark.createDataFrame([(0, ["a > b", "c"]), (1, ["a", "b > c"])], "tran_id long, items array<string>")
    found = frequent_item_sequences(df, 0.5, typed=True).collect()
    assert len({tuple(r["items"]) for r in found}) == len(found) > len({r["pattern"] for r in found})
    db = df.select("tran_id", F.posexplode("items").alias("pos", "item"))
    again = framework.mine(framework.ItemSequences(), db, 2, 0.5, typed=True).collect()
    assert {tuple(r["items"]) for r in again} == {tuple(r["items"]) for r in found}
    df = spark.createDataFrame([(0, [["a b", "c"]]), (1, [["a", "b c"]])], "tran_id long, sequence array<array<string>>")
    found = frequent_itemset_sequences(df, 0.5, typed=True).collect()
    assert len({repr(r["items"]) for r in found}) == len(found) > len({r["pattern"] for r in found})


def test_itemset_step_makes_each_row_once(spark):
    """Later items are met from a pattern's first place only, and nothing is left to a distinct() over the grown rows."""
    events = spark.createDataFrame([(1, p, i) for p in range(4) for i in "ab"], "tran_id long, pos int, item string")
    one = events.selectExpr("item as pattern", "item as last", "tran_id", "pos")
    grown = projection.itemset_step(one, events)
    rows = [tuple(r) for r in grown.collect()]
    assert len(rows) == len(set(rows)) == 2 * 3 * 2 + 4 and ("a", True, "b", 1, 3) in rows and ("b", False, "a", 1, 1) in rows
    assert not grown._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
