"""Pattern trees, parts, sources, sinks, streams and metrics."""

import pytest

from motifloom.operators import partitions
from motifloom.plans import metrics, tree
from motifloom.sources import sinks, tables, text
from motifloom.streaming import supports


@pytest.fixture
def patterns(spark):
    return spark.createDataFrame([(["a"], 5), (["b"], 4), (["a", "b"], 3), (["a", "b", "c"], 2), (["b", "a"], 2)], "pattern array<string>, support long")


def named(df, value):
    return {tuple(r["pattern"]): r[value] for r in df.collect()}


def test_tree(spark, patterns):
    assert named(tree.children_counts(patterns), "children") == {("a",): 1, ("b",): 1, ("a", "b"): 1, ("a", "b", "c"): 0, ("b", "a"): 0}
    assert named(tree.parent_supports(patterns), "parent_support") == {("a", "b"): 5, ("a", "b", "c"): 3, ("b", "a"): 4}
    roots = spark.createDataFrame([(["a"],)], "pattern array<string>")
    assert set(named(tree.subtree(patterns, roots), "support")) == {("a",), ("a", "b"), ("a", "b", "c")}
    assert set(named(tree.without_subtrees(patterns, roots), "support")) == {("b",), ("b", "a")}
    queries = spark.createDataFrame([(["a", "b", "x"],), (["z"],), ([],)], "query array<string>")
    found = {tuple(r["query"]): r["matched"] for r in tree.longest_prefixes(queries, patterns).collect()}
    assert found == {("a", "b", "x"): ["a", "b"], ("z",): None, (): None}


def test_parts_merge_to_global_supports(spark):
    rows = spark.createDataFrame([(i, p) for i in range(20) for p in "abc" if (i % 3 == 0 or p == "a")], "tran_id long, pattern string")
    from pyspark.sql import functions as F

    part = F.pmod("tran_id", F.lit(4))
    local = partitions.local_support(rows, part)
    sizes = rows.select("tran_id").distinct().groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    merged = {r["pattern"]: r["support"] for r in partitions.merged_support(local, F.lit(20), 0.3).collect()}
    assert merged == {"a": 20, "b": 7, "c": 7}
    assert set(merged) <= {r["pattern"] for r in partitions.candidates(local, sizes, 0.3).collect()}
    assert partitions.frontier(local).first()["pattern"] == "c"


def test_tables(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 2, "a"), (2, 1, "c")], "id long, at int, item string")
    assert {r["tran_id"]: r["items"] for r in tables.baskets(rows, "id", "item").collect()} == {1: ["a", "b"], 2: ["c"]}
    assert {r["tran_id"]: r["sequence"] for r in tables.itemset_sequences(rows, "id", ["at"], "item").collect()} == {1: [["a"], ["a", "b"]], 2: [["c"]]}
    assert {r["tran_id"]: r["items"] for r in tables.item_sequences(rows, "id", ["at", "item"], "item").collect()} == {1: ["a", "a", "b"], 2: ["c"]}


def test_sinks_and_part_files(spark, tmp_path):
    found = spark.createDataFrame([("a > b", 2, 7)], "pattern string, size int, support long")
    sinks.write_patterns(found, str(tmp_path / "t"), "text")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a > b: 7"]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.write_patterns(found, str(tmp_path / "t"), "text")
    sinks.write_patterns(found, str(tmp_path / "p"), max_records_per_file=1)
    assert spark.read.parquet(str(tmp_path / "p")).collect() == found.collect()
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"part_{i:04d}").write_text("a,b\n\nb\n")
    assert text.read_item_sequences(spark, str(tmp_path / "in")).count() == 6
    sinks.copy_text(spark, str(tmp_path / "in"), str(tmp_path / "copy"))
    sinks.copy_text(spark, str(tmp_path / "in"), str(tmp_path / "copy"), overwrite=True)
    assert spark.read.text(str(tmp_path / "copy")).count() == 9


def test_stream_supports(spark, tmp_path):
    source = tmp_path / "stream"
    spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a"])], "tran_id long, items array<string>").write.parquet(str(source))
    stream = spark.readStream.schema("tran_id long, items array<string>").parquet(str(source))
    query = supports.running_supports(stream).writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r["item"]: r["support"] for r in spark.table("running").collect()} == {"a": 2, "b": 1}


def test_metrics(spark):
    times = {}
    with metrics.timed(times, "run"):
        df, seen = metrics.observed(spark.range(7))
        df.collect()
    assert seen.get["n"] == 7 and times["run"] > 0


def test_levels_of_a_run(spark):
    """Counts of each level; of graphs, canonical codes are fewer than frequent ones."""
    from motifloom.operators import graphs
    from motifloom.plans.metrics import Levels

    edges = [(g, u, v, 0, 0, 0) for g in range(3) for u, v in ((0, 1), (1, 2), (2, 3))]
    levels = Levels()
    found = graphs.frequent_subgraphs(spark.createDataFrame(edges, "gid int, u int, v int, lu int, lv int, el int"), 3, 1.0, levels=levels).collect()
    rows = [r.asDict() for r in levels.frame(spark).collect()]
    assert [r["canonical"] for r in rows] == [1, 1, 1, 0] and len(found) == 3
    assert [r["level"] for r in rows] == [1, 2, 3, 4] and rows[0]["projections"] == 3 and rows[1]["candidates"] == 2
    assert all(r["projections"] >= r["frequent"] >= r["canonical"] and r["candidates"] >= r["frequent"] and r["seconds"] > 0 for r in rows)
    assert rows[1]["frequent"] == 2  # the path's end and its start; the second is no least code
