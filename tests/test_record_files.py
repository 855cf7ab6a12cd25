"""Record files: ranges of any size give the same records, files roll by bytes, what is written is read back."""

import io
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from motifloom.operators import graphs
from motifloom.plans import framework
from motifloom.sources import files, text

GRAPHS = "\n  \nt # 0\nv 0 1\nv 1 1\ne 0 1 2\n\nt\t#\t0 x\r\nv\t0 1\r\n\r\nv 1 2\r\ne 0 1 2\r\n t % 7\nt # -1\nv 0 3\nv 1 4\ne 0 1 2"
ITEMSETS = "1 1 2 5 6\n1 2 1 7\n\n2 1 1 5\n\n 2 2 1 6\n3 1 1 9\n1 3 1 8\n"


def plain(content: str, layout: str):
    """Records by one walk over all lines."""
    opens, found, before, at = files.LAYOUTS[layout][0], [], None, 0
    for line in content.encode().splitlines(keepends=True):
        bare = line.rstrip(b"\r\n")
        if bare.strip():
            if not found or opens(bare, before):
                found.append((at, [bare]))
            else:
                found[-1][1].append(bare)
            before = bare
        at += len(line)
    return found


def by_ranges(content: str, layout: str, size: int):
    raw = content.encode()
    return [r for s in range(0, len(raw), size) for r in files.records_of(io.BytesIO(raw), s, min(s + size, len(raw)), layout)]


@pytest.mark.parametrize("layout", files.LAYOUTS)
def test_ranges_of_any_size(layout):
    rng = random.Random(5)
    made = ["", "\n\n \n", "junk\nv 1 2\n" + GRAPHS + "\nt short\nv 1 4\n", GRAPHS, ITEMSETS, "1 " * 9000 + "\n" + "1 2\n" * 50 + "2 1"]
    made += ["".join(rng.choice(["t # 1", "v 0 1", "e 0 1", "7 1", "7 2 1 é", "", " "]) + rng.choice(["\n", "\r\n"]) for _ in range(30)) for _ in range(40)]
    for content in made:
        for size in (1, 2, 3, 7, 50, 1 << 20) if len(content) < 1000 else (999, 20000):
            assert by_ranges(content, layout, size) == plain(content, layout), (content, size)


@pytest.mark.parametrize("split", [3, 40, 1 << 20])
def test_graphs_as_the_text_source_reads_them(spark, tmp_path, split):
    for name in "abc":
        (tmp_path / name).write_text(GRAPHS)
    (tmp_path / "_hidden").write_text("t # 9\n")
    (tmp_path / "empty").write_text("")
    rows = lambda blocks: sorted(map(tuple, text.parse_graph_blocks(blocks).select("gid", "graph_id", F.size("vertices"), F.to_json("edges.lu"), F.to_json("edges.lv")).collect()))
    assert rows(files.graph_blocks(spark, str(tmp_path), split)) == rows(text.read_graph_blocks(spark, str(tmp_path)))


def test_stray_lines_raise_and_graphs_are_mined(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a").write_text("t # 0\nv 0 1\nv 1 2\ne 0 1 5\n" * 2)
    found = framework.run(graphs.Subgraphs(), files.graph_blocks(spark, str(tmp_path / "g"), 5), 0.5).collect()
    assert [(r["pattern"], r["support"]) for r in found] == [("0 1 1 5 2", 2)]
    (tmp_path / "other").write_text("t # 0\nv 0 1\nt short\ntotal 2\nv 1 2\ne 0 1 5\n")  # such lines open no graph and end none
    assert [r["edges"][0][:6] for r in text.parse_graph_blocks(files.graph_blocks(spark, str(tmp_path / "other"), 4)).collect()] == [(0, 1, 5, 5, 1, 2)]
    (tmp_path / "stray").write_text("v 0 1\nt # 0\nv 0 1\n")
    with pytest.raises(Exception, match="before its t line"):
        text.parse_graph_blocks(files.graph_blocks(spark, str(tmp_path / "stray"), 4)).collect()


def test_graphs_without_numbers_are_read_once(spark, tmp_path):
    """Where gid is not used, no join, no shuffle and no written copy; small ranges in a row are one task's work."""
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a").write_text(GRAPHS)
    for blocks in (files.graph_blocks(spark, str(tmp_path / "g"), 3), text.read_graph_blocks(spark, str(tmp_path / "g"))):
        parsed = text.parse_graph_blocks(blocks).select("graph_id", "edges")
        plan = parsed._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan and "parquet" not in plan
        assert sorted(r["graph_id"] for r in parsed.collect()) == [0, 0, 7]
    parts = files._parts([("a", 10 << 20), ("b", 5)], 1 << 18)
    assert len(parts) == 3 and [r for p in parts for r in p.ranges] == [("a", s, s + (1 << 18)) for s in range(0, 10 << 20, 1 << 18)] + [("b", 0, 5)]


def test_itemsets(spark, tmp_path):
    (tmp_path / "a").write_text(ITEMSETS)
    (tmp_path / "b").write_text("1 0 1 4\n")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(files.itemset_sequences(spark, str(tmp_path), split_bytes=6)) == rows(text.read_itemset_sequences(spark, str(tmp_path)))
    assert sorted(r["value"] for r in files.read_records(spark, str(tmp_path / "a"), "itemset", 5).collect()) == ["1 1 2 5 6\n1 2 1 7", "1 3 1 8", "2 1 1 5\n 2 2 1 6", "3 1 1 9"]


def test_written_files_roll_and_come_back(spark, tmp_path):
    path = tmp_path / "out"
    lines = spark.range(500).select(F.when(F.col("id") != 3, F.concat(F.lit("t # "), F.col("id"), F.lit("\nv 0 é"))).alias("value")).repartition(3)
    files.write_records(lines, f"file://{path}", roll_bytes=200, mode="overwrite")
    sizes = [p.stat().st_size for p in path.iterdir()]
    assert len(sizes) > 20 and max(sizes) < 200 + 20 and all(p.name.startswith("part-") for p in path.iterdir())
    wanted = sorted(r["value"] for r in lines.where("value is not null").collect())
    assert sorted(r["value"] for r in files.read_records(spark, str(path), "graph", 64).collect()) == wanted
    files.write_records(lines.limit(1), str(path))
    files.write_records(lines.where("value like '% 7\n%'"), str(path), mode="overwrite")
    assert [r["value"] for r in files.read_records(spark, str(path), "graph").collect()] == ["t # 7\nv 0 é"]


def test_failed_tasks_leave_nothing(spark, tmp_path):
    path = tmp_path / "out"
    files.write_records(spark.createDataFrame([("a",)], "value string"), str(path))
    bad = spark.range(20).select(F.when(F.col("id") == 19, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("value"))
    with pytest.raises(Exception, match="no"):
        files.write_records(bad, str(path), mode="overwrite")
    assert [p.read_text() for p in path.rglob("*") if p.is_file()] == ["a\n"]
    assert Path(path).is_dir()


def test_options_are_checked(spark, tmp_path):
    (tmp_path / "a").write_text("x\n")
    for broken in (lambda: files.read_records(spark, str(tmp_path / "none"), "line"), lambda: files.read_records(spark, str(tmp_path), "tree"), lambda: files.read_records(spark, str(tmp_path), "line", 0)):
        with pytest.raises(Exception):
            broken().collect()
    with pytest.raises(Exception, match="one column"):
        files.write_records(spark.range(1), str(tmp_path / "b"))
