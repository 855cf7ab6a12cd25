"""Subgraph mining against hand-made cases and brute force."""

import itertools
import random

import pytest

from motifloom.functions import dfscode
from motifloom.operators import graphs, prune
from motifloom.plans import framework
from motifloom.sources import text

FOUR = """t # 0
v 0 0
v 1 0
v 2 0
e 0 1 0
e 1 2 0
e 0 2 0
t # 1
v 0 0
v 1 0
v 2 0
e 0 1 0
e 1 2 0
t # 2
v 0 1
v 1 2
v 2 1
e 0 1 0
e 1 2 0
t # 3
v 0 0
v 1 0
v 2 0
e 0 1 1
e 1 2 0
t # -1
"""
EXPECTED = {
    "0 1 0 0 0": 3,
    "0 1 0 1 0": 1,
    "0 1 1 0 2": 1,
    "0 1 0 0 0 , 1 2 -1 0 0": 2,
    "0 1 0 0 0 , 1 2 -1 1 0": 1,
    "0 1 1 0 2 , 1 2 -1 0 1": 1,
    "0 1 0 0 0 , 1 2 -1 0 0 , 2 0 -1 0 -1": 1,
}


def mined(spark, content, threshold, tmp_path, **options):
    path = tmp_path / "graphs.txt"
    path.write_text(content)
    ids, vertices, edges = text.read_graphs(spark, str(path))
    found = graphs.frequent_subgraphs(text.labelled_edges(vertices, edges), ids.count(), threshold, **options).collect()
    assert len({r["pattern"] for r in found}) == len(found)
    return {r["pattern"]: r["support"] for r in found}


def one(n):
    """The n-th graph alone."""
    return "t # " + FOUR.split("t # ")[n + 1]


def test_four_graphs(spark, tmp_path):
    assert mined(spark, FOUR, 0.25, tmp_path) == EXPECTED
    assert mined(spark, FOUR, 0.5, tmp_path) == {p: n for p, n in EXPECTED.items() if n >= 2}
    assert set(mined(spark, FOUR, 0.25, tmp_path, max_edges=1)) == {p for p in EXPECTED if "," not in p}


def test_single_graphs(spark, tmp_path):
    assert mined(spark, one(2), 1.0, tmp_path) == {"0 1 1 0 2": 1, "0 1 1 0 2 , 1 2 -1 0 1": 1}
    assert len(mined(spark, one(3), 1.0, tmp_path)) == 3
    assert mined(spark, one(0) + "e 0 1 0\n", 1.0, tmp_path) == mined(spark, one(0), 1.0, tmp_path)


def test_files_are_split_at_graphs(spark, tmp_path):
    """Graphs count wherever they stand, also after an end marker; however the files are split, the tables are the same."""
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "part_0000").write_text(FOUR + "t # 9\nv 0 1\n")
    (tmp_path / "g" / "part_0001").write_text(FOUR.replace("t # ", "t # 1").replace("t # 1-1", "t # -1").replace("\n", "\r\n"))
    ids, vertices, edges = text.read_graphs(spark, str(tmp_path / "g"))
    assert sorted(r[0] for r in ids.collect()) == [0, 1, 2, 3, 9, 10, 11, 12, 13]
    assert vertices.count() == 25 and edges.count() == 18
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        again = text.read_graphs(spark, str(tmp_path / "g"))
        for one, two in zip((ids, vertices, edges), again, strict=True):
            assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_run_from_files(spark, tmp_path):
    """Parsing, counting, pruning and mining on the framework; graphs without edges count in N."""
    (tmp_path / "g.txt").write_text(FOUR.replace("t # -1", "t # 7\nv 0 0"))
    blocks = text.read_graph_blocks(spark, str(tmp_path / "g.txt"))
    found = framework.run(graphs.Subgraphs(), blocks, 0.2)
    assert {r["pattern"]: r["support"] for r in found.collect()} == EXPECTED
    found = framework.run(graphs.Subgraphs(), blocks, 0.6)
    assert {r["pattern"]: r["support"] for r in found.collect()} == {"0 1 0 0 0": 3}


def test_edge_before_its_vertices(spark, tmp_path):
    with pytest.raises(Exception, match="edge before its vertices"):
        mined(spark, "t # 0\nv 0 1\ne 0 1 1\nv 1 1\n", 1.0, tmp_path)


def test_pruning_is_symmetric(spark):
    edges = spark.createDataFrame([(0, 1, 2, 5, 3, 7), (1, 1, 2, 3, 5, 7), (2, 1, 2, 3, 4, 7)], "gid int, u int, v int, lu int, lv int, el int")
    supports = prune.label_edge_support(edges)
    assert {(r["from_label"], r["to_label"], r["support"]) for r in supports.collect()} == {(3, 5, 2), (3, 4, 1)}
    assert {r["gid"] for r in prune.prune_edges(edges, supports.where("support > 1")).collect()} == {0, 1}


def all_codes(labels, edges):
    """Every DFS code of a graph, by walking it in all ways: no bounds, no pruning."""

    def walk(order, used, code, parent):
        if len(used) == len(edges):
            yield tuple(code)
            return
        last = len(order) - 1
        path = [last]
        while path[-1]:
            path.append(parent[path[-1]])
        place = {v: i for i, v in enumerate(order)}
        for i, (a, b, el) in enumerate(edges):
            if i in used:
                continue
            for u, v in ((a, b), (b, a)):
                if u not in place or place[u] not in path:
                    continue
                if v in place:
                    if place[u] == last and place[v] in path:
                        yield from walk(order, used | {i}, [*code, (last, place[v], -1, el, -1)], parent)
                else:
                    yield from walk([*order, v], used | {i}, [*code, (place[u], last + 1, -1, el, labels[v])], parent | {last + 1: place[u]})

    for i, (a, b, el) in enumerate(edges):
        for u, v in ((a, b), (b, a)):
            yield from walk([u, v], {i}, [(0, 1, labels[u], el, labels[v])], {1: 0})


def least_by_walking(labels, edges):
    """The least of all codes: backward edges before forward ones, by target; forward ones from the deepest source."""
    order = lambda e: (0, e[1], e[3], 0) if e[1] < e[0] else (1, -e[0], e[3], e[4])
    first = lambda e: (e[2], e[3], e[4])
    return min(all_codes(labels, edges), key=lambda code: (first(code[0]), [order(e) for e in code[1:]]))


def connected_subsets(edges, most):
    for n in range(1, most + 1):
        for subset in itertools.combinations(edges, n):
            reach, rest = set(subset[0][:2]), list(subset[1:])
            while True:
                hit = [e for e in rest if reach & set(e[:2])]
                if not hit:
                    break
                for e in hit:
                    reach |= set(e[:2])
                    rest.remove(e)
            if not rest:
                yield subset


def random_graphs(seed, n, size):
    rng = random.Random(seed)
    for gid in range(n):
        labels = {v: rng.randint(0, 1) for v in range(size)}
        pairs = [p for p in itertools.combinations(range(size), 2) if rng.random() < 0.6]
        edges = sorted({(u, v, rng.randint(0, 1)) for u, v in pairs} | {(u, v, rng.randint(0, 1)) for u, v in pairs[:1]})
        yield gid, labels, edges


def test_brute_force(spark):
    rows, groups = [], {}
    for gid, labels, edges in random_graphs(7, 6, 5):
        rows += [(gid, u, v, labels[u], labels[v], el) for u, v, el in edges]
        for subset in connected_subsets(edges, 4):
            used = {v for e in subset for v in e[:2]}
            code = least_by_walking({v: labels[v] for v in used}, subset)
            groups.setdefault(" , ".join(" ".join(map(str, e)) for e in code), set()).add(gid)
    df = spark.createDataFrame(rows, "gid int, u int, v int, lu int, lv int, el int")
    for need in (0.5, 0.8):
        found = graphs.frequent_subgraphs(df, 6, need, max_edges=4).collect()
        assert len({r["pattern"] for r in found}) == len(found)
        assert {r["pattern"]: (r["size"], r["support"]) for r in found} == {c: (c.count(",") + 1, len(g)) for c, g in groups.items() if len(g) >= 6 * need}
        assert any(" 1 0 -1" in r["pattern"] for r in found) or need > 0.5  # edges beside each other


def test_least_code_is_canonical():
    for gid, labels, edges in random_graphs(11, 20, 5):
        for subset in itertools.islice(connected_subsets(edges, 5), 40):
            used = sorted({v for e in subset for v in e[:2]})
            codes = set()
            for seed in range(4):
                names = used[:]
                random.Random(seed).shuffle(names)
                renamed = dict(zip(used, names, strict=True))
                codes.add(tuple(dfscode.least_code({renamed[v]: labels[v] for v in used}, [(renamed[u], renamed[v], el) for u, v, el in subset])))
            assert len(codes) == 1
            assert dfscode.is_least(list(codes.pop()))


def class_of(labels, edges):
    """A name of a directed graph up to isomorphism: the least of all ways to number its vertices."""
    used = sorted({v for e in edges for v in e[:2]})
    names = []
    for order in itertools.permutations(range(len(used))):
        place = dict(zip(used, order, strict=True))
        names.append((sorted((place[v], labels[v]) for v in used), sorted((place[u], place[v], el) for u, v, el in edges)))
    return repr(min(names))


def drawn(pattern):
    """Labels and directed edges of a rendered code."""
    labels, edges = {}, []
    for e in pattern.split(" , "):
        f, t, lf, le, lt = e.split()
        f, t = int(f), int(t)
        for v, label in ((f, lf), (t, lt)):
            if label != "-1":
                labels[v] = int(label)
        edges.append((f, t, int(le[:-1])) if le[-1] == ">" else (t, f, int(le[:-1])))
    return labels, edges


def test_directed_brute_force(spark):
    """Edges both ways between two vertices, with equal labels too, are edges of their own."""
    rng = random.Random(3)
    rows, groups = [], {}
    for gid in range(5):
        labels = {v: rng.randint(0, 1) for v in range(4)}
        edges = sorted({(u, v, rng.randint(0, 1)) for u in range(4) for v in range(4) if u != v and rng.random() < 0.55})
        rows += [(gid, u, v, labels[u], labels[v], el) for u, v, el in edges]
        for subset in connected_subsets(edges, 4):
            groups.setdefault(class_of(labels, subset), set()).add(gid)
    df = spark.createDataFrame(rows, "gid int, u int, v int, lu int, lv int, el int")
    found = graphs.frequent_subgraphs(df.unionByName(df), 5, 0.4, max_edges=4, directed=True).collect()
    got = {class_of(*drawn(r["pattern"])): r["support"] for r in found}
    assert len(got) == len(found)
    assert got == {c: len(g) for c, g in groups.items() if len(g) >= 2}
    assert any(" 1 0 -1" in r["pattern"] for r in found)


@pytest.mark.parametrize("long", [4096, 9, 0])
@pytest.mark.parametrize("directed", [False, True])
def test_graphs_in_blocks_and_by_rows(spark, long, directed, monkeypatch):
    """Graphs that are gathered and graphs that are not give the same patterns, also when slices are smaller than a graph's embeddings."""
    from motifloom.functions import embeddings

    monkeypatch.setattr(framework, "LONG", long)
    rows = [(gid, u, v, labels[u], labels[v], el) for gid, labels, edges in random_graphs(5, 8, 5) for u, v, el in edges]
    df = spark.createDataFrame(rows, "gid int, u int, v int, lu int, lv int, el int")
    symmetric = graphs.symmetric(df, directed)
    expected = {(r["pattern"], r["support"]) for r in framework.mine(graphs.Subgraphs(directed), symmetric, 8, 0.6, 3).collect()}
    assert expected == {(r["pattern"], r["support"]) for r in graphs.frequent_subgraphs(df, 8, 0.6, max_edges=3, directed=directed).collect()}
    edges = df.groupBy("gid").agg(graphs.F.collect_list(graphs.F.struct("u", "v", "lu", "lv", "el")).alias("e")).toArrow()["e"]
    block = embeddings.Block(edges, directed)
    codes = [[e, (1, 2, -1, int(el), int(lv))] for e, _ in block.begun() for el in block.edge_labels for lv in block.vertex_labels]
    tree, found = embeddings.tree_of((i, c, graphs.growth_places(c)) for i, c in enumerate(codes)), []
    for held in (1 << 20, 60, 1):
        counts = embeddings.Counts()
        embeddings.counted(block, tree, 2, counts, held)
        found.append(counts.n)
    assert found[0] and found[0] == found[1] == found[2]


@pytest.mark.parametrize("directed", [False, True])
def test_equal_graphs_are_one_row(directed):
    """However vertices are named and edges are listed; what differs stays apart, large graphs stay as they are."""
    import pyarrow as pa

    from motifloom.functions import embeddings

    kind = pa.list_(pa.struct([(c, pa.string() if c in "uv" else pa.int32()) for c in ("u", "v", "lu", "lv", "el")]))
    rng = random.Random(4)
    made = []
    for _, labels, edges in random_graphs(12, 6, 5):
        edges = [e for e in edges if e[0] != e[1]]
        for _ in range(20):
            name = dict(zip(labels, rng.sample(range(100), len(labels)), strict=True))
            listed = [(u, v, el) if directed or rng.random() < 0.5 else (v, u, el) for u, v, el in rng.sample(edges, len(edges))]
            made.append([{"u": f"x{name[u]}", "v": f"x{name[v]}", "lu": labels[u], "lv": labels[v], "el": el} for u, v, el in listed])
    made += [[], None]
    batch = pa.RecordBatch.from_arrays([pa.array(made, kind)], ["rows"])
    rows = [r for out in embeddings.merged(directed, 4096)(iter([batch, batch])) for r in out.to_pylist()]
    assert sum(r["n"] for r in rows) == 2 * len(made) and len(rows) < len(made) / 4
    assert all(r["own"] is None for r in rows)
    for r in rows:  # vertices are numbered from 0
        ends = {e[c] for e in r["rows"] for c in "uv"}
        assert ends == set(range(len(ends)))
    large = [r for out in embeddings.merged(directed, 0)(iter([batch])) for r in out.to_pylist()]
    assert sum(r["own"] is not None for r in large) == sum(bool(g) for g in made) == len({r["own"] for r in large} - {None})


def test_equal_leaves_are_built_in_one_order():
    """Of three equal neighbours of seven 35 embeddings, not 210; the counts are those of graphs, each with its number."""
    import numpy as np
    import pyarrow as pa

    from motifloom.functions import embeddings

    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("u", "v", "lu", "lv", "el")]))
    star = [{"u": 0, "v": v, "lu": 5, "lv": 6, "el": 1} for v in range(1, 8)]
    block = embeddings.Block(pa.array([star, star[:3]], kind), False, np.array([10, 100]))
    assert list(block.begun()) == [((0, 1, 5, 1, 6), 110)]
    code = [(0, 1, 5, 1, 6), (0, 2, -1, 1, 6), (0, 3, -1, 1, 6)]
    vertices, used = block.first(code[0])
    for before, edge in itertools.pairwise(code):
        vertices, used = block.longer(block.near(), vertices, used, edge, before)
    assert len(vertices) == 35 + 1
    for held in (1 << 20, 1):
        counts = embeddings.Counts()
        embeddings.counted(block, embeddings.tree_of([(7, code, graphs.growth_places(code))]), 3, counts, held)
        assert counts.n == {(7, 0, 4, 1, 6): 10}


def test_files_of_equal_graphs(spark, tmp_path, monkeypatch):
    """Patterns from files are those of the edges, also where some graphs are too large to be gathered."""
    made = list(random_graphs(9, 4, 5))
    rows, lines = [], []
    for k in range(5):
        for gid, labels, edges in made:
            edges = [(u, v, el) for u, v, el in edges if u != v]
            lines.append(f"t # {gid}\n" + "".join(f"v {v + k} {label}\n" for v, label in labels.items()) + "".join(f"e {u + k} {v + k} {el}\n" for u, v, el in edges))
            rows += [(100 * k + gid, u, v, labels[u], labels[v], el) for u, v, el in edges]
    (tmp_path / "g").write_text("".join(lines))
    df = spark.createDataFrame(rows, "gid int, u int, v int, lu int, lv int, el int")
    expected = {(r["pattern"], r["support"]) for r in graphs.frequent_subgraphs(df, 20, 0.4, max_edges=3).collect()}
    for long in (4096, 6):
        monkeypatch.setattr(framework, "LONG", long)
        miner = graphs.Subgraphs()
        records = miner.parse(text.read_graph_blocks(spark, str(tmp_path / "g"))).collect()
        assert sum(r["n"] for r in records) == 20 and (len(records) < 20 if long > 6 else any(r["own"] is not None for r in records))
        assert {(r["pattern"], r["support"]) for r in framework.run(miner, text.read_graph_blocks(spark, str(tmp_path / "g")), 0.4, 3).collect()} == expected
