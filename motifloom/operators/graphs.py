"""Frequent connected subgraphs of labelled graph transactions, undirected or directed.

Edges come as rows (gid, u, v, lu, lv, el): vertex ids, vertex labels and edge label, in one direction or both. The state
of the level loop is one row for each embedding of a code in a graph: the vertices that the code's vertices are mapped to
and the edges used. A code grows along its right-most path only. What the growth of a code may look like (where edges
start, which labels they may have, by the bounds of gSpan, Yan and Han, 2002) depends on the code alone, so it is worked
out once a code and joined by its number.

Growth has two phases. First it is found in which graphs a code may grow by an edge: embeddings meet summaries of their
path's vertices, of the neighbours behind each pair of edge and vertex label just so many that one of them is outside any
embedding of this size, or else all. So a vertex with very many edges gives a few rows for each pair of labels, not one for
each edge. Edges that close a cycle meet both of their ends in an equi-join. Then only the
embeddings of codes that are frequent and canonical are built, by an equi-join on vertex and labels, and none for the last
level. Support counts graphs, not embeddings; codes that are not canonical are dropped, so a pattern is found once.

Graphs of up to LONG edges need no embeddings outside a task: they are gathered, a row each, those that are equal but for the
names of their vertices become one row with their number, and every level is a pass over these
(functions/embeddings.py) that gives a row for each code, edge and task. What is said above holds for larger graphs.

Of directed edges u is the source. A code may walk them either way, and the label that it has for an edge says which: twice
the label, plus 1 against the edge's direction. Codes and their order are otherwise those of undirected graphs.

Patterns have one edge or more. Edges of different labels between two vertices are edges of their own; exact repeats of
an edge count once, and edges from a vertex to itself are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.functions import dfscode, embeddings, render
from motifloom.operators import prune
from motifloom.plans import framework
from motifloom.plans.checkpoints import written
from motifloom.plans.framework import in_blocks, mine
from motifloom.plans.metrics import Levels
from motifloom.sources import text

#: Of one code: the place `at` from which an edge may go, whether that is the last vertex, the least label of new
#: vertices, the bound (edge label, vertex label) of forward edges, and for the last vertex the bounds of backward edges
#: by target (null where there is none).
PLACES = "array<struct<at:int,last:boolean,least:int,el:int,lv:int,back:array<struct<el:int,open:boolean>>>>"


def symmetric(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Both directions of each edge once: tran_id (the graph), u, v, lu, lv, el (of a directed edge with the direction), and further

    eid, which both directions share; beside, whether there are other edges between the two; place, the number (from 1) of
    the neighbour among those that u has by an edge of this label to a vertex of this label.
    """
    ends = lambda n, label: F.struct(F.col(n).alias("n"), F.col(label).cast("int").alias("l"))
    u, v, el = ends("u", "lu"), ends("v", "lv"), F.col("el").cast("int")
    el = 2 * el + (u > v).cast("int") if directed else el
    e = edges.where(F.col("u") != F.col("v")).select(F.col("gid").alias("tran_id"), F.least(u, v).alias("a"), F.greatest(u, v).alias("b"), el.alias("el"))
    pairs = e.groupBy("tran_id", "a", "b").agg(F.collect_set("el").alias("els"))
    one = pairs.select("tran_id", "a", "b", (F.size("els") > 1).alias("beside"), F.explode("els").alias("el"))
    one = one.withColumn("eid", F.xxhash64("a.n", "b.n", "el"))
    way = lambda x, y, label: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), label.alias("el"))
    both = one.select("tran_id", F.explode(F.array(way("a", "b", F.col("el")), way("b", "a", _turned(F.col("el"), directed)))).alias("w"), "eid", "beside")
    both = both.select("tran_id", F.col("w.x.n").alias("u"), F.col("w.y.n").alias("v"), F.col("w.x.l").alias("lu"), F.col("w.y.l").alias("lv"), "w.el", "eid", "beside")
    return both.withColumn("place", F.row_number().over(Window.partitionBy("tran_id", "u", "el", "lv").orderBy("v")))


def _turned(el: Column, directed: bool) -> Column:
    """The label of an edge as it is walked the other way."""
    return el.bitwiseXOR(F.lit(1)) if directed else el


def _edge(f: Column, t: Column, lf: Column, le: Column, lt: Column) -> Column:
    return F.struct(*(c.cast("int").alias(n) for c, n in ((f, "f"), (t, "t"), (lf, "lf"), (le, "le"), (lt, "lt"))))


def growth_places(code: list[dfscode.Edge]) -> list[dict]:
    """Where a code may grow, in the form of PLACES.

    From the last vertex a forward edge may have any labels; from an earlier vertex of the path it must not be less than
    the path's edge there. A backward edge must not be less than the path's edge at its target.
    """
    labels, path = dfscode.labels(code), dfscode.rightmost_path(code)
    last = path[-1]
    forward = {t: (f, le) for f, t, _, le, _ in code if f < t}
    back: list[dict | None] = [None] * len(labels)
    places = []
    for at, after in zip(path, path[1:], strict=False):
        el = forward[after][1]
        back[at] = {"el": el, "open": labels[after] <= labels[last]}
        places.append({"at": at, "last": False, "least": labels[0], "el": el, "lv": labels[after], "back": None})
    return [*places, {"at": last, "last": True, "least": labels[0], "el": None, "lv": None, "back": back}]


def _codes(column: pa.Array) -> Iterator[list[dfscode.Edge]]:
    return ([(e["f"], e["t"], e["lf"], e["le"], e["lt"]) for e in code] for code in column.to_pylist())


class Subgraphs:
    """The gSpan miner over edges (gid, u, v, lu, lv, el), or over symmetric ones (tran_id, u, v, lu, lv, el, eid). A delta is a code edge.

    For run(), a source is frames of graph blocks (text.read_graph_blocks): graphs are parsed, equal ones merged, counted, edges
    of infrequent label triples pruned, then mined. No graph is shuffled but the different ones of each task.
    """

    one_each = True  # of candidates()

    def __init__(self, directed: bool = False):
        self.directed = directed

    def parse(self, blocks: DataFrame) -> DataFrame:
        """(rows, own, n) of the graphs of the blocks."""
        return self._merged(text.labelled_graphs(text.parse_graph_blocks(blocks)).select(F.col("edges").alias("rows")))

    def counted(self, records: DataFrame) -> int:
        return records.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def items(self, records: DataFrame) -> DataFrame:
        triple = lambda e: F.struct(F.least(e["lu"], e["lv"]).alias("from_label"), F.greatest(e["lu"], e["lv"]).alias("to_label"), e["el"].alias("edge_label"))
        each = records.select("n", F.explode(F.array_distinct(F.transform("rows", triple))).alias("t"))
        return each.groupBy("t").agg(F.sum("n").alias("support")).select("t.*", "support")

    def encode(self, records: DataFrame, frequent: DataFrame) -> DataFrame:
        """Records as they are: of gathered graphs tasks leave infrequent edges out, of large ones split() does."""
        self.frequent = frequent
        return records

    def _merged(self, graphs: DataFrame) -> DataFrame:
        """(rows, own, n): equal graphs as one row, merged in each task and then in all; own is a number of each graph that is too large for it."""
        tasks = graphs.mapInArrow(embeddings.merged(self.directed, framework.LONG), f"rows {_ROWS}, own long, n long")
        # few rows may hold much work: they are dealt to all tasks of the levels
        return tasks.groupBy("rows", "own").agg(F.sum("n").alias("n")).repartition(int(graphs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def split(self, edges: DataFrame) -> tuple[DataFrame, DataFrame | None] | None:
        """Graphs as rows, and the symmetric edges of those that are too large for one."""
        if "rows" in edges.columns:
            large = edges.where("own is not null").select(F.col("own").alias("gid"), F.explode("rows").alias("e")).select("gid", "e.*")
            large = None if large.isEmpty() else prune.prune_edges(large, self.frequent)
            return edges.where("own is null").select("rows", "n"), None if large is None else written(symmetric(large, self.directed))
        if "gid" not in edges.columns:
            return None
        edge = F.struct("u", "v", *(F.col(c).cast("int").alias(c) for c in ("lu", "lv", "el")))
        edges = edges.where(F.col("u") != F.col("v"))
        graphs, large = in_blocks(edges, "gid", F.collect_list(edge), F.lit(False), lambda records: self._merged(records).select("rows", "n"))
        return graphs, None if large is None else written(symmetric(large, self.directed))

    def delta_type(self, graphs: DataFrame) -> str:
        return "struct<f:int,t:int,lf:int,le:int,lt:int>"

    def tally(self, patterns: list[tuple], size: int, first: list | None):
        """For mapInArrow over graphs."""
        directed = self.directed
        codes = [(number, [tuple(e) for e in code]) for number, code in patterns]
        triples = None if first is None else {tuple(code[0])[2:] for code in first}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = embeddings.Counts()
            tree = embeddings.tree_of((n, code, growth_places(code)) for n, code in codes)
            for batch in batches:
                block = embeddings.Block(batch.column(0), directed, batch.column(1).to_numpy())
                if not size:
                    for edge, n in block.begun():
                        counts.add((0, *edge), n)
                else:
                    if triples is not None:
                        block.only(triples)
                    embeddings.counted(block, tree, size, counts)
                if len(counts.n) >= _FLUSHED:
                    yield _deltas(counts)
                    counts = embeddings.Counts()
            if counts.n:
                yield _deltas(counts)

        return run

    def start(self, delta: Column) -> Column:
        return F.array(delta)

    def grow(self, pattern: Column, delta: Column) -> Column:
        return F.concat(pattern, F.array(delta))

    def _begins(self) -> Column:
        """Whether an edge of db stands in the direction in which a least code walks its first edge, or in both."""
        lower = F.col("lu") < F.col("lv")
        return lower | ((F.col("lu") == F.col("lv")) & (F.col("el") <= _turned(F.col("el"), self.directed)))

    def candidates(self, projected: DataFrame | None, db: DataFrame, size: int) -> DataFrame:
        """The edges by which each code may grow in each graph."""
        if projected is None:
            edge = _edge(F.lit(0), F.lit(1), F.col("lu"), F.col("el"), F.col("lv"))
            return db.where(self._begins()).select(F.lit(0).cast("long").alias("pid"), edge.alias("delta"), F.col("tran_id")).distinct()
        p = projected.select("pid", F.col("tran_id").alias("gid"), "vertices", "used", F.explode("places").alias("s"))
        p = p.withColumn("u", F.element_at("vertices", F.col("s.at") + 1))
        # of at most size + 1 vertices `size` are not u, so of size + 1 neighbours one is new
        near = db.where(F.col("place") <= size + 1).select(F.col("tran_id").alias("gid"), "u", "v", "el", "lv")
        bound = F.col("s.last") | (F.col("s.el") < F.col("el")) | ((F.col("s.el") == F.col("el")) & (F.col("s.lv") <= F.col("lv")))
        made = _edge(F.col("s.at"), F.size("vertices"), F.lit(-1), F.col("el"), F.col("lv"))
        forward = p.join(near, ["gid", "u"]).where((F.col("lv") >= F.col("s.least")) & bound & ~F.array_contains("vertices", F.col("v"))).select("pid", made.alias("delta"), "gid")
        closing = p.where("s.last").select("pid", "gid", "u", "used", "s.at", F.posexplode("s.back").alias("target", "b"), "vertices").where(F.col("b").isNotNull())
        closing = closing.withColumn("v", F.element_at("vertices", F.col("target") + 1)).drop("vertices")
        made = _edge(F.col("at"), F.col("target"), F.lit(-1), F.col("el"), F.lit(-1))
        # a cycle of two edges are edges beside each other
        backward = closing.join((db.where("beside") if size == 1 else db).select(F.col("tran_id").alias("gid"), "u", "v", "el", "eid"), ["gid", "u", "v"])
        back = _turned(F.col("el"), self.directed)  # from the target, where the path's own edge goes from
        backward = backward.where(((F.col("b.el") < back) | ((F.col("b.el") == back) & F.col("b.open"))) & ~F.array_contains("used", F.col("eid"))).select("pid", made.alias("delta"), "gid")
        return forward.unionByName(backward).distinct().withColumnRenamed("gid", "tran_id")

    def embed(self, projected: DataFrame | None, chosen: DataFrame, db: DataFrame) -> DataFrame:
        """The embeddings of chosen codes."""
        chosen = chosen.select("pid", "number", F.col("delta").alias("d"))
        if projected is None:
            met = db.where(self._begins()).join(chosen, (F.col("lu") == F.col("d.lf")) & (F.col("el") == F.col("d.le")) & (F.col("lv") == F.col("d.lt")))
            return met.select(F.col("number").alias("pid"), "tran_id", F.array("u", "v").alias("vertices"), F.array("eid").alias("used"))
        p = projected.select("pid", F.col("tran_id").alias("gid"), "vertices", "used").join(chosen, "pid").withColumn("from", F.element_at("vertices", F.col("d.f") + 1))
        is_new = F.col("d.f") < F.col("d.t")
        same = (F.col("gid") == F.col("tran_id")) & (F.col("from") == F.col("u")) & (F.col("d.le") == F.col("el"))
        used = F.concat("used", F.array("eid")).alias("used")
        forward = p.where(is_new).join(db, same & (F.col("d.lt") == F.col("lv"))).where(~F.array_contains("vertices", F.col("v")))
        forward = forward.select(F.col("number").alias("pid"), "tran_id", F.concat("vertices", F.array("v")).alias("vertices"), used)
        closing = p.where(~is_new).withColumn("to", F.element_at("vertices", F.col("d.t") + 1))
        backward = closing.join(db, same & (F.col("to") == F.col("v"))).where(~F.array_contains("used", F.col("eid")))
        return forward.unionByName(backward.select(F.col("number").alias("pid"), "tran_id", "vertices", used))

    def annotate(self, patterns: DataFrame) -> DataFrame:
        """The places of each pattern, once a pattern."""

        @F.arrow_udf(PLACES)
        def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([growth_places(code) for code in _codes(batch)], _PLACES)

        return patterns.withColumn("places", places(F.col("pattern")))

    def canonical(self, pattern: Column) -> Column:
        """Tests the distinct codes of a level, not their embeddings."""

        directed = self.directed

        @F.arrow_udf("boolean")
        def least(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([dfscode.is_least(code, directed) for code in _codes(batch)], pa.bool_())

        return least(pattern)

    def render(self, pattern: Column) -> Column:
        return render.dfs_code(pattern, self.directed)


#: Counts that a task holds, about.
_FLUSHED = 1 << 18

_ROWS = "array<struct<u:int,v:int,lu:int,lv:int,el:int>>"


def _deltas(counts: embeddings.Counts) -> pa.RecordBatch:
    pid, f, t, le, lt = (pa.array(c) for c in ([k[0] for k in counts.n], [k[1] for k in counts.n], [k[2] for k in counts.n], [k[-2] for k in counts.n], [k[-1] for k in counts.n]))
    lf = pa.array([k[3] if len(k) == 6 else -1 for k in counts.n])
    delta = pa.StructArray.from_arrays([x.cast(pa.int32()) for x in (f, t, lf, le, lt)], ["f", "t", "lf", "le", "lt"])
    return pa.RecordBatch.from_arrays([pid.cast(pa.int64()), delta, pa.array(list(counts.n.values()), pa.int64())], ["pid", "delta", "support"])


_PLACES = pa.list_(pa.struct([
    ("at", pa.int32()), ("last", pa.bool_()), ("least", pa.int32()), ("el", pa.int32()), ("lv", pa.int32()),
    ("back", pa.list_(pa.struct([("el", pa.int32()), ("open", pa.bool_())]))),
]))


def frequent_subgraphs(edges: DataFrame, n_graphs: int, threshold: float, max_edges: int | None = None, directed: bool = False, levels: Levels | None = None) -> DataFrame:
    """(pattern, size, support): size in edges, pattern as its least DFS code. n_graphs counts graphs without edges too.

    Edges whose label triple is infrequent go with the first level. Directed edges go from u to v; in a pattern the label
    of one is followed by > if the code walks it so, by < if it walks against it.
    """
    return mine(Subgraphs(directed), edges, n_graphs, threshold, max_edges, levels=levels)
