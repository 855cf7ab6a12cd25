"""Text layouts of records. Paths may be files, folders of part files or patterns, in any store that Spark reads."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_item_lines(lines: DataFrame, separator: str = ",") -> DataFrame:
    """(value) -> (tran_id, items): separators in a row count as one; blank lines are no records. tran_id is unique, not consecutive."""
    kept = lines.where(F.trim("value") != "")
    items = F.filter(F.split("value", "[" + separator + "]"), lambda x: x != "")
    return kept.select(F.monotonically_increasing_id().alias("tran_id"), items.alias("items"))


def read_item_sequences(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    return parse_item_lines(spark.read.text(path), separator)


def parse_itemset_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(value) of `customer itemset_id size item ...` -> (tran_id, sequence): a customer's itemsets by itemset_id, items sorted and distinct.

    Lines may come in any order and from any file. Lines with a field that is no integer are left out, or raise if strict.
    """
    fields = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    rows = lines.where(F.trim("value") != "").select("value", fields.alias("f"))
    numbers = rows.select("value", F.transform("f", lambda x: x.try_cast("int")).alias("n"))
    bad = (F.size("n") < 3) | F.exists("n", lambda x: x.isNull())
    numbers = numbers.where(F.when(bad, F.raise_error(F.concat(F.lit("not an itemset line: "), F.col("value")))).otherwise(True)) if strict else numbers.where(~bad)
    sets = numbers.select(F.col("n")[0].alias("tran_id"), F.col("n")[1].alias("itemset_id"), F.array_sort(F.array_distinct(F.slice("n", 4, F.greatest(F.size("n") - 3, F.lit(0))))).alias("items"))
    grouped = sets.groupBy("tran_id").agg(F.array_sort(F.collect_list(F.struct("itemset_id", "items"))).alias("sets"))
    return grouped.select("tran_id", F.col("sets.items").alias("sequence"))


def read_itemset_sequences(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return parse_itemset_lines(spark.read.text(path), strict)


def read_graph_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(gid, value): the lines of one graph each, from files of `t # id`, `v id label`, `e from to label` lines.

    Each line whose first field is t, of three fields or more, opens a graph; fields are parted by any white space. gid
    numbers graphs from 0, by path and place, over all files: ids in the files need not be unique, and however files are
    split over tasks, the numbers are the same. Files are parted where a line begins with t, so a task holds one graph at
    a time; the numbers come from the counts of the splits, a row for each. Where gid is not used, files are read once.
    """
    raw = spark.read.text(path, lineSep="\nt").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    # what lineSep took away; the first piece of a file still has it
    whole = F.when(F.col("value").rlike(r"^\s") & ~F.col("value").rlike(r"^\s*t\s"), F.concat(F.lit("t"), "value")).otherwise(F.col("value"))
    opens = r"(?:^|[\r\n])(?=[ \t\x0B\f]*t[ \t\x0B\f]+[^ \t\x0B\f\r\n]+[ \t\x0B\f]+[^ \t\x0B\f\r\n])"  # such lines may also begin with blanks
    parts = raw.where(F.col("value").rlike(r"\S")).select("file", "start", F.explode(F.split(whole, opens)).alias("value"))
    parts = parts.where(F.col("value").rlike(r"\S")).select("file", "start", "value", F.monotonically_increasing_id().alias("at"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = parts.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    splits = splits.select(F.col("file").alias("f"), F.col("start").alias("s"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    splits = splits.groupBy("f", "s").agg(F.first("first").alias("first"), F.first("before").alias("before"))  # says that a split has one row: where gid is not used, nothing is joined
    met = parts.join(splits, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")), "left")
    return met.select((F.col("before") + F.col("at") - F.col("first")).cast("long").alias("gid"), "value")


_VERTICES = "array<struct<vid:int,label:int,line:int>>"
_EDGES = "array<struct<u:int,v:int,label:int,line:int,lu:int,lv:int,at:int>>"


def parse_graph_blocks(blocks: DataFrame) -> DataFrame:
    """(gid, value) -> (gid, graph_id, vertices, edges), a row for each graph; each vertex and edge with the number of its line, each edge with the labels of its ends.

    graph_id is the number in the `t` line. A graph with a negative one is an end marker and no graph, wherever it stands;
    graphs after it count as well. Of several lines of one vertex the last counts. Lines of other kinds, or too short, are
    left out; numbers that are none raise, as do vertices or edges that no `t` line stands before.
    """
    # white space and line ends become blanks and line feeds for all lines at once, where there are others; what is split at one character needs no pattern
    other = reduce(or_, (F.contains(F.col("value"), F.lit(c)) for c in "\r\t\x0b\f"))
    plain = F.when(other, F.translate(F.regexp_replace("value", r"\r\n?", "\n"), "\t\x0b\f", "   ")).otherwise(F.col("value"))
    fields = F.transform(F.split(plain, "\n"), lambda x: F.filter(F.split(x, " "), lambda f: f != ""))
    parsed = F.transform(fields, lambda f, i: F.struct(f.alias("f"), i.alias("line")))
    # a generated column: conditions on it are not pushed below, where each would parse the lines again
    rows = blocks.select("gid", F.explode(F.array(parsed)).alias("lines"))
    head = F.col("lines")[0]["f"]
    opened = (F.size(head) >= 3) & (F.get(head, F.lit(0)) == "t")
    vertex = F.filter("lines", lambda x: (F.size(x["f"]) >= 3) & (F.get(x["f"], F.lit(0)) == "v"))
    edge = F.filter("lines", lambda x: (F.size(x["f"]) >= 4) & (F.get(x["f"], F.lit(0)) == "e"))
    stray = ~opened & ((F.size(vertex) > 0) | (F.size(edge) > 0))
    rows = rows.where(F.when(stray, F.raise_error(F.concat(F.lit("lines of a graph before its t line: "), F.array_join(head, " "))).cast("boolean")).otherwise(opened))
    rows = rows.withColumn("graph_id", F.col("lines")[0]["f"][2].cast("int")).where(F.col("graph_id") >= 0)
    rows = rows.select(
        "gid", "graph_id",
        F.transform(vertex, lambda x: F.struct(x["f"][1].cast("int").alias("vid"), x["f"][2].cast("int").alias("label"), x["line"].alias("line"))).cast(_VERTICES).alias("vertices"),
        F.transform(edge, lambda x: F.struct(x["f"][1].cast("int").alias("u"), x["f"][2].cast("int").alias("v"), x["f"][3].cast("int").alias("label"), x["line"].alias("line"))).alias("edges"),
    )
    # vertices by id, of one id the last line first: the first place of an id is the vertex that counts
    rows = rows.withColumn("sorted", F.sort_array(F.transform("vertices", lambda x: F.struct(x["vid"], x["line"], x["label"])), asc=False))
    rows = rows.select("gid", "graph_id", "vertices", "edges", F.explode(F.array(F.struct("sorted", F.col("sorted.vid").alias("ids")))).alias("v"))
    end = lambda vid: F.get("v.sorted", F.array_position("v.ids", vid).cast("int") - 1)
    met = F.transform("edges", lambda e: F.struct(e.alias("e"), end(e["u"]).alias("u"), end(e["v"]).alias("v")))

    def labelled(x: Column) -> Column:
        e, u, v = x["e"], x["u"], x["v"]
        return F.struct(e["u"], e["v"], e["label"], e["line"], u["label"].alias("lu"), v["label"].alias("lv"), F.when(u.isNotNull() & v.isNotNull(), F.greatest(u["line"], v["line"])).alias("at"))

    return rows.select("gid", "graph_id", "vertices", F.transform(met, labelled).cast(_EDGES).alias("edges"))


def labelled_graphs(records: DataFrame) -> DataFrame:
    """(edges), a row for each parsed graph: its edges as (u, v, lu, lv, el). An edge that stands before its vertices raises."""
    early = F.get(F.filter("edges", lambda e: e["at"].isNull() | (e["at"] > e["line"])), F.lit(0))
    rows = records.select("graph_id", "edges", early["line"].alias("early"))
    rows = rows.where(F.when(F.col("early").isNotNull(), F.raise_error(_early(F.col("early"))).cast("boolean")).otherwise(True))
    return rows.select(F.transform("edges", lambda e: F.struct(e["u"], e["v"], e["lu"], e["lv"], e["label"].alias("el"))).alias("edges"))


def _early(line: Column) -> Column:
    return F.concat(F.lit("edge before its vertices: graph "), F.col("graph_id").cast("string"), F.lit(" line "), line.cast("string"))


def graph_tables(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graphs(graph_id, gid), vertices(graph_id, gid, vid, label, line), edges(graph_id, gid, u, v, label, line, lu, lv, at) of parsed graphs; gid names a graph."""
    vertices = records.select("graph_id", "gid", F.explode("vertices").alias("x")).select("graph_id", "gid", "x.*")
    edges = records.select("graph_id", "gid", F.explode("edges").alias("x")).select("graph_id", "gid", "x.*")
    return records.select("graph_id", "gid"), vertices, edges


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graph_tables of a path."""
    return graph_tables(parse_graph_blocks(read_graph_blocks(spark, path)))


def labelled_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(gid, u, v, lu, lv, el). Edges of graph_tables have the labels of their ends; those of other tables (graph_id, u, v, label) meet vertices (graph_id, vid, label).

    An edge of graph_tables that stands before its vertices raises.
    """
    if {"gid", "lu", "lv", "at", "line"} <= set(edges.columns):
        early = F.col("at").isNull() | (F.col("at") > F.col("line"))
        own = edges.where(F.when(early, F.raise_error(_early(F.col("line"))).cast("boolean")).otherwise(True))
        return own.select("gid", "u", "v", "lu", "lv", F.col("label").alias("el"))
    own = edges.select("graph_id", "u", "v", "label")
    for end in ("u", "v"):
        own = own.join(vertices.select("graph_id", F.col("vid").alias(end), F.col("label").alias(f"l{end}")), ["graph_id", end])
    return own.select(F.col("graph_id").alias("gid"), "u", "v", "lu", "lv", F.col("label").alias("el"))
