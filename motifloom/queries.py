"""The named queries over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifloom.functions import render
from motifloom.operators import graphs, itemsets, partitions, projection, prune, sequences, support
from motifloom.plans import framework, metrics, tree
from motifloom.plans.checkpoints import shared_folder, written
from motifloom.sources import files
from motifloom.sources import records as formats
from motifloom.sources import sinks, tables, text

PRIORITY, BRAND, TYPE, GRAPH, LINES = 0.3, 0.005, 0.85, 0.05, 0.3


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- fixtures -------------------------------------------------------------------------------------------------------


def priority_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Order priorities of each customer by (date, key)."""
    return tables.item_sequences(_table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority")


def brand_baskets(spark: SparkSession, d: str) -> DataFrame:
    """Brands of each order."""
    rows = _table(spark, d, "lineitem").join(_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return tables.baskets(rows, "l_orderkey", "p_brand")


def _type_rows(spark: SparkSession, d: str) -> DataFrame:
    lines, part, orders = (_table(spark, d, t) for t in ("lineitem", "part", "orders"))
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def type_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sets of part types of each customer's orders by (date, key)."""
    return tables.itemset_sequences(_type_rows(spark, d), "o_custkey", ["o_orderdate", "o_orderkey"], "p_type")


def order_graphs(spark: SparkSession, d: str) -> DataFrame:
    """A graph for each order: order vertex (label 0) - return flag - part (rank of its type, from 1) - 3 - supplier (1000 + region)."""
    lines, part, supplier, nation = (_table(spark, d, t) for t in ("lineitem", "part", "supplier", "nation"))
    ranks = part.select("p_type").distinct().withColumn("type_label", F.row_number().over(Window.orderBy("p_type")))
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(ranks, "p_type").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    p, s, o = (F.concat(F.lit(x), F.col(c).cast("string")) for x, c in (("p", "l_partkey"), ("s", "l_suppkey"), ("o", "l_orderkey")))
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    e = F.array(
        F.struct(o.alias("u"), p.alias("v"), F.lit(0).alias("lu"), F.col("type_label").alias("lv"), flag.alias("el")),
        F.struct(p.alias("u"), s.alias("v"), F.col("type_label").alias("lu"), (F.lit(1000) + F.col("n_regionkey")).alias("lv"), F.lit(3).alias("el")),
    )
    rows = rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "type_label", "n_regionkey").repartition("l_orderkey")  # narrow rows move, and an order's edges meet where they are made
    return rows.select(F.col("l_orderkey").alias("gid"), F.explode(e).alias("e")).select("gid", "e.*").distinct()


def _order_lines(spark: SparkSession, d: str) -> DataFrame:
    """(gid, p, s, r): of each line its order, the vertices of its part and supplier, and the supplier's label (10 + region). An order's lines are in one task."""
    lines, supplier, nation = (_table(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    rows = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select("l_orderkey", "l_partkey", "l_suppkey", "n_regionkey").repartition("l_orderkey")
    return rows.select(F.col("l_orderkey").alias("gid"), (F.col("l_partkey") * 2 + 1).alias("p"), (F.col("l_suppkey") * 2 + 2).alias("s"), (F.lit(10) + F.col("n_regionkey")).cast("int").alias("r"))


def line_graphs(spark: SparkSession, d: str) -> DataFrame:
    """A graph for each order, with a triangle for each line: order (vertex 0, label 0) - 0 - part (label 1) - 1 - supplier (10 + region) - 2 - order."""
    o, p, s, region = F.lit(0).cast("long"), F.col("p"), F.col("s"), F.col("r")
    edge = lambda u, v, lu, lv, el: F.struct(u.alias("u"), v.alias("v"), lu.cast("int").alias("lu"), lv.cast("int").alias("lv"), F.lit(el).alias("el"))
    e = F.array(edge(o, p, F.lit(0), F.lit(1), 0), edge(p, s, F.lit(1), region, 1), edge(o, s, F.lit(0), region, 2))
    return _order_lines(spark, d).select("gid", F.explode(e).alias("e")).select("gid", "e.*").distinct()


def _n_graphs(edges: DataFrame) -> int:
    """Orders with lines that meet their dimension tables: the graphs that have edges."""
    return edges.select("gid").distinct().count()


def _files(lines: DataFrame) -> str:
    """The folder of part files that the lines (value) were written to."""
    path = shared_folder(lines.sparkSession)
    lines.select("value").write.text(path)
    return path


# --- queries --------------------------------------------------------------------------------------------------------


def seq_patterns_order_priority(spark, d):
    return sequences.frequent_item_sequences(priority_sequences(spark, d), PRIORITY)


def seq_patterns_levelwise(spark, d):
    lines = priority_sequences(spark, d).select(F.array_join("items", ",").alias("value"))
    return framework.run(framework.ItemSequences(), lines, PRIORITY)


def itemset_seq_patterns_ptype(spark, d):
    return sequences.frequent_itemset_sequences(type_sequences(spark, d), TYPE)


def itemset_seq_patterns_levelwise(spark, d):
    records = written(type_sequences(spark, d))
    return framework.mine(framework.ItemsetSequences(), projection.set_events_of(records), support.record_count(records), TYPE)


def frequent_itemsets_brand(spark, d):
    return itemsets.frequent_itemsets(brand_baskets(spark, d), BRAND)


def frequent_itemsets_levelwise(spark, d):
    records = written(brand_baskets(spark, d))
    db = records.select("tran_id", F.explode("items").alias("item"))
    return framework.mine(framework.Itemsets(), db, support.record_count(records), BRAND)


def itemset_seq_patterns_bitmaps(spark, d):
    records, miner = written(type_sequences(spark, d)), framework.Bitmaps()
    return framework.mine(miner, miner.bitmaps(projection.set_events_of(records)), support.record_count(records), TYPE)


def seq_patterns_by_parts(spark, d):
    return partitions.frequent_by_parts(priority_sequences(spark, d), PRIORITY, least_parts=4)


def frequent_itemsets_by_parts(spark, d):
    return partitions.frequent_by_parts(brand_baskets(spark, d), BRAND, as_sets=True, least_parts=4)


def itemset_seq_patterns_by_parts(spark, d):
    return partitions.frequent_by_parts(type_sequences(spark, d), TYPE, least_parts=4)


def seq_patterns_finished(spark, d):
    """Patterns with up to two thirds of the rows are finished in one task each, the others grow level by level."""
    db = written(projection.events_of(priority_sequences(spark, d)))
    return framework.mine(framework.ItemSequences(), db, support.record_count(priority_sequences(spark, d)), PRIORITY, finish_below=db.count() * 2 // 3)


def itemset_seq_patterns_finished(spark, d):
    records = written(type_sequences(spark, d))
    db = written(projection.set_events_of(records))
    return framework.mine(framework.ItemsetSequences(), db, support.record_count(records), TYPE, finish_below=db.count() * 9 // 10)


def frequent_itemsets_finished(spark, d):
    records = written(brand_baskets(spark, d))
    db = written(records.select("tran_id", F.explode("items").alias("item")))
    return framework.mine(framework.Itemsets(), db, support.record_count(records), BRAND, finish_below=db.count() // 5)


def mining_levels(spark, d):
    """What each level of a run saw and kept."""
    lines = priority_sequences(spark, d).select(F.array_join("items", ",").alias("value"))
    levels = metrics.Levels()
    framework.run(framework.ItemSequences(), lines, PRIORITY, levels=levels)
    return levels.frame(spark).drop("seconds")


def seq_patterns_coded(spark, d):
    lines = priority_sequences(spark, d).select(F.array_join("items", ",").alias("value"))
    return framework.run(framework.Coded(framework.ItemSequences()), lines, PRIORITY, finish_below=framework.FINISH_BELOW)


def frequent_itemsets_coded(spark, d):
    lines = brand_baskets(spark, d).select(F.array_join("items", ",").alias("value"))
    return framework.run(framework.Coded(framework.Itemsets()), lines, BRAND, finish_below=framework.FINISH_BELOW)


def item_support(spark, d):
    return support.item_support(brand_baskets(spark, d))


def frequent_items(spark, d):
    return support.frequent_items(brand_baskets(spark, d), 0.155)


def infrequent_items(spark, d):
    return support.infrequent_items(brand_baskets(spark, d), 0.155)


def item_rank(spark, d):
    return support.item_ranks(support.item_support(brand_baskets(spark, d)))


def record_and_required_count(spark, d):
    return support.required_table(priority_sequences(spark, d), PRIORITY)


def pruned_item_sequences(spark, d):
    records = priority_sequences(spark, d)
    kept = prune.prune_item_sequences(records, support.frequent_items(records, 0.86))
    return kept.select("tran_id", render.item_sequence(F.col("items")).alias("items"))


def pruned_itemset_sequences(spark, d):
    records = type_sequences(spark, d)
    flat = records.select("tran_id", F.flatten("sequence").alias("items"))
    kept = prune.prune_itemset_sequences(records, support.frequent_items(flat, 0.98))
    return kept.select("tran_id", render.itemset_sequence(F.col("sequence")).alias("sequence"))


def seq_first_occurrence(spark, d):
    first = projection.first_occurrences(projection.events_of(priority_sequences(spark, d)))
    return first.select("tran_id", "item", (F.col("pos") + 1).cast("long").alias("pos"))


def seq_projection_step(spark, d):
    events = projection.events_of(priority_sequences(spark, d))
    one = projection.first_occurrences(events).select(F.col("item").alias("pattern"), "tran_id", "pos")
    grown = projection.sequence_step(one, events)
    return grown.groupBy("pattern", "item").agg(F.count("*").alias("support"))


def itemset_extension_step(spark, d):
    events = projection.set_events_of(type_sequences(spark, d))
    one = events.select(F.col("item").alias("pattern"), F.col("item").alias("last"), "tran_id", "pos")
    grown = projection.itemset_step(one, events)
    return grown.groupBy("pattern", "joined", "item").agg(F.countDistinct("tran_id").alias("support"))


def graph_label_edge_support(spark, d):
    return prune.label_edge_support(order_graphs(spark, d))


def graph_frequent_edges(spark, d):
    edges = order_graphs(spark, d)
    n = edges.agg(F.countDistinct("gid").alias("n")).scalar()
    return prune.label_edge_support(edges).where(F.col("support") >= n * GRAPH)


def graph_pruned_edges(spark, d):
    edges = order_graphs(spark, d)
    kept = prune.prune_edges(edges, graph_frequent_edges(spark, d))
    return kept.groupBy("gid").agg(F.count("*").alias("edges"))


def graph_patterns_2edge(spark, d):
    edges = written(order_graphs(spark, d))
    return graphs.frequent_subgraphs(edges, _n_graphs(edges), GRAPH, max_edges=2)


def graph_patterns(spark, d):
    edges = written(order_graphs(spark, d))
    return graphs.frequent_subgraphs(edges, _n_graphs(edges), 0.1)


def graph_patterns_3edge(spark, d):
    edges = written(line_graphs(spark, d))
    return graphs.frequent_subgraphs(edges, _n_graphs(edges), LINES, max_edges=3)


def directed_graph_patterns(spark, d):
    """Patterns of up to two edges of line_graphs as directed graphs: an order has lines, a part comes from a supplier, an order names suppliers."""
    edges = written(line_graphs(spark, d))
    return graphs.frequent_subgraphs(edges, _n_graphs(edges), LINES, max_edges=2, directed=True)


def _graph_lines(spark: SparkSession, d: str) -> DataFrame:
    """(value): the lines of each of line_graphs, its vertices before its edges. An order's lines are gathered once, as numbers."""
    x = F.sort_array(F.collect_set(F.struct("p", "s", "r")))
    rows = _order_lines(spark, d).groupBy("gid").agg(x.alias("x")).select("gid", "x", F.array_distinct("x.p").alias("parts"), F.array_distinct("x.s").alias("suppliers"))
    line = lambda *c: F.concat_ws(" ", *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in c))
    lines = F.concat(
        F.array(F.lit("v 0 0")),
        F.transform("parts", lambda p: line("v", p, "1")),
        F.array_distinct(F.transform("x", lambda x: line("v", x["s"], x["r"]))),
        F.transform("parts", lambda p: line("e 0", p, "0")),
        F.transform("x", lambda x: line("e", x["p"], x["s"], "1")),
        F.transform("suppliers", lambda s: line("e 0", s, "2")),
    )
    return rows.select(F.concat(F.lit("t # "), F.col("gid").cast("string"), F.lit("\n"), F.array_join(lines, "\n")).alias("value"))


def graph_file_patterns(spark, d):
    """The same graphs through files: blocks of lines written, read back, parsed, counted, pruned and mined to the end."""
    path = _files(_graph_lines(spark, d))
    return framework.run(graphs.Subgraphs(), text.read_graph_blocks(spark, path), LINES)


def graph_source_edges(spark, d):
    """The same graphs through the data source: files that roll at a megabyte, ranges of a quarter of one that cut graphs."""
    path = shared_folder(spark)
    files.write_records(_graph_lines(spark, d), path, roll_bytes=1 << 20)
    parsed = text.parse_graph_blocks(files.graph_blocks(spark, path, split_bytes=1 << 18))
    return parsed.select("graph_id", F.explode("edges").alias("e")).select("graph_id", "e.u", "e.v", "e.lu", "e.lv", F.col("e.label").alias("el"))


def itemset_source_sequences(spark, d):
    """itemset_file_sequences through the data source."""
    path = shared_folder(spark)
    files.write_records(_itemset_lines(spark, d), path, roll_bytes=1 << 20)
    return files.itemset_sequences(spark, path, split_bytes=1 << 18).select("tran_id", render.itemset_sequence(F.col("sequence")).alias("sequence"))


def item_file_patterns(spark, d):
    path = _files(priority_sequences(spark, d).select(F.array_join("items", ",").alias("value")))
    return sequences.frequent_item_sequences(text.read_item_sequences(spark, path), PRIORITY)


def own_format_patterns(spark, d):
    """Records over several lines through files, parsed in SQL by a registered table function, and mined."""
    block = F.concat(F.lit("record "), F.col("tran_id").cast("string"), F.lit("\n"), F.array_join(F.transform("items", lambda x: F.concat(F.lit("item "), x)), "\n"), F.lit("\nend"))
    path = _files(priority_sequences(spark, d).select(block.alias("value")))
    formats.register(spark, "read_blocks", formats.Blocks, formats.Blocks.SCHEMA)
    parsed = spark.sql("select * from read_blocks(table(select * from {lines}) partition by part order by (start, at))", lines=formats.lines(spark, path))
    return sequences.frequent_item_sequences(parsed, PRIORITY)


def _itemset_lines(spark: SparkSession, d: str) -> DataFrame:
    """(value): a line `customer order size item ...` for each order, items being lengths of part types."""
    rows = _type_rows(spark, d).select("o_custkey", "o_orderkey", F.length("p_type").alias("item")).groupBy("o_custkey", "o_orderkey").agg(F.collect_list("item").alias("items"))
    return rows.select(F.concat_ws(" ", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), F.size("items").cast("string"), F.transform("items", lambda x: x.cast("string"))).alias("value"))


def itemset_file_sequences(spark, d):
    path = _files(_itemset_lines(spark, d))
    return text.read_itemset_sequences(spark, path).select("tran_id", render.itemset_sequence(F.col("sequence")).alias("sequence"))


def pattern_sink_lines(spark, d):
    """Patterns through the text sink, copied, and read back."""
    first, second = shared_folder(spark), shared_folder(spark)
    sinks.write_patterns(seq_patterns_order_priority(spark, d), first, "text")
    sinks.copy_text(spark, first, second)
    return spark.read.text(second).select(F.col("value").alias("line"))


def _parts(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    local = partitions.local_support(support.exploded(records).withColumnRenamed("item", "pattern"), F.pmod("tran_id", F.lit(4)))
    sizes = records.groupBy(F.pmod("tran_id", F.lit(4)).alias("part")).agg(F.count("*").alias("n"))
    return local, sizes


def partition_local_support(spark, d):
    return _parts(brand_baskets(spark, d))[0]


def partition_candidates(spark, d):
    return partitions.candidates(*_parts(brand_baskets(spark, d)), 0.155)


def partition_merged_support(spark, d):
    records = brand_baskets(spark, d)
    local, sizes = _parts(records)
    return partitions.merged_support(local, sizes.agg(F.sum("n").alias("n")).scalar(), 0.155)


def min_frontier(spark, d):
    return partitions.frontier(_parts(brand_baskets(spark, d))[0])


def _patterns(spark, d) -> DataFrame:
    found = seq_patterns_order_priority(spark, d)
    return found.select(F.split("pattern", " > ").alias("pattern"), "support")


def pattern_tree_children(spark, d):
    return tree.children_counts(_patterns(spark, d)).select(render.item_sequence(F.col("pattern")).alias("pattern"), "children")


def pattern_parent_support(spark, d):
    return tree.parent_supports(_patterns(spark, d)).select(render.item_sequence(F.col("pattern")).alias("pattern"), "support", "parent_support")


def pattern_prefix_match(spark, d):
    queries = priority_sequences(spark, d).select(F.col("items").alias("query")).distinct()
    found = tree.longest_prefixes(queries, _patterns(spark, d))
    return found.groupBy(F.coalesce(F.size("matched"), F.lit(0)).alias("matched_size")).agg(F.count("*").alias("queries"))


def pattern_subtree_removed(spark, d):
    patterns = _patterns(spark, d)
    roots = patterns.where((F.size("pattern") == 1) & (F.col("pattern")[0] < "3"))
    kept = tree.without_subtrees(patterns, roots)
    return kept.select(render.item_sequence(F.col("pattern")).alias("pattern"), "support")


def pattern_tree_intervals(spark, d):
    """Depth, preorder interval, size of the subtree, and the nearest ancestor that twice as many records hold as are required."""
    patterns = written(_patterns(spark, d))
    need = 2 * PRIORITY * support.record_count(priority_sequences(spark, d))
    near = tree.nearest_ancestors(patterns, F.col("support") >= need).select(F.col("pattern").alias("p"), "ancestor")
    sizes = tree.subtree_sizes(patterns).join(near, F.col("pattern") == F.col("p"))
    return sizes.select(render.item_sequence(F.col("pattern")).alias("pattern"), "depth", "begin", "end", "below", render.item_sequence(F.col("ancestor")).alias("ancestor"))


def parsed_item_lines(spark, d):
    lines = _table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("o_orderpriority")), ",,").alias("value"))
    return text.parse_item_lines(lines.select("value")).select(F.size("items").alias("n")).groupBy("n").agg(F.count("*").alias("records"))


def parsed_itemset_lines(spark, d):
    parsed = text.parse_itemset_lines(_itemset_lines(spark, d))
    return parsed.select("tran_id", render.itemset_sequence(F.col("sequence")).alias("sequence"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        seq_patterns_order_priority, seq_patterns_levelwise, itemset_seq_patterns_ptype, itemset_seq_patterns_levelwise, frequent_itemsets_brand, frequent_itemsets_levelwise,
        itemset_seq_patterns_bitmaps, seq_patterns_by_parts, frequent_itemsets_by_parts, itemset_seq_patterns_by_parts, seq_patterns_finished, itemset_seq_patterns_finished, frequent_itemsets_finished,
        seq_patterns_coded, frequent_itemsets_coded, mining_levels,
        item_support, frequent_items, infrequent_items, item_rank, record_and_required_count, pruned_item_sequences, pruned_itemset_sequences,
        seq_first_occurrence, seq_projection_step, itemset_extension_step,
        graph_label_edge_support, graph_frequent_edges, graph_pruned_edges, graph_patterns_2edge, graph_patterns, graph_patterns_3edge, directed_graph_patterns,
        graph_file_patterns, graph_source_edges, item_file_patterns, own_format_patterns, itemset_file_sequences, itemset_source_sequences, pattern_sink_lines,
        partition_local_support, partition_candidates, partition_merged_support, min_frontier,
        pattern_tree_children, pattern_parent_support, pattern_prefix_match, pattern_subtree_removed, pattern_tree_intervals, parsed_item_lines, parsed_itemset_lines,
    )
}


# --- SQL ------------------------------------------------------------------------------------------------------------

_EV = "ev as (select o_custkey sid, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) pos, o_orderpriority item from orders)"
_SEQ = f"""recursive {_EV}, n as (select count(distinct sid) * {PRIORITY}::double mc from ev),
p as (select item pat, 1 k, sid, min(pos) pos from ev group by 1, 2, 3 qualify count(*) over (partition by item) >= (select mc from n)
      union all
      select pat, k, sid, pos from (select p.pat || ' > ' || e.item pat, p.k + 1 k, p.sid, min(e.pos) pos from p join ev e on e.sid = p.sid and e.pos > p.pos group by 1, 2, 3) t
      qualify count(*) over (partition by pat) >= (select mc from n)),
f as (select pat as pattern, k as size, count(*) as support from p group by 1, 2)"""
_BASKET = "it as (select distinct l_orderkey tid, p_brand item from lineitem join part on l_partkey = p_partkey)"
_ITEMSETS = f"""with recursive {_BASKET}, n as (select count(distinct tid) * {BRAND}::double mc from it),
p as (select item pat, item last, 1 k, tid from it qualify count(*) over (partition by item) >= (select mc from n)
      union all
      select pat, last, k, tid from (select p.pat || ',' || i.item pat, i.item last, p.k + 1 k, p.tid from p join it i on i.tid = p.tid and i.item > p.last) t
      qualify count(*) over (partition by pat) >= (select mc from n))
select pat as pattern, k as size, count(*) as support from p group by 1, 2"""
_TYPES = """base as (select distinct o_custkey sid, o_orderkey ok, o_orderdate od, p_type item from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
ev as (select sid, dense_rank() over (partition by sid order by od, ok) pos, item from base)"""
_ITEMSET_SEQ = f"""with recursive {_TYPES}, n as (select count(distinct sid) * {TYPE}::double mc from ev),
p as (select '(' || item pat, item last, 1 k, sid, pos from ev where item in (select item from ev group by 1 having count(distinct sid) >= (select mc from n))
      union all
      select pat, last, k, sid, pos from (
        select t.*, sum(case when rn = 1 then 1 else 0 end) over (partition by pat) sup from (
          select distinct *, row_number() over (partition by pat, sid order by pos) rn from (
            select distinct case when j then p.pat || ' ' || e.item else p.pat || ') (' || e.item end pat, e.item last, p.k + 1 k, p.sid, e.pos
            from p join (select *, unnest([true, false]) j from ev) e on e.sid = p.sid and ((j and e.pos = p.pos and e.item > p.last) or (not j and e.pos > p.pos))) u) t) v
      where sup >= (select mc from n))
select pat || ')' as pattern, k as size, count(distinct sid) as support from p group by 1, 2"""
_GRAPH = """r as (select p_type, row_number() over (order by p_type) as tl from (select distinct p_type from part)),
l as (select l_orderkey gid, 'o' || l_orderkey o, 'p' || l_partkey p, 's' || l_suppkey s, tl, 1000 + n_regionkey rl, case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end fl
      from lineitem join part on p_partkey = l_partkey join r using (p_type) join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey),
e as (select gid, o u, p v, 0 lu, tl lv, fl el from l union select gid, p, s, tl, rl, 3 from l),
n as (select count(distinct gid) as n from e)"""
_LABELS = "t as (select least(lu, lv)::int from_label, greatest(lu, lv)::int to_label, el::int edge_label, count(distinct gid) as support from e group by 1, 2, 3)"

def _two_edges(threshold: float) -> str:
    """1- and 2-edge patterns. In the order of gSpan a forward edge from the deeper vertex comes first, so of codes with the same first edge the one that goes on from vertex 1 is least."""
    choices = "[(m, e1, x, -0, e2, y), (x, e1, m, -1, e2, y), (m, e2, y, -0, e1, x), (y, e2, m, -1, e1, x)]"
    return f"""with {_GRAPH}, s as (select * from e union select gid, v, u, lv, lu, el from e), need as (select n * {threshold}::double as need from n),
one as (select '0 1 ' || lu || ' ' || el || ' ' || lv as pattern, 1 as size, count(distinct gid) as support from s where lu <= lv group by 1),
pair as (select a.gid, a.lu as m, a.el as e1, a.lv as x, b.el as e2, b.lv as y from s a join s b on a.gid = b.gid and a.u = b.u and a.v <> b.v),
c as (select gid, list_min(list_transform({choices}, lambda t: {{'lf': t[1], 'le': t[2], 'lt': t[3], 'deep': t[4], 'le2': t[5], 'lt2': t[6]}})) as c from pair),
two as (select '0 1 ' || c.lf || ' ' || c.le || ' ' || c.lt || ' , ' || (-c.deep) || ' 2 -1 ' || c.le2 || ' ' || c.lt2 as pattern, 2 as size, count(distinct gid) as support from c group by 1),
beside as (select '0 1 ' || a.lu || ' ' || a.el || ' ' || a.lv || ' , 1 0 -1 ' || b.el || ' -1' as pattern, 2 as size, count(distinct a.gid) as support
           from s a join s b on a.gid = b.gid and a.u = b.u and a.v = b.v and a.el < b.el where a.lu <= a.lv group by 1)
select pattern, size, support from (select * from one union all select * from two union all select * from beside) where support >= (select need from need)"""


def _line_patterns(most: int, threshold: float = LINES) -> str:
    """Patterns of line_graphs with at most `most` (2 or 3) edges. All ways to walk a connected set of edges from its least end are packed into numbers whose order is that of codes; the least one names the set. No two vertices have more than one edge."""
    step = lambda f: f"256 + (3 - {f}) * 64 + s.el * 16 + s.lv"
    part = lambda k: f"(case when k{k} >= 256 then (3 - ((k{k} >> 6) & 3)) || ' {k}' || ' -1 ' || ((k{k} >> 4) & 3) || ' ' || (k{k} & 15) else {k - 1} || ' ' || ((k{k} >> 6) & 3) || ' -1 ' || ((k{k} >> 4) & 3) || ' -1' end)"
    first = "'0 1 ' || (k1 >> 6) || ' ' || ((k1 >> 4) & 3) || ' ' || (k1 & 15)"
    third = f""",
c3 as (select c2.gid, code * 512 + s.el * 16 as code, d1, d2, s.eid as d3 from c2 join s on s.gid = c2.gid and s.u = v2 and s.v = v0 where f2 = 1
       union all select c2.gid, code * 512 + {step(2)}, d1, d2, s.eid from c2 join s on s.gid = c2.gid and s.u = v2 where s.v <> v0 and s.v <> v1
       union all select c2.gid, code * 512 + {step(1)}, d1, d2, s.eid from c2 join s on s.gid = c2.gid and s.u = v1 where f2 = 1 and s.v <> v0 and s.v <> v2
       union all select c2.gid, code * 512 + {step(0)}, d1, d2, s.eid from c2 join s on s.gid = c2.gid and s.u = v0 where s.v <> v1 and s.v <> v2),
m3 as (select gid, min(code) as code from c3 group by gid, least(d1, d2, d3), greatest(d1, d2, d3), d1 + d2 + d3),
p3 as (select {first} || ' , ' || {part(2)} || ' , ' || {part(3)} as pattern, 3 as size, support
       from (select code >> 18 as k1, (code >> 9) & 511 as k2, code & 511 as k3, count(distinct gid) as support from m3 group by all))"""
    return f"""with l as (select l_orderkey as gid, l_partkey * 2 + 1 as p, l_suppkey * 2 + 2 as s, 10 + n_regionkey as r from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey),
e0 as (select gid, 0::bigint as u, p as v, 0 as lu, 1 as lv, 0 as el from l union select gid, p, s, 1, r, 1 from l union select gid, 0, s, 0, r, 2 from l),
e as (select *, row_number() over () as eid from e0), s as (select * from e union all select gid, v, u, lv, lu, el, eid from e),
need as (select count(distinct gid) * {threshold}::double as need from e),
c1 as (select gid, u as v0, v as v1, lu * 64 + el * 16 + lv as code, eid as d1 from s where lu <= lv),
p1 as (select {first} as pattern, 1 as size, support from (select code as k1, count(distinct gid) as support from c1 group by 1)),
c2 as (select c1.gid, v0, v1, s.v as v2, 1 as f2, code * 512 + {step(1)} as code, d1, s.eid as d2 from c1 join s on s.gid = c1.gid and s.u = v1 where s.v <> v0
       union all select c1.gid, v0, v1, s.v, 0, code * 512 + {step(0)}, d1, s.eid from c1 join s on s.gid = c1.gid and s.u = v0 where s.v <> v1),
m2 as (select gid, min(code) as code from c2 group by gid, least(d1, d2), greatest(d1, d2)),
p2 as (select {first} || ' , ' || {part(2)} as pattern, 2 as size, support from (select code >> 9 as k1, code & 511 as k2, count(distinct gid) as support from m2 group by all)){third if most == 3 else ""}
select pattern, size, support from (select * from p1 union all select * from p2{" union all select * from p3" if most == 3 else ""}) where support >= (select need from need)"""


#: All patterns of line_graphs, of any size. Orders whose lines name different parts and suppliers differ by their regions only, so one of each form stands for n.
#: Embeddings of the least codes (numbered by no) grow by an edge at a time; of leaves that repeat each other one order is enough. A code is least if it is so in one graph.
_ALL_LINE_PATTERNS = f"""with recursive l as (select distinct l_orderkey as gid, l_partkey * 2 + 1 as p, l_suppkey * 2 + 2 as s, 10 + n_regionkey as r from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey),
g as materialized (select min(gid) as gid, count(*) as n from (select gid, if(count(distinct p) = count(*) and count(distinct s) = count(*), list(r order by r), [-1 - gid]) as form from l group by gid) group by form),
e0 as (select gid, 0::bigint as u, p as v, 0 as lu, 1 as lv, 0 as el from l union select gid, p, s, 1, r, 1 from l union select gid, 0, s, 0, r, 2 from l),
e as materialized (select *, row_number() over () as eid from e0 join g using (gid)), need as materialized (select sum(n) * {LINES}::double as need from g),
k as materialized (select lu, el, lv, row_number() over (order by lu, el, lv) as no from (select distinct lu, el, lv, gid, n from e) group by lu, el, lv having sum(n) >= (select need from need)),
s as materialized (select * from (select gid, u, v, lu, lv, el, eid, n from e union all select gid, v, u, lv, lu, el, eid, n from e) where (least(lu, lv), el, greatest(lu, lv)) in (select (lu, el, lv) from k)),
w as (
  select 1 as size, gid, n, [u, v] as vs, [0, 1] as path, no, 255 * 256 + el * 64 + lv as last, [eid] as es, '0 1 ' || lu || ' ' || el || ' ' || lv as pattern from s join k using (lu, el, lv)
  union all
  select * from (with x as materialized (
     select *, no * 131072 + step as key from (select *, if(met is null, 65536 + (255 - f) * 256 + el * 64 + lv, (met - 1) * 64 + el) as step
       from (select t.*, s.v, s.eid, s.el, s.lv, nullif(list_position(vs, s.v), 0) as met from (select *, unnest(path) as f from w) t join s on s.gid = t.gid and s.u = vs[f + 1]))
     where if(met is null, v > vs[-1] or step <> 65536 + last, f = len(vs) - 1 and list_contains(path, met - 1) and not list_contains(es, eid))),
   y as materialized (select key, min(gid) as one from (select distinct key, gid, n from x) group by key having sum(n) >= (select need from need)),
   c as materialized (select key, row_number() over (order by key) as no from (
     select distinct key from (select key, min(key) over (partition by gid, list_sort(list_append(es, eid))) as least from x where key in (select key from y) and gid in (select one from y)) where key = least))
   select size + 1, gid, n, if(met is null, list_append(vs, v), vs), if(met is null, list_append(list_filter(path, lambda i: i <= f), len(vs)::int), path), c.no, if(met is null, step - 65536, -1), list_append(es, eid),
          pattern || ' , ' || f || ' ' || if(met is null, len(vs) || ' -1 ' || el || ' ' || lv, (met - 1) || ' -1 ' || el || ' -1') from x join c using (key)))
select pattern, size, sum(n)::bigint as support from (select distinct pattern, size, gid, n from w) group by all"""


_DIRECTED = f"""with l as (select l_orderkey as gid, l_partkey * 2 + 1 as p, l_suppkey * 2 + 2 as s, 10 + n_regionkey as r from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey),
e as (select gid, 0::bigint as u, p as v, 0 as lu, 1 as lv, 0 as el from l union select gid, p, s, 1, r, 1 from l union select gid, 0, s, 0, r, 2 from l),
need as (select count(distinct gid) * {LINES}::double as need from e),
s as (select gid, u, v, lu, lv, 2 * el as el from e union all select gid, v, u, lv, lu, 2 * el + 1 from e),
c1 as (select gid, [lu, el, lv] as c from s where lu < lv or (lu = lv and el % 2 = 0)),
-- from the middle vertex m to x and y: a code begins at x, or at m and goes on from the vertex just found or from m
pair as (select a.gid, list_min([[a.lv, xor(a.el, 1), a.lu, 0, b.el, b.lv], [a.lu, a.el, a.lv, 1, b.el, b.lv], [b.lv, xor(b.el, 1), b.lu, 0, a.el, a.lv], [b.lu, b.el, b.lv, 1, a.el, a.lv]]) as c
         from s a join s b on a.gid = b.gid and a.u = b.u and a.v < b.v),
w as (select 1 as size, gid, c from c1 union all select 2, gid, c from pair),
n as (select size, c, count(distinct gid) as support from w group by all)
select '0 1 ' || c[1] || ' ' || (c[2] >> 1) || case c[2] % 2 when 0 then '>' else '<' end || ' ' || c[3]
       || case when size = 1 then '' else ' , ' || (1 - c[4]) || ' 2 -1 ' || (c[5] >> 1) || case c[5] % 2 when 0 then '>' else '<' end || ' ' || c[6] end as pattern, size, support
from n where support >= (select need from need)"""


_ITEMSET_LINES = """with b as (select distinct o_custkey, o_orderkey, length(p_type) as item from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
        s as (select o_custkey, o_orderkey, string_agg(item::varchar, ' ' order by item::varchar) as items from b group by 1, 2)
        select o_custkey::int as tran_id, '(' || string_agg(items, ') (' order by o_orderkey) || ')' as sequence from s group by 1"""


ORACLES: dict[str, str] = {
    "seq_patterns_order_priority": f"with {_SEQ} select pattern, size, support from f",
    "seq_patterns_levelwise": f"with {_SEQ} select pattern, size, support from f",
    "itemset_seq_patterns_ptype": _ITEMSET_SEQ,
    "itemset_seq_patterns_levelwise": _ITEMSET_SEQ,
    "frequent_itemsets_brand": _ITEMSETS,
    "frequent_itemsets_levelwise": _ITEMSETS,
    **dict.fromkeys(("seq_patterns_by_parts", "seq_patterns_finished", "seq_patterns_coded", "own_format_patterns"), f"with {_SEQ} select pattern, size, support from f"),
    **dict.fromkeys(("frequent_itemsets_by_parts", "frequent_itemsets_finished", "frequent_itemsets_coded"), _ITEMSETS),
    **dict.fromkeys(("itemset_seq_patterns_bitmaps", "itemset_seq_patterns_by_parts", "itemset_seq_patterns_finished"), _ITEMSET_SEQ),
    "item_support": f"with {_BASKET} select item, count(*) as support from it group by 1",
    "frequent_items": f"with {_BASKET} select item, count(*) as support from it group by 1 having count(*) >= (select count(distinct tid) * 0.155::double from it)",
    "infrequent_items": f"with {_BASKET} select item, count(*) as support from it group by 1 having count(*) < (select count(distinct tid) * 0.155::double from it)",
    "item_rank": f"with {_BASKET}, s as (select item, count(*) as support from it group by 1) select item, support, row_number() over (order by support desc, item) as rank from s",
    "record_and_required_count": f"select count(distinct o_custkey) as n_records, count(distinct o_custkey) * {PRIORITY}::double as required from orders",
    "pruned_item_sequences": f"""with {_EV}, k as (select item from ev group by 1 having count(distinct sid) >= (select count(distinct sid) * 0.86::double from ev))
        select sid as tran_id, string_agg(item, ' > ' order by pos) as items from ev where item in (select item from k) group by 1""",
    "pruned_itemset_sequences": f"""with {_TYPES}, k as (select item from ev group by 1 having count(distinct sid) >= (select count(distinct sid) * 0.98::double from ev)),
        s as (select sid, pos, string_agg(item, ' ' order by item) as items from ev where item in (select item from k) group by 1, 2)
        select sid as tran_id, '(' || string_agg(items, ') (' order by pos) || ')' as sequence from s group by 1""",
    "seq_first_occurrence": f"with {_EV} select sid as tran_id, item, min(pos) as pos from ev group by 1, 2",
    "seq_projection_step": f"""with {_EV}, o as (select sid, item, min(pos) as pos from ev group by 1, 2)
        select o.item as pattern, e.item, count(distinct o.sid) as support from o join ev e on e.sid = o.sid and e.pos > o.pos group by 1, 2""",
    "itemset_extension_step": f"""with {_TYPES}
        select a.item as pattern, a.pos = b.pos as joined, b.item, count(distinct a.sid) as support
        from ev a join ev b on a.sid = b.sid and ((a.pos = b.pos and b.item > a.item) or b.pos > a.pos) group by 1, 2, 3""",
    "graph_label_edge_support": f"with {_GRAPH}, {_LABELS} select * from t",
    "graph_frequent_edges": f"with {_GRAPH}, {_LABELS} select * from t where support >= (select n * {GRAPH}::double from n)",
    "graph_pruned_edges": f"""with {_GRAPH}, {_LABELS}, k as (select * from t where support >= (select n * {GRAPH}::double from n))
        select gid, count(*) as edges from e join k on least(lu, lv) = from_label and greatest(lu, lv) = to_label and el = edge_label group by 1""",
    "graph_patterns_2edge": _two_edges(GRAPH),
    "graph_patterns": _two_edges(0.1),
    "graph_patterns_3edge": _line_patterns(3),
    "directed_graph_patterns": _DIRECTED,
    "graph_file_patterns": _ALL_LINE_PATTERNS,
    "graph_source_edges": """with l as (select l_orderkey as gid, l_partkey * 2 + 1 as p, l_suppkey * 2 + 2 as s, 10 + n_regionkey as r from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey),
        e as (select gid, 0 as u, p as v, 0 as lu, 1 as lv, 0 as el from l union select gid, p, s, 1, r, 1 from l union select gid, 0, s, 0, r, 2 from l)
        select gid::int as graph_id, u::int as u, v::int as v, lu::int as lu, lv::int as lv, el::int as el from e""",
    "item_file_patterns": f"with {_SEQ} select pattern, size, support from f",
    "pattern_sink_lines": f"with {_SEQ} select pattern || ': ' || support as line from f",
    "partition_local_support": f"with {_BASKET} select tid % 4 as part, item as pattern, count(*) as local_support from it group by 1, 2",
    "partition_candidates": f"""with {_BASKET}, n as (select tid % 4 as part, count(distinct tid) as n from it group by 1), l as (select tid % 4 as part, item, count(*) as c from it group by 1, 2)
        select distinct item as pattern from l join n using (part) where c >= n * 0.155::double""",
    "partition_merged_support": f"""with {_BASKET} select item as pattern, count(*) as support, count(distinct tid % 4) as parts from it group by 1
        having count(*) >= (select count(distinct tid) * 0.155::double from it)""",
    "min_frontier": f"with {_BASKET}, m as (select tid % 4 as part, max(item) as pattern from it group by 1) select min(pattern) as pattern from m",
    "pattern_tree_children": f"with {_SEQ} select f.pattern, count(g.pattern) as children from f left join f g on g.size = f.size + 1 and starts_with(g.pattern, f.pattern || ' > ') group by 1",
    "pattern_parent_support": f"with {_SEQ} select g.pattern, g.support, f.support as parent_support from f join f g on g.size = f.size + 1 and starts_with(g.pattern, f.pattern || ' > ')",
    "pattern_prefix_match": f"""with {_SEQ}, q as (select distinct list(item order by pos) as items from ev group by sid),
        m as (select items, max(case when f.pattern = array_to_string(items[1:f.size], ' > ') then f.size else 0 end) as k from q, f group by 1)
        select k::int as matched_size, count(*) as queries from m group by 1""",
    "pattern_subtree_removed": f"with {_SEQ} select pattern, support from f where pattern >= '3'",
    "mining_levels": f"""with {_SEQ}, k as (select item from ev, n group by item, mc having count(distinct sid) >= mc),
        g as (select p.k + 1 as level, p.pat, e.item, p.sid from p join ev e on e.sid = p.sid and e.pos > p.pos where e.item in (select item from k) group by all
              union all select distinct 1, '', item, sid from ev where item in (select item from k)),
        c as (select level, pat, item, count(*) as support from g group by all), l as (select unnest(range(1, max(k) + 2)) as level from p)
        select l.level::int as level, coalesce(sum(support), 0)::bigint as projections, count(support) as candidates,
               count(support) filter (support >= mc) as frequent, count(support) filter (support >= mc) as canonical
        from l left join c on c.level = l.level, n group by l.level, mc""",
    "pattern_tree_intervals": f"""with {_SEQ}, t as (select *, row_number() over (order by string_split(pattern, ' > ')) - 1 as begin from f),
        b as (select f.pattern, count(*) - 1 as below from f join f g on starts_with(g.pattern || ' > ', f.pattern || ' > ') group by 1),
        a as (select f.pattern, max_by(g.pattern, g.size) as ancestor from f join f g on g.size < f.size and starts_with(f.pattern, g.pattern || ' > ')
              where g.support >= 2 * {PRIORITY}::double * (select count(distinct sid) from ev) group by 1)
        select pattern, size as depth, begin, begin + below + 1 as "end", below, ancestor from t join b using (pattern) left join a using (pattern)""",
    "parsed_item_lines": "with c as (select o_custkey, count(*)::int as n from orders group by 1) select n, count(*) as records from c group by 1",
    "parsed_itemset_lines": _ITEMSET_LINES,
    "itemset_file_sequences": _ITEMSET_LINES,
    "itemset_source_sequences": _ITEMSET_LINES,
}
