"""Pruning of infrequent items, sets and edges. What becomes empty is dropped; N stays that of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prune_item_sequences(records: DataFrame, frequent: DataFrame) -> DataFrame:
    """(tran_id, items): frequent items in their order. Joins exploded items, so the alphabet may be of any size."""
    rows = records.select("tran_id", F.posexplode("items").alias("pos", "item")).join(frequent.select("item"), "item", "left_semi")
    kept = rows.groupBy("tran_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("kept"))
    return kept.select("tran_id", F.col("kept.item").alias("items"))


def prune_itemset_sequences(records: DataFrame, frequent: DataFrame) -> DataFrame:
    """(tran_id, sequence): frequent items of each set; emptied sets go, and neighbouring sets never merge."""
    sets = records.select("tran_id", F.posexplode("sequence").alias("pos", "items"))
    rows = sets.select("tran_id", "pos", F.explode("items").alias("item")).join(frequent.select("item"), "item", "left_semi")
    kept = rows.groupBy("tran_id", "pos").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return kept.groupBy("tran_id").agg(F.array_sort(F.collect_list(F.struct("pos", "items"))).alias("kept")).select("tran_id", F.col("kept.items").alias("sequence"))


def label_edges(edges: DataFrame) -> DataFrame:
    """Each edge with its label triple, the smaller vertex label first: gid, from_label, to_label, edge_label."""
    return edges.select("gid", F.least("lu", "lv").alias("from_label"), F.greatest("lu", "lv").alias("to_label"), F.col("el").alias("edge_label"))


def label_edge_support(edges: DataFrame) -> DataFrame:
    """Graphs that hold an edge of these labels."""
    return label_edges(edges).distinct().groupBy("from_label", "to_label", "edge_label").agg(F.count("*").alias("support"))


def prune_edges(edges: DataFrame, frequent: DataFrame) -> DataFrame:
    """Edges (both directions alike) whose label triple is frequent."""
    on = (F.least("lu", "lv") == F.col("from_label")) & (F.greatest("lu", "lv") == F.col("to_label")) & (F.col("el") == F.col("edge_label"))
    return edges.join(frequent.select("from_label", "to_label", "edge_label"), on, "left_semi")
