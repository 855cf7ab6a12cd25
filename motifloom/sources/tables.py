"""Records from tables: baskets, sequences and graphs of any DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def baskets(rows: DataFrame, tran_id: str | Column, item: str | Column) -> DataFrame:
    """(tran_id, items): the distinct items of each transaction."""
    return rows.groupBy(_col(tran_id).alias("tran_id")).agg(F.sort_array(F.collect_set(_col(item))).alias("items"))


def item_sequences(rows: DataFrame, tran_id: str | Column, order: list[str], item: str | Column) -> DataFrame:
    """(tran_id, items): the items of each record by order. A record is one customer's history, gathered in its own row."""
    keyed = rows.select(_col(tran_id).alias("tran_id"), F.struct(*order, _col(item).alias("_item")).alias("e"))
    return keyed.groupBy("tran_id").agg(F.array_sort(F.collect_list("e")).alias("e")).select("tran_id", F.col("e._item").alias("items"))


def itemset_sequences(rows: DataFrame, tran_id: str | Column, order: list[str], item: str | Column) -> DataFrame:
    """(tran_id, sequence): rows with equal order are one itemset, items sorted and distinct."""
    sets = rows.groupBy(_col(tran_id).alias("tran_id"), *order).agg(F.sort_array(F.collect_set(_col(item))).alias("_items"))
    grouped = sets.groupBy("tran_id").agg(F.array_sort(F.collect_list(F.struct(*order, "_items"))).alias("e"))
    return grouped.select("tran_id", F.col("e._items").alias("sequence"))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
