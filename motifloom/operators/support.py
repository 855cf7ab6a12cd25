"""Supports, thresholds and ranks of items. Records come as (tran_id, items array)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.plans import coding


def record_count(records: DataFrame) -> int:
    """N: records before pruning, empty ones included."""
    return records.count()


def required(n: int, threshold: float) -> float:
    """The support that is frequent: N x threshold, not rounded."""
    return n * threshold


def required_table(records: DataFrame, threshold: float) -> DataFrame:
    """One row: n_records, required."""
    return records.agg(F.count("*").alias("n_records")).withColumn("required", F.col("n_records") * F.lit(threshold))


def exploded(records: DataFrame, items: str = "items") -> DataFrame:
    """(tran_id, item), each item once a record."""
    return records.select("tran_id", F.explode(F.array_distinct(items)).alias("item"))


def item_support(records: DataFrame, items: str = "items") -> DataFrame:
    """(item, support): records that hold the item. One shuffle of partial counts."""
    return exploded(records, items).groupBy("item").agg(F.count("*").alias("support"))


def frequent_items(records: DataFrame, threshold: float) -> DataFrame:
    """Items whose support reaches the threshold, which is a scalar subquery over the same records."""
    need = required_table(records, threshold).select("required").scalar()
    return item_support(records).where(F.col("support") >= need)


def infrequent_items(records: DataFrame, threshold: float) -> DataFrame:
    support = item_support(records)
    return support.join(frequent_items(records, threshold), "item", "left_anti")


def item_ranks(support: DataFrame) -> DataFrame:
    """(item, support, rank): by support descending, ties by item, from 1. Ranks come from range partitions and their counts; no task sees all items."""
    return coding.numbered(support.select("item", "support"), F.desc("support"), F.asc("item")).select("item", "support", (F.col("number") + 1).alias("rank"))
