"""Frequent itemsets."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.functions import render
from motifloom.plans.checkpoints import written


def frequent_itemsets(records: DataFrame, threshold: float, typed: bool = False) -> DataFrame:
    """(pattern, size, support) of all itemsets that reach the threshold, from (tran_id, items); a null list counts as an empty record.

    With typed also `items`, the itemset as a sorted array: itemsets whose items hold commas or are null may look alike as strings.
    """
    baskets = records.select(F.array_distinct(F.coalesce("items", F.array().cast(records.schema["items"].dataType))).alias("items"))
    # the miner passes over its input several times
    found = FPGrowth(itemsCol="items", minSupport=threshold).fit(written(baskets)).freqItemsets
    return found.select(render.itemset(F.col("items")).alias("pattern"), F.size("items").alias("size"), F.col("freq").alias("support"), *([F.array_sort("items").alias("items")] if typed else []))
