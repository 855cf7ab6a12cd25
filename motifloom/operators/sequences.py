"""Frequent sequences of items and of itemsets."""

from __future__ import annotations

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.functions import render
from motifloom.plans.checkpoints import written

NO_CAP = 2147483647


def _mined(sequences: DataFrame, threshold: float) -> DataFrame:
    # the miner passes over its input several times
    sequences = written(sequences.select("sequence"))
    span = PrefixSpan(minSupport=threshold, maxPatternLength=NO_CAP, sequenceCol="sequence")
    return span.findFrequentSequentialPatterns(sequences)


def frequent_item_sequences(records: DataFrame, threshold: float, typed: bool = False) -> DataFrame:
    """(pattern, size, support) of all subsequences of single items, from (tran_id, items). Null lists count as empty records.

    With typed also `items`, the pattern as an array: two patterns may look alike as strings.
    """
    empty = F.array().cast(records.schema["items"].dataType)
    found = _mined(records.select(F.transform(F.coalesce("items", empty), lambda x: F.array(x)).alias("sequence")), threshold)
    flat = F.flatten("sequence")
    return found.select(render.item_sequence(flat).alias("pattern"), F.size(flat).alias("size"), F.col("freq").alias("support"), *([flat.alias("items")] if typed else []))


def frequent_itemset_sequences(records: DataFrame, threshold: float, typed: bool = False) -> DataFrame:
    """(pattern, size, support) of all sequences of itemsets, from (tran_id, sequence); size counts items. Sets are sets: repeats in one count once.

    With typed also `items`, the pattern as an array of arrays.
    """
    empty = F.array().cast(records.schema["sequence"].dataType)
    sets = F.transform(F.coalesce("sequence", empty), lambda s: F.array_sort(F.array_distinct(s)))
    found = _mined(records.select(sets.alias("sequence")), threshold)
    return found.select(render.itemset_sequence(F.col("sequence")).alias("pattern"), render.flat_size(F.col("sequence")).alias("size"), F.col("freq").alias("support"), *([F.col("sequence").alias("items")] if typed else []))
