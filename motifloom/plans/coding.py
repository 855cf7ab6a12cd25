"""Dense codes for items: records carry small ints, patterns are decoded at the end.

Numbers are given in an order without gathering the rows: a range partitioning sorts them, each partition counts its own,
and the sums of the partitions before (a row for each partition) are added. Items are numbered by support, most frequent
first, ties by item, so the code of an item is its rank less 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.plans.checkpoints import written

#: monotonically_increasing_id has the row's place within its partition below this bit.
_PLACE_BITS = 33


def numbered(rows: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """rows with their place in an order (from 0), written. Rows that tie are numbered in any order.

    The only window runs over a row for each partition.
    """
    own = rows.columns
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.select(*own, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("_place")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select(F.col("_part").alias("_own"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(parts, F.col("_part") == F.col("_own")).select(*own, (F.col("_before") + F.col("_place")).cast("long").alias(name))


def item_codes(support: DataFrame) -> DataFrame:
    """(item, code) from (item, support): written."""
    return written(numbered(support, F.desc("support"), F.asc("item"), name="code").select("item", "code"))


def coded_records(records: DataFrame, codes: DataFrame) -> DataFrame:
    """(tran_id, items) or (tran_id, sequence) with codes in place of items; items without a code go, and records and sets that become empty."""
    if "sequence" in records.columns:
        sets = records.select("tran_id", F.posexplode("sequence").alias("pos", "items"))
        rows = sets.select("tran_id", "pos", F.explode(F.array_distinct("items")).alias("item")).join(codes, "item")
        kept = rows.groupBy("tran_id", "pos").agg(F.sort_array(F.collect_list("code")).alias("items"))
        ordered = kept.groupBy("tran_id").agg(F.array_sort(F.collect_list(F.struct("pos", "items"))).alias("x"))
        return ordered.select("tran_id", F.col("x.items").alias("sequence"))
    rows = records.select("tran_id", F.posexplode("items").alias("pos", "item")).join(codes, "item")
    ordered = rows.groupBy("tran_id").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("x"))
    return ordered.select("tran_id", F.col("x.code").alias("items"))


def decoded(patterns: DataFrame, codes: DataFrame) -> DataFrame:
    """(steps, support) -> (pattern, size, support): steps are 2 x code, plus 1 where the item joins the set before; pattern is an array of sets of items."""
    steps = patterns.select("steps", "support", F.posexplode("steps").alias("k", "step"))
    named = steps.join(codes, F.shiftright("step", 1) == F.col("code")).select("steps", "support", F.struct("k", (F.col("step") % 2 == 1).alias("joined"), "item").alias("x"))
    whole = named.groupBy("steps", "support").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    kind = f"array<array<{codes.schema['item'].dataType.simpleString()}>>"

    def add(sets: Column, x: Column) -> Column:
        joined = F.concat(F.slice(sets, 1, F.size(sets) - 1), F.array(F.concat(F.element_at(sets, -1), F.array(x["item"]))))
        return F.when(x["joined"], joined).otherwise(F.concat(sets, F.array(F.array(x["item"]))))

    return whole.select(F.aggregate("xs", F.array().cast(kind), add).alias("pattern"), F.size("steps").alias("size"), "support")


def decoded_arrays(patterns: DataFrame, codes: DataFrame) -> DataFrame:
    """Patterns (distinct arrays of codes, or arrays of arrays) with items in place of codes; other columns stay."""
    rest = [c for c in patterns.columns if c != "pattern"]
    nested = patterns.schema["pattern"].dataType.elementType.typeName() == "array"
    rows = patterns.select("pattern", *rest, F.posexplode("pattern").alias("i", "x"))
    rows = rows.select("pattern", *rest, "i", F.posexplode("x").alias("j", "code")) if nested else rows.select("pattern", *rest, "i", F.lit(0).alias("j"), F.col("x").alias("code"))
    named = rows.join(codes, "code").groupBy("pattern", *rest).agg(F.array_sort(F.collect_list(F.struct("i", "j", "item"))).alias("xs"))
    if not nested:
        return named.select(F.col("xs.item").alias("pattern"), *rest)
    sets = F.transform(F.sequence(F.lit(0), F.size("pattern") - 1), lambda i: F.transform(F.filter("xs", lambda x: x["i"] == i), lambda x: x["item"]))
    return named.select(sets.alias("pattern"), *rest)
