"""Local supports of parts of the data, the candidates that they give, and their merger to global supports.

A pattern that is frequent over all is frequent in one part at least, so the union of what is frequent somewhere is a
complete candidate set. Parts are named by a column, e.g. a hash of the record id, a file or a partition.

frequent_by_parts mines whole patterns in two passes over parts. In the first each part is mined to the end in one task,
with its own share of the threshold. A pattern that every part found has its support at once, as the sum. The others are
counted in the second pass: dealt into trees of neighbouring candidates, each of which meets each part, whose records walk
down the tree of all its candidates at once. Parts and trees have bounded sizes and their number grows with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.functions import ragged, render
from motifloom.operators import support
from motifloom.plans import coding
from motifloom.plans.checkpoints import dropped, written

#: Items of a part and candidates of a tree (about): what a task holds follows from both.
PART_ITEMS, TREE = 1 << 20, 1 << 16


def local_support(occurrences: DataFrame, part: Column) -> DataFrame:
    """From distinct (pattern, tran_id): (part, pattern, local_support)."""
    return occurrences.groupBy(part.alias("part"), "pattern").agg(F.count("*").alias("local_support"))


def candidates(local: DataFrame, part_sizes: DataFrame, threshold: float) -> DataFrame:
    """Patterns that reach the threshold in a part, from (part, pattern, local_support) and (part, n)."""
    return local.join(part_sizes, "part").where(F.col("local_support") >= F.col("n") * threshold).select("pattern").distinct()


def merged_support(local: DataFrame, n_records: Column, threshold: float) -> DataFrame:
    """(pattern, support, parts) of the globally frequent patterns; a part without a row has none of the pattern."""
    merged = local.groupBy("pattern").agg(F.sum("local_support").alias("support"), F.count("*").alias("parts"))
    return merged.where(F.col("support") >= n_records * threshold)


def frontier(local: DataFrame) -> DataFrame:
    """The smallest over parts of the largest pattern that each has: one row, pattern."""
    return local.groupBy("part").agg(F.max("pattern").alias("pattern")).agg(F.min("pattern").alias("pattern"))


def _local(threshold: float, most: int | None):
    def run(table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        found = list(ragged.mined(ragged.block_of(table["codes"]), n * threshold, most))
        part = pa.array([table["part"][0].as_py()] * len(found), pa.int64())
        return pa.table([part, pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.int64())], ["part", "steps", "local_support"])

    return run


def _counted(candidates: pa.Table, records: pa.Table) -> pa.Table:
    steps = [tuple(x) for x in candidates["steps"].to_pylist()]
    n = ragged.counted(ragged.block_of(records["codes"]), steps) if steps and records.num_rows else np.zeros(len(steps), np.int64)
    hit = np.flatnonzero(n)
    return pa.table([pa.array([steps[i] for i in hit], pa.list_(pa.int64())), pa.array(n[hit], pa.int64())], ["steps", "support"])


def local_patterns(coded: DataFrame, sizes: DataFrame, threshold: float, most: int | None = None) -> DataFrame:
    """From (part, codes) and (part, n): (part, steps, local_support) of all patterns that reach n x threshold in their part."""
    rows = coded.join(sizes, "part").select("part", "n", "codes")
    return rows.groupBy("part").applyInArrow(_local(threshold, most), "part long, steps array<long>, local_support long")


def candidate_supports(coded: DataFrame, candidates: DataFrame, parts: int, tree: int = TREE) -> DataFrame:
    """(steps, support) of candidates (steps, distinct) over (part, codes), parts from 0 to below `parts`; those that occur nowhere are left out."""
    dealt = written(coding.numbered(candidates.select("steps"), F.asc("steps")).select("steps", F.expr(f"number div {tree}").alias("tree")))
    trees = (dealt.agg(F.max("tree")).first()[0] or 0) + 1
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = dealt.select("tree", each(parts).alias("part"), "steps")
    records = coded.select(each(trees).alias("tree"), "part", "codes")
    found = asked.groupBy("tree", "part").cogroup(records.groupBy("tree", "part")).applyInArrow(_counted, "steps array<long>, support long")
    return found.groupBy("steps").agg(F.sum("support").alias("support"))


def frequent_by_parts(records: DataFrame, threshold: float, as_sets: bool = False, least_parts: int = 1, part_items: int = PART_ITEMS, tree: int = TREE, max_size: int | None = None) -> DataFrame:
    """(pattern, size, support) of all frequent patterns of (tran_id, items), or of (tran_id, sequence).

    Items are sequences, with as_sets itemsets. tran_id names a record; null items and null lists are none. There are as
    many parts as part_items items each ask for, at least least_parts.
    """
    nested = "sequence" in records.columns
    records = written(records)  # read five times
    n = records.count()
    flat = records.select("tran_id", (F.flatten("sequence") if nested else F.col("items")).alias("items"))
    counts = written(support.item_support(flat).where(F.col("item").isNotNull()))
    codes = coding.item_codes(counts.where(F.col("support") >= n * threshold))
    total = flat.agg(F.sum(F.size(F.coalesce("items", F.array().cast(flat.schema["items"].dataType))))).first()[0] or 0
    parts = max(least_parts, -(-total // part_items), 1)
    part = F.pmod(F.xxhash64("tran_id"), F.lit(parts)).alias("part")
    coded = coding.coded_records(records, codes)
    listed = F.col("sequence") if nested else F.array_sort(F.array_distinct("items")) if as_sets else F.col("items")
    coded = written(coded.select(part, listed.alias("codes")))
    sizes = written(records.groupBy(part).agg(F.count("*").alias("n")))

    local = written(local_patterns(coded, sizes, threshold, max_size))
    merged = written(local.groupBy("steps").agg(F.sum("local_support").alias("support"), F.count("*").alias("parts")))
    occupied = sizes.count()
    known = merged.where(F.col("parts") == occupied).select("steps", "support")
    asked = merged.where(F.col("parts") < occupied)
    if not asked.isEmpty():
        known = known.unionByName(candidate_supports(coded, asked, parts, tree))
    found = written(coding.decoded(known.where(F.col("support") >= n * threshold), codes))
    for frame in (records, coded, sizes, local, merged, codes, counts):
        dropped(frame)
    flat_items = F.flatten("pattern")
    shown = render.itemset_sequence(F.col("pattern")) if nested else render.itemset(flat_items) if as_sets else render.item_sequence(flat_items)
    return found.select(shown.alias("pattern"), F.col("size").cast("int").alias("size"), "support")
