"""Views of a set of patterns as a tree of prefixes. Patterns are arrays of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.plans import intervals


def with_parents(patterns: DataFrame) -> DataFrame:
    """(pattern, support) with depth and parent (the empty array for one-step patterns)."""
    return patterns.withColumn("depth", F.size("pattern")).withColumn("parent", F.slice("pattern", 1, F.size("pattern") - 1))


def parent_supports(patterns: DataFrame) -> DataFrame:
    """(pattern, support, parent_support) of patterns of two or more steps; an exact match finds the parent."""
    known = patterns.select(F.col("pattern").alias("parent"), F.col("support").alias("parent_support"))
    return with_parents(patterns).where(F.col("depth") > 1).join(known, "parent").select("pattern", "support", "parent_support")


def children_counts(patterns: DataFrame) -> DataFrame:
    """(pattern, children) of all patterns, 0 for leaves."""
    n = with_parents(patterns).groupBy("parent").agg(F.count("*").alias("n"))
    return patterns.select("pattern").join(n, F.col("pattern") == F.col("parent"), "left").select("pattern", F.coalesce("n", F.lit(0)).alias("children"))


def subtree(patterns: DataFrame, roots: DataFrame) -> DataFrame:
    """Patterns that have one of roots (pattern) as a prefix, themselves included."""
    return _below(patterns, roots).where(F.col("_root").isNotNull()).select("_row.*")


def without_subtrees(patterns: DataFrame, roots: DataFrame) -> DataFrame:
    """Patterns of which no prefix is among roots."""
    return _below(patterns, roots).where(F.col("_root").isNull()).select("_row.*")


def _below(patterns: DataFrame, roots: DataFrame) -> DataFrame:
    """`_row` of patterns, and the nearest of roots that it begins with."""
    rows = patterns.select("pattern", F.struct("*").alias("_row"))
    both = rows.unionByName(roots.select("pattern", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")))
    return intervals.nearest_prefix(both, F.col("_row").isNull(), itself=True, name="_root").where(F.col("_row").isNotNull())


def longest_prefixes(queries: DataFrame, patterns: DataFrame) -> DataFrame:
    """(query, matched): the longest prefix of each distinct query array that is a pattern; null if there is none, as for a null query."""
    asked = queries.select(F.col("query").alias("pattern"), F.lit(True).alias("_asked")).distinct()
    both = asked.where(F.col("pattern").isNotNull()).unionByName(patterns.select("pattern", F.lit(False).alias("_asked")))
    found = intervals.nearest_prefix(both, ~F.col("_asked"), itself=True, name="matched").where("_asked")
    none = asked.where(F.col("pattern").isNull()).select(F.col("pattern").alias("query"), F.col("pattern").alias("matched"))
    return found.select(F.col("pattern").alias("query"), "matched").unionByName(none)


def subtree_sizes(patterns: DataFrame) -> DataFrame:
    """(pattern, depth, begin, end, below): preorder intervals, and how many patterns go on from each."""
    return intervals.preorder(patterns.select("pattern")).withColumn("below", F.col("end") - F.col("begin") - 1)


def nearest_ancestors(patterns: DataFrame, chosen: Column) -> DataFrame:
    """patterns with ancestor: the longest proper prefix that is a pattern for which chosen holds."""
    return intervals.nearest_prefix(patterns, chosen, name="ancestor")
