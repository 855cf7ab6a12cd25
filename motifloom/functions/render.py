"""Columns that render patterns as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def item_sequence(pattern: Column) -> Column:
    """array<T> -> `a > b > c`."""
    return F.array_join(F.transform(pattern, lambda x: x.cast("string")), " > ")


def itemset(pattern: Column) -> Column:
    """array<T> -> `a,b,c`, items sorted."""
    return F.array_join(F.transform(F.array_sort(pattern), lambda x: x.cast("string")), ",")


def itemset_sequence(pattern: Column) -> Column:
    """array<array<T>> -> `(a b) (c)`, items sorted inside each set."""
    sets = F.transform(pattern, lambda s: F.concat(F.lit("("), F.array_join(F.transform(F.array_sort(s), lambda x: x.cast("string")), " "), F.lit(")")))
    return F.array_join(sets, " ")


def dfs_code(pattern: Column, directed: bool = False) -> Column:
    """array of code edges -> `0 1 7 3 7 , 1 2 -1 3 9`; directed, `0 1 7 3> 7 , 1 2 -1 3< 9`."""
    label = lambda e: F.concat(F.shiftright(e["le"], 1).cast("string"), F.when(e["le"] % 2 == 0, ">").otherwise("<")) if directed else e["le"].cast("string")
    edge = lambda e: F.concat_ws(" ", *(label(e) if k == "le" else e[k].cast("string") for k in ("f", "t", "lf", "le", "lt")))
    return F.array_join(F.transform(pattern, edge), " , ")


def flat_size(pattern: Column) -> Column:
    """Items of an itemset sequence."""
    return F.aggregate(pattern, F.lit(0), lambda n, s: n + F.size(s))
