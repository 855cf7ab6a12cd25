"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_written, materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, max_rounds: int = 100, write: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """From rows of two node ids (the first two columns, long): node, component, for nodes with an edge to another node.

    The component is its smallest node. Each round writes the edges to the shared folder (by write) and deletes those of
    the round before; no group of neighbours is gathered: a node's smallest neighbour is a partial aggregate that is
    joined back to its edges. Rows with a null or with equal ends are no edges.
    """
    a, b = (F.col(c).cast("long") for c in edges.columns[:2])
    now = write(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where((a != b)).distinct())
    before = _state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.join(least, now["lo"] == least["u"]).select("hi", F.col("m").alias("lo")).where(F.col("hi") != F.col("lo")).distinct()
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.join(least, large["hi"] == least["u"]).where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = write(small.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct())
        after = _state(new)
        drop_written(now.sparkSession, now)
        now = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
