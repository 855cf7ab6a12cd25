"""One step of pattern growth as joins: what can follow a pattern, and where.

Events are (tran_id, pos, item): one row for each item of a sequence; items of one itemset share a pos.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def events_of(records: DataFrame) -> DataFrame:
    """From (tran_id, items)."""
    return records.select("tran_id", F.posexplode("items").alias("pos", "item"))


def set_events_of(records: DataFrame) -> DataFrame:
    """From (tran_id, sequence)."""
    sets = records.select("tran_id", F.posexplode("sequence").alias("pos", "items"))
    return sets.select("tran_id", "pos", F.explode(F.array_distinct("items")).alias("item"))


def first_occurrences(events: DataFrame) -> DataFrame:
    """(tran_id, item, pos): the first place of each item of a sequence, i.e. the projections of one-item patterns."""
    return events.groupBy("tran_id", "item").agg(F.min("pos").alias("pos"))


def sequence_step(projected: DataFrame, events: DataFrame) -> DataFrame:
    """(pattern, tran_id, pos) grown by one later item: (pattern, item, tran_id, pos of its first occurrence)."""
    p, e = projected.alias("p"), events.alias("e")
    later = p.join(e, (F.col("p.tran_id") == F.col("e.tran_id")) & (F.col("e.pos") > F.col("p.pos")))
    return later.groupBy("p.pattern", "e.item", "p.tran_id").agg(F.min("e.pos").alias("pos"))


def itemset_step(projected: DataFrame, events: DataFrame) -> DataFrame:
    """(pattern, last, tran_id, pos) at all its places, grown by an item of the same set (joins, after `last`) or of a later one.

    Returns (pattern, joined boolean, item, tran_id, pos), all places.
    """
    e = events.select("tran_id", "pos", "item").distinct().alias("e")
    # a later item is met once, from the first place: no row is made that distinct() would drop
    first = projected.groupBy("pattern", "tran_id").agg(F.min("pos").alias("pos")).alias("p")
    later = first.join(e, (F.col("p.tran_id") == F.col("e.tran_id")) & (F.col("e.pos") > F.col("p.pos")))
    p = projected.select("pattern", "last", "tran_id", "pos").distinct().alias("p")
    same = p.join(e, (F.col("p.tran_id") == F.col("e.tran_id")) & (F.col("p.pos") == F.col("e.pos")) & (F.col("e.item") > F.col("p.last")))
    shown = lambda rows, joined: rows.select("p.pattern", F.lit(joined).alias("joined"), "e.item", "p.tran_id", "e.pos")
    return shown(later, False).unionByName(shown(same, True))
