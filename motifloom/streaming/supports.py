"""Item supports of a stream of records. An extension: batch mining needs no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.operators.support import exploded


def running_supports(records: DataFrame) -> DataFrame:
    """From a streaming (tran_id, items): (item, support) so far; write it in complete or update mode."""
    return exploded(records).groupBy("item").agg(F.count("*").alias("support"))


def windowed_supports(records: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, item, support) of event-time windows, final once the watermark passes."""
    rows = records.withWatermark(time, late).select(F.window(time, window).alias("w"), F.explode(F.array_distinct("items")).alias("item"))
    return rows.groupBy("w", "item").agg(F.count("*").alias("support")).select(F.col("w.start").alias("start"), "item", "support")
