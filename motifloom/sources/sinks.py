"""Writers of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_patterns(patterns: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", max_records_per_file: int | None = None) -> None:
    """Writes (pattern, size, support). The format `text` gives lines of `pattern: support`."""
    rows = patterns.select(F.concat_ws(": ", "pattern", F.col("support").cast("string")).alias("value")) if fmt == "text" else patterns
    writer = rows.write.mode(mode).format(fmt)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.save(path)


def copy_text(spark, source: str, target: str, overwrite: bool = False) -> None:
    """Copies lines between stores."""
    spark.read.text(source).write.mode("overwrite" if overwrite else "errorifexists").text(target)
