"""Formats of one's own: parsers that read line after line and keep what they have seen.

A Parser is told each line of a part in order and gives the records that are complete; at the part's end it gives what is
left. So a record may span any number of lines, and a line may end a whole part. Parsers run in Spark as table functions
over (part, ..., value), partitioned by part and ordered: in DataFrames with parsed(), in SQL after register().

A part is read by one task as a stream, which holds one parser's state. Of files, each is a part (lines()), since a parser
may look back as far as its file's first line; write large sources as part files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class Parser(Protocol):
    def line(self, value: str) -> Iterable[tuple]:
        """Records (fields in the order of the schema) that this line completes."""

    def end(self) -> Iterable[tuple]:
        """Records that are complete as the part ends."""


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(part, start, at, value): the lines of each file; part is the file, (start, at) their order in it, however files are split over tasks."""
    raw = spark.read.text(path)
    return raw.select(F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")


def table_function(parser: Callable[[], Parser], schema: str):
    """A table function over a table with the column value; each partition has a parser of its own."""

    class Reader:
        def __init__(self):
            self.parser = parser()

        def eval(self, row: Row):
            if row["value"] is not None:
                yield from self.parser.line(row["value"])

        def terminate(self):
            yield from self.parser.end()

    return F.udtf(Reader, returnType=schema)


def register(spark: SparkSession, name: str, parser: Callable[[], Parser], schema: str) -> None:
    """For SQL: SELECT * FROM name(TABLE(t) PARTITION BY part ORDER BY (start, at))."""
    spark.udtf.register(name, table_function(parser, schema))


def parsed(rows: DataFrame, parser: Callable[[], Parser], schema: str, part: str = "part", order: tuple[str, ...] = ("start", "at")) -> DataFrame:
    """The records of rows, which have the column value. Null lines are none; a null part is a part like others."""
    return table_function(parser, schema)(rows.asTable().partitionBy(part).orderBy(*order))


class Blocks:
    """Records (tran_id, items) over several lines: `record <id>`, a line `item <text>` for each item, and `end`.

    A record that has no `end` before the next one begins, or before its part ends, counts as complete; `stop` ends a
    part: what follows is left out. Other lines are left out.
    """

    SCHEMA = "tran_id long, items array<string>"

    def __init__(self):
        self.record: tuple[int, list[str]] | None = None
        self.stopped = False

    def line(self, value: str) -> Iterable[tuple]:
        word, _, rest = value.strip().partition(" ")
        if self.stopped:
            return
        if word == "record":
            yield from self.end()
            self.record = int(rest), []
        elif word == "item" and self.record is not None:
            self.record[1].append(rest.strip())
        elif word in ("end", "stop"):
            yield from self.end()
            self.stopped = word == "stop"

    def end(self) -> Iterable[tuple]:
        if self.record is not None:
            yield self.record
        self.record = None
