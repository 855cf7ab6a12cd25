"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
#: Rows of ids that are broadcast at most: some 32 MB as a hashed relation.
BROADCAST_ROWS = 1 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(col):
    """Lower-cases A-Z only, inside the JVM."""
    return F.translate(col, _UPPER, _LOWER)


def held_out(doc_id):
    """True for the rows whose crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset (tests, local runs), under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "motifloom-checkpoints")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the folder of a frame that materialize() returned, once nothing reads it any more."""
    for name in df.inputFiles()[:1]:
        _delete(spark, name.rsplit("/", 1)[0])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """materialize(), with folders that are deleted when the block ends: what outlives the block must not read them."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(shared_dir(spark))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            _delete(spark, path)


def bounded(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written frame of a few numbers a row, marked for broadcast where it has at most `most` rows; beyond that its joins shuffle."""
    return F.broadcast(ids) if ids.count() <= most else ids


def kept_names(keep: Iterable[str], results: Iterable[str]) -> dict[str, str]:
    """What the columns of keep are called beside results: one that is named like a result, in any case, gets `_in` appended."""
    taken = {r.lower() for r in results}
    names: dict[str, str] = {}
    for column in dict.fromkeys(keep):
        name = column
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        names[column] = name
    return names


def with_results(docs: DataFrame, keep: Iterable[str], made: Column, results: Iterable[str]) -> DataFrame:
    """The columns of keep (named by kept_names) and the fields `results` of the struct column made."""
    results = tuple(results)
    names = kept_names(keep, results)
    # both sides stand in structs, so no name of docs can clash on the way
    kept = F.struct(*(F.col(c).alias(n) for c, n in names.items())) if names else F.lit(None)
    rows = docs.select(kept.alias("kept"), made.alias("made"))
    return rows.select(*(F.col("kept").getField(n).alias(n) for n in names.values()), *(F.col("made").getField(r).alias(r) for r in results))


def packed(df: DataFrame, **columns) -> DataFrame:
    """df as one column `row` (a struct of all of its own) beside new columns, whose names cannot clash with its own."""
    return df.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in columns.items()))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def blocks(texts: Iterable[str | None], max_chars: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of consecutive texts (null: empty) of about max_chars, so that what is built for one run stays bounded."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= max_chars or len(held) >= 4096:
            yield held
            held, size = [], 0
    if held:
        yield held


def read_bounded(path: str, max_bytes: int = 64 << 20) -> bytes:
    """A vocabulary file's bytes, refused beyond max_bytes: what this returns is shipped to every task."""
    if os.path.getsize(path) > max_bytes:
        raise ValueError(f"{path} has more than {max_bytes} bytes")
    with open(path, "rb") as file:
        return file.read()
