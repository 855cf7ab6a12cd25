"""Record files as a data source: ranges of bytes that begin and end with records, and files that roll by bytes.

``spark.read.format("record_files").option("layout", ...).load(path)`` gives (file, start, part, place, value): a row for
each record with the byte at which it begins, and its place among the records of its part; parts are in the order of
files and ranges. Layouts say which lines open a record:

* ``graph``: lines of three fields or more whose first is `t`;
* ``itemset``: lines whose first field is not that of the line before (a customer's lines in a row are one record);
* ``line``: every line.

A file is cut every ``splitBytes``; a record belongs to the range in which it begins, and its task reads on to its end,
so a record may be longer than a range and the rows do not depend on where files are cut. Small files and ranges share a
part, up to PART_BYTES. A task holds one record and one batch of rows. With ``values`` false, value is null. Lines before a file's first record are a record of their own. Blank lines
are left out, and line ends (LF or CR LF).

``df.write.format("record_files").option("rollBytes", ...).mode("append" or "overwrite").save(path)`` writes a column of
strings, a line or several each; null ones are left out. A file that has rollBytes is closed after its record. Tasks write
to a hidden folder and the driver moves the files of the tasks that were committed, so tasks that fail or run twice leave
nothing behind.

Paths are files or folders that pyarrow reads: local or mounted ones (without a scheme or with file:), hdfs:, s3:, gs:.
Other stores, patterns of paths and compressed files are for ``sources/text.py``.
"""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .text import parse_itemset_lines

NAME = "record_files"
SCHEMA = "file string, start long, part int, place long, value string"
SPLIT_BYTES = ROLL_BYTES = 128 << 20
#: Ranges in a row of less than this in all are one task's work.
PART_BYTES = 4 << 20
_BATCH_BYTES, _BATCH_ROWS = 4 << 20, 10_000


def _opens_graph(line: bytes, before: bytes | None) -> bool:
    fields = line.split(None, 3)
    return len(fields) > 2 and fields[0] == b"t"


def _opens_itemsets(line: bytes, before: bytes | None) -> bool:
    return before is None or line.split(None, 1)[0] != before.split(None, 1)[0]


#: When a line opens a record, given the line before; and whether that depends on the line before.
LAYOUTS: dict[str, tuple[Callable[[bytes, bytes | None], bool], bool]] = {
    "graph": (_opens_graph, False),
    "itemset": (_opens_itemsets, True),
    "line": (lambda line, before: True, False),
}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if local := re.fullmatch(r"(?:file:(?://)?)?(/.*)", path):
        return fs.LocalFileSystem(), local.group(1)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def _listed(store: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """The files of a path that are not hidden, in order."""
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path))
    return sorted((f for f in found if f.is_file and not _hidden(f.base_name)), key=lambda f: f.path)


def _line_before(file, at: int) -> bytes | None:
    """The last line before byte `at`, where a line begins, that is not blank."""
    tail, size = b"", 1 << 12
    while at:
        size = min(2 * size, at)
        at -= size
        file.seek(at)
        tail = file.read(size) + tail
        lines = tail.split(b"\n")
        for line in reversed(lines[1:] if at else lines):
            if line.strip():
                return line
    return None


def records_of(file, start: int, end: int, layout: str) -> Iterator[tuple[int, list[bytes]]]:
    """(byte, lines) of the records that begin in [start, end) of a seekable file."""
    opens, looks_back = LAYOUTS[layout]
    at, before = start, None
    held: list[bytes] | None = [] if start == 0 else None  # what stands before a file's first record
    if start:
        file.seek(start - 1)
        at += len(file.readline()) - 1
        before = _line_before(file, at) if looks_back else None
    file.seek(at)
    began = at
    while line := file.readline():
        offset, at = at, at + len(line)
        bare = line.rstrip(b"\r\n")
        if not bare.strip():
            continue
        if opens(bare, before):
            if held:
                yield began, held
            if offset >= end:
                return
            began, held = offset, [bare]
        elif held is not None:
            began = began if held else offset
            held.append(bare)
        elif offset >= end:
            return
        before = bare
    if held:
        yield began, held


@dataclass
class _Part(InputPartition):
    number: int
    ranges: list[tuple[str, int, int]]


def _parts(files: Iterable[tuple[str, int]], split: int) -> list[_Part]:
    """Ranges of (path, size), as many in a row to a part as fit into `split` bytes, or PART_BYTES if that is more."""
    parts: list[_Part] = []
    room, most = 0, max(split, PART_BYTES)
    for path, size in files:
        for start in range(0, size, split):
            end = min(start + split, size)
            if not parts or end - start > room:
                parts.append(_Part(len(parts), []))
                room = most
            parts[-1].ranges.append((path, start, end))
            room -= end - start
    return parts


class _Reader(DataSourceReader):
    def __init__(self, path: str, layout: str, split: int, values: bool = True):
        self.path, self.layout, self.split, self.values = path, layout, split, values

    def partitions(self) -> list[_Part]:
        store, path = _store(self.path)
        return _parts([(f.path, f.size) for f in _listed(store, path)], self.split) or [_Part(0, [])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        rows: list[tuple[str, int, int, int, str | None]] = []
        size = place = 0
        for path, start, end in partition.ranges:
            with store.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 18) as file:
                for at, lines in records_of(file, start, end, self.layout):
                    value = b"\n".join(lines) if self.values else b""
                    rows.append((path, at, partition.number, place, value.decode(errors="replace") if self.values else None))
                    place, size = place + 1, size + len(value)
                    if size >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                        yield _batch(rows)
                        rows, size = [], 0
        yield _batch(rows)


def _batch(rows: list[tuple[str, int, int, int, str | None]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * 5
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "start", "part", "place", "value"])


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, roll: int, overwrite: bool):
        self.path, self.roll, self.overwrite, self.folder = path, roll, overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, path = _store(self.path)
        store.create_dir(f"{path}/{self.folder}", recursive=True)
        task, run = TaskContext.get().partitionId(), uuid.uuid4().hex
        names: list[str] = []
        file, size = None, 0
        try:
            for batch in iterator:
                for value in batch.column(0):
                    if not value.is_valid:
                        continue
                    if file is None:
                        names.append(f"part-{task:06d}-{len(names):06d}-{run}.txt")
                        file, size = store.open_output_stream(f"{path}/{self.folder}/{names[-1]}", compression=None), 0
                    line = value.as_py().encode() + b"\n"
                    file.write(line)
                    size += len(line)
                    if size >= self.roll:
                        file.close()
                        file = None
        finally:
            if file is not None:
                file.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for old in _listed(store, path):
                store.delete_file(old.path)
        for name in (name for m in messages if m is not None for name in m.names):
            store.move(f"{path}/{self.folder}/{name}", f"{path}/{name}")
        self._clear(store, path)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: fs.FileSystem, path: str) -> None:
        if store.get_file_info(f"{path}/{self.folder}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.folder}")


class RecordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _number(self, option: str, default: int) -> int:
        number = int(self.options.get(option, default))
        if number < 1:
            raise ValueError(f"{option} must be 1 or more")
        return number

    def reader(self, schema) -> _Reader:
        layout = self.options.get("layout", "line")
        if layout not in LAYOUTS:
            raise ValueError(f"layout must be one of {', '.join(LAYOUTS)}")
        return _Reader(self.options["path"], layout, self._number("splitBytes", SPLIT_BYTES), self.options.get("values", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> _Writer:
        if [f.dataType.typeName() for f in schema.fields] != ["string"]:
            raise ValueError("record files are written from one column of strings")
        return _Writer(self.options["path"], self._number("rollBytes", ROLL_BYTES), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, for spark.read, df.write and SQL."""
    spark.dataSource.register(RecordFiles)


def read_records(spark: SparkSession, path: str, layout: str, split_bytes: int = SPLIT_BYTES, values: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("layout", layout).option("splitBytes", split_bytes).option("values", values).load(path)


def write_records(lines: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, mode: str = "append") -> None:
    """Writes one column of strings."""
    register(lines.sparkSession)
    lines.write.format(NAME).option("rollBytes", roll_bytes).mode(mode).save(path)


def graph_blocks(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(gid, value) like text.read_graph_blocks: graphs numbered from 0 by path and place.

    The numbers come from the counts of the parts, a row for each. Where gid is not used, nothing is counted and nothing
    joined: the files are read once, and no text is shuffled or written.
    """
    rows = read_records(spark, path, "graph", split_bytes).select("part", "place", "value")
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    counts = read_records(spark, path, "graph", split_bytes, values=False).groupBy(F.col("part").alias("number")).agg(F.count("*").alias("n"))
    counts = counts.select("number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).groupBy("number").agg(F.first("before").alias("before"))  # says that numbers are unique
    return rows.join(counts, F.col("part") == F.col("number"), "left").select((F.col("before") + F.col("place")).alias("gid"), "value")


def itemset_sequences(spark: SparkSession, path: str, strict: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(tran_id, sequence) like text.read_itemset_sequences: a customer whose lines stand apart, or in several files, is one record."""
    rows = read_records(spark, path, "itemset", split_bytes)
    return parse_itemset_lines(rows.select(F.explode(F.split("value", "\n")).alias("value")), strict)
