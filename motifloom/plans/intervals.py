"""Patterns as intervals of a preorder: what lies below a pattern is a range of numbers.

Sorted as arrays, patterns stand in preorder: what begins with a pattern follows it without a gap. So a pattern and all that
begin with it are the numbers from `begin` to before `end`, a is a prefix of b if begin(a) <= begin(b) < end(a), and nobody
has to list the prefixes of each pattern. The set need not hold the prefixes of its patterns.

A range partitioning sorts the patterns; each partition is read once, as a stream, with a stack no higher than its longest
pattern. What crosses partitions follows from a row for each of them (its ends and that stack), which one small task goes
through in order. Equal patterns lie inside each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from motifloom.plans.checkpoints import written

_ENTRY = "struct<common:int,at:long>"


def common(a: list, b: list) -> int:
    """Length of the longest common prefix."""
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return i
    return min(len(a), len(b))


def _push(stack: list[tuple[int, int]], entry: tuple[int, int]) -> None:
    """The nearest entries are on top; a farther one stays only while it has less in common than all nearer ones."""
    while stack and stack[-1][0] >= entry[0]:
        stack.pop()
    stack.append(entry)


def _sorted(patterns: DataFrame, *order: Column, by: Column) -> DataFrame:
    return patterns.repartitionByRange(by).sortWithinPartitions(*order).select(*patterns.columns, F.spark_partition_id().alias("_part"))


def _kinds(frame: DataFrame) -> dict[str, tuple[str, pa.DataType]]:
    return {f.name: (f.dataType.simpleString(), to_arrow_type(f.dataType)) for f in frame.schema.fields}


def _schema(kinds: dict[str, tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"`{n}` {k[0]}" for n, k in kinds.items())


def _row(kinds: dict[str, tuple[str, pa.DataType]], **values) -> pa.RecordBatch:
    """One row; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], k[1]) for n, k in kinds.items()], names=list(kinds))


_STACK = pa.list_(pa.struct([("common", pa.int32()), ("at", pa.int64())]))


def preorder(patterns: DataFrame, key: str = "pattern") -> DataFrame:
    """patterns with depth, begin and end: those that begin with a pattern, itself included, have numbers from its begin to before its end."""
    ranged = _sorted(patterns, F.desc(key), by=F.col(key))
    base = _kinds(ranged)
    pattern_kind = base[key]
    kinds = base | {"_at": ("bigint", pa.int64()), "_next": ("bigint", pa.int64()), "_n": ("bigint", pa.int64()), "_first": pattern_kind, "_last": pattern_kind, "_stack": (f"array<{_ENTRY}>", _STACK)}

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the last pattern of a partition to its first. `_at` counts from the end, `_next` is the first pattern that does not begin with this one."""
        stack: list[tuple[int, int]] = []
        after, last, n, part = None, None, 0, None
        for batch in batches:
            ends = []
            for k, x in enumerate(batch.column(key).to_pylist()):
                if after is None:
                    last = x
                else:
                    _push(stack, (common(x, after), n + k - 1))
                ends.append(next((at for held, at in reversed(stack) if held < len(x)), None))
                after = x
            rows, part = batch.num_rows, batch.column("_part")[0].as_py() if batch.num_rows else part
            extra = [pa.array(range(n, n + rows), pa.int64()), pa.array(ends, pa.int64()), *(pa.nulls(rows, kinds[c][1]) for c in ("_n", "_first", "_last", "_stack"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=list(kinds))
            n += rows
        if n:
            yield _row(kinds, _part=part, _n=n, _first=after, _last=last, _stack=[{"common": c, "at": a} for c, a in stack])

    made = written(ranged.mapInArrow(backwards, _schema(kinds)))
    edge = {"_own": ("int", pa.int32()), "_start": ("bigint", pa.int64()), "_rows": ("bigint", pa.int64()), "_total": ("bigint", pa.int64()), "_later": (f"array<{_ENTRY}>", _STACK)}

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the last partition to the first: where each begins, and where what is open at its end can end."""
        rows = [r for b in batches for r in b.to_pylist()]
        start, stack, following = sum(r["_n"] for r in rows), [], None
        total = start
        for r in rows:
            start -= r["_n"]
            if following is not None:
                _push(stack, (common(r["_last"], following[0]), following[1]))
            yield _row(edge, _own=r["_part"], _start=start, _rows=r["_n"], _total=total, _later=[{"common": c, "at": a} for c, a in reversed(stack)])
            for e in r["_stack"]:
                _push(stack, (e["common"], start + r["_n"] - 1 - e["at"]))
            following = r["_first"], start

    edges = made.where(F.col("_n").isNotNull()).select("_part", "_n", "_first", "_last", "_stack").coalesce(1).sortWithinPartitions(F.desc("_part"))
    edges = written(edges.mapInArrow(across, _schema(edge)))
    rows = made.where(F.col("_n").isNull()).join(F.broadcast(edges), F.col("_part") == F.col("_own"))  # a short row for each partition
    depth = F.size(key)
    number = lambda at: F.col("_start") + F.col("_rows") - 1 - F.col(at)
    later = F.get(F.filter("_later", lambda e: e["common"] < depth), F.lit(0))["at"]
    end = F.when(F.col("_next").isNotNull(), number("_next")).otherwise(F.coalesce(later, F.col("_total")))
    return rows.select(*patterns.columns, depth.alias("depth"), number("_at").alias("begin"), end.alias("end"))


def nearest_prefix(rows: DataFrame, chosen: Column, key: str = "pattern", itself: bool = False, name: str = "nearest") -> DataFrame:
    """rows with the longest proper prefix of each pattern that is a chosen row's; with itself, a chosen row's equal pattern is one too. Null if there is none."""
    flagged = rows.select("*", F.coalesce(chosen, F.lit(False)).alias("_chosen"))
    ranged = _sorted(flagged, F.asc(key), F.desc("_chosen"), by=F.col(key))
    base = _kinds(ranged)
    kind = base[key]
    lists = (f"array<{kind[0]}>", pa.list_(kind[1]))
    kinds = base | {"_near": kind, "_n": ("bigint", pa.int64()), "_first": kind, "_stack": lists}

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chosen patterns that a pattern begins with are a stack: what it does not begin with, no later one does."""
        stack: list[list] = []
        first, n, part = None, 0, None
        for batch in batches:
            found = []
            for x, is_chosen in zip(batch.column(key).to_pylist(), batch.column("_chosen").to_pylist(), strict=True):
                first = x if first is None else first
                while stack and common(stack[-1], x) < len(stack[-1]):
                    stack.pop()
                same = bool(stack) and len(stack[-1]) == len(x)
                if is_chosen and not same:
                    stack.append(x)
                    same = True
                found.append(stack[-1] if stack and (itself or not same) else stack[-2] if same and not itself and len(stack) > 1 else None)
            rows_, part = batch.num_rows, batch.column("_part")[0].as_py() if batch.num_rows else part
            extra = [pa.array(found, kind[1]), *(pa.nulls(rows_, kinds[c][1]) for c in ("_n", "_first", "_stack"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=list(kinds))
            n += rows_
        if n:
            yield _row(kinds, _part=part, _n=n, _first=first, _stack=stack)

    made = written(ranged.mapInArrow(forwards, _schema(kinds)))
    edge = {"_own": ("int", pa.int32()), "_before": lists}

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chosen patterns of earlier partitions that a partition's first pattern, and so any of its patterns, may begin with: shortest first."""
        held: list[list] = []
        for r in (r for b in batches for r in b.to_pylist()):
            held = [x for x in held if common(x, r["_first"]) == len(x)]
            yield _row(edge, _own=r["_part"], _before=held)
            held = held + r["_stack"]

    edges = made.where(F.col("_n").isNotNull()).select("_part", "_first", "_stack").coalesce(1).sortWithinPartitions("_part")
    edges = written(edges.mapInArrow(across, _schema(edge)))
    out = made.where(F.col("_n").isNull()).join(F.broadcast(edges), F.col("_part") == F.col("_own"))  # a short row for each partition
    fits = F.filter("_before", lambda c: (F.slice(F.col(key), F.lit(1), F.size(c)) == c) & ((F.size(c) < F.size(key)) | F.lit(itself)))
    carried = F.get(F.reverse(fits), F.lit(0))
    return out.select(*rows.columns, F.coalesce("_near", carried).alias(name))
