"""Hard negatives: for each anchor and each of its positives, the best-scored rows of another label below the positive.

Scores are integer inner products: a component x counts as floor(scale * x). Higher scores come first, ties by smaller id.
Anchors are a stated set of query rows; they meet all rows in blocks. Rows and anchors are dealt by a hash of their id into
blocks of bounded size, and a task takes one block of rows with one of anchors at a time, so what it holds depends on
neither the number of rows nor that of anchors, and no label or vector that many rows share makes a large group. Two passes:

1. Each block's scores are sorted for each anchor, and the first rows of the anchor's own label go on; the first
   ``positives`` over all blocks are the anchor's positives.
2. The block's scores are sorted again, in whole, by score and id. The place where a positive's upper limit begins is found
   by binary search among the rows of other labels, and ``negatives`` of them above the lower limit are read from there.
   The first ``negatives`` over all blocks are the result: what is among the first of all rows is among those of its block.

Rows with a null id, label or vector, or a null or non-finite component take no part. Of several rows of one id the least
by label and vector counts. A label that is replaced (``relabel``) is so before anything else. Vectors of different lengths
are compared as if the shorter one ended in zeros. Scores beyond 2^63 raise. Negative and zero scores are scores like
others; a limit that its positive's sign turns around leaves no rows. An anchor without other rows of its label, or a
positive without rows between its limits, has no row in the result. Empty tables give an empty table. Other columns of the
table are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, scratch

#: Rows and anchors of a block (about): their scores, 8 bytes each, are worked out for some anchors at a time.
ROW_BLOCK, ANCHOR_BLOCK = 16_384, 4_096
#: Scores that are held at once.
HELD = 1 << 22


def usable(rows: DataFrame, vec_id: str, vector: str, label: str, relabel: Callable[[Column, Column], Column] | None) -> DataFrame:
    """id, label, vec: the rows that take part, one for each id."""
    kind = "array<float>" if rows.select(vector).dtypes[0][1] == "array<float>" else "array<double>"
    of = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast(kind).alias("vec"))
    whole = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    of = of.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & whole)
    if relabel is not None:
        of = of.withColumn("label", relabel(F.col("id"), F.col("label")))
    return of.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec")


def _matrix(vectors: pa.Array, scale: float) -> np.ndarray:
    """floor(scale x) as whole doubles, rows padded with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles hold them exactly below 2^53, longs below 2^63."""
    width = min(anchors.shape[1], rows.shape[1])
    a, r = anchors[:, :width], rows[:, :width]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(r).max(initial=0)) * max(width, 1)
    if most < 1 << 53:
        return (a @ r.T).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ r.T.astype(np.int64)
    exact = np.array([[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in r] for u in a], object).reshape(len(a), len(r))
    if any(abs(x) >= 1 << 63 for x in exact.ravel()):
        raise OverflowError("a score is beyond 2^63")
    return exact.astype(np.int64)


def _by_anchor(anchors: pa.Table, rows: pa.Table, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each anchor (its place): the places of the block's rows by score, highest first, ties by id, and their scores."""
    left, right, ids = _matrix(anchors["vec"], scale), _matrix(rows["vec"], scale), rows["id"].to_numpy()
    step = max(1, HELD // max(1, len(ids)))
    for begin in range(0, len(left), step):
        for k, row in enumerate(scores(left[begin : begin + step], right), begin):
            order = np.lexsort((ids, -row))
            yield k, order, row[order]


def first_positives(anchors: pa.Table, rows: pa.Table, scale: float, most: int) -> pa.Table:
    """The block's first rows of each anchor's own label, the anchor left out."""
    own, label, ids, names = rows["label"].to_numpy(), anchors["label"].to_numpy(), rows["id"].to_numpy(), anchors["id"].to_numpy()
    out = []
    for k, order, score in _by_anchor(anchors, rows, scale):
        at = np.flatnonzero((own[order] == label[k]) & (ids[order] != names[k]))[:most]
        out += zip([names[k]] * len(at), ids[order[at]], score[at], strict=True)
    columns = list(zip(*out, strict=True)) or [()] * 3
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "positive_id", "positive_score"])


def limits(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the largest integer s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def first_negatives(anchors: pa.Table, rows: pa.Table, scale: float, most: int, low: int, high: int) -> pa.Table:
    """The block's first rows of other labels between each positive's limits. anchors has positives: a list of (id, score)."""
    own, label, ids, names = rows["label"].to_numpy(), anchors["label"].to_numpy(), rows["id"].to_numpy(), anchors["id"].to_numpy()
    positives, out = anchors["positives"].to_pylist(), []
    for k, order, score in _by_anchor(anchors, rows, scale):
        other = own[order] != label[k]
        order, falling = order[other], -score[other]
        for p in positives[k]:
            least, largest = limits(p["positive_score"], low, high)
            begin = int(np.searchsorted(falling, -largest, "left"))
            end = min(begin + most, int(np.searchsorted(falling, -least, "right")))
            out += ((names[k], p["positive_id"], p["positive_score"], ids[order[i]], -falling[i]) for i in range(begin, end))
    columns = list(zip(*out, strict=True)) or [()] * 5
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def hard_negatives(rows: DataFrame, anchor: Callable[[Column], Column], vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", relabel: Callable[[Column, Column], Column] | None = None, scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor is the condition on ids that makes a row an anchor; relabel gives the label of an id and its label. A negative
    has low * positive_score <= 100 * negative_score <= high * positive_score; rank counts from 1.
    """
    with scratch(rows.sparkSession) as keep:
        known = keep(usable(rows, vec_id, vector, label, relabel))
        queries = keep(known.where(anchor(F.col("id"))))
        n_rows, n_anchors = known.count(), queries.count()
        # each row goes to every block of anchors, each anchor to every block of rows
        across, down = max(1, -(-n_anchors // anchor_block)), max(1, -(-n_rows // row_block))
        block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        all_rows = known.select(each(across).alias("a"), block(down).alias("r"), "id", "label", "vec").groupBy("a", "r")
        asked = queries.select(block(across).alias("a"), each(down).alias("r"), "id", "label", "vec")

        found = asked.groupBy("a", "r").cogroup(all_rows).applyInArrow(lambda x, y: first_positives(x, y, scale, positives), "anchor_id long, positive_id long, positive_score long")
        best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        chosen = found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= positives)
        chosen = keep(chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")))

        asked = asked.join(chosen, F.col("id") == F.col("anchor_id")).select("a", "r", "id", "label", "vec", "positives")
        made = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
        found = asked.groupBy("a", "r").cogroup(all_rows).applyInArrow(lambda x, y: first_negatives(x, y, scale, negatives, low, high), made)
        best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
        return materialize(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


ORACLE = """
    with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
               from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as own, list_inner_product(a.v, b.v)::bigint as score from r a, r b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
    p as (select anchor_id, id as positive_id, score as positive_score from s where own qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
    select anchor_id, positive_id, (row_number() over w)::int as rank, id as negative_id, positive_score, score as negative_score
    from p join s using (anchor_id) where not own and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
    window w as (partition by anchor_id, positive_id order by score desc, id) qualify row_number() over w <= 3
"""
