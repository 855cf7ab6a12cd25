"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of one to three characters for each language over a bounded, hash-chosen sample of
labelled rows (``max_docs_per_label``, stratified, about that many at most; a language with fewer rows gives them all).
The matrix of log probabilities (buckets x languages; its bytes are checked) is broadcast, and each batch of texts is
scored as a sparse product: the rows of the matrix at the n-grams of a text, summed. The posterior is the score. It
compares the learned languages with each other only, and is near 1 for any text of some words; `known`, where it is asked for
(the pipeline's stage does), says whether the best one fits at all: the share of the text's n-grams that are likelier in it than n-grams are on average. In a script that no
language was learned in only those are that share a bucket with a frequent n-gram.

Text that is null or has no letter is `und` with score and known 0. Upper and lower case count alike, other characters than
letters as a blank. Equal posteriors go to the language that sorts first. With nothing to learn from, all rows are
`und`. Whole texts are scored, long ones in segments that overlap by the n-gram length. Repeated rows give repeated
rows, and count as often as they occur in learning; an empty table gives an empty table. A column of keep that is named
like a result comes back with `_in` appended.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import blocks, packed, unpacked, with_results

ORDERS = (1, 2, 3)
SEGMENT = 1 << 18
GAP = max(ORDERS) - 1
MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    weights: np.ndarray  # float32, buckets + 1 rows (the last is 0), a column for each label
    prior: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    @cached_property
    def table(self) -> np.ndarray:
        """A row for each label's weights, one for each label that is 1 where an n-gram is likelier in a label than n-grams are on average, and a row of 1 where there is an n-gram; once a Python worker."""
        buckets = len(self.weights) - 1
        known = self.weights > -np.log(max(1, buckets))
        known[buckets] = False
        real = np.arange(buckets + 1)[:, None] < buckets
        return np.ascontiguousarray(np.hstack([self.weights, known, real], dtype=np.float32).T)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def _segments(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Runs of about SEGMENT characters of the lower-cased texts: the text of each segment, the segment, and how many of its characters begin n-grams."""
    owner, parts, starts, size = [], [], [], 0
    for i, text in enumerate(texts):
        text = text.lower()  # before anything is counted: some characters become several
        for at in range(0, max(len(text), 1), SEGMENT):
            part = text[at : at + SEGMENT + GAP]
            owner.append(i)
            parts.append(part)
            starts.append(len(part) if at + SEGMENT + GAP >= len(text) and at + SEGMENT >= len(text) else SEGMENT)
            size += len(part) + GAP
            if size >= SEGMENT:
                yield owner, parts, starts
                owner, parts, starts, size = [], [], [], 0
    if parts:
        yield owner, parts, starts


def hashed(parts: list[str], starts: list[int], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram buckets of lower-cased parts (orders x positions, `buckets` where there is no n-gram), where each part begins, and whether it has a letter."""
    gap = " " * GAP
    codes = np.frombuffer((gap.join(parts) + gap).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + GAP
    begins = np.cumsum(lengths) - lengths
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    padded = np.concatenate([codes, np.full(GAP, 32, np.uint32)])
    some = np.concatenate([letter, np.zeros(GAP, bool)])
    out = np.empty((len(ORDERS), len(codes)), np.int64)
    value, any_letter = np.zeros(len(codes), np.uint32), np.zeros(len(codes), bool)
    for order in range(1, max(ORDERS) + 1):
        value = value * MULTIPLIERS[0] + (padded[order - 1 : order - 1 + len(codes)] + np.uint32(order)) * MULTIPLIERS[1]
        any_letter = any_letter | some[order - 1 : order - 1 + len(codes)]
        if order in ORDERS:
            mixed = (value ^ (value >> np.uint32(15))) * MULTIPLIERS[2]
            out[ORDERS.index(order)] = np.where(any_letter, (mixed >> np.uint32(8)) % np.uint32(buckets), buckets)
    for begin, length, n in zip(begins, lengths, starts, strict=True):
        out[:, begin + n : begin + length] = buckets  # no n-gram begins between texts; an overlap is counted with the next segment
    return out, begins, np.logical_or.reduceat(letter, begins)


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", buckets: int = 1 << 16, max_docs_per_label: int = 4000, max_model_bytes: int = 32 << 20, smoothing: float = 0.5) -> LanguageModel:
    """Learns from the rows of labelled with a label. A matrix of labels x buckets beyond max_model_bytes is refused; it bounds what the driver gathers and what is broadcast."""
    max_labels = max_model_bytes // (4 * buckets)
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.xxhash64(F.col(doc_id).cast("string")).alias("h")).where(F.col("label").isNotNull())
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().limit(max_labels + 1).collect()}
    if len(sizes) > max_labels:
        raise ValueError(f"more than {max_labels} labels: their matrix would pass {max_model_bytes} bytes")
    labels = tuple(sorted(sizes))
    if not labels:
        return LanguageModel((), np.zeros((buckets + 1, 0), np.float32), np.zeros(0))
    index = {x: i for i, x in enumerate(labels)}
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int(1_000_000 * min(1.0, max_docs_per_label / n)))))
    sample = rows.where(F.pmod("h", F.lit(1_000_000)) < share[F.col("label")]).select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}  # counts of the labels that this task meets
        for batch in batches:
            own, at = np.array([index[x] for x in batch.column("label").to_pylist()], np.int64), 0
            for block in blocks((x.as_py() for x in batch.column("text")), SEGMENT):
                for owner, parts, starts in _segments(block):
                    grams, begins, _ = hashed(parts, starts, buckets)
                    which = np.repeat(own[at + np.array(owner)], np.diff(np.append(begins, grams.shape[1])))
                    for kind in np.unique(which).tolist():
                        n = np.bincount(grams[:, which == kind].ravel(), minlength=buckets + 1)
                        seen[kind] = seen[kind] + n if kind in seen else n
                at += len(block)
        for kind, total in sorted(seen.items()):
            bucket = np.flatnonzero(total[:buckets])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), kind)), pa.array(bucket), pa.array(total[bucket])], names=["kind", "bucket", "n"])

    counted = sample.mapInArrow(count, "kind long, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((buckets, len(labels)))
    total[counted["bucket"].to_numpy(), counted["kind"].to_numpy()] = counted["n"].to_numpy()
    total += smoothing
    weights = np.zeros((buckets + 1, len(labels)), np.float32)
    weights[:buckets] = np.log(total) - np.log(total.sum(axis=0))
    n = np.array([sizes[x] for x in labels], float)
    return LanguageModel(labels, weights, np.log(n / n.sum()))


def _summed(model: LanguageModel, texts: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of each of rows over a text's n-grams, and which texts have a letter."""
    sums, some = np.zeros((len(texts), len(rows))), np.zeros(len(texts), bool)
    for owner, parts, starts in _segments(texts):
        grams, begins, has = hashed(parts, starts, len(model.weights) - 1)
        for g in grams:
            np.add.at(sums, owner, np.stack([np.add.reduceat(row[g].astype(np.float64), begins) for row in rows], axis=1))
        np.logical_or.at(some, owner, has)
    return sums, some


def _best(model: LanguageModel, sums: np.ndarray, some: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Label, posterior and the label's place."""
    total = model.prior + sums
    best = total.argmax(axis=1)
    posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.labels[i] if s else "und" for i, s in zip(best, some, strict=True)], np.where(some, posterior, 0.0), best


def score(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Label and posterior of each text."""
    if not model.labels:
        return ["und"] * len(texts), np.zeros(len(texts))
    return _best(model, *_summed(model, texts, model.table[: len(model.labels)]))[:2]


def score_and_known(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Label, posterior and share of known n-grams of each text, at about twice the work."""
    if not (width := len(model.labels)):
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    sums, some = _summed(model, texts, model.table)
    labels, posterior, best = _best(model, sums[:, :width], some)
    share = sums[np.arange(len(texts)), width + best] / np.maximum(sums[:, -1], 1)
    return labels, posterior, np.where(some, share, 0.0)


RESULT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("known", pa.float64())])


def predicted(text: Column, model: LanguageModel, spark, known: bool = True) -> Column:
    """A struct of lang_pred, score and, if asked for, known."""
    shared = spark.sparkContext.broadcast(model)
    fields = list(RESULT) if known else list(RESULT)[:2]

    @F.arrow_udf(", ".join(f"{f.name} {'string' if f.type == pa.string() else 'double'}" for f in fields))
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            held: list[list] = [[] for _ in fields]
            for block in blocks((x.as_py() for x in batch), SEGMENT):
                for column, values in zip(held, (score_and_known if known else score)(shared.value, block), strict=True):
                    column += values if isinstance(values, list) else values.tolist()
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(held, fields, strict=True)], fields=fields)
        pa.default_memory_pool().release_unused()  # Python workers live on with other operators

    return predict(text)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), known: bool = False) -> DataFrame:
    """Rows of docs with the columns of keep, lang_pred, score and, if asked for, known."""
    return with_results(docs, keep, predicted(F.col(text), model, docs.sparkSession, known), [f.name for f in RESULT][: 3 if known else 2])


def identified(docs: DataFrame, model: LanguageModel, text: str = "text", min_score: float = 0.3, min_known: float = 0.25) -> DataFrame:
    """The rows of docs whose language is recognised, all columns as they were: with a posterior of at least min_score
    (one-word texts are seldom sure) and at least a share min_known of known n-grams (a third are single letters; in scripts that were not learned few are known, by chance)."""
    rows = packed(docs, language=predicted(F.col(text), model, docs.sparkSession))
    recognised = (F.col("language.lang_pred") != "und") & (F.col("language.score") >= min_score) & (F.col("language.known") >= min_known)
    return unpacked(rows.where(recognised))
