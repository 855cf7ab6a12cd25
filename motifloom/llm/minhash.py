"""Near-duplicate documents: MinHash with banding, verified links, connected components.

1. Each text becomes its set of word shingles, many universal hash minima of it, and from these bucket numbers (one for
   each band of minima) and a packed signature of one bit for each minimum. An odd sketch of the set (parities of hash
   bins; Mitzenmacher, Pagh and Pham, 2014) stands beside it: two sets differ in at least as many shingles as their
   sketches do in bits, a bound that never rules out a link. Equal sets are one class from here on (a partial aggregate
   on the set's digest), so exact copies cost one row for each task and never meet in pairs.
2. In each bucket every class is paired with a centre only: the member that meets most others over all its buckets,
   which in a group of copies is the text that they derive from, or the one nearest to it. Pairs that sizes and
   sketches leave possible are verified on their full shingle sets; components follow.
3. What may still be linked shares a bucket but not a component. In such buckets the members outside the bucket's
   dominant component meet the others, as far as sizes and sketches leave it possible, and are verified too. So every
   pair that shares a bucket is decided, without expanding a group of copies into its pairs.

The number of bands, their rows and the bound on differing signature bits follow from the threshold (``Plan``): a link at
the threshold shares no bucket with probability ``MISS`` (7e-7) at most, and is ruled out by its signature with
probability ``MISS_BITS`` (1e-8) at most. At 0.8 that makes 36 bands of 5 minima. All links that are kept are exact.

Only the texts of classes in candidate pairs are looked at again; their shingle hashes are written once and travel to
the pairs. Everything else is ids and hashes. Of the folders that a call writes one is left, which the result reads.

Null texts count as empty; a text without words has an empty set and is linked with nothing. With fewer words than a
shingle, the whole sequence is one shingle. Texts of any length are shingled as wholes, one at a time. doc_id names a
document: rows that repeat one are linked if any of their texts is. Rows with a null doc_id get a component of null and
are kept. Components are named by their smallest doc_id, so there are no ties. An empty table gives an empty table;
further columns of docs may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, bounded, materialize, packed, scratch, unpacked
from .components import connected_components

MISS, MISS_BITS = 7e-7, 1e-8
MAX_MINIMA = 224
ODD_BITS = 2048
_LOWER = {c: c + 32 for c in range(65, 91)}
_A = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """Bands, minima in a band, signature bits in which a link may differ."""

    bands: int
    rows: int
    most_bits: int

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def longs(self) -> int:
        """Longs of a signature."""
        return -(-self.minima // 64)


@lru_cache(maxsize=16)
def plan(threshold: float) -> Plan:
    """The bands with the most rows that MAX_MINIMA leaves room for, as many as MISS asks for. Refuses thresholds below 0.3 or above 1."""
    if not 0.3 <= threshold <= 1:
        raise ValueError("the threshold must lie between 0.3 and 1")
    best = Plan(0, 0, 0)
    for rows in range(1, 11):
        share = min(threshold**rows, 1 - 1e-9)
        bands = math.ceil(math.log(MISS) / math.log1p(-share))
        if bands * rows <= MAX_MINIMA or not best.bands:
            best = Plan(bands, rows, 0)
    n, p = best.minima, (1 - threshold) / 2
    tail, most = 1.0, -1
    while tail > MISS_BITS and most < n:
        most += 1
        tail -= math.comb(n, most) * p**most * (1 - p) ** (n - most)
    return Plan(best.bands, best.rows, most)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of shingle hashes (64 bits)."""

    def __init__(self, words: int):
        self.words = words
        self.memo: dict[str, int] = {}

    def hashes(self, text: str) -> np.ndarray:
        found = WORD.findall(text)
        memo = self.memo
        if len(memo) > 150_000:
            memo.clear()
        for w in set(found).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w.translate(_LOWER).encode("utf-8", "replace"))
        own = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
        size = min(self.words, len(own))
        if not size:
            return own
        value = np.full(len(own) - size + 1, np.uint64(size))
        for k in range(size):
            value = value * _A + own[k : len(own) - size + 1 + k]
        return np.unique(_mix(value))


class MinHasher:
    """Minima of (a x + b) mod 2^64, upper half, for random a and b: 2-universal on 32-bit x."""

    def __init__(self, plan: Plan, seed: int = 1, chunk: int = 512):
        rng = np.random.default_rng(seed)
        n, self.plan = plan.minima, plan
        self.a = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
        self.weights = rng.integers(0, 2**63, plan.rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = _mix(np.arange(1, plan.bands + 1, dtype=np.uint64))
        self.chunk = chunk

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = shingles >> np.uint64(32)
        least = np.full(len(self.a), np.iinfo(np.uint64).max)
        for at in range(0, len(x), self.chunk):
            v = self.a[:, None] * x[None, at : at + self.chunk]
            v += self.b[:, None]
            least = np.minimum(least, v.min(axis=1) >> np.uint64(32))
        return least

    def bands(self, minima: np.ndarray) -> np.ndarray:
        rows = minima.reshape(self.plan.bands, self.plan.rows)
        value = self.salt.copy()
        for k in range(self.plan.rows):
            value = _mix(value + rows[:, k] * self.weights[k])
        return value.view(np.int64)

    def bits(self, minima: np.ndarray) -> np.ndarray:
        """The signature: a bit for each minimum, in longs."""
        packed = np.packbits((minima & np.uint64(1)).astype(bool))
        return np.concatenate([packed, np.zeros(8 * self.plan.longs - len(packed), np.uint8)]).view(np.int64)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles & np.uint64(ODD_BITS - 1)).astype(np.int64), minlength=ODD_BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


_LONGS = pa.list_(pa.int64())
SKETCH = pa.struct([("n", pa.int64()), ("key", pa.binary()), ("bands", _LONGS), ("bits", _LONGS)])


def sketched(text: Column, words: int, plan: Plan) -> Column:
    """A struct of the set's size, its digest, bucket numbers, and signature and odd sketch in one array."""

    @F.arrow_udf("n long, key binary, bands array<long>, bits array<long>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler, hasher = Shingler(words), MinHasher(plan)
        recent: dict[bytes, tuple] = {}
        for batch in batches:
            rows = []
            for x in batch:
                shingles = shingler.hashes(x.as_py() or "")
                if not len(shingles):
                    rows.append((0, None, None, None))
                    continue
                key = xxhash.xxh3_128_digest(shingles.tobytes())
                if key not in recent:
                    if len(recent) > 10_000:
                        recent.clear()
                    minima = hasher.minima(shingles)
                    recent[key] = hasher.bands(minima), np.concatenate([hasher.bits(minima), odd_sketch(shingles)])
                rows.append((len(shingles), key, *recent[key]))
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SKETCH, strict=True)] if rows else [pa.array([], f.type) for f in SKETCH], fields=list(SKETCH))

    return sketch(text)


def shingled(text: Column, words: int) -> Column:
    """The sorted shingle hashes of a text, as bytes."""

    @F.arrow_udf("binary")
    def shingle(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler = Shingler(words)
        for batch in batches:
            yield pa.array([shingler.hashes(x.as_py() or "").tobytes() for x in batch], pa.binary())

    return shingle(text)


def _differing(first: int, last: int) -> Column:
    """Bits in which the longs from first to before last of s1 and s2 differ."""
    return sum((F.bit_count(F.col("s1")[k].bitwiseXOR(F.col("s2")[k])) for k in range(first + 1, last)), F.bit_count(F.col("s1")[first].bitwiseXOR(F.col("s2")[first])))


def _could_link(threshold: float) -> Column:
    """Sizes, signatures and odd sketches of a pair (n1, s1, n2, s2) do not rule the similarity out."""
    percent, p = round(100 * threshold), plan(threshold)
    near = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent
    few = _differing(p.longs, p.longs + ODD_BITS // 64) * (100 + percent) <= (F.col("n1") + F.col("n2")) * (100 - percent)
    return near & (_differing(0, p.longs) <= p.most_bits) & few


def _verified(pairs: DataFrame, docs: DataFrame, words: int, threshold: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Those of pairs (x, y of class representatives) whose full shingle sets are similar enough.

    The ids of candidates are broadcast to the texts where they are few; beyond that the texts meet them in a join.
    """
    percent = round(100 * threshold)
    needed = keep(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct())
    # a doc_id that several rows have stands for each of their texts
    sets = keep(docs.join(bounded(needed), docs["_id"] == needed["id"], "left_semi").select("_id", shingled(F.col("_text"), words).alias("set")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            columns = [batch.column(c) for c in ("x", "y", "sx", "sy")]
            for i in range(batch.num_rows):
                x, y = columns[0][i].as_py(), columns[1][i].as_py()
                a, b = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in columns[2:])
                both = len(np.intersect1d(a, b, assume_unique=True))
                if len(a) and 100 * both >= percent * (len(a) + len(b) - both):
                    xs.append(x)
                    ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    left = pairs.join(sets.select(F.col("_id").alias("x"), F.col("set").alias("sx")), "x")
    full = left.join(sets.select(F.col("_id").alias("y"), F.col("set").alias("sy")), "y")
    return keep(full.select("x", "y", "sx", "sy").mapInArrow(verify, "x long, y long"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id that links reach), kept."""
    with scratch(docs.sparkSession) as keep:
        return materialize(_near_duplicates(docs, words, threshold, text, doc_id, keep))


def _near_duplicates(docs: DataFrame, words: int, threshold: float, text: str, doc_id: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    docs = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows = docs.select("_id", sketched(F.col("_text"), words, plan(threshold)).alias("s")).select("_id", "s.*")
    rows = keep(rows)
    classes = keep(rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")))
    nodes = classes.where(F.col("rep").isNotNull())
    sizes = nodes.select("rep", "n", "bits")

    members = nodes.select("rep", F.explode("bands").alias("bucket"))
    # small tables by bucket are written before they are joined, so that a hot bucket's other side can be split
    sizes_of = keep(members.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1))
    shared = keep(members.join(sizes_of, "bucket"))
    popular = shared.groupBy("rep").agg(F.sum("size").alias("popularity"))
    best = F.max(F.struct("popularity", (-F.col("rep")).alias("r")))["r"]
    centres = keep(shared.join(popular, "rep").groupBy("bucket").agg((-best).alias("centre")))
    shared = keep(shared.join(centres, "bucket").select("bucket", "rep", "centre"))

    tried = shared.where(F.col("rep") != F.col("centre")).select(F.col("rep").alias("x"), F.col("centre").alias("y")).distinct()
    tried = tried.join(sizes.select(F.col("rep").alias("x"), F.col("n").alias("n1"), F.col("bits").alias("s1")), "x").join(sizes.select(F.col("rep").alias("y"), F.col("n").alias("n2"), F.col("bits").alias("s2")), "y")
    tried = keep(tried.where(_could_link(threshold)).select("x", "y"))
    first = connected_components(_verified(tried, docs, words, threshold, keep), write=keep)

    label = F.coalesce(F.col("component"), F.col("rep"))
    placed = shared.select("bucket", "rep").join(first, F.col("rep") == F.col("node"), "left").select("bucket", "rep", label.alias("component"))
    spread = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") != F.col("high")).select("bucket")
    spread = keep(spread)
    mixed = keep(placed.join(spread, "bucket", "left_semi"))
    counted = mixed.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    main = keep(counted.groupBy("bucket").agg(F.max(F.struct("size", "component"))["component"].alias("main")))
    full = keep(mixed.join(main, "bucket").join(sizes, "rep"))
    one = full.where(F.col("component") != F.col("main")).select("bucket", F.col("rep").alias("x"), F.col("component").alias("c1"), F.col("n").alias("n1"), F.col("bits").alias("s1"))
    two = full.select(F.col("bucket").alias("b2"), F.col("rep").alias("y"), F.col("component").alias("c2"), F.col("n").alias("n2"), F.col("bits").alias("s2"), "main")
    # of two members outside the dominant component each pair is met once
    meets = (F.col("bucket") == F.col("b2")) & (F.col("c1") != F.col("c2")) & ((F.col("c2") == F.col("main")) | (F.col("x") < F.col("y"))) & _could_link(threshold)
    left_over = one.join(two, meets).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    seen = tried.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    late = _verified(keep(left_over.join(seen, ["x", "y"], "left_anti")), docs, words, threshold, keep)
    named = late
    for end in ("x", "y"):
        own = first.select(F.col("node").alias(end), F.col("component").alias("c"))
        named = named.join(own, end, "left").withColumn(f"c{end}", F.coalesce("c", F.col(end))).drop("c")
    second = connected_components(named.select("cx", "cy"), write=keep).select(F.col("node").alias("node2"), F.col("component").alias("component2"))

    final = nodes.select("key", "rep").join(first, F.col("rep") == F.col("node"), "left").withColumn("c", label).join(second, F.col("c") == F.col("node2"), "left")
    final = final.select(F.col("key").alias("class"), F.coalesce("component2", "c").alias("component_id"))
    found = rows.select("_id", "n", "key").join(final, F.col("key") == F.col("class"), "left")
    component = F.when(F.col("key").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return found.select(F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("_id").isNull() | (F.col("_id") == component)).alias("kept"))


def representatives(docs: DataFrame, words: int = 5, threshold: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs with the smallest doc_id of each component, with all their columns.

    The ids that go are broadcast to the texts where they are few; beyond that the texts meet them in a join.
    """
    gone = near_duplicates(docs, words, threshold, text, doc_id).where(~F.col("kept")).select(F.col(doc_id).cast("long").alias("gone"))
    return unpacked(packed(docs, own_id=F.col(doc_id).cast("long")).join(bounded(gone), F.col("own_id") == F.col("gone"), "left_anti"))
