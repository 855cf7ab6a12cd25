"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Targets are shares of all sizes by weight, where none exceeds ``max_copies`` times its source's size; the excess is
reshared by weight until none is above. The final shares are one water level: sources ordered by capacity over weight
are filled to capacity as long as the level of the others is above it, which one pass of running sums over the (small,
aggregated) table of sources decides.

A document is wanted target / source_size times: the whole part is certain, the fraction is a probability. Two
documents' fractions are paired and mass (fraction times size) is moved from one to the other at random, with expected
values kept, until one of them is 0 or 1; the other carries on. Chunks of about ``chunk`` documents are folded like this
in one task each; the at most one fractional document that a chunk leaves goes up to the next level of a tree with
``chunk``-fold fan-in. The mass of a source never changes until its last document, whose fraction goes to the nearer
side, so the words taken differ from the target by at most half that document's size (and what float addition loses).
Chunks are folded from their largest documents down, which leaves a small one last where there are enough to settle.

All draws are hashes of the seed, the level and the two ids: reruns agree and do not depend on partitioning. No source
is ever gathered in one task: chunks are dealt by a hash of the id, also in the largest source.

Null texts have size 0. Documents of size 0 are never taken. A null source is a source of its own, ordered last; sources
that tie in capacity over weight are ordered by name, which their targets do not depend on. Rows that repeat (source, doc_id, size) share one draw, weighted by
their number. Texts of any length are counted as wholes inside the JVM. An empty table gives an empty table; further
columns of docs may have any names. Of the folders that a call writes one is left, which the result reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, WORD_PATTERN, bounded, materialize, packed, scratch, unpacked

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
#: A chunk is a hash bucket; its number of rows spreads like a Poisson variable around this mean.
CHUNK = 512
#: The running sums over sources are one task's work.
MAX_SOURCES = 1_000_000


def text_size(text: str) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """From rows of source and size: source, n_docs, source_size, target, rate."""
    return _targets(source_totals(sizes), weights, max_copies)


def source_totals(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))


def _targets(totals: DataFrame, weights: tuple[float, ...], max_copies: int) -> DataFrame:
    """The windows run over the table of totals, a row for each source, not over documents."""
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (at + 1).cast("int"))
    capacity = F.col("source_size") * F.lit(float(max_copies))
    t = totals.withColumn("weight", weight).withColumn("full", capacity / F.col("weight"))
    order = Window.orderBy("full", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("weights", F.sum("weight").over(everything))
    level = (F.col("total") - F.coalesce(F.sum(capacity).over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", level).withColumn("place", F.row_number().over(order)).withColumn("open", F.col("level") <= F.col("full"))
    # the first source, in the order of the running sums, that its level does not fill sets the level of all from there on
    t = t.withColumn("final", F.min_by("level", F.when(F.col("open"), F.col("place"))).over(everything))
    # the level only rises while sources are filled, so those before are full at the final level too
    target = F.least(F.col("weight") * F.col("final"), capacity)
    t = t.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(target))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_copies)))).otherwise(0.0)
    return t.select("source", "n_docs", "source_size", "target", rate.alias("rate"))


def _draw(*parts: Column) -> Column:
    """A number from 0 to below 1 that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _fold(rows: Column, level: int, seed: int) -> Column:
    """Pairs the carried document with each of rows in turn; `done` gets those whose copies are decided."""

    def step(state: Column, new: Column) -> Column:
        old = state["carry"]
        p, q = old["p"], new["p"]
        # mass moves in units of each document's own size: up sends it to `old`, down to `new`
        up = F.least(1.0 - p, q * new["w"] / old["w"])
        down = F.least(p, (1.0 - q) * new["w"] / old["w"])
        raise_old = _draw(F.lit(seed), F.lit(level), old["id"], new["id"]) * (up + down) < down
        p2 = F.when(raise_old, p + up).otherwise(p - down)
        q2 = F.when(raise_old, q - up * old["w"] / new["w"]).otherwise(q + down * old["w"] / new["w"])
        old_ends = F.when(raise_old, 1.0 - p <= q * new["w"] / old["w"]).otherwise(p <= (1.0 - q) * new["w"] / old["w"])
        ended = F.when(old_ends, F.struct(old["id"].alias("id"), old["w"].alias("w"), F.when(raise_old, 1).otherwise(0).alias("extra"))).otherwise(
            F.struct(new["id"].alias("id"), new["w"].alias("w"), F.when(raise_old, 0).otherwise(1).alias("extra"))
        )
        carry = F.when(old_ends, F.struct(new["id"].alias("id"), new["w"].alias("w"), q2.alias("p"))).otherwise(F.struct(old["id"].alias("id"), old["w"].alias("w"), p2.alias("p")))
        return F.struct(carry.alias("carry"), F.concat(state["done"], F.array(ended)).alias("done"))

    none = F.array().cast("array<struct<id:string,w:double,extra:int>>")
    return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), F.struct(rows[0].alias("carry"), none.alias("done")), step)


def rounded(units: DataFrame, n_units: int, seed: int = 0, chunk: int = CHUNK, write: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """Rounds units (source, id string, w > 0, p in (0, 1), n: at least the units of its source): source, id, extra (0 or 1).

    n_units is the largest n; it sets the height of the tree. About `chunk` units of each source, chosen by hash, wait
    for the root, so that the large documents that tend to be left over still find others to settle with.
    """
    # doubles: a product of longs would pass 2^63 in sources of many rows
    waiting = F.pmod(F.xxhash64(F.lit(seed), F.lit("root"), "id"), F.lit(1 << 40)).cast("double") * F.col("n").cast("double") < F.lit(float(chunk * (1 << 40)))
    root = units.where(waiting)
    units = units.where(~waiting)
    level, decided, most = 0, [], max(1, n_units)
    while True:
        last = most <= chunk
        units = (units.unionByName(root) if last else units).withColumn("n", F.ceil(F.col("n") / F.lit(chunk)).cast("long"))
        most = -(-most // chunk)
        dealt = units.withColumn("chunk", F.lit(0).cast("long") if last else F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "id"), F.col("n")))
        # large documents first: what carries on at the end of a chunk is then likely small
        order = F.struct((-F.col("w")).alias("o"), F.xxhash64(F.lit(seed), "id").alias("h"), "id", "w", "p")
        rows = F.transform(F.array_sort(F.collect_list(order)), lambda x: F.struct(x["id"].alias("id"), x["w"].alias("w"), x["p"].alias("p")))
        folded = dealt.groupBy("source", "chunk").agg(rows.alias("rows"), F.max("n").alias("n"))
        folded = write(folded.select("source", "n", _fold(F.col("rows"), level, seed).alias("f")))
        decided.append(folded.select("source", F.explode("f.done").alias("d")).select("source", "d.id", "d.extra"))
        units = folded.select("source", "f.carry.id", "f.carry.w", "f.carry.p", "n")
        if last:
            break
        level += 1
    end = F.when(F.col("p") >= 0.5, 1).otherwise(0)
    decided.append(units.select("source", "id", end.alias("extra")))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """For each row of docs: doc_id, source, size, source_size, target, copies, taken (copies times size)."""
    with scratch(docs.sparkSession) as keep:
        return materialize(_mixed(docs, text, doc_id, source, weights, max_copies, seed, chunk, keep))


def _mixed(docs: DataFrame, text: str, doc_id: str, source: str, weights: tuple[float, ...], max_copies: int, seed: int, chunk: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    sized = keep(docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("source"), text_size(text).alias("size")))
    totals = keep(source_totals(sized))
    if totals.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    targets = keep(_targets(totals, weights, max_copies))
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    rows = sized.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    key = F.concat_ws("/", F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.col("size").cast("string"))
    rows = rows.withColumn("_key", key).withColumn("_whole", F.floor("rate")).withColumn("_part", F.col("rate") - F.floor("rate"))
    units = rows.where((F.col("size") > 0) & (F.col("_part") > 0)).groupBy("source", F.col("_key").alias("id")).agg(F.sum("size").cast("double").alias("w"), F.max("_part").alias("p"), F.max("n_docs").alias("n"))
    extra = rounded(units, largest, seed, chunk, keep).select(F.col("source").alias("_s"), F.col("id").alias("_k"), "extra")
    found = rows.join(extra, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_k")), "left")
    copies = F.when(F.col("size") > 0, F.col("_whole") + F.coalesce("extra", F.lit(0))).otherwise(0).cast("long")
    return found.select(F.col("_id").alias(doc_id), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def resampled(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns. Rows that are taken 0 times go.

    The copies of each document are broadcast to the texts where they are few; beyond that the texts meet them in a join.
    Words are counted again only for documents that share id and source but not the size.
    """
    taken = mixed(docs, text, doc_id, source, **options)
    copies = taken.groupBy(F.col(doc_id).alias("id2"), F.col("source").alias("source2")).agg(F.max("copies").cast("int").alias("n"), (F.min("size") != F.max("size")).alias("several"))
    copies = materialize(copies.where(F.col("n") > 0))
    rows = packed(docs, id1=F.col(doc_id), source1=F.col(source), text1=F.col(text))
    same = F.col("id1").eqNullSafe(F.col("id2")) & F.col("source1").eqNullSafe(F.col("source2"))
    met = rows.join(bounded(copies, BROADCAST_ROWS // 2), same)
    repeat = F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")
    plain = met.where(~F.col("several")).select("row", repeat).select("row")
    if copies.where("several").isEmpty():
        return unpacked(plain)
    by_size = taken.where(F.col("copies") > 0).groupBy(F.col(doc_id).alias("id3"), F.col("source").alias("source3"), F.col("size").alias("size3")).agg(F.max("copies").cast("int").alias("n"))
    odd = met.where("several").select("row", "id1", "source1", text_size("text1").alias("size1"))
    same = F.col("id1").eqNullSafe(F.col("id3")) & F.col("source1").eqNullSafe(F.col("source3")) & (F.col("size1") == F.col("size3"))
    return unpacked(plain.unionByName(odd.join(by_size, same).select("row", repeat).select("row")))
