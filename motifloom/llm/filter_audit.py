"""Audit of how filters interact: what each filter removes after each set of others, for every order of them.

A document's failures are a bit mask. Of n filters a document contributes to the n x 2^(n-1) edges (set of filters applied
already, next filter) of the lattice of sets; with five filters these are 80. Documents are first counted by (part, mask,
labels), so an edge is aggregated from the masks that occur, not from documents. An order of the filters is a path of the
lattice from the empty set to the full one: its steps (600 for all 120 orders of five) are edges, joined to the aggregated
ones. The number of orders that run through an edge weighs it in the Shapley sums.

One filter may be that of exact copies: a document fails it if a smaller doc_id of the whole table, removed or not, has the
same text. Copies meet as digests, added up in each task before the shuffle, so a text that holds a third of all rows is a
row for each task, part and label. Row-local filters are Columns over the text, which is read once and never shuffled.

Null texts count as empty, and empty texts equal each other. A null part is the empty string. Rows that repeat a doc_id are
documents of their own; those of the least doc_id are no copies. A row with a null doc_id is no copy, makes none of others
and has no labels. A doc_id is good (or toxic) if any row of labels says so. Texts of any length are read as wholes inside
the JVM. An empty table gives an empty table. Columns of docs and labels may have any other names beside.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The orders of seven filters are 5,040, of 35,280 steps; beyond that their list is no small table.
MOST_FILTERS = 7
_BLANKS = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _BLANKS), "")


#: The filters of the registered query: from a text that is not null to whether it fails.
FILTERS: dict[str, Callable[[Column], Column]] = {
    "A": lambda t: F.size(_words(t)) < 200,
    "B": lambda t: 100 * F.size(F.array_distinct(_words(t))) < 50 * F.size(_words(t)),
    "C": lambda t: 100 * F.regexp_count(t, F.lit("[A-Z]")) > 3 * F.length(t),
    "D": lambda t: t.rlike(r"[#$%&*|]"),
}


def lattice_edges(names: str) -> list[tuple[int, int, int]]:
    """(mask of the applied set, number of the next filter, orders that run through this edge)."""
    n = len(names)
    sets = [(sum(1 << i for i in chosen), len(chosen)) for size in range(n) for chosen in combinations(range(n), size)]
    return [(mask, f, factorial(size) * factorial(n - 1 - size)) for mask, size in sets for f in range(n) if not mask >> f & 1]


def path_steps(spark: SparkSession, names: str) -> DataFrame:
    """filter_order, step, filter, applied: n x n! rows, each a step of an order and the edge that it is."""
    rows = []
    for order in permutations(range(len(names))):
        applied = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[i] for i in order), step, f, applied))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, applied int")


def failure_masks(docs: DataFrame, filters: dict[str, Callable[[Column], Column]], text: str, doc_id: str, part: str) -> DataFrame:
    """id, part, digest, mask (of the row-local filters) and n: rows that agree in all of them are one row here."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + fails(F.col("text")).cast("int") * F.lit(1 << i)
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    return rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))


def mask_counts(masks: DataFrame, labels: DataFrame, copies_bit: int | None, doc_id: str) -> DataFrame:
    """part, mask, good, toxic, n: how many documents have these failures and labels."""
    said = labels.select(F.col(doc_id).cast("long").alias("own"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")).where(F.col("own").isNotNull())
    said = said.groupBy("own").agg(F.coalesce(F.max("q"), F.lit(False)).alias("q"), F.coalesce(F.max("t"), F.lit(False)).alias("t"))
    rows = masks.join(said, F.col("id") == F.col("own"), "left").select("id", "part", "digest", "mask", "n", F.coalesce("q", F.lit(False)).alias("good"), F.coalesce("t", F.lit(False)).alias("toxic"))
    if copies_bit is None:
        return rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    # equal digests have equal masks; of an id these rows hold one each
    named = F.col("id").isNotNull()
    groups = rows.groupBy("digest", "part", "good", "toxic").agg(
        F.min("mask").alias("mask"), F.sum("n").alias("n"), F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("nameless"),
        F.min("id").alias("least"), F.min_by(F.when(named, F.col("n")), "id").alias("at_least"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    groups = groups.withColumn("firsts", F.col("nameless") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + (1 << copies_bit)).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))
    rows = groups.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.mask", "x.n")
    return rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def edge_counts(counts: DataFrame, names: str) -> DataFrame:
    """Of each part and lattice edge: part, applied, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (of the filter)."""
    edge = F.array(*(F.struct(F.lit(a).alias("applied"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit"), F.lit(w).alias("orders")) for a, f, w in lattice_edges(names)))
    rows = counts.select("part", "mask", "good", "toxic", "n", F.explode(edge).alias("e")).select("part", "mask", "good", "toxic", "n", "e.*")
    here = F.col("mask").bitwiseAND(F.col("applied")) == 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    number = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).alias
    edges = rows.groupBy("part", "applied", "filter", "orders").agg(
        number(here & ~fails)("kept"), number(here & fails)("removed"), number(~here & fails)("redundant"), number(F.col("mask") == F.col("bit"))("unique_fails"),
        number(here & fails & F.col("good"))("good_lost"), number(here & fails & F.col("toxic"))("toxic_lost"),
    )
    return edges.withColumn("shapley", F.sum(F.col("orders") * F.col("removed")).over(Window.partitionBy("part", "filter"))).drop("orders")


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] | None = None, copies: str | None = "E", text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """For each part, order of the filters and step: part, filter_order, step, filter and the counts of that step.

    filters maps one-letter names to conditions on a text; `copies` names the filter of exact copies (None: there is
    none). labels has doc_id, quality and toxic.
    """
    filters = FILTERS if filters is None else filters
    names = "".join(filters) + (copies or "")
    if len(set(names)) != len(filters) + bool(copies) or not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"filters need distinct one-letter names, at most {MOST_FILTERS}: {names}")
    masks = failure_masks(docs, filters, text, doc_id, part)
    edges = edge_counts(mask_counts(masks, labels, len(filters) if copies else None, doc_id), names)
    met = edges.join(F.broadcast(path_steps(docs.sparkSession, names)), ["applied", "filter"])
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    return met.select("part", "filter_order", "step", letter.alias("filter"), *COUNTS)


ORACLE = """
    with recursive p(o) as (select '' union all select o || x from p, (values ('A'), ('B'), ('C'), ('D'), ('E')) v(x) where length(o) < 5 and position(x in o) = 0),
    steps as (select o as filter_order, k::int as step, o[k] as filter, o[1:k - 1] as applied from (select o from p where length(o) = 5), range(1, 6) r(k)),
    t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
    w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words, min(doc_id) over (partition by text) as least from t),
    l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
    d as (select w.doc_id, part, coalesce(good, false) as good, coalesce(l.toxic, false) as toxic,
            case when len(words) < 200 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end
            || case when 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) then 'C' else '' end
            || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end || case when w.doc_id > least then 'E' else '' end as fails
          from w left join l on l.doc_id = w.doc_id),
    s as (select part, filter_order, step, filter, fails, good, toxic, position(filter in fails) > 0 as hit, translate(fails, applied, '') = fails as here from d, steps),
    c as (select part, filter_order, step, filter, count(*) filter (here and not hit) as kept, count(*) filter (here and hit) as removed, count(*) filter (not here and hit) as redundant,
            count(*) filter (fails = filter) as unique_fails, count(*) filter (here and hit and good) as good_lost, count(*) filter (here and hit and toxic) as toxic_lost
          from s group by all)
    select *, (sum(removed) over (partition by part, filter))::bigint as shapley from c
"""
