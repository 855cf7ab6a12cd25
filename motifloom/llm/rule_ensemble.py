"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Column expressions.

Statistics of a text (lengths, shares of kinds of characters, variety of words and lines) are Columns, worked out where the
text is read. Learning has three steps on a bounded, hash-chosen sample of labelled rows: a random forest of shallow trees;
every path from a root to a node as a conjunction of bounds on statistics, those that say the same once; a logistic
regression with lasso penalty over the rules as 0/1 features, of which those with a weight of 0 go. What is left is a sum of
`CASE WHEN rule THEN weight`, which Spark compiles: scoring runs in the JVM, row by row, without a shuffle or a model to ship.

The sample has at most about ``max_docs_per_class`` rows of a class, one text for each doc_id; rows of a class that is
sampled weigh more in turn. It is ordered before the forest, so equal tables give equal models. The number of rules follows
from the number and depth of the trees, not from the data.

Null texts count as empty: all their statistics are 0 and they get the score of those. Texts of any length count as wholes.
With labels of one class only, or none, there are no rules, and every text gets the smoothed share of the good ones. A
doc_id with both labels counts for both; of several texts of a sampled doc_id the least by its statistics is learned from.
Repeated rows give repeated rows, an empty table an empty table. A column of keep that is named like a result comes back
with `_in` appended.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded, kept_names, scratch

_BLANKS = r"[\x20\x09-\x0D]+"


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def statistics(text: Column) -> dict[str, Column]:
    """Doubles by name, of a text that is not null."""
    words = F.array_remove(F.split(text, _BLANKS), "")
    lines = F.array_remove(F.split(text, "\n"), "")
    chars, n = F.length(text), F.size(words)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "n_words": n.cast("double"),
        "word_length": _share(chars - count(r"[\x20\x09-\x0D]"), n),
        "distinct_words": _share(F.size(F.array_distinct(words)), n),
        "distinct_lines": _share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": _share(n, F.size(lines)),
        "upper": _share(count(r"\p{Lu}"), chars),
        "digits": _share(count(r"\p{Nd}"), chars),
        "symbols": _share(count("[#$%&*|<>]"), chars),
        "stops": _share(count(r"[.!?]"), n),
        "shouts": _share(count("[!?]"), n),
        "pauses": _share(count("[,;:]"), n),
        "runs": _share(count(r"([^\s\p{L}\p{Nd}])\1"), n),
        "same_next": _share(count(r"(?<![^\s])(\S+)\s+\1(?![^\s])"), n),
    }


@dataclass(frozen=True)
class Bounds:
    """above < x, x <= most."""

    above: float = -math.inf
    most: float = math.inf


#: A conjunction: statistic -> bounds, by name.
Rule = tuple[tuple[str, Bounds], ...]


def narrowed(rule: Rule, name: str, bounds: Bounds) -> Rule:
    """The rule with one more condition, which is merged with that of the same statistic."""
    held = dict(rule)
    old = held.get(name, Bounds())
    held[name] = Bounds(max(old.above, bounds.above), min(old.most, bounds.most))
    return tuple(sorted(held.items()))


def condition(rule: Rule, column: dict[str, Column]) -> Column:
    found = F.lit(True)
    for name, b in rule:
        if b.above > -math.inf:
            found = found & (column[name] > F.lit(b.above))
        if b.most < math.inf:
            found = found & (column[name] <= F.lit(b.most))
    return found


def holds(rule: Rule, values: dict[str, float]) -> bool:
    return all(b.above < values[name] <= b.most for name, b in rule)


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_rules(described: str, names: list[str]) -> Iterable[Rule]:
    """All paths from the root to a node, from a tree's description: a line for each branch, indented by depth."""
    path: list[tuple[int, Rule]] = []
    for line in described.splitlines():
        found = _SPLIT.match(line)
        if not found:
            continue
        depth, name, bound = len(found[1]), names[int(found[3])], float(found[5])
        while path and path[-1][0] >= depth:
            path.pop()
        rule = narrowed(path[-1][1] if path else (), name, Bounds(most=bound) if found[4] == "<=" else Bounds(above=bound))
        path.append((depth, rule))
        yield rule


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def logit(self, column: dict[str, Column]) -> Column:
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + F.when(condition(rule, column), F.lit(weight)).otherwise(F.lit(0.0))
        return z

    def score(self, values: dict[str, float]) -> float:
        """The same for one text's statistics, without Spark."""
        z = self.bias + sum(weight for rule, weight in self.rules if holds(rule, values))
        return 1 / (1 + math.exp(-z))


def _sampled(docs: DataFrame, labels: DataFrame, text: str, label: str, doc_id: str, max_docs_per_class: int, keep) -> tuple[DataFrame | None, dict[int, float], dict[int, int]]:
    """(y, stats) of the sample, the share of each class that it has, and the sizes of the classes."""
    marks = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("_id").isNotNull()).distinct()
    marks = keep(marks)
    n = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    share = {y: min(1.0, max_docs_per_class / n[y]) for y in n}
    if len(n) < 2:
        return None, share, n
    drawn = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1_000_000)) < F.when(F.col("y") == 1, int(1e6 * share[1])).otherwise(int(1e6 * share[0]))
    marks = keep(marks.where(drawn))  # only these rows meet the texts, of which only statistics go on
    met = docs.select(F.col(doc_id).alias("_own"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(bounded(marks), F.col("_own") == F.col("_id"))
    stats = F.struct(*(c.alias(k) for k, c in statistics(F.col("_text")).items()))
    return keep(met.select("_id", "y", stats.alias("stats")).groupBy("_id", "y").agg(F.min("stats").alias("stats"))), share, n


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", doc_id: str = "doc_id", max_docs_per_class: int = 4000, trees: int = 24, depth: int = 3, penalty: float = 0.001, seed: int = 1) -> RuleEnsemble:
    """Learns from the texts of docs with a label 0 or 1 in labels (doc_id, label); others are left out."""
    with scratch(docs.sparkSession) as keep:
        sample, share, n = _sampled(docs, labels, text, label, doc_id, max_docs_per_class, keep)
        good, all_of = n.get(1, 0), sum(n.values())
        plain = RuleEnsemble(math.log((good + 1) / (all_of - good + 1)))
        if sample is None:
            return plain
        names = list(statistics(F.lit("")))
        weight = F.when(F.col("y") == 1, 1 / share[1]).otherwise(1 / share[0])
        values = array_to_vector(F.array(*(F.col("stats").getField(k) for k in names)))
        # of bounded size, so one ordered partition: the forest's draws follow the order of rows
        rows = keep(sample.coalesce(1).sortWithinPartitions("_id", "y").select(F.col("y").cast("double").alias("label"), weight.alias("weight"), values.alias("features"), "stats"))
        if rows.select("label").distinct().count() < 2:
            return plain
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="onethird", seed=seed, weightCol="weight").fit(rows)
        rules = sorted({rule for tree in forest.trees for rule in tree_rules(tree.toDebugString, names)}, key=repr)
        if not rules:
            return plain
        column = {k: F.col("stats").getField(k) for k in names}
        matrix = rows.select("label", "weight", array_to_vector(F.array(*(condition(r, column).cast("double") for r in rules))).alias("features"))
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False, weightCol="weight").fit(keep(matrix))
        weights = [float(w) for w in lasso.coefficients.toArray()]
        return RuleEnsemble(float(lasso.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def quality(docs: DataFrame, ensemble: RuleEnsemble, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of docs with the columns of keep, score and predicted (1 if score >= 0.5)."""
    names = kept_names(keep, ("score", "predicted"))
    own = F.struct(*(F.col(c).alias(n) for c, n in names.items())) if names else F.lit(0)
    rows = docs.select(own.alias("own"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    stats = statistics(F.col("text"))
    # two projections: each statistic is computed once, however many rules ask for it
    rows = rows.select("own", *(c.alias(k) for k, c in stats.items()))
    rows = rows.select("own", (1 / (1 + F.exp(-ensemble.logit({k: F.col(k) for k in stats})))).alias("score"))
    return rows.select(*(F.col("own").getField(n).alias(n) for n in names.values()), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
