"""Filter audit, rule ensemble and hard negatives against plain versions."""

import random
import re
from itertools import permutations
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifloom.llm import filter_audit, hard_negatives, rule_ensemble
from motifloom.llm.queries import op11_filter_audit, op12_rule_ensemble, op13_hard_negatives

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter audit ---------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic). Every document walks every order."""
    docs = [(i, t or "", p or "") for i, t, p in docs]
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}

    def fails(i, t):
        words = WORD.findall(t)
        found = {"A"} if len(words) < 200 else set()
        found |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        found |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        found |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        return found | ({"E"} if i is not None and i > least[t] else set())

    rows = [(p, fails(i, t), i is not None and i in good, i is not None and i in toxic) for i, t, p in docs]
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                redundant = sum(f in r[1] for r in own) - len(gone)
                alone = sum(r[1] == {f} for r in own)
                left = [r for r in left if f not in r[1]]
                out.append((part, "".join(order), step, f, len(left), len(gone), redundant, alone, sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted((*r, shapley[r[0], r[3]]) for r in out)


def audited(found):
    return sorted(tuple(r) for r in found.select("part", "filter_order", "step", "filter", *filter_audit.COUNTS).collect())


def test_audit_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()
    assert audited(op11_filter_audit(spark, SF)) == plain_audit(docs, labels)


def test_audit_of_odd_rows(spark, odd):
    """Nulls, copies across parts, repeated rows and ids, labels that repeat and disagree, clashing columns."""
    again = [(7, "Copy OF text", "fr"), (7, "Copy OF text", "fr"), (8, "Copy OF text", "de"), (9, "Copy OF text", None), (None, "Copy OF text", "fr"), (7, "other $", "fr"), (6, None, "fr"), (5, "", "")]
    extra = spark.createDataFrame([(i, t, p, None, 0, "x", 0.0, False, "k") for i, t, p in again], odd.schema)
    docs = odd.unionByName(extra).withColumn("mask", F.lit(1)).withColumn("part", F.lit("p")).withColumn("own", F.lit(2))
    labels = spark.createDataFrame([(7, 1, 0, 1), (7, 0, 1, 1), (8, None, 1, 1), (None, 1, 1, 1), (3, 1, None, 1), (999, 1, 1, 1)], "doc_id long, quality int, toxic int, id int")
    expected = plain_audit(docs.select("doc_id", "text", "lang").collect(), [tuple(r)[:3] for r in labels.collect()])
    assert audited(filter_audit.audit(docs, labels)) == expected
    assert len(expected) == 600 * 4


def test_audit_of_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).collect() == []
    assert filter_audit.audit(odd, labels).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_without_copies_and_with_other_filters(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = filter_audit.audit(odd, labels, {"x": lambda t: F.length(t) < 5, "y": lambda t: F.length(t) > 1}, copies=None).collect()
    assert {(r["filter_order"], r["step"], r["filter"]) for r in found} == {("xy", 1, "x"), ("xy", 2, "y"), ("yx", 1, "y"), ("yx", 2, "x")}
    for r in found:
        # both orders keep the same documents in the end
        assert r["step"] == 1 or r["kept"] == next(x["kept"] for x in found if x["part"] == r["part"] and x["step"] == 2)
    with pytest.raises(ValueError):
        filter_audit.audit(odd, labels, {"E": lambda t: F.length(t) < 5})


def test_lattice_edges():
    edges = filter_audit.lattice_edges("ABCDE")
    assert len(edges) == len({e[:2] for e in edges}) == 80
    for f in range(5):
        assert sum(w for _, g, w in edges if g == f) == 120


# --- rule ensemble --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ensemble(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return rule_ensemble.learn(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = op12_rule_ensemble(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("quality", "predicted").collect()
    bad = [r["predicted"] == 0 for r in rows if r["quality"] == 0]
    good = [r["predicted"] == 1 for r in rows if r["quality"] == 1]
    assert len(bad) > 10 and sum(bad) >= 0.85 * len(bad)
    assert sum(good) >= 0.98 * len(good)


def test_compiled_rules_equal_plain_ones(spark, ensemble, odd):
    assert ensemble.rules and all(w for _, w in ensemble.rules)
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    stats = rule_ensemble.statistics(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text", F.struct(*(c.alias(k) for k, c in stats.items())).alias("s")).collect()
    expected = sorted(ensemble.score(r["s"].asDict()) for r in rows)
    got = sorted(r["score"] for r in rule_ensemble.quality(docs, ensemble).collect())
    assert np.allclose(got, expected, atol=1e-12) and all(0 <= x <= 1 for x in got)


def plain_statistics(t):
    words, lines = WORD.findall(t), [x for x in t.split("\n") if x]
    share = lambda a, b: a / b if b else 0.0
    return {
        "n_words": len(words), "word_length": share(sum(map(len, words)), len(words)), "distinct_words": share(len(set(words)), len(words)),
        "distinct_lines": share(len(set(lines)), len(lines)), "line_words": share(len(words), len(lines)), "symbols": share(len(re.findall("[#$%&*|<>]", t)), len(t)),
        "stops": share(len(re.findall("[.!?]", t)), len(words)), "pauses": share(len(re.findall("[,;:]", t)), len(words)),
    }


def test_statistics(spark, odd):
    stats = rule_ensemble.statistics(F.coalesce("text", F.lit("")))
    for r in odd.select("text", F.struct(*(c.alias(k) for k, c in stats.items())).alias("s")).collect():
        for name, value in plain_statistics(r["text"] or "").items():
            assert r["s"][name] == pytest.approx(value), (name, (r["text"] or "")[:40])


def test_tree_paths():
    described = """Tree
  If (feature 0 <= 0.5)
   If (feature 1 <= 2.0)
    Predict: 0.0
   Else (feature 1 > 2.0)
    Predict: 1.0
  Else (feature 0 > 0.5)
   If (feature 0 <= 1.5E-3)
    Predict: 0.0
   Else (feature 0 > 1.5E-3)
    Predict: 1.0
"""
    rules = list(rule_ensemble.tree_rules(described, ["a", "b"]))
    b = rule_ensemble.Bounds
    assert rules[:3] == [(("a", b(most=0.5)),), (("a", b(most=0.5)), ("b", b(most=2.0))), (("a", b(most=0.5)), ("b", b(above=2.0)))]
    assert rules[3:] == [(("a", b(above=0.5)),), (("a", b(above=0.5, most=0.0015)),), (("a", b(above=0.5)),)]
    assert not rule_ensemble.holds(rules[4], {"a": 0.4})


def test_few_labels_and_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert rule_ensemble.learn(odd, none) == rule_ensemble.RuleEnsemble(0.0)
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None), (4, 7)], "doc_id long, quality int")
    only = rule_ensemble.learn(odd, one)
    assert only.rules == () and only.bias == pytest.approx(np.log(3))
    both = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 0), (888, 1)], "doc_id long, quality int")
    twice = [rule_ensemble.learn(odd.unionByName(odd), both) for _ in range(2)]
    assert twice[0] == twice[1]
    found = rule_ensemble.quality(odd, twice[0], keep=("doc_id", "score", "text"))
    assert found.columns == ["doc_id", "score_in", "text", "score", "predicted"]
    assert found.count() == odd.count()
    assert rule_ensemble.quality(empty, twice[0]).collect() == []
    assert rule_ensemble.learn(empty, both).rules == ()


# --- hard negatives -------------------------------------------------------------------------------------------------


def plain_negatives(rows, every=50, positives=5, negatives=3, low=50, high=95):
    """rows: (vec_id, embedding, label), each id once."""
    used = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not isfinite(x) for x in v):
            continue
        used.append((i, (label + 1) % 10 if i % 7 == 0 else label, [floor(256 * x) for x in v]))
    out = []
    for i, label, v in used:
        if i % every:
            continue
        ranked = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, own) for j, own, w in used if j != i)
        for p, j, _ in [r for r in ranked if r[2] == label][:positives]:
            hits = [(s, k) for s, k, own in ranked if own != label and low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(hits, 1)]
    return sorted(out)


MOVED = staticmethod(lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)).__func__


def mined(spark, rows, every=50, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = hard_negatives.hard_negatives(table, lambda i: i % every == 0, relabel=MOVED, **options)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_negatives_of_the_test_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    found = op13_hard_negatives(spark, SF)
    got = sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got and got == plain_negatives([tuple(r) for r in rows])


@pytest.mark.parametrize("seed", range(3))
def test_blocks_of_any_size_give_the_same(spark, seed):
    """Few distinct vectors, so scores tie; small blocks, so every list is merged from many."""
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.choice([-0.3, 0.1, 0.2, 0.55]))) for _ in range(4)], rng.randrange(3)) for i in range(-20, 120)]
    rows += [(500, None, 1), (550, [0.1, None], 1), (600, [0.1, float("nan")], 1), (650, [float("inf")], 1), (700, [0.1, 0.2], None), (None, [0.1, 0.2], 1), (750, [], 0), (800, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5], 1)]
    expected = plain_negatives(rows, every=10)
    assert expected
    assert mined(spark, rows, 10, row_block=rng.choice([9, 40]), anchor_block=3) == expected
    assert mined(spark, rows, 10) == expected


def test_repeated_ids_and_empty_tables(spark):
    rows = [(i, [float(i % 5) / 4, 0.5], i % 2) for i in range(60)]
    expected = plain_negatives(rows, every=20)
    assert mined(spark, rows * 2 + [(20, [9.0, 9.0], 5)], 20) == expected
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1)]) == []
    clash = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label long, id long, a long, anchor_id int")
    assert hard_negatives.hard_negatives(clash, lambda i: i % 20 == 0, relabel=MOVED).count() == len(expected)


def test_large_scores():
    big = np.array([[2.0**40, 1.0]])
    assert hard_negatives.scores(big, np.array([[2.0**20, 3.0]]))[0, 0] == 2**60 + 3
    assert hard_negatives.scores(np.array([[2.0**32, -(2.0**32)]]), np.array([[2.0**31, 2.0**31]]))[0, 0] == 0
    with pytest.raises(OverflowError):
        hard_negatives.scores(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_limits():
    for score in (-7, -1, 0, 1, 3, 99, 100, 12345):
        least, largest = hard_negatives.limits(score, 50, 95)
        inside = [s for s in range(-20, 12400) if 50 * score <= 100 * s <= 95 * score]
        assert inside == list(range(least, largest + 1))
