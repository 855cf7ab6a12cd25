"""Licence scans and source mixing."""

import re
from collections import Counter

import random

import pytest
from pyspark.sql import functions as F

from motifloom.llm import license_scan, mixing, queries

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def bag(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return Counter(zip(words, words[1:], strict=False))


def slow_scan(text, threshold=0.8):
    """All units against all templates, without bounds."""
    text = text or ""
    lines, paragraphs = text.split("\n"), text.split("\n\n")
    units = lines + ([text] if len(lines) > 1 else []) + (paragraphs if len(paragraphs) > 1 else [])
    best, hits = (0.0, 0, 0, None), 0
    for unit in units:
        own, hit = bag(unit), False
        for i, (name, template) in enumerate(license_scan.TEMPLATES):
            other = bag(template)
            total = own.total() + other.total()
            common = (own & other).total()
            if own and 2 * common >= threshold * total:
                best, hit = max(best, (2 * common / total, other.total(), -i, name)), True
        hits += hit
    return best[3], best[0], hits


def test_scan_by_brute_force(spark, docs):
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 200)
    texts = [r["text"] for r in docs.limit(60).collect()]
    texts += [mit, mit[:600] + "\n" + mit[600:], "x\n\n" + mit.replace("Software", "program") + "\n\ny", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "under the the MIT License", *ODD]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = {r["doc_id"]: (r["license"], r["dice"], r["n_matches"]) for r in license_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        name, dice, hits = slow_scan(t)
        assert got[i][0] == name and got[i][1] == pytest.approx(dice) and got[i][2] == hits, t


def test_scan_edge_cases(odd, empty):
    rows = license_scan.scan(odd).collect()
    assert len(rows) == len(ODD) + 1 and all(r["license"] is None and r["n_matches"] == 0 for r in rows)
    assert license_scan.scan(empty).count() == 0
    with pytest.raises(ValueError, match="no template"):
        license_scan.scan(odd, templates=(("x", "word"),))
    notice = odd.limit(1).withColumn("doc_id", F.lit(1)).withColumn("text", F.lit("Released under the MIT License."))
    assert [(r["license"], r["dice"], r["n_matches"]) for r in license_scan.scan(notice.unionByName(notice)).collect()] == [("MIT", 1.0, 1)] * 2


def targets(sizes, weights=(5, 2, 1), most=3):
    """The rule, step by step: share by weight, stop at the cap, reshare the excess."""
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {s: share.get(s, most * sizes[s]) for s in order}
        capped |= set(over)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, "c": 1000}, {"a": 1, "b": 1, "c": 1, "d": 500, None: 30}, {"a": 0, "b": 7}, {"x": 5}, {None: 3, "é": 900, "z": 2}, {"a": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(targets(sizes) if sum(sizes.values()) else {s: 0.0 for s in sizes})


def test_targets_of_sources_that_tie(spark):
    """Random tables with many equal sizes and weights, zeros and a null source."""
    rng = random.Random(5)
    for case in range(100):
        sizes = {f"s{i:03}": rng.choice([0, 1, 10, 10, 10, 150, 150, 1500]) for i in range(rng.randrange(1, 40))}
        if case % 3 == 0:
            sizes[None] = rng.choice([0, 10, 150])
        if not sum(sizes.values()):
            continue
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
        assert got == pytest.approx(targets(sizes)), sizes
        assert sum(got.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("n", [10, 1000])
def test_equal_sources_share_all_words(spark, n):
    docs = spark.range(5 * n).selectExpr("id as doc_id", "repeat('w ', 3) as text", f"lpad(cast(id % {n} as string), 4, '0') as source")
    rows = mixing.mixed(docs).collect()
    by = {r["source"]: r["target"] for r in rows}
    assert len(by) == n and sum(by.values()) == pytest.approx(15 * n)
    # each source's last document goes to its nearer side
    assert abs(sum(r["taken"] for r in rows) - 15 * n) <= 1.5 * n


@pytest.mark.parametrize("chunk", [4, 512])
def test_mix(spark, chunk):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mixed(docs, chunk=chunk, seed=3).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        rate = own[0]["target"] / own[0]["source_size"]
        assert {r["copies"] for r in own if r["size"]} <= {int(rate), int(rate) + 1}
        largest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= largest / 2 + 1e-3
        assert own[0]["source_size"] == sum(r["size"] for r in own)
    again = mixing.mixed(docs.repartition(5), chunk=chunk, seed=3).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_rounding_keeps_expectations(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    taken = {}
    for seed in range(30):
        for r in mixing.mixed(docs, seed=seed, chunk=8).collect():
            taken[r["source"], r["doc_id"]] = taken.get((r["source"], r["doc_id"]), 0) + r["copies"]
    for source in "ab":
        counts = [n for (s, _), n in taken.items() if s == source]
        assert min(counts) < max(counts)
        assert all(abs(n / 30 - sum(counts) / len(counts) / 30) < 0.45 for n in counts)


def test_mix_edge_cases(odd, empty):
    df = odd.withColumn("copies", F.lit("clash")).withColumn("size", F.lit(1))
    rows = mixing.mixed(df).collect()
    assert len(rows) == len(ODD) + 1
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mixed(empty).count() == 0
    twice = mixing.mixed(df.unionByName(df)).collect()
    assert len(twice) == 2 * len(rows) and len({(r["doc_id"], r["taken"]) for r in twice}) <= len(rows)
    out = mixing.resampled(df)
    assert out.columns == df.columns
    assert out.count() == sum(r["copies"] for r in rows)


def test_mix_query(spark):
    assert queries.op8_mixing(spark, SF).count() == 200
