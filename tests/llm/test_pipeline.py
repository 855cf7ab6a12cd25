"""The pipeline's stages, each held against a plain version on its own input."""

import re

import corpus_pipeline
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from motifloom.llm import bpe_tree
from motifloom.llm._common import documents, materialize

from .conftest import ODD
from .test_dedup_ops import brute, lowered
from .test_licenses_and_mix import targets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    steps = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5

    first = steps["language ID"](spark, docs, SF).cache()
    assert first.columns == docs.columns
    assert first.count() == docs.where("text rlike '[A-Za-z]'").count()

    second = steps["exact dedup"](spark, first, SF).cache()
    keep = {}
    for r in first.collect():
        keep[lowered(r["text"])] = max(keep.get(lowered(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in second.collect()) == sorted(keep.values())

    third = steps["MinHash near-dedup"](spark, second, SF).cache()
    groups = brute({r["doc_id"]: r["text"] for r in second.collect()}, 5)
    assert sorted(r["doc_id"] for r in third.collect()) == sorted({c for _, c in groups.values()})

    fourth = steps["mixing"](spark, third, SF).cache()
    assert fourth.columns == docs.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest, taken, copies = {}, {}, {}, {}
    for r in third.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
        largest[r["source"]] = max(largest.get(r["source"], 0), size(r["text"]))
    for r in fourth.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + size(r["text"])
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 3
    for source, target in targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= largest[source] / 2 + 1e-3

    last = steps["BPE encoding"](spark, fourth, SF).collect()
    with open(path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe_tree.parse_ranks(f.read()), special_tokens={})
    expected = sorted((r["doc_id"], len(library.encode_ordinary(r["text"]))) for r in fourth.collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in last) == expected


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def through(spark, docs):
    """The rows that each stage returns; all but the last have the columns of docs."""
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, docs, SF))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        docs = out
        counts.append(out.count())
    return counts


def test_odd_tables(spark, odd, empty):
    """Nulls in all columns, repeated rows, clashing names, odd texts; tables without rows, and rows of nulls only."""
    clashing = odd.drop("n").withColumn("row", F.lit("r")).withColumn("digest", F.lit(1)).withColumn("size", F.lit(2)).withColumn("language", F.lit("l"))
    assert through(spark, clashing.where("false")) == [0] * 5
    nulls = spark.createDataFrame([(None,) * len(clashing.columns)] * 3, StructType([StructField(f.name, f.dataType) for f in clashing.schema]))
    assert through(spark, nulls) == [0] * 5
    counts = through(spark, clashing.unionByName(clashing).unionByName(nulls))
    letters = {lowered(t) for t in ODD if t and re.search(r"[^\W\d_]", t)}
    assert counts[1] <= len(letters) + 1 and counts[0] >= 2 * counts[1] > 0
    assert counts[2] <= counts[1] and counts[3] == counts[4]
