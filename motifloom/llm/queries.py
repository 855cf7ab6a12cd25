"""The queries op1 to op13 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_counts, bpe_tree, chat, cuckoo, fertility, filter_audit, hard_negatives, langid, license_scan, minhash, mixing, rule_ensemble, toxicity
from ._common import documents, held_out


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    return langid.predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model, keep=("doc_id", "held_out"))


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies = (public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return fertility.quality(documents(spark, sf_dir), vocabularies, language="lang")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=4, threshold=0.8)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.duplicate_groups(documents(spark, sf_dir))


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encoding_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    grammar = toxicity.learn(docs.select("doc_id", "text"), labels)
    return toxicity.toxicity(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), grammar, keep=("doc_id", "held_out"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.formatted_turns(rows.unionByName(extra), ranks), ranks)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    ensemble = rule_ensemble.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~out))
    return rule_ensemble.quality(docs.select("doc_id", "text", out.alias("held_out")), ensemble, keep=("doc_id", "held_out"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0, relabel=moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_fertility": op2_fertility,
    "op3_minhash": op3_minhash,
    "op4_license_scan": op4_license_scan,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_bpe_tree": op6_bpe_tree,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_chat": op10_chat,
    "op11_filter_audit": op11_filter_audit,
    "op12_rule_ensemble": op12_rule_ensemble,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op4_license_scan": license_scan.oracle(),
    "op5_exact_dedup": """
        with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
               coalesce(doc_id = max(doc_id) over g, max(doc_id) over g is null) as kept, text_sha256
        from d window g as (partition by text_sha256)
    """,
    "op10_chat": r"""
        with c as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        k(control) as (values ('### System:'), ('### User:'), ('### Assistant:'), ('### Other:'), ('</role>'), ('</turn>'), ('\')),
        e as (select *, length(text) + list_sum([(length(text) - length(replace(text, x, ''))) // length(x) for x in (select list(control) from k)]) as escaped,
              length(role) + list_sum([(length(role) - length(replace(role, x, ''))) // length(x) for x in (select list(control) from k)]) as escaped_role from c),
        f as (select *, escaped + 8 + case role when 'system' then 11 when 'user' then 9 when 'assistant' then 14 else 10 + escaped_role + 7 end as chars from e)
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
               sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
               sum(chars)::bigint as formatted_chars
        from f group by conv_id
    """,
    "op11_filter_audit": filter_audit.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
