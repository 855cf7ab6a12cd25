"""Language ID against a plain naive Bayes over the same hashed n-grams, and ties."""

import math
from collections import Counter

import numpy as np
import pytest

from motifloom.llm import langid

from .conftest import ODD
from .test_fertility import SCRIPTS

M = [int(m) for m in langid.MULTIPLIERS]
MASK = (1 << 32) - 1


def plain_buckets(text, buckets):
    """One n-gram at a time."""
    codes = [ord(c) for c in text.lower()]
    out = []
    for begin in range(len(codes)):
        for order in (1, 2, 3):
            gram = (codes[begin : begin + order] + [32] * order)[:order]
            letters = [chr(c).isalpha() and __import__("unicodedata").category(chr(c))[0] == "L" for c in gram]
            if not any(letters):
                continue
            value = 0
            for k, (c, is_letter) in enumerate(zip(gram, letters, strict=True)):
                value = (value * M[0] + ((c if is_letter else 32) + k + 1) * M[1]) & MASK
            mixed = ((value ^ (value >> 15)) * M[2]) & MASK
            out.append((mixed >> 8) % buckets)
    return out


def plain_model(rows, buckets, smoothing=0.5):
    labels = sorted({y for _, y in rows})
    counts = {y: Counter() for y in labels}
    for text, y in rows:
        counts[y].update(plain_buckets(text, buckets))
    n = Counter(y for _, y in rows)

    def predict(text):
        grams = plain_buckets(text, buckets)
        if not any(__import__("unicodedata").category(c)[0] == "L" for c in text.lower()):
            return "und", 0.0
        total = {y: math.log(n[y] / len(rows)) + sum(math.log((counts[y][g] + smoothing) / (counts[y].total() + smoothing * buckets)) for g in grams) for y in labels}
        best = max(labels, key=lambda y: (total[y], [-ord(c) for c in y]))
        return best, 1 / sum(math.exp(min(700, t - total[best])) for t in total.values())

    return predict


def test_equal_to_plain_naive_bayes(spark, docs):
    buckets = 512
    train = [(r["text"], r["lang"]) for r in docs.limit(40).collect()]
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(train)], "doc_id long, text string, lang string")
    model, predict = langid.fit(df, buckets=buckets), plain_model(train, buckets)
    texts = [r["text"][:300] for r in docs.collect()[40:90]] + ["das", "le", "ll", "a b", "Straße 12", "x-y z"] + [t or "" for t in ODD if len(t or "") < 500]
    labels, scores = langid.score(model, texts)
    for text, label, score in zip(texts, labels, scores, strict=True):
        wanted = predict(text)
        assert score == pytest.approx(wanted[1], abs=2e-3)
        assert label == wanted[0] or 0.499 < wanted[1] < 0.501


def test_whole_texts_where_lower_casing_lengthens(monkeypatch):
    """A capital dotted I becomes two characters: no n-gram of the text is lost, whatever the segments."""
    text = "\u0130" * 20 + " the house and garden"
    for segment in (1 << 18, 7):
        monkeypatch.setattr(langid, "SEGMENT", segment)
        got = Counter()
        for _, parts, starts in langid._segments([text, "x\u0130"]):
            got.update(g for g in langid.hashed(parts, starts, 512)[0].ravel().tolist() if g < 512)
        assert got == Counter(plain_buckets(text, 512)) + Counter(plain_buckets("x\u0130", 512))


def test_ties_go_to_the_first_label(spark):
    rows = [(1, "same words", "fr"), (2, "same words", "en"), (3, "same words", "de")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    labels, scores = langid.score(model, ["same words", "other", "12"])
    assert labels == ["de", "de", "und"] and np.allclose(scores, [1 / 3, 1 / 3, 0])
    twice = langid.fit(spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, lang string"))
    assert langid.score(twice, ["same words"])[0] == ["en"]


def test_known_equals_a_plain_count(spark):
    buckets, rows = 512, [("some words of a language", "en"), ("des mots de la langue", "fr")]
    model = langid.fit(spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, lang string"), buckets=buckets)
    counts = {y: Counter(plain_buckets(t, buckets)) for t, y in rows}
    texts = ["words", "la langue, 12", "текст", "", None or "!?"]
    labels, _, shares = langid.score_and_known(model, texts)
    for text, label, share in zip(texts, labels, shares, strict=True):
        own = plain_buckets(text, buckets) if label != "und" else []
        # likelier than 1 / buckets: counted more often than buckets are on average
        known = sum(counts[label][g] > counts[label].total() / buckets for g in own)
        assert share == pytest.approx(known / max(1, len(own)))


def test_scripts_that_were_not_learned_are_rejected(spark):
    """Whatever the posterior says; short and odd words of the learned script stay, and so does every document with a letter."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id % 5 <> 0"))
    foreign = [t * n for s, t in SCRIPTS.items() if s != "LATIN" for n in (1, 20)]
    short = ["a", "ok", "Straße", "été", "spam ham", "Xylophon", "ñ", "A.\nAll rights reserved."]
    rows = [(i, t) for i, t in enumerate([*foreign, *short, None, "", "12 !"])]
    kept = langid.identified(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert {r["text"] for r in kept.collect()} == set(short)
    assert (langid.score(model, foreign)[1] > 0.9).any()
    few = langid.fit(docs.where("doc_id % 5 <> 0"), max_docs_per_label=30)  # the bound does not move with what was learned from
    assert (langid.score_and_known(few, foreign)[2] < 0.25).all() and (langid.score_and_known(few, short)[2] >= 0.25).all()
    assert langid.identified(docs, model).count() == docs.where("text rlike '[A-Za-z]'").count()
