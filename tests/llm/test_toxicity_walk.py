"""The composed machines against a plain walk over a clause's words, and what learning may see."""

import random
import re

import pytest
from pyspark.sql import functions as F

from motifloom.llm import toxicity as tox

STEMS = {"vermi": 2.0, "vermin$": 4.0, "rott": 1.0, "rotten": 3.0, "you$": 0.7}
WORDS = ["idiot", "scum", "vermin", "vermillion", "rotting", "rottenness", "kill", "hurt", "will", "must", "you", "they", "not", "never", "said", "the", "kind", "evening", "you're", "IDIOTS", "don't", "I'll", "she’ll", "him"]


def plain_symbol(word):
    """By looking everything up: a learned whole word, a seed, the longest learned stem."""
    if word + "$" in STEMS:
        return tox.INSULT, STEMS[word + "$"]
    for symbol, words in tox.SEEDS.items():
        if word in words.split():
            return symbol, tox.SEED_WEIGHT
    known = [s for s in STEMS if not s.endswith("$") and word.startswith(s)]
    return (tox.INSULT, STEMS[max(known, key=len)]) if known else (tox.REST, 0.0)


def plain_events(text):
    """Looks back and ahead from each word by itself."""
    sums = [0.0] * tox.KINDS
    text = text.lower().replace("’", "'")
    text = re.sub(r"(\w)'ll\b", r"\1 will", re.sub(r"(\w)n't\b", r"\1 not", text)).replace("'", "")
    for clause in re.split(r"[.!?;\n()]+", text):
        quoted = [[plain_symbol(w) for w in re.findall(r"[^\W_]+", part)] for part in re.split(r"[:\"«»„“”]+", clause)]
        before = False
        for words in quoted:  # nothing but a report reaches from one part to the next
            symbols = [s for s, _ in words]
            for i, (symbol, weight) in enumerate(words):
                back, ahead = symbols[max(0, i - 3) : i], symbols[i + 1 : i + 4]
                negated, reported = tox.NEGATION in symbols[max(0, i - 5) : i], before or tox.REPORT in symbols[:i]
                whom = {tox.TARGET, tox.SUBJECT}
                kind = -1
                if symbol == tox.INSULT:
                    kind = tox.NEGATED if negated else tox.REPORTED if reported else tox.TARGETED if whom & {*back, *ahead} else tox.PLAIN
                elif symbol == tox.THREAT and tox.INTENT in back and not negated and not reported:
                    last = max((k for k, s in enumerate(back) if s == tox.TARGET), default=None)
                    subject = last is not None and last + 1 < len(back) and back[last + 1] == tox.INTENT
                    kind = tox.THREATENED if tox.TARGET in ahead or (last is not None and not subject) else -1
                if kind >= 0:
                    sums[kind] += weight * tox.FACTORS[kind]
            before = before or tox.REPORT in symbols
    return sums


def test_equal_to_a_plain_walk():
    rng = random.Random(5)
    g = tox.Grammar(STEMS)
    seen = [0] * tox.KINDS
    for _ in range(20_000):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", " ", ", ", ". ", "\n", ' "', ": "]) for _ in range(rng.randint(0, 14)))
        events = g.events(text)
        assert events == pytest.approx(plain_events(text))
        seen = [n + (e > 0) for n, e in zip(seen, events, strict=True)]
    assert min(seen) > 100


def test_subjects_are_no_objects():
    g = tox.Grammar({})
    assert not any(g.events("They will beat the deadline")) and not any(g.events("You must beat the clock"))
    assert g.events("They will beat you")[tox.THREATENED] and g.events("You, we will hurt all")[tox.THREATENED]


@pytest.mark.parametrize(("text", "kind"), [
    ('He said "you are an idiot".', tox.REPORTED), ("He said: you idiot", tox.REPORTED), ("He said you are an idiot", tox.REPORTED),
    ('"You are an idiot", she wrote', tox.TARGETED), ("I'll kill you", tox.THREATENED), ("I’ll kill you all", tox.THREATENED),
    ("we will kill the process they started", None), ("We will kill them", tox.THREATENED), ("They must hurt him", tox.THREATENED),
    ("You don't look like an idiot", tox.NEGATED), ("you wasnt an idiot", tox.NEGATED), ("He didn’t call anybody an idiot", tox.NEGATED),
    ("I won't kill you", None), ("I can't hurt you", None), ("They are idiots", tox.TARGETED), ('A title: "we will burn" you', None),
])
def test_clauses(text, kind):
    assert [k for k, v in enumerate(tox.Grammar({}).events(text)) if v] == ([] if kind is None else [kind])


def test_sample_is_bounded_by_rows(spark):
    """A doc_id that many rows share gives one text to learn from; what is copied teaches no stem."""
    rows = [(i, f"word{i} grumblic other{i}" if i < 40 else f"word{i} nice other{i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many = docs.unionByName(spark.range(5000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("zzz spammic "), F.col("id").cast("string")).alias("text")))
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)] * 2, "doc_id long, toxic int")
    g = tox.learn(many, labels)
    assert any("grumblic".startswith(s) for s in g.stems) and not any("spammic".startswith(s.rstrip("$")) for s in g.stems)
    copies = spark.createDataFrame([(i, "the same grumblic text" if i < 40 else "the same nice text") for i in range(80)], "doc_id long, text string")
    assert tox.learn(copies, labels).stems == {}
