"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat verb, intent, target, subject pronoun, negation, reported speech, other) by a lexicon transducer: a
trie of stems (accepted with anything after them) and whole words, whose arcs are seed words and stems learned from
labels; the weight of a word is that of the last accepting state on its path. Two machines read the symbols of a clause,
a bimachine: one from the right, which knows whether a target or an object follows within reach, and one from the left, the
composition of five small ones (how far back the last target, the last possible object, the last negation and the last
intent are, and whether speech is reported). Quotation marks and colons are symbols too: no target, object, negation or
intent reaches across them, but a report does, so it reaches into what it quotes. Where they meet, each insult or threat is an event of a kind (plain,
targeted, negated, reported, threat); the arc that emits it multiplies the word's weight by the factors of the machines
it was composed of. A text's sums of path weights by kind go through a logistic model.

A pronoun right before an intent is its subject, so "you will beat the deadline" has no object and is no threat, while
"they will beat you" has one. Pronouns that are subjects only (he, they) can be insulted, but are no objects: "we will kill
the process they started" is no threat. Contractions are parted: "I'll" is an intent, "don't" a negation.

Learning uses a bounded, hash-chosen sample of labelled rows (``max_docs_per_class``, one text for each doc_id): all stems
whose texts are mostly toxic, that occur often enough and in enough different contexts (so copies of one text do not count
as evidence), then the weights of the kinds. The lexicon has no cap of its own: each stem needs ``min_docs`` sampled texts.
The model is shipped to the tasks; scoring is row-local.

Null texts count as empty; those, and texts without events, get the model's base score. With no labels of both classes
the seed words alone are used. Repeated rows give repeated rows, an empty table an empty table; of several texts of one
sampled doc_id the first by code points is learned from, and a doc_id with both labels counts for both. Texts of any
length are scored as wholes, clause by clause. A column of keep that is named like a result comes back with `_in` appended.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded, scratch, with_results

INSULT, THREAT, INTENT, TARGET, SUBJECT, NEGATION, REPORT, BREAK, REST = range(9)
PLAIN, TARGETED, NEGATED, REPORTED, THREATENED = range(5)
KINDS = 5
#: What the small machines multiply a word's weight by where they take part in an event.
FACTORS = {PLAIN: 1.0, TARGETED: 1.5, NEGATED: 0.2, REPORTED: 0.3, THREATENED: 1.5}

SEEDS: dict[int, str] = {
    INSULT: "idiot idiots idiotic moron morons stupid scum loser losers pathetic worthless disgusting trash clown clowns imbecile dumbass abruti imbécile salaud crétin dummkopf arschloch trottel abschaum idiota imbécil estúpido basura",
    THREAT: "kill murder hurt harm destroy burn beat shoot stab strangle choke crush smash punch attack hunt bomb poison torture hang slap tuer frapper brûler détruire étrangler töten umbringen schlagen verbrennen erschießen zerstören matar golpear quemar destruir disparar",
    INTENT: "will gonna going wanna should must shall would could vais va allons vas vont veux dois werde wird wirst werden will soll muss voy va vamos vas van quiero debo",
    TARGET: "you your youre ur yourself him her them us everyone everybody tu toi te vous votre ton ta lui leur eux du dich dir ihr euch ihn ihm ihnen sie tú usted te ti vosotros ustedes os lo la los",
    SUBJECT: "he she they il elle ils elles er él ella ellos ellas",
    NEGATION: "not never no nobody neither nor without cannot isnt arent wasnt werent dont doesnt didnt wont wouldnt cant couldnt shouldnt mustnt hasnt havent hadnt aint pas jamais aucun ne sans ni nicht kein keine keinen nie niemals ohne nunca jamás ningún tampoco sin",
    REPORT: "said says saying told tells called calls wrote writes quoted quotes reported reports claims claimed alleged shouted yelled asked dit disait appelé écrit cite crié sagte sagt sagten nannte schrieb zitiert rief dijo dice decía llamó escribió gritó citó",
}
SEED_WEIGHT = 3.0
_CLAUSE = re.compile(r"[.!?;\n()]+")
_WORD = re.compile(r"[^\W_]+")
BREAKS = ':"«»„“”'
_TOKEN = re.compile(rf"[^\W_]+|[{BREAKS}]+")
_SHORT = re.compile(r"(?<=[^\W_])(?:n't|'ll)(?![^\W_])")
REACH, NEGATION_REACH = 3, 5  # words that a target, object or intent, and that a negation reaches
NONE, WHOM, OBJECT = range(3)  # what follows: nothing, somebody, somebody who may be an object
STEM_LENGTHS = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class Lexicon:
    """The lexicon transducer as a trie: arcs[state][letter] is the next state; stem and whole give symbol and weight of the states that accept prefixes and whole words."""

    arcs: list[dict[str, int]]
    stem: dict[int, tuple[int, float]]
    whole: dict[int, tuple[int, float]]

    def read(self, word: str) -> tuple[int, float]:
        """Symbol and weight of a word: those of the whole word if it is accepted, else of its longest stem."""
        state, best = 0, (REST, 0.0)
        for letter in word:
            state = self.arcs[state].get(letter, -1)
            if state < 0:
                return best
            best = self.stem.get(state, best)
        return self.whole.get(state, best)


def lexicon(stems: dict[str, float]) -> Lexicon:
    """From learned stems (insults; one that ends in $ is a whole word) and the seeds, of which the first symbol of a word counts; a learned whole word goes before a seed."""
    arcs: list[dict[str, int]] = [{}]
    found = Lexicon(arcs, {}, {})

    def state(word: str) -> int:
        at = 0
        for letter in word:
            if letter not in arcs[at]:
                arcs.append({})
                arcs[at][letter] = len(arcs) - 1
            at = arcs[at][letter]
        return at

    for symbol, words in reversed(SEEDS.items()):
        for word in words.split():
            found.whole[state(word)] = symbol, SEED_WEIGHT
    for stem, weight in stems.items():
        if stem.endswith("$"):
            found.whole[state(stem[:-1])] = INSULT, weight
        else:
            found.stem[state(stem)] = INSULT, weight
    return found


@dataclass(frozen=True)
class Machine:
    """move[state][symbol]; event[state][symbol][after]: kind (-1: none) and factor, by what the machine from the right says that follows (NONE, WHOM, OBJECT)."""

    start: int
    move: list[list[int]]
    event: list[list[list[tuple[int, float]]]]


def compose() -> Machine:
    """The machine from the left. States are (words since a target, since a possible object, since a negation, since an intent: the reach means none; speech reported)."""
    span, wide = range(REACH + 1), range(NEGATION_REACH + 1)
    states = list(product(span, span, wide, span, (0, 1)))
    number = {s: i for i, s in enumerate(states)}
    move, event = [], []
    for target, thing, negation, intent, report in states:
        older = min(target + 1, REACH), min(thing + 1, REACH), min(negation + 1, NEGATION_REACH), min(intent + 1, REACH)
        moves, events = [], []
        for symbol in range(REST + 1):
            t, o, n, i = older
            if symbol == BREAK:
                t, o, n, i = REACH, REACH, NEGATION_REACH, REACH
            t = 0 if symbol in (TARGET, SUBJECT) else t
            o = 0 if symbol == TARGET else o
            n = 0 if symbol == NEGATION else n
            i = 0 if symbol == INTENT else i
            if symbol == INTENT and thing == 0:
                o = REACH  # the pronoun just before is the subject
            moves.append(number[t, o, n, i, 1 if symbol == REPORT else report])
            arcs = []
            for after in (NONE, WHOM, OBJECT):
                kind = -1
                if symbol == INSULT:
                    kind = NEGATED if negation < NEGATION_REACH else REPORTED if report else TARGETED if target < REACH or after else PLAIN
                elif symbol == THREAT and intent < REACH and negation == NEGATION_REACH and not report and (thing < REACH or after == OBJECT):
                    kind = THREATENED
                arcs.append((kind, FACTORS.get(kind, 0.0)))
            events.append(arcs)
        move.append(moves)
        event.append(events)
    return Machine(number[REACH, REACH, NEGATION_REACH, REACH, 0], move, event)


MACHINE = compose()


def follows(symbols: list[int]) -> list[int]:
    """The machine from the right: what is among the REACH next symbols, up to a break. Its state are the distances of a pronoun and of a possible object."""
    out, whom, thing = [NONE] * len(symbols), REACH, REACH
    for at in range(len(symbols) - 1, -1, -1):
        out[at] = OBJECT if thing < REACH else WHOM if whom < REACH else NONE
        symbol = symbols[at]
        whom, thing = (REACH, REACH) if symbol == BREAK else (min(whom + 1, REACH), min(thing + 1, REACH))
        whom = 0 if symbol in (TARGET, SUBJECT) else whom
        thing = 0 if symbol == TARGET else thing
    return out


@dataclass
class Grammar:
    stems: dict[str, float]
    bias: float = -3.0
    kinds: tuple[float, ...] = (1.0,) * KINDS
    _lexicon: Lexicon | None = field(default=None, repr=False)
    _known: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}, "_lexicon": None}

    def symbol(self, word: str) -> tuple[int, float]:
        """What the lexicon transducer makes of a lower-case word."""
        known = self._known.get(word)
        if known is None:
            if self._lexicon is None:
                self._lexicon = lexicon(self.stems)
            if len(self._known) > 200_000:
                self._known.clear()
            known = self._known[word] = self._lexicon.read(word)
        return known

    def events(self, text: str) -> list[float]:
        """Sums of path weights by kind."""
        sums = [0.0] * KINDS
        text = _plain(text)
        hot = [w for w in set(_WORD.findall(text)) if self.symbol(w)[0] <= THREAT]
        if not hot:
            return sums
        for clause in _CLAUSE.split(text):
            if not any(map(clause.__contains__, hot)):
                continue
            words = [(BREAK, 0.0) if w[0] in BREAKS else self.symbol(w) for w in _TOKEN.findall(clause)]
            state = MACHINE.start
            for (symbol, weight), after in zip(words, follows([s for s, _ in words]), strict=True):
                kind, factor = MACHINE.event[state][symbol][after]
                if kind >= 0:
                    sums[kind] += weight * factor
                state = MACHINE.move[state][symbol]
        return sums

    def score(self, text: str) -> float:
        z = self.bias + sum(k * math.log1p(s) for k, s in zip(self.kinds, self.events(text), strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _plain(text: str) -> str:
    """Lower case, contractions parted, other apostrophes left out."""
    text = text.lower().replace("’", "'")
    if "'" not in text:
        return text
    return _SHORT.sub(lambda m: " not" if m[0] == "n't" else " will", text).replace("'", "")


def stems_of(word: str) -> list[str]:
    return [word[:n] for n in STEM_LENGTHS if n <= len(word)] + [word + "$"]


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", doc_id: str = "doc_id", max_docs_per_class: int = 4000, min_docs: int = 6, min_contexts: int = 4, min_precision: float = 0.7) -> Grammar:
    """Learns stems and weights from the texts of docs with a label 0 or 1 in labels (doc_id, label); others are left out.

    The labels are sampled before they meet the texts, so that only a table of bounded size is broadcast and no text
    is shuffled but the sampled ones. The sample has one text for each sampled doc_id and label.
    """
    with scratch(docs.sparkSession) as keep:
        marks = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("_id").isNotNull()).distinct()
        marks = keep(marks)
        n = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
        if len(n) < 2:
            return Grammar({})
        share = {y: min(1.0, max_docs_per_class / n[y]) for y in n}
        drawn = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1_000_000)) < F.when(F.col("y") == 1, int(1e6 * share[1])).otherwise(int(1e6 * share[0]))
        marks = keep(marks.where(drawn))
        sample = docs.select(F.col(doc_id).alias("_own"), F.col(text).alias("_text")).join(bounded(marks), F.col("_own") == F.col("_id")).where(F.col("_text").isNotNull())
        sample = keep(sample.groupBy("_id", "y").agg(F.min("_text").alias("text")).select("text", "y"))
        return _learned(sample, {y: 1 / share[y] for y in n}, min_docs, min_contexts, min_precision)


def _learned(sample: DataFrame, weight: dict[int, float], min_docs: int, min_contexts: int, min_precision: float) -> Grammar:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()
        for batch in batches:
            for x, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                seen[y].update({s for w in set(_WORD.findall(_plain(x))) for s in stems_of(w)})
        for y in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(list(seen[y]), pa.string()), pa.array([y] * len(seen[y]), pa.int32()), pa.array(list(seen[y].values()), pa.int64())], names=["stem", "y", "n"])

    counted = sample.mapInArrow(count, "stem string, y int, n long").groupBy("stem").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good"))
    precision = F.col("bad") * weight[1] / (F.col("bad") * weight[1] + F.col("good") * weight[0])
    chosen = {r["stem"]: (r["bad"], r["good"]) for r in counted.where((F.col("bad") >= min_docs) & (precision >= min_precision)).collect()}
    # a longer stem adds nothing to a shorter one that is chosen
    chosen = {s: v for s, v in chosen.items() if not any(s[:k] in chosen for k in STEM_LENGTHS if k < len(s.rstrip("$")) + (s[-1] == "$"))}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, set[str]] = {}
        for batch in batches:
            for x, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                words = _WORD.findall(_plain(x)) if y == 1 else []
                for i, w in enumerate(words):
                    for s in stems_of(w):
                        # a task need not name more contexts than decide
                        if s in chosen and len(held := found.setdefault(s, set())) < min_contexts:
                            held.add(" ".join(words[max(0, i - 1) : i] + ["_"] + words[i + 1 : i + 2]))
        pairs = [(s, c) for s, held in found.items() for c in held]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], names=["stem", "context"])

    varied = sample.mapInArrow(contexts, "stem string, context string").groupBy("stem").agg(F.countDistinct("context").alias("n")).where(F.col("n") >= min_contexts).select("stem").collect()
    odds = {s: math.log((chosen[s][0] * weight[1] + 0.5) / (chosen[s][1] * weight[0] + 0.5)) for s in sorted(r["stem"] for r in varied)}
    grammar = Grammar({s: max(0.5, min(6.0, o)) for s, o in odds.items()})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            events = [[math.log1p(s) for s in grammar.events(x)] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(events, pa.list_(pa.float64()))], names=["y", "x"])

    table = sample.mapInArrow(features, "y int, x array<double>").toArrow()  # a short row for each sampled label
    y = table["y"].to_numpy().astype(float)
    x = np.array(table["x"].to_pylist(), float).reshape(len(y), KINDS)
    grammar.bias, grammar.kinds = _logistic(x, y, np.where(y == 1, weight[1], weight[0]), np.array(Grammar({}).kinds))
    return grammar


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: np.ndarray, ridge: float = 1.0) -> tuple[float, tuple[float, ...]]:
    """Weighted logistic regression by Newton steps, drawn towards the given weights of the kinds (kinds without data keep them)."""
    if not len(x):
        return Grammar({}).bias, tuple(prior.tolist())
    w = w / w.mean()
    design = np.hstack([np.ones((len(x), 1)), x])
    center = np.concatenate([[-3.0], prior])
    pull = np.array([1e-6] + [ridge] * len(prior))
    beta = center.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (w * p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(pull), design.T @ (w * (y - p)) - pull * (beta - center))
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), tuple(float(b) for b in beta[1:])


RESULT = pa.struct([("score", pa.float64()), ("predicted", pa.int32())])


def scored(text: Column, grammar: Grammar) -> Column:
    """A struct of score and predicted."""

    @F.arrow_udf("score double, predicted int")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [grammar.score(x.as_py() or "") for x in batch]
            yield pa.StructArray.from_arrays([pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], fields=list(RESULT))

    return score(text)


def toxicity(docs: DataFrame, grammar: Grammar, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of docs with the columns of keep, score and predicted (1 if score >= 0.5)."""
    return with_results(docs, keep, scored(F.col(text), grammar), (f.name for f in RESULT))
