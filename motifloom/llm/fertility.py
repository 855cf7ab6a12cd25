"""Quality rules from tokeniser fertility.

Public vocabularies encode each whole text; characters per token, the share of byte-fallback tokens and the entropy of
the token distribution are held against rejection bands for the text's main script and, where the language is known, for
the language. Plain base figures of the words stand beside them. Texts are measured where they are read, without a
shuffle; what the limits of the languages need are counts of rounded figures, added up in each task first.

Null and empty texts have no words and no tokens; they fail the base rules. A text without letters has the script
`none`; of scripts with equally many letters the one named first in SCRIPTS counts. A script without a band of its own
has that of `other`. Repeated rows give repeated rows, an empty table an empty table. A column of keep that is named
like a result comes back with `_in` appended.

Texts of any length are encoded as wholes: the runs in which long ones go through the libraries end where the libraries
would not merge across anyway (``pretoken.SEAM``), so ids and all figures are those of the whole text. Parts between seams
that a task has met before are looked up (``Parts``). What a task holds beyond that bounded table is one text's tokens.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat
from string import ascii_letters

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from ._common import bounded, kept_names, materialize, read_bounded, with_results
from .bpe_tree import parse_ranks
from .pretoken import LONG, encode_ordinary, seamed

SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\v\f\r"
_UNEVEN = re.compile(r"\s ")
_ASCII_LETTER = re.compile("[A-Za-z]")
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "DEVANAGARI", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "THAI")


@dataclass(frozen=True)
class Band:
    """A text outside these limits is rejected."""

    min_chars_per_piece: float  # of a vocabulary with byte fallback
    min_chars_per_rank: float  # of a byte-level vocabulary
    max_chars_per_token: float
    max_fallback: float
    min_entropy: float  # bits


#: Wide bands: what running text of the script stays within under vocabularies of 30,000 to 50,000 tokens. Text strewn
#: with symbols falls under the byte-level limit, repeated or padded text under the entropy.
BANDS = {
    "LATIN": Band(1.5, 2.0, 7.0, 0.10, 4.5),
    "CYRILLIC": Band(0.6, 0.8, 6.0, 0.60, 4.5),
    "GREEK": Band(0.5, 0.6, 6.0, 0.70, 3.5),
    "CJK": Band(0.3, 0.3, 2.5, 0.90, 4.5),
    "HIRAGANA": Band(0.3, 0.3, 3.0, 0.90, 4.5),
    "HANGUL": Band(0.3, 0.3, 3.0, 0.90, 4.5),
    "other": Band(0.25, 0.25, 8.0, 0.95, 3.5),
    "none": Band(0.8, 0.8, 4.0, 0.20, 5.0),
}


class Pieces:
    """A sentencepiece model with byte fallback.

    Where no piece has its blank mark after another character and the normaliser changes nothing, no merge crosses a
    blank that follows another character, so runs of a long text between such blanks are encoded apart: the mark that
    the model puts before each of them stands for the blank. Other models encode all texts in one piece.
    """

    least = "min_chars_per_piece"
    leads = True  # a text is encoded as if a blank stood before it

    def __init__(self, data: bytes):
        proto = sentencepiece_model_pb2.ModelProto.FromString(data)
        norm = proto.normalizer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        self.parted = plain and not proto.trainer_spec.treat_whitespace_as_suffix and not any("\u2581" in p.piece.lstrip("\u2581") for p in proto.pieces)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        size = self.model.get_piece_size()
        self.fallback = np.fromiter((self.model.is_byte(i) or self.model.is_unknown(i) for i in range(size)), bool, size)
        self.parted = self.parted and not self.fallback[self.model.piece_to_id("\u2581")]
        #: Tokens that begin with the mark of a blank.
        self.begins = np.fromiter((p.piece.startswith("\u2581") for p in proto.pieces), bool, size)

    def after_blank(self, text: str) -> np.ndarray:
        """The ids of a text that stands behind a seam, with those of the blank."""
        return np.array(self.model.encode(text), np.int32)

    def encode(self, text: str) -> np.ndarray:
        runs = seamed(text) if self.parted else [text]
        return np.concatenate([self.after_blank(run[1:] if i else run) for i, run in enumerate(runs)])


class Ranks:
    """A byte-level rank file. Fallback tokens are those that are no whole characters."""

    least = "min_chars_per_rank"
    leads = False
    parted = True

    def __init__(self, data: bytes):
        ranks = parse_ranks(data)
        self.coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.fallback, self.begins = np.zeros((2, max(ranks.values()) + 1), bool)
        for token, rank in ranks.items():
            self.fallback[rank] = not _whole(token)
            self.begins[rank] = token.startswith(b" ")

    def after_blank(self, text: str) -> np.ndarray:
        return np.array(encode_ordinary(self.coder, " " + text), np.int32)

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.array(encode_ordinary(self.coder, run), np.int32) for run in seamed(text)])


def _whole(token: bytes) -> bool:
    try:
        token.decode()
        return True
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=4)
def vocabulary(name: str, data: bytes) -> Pieces | Ranks:
    """Each vocabulary once a Python worker."""
    return Pieces(data) if name.endswith(".model") else Ranks(data)


class Parts:
    """Ids of texts under several vocabularies that may be parted at seams: each part is split off once and encoded once for as long as it is held.

    Of a part behind a seam the first token begins with the blank (or its mark) and no other does, as parts hold no blanks.
    So all new parts of a text are encoded in one call and told apart by the tokens that begin so.
    """

    #: Characters of the parts that are held at most (some 450,000 parts of running text), beyond one text's.
    HELD = 1 << 22

    def __init__(self, vocabs: list[Pieces | Ranks]):
        self.vocabs = vocabs
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        # part k has the ids from ends[k] to before ends[k + 1]
        self.ids = [np.empty(1 << 12, np.int32) for _ in self.vocabs]
        self.ends = [np.zeros(1 << 12, np.int64) for _ in self.vocabs]

    def _learn(self, new: list[str]) -> bool:
        """Encodes and holds new parts, unless one is empty, ends in white space or holds the mark that stands for blanks."""
        joined = " ".join(new)
        if not joined or joined[0] == " " or joined[-1].isspace() or "\u2581" in joined or _UNEVEN.search(joined):
            return False
        n, m = len(self.known), len(new)
        for k, vocab in enumerate(self.vocabs):
            ids, used = vocab.after_blank(joined), self.ends[k][n]
            begins = np.flatnonzero(vocab.begins[ids])
            if len(begins) != m:
                raise RuntimeError("a part does not begin with a token of its own")
            while used + len(ids) > len(self.ids[k]):
                self.ids[k] = np.concatenate([self.ids[k], np.empty_like(self.ids[k])])
            while n + m >= len(self.ends[k]):
                self.ends[k] = np.concatenate([self.ends[k], np.zeros_like(self.ends[k])])
            self.ids[k][used : used + len(ids)] = ids
            self.ends[k][n + 1 : n + m + 1] = used + np.append(begins[1:], len(ids))
        self.known.update(zip(new, range(n, n + m), strict=True))
        self.chars += len(joined)
        return True

    def _numbers(self, text: str) -> np.ndarray | None:
        """The numbers of a text's parts; None where a blank in it is no seam."""
        if len(text) > 2 * LONG:
            return None
        parts, known = text.split(" "), self.known
        which = np.fromiter(map(known.get, parts, repeat(-1)), np.int64, len(parts))
        at = np.flatnonzero(which < 0).tolist()
        if at:
            if not self._learn(list(dict.fromkeys(parts[i] for i in at))):
                return None
            which[at] = [known[parts[i]] for i in at]
        return which

    def _gathered(self, k: int, which: np.ndarray) -> np.ndarray:
        begins = self.ends[k][which]
        n = self.ends[k][which + 1] - begins
        upto = np.cumsum(n)
        return self.ids[k][np.repeat(begins - upto + n, n) + np.arange(n.sum())]

    def encode(self, text: str) -> list[np.ndarray]:
        """The ids of a text under each vocabulary."""
        if self.chars > self.HELD:
            self._clear()
        out: list[list[np.ndarray]] = [[] for _ in self.vocabs]
        for i, run in enumerate(seamed(text)):
            body, tail = run[1:] if i else run, ""
            if body[-1:].isspace():  # the end of a text needs no seam behind it
                body, _, tail = body.rpartition(" ")
                which = self._numbers(body) if tail else None
            else:
                which = self._numbers(body)
            for k, (vocab, ids) in enumerate(zip(self.vocabs, out, strict=True)):
                if which is None:
                    ids.append(vocab.after_blank(run[1:]) if i else vocab.encode(run))
                    continue
                if i or vocab.leads:
                    ids.append(self._gathered(k, which))
                else:
                    ids += [vocab.encode(body.partition(" ")[0]), self._gathered(k, which[1:])]
                if tail:
                    ids.append(vocab.after_blank(tail))
        return [np.concatenate(ids) for ids in out]


@lru_cache(maxsize=1)
def _script_table() -> np.ndarray:
    """The script of each code point: its place in SCRIPTS, len(SCRIPTS) for other letters, 255 for what is no letter."""
    places = {s: i for i, s in enumerate(SCRIPTS)}
    table = np.full(0x110000, 255, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            table[c] = places.get(unicodedata.name(chr(c), "").split(" ")[0], len(SCRIPTS))
    return table


def main_script(text: str) -> str:
    """The script of most letters; ties go to the one named first."""
    if text.isascii():
        return "LATIN" if _ASCII_LETTER.search(text) else "none"
    plain = text.encode("utf-8", "replace")
    if 2 * (len(plain) - len(plain.translate(None, ascii_letters.encode()))) > len(text):
        return "LATIN"
    n = np.bincount(_script_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=256)[: len(SCRIPTS) + 1]
    return "none" if not n.any() else (*SCRIPTS, "other")[int(n.argmax())]


def base_figures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode("utf-8", "replace")
    words = data.split()  # bytes part at the same six characters as WORD
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeat = 0
    if len(words) > 3:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        pairs = ids[:-1] * len(known) + ids[1:]
        if len(known) ** 3 >= 1 << 62:  # pairs that occur are numbered first
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(known) + ids[2:]
        ordered = np.sort(windows)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            covered = np.zeros(len(words), bool)
            at = np.flatnonzero(np.isin(windows, twice))
            for k in range(3):
                covered[at + k] = True
            repeat = int(covered.sum())
    n_blanks = len(data) - len(data.translate(None, BLANKS))
    return len(words), len(text) - n_blanks, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat


def fertility(text: str, vocab: Pieces | Ranks) -> tuple[int, float, float]:
    """n_tokens, fallback share and entropy (bits) of a text."""
    return token_figures(vocab.encode(text), vocab)


def token_figures(ids: np.ndarray, vocab: Pieces | Ranks) -> tuple[int, float, float]:
    if not len(ids):
        return 0, 0.0, 0.0
    ids = np.sort(ids)
    begins = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
    n = np.diff(begins)
    fallback = n[vocab.fallback[ids[begins[:-1]]]].sum()
    return len(ids), float(fallback / len(ids)), float(np.log2(len(ids)) - (n * np.log2(n)).sum() / len(ids))


def within(band: Band, n_chars: int, figures: list[tuple[int, float, float]], vocabs: list[Pieces | Ranks]) -> bool:
    """The verdict: no vocabulary's figures are outside the band."""
    return all(
        tokens > 0 and getattr(band, vocab.least) <= n_chars / tokens <= band.max_chars_per_token and fallback <= band.max_fallback and entropy >= band.min_entropy
        for (tokens, fallback, entropy), vocab in zip(figures, vocabs, strict=True)
    )


def language_limits(measured: DataFrame, spread: float, prior: float) -> DataFrame:
    """From rows of language, n_words and chars_per_token: language, usual (the median of n_words), trust, and limits: for each vocabulary its median (`middle`) and `width`.

    trust is n / (n + prior) of a language with n rows. Quartiles are exact to a thousandth: rows are counted by that
    first, so a language's rows never meet in one task.
    """
    figures = F.concat(F.array(F.col("n_words").cast("double")), F.transform("chars_per_token", lambda x: F.floor(x * 1000).cast("double")))
    counted = measured.where(F.col("language").isNotNull()).select("language", F.posexplode(figures).alias("k", "bin")).groupBy("language", "k", "bin").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("language", "k").orderBy("bin")
    placed = counted.withColumn("upto", F.sum("n").over(so_far)).withColumn("total", F.sum("n").over(Window.partitionBy("language", "k")))
    quarter = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bin")))
    found = placed.groupBy("language", "k").agg(quarter(1).alias("low"), quarter(2).alias("middle"), quarter(3).alias("high"), F.max("total").alias("total"))
    one = F.struct("k", (F.col("middle") / 1000).alias("middle"), (F.lit(spread) * (F.col("high") - F.col("low")) / 1349).alias("width"))
    by_language = found.groupBy("language").agg(
        F.max(F.when(F.col("k") == 0, F.col("middle"))).alias("usual"), F.array_sort(F.collect_list(F.when(F.col("k") > 0, one))).alias("limits"),
        (F.max("total") / (F.max("total") + F.lit(prior))).alias("trust"),
    )
    return by_language


def quality(docs: DataFrame, vocabulary_paths: tuple[str, ...], bands: dict[str, Band] | None = None, min_words: int = 50, max_repeat_percent: int = 50, text: str = "text", keep: tuple[str, ...] = ("doc_id",), language: str | None = None, spread: float = 4.0, prior: float = 2.0) -> DataFrame:
    """Rows of docs with the columns of keep, the base figures, script, chars_per_token, fallback_share, token_entropy and band_least, the least characters per token of the script's band (arrays in the order of the vocabularies), base_failed and kept.

    With the name of a language column, a text must also stay above the limits of its language: under each vocabulary its
    characters per token are at least the median of the language's texts less `spread` standard deviations (estimated
    by the quartiles; wider for texts that are shorter than the median, as their mean varies more). The limits come from
    all texts that pass the base rules, so most of them should be running text. The fewer those are, the nearer a
    language's limit lies to the lower end of its script's band: it counts like `prior` texts beside them. A null
    language has only the band.
    """
    bands = bands or BANDS
    shared = [(os.path.basename(p), read_bounded(p)) for p in vocabulary_paths]

    def one(x: str, vocabs: list[Pieces | Ranks], parts: Parts) -> tuple:
        by_parts = iter(parts.encode(x))
        figures = [token_figures(next(by_parts) if v.parted else v.encode(x), v) for v in vocabs]
        script, base = main_script(x), base_figures(x)
        failed = base[0] < min_words or 100 * base[4] > max_repeat_percent * base[0]
        band = bands.get(script, bands["other"])
        kept = not failed and within(band, len(x), figures, vocabs)
        return (*base, script, [len(x) / max(1, f[0]) for f in figures], [f[1] for f in figures], [f[2] for f in figures], [getattr(band, v.least) for v in vocabs], failed, kept)

    @F.arrow_udf(MEASURED_DDL)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabs = [vocabulary(*x) for x in shared]
        parts = Parts([v for v in vocabs if v.parted])
        blank = one("", vocabs, parts)
        for batch in batches:
            distinct = batch.dictionary_encode()  # repeated texts of a batch are measured once
            measured = [one(x.as_py() or "", vocabs, parts) for x in distinct.dictionary]
            rows = [blank if k is None else measured[k] for k in distinct.indices.to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(MEASURED)
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MEASURED, strict=True)], fields=list(MEASURED))

    names = [f.name for f in MEASURED]
    if language is None:
        return with_results(docs, keep, measure(F.col(text)), names)
    own = kept_names(keep, names)
    kept_columns = F.struct(*(F.col(c).alias(n) for c, n in own.items())) if own else F.lit(0)
    rows = materialize(docs.select(kept_columns.alias("own"), F.col(language).cast("string").alias("language"), measure(F.col(text)).alias("made")))
    limits = materialize(language_limits(rows.where(~F.col("made.base_failed")).select("language", "made.n_words", "made.chars_per_token"), spread, prior))
    met = rows.join(bounded(limits), "language", "left")
    wider = F.sqrt(F.greatest(F.lit(1.0), F.col("usual") / F.greatest(F.col("made.n_words"), F.lit(1))))
    lowest = F.zip_with("limits", "made.band_least", lambda own, band: F.col("trust") * (own["middle"] - own["width"] * wider) + (1 - F.col("trust")) * band)
    above = F.zip_with("made.chars_per_token", lowest, lambda x, least: x >= least)
    kept = F.col("made.kept") & F.coalesce(F.forall(above, lambda x: x), F.lit(True))
    return met.select(*(F.col("own").getField(n).alias(n) for n in own.values()), *(F.col("made").getField(n).alias(n) for n in names[:-1]), kept.alias("kept"))


_LIST = pa.list_(pa.float64())
MEASURED = pa.struct([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("script", pa.string()), ("chars_per_token", _LIST), ("fallback_share", _LIST), ("token_entropy", _LIST), ("band_least", _LIST), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
])
MEASURED_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, chars_per_token array<double>, fallback_share array<double>, token_entropy array<double>, band_least array<double>, base_failed boolean, kept boolean"
