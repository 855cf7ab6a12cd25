"""Token counts by rank-synchronous array merging.

Texts are split into pre-tokens; those of a block of texts that are not yet known are held as one ragged numpy array of
symbols. In each round every sequence applies its pair of lowest rank, at all its places at once; a sequence without a
known pair is finished, and its surviving symbols are counted. That equals merging one pair at a time because a merge
only makes pairs of higher rank, which is checked when the vocabulary is read.

Row-local, without a shuffle. Null texts count as empty (0 bytes, 0 tokens); repeated rows give repeated rows, an empty
table an empty table. Texts of any length are counted as wholes; a task holds the symbols of about a million characters,
or of one longer text. A column of keep that is named like a result comes back with `_in` appended.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, read_bounded, with_results
from .pretoken import SPLIT

NONE = np.int64(1) << 40


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RankMerger:
    """Counts tokens of pre-tokens under a merge list. memo_size bounds the table of remembered counts."""

    def __init__(self, vocabulary: dict, memo_size: int = 300_000):
        model, self.memo_size = vocabulary["model"], memo_size
        pre = vocabulary.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or vocabulary.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("only byte-level BPE vocabularies without a normalizer are counted here")
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        born = np.full(max(ids.values()) + 1, -1, np.int64)
        born[made[::-1]] = np.arange(len(merges))[::-1]
        if len(merges) and not ((born[left] < np.arange(len(merges))) & (born[right] < np.arange(len(merges)))).all():
            raise ValueError("a merge comes before one that makes its parts")
        self.width = np.int64(len(born))
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = np.append(keys[order], np.iinfo(np.int64).max), np.append(order.astype(np.int64), NONE), made
        self.first = np.array([ids[s] for _, s in sorted(byte_symbols().items())], np.int64)
        self.special = [t["content"] for t in vocabulary.get("added_tokens", [])]
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merged_sizes(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols left of each piece."""
        out = np.zeros(len(pieces), np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        owner = np.flatnonzero(sizes)
        sizes = sizes[owner]
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        if not len(symbols):
            return out
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        ranks = np.full(len(symbols), NONE)
        inner = np.flatnonzero(~last)
        ranks[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        while len(owner):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(ranks, starts)
            going = least < NONE
            if not going.all():
                out[owner[~going]] = sizes[~going]
                hold = np.repeat(going, sizes)
                symbols, ranks, last = symbols[hold], ranks[hold], last[hold]
                owner, sizes, least = owner[going], sizes[going], least[going]
                if not len(owner):
                    break
            hit = ranks == np.repeat(least, sizes)
            # of overlapping places (as in "aaa") every second one from the left
            at = np.flatnonzero(hit)
            new_run = np.ones(len(at), bool)
            new_run[1:] = at[1:] != at[:-1] + 1
            run = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            sequence = np.repeat(np.arange(len(owner)), sizes)
            symbols[at] = self.made[ranks[at]]
            last[at] = last[at + 1]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            sizes = sizes - np.bincount(sequence[at], minlength=len(owner))
            moved = np.cumsum(stay) - 1
            symbols, ranks, last = symbols[stay], ranks[stay], last[stay]
            touched = np.unique(np.concatenate([moved[at], moved[at] - 1]))
            touched = touched[touched >= 0]
            ranks[touched] = NONE
            inner = touched[~last[touched]]
            ranks[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Special strings inside texts are one token each and part what stands around them."""
        counts, split = [], []
        for text in texts:
            parts = [text]
            for content in self.special:
                if content in text:
                    parts = [y for x in parts for y in x.split(content)]
            counts.append(len(parts) - 1)
            split.append([p for x in parts for p in SPLIT.findall(x)])
        if len(self.memo) >= self.memo_size:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        unknown = {p for pieces in split for p in pieces}.difference(memo)
        new = [p for p in unknown if p not in older]
        memo.update((p, older[p]) for p in unknown.difference(new))
        memo.update(zip(new, self.merged_sizes([p.encode("utf-8", "replace") for p in new]).tolist(), strict=True))
        return [n + sum(map(memo.__getitem__, pieces)) for n, pieces in zip(counts, split, strict=True)]


@lru_cache(maxsize=4)
def merger(data: bytes) -> RankMerger:
    """One merger for each vocabulary and Python worker."""
    return RankMerger(json.loads(data))


COUNTS = pa.struct([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 1024, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of docs with the columns of keep, n_bytes, n_tokens and over_limit (more than limit tokens)."""
    data = read_bounded(vocabulary_path)

    @F.arrow_udf("n_bytes long, n_tokens long, over_limit boolean")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = merger(data)
        for batch in batches:
            sizes, tokens = [], []
            for block in blocks(x.as_py() for x in batch):
                tokens += own.count(block)
                sizes += [len(x.encode("utf-8", "replace")) for x in block]
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], fields=list(COUNTS))

    return with_results(docs, keep, count(F.col(text)), (f.name for f in COUNTS))
