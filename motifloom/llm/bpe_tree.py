"""Byte-level BPE encoding and decoding by monoid tree reduction.

The encodings of adjacent pieces form a monoid: an operator joins the encodings of x and y into that of x + y. Each text
is halved down to leaves, and neighbours are joined up the tree. Two levels use the same idea:

* Splits of a text into pre-tokens. A join splits a window around the cut again, and grows it until both its ends are
  places where splitting restarts whatever stands outside (``pretoken.is_restart``), so the outer pre-tokens are stable.
* Tokens inside one pre-token. A join re-encodes a window of the last and first tokens, and grows it until the tokens
  at both seams are compatible, i.e. the pair encodes to itself. A sequence of tokens is the BPE encoding of its bytes
  exactly if every adjacent pair is compatible, so the tokens outside the window are stable.

Decoding joins token bytes up a tree of halves. Nothing is shuffled: each row is encoded where it is read.

Null texts count as empty. An empty text has no tokens; its digests are those of the empty string. Repeated rows give
repeated rows, an empty table an empty table. Texts of any length are encoded as wholes, one at a time; pre-tokens of any
length keep short windows at their joins. Columns beyond the id are passed only if named in ``keep``; one that is named
like a result comes back with `_in` appended.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import blocks, read_bounded, with_results
from .pretoken import SPLIT, is_restart

Tokens = tuple[int, ...]


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class TreeCodec:
    """Encoder and decoder for one table of ranks. memo_size bounds each of its tables of remembered pieces."""

    def __init__(self, ranks: dict[bytes, int], split: regex.Pattern = SPLIT, leaf_chars: int = 8192, memo_size: int = 200_000):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must hold every single byte")
        self.ranks, self.split, self.leaf_chars, self.memo_size = ranks, split, leaf_chars, memo_size
        self.token = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.token[rank] = piece
        self.forget()

    def forget(self) -> None:
        """Drops what is remembered; tasks do so at their end, as Python workers live on with other operators."""
        self._window: dict[Tokens, Tokens] = {}
        self._part: dict[bytes, Tokens] = {}
        self._piece: dict[str, Tokens] = {}
        self._older: dict[str, Tokens] = {}

    def _scan(self, data: bytes) -> Tokens:
        """Encodes a short window: merge the adjacent pair of lowest rank, the leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts)

    def _again(self, window: Tokens) -> Tokens:
        """The encoding of the bytes of these tokens."""
        known = self._window.get(window)
        if known is None:
            if len(self._window) >= self.memo_size:
                self._window.clear()
            known = self._window[window] = self._scan(b"".join(map(self.token.__getitem__, window)))
        return known

    def _compatible(self, left: int, right: int) -> bool:
        return self._again(pair := (left, right)) == pair

    def join(self, left: Tokens, right: Tokens) -> Tokens:
        """The encoding of the bytes of left followed by those of right, both encodings themselves."""
        if not left or not right or self._compatible(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            window = self._again(left[len(left) - a :] + right[:b])
            calm_left = a == len(left) or self._compatible(left[-a - 1], window[0])
            calm_right = b == len(right) or self._compatible(window[-1], right[b])
            if calm_left and calm_right:
                return left[: len(left) - a] + window + right[b:]
            a, b = (a if calm_left else min(len(left), 2 * a)), (b if calm_right else min(len(right), 2 * b))

    def encode_bytes(self, data: bytes) -> Tokens:
        """Halves, encodes and joins."""
        if len(data) < 2:
            return (self.ranks[data],) if data else ()
        known = self._part.get(data)
        if known is None:
            half = len(data) // 2
            known = self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))
            if len(data) <= 64:
                if len(self._part) >= self.memo_size:
                    self._part.clear()
                self._part[data] = known
        return known

    def encode_piece(self, piece: str) -> Tokens:
        """A pre-token; one that is a token as a whole is that token."""
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        return self.encode_bytes(data) if whole is None else (whole,)

    def split_text(self, text: str) -> list[str]:
        """The pre-tokens of a text, by halves."""
        if len(text) <= self.leaf_chars:
            return self.split.findall(text)
        half = len(text) // 2
        left, right = self.split_text(text[:half]), self.split_text(text[half:])
        a = b = 1
        while True:
            window = left[len(left) - a :] + right[:b]
            calm_left = a == len(left) or is_restart(left[-a - 1][-1], window[0][0])
            calm_right = b == len(right) or is_restart(window[-1][-1], right[b][0])
            if calm_left and calm_right:
                del left[len(left) - a :]
                left += self.split.findall("".join(window))
                left += right[b:]
                return left
            a, b = (a if calm_left else min(len(left), 2 * a)), (b if calm_right else min(len(right), 2 * b))

    def encode(self, text: str) -> list[int]:
        pieces = self.split_text(text)
        if len(self._piece) >= self.memo_size:
            self._piece, self._older = {}, self._piece
        known, older = self._piece, self._older
        for piece in set(pieces).difference(known):
            known[piece] = older.get(piece) or self.encode_piece(piece)
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids: list[int], leaf_ids: int = 65536) -> bytes:
        """Leaves of token bytes, concatenated up the tree."""
        if len(ids) <= leaf_ids:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half], leaf_ids) + self.decode(ids[half:], leaf_ids)


@lru_cache(maxsize=4)
def codec(data: bytes) -> TreeCodec:
    """One codec for each vocabulary and Python worker."""
    return TreeCodec(parse_ranks(data))


ENCODED = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
DIGESTS = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encoded(text: Column, ranks_path: str) -> Column:
    """A struct of the text's ids and of the bytes that they decode to."""
    data = read_bounded(ranks_path)

    @F.arrow_udf("ids array<int>, decoded binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code = codec(data)
        for batch in batches:
            done = [pa.array([], ENCODED)]
            for block in blocks(_texts(batch)):  # Python's lists of ids are held for a block at a time
                done.append(pa.array([{"ids": (ids := code.encode(x)), "decoded": code.decode(ids)} for x in block], ENCODED))
            yield pa.concat_arrays(done)
        code.forget()

    return encode(text)


def encode_documents(docs: DataFrame, ranks_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of docs with the columns of keep, ids (array of int) and decoded (binary)."""
    return with_results(docs, keep, encoded(F.col(text), ranks_path), (f.name for f in ENCODED))


def encoding_digests(docs: DataFrame, ranks_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As encode_documents, with the number of ids and digests of ids and decoded bytes in place of them.

    ids_sha256 is of the decimal ids joined by commas. Ids and bytes never leave the task, so memory and Arrow batches
    stay small for very long texts.
    """
    data = read_bounded(ranks_path)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code = codec(data)
        decimal = [str(i) for i in range(len(code.token))]
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in _texts(batch):
                ids = code.encode(text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(code.decode(ids)).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], fields=list(DIGESTS))
        code.forget()
        pa.default_memory_pool().release_unused()

    return with_results(docs, keep, digest(F.col(text)), (f.name for f in DIGESTS))


def _texts(batch: pa.Array) -> Iterable[str]:
    """Null is empty; one text at a time becomes a Python string."""
    return (x.as_py() or "" for x in batch)
