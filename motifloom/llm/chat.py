"""Chat formatting by token-level assembly.

Each turn's segments are encoded separately, and reserved ids beyond the vocabulary are spliced between them: one that
opens the turn (by role), one that closes it. No content can encode to a reserved id. The same control strings could
still occur in the text that a conversation renders to, so in contents each of them, and each backslash, gets a
backslash before it; taking one backslash away from each pair undoes that exactly.

The loss mask comes from prefix sums: +1 where an assistant's content begins, -1 where it ends. Turns are formatted
where they are read; a conversation's output is its turns' outputs in order, at token offsets that are running sums of
their lengths. Reading back walks the ids of a conversation in order as a stream, holding one turn at a time, so a very
long conversation needs no memory beyond its longest turn (its digest is one sequential computation by nature).

Null texts and roles count as empty. Roles other than system, user and assistant are kept as a segment of their own.
Turns with equal numbers are ordered by role, then text; null turn numbers come first. Rows with a null conv_id make
up one conversation. Repeated rows are repeated turns. Texts of any length are encoded as wholes, in runs that end where
the library would not merge across. An empty table gives an empty table. Other columns of the rows are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import blocks, read_bounded
from .bpe_tree import parse_ranks
from .pretoken import encode_ordinary

ROLES = ("system", "user", "assistant")
#: The text that each reserved id renders to, in the order of the ids.
CONTROLS = ("### System:", "### User:", "### Assistant:", "### Other:", "</role>", "</turn>")
OTHER, ROLE_END, TURN_END = 3, 4, 5
BETWEEN = "\n"
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPE = re.compile(r"\\|" + _CONTROL.pattern)
_UNESCAPE = re.compile(r"\\(\\|" + _CONTROL.pattern + ")")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


class ChatCodec:
    def __init__(self, ranks: dict[bytes, int]):
        self.base = max(ranks.values()) + 1
        self.coder = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token = [b""] * self.base
        for token, rank in ranks.items():
            self.token[rank] = token
        self.token += [c.encode() for c in CONTROLS]
        self.between = self.coder.encode_ordinary(BETWEEN)

    def format_turn(self, role: str, text: str) -> tuple[list[int], np.ndarray]:
        """Ids and loss mask of a turn."""
        content = encode_ordinary(self.coder, escape(text))
        if role in ROLES:
            ids = [self.base + ROLES.index(role)]
        else:
            ids = [self.base + OTHER, *encode_ordinary(self.coder, escape(role)), self.base + ROLE_END]
        begin = len(ids)
        ids += [*content, self.base + TURN_END, *self.between]
        change = np.zeros(len(ids), np.int8)
        if role == "assistant" and content:
            change[begin] += 1
            change[begin + len(content)] -= 1
        return ids, np.cumsum(change, dtype=np.int8)

    def text(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8")


class Reader:
    """Reads one conversation back from its ids and mask, fed in order in parts of whole turns."""

    def __init__(self, code: ChatCodec):
        self.code = code
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, ids: list[int], mask: list[int]) -> None:
        code, at = self.code, 0
        while at < len(ids):
            kind = ids[at] - code.base
            end = ids.index(code.base + TURN_END, at)
            begin = at + 1
            if kind == OTHER:
                role_end = ids.index(code.base + ROLE_END, at)
                role, begin = unescape(code.text(ids[begin:role_end])), role_end + 1
            else:
                role = ROLES[kind]
            text = unescape(code.text(ids[begin:end]))
            self.all.update(f"{role}\n{text}\n".encode())
            # what the mask selects, decoded on its own
            taken = unescape(code.text([i for i, m in zip(ids[at:end], mask[at:end], strict=True) if m]))
            self.loss.update(taken.encode())
            self.loss_chars += len(taken)
            self.turns += 1
            at_next = end + 1 + len(code.between)
            self.chars += len(code.text(ids[at:at_next]))
            at = at_next


@lru_cache(maxsize=4)
def codec(data: bytes) -> ChatCodec:
    return ChatCodec(parse_ranks(data))


FORMATTED = pa.struct([("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int8()))])


def formatted_turns(conversations: DataFrame, ranks_path: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For each turn: conv_id, turn, role, text (as they are), ids, mask."""
    data = read_bounded(ranks_path)

    @F.arrow_udf("ids array<int>, mask array<tinyint>")
    def assemble(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        code = codec(data)
        for roles, texts in batches:
            done, at = [pa.array([], FORMATTED)], 0
            for block in blocks(t.as_py() for t in texts):
                made = [code.format_turn(r.as_py() or "", t) for r, t in zip(roles[at : at + len(block)], block, strict=True)]
                done.append(pa.StructArray.from_arrays([pa.array([m[0] for m in made], FORMATTED[0].type), pa.array([m[1] for m in made], FORMATTED[1].type)], fields=list(FORMATTED)))
                at += len(block)
            yield pa.concat_arrays(done)

    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return rows.withColumn("_f", assemble(F.col("role"), F.col("text"))).select("conv_id", "turn", "role", "text", F.col("_f.ids").alias("ids"), F.col("_f.mask").alias("mask"))


_ORDER = ("turn", "role", "text")


def assembled(turns: DataFrame) -> DataFrame:
    """formatted_turns with the token offset of each turn in its conversation's output, in place of the texts."""
    before = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in _ORDER)).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)).cast("long")
    return turns.withColumn("offset", offset).select("conv_id", "turn", "role", "offset", "ids", "mask")


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(turns: DataFrame, ranks_path: str) -> DataFrame:
    """Digests of each conversation, read back from the ids and masks of formatted_turns."""
    data = read_bounded(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, now, reader, done = codec(data), None, None, []

        def close() -> None:
            if reader is not None:
                done.append((now, reader.turns, reader.all.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))

        for batch in batches:
            for i, key in enumerate(batch.column("conv_id").to_pylist()):
                if reader is None or key != now:
                    close()
                    now, reader = key, Reader(code)
                reader.feed(batch.column("ids")[i].as_py(), batch.column("mask")[i].as_py())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), READ, strict=True)], schema=READ)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), READ, strict=True)], schema=READ)

    ordered = turns.withColumn("conv_id", F.col("conv_id").cast("long")).repartition("conv_id").sortWithinPartitions("conv_id", *(F.col(c).asc_nulls_first() for c in _ORDER))
    return ordered.select("conv_id", "ids", "mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
