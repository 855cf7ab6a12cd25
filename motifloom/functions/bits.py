"""Pattern growth over bitmaps of positions: what a task does with a bounded block of records.

A row is an item of a record, its words are the sets of the record that hold the item, a bit each. Steps are numbers as in
`ragged`: twice the code, plus 1 if the item joins the pattern's last set. A projection is one row of words for each record:
the sets in which the pattern's last set can lie. Projections are made on the way down a tree of candidates, so those of
one path are held, and the growth of one pattern has a row for each row of the block; memory is bounded by the block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from motifloom.functions import ragged


@dataclass(frozen=True)
class Block:
    """Of each row: its code and its record, from 0, ascending. words is (words, rows)."""

    code: np.ndarray
    record: np.ndarray
    words: np.ndarray

    @cached_property
    def length(self) -> np.ndarray:
        """Rows of each record."""
        return np.bincount(self.record)

    @cached_property
    def begin(self) -> np.ndarray:
        return np.cumsum(self.length) - self.length

    @cached_property
    def _by_code(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.code, kind="stable")  # records rise within a code
        return order, self.code[order]

    def rows(self, code: int) -> np.ndarray:
        order, codes = self._by_code
        return order[slice(*np.searchsorted(codes, [code, code + 1]))]


def blocks_of(bits: pa.Array, code: np.ndarray, record: np.ndarray, held: int = ragged.HELD) -> Iterator[Block]:
    """From lists of words of rows that are sorted by record. Records of about as many words come together, up to about held words and those of one record."""
    own = bits.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values, start = bits.flatten().to_numpy(zero_copy_only=False), np.cumsum(own) - own
    begin = np.flatnonzero(np.append(True, record[1:] != record[:-1]))
    length = np.diff(np.append(begin, len(record)))
    size = np.maximum.reduceat(own, begin)
    size = 1 << np.ceil(np.log2(size)).astype(np.int64)  # padded to a power of two
    for n in np.unique(size).tolist():
        same = np.flatnonzero(size == n)
        parts = np.flatnonzero(np.diff(np.cumsum(length[same] * n) // held)) + 1
        for chosen in np.split(same, parts):
            rows = ragged.runs(begin[chosen], length[chosen])
            words = np.zeros((n, len(rows)), np.int64)
            for w in range(n):
                has = np.flatnonzero(own[rows] > w)
                words[w, has] = values[start[rows[has]] + w]
            yield Block(code[rows], np.repeat(np.arange(len(chosen)), length[chosen]), words)


@dataclass(frozen=True)
class Places:
    """A pattern's records, ascending, and of each the sets in which the pattern's last set can lie: (words, records)."""

    block: Block
    record: np.ndarray
    bits: np.ndarray

    @cached_property
    def after(self) -> np.ndarray:
        """All sets after the first one: of the first word all bits above its lowest one, of later words all."""
        above = -2 * (self.bits & -self.bits)
        if len(above) == 1:
            return above
        first, word = np.argmax(self.bits != 0, axis=0), np.arange(len(above))[:, None]
        return np.where(word < first, 0, np.where(word > first, -1, above))

    @property
    def _everywhere(self) -> bool:
        return len(self.record) == len(self.block.length)

    def grown(self, step: int) -> Places:
        """One step longer."""
        rows = self.block.rows(step >> 1)
        record = at = self.block.record[rows]
        if not self._everywhere:
            at = np.minimum(np.searchsorted(self.record, record), len(self.record) - 1)
            met = self.record[at] == record
            rows, record, at = rows[met], record[met], at[met]
        bits = (self.bits if step & 1 else self.after)[:, at] & self.block.words[:, rows]
        on = bits.any(axis=0)
        return Places(self.block, record[on], bits[:, on])

    def steps(self, last: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(step, support) of all steps that the pattern, whose last item is `last`, can grow by."""
        length = self.block.length[self.record]
        rows = slice(None) if self._everywhere else ragged.runs(self.block.begin[self.record], length)
        code = self.block.code[rows]
        later, same = np.zeros(len(code), bool), np.zeros(len(code), bool)
        for own, after, words in zip(self.bits, self.after, self.block.words, strict=True):
            words = words[rows]
            later |= np.repeat(after, length) & words != 0
            same |= np.repeat(own, length) & words != 0
        step = np.concatenate([2 * code[later], 2 * code[same & (code > last)] + 1])
        if width > len(step):  # many items, few rows
            return np.unique(step, return_counts=True)
        support = np.bincount(step, minlength=width)
        found = np.flatnonzero(support)
        return found, support[found]


def begun(blocks: Iterable[Block]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(step, support) of all patterns of one item."""
    for block in blocks:
        step, support = np.unique(2 * block.code, return_counts=True)
        yield step, support


def extended(blocks: Iterable[Block], candidates: list[tuple[int, ...]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the candidate, step, support) of all steps that distinct candidates can grow by in each block. Codes are below width / 2."""
    tree = ragged.tree_of(candidates, width)
    owners, (node, step) = tree.owners(), np.divmod(tree.key, width)
    children = np.searchsorted(node, np.arange(len(owners) + 1)).tolist()
    for block in blocks:
        stack: list[tuple[int, Places | None]] = [(k, None) for k in range(*children[:2])]
        while stack:
            k, before = stack.pop()
            if before is None:
                rows = block.rows(int(step[k]) >> 1)
                found = Places(block, block.record[rows], block.words[:, rows])
            else:
                found = before.grown(int(step[k]))
            if not len(found.record):
                continue
            at = int(tree.child[k])
            if owners[at] >= 0:
                steps, support = found.steps(int(step[k]) >> 1, width)
                yield np.full(len(steps), owners[at]), steps, support
            stack.extend((c, found) for c in range(children[at], children[at + 1]))
