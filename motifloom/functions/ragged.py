"""Pattern growth over ragged arrays: what a task does with a bounded block of records.

A block holds the items of its records one after another, as codes; a record is a run of sets, a set a run of ascending
codes (a sequence of single items has sets of one). A step of a pattern is a number: twice the code, plus 1 if the item
joins the pattern's last set instead of opening a new one. Itemsets are sequences of single items in ascending order, so
one kind of growth serves all three.

A projection is a place: that of a pattern's last item in a record. Patterns are grown many at once, all their places in
the same arrays. The growth of one pattern has at most two rows for each item of the block, and patterns are taken
together only up to a number of rows, so memory is bounded by the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Rows of growth that are held at once, beyond those of one pattern.
HELD = 1 << 20


@dataclass(frozen=True)
class Block:
    """Of each place: its code, its record, and the place after the end of its set and of its record."""

    code: np.ndarray
    record: np.ndarray
    set_end: np.ndarray
    record_end: np.ndarray
    #: All sets have one item: then the first place of a record decides, and no item joins a set.
    single: bool

    @cached_property
    def width(self) -> int:
        return 2 * (int(self.code.max(initial=-1)) + 1)


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.repeat(np.cumsum(lengths), lengths)


def block_of(lists: pa.Array) -> Block:
    """From a list (single items) or a list of lists (sets, ascending) of codes for each record; null lists are empty."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    inner, single = lists.flatten(), not pa.types.is_list(lists.type.value_type)
    sets = np.ones(len(inner), np.int64) if single else inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    code = (inner if single else inner.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, ends = np.append(0, np.cumsum(sets)), np.cumsum(lengths)
    items = upto[ends] - upto[ends - lengths]
    return Block(code, np.repeat(np.arange(len(items)), items), _ends(sets), _ends(items), single)


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where any column differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


@dataclass(frozen=True)
class Grown:
    """One step longer: rows by (pattern, step, place). key is pattern * width + step of each distinct one, begin its first row."""

    key: np.ndarray
    begin: np.ndarray
    support: np.ndarray
    place: np.ndarray
    length: np.ndarray

    def places(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New numbers 0, 1, ... of the chosen keys, and their places."""
        n = self.length[chosen]
        return np.repeat(np.arange(len(chosen)), n), self.place[runs(self.begin[chosen], n)]


def _sorted(block: Block, node: np.ndarray, step: np.ndarray, place: np.ndarray) -> Grown:
    key = node * block.width + step
    order = np.argsort(key, kind="stable")  # places already rise within a key
    key, place = key[order], place[order]
    new = _changes(key, block.record[place])
    if block.single:
        key, place = key[new], place[new]
        new = np.ones(len(key), bool)
    begin = np.flatnonzero(_changes(key))
    length = np.diff(np.append(begin, len(key)))
    support = np.add.reduceat(new.astype(np.int64), begin) if len(begin) else begin
    return Grown(key[begin], begin, support, place, length)


def begun(block: Block) -> Grown:
    """All patterns of one item."""
    n = len(block.code)
    return _sorted(block, np.zeros(n, np.int64), 2 * block.code, np.arange(n))


def grown(block: Block, node: np.ndarray, place: np.ndarray) -> Grown:
    """All patterns that are one step longer than those of node. Rows come by (node, place)."""
    first = _changes(node, block.record[place])
    start = block.set_end[place[first]]
    length = block.record_end[place[first]] - start
    at, who = runs(start, length), np.repeat(node[first], length)
    step = 2 * block.code[at]
    if not block.single:
        length = block.set_end[place] - place - 1
        beside = runs(place + 1, length)
        at, who, step = np.concatenate([at, beside]), np.concatenate([who, np.repeat(node, length)]), np.concatenate([step, 2 * block.code[beside] + 1])
    return _sorted(block, who, step, at)


def _cost(block: Block, node: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Rows of growth of each of n patterns, at most."""
    return np.bincount(node, block.record_end[place] - place, n)


def _batches(cost: np.ndarray, held: int) -> Iterator[tuple[int, int]]:
    """Runs of patterns whose costs add up to about held; a single one may cost more."""
    begin, total = 0, 0.0
    for i, c in enumerate(cost.tolist()):
        if i > begin and total + c > held:
            yield begin, i
            begin, total = i, 0.0
        total += c
    if begin < len(cost):
        yield begin, len(cost)


def mined(block: Block, need: float, most: int | None = None, places: np.ndarray | None = None, held: int = HELD) -> Iterator[tuple[tuple[int, ...], int]]:
    """(steps, support) of all patterns of the block whose support reaches need, of at most `most` steps; depth first.

    With places, those that go on from one pattern with these places.
    """
    if most is not None and most < 1:
        return
    first = begun(block) if places is None else grown(block, np.zeros(len(places), np.int64), places)
    stack: list[tuple[list[tuple[int, ...]], Grown]] = [([()], first)]
    while stack:
        paths, found = stack.pop()
        chosen = np.flatnonzero(found.support >= need)
        node, step = np.divmod(found.key[chosen], max(block.width, 1))
        longer = [(*paths[a], b) for a, b in zip(node.tolist(), step.tolist(), strict=True)]
        yield from zip(longer, found.support[chosen].tolist(), strict=True)
        if not longer or most is not None and len(longer[0]) >= most:
            continue
        own, at = found.places(chosen)
        for begin, end in _batches(_cost(block, own, at, len(chosen)), held):
            part = slice(*np.searchsorted(own, [begin, end]))
            stack.append((longer[begin:end], grown(block, own[part] - begin, at[part])))


@dataclass(frozen=True)
class Tree:
    """Candidates as a tree of prefixes: children of a node are the keys node * width + step, ascending; owner is the place of the candidate that ends at the child, -1 if none does."""

    key: np.ndarray
    child: np.ndarray
    owner: np.ndarray
    width: int

    def owners(self) -> np.ndarray:
        """By node, the root first."""
        out = np.full(len(self.key) + 1, -1, np.int64)
        out[self.child] = self.owner
        return out


def tree_of(candidates: list[tuple[int, ...]], width: int) -> Tree:
    """The tree of candidates and all their prefixes. Node 0 is the root; steps of width or more occur in no record of the block."""
    nodes: dict[tuple[int, int], int] = {}
    owner: list[int] = [-1]
    for k, steps in enumerate(candidates):
        at = 0
        for step in steps:
            if step >= width:
                break
            at = nodes.setdefault((at, step), len(owner))
            if at == len(owner):
                owner.append(-1)
        else:
            if at:
                owner[at] = k
    key = np.fromiter((a * width + b for a, b in nodes), np.int64, len(nodes))
    order = np.argsort(key)
    child = np.fromiter(nodes.values(), np.int64, len(nodes))[order]
    return Tree(key[order], child, np.array(owner, np.int64)[child], width)


def counted(block: Block, candidates: list[tuple[int, ...]], held: int = HELD) -> np.ndarray:
    """The support of each of distinct candidates in the block: records walk down the tree of all of them once."""
    support = np.zeros(len(candidates), np.int64)
    tree = tree_of(candidates, block.width)
    if not len(tree.key):
        return support
    inner = np.unique(tree.key // tree.width)  # nodes with children
    stack = [(np.zeros(1, np.int64), begun(block))]
    while stack:
        ids, found = stack.pop()
        node, step = np.divmod(found.key, tree.width)
        key = ids[node] * tree.width + step
        at = np.minimum(np.searchsorted(tree.key, key), len(tree.key) - 1)
        hit = np.flatnonzero(tree.key[at] == key)
        at = at[hit]
        owned = tree.owner[at] >= 0
        support[tree.owner[at[owned]]] += found.support[hit[owned]]
        on = np.isin(tree.child[at], inner)
        chosen, ids = hit[on], tree.child[at[on]]
        own, place = found.places(chosen)
        for begin, end in _batches(_cost(block, own, place, len(chosen)), held):
            part = slice(*np.searchsorted(own, [begin, end]))
            stack.append((ids[begin:end], grown(block, own[part] - begin, place[part])))
    return support


def extended(block: Block, candidates: list[tuple[int, ...]], held: int = HELD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the candidate, step, support) of all steps that distinct candidates can grow by in the block."""
    tree = tree_of(candidates, block.width)
    if not len(tree.key):
        return
    owners, inner = tree.owners(), np.unique(tree.key // tree.width)
    stack = [(np.zeros(1, np.int64), begun(block))]
    while stack:
        ids, found = stack.pop()
        node, step = np.divmod(found.key, tree.width)
        owned = owners[ids[node]] >= 0
        if owned.any():
            yield owners[ids[node[owned]]], step[owned], found.support[owned]
        on = np.isin(ids[node], inner)
        key = ids[node] * tree.width + step
        at = np.minimum(np.searchsorted(tree.key, key), len(tree.key) - 1)
        chosen = np.flatnonzero(on & (tree.key[at] == key))
        ids = tree.child[at[chosen]]
        own, place = found.places(chosen)
        for begin, end in _batches(_cost(block, own, place, len(chosen)), held):
            part = slice(*np.searchsorted(own, [begin, end]))
            stack.append((ids[begin:end], grown(block, own[part] - begin, place[part])))
