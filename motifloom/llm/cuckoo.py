"""Exact deduplication over a cuckoo-filter index of live digests.

Digests of normalised texts are dealt out to shards by their own bits. Each shard keeps a cuckoo filter (four
fingerprints of 16 bits a bucket, partial-key alternate buckets) whose slots point at the stored keys: a filter miss
proves that a digest is new, a hit is verified against the full SHA-256 digests stored for that bucket (the content's
digest stands for the content). A failed insertion (too many displacements) doubles the table and rebuilds it from the
stored keys. Digests can be deleted.

A text that holds a third of all rows is no hot spot: every task first runs its rows through an index of its own and
passes on one row for each digest, so a shard sees a digest at most once from each task. A shard reads its digests in
order and hands its index on whenever it holds ``shard_limit`` digests, so its memory does not grow with the input.
Each text is read and digested once; texts are never shuffled.

Null texts count as empty, and empty texts equal each other. Among equal texts the largest doc_id stays; a null doc_id
is smaller than any other. Rows that repeat a doc_id and text are the same document: ``duplicate_groups`` marks all of
them alike, ``deduplicated`` returns one of them. Texts of any length are digested as wholes inside the JVM. An empty
table gives an empty table. Columns of docs may have any names: a column of ``keep`` that is named like a result comes
back with `_in` appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, bounded, kept_names, materialize, packed, unpacked

SLOTS = 4


class CuckooIndex:
    """A cuckoo filter over 256-bit digests with the stored keys, a count and the largest id of each."""

    def __init__(self, buckets: int = 256, max_rounds: int = 64):
        self.max_rounds, self.resizes = max_rounds, 0
        self.keys = np.zeros((1024, 4), np.uint64)
        self.counts = np.zeros(1024, np.int64)
        self.ids, self.named = np.zeros(1024, np.int64), np.zeros(1024, bool)  # without a name there is no id yet
        self.used, self.free = 0, np.zeros(0, np.int64)
        self._clear(buckets)

    def __len__(self) -> int:
        return self.used - len(self.free)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = np.zeros((buckets, SLOTS), np.uint16)
        self.entries = np.full((buckets, SLOTS), -1, np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and first bucket. The bytes that order digests come first, so neither is made of those."""
        prints = np.maximum(keys[:, 1] >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        return prints, (keys[:, 2] & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        step = (prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        return bucket ^ (step & np.uint64(self.buckets - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for those that are not in the index. Filter hits are verified on the full keys."""
        prints, first = self._places(keys)
        out = np.full(len(keys), -1, np.int64)
        for bucket in (first, self._other(prints, first)):
            for slot in range(SLOTS):
                at = np.flatnonzero(self.prints[bucket, slot] == prints)
                entry = self.entries[bucket[at], slot]
                same = (self.keys[entry] == keys[at]).all(axis=1)
                out[at[same]] = entry[same]
        return out

    def _store(self, keys: np.ndarray) -> np.ndarray:
        """Puts keys among the stored ones and returns their entries."""
        reused, self.free = self.free[: len(keys)], self.free[len(keys) :]
        new = np.arange(self.used, self.used + len(keys) - len(reused))
        self.used += len(new)
        while self.used > len(self.keys):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.named = np.concatenate([self.named, np.zeros_like(self.named)])
        entries = np.concatenate([reused, new])
        self.keys[entries], self.counts[entries], self.named[entries] = keys, 0, False
        return entries

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Inserts distinct keys that are not in the index; returns their entries."""
        entries = self._store(keys)
        if len(self) > 0.9 * SLOTS * self.buckets or not self._place(entries):
            self._grow()
        return entries

    def _grow(self) -> None:
        """Doubles the table, as often as it takes, and places all stored keys anew."""
        live = np.setdiff1d(np.arange(self.used), self.free)
        while True:
            self.resizes += 1
            self._clear(self.buckets * 2)
            if len(live) <= 0.9 * SLOTS * self.buckets and self._place(live):
                return

    def _place(self, entries: np.ndarray) -> bool:
        """Gives each entry a slot, all at once in rounds; those that find none displace a fingerprint of their bucket."""
        prints, bucket = self._places(self.keys[entries])
        tried = np.zeros(len(entries), np.int64)
        for round_ in range(self.max_rounds):
            order = np.argsort(bucket, kind="stable")
            entries, prints, bucket, tried = entries[order], prints[order], bucket[order], tried[order]
            begins = np.concatenate([[True], bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, bool)
            rank = np.arange(len(bucket)) - np.maximum.accumulate(np.where(begins, np.arange(len(bucket)), 0))
            empty = self.prints[bucket] == 0
            fits = rank < empty.sum(axis=1)
            slot = np.argmax(np.cumsum(empty, axis=1) == (rank + 1)[:, None], axis=1)
            self.prints[bucket[fits], slot[fits]] = prints[fits]
            self.entries[bucket[fits], slot[fits]] = entries[fits]
            left = ~fits
            if not left.any():
                return True
            entries, prints, bucket, tried = entries[left], prints[left], bucket[left], tried[left] + 1
            turn = tried % 2 == 0
            # every second try the first entry of a bucket takes a slot and its occupant moves on instead
            firsts = np.flatnonzero(turn & np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            at = (round_ + entries[firsts]) % SLOTS
            out_print, out_entry = self.prints[bucket[firsts], at], self.entries[bucket[firsts], at]
            self.prints[bucket[firsts], at], self.entries[bucket[firsts], at] = prints[firsts], entries[firsts]
            prints[firsts], entries[firsts] = out_print, out_entry
            bucket = self._other(prints, bucket)
        return False

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Takes distinct keys out of the index; returns which were in it."""
        entry = self.find(keys)
        there = entry >= 0
        prints, first = self._places(keys[there])
        for bucket in (first, self._other(prints, first)):
            for slot in range(SLOTS):
                hit = self.entries[bucket, slot] == entry[there]
                self.prints[bucket[hit], slot] = 0
                self.entries[bucket[hit], slot] = -1
        self.free = np.concatenate([self.free, entry[there]])
        return there

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, named: np.ndarray | None = None) -> None:
        """Adds rows of any keys: counts are summed, the largest id stays; rows that are not named have none. Keys whose count falls to 0 or below are deleted."""
        named = np.ones(len(ids), bool) if named is None else named
        distinct, at = np.unique(keys, axis=0, return_inverse=True)
        at = at.reshape(-1)
        n = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
        entry = self.find(distinct)
        new = entry < 0
        entry[new] = self.insert(distinct[new])
        self.counts[entry] += n
        holder, ids = entry[at[named]], ids[named]
        first = holder[~self.named[holder]]
        self.ids[first], self.named[first] = np.iinfo(np.int64).min, True
        np.maximum.at(self.ids, holder, ids)
        if (gone := self.counts[entry] <= 0).any():
            self.delete(distinct[gone])

    def take(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Takes one key out: its key, id, count and whether it has an id, or none of each if it is not there."""
        entry = self.find(key)
        entry = entry[entry >= 0]
        held = self.keys[entry].copy(), self.ids[entry].copy(), self.counts[entry].copy(), self.named[entry].copy()
        self.delete(key)
        return held

    def rows(self) -> pa.RecordBatch:
        """What the index holds: digest, keep_id, group_size."""
        live = np.setdiff1d(np.arange(self.used), self.free)
        raw = np.ascontiguousarray(self.keys[live]).tobytes()
        digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(live), [None, pa.py_buffer(raw)]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([digest, pa.array(self.ids[live], mask=~self.named[live]), pa.array(self.counts[live])], names=["digest", "keep_id", "group_size"])


SCHEMA = "digest binary, keep_id long, group_size long"
#: Digests that an index holds at most before it is handed on (some 100 bytes each).
TASK_LIMIT, SHARD_LIMIT = 500_000, 1_000_000


def _indexed(limit: int, ordered: bool = False):
    """A mapInArrow function: rows of digest, keep_id, group_size through an index.

    Beyond limit it passes on what it holds and begins anew; of ordered rows all but the last digest, which may go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            if not batch.num_rows:
                continue
            digest = batch.column("digest").cast(pa.binary(32))
            keys = np.frombuffer(digest.buffers()[1], np.uint64).reshape(-1, 4)[digest.offset : digest.offset + len(digest)]
            ids = batch.column("keep_id")
            index.add(keys, ids.fill_null(0).to_numpy(zero_copy_only=False), batch.column("group_size").to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False))
            if len(index) > limit:
                held = index.take(keys[-1:]) if ordered else None
                yield index.rows()
                index = CuckooIndex()
                if held is not None and len(held[0]):
                    index.add(*held)
        yield index.rows()

    return run


def _merged(rows: DataFrame, shard_limit: int) -> DataFrame:
    """One row for each digest. Of a digest what adds comes before what takes away."""
    return rows.repartition("digest").sortWithinPartitions("digest", F.col("group_size").desc()).mapInArrow(_indexed(shard_limit, ordered=True), SCHEMA)


def text_digest(text: str):
    """SHA-256 of the text with A-Z lower-cased, null as empty."""
    return F.unhex(F.sha2(F.coalesce(ascii_lower(F.col(text)), F.lit("")), 256))


def _index(keyed: DataFrame, task_limit: int, shard_limit: int) -> DataFrame:
    """The index of rows of digest and id."""
    rows = keyed.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return _merged(rows.mapInArrow(_indexed(task_limit), SCHEMA), shard_limit)


def digest_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", task_limit: int = TASK_LIMIT, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """The live digests of docs: digest, keep_id (largest doc_id), group_size. One shuffle, of one short row for each digest and task."""
    return _index(docs.select(text_digest(text).alias("digest"), F.col(doc_id).cast("long").alias("id")), task_limit, shard_limit)


def update_index(index: DataFrame, inserted: DataFrame, deleted: DataFrame, live: DataFrame, text: str = "text", doc_id: str = "doc_id", task_limit: int = TASK_LIMIT, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """The index after inserting and deleting documents. Digests without live documents leave it.

    live are the documents that remain. They are read only for digests whose kept document was deleted, whose keep_id
    becomes the largest doc_id that remains.
    """
    added = digest_index(inserted, text, doc_id, task_limit, shard_limit)
    gone = materialize(digest_index(deleted, text, doc_id, task_limit, shard_limit))
    combined = index.select("digest", "keep_id", "group_size").unionByName(added).unionByName(gone.select("digest", F.lit(None).cast("long").alias("keep_id"), (-F.col("group_size")).alias("group_size")))
    merged = materialize(_merged(combined, shard_limit))
    lost = merged.join(gone.select("digest", F.col("keep_id").alias("gone_id")), "digest").where(F.col("keep_id").isNull() | (F.col("gone_id") >= F.col("keep_id"))).select("digest")
    lost = materialize(lost)
    rest = live.select(text_digest(text).alias("digest"), F.col(doc_id).cast("long").alias("id")).join(bounded(lost), "digest", "left_semi")
    found = rest.groupBy("digest").agg(F.max("id").alias("id"))
    settled = lost.join(found, "digest", "left").select(F.col("digest").alias("d"), F.lit(True).alias("lost"), "id")
    both = merged.join(settled, F.col("digest") == F.col("d"), "left")
    return both.select("digest", F.when(F.col("lost"), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size")


def _keyed(docs: DataFrame, text: str, doc_id: str, **columns) -> DataFrame:
    """digest, id and further columns of docs, written: texts are read and digested once."""
    return materialize(docs.select(text_digest(text).alias("digest"), F.col(doc_id).cast("long").alias("id"), *(c.alias(n) for n, c in columns.items())))


def duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, the columns of keep, keep_id, group_size, kept, text_sha256."""
    names = kept_names([c for c in keep if c != doc_id], (doc_id, "keep_id", "group_size", "kept", "text_sha256"))
    keyed = _keyed(docs, text, doc_id, doc=F.col(doc_id), own=F.struct(*(F.col(c).alias(n) for c, n in names.items())) if names else F.lit(0))
    index = _index(keyed, TASK_LIMIT, SHARD_LIMIT)
    joined = keyed.join(index, "digest")
    return joined.select(
        F.col("doc").alias(doc_id), *(F.col("own").getField(n).alias(n) for n in names.values()), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat a doc_id and text one stays.

    Which rows go is found from digests alone. The ids that go are broadcast where they are few (``bounded``); beyond
    that the texts meet them in a join. Only ids that occur in several rows are looked at by text.
    """
    keyed = _keyed(docs, text, doc_id)
    index = _index(keyed, TASK_LIMIT, SHARD_LIMIT)
    marked = keyed.join(index, "digest").groupBy("id").agg(
        F.count("*").alias("rows"), F.max(F.col("id").eqNullSafe(F.col("keep_id"))).alias("some"), F.min(F.col("id").eqNullSafe(F.col("keep_id"))).alias("all"),
    )
    # an id is plain if it has one row: that stays or goes with its id
    odd = materialize(marked.where(~F.col("all") | (F.col("rows") > 1)).select("id", (F.col("some") & (F.col("rows") > 1)).alias("mixed")))
    rows = packed(docs, own_id=F.col(doc_id).cast("long"), own_text=F.col(text))
    flagged = rows.join(bounded(odd), F.col("own_id").eqNullSafe(F.col("id")), "left").select("row", "own_id", "own_text", "mixed")
    plain = flagged.where(F.col("mixed").isNull()).select("row")
    if odd.where("mixed").isEmpty():
        return unpacked(plain)
    mixed = flagged.where(F.col("mixed")).select("row", "own_id", text_digest("own_text").alias("own_digest"))
    wanted = index.join(odd.where("mixed"), F.col("keep_id").eqNullSafe(F.col("id")), "left_semi").select("digest", "keep_id")
    first = mixed.join(wanted, (F.col("own_digest") == F.col("digest")) & F.col("own_id").eqNullSafe(F.col("keep_id")), "left_semi").dropDuplicates(["own_id", "own_digest"]).select("row")
    return unpacked(plain.unionByName(first))
