"""Exact repeat search over batches of documents and shards of hashes.

Documents are dealt by their key and text into batches of a bounded size: rows without an id, or
with the same one, are told apart by their texts.  A batch sends what it wants
compared, once for each distinct hash, as one packed row to each shard of the hash space; a shard
answers each batch with the hashes that matter to it.  A passage that a third of all documents
share thus costs one entry a batch and not one a document, and no task holds more than a shard
or a batch.  The texts are shuffled once: every round reads the same exchange again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, text_bytes

SENT = "shard int, batch long, data binary"
NOTES = "batch long, level int, data binary"
#: The level of the notes that name copies.
COPIES = 0


class Rounds:
    """The texts in batches, and the notes each batch has had so far."""

    def __init__(self, texts: DataFrame, batch_bytes: int, shard_bytes: int):
        total = text_bytes(texts)
        self.batches, self.shards = parts(total, batch_bytes), parts(total, shard_bytes)
        batch = F.pmod(F.xxhash64("key", "text"), F.lit(self.batches)).alias("batch")
        digest = F.md5(F.col("text").cast("binary"))
        heads = texts.groupBy(digest.alias("digest")).agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        copies = texts.select("key", batch, digest.alias("digest")).join(heads, "digest").where("key > first")
        self.texts = texts.select("key", "text", batch)
        named = F.concat(F.unhex(F.lpad(F.hex("key"), 16, "0")), F.unhex("digest"))
        self.notes = copies.select("batch", F.lit(COPIES).alias("level"), named.alias("data"))

    def answer(self, function: Callable, schema: str) -> DataFrame:
        """function(Batch) -> Arrow table, once for each batch."""

        def run(texts: pa.Table, notes: pa.Table) -> pa.Table:
            return function(Batch(texts, notes))

        return self.texts.groupBy("batch").cogroup(self.notes.groupBy("batch")).applyInArrow(run, schema)

    def ask(self, send: Callable, reply: Callable, level: int) -> None:
        """send(Batch) gives (shard, bytes) pairs; reply([(batch, bytes)]) gives pairs for batches."""

        def sent(batch: Batch) -> pa.Table:
            out = [(shard, data) for shard, data in send(batch) if len(data)]
            shards, data = zip(*out, strict=True) if out else ((), ())
            return pa.table({"shard": pa.array(shards, pa.int32()), "batch": pa.array([batch.number] * len(out), pa.int64()), "data": pa.array(data, pa.binary())})

        def replied(rows: pa.Table) -> pa.Table:
            out = reply(sorted(zip(rows["batch"].to_pylist(), rows["data"].to_pylist(), strict=True)))
            batches, data = zip(*out, strict=True) if out else ((), ())
            return pa.table({"batch": pa.array(batches, pa.int64()), "level": pa.array([level] * len(out), pa.int32()), "data": pa.array(data, pa.binary())})

        self.notes = self.notes.unionByName(self.answer(sent, SENT).groupBy("shard").applyInArrow(replied, NOTES))


class Batch:
    """The documents of one batch, ordered by key and text, and the notes on them."""

    def __init__(self, texts: pa.Table, notes: pa.Table):
        rows = sorted(zip(texts["key"].to_pylist(), texts["text"].to_pylist(), strict=True))
        self.keys, self.texts = ([r[0] for r in rows], [r[1] for r in rows])
        self.number = texts["batch"][0].as_py() if len(texts) else -1
        self._notes: dict[int, list[bytes]] = {}
        for level, data in zip(notes["level"].to_pylist(), notes["data"].to_pylist(), strict=True):
            self._notes.setdefault(level, []).append(data)
        named = set(self._notes.get(COPIES, []))
        heads = {n[:8] for n in named}
        #: Whether each document is a copy of one with a smaller key.
        self.copied = [(k8 := k.to_bytes(8, "big", signed=True)) in heads and k8 + hashlib.md5(t.encode()).digest() in named for k, t in rows]

    def notes(self, level: int) -> list[bytes]:
        return self._notes.get(level, [])

    def hashes(self, level: int) -> np.ndarray:
        return np.sort(np.frombuffer(b"".join(self.notes(level)), np.uint64))


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the values are in the ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit hashes; the lowest bit is left 0 for a mark."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) & ~np.uint64(1)


def send_hashes(values: np.ndarray, shards: int):
    """Each distinct hash once, marked in its lowest bit if the batch has it twice."""
    h, n = np.unique(values, return_counts=True)
    return deal(h, shards, h | (n > 1).astype(np.uint64))


def deal(hashes: np.ndarray, shards: int, *columns: np.ndarray):
    """(shard, packed columns) pairs of the shards met; hashes rise within a shard as they do in the input."""
    shard = ((hashes >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        at = order[a:b]
        yield int(shard[at[0]]), b"".join(c[at].tobytes() for c in columns)


def reply_repeated(rows: list[tuple[int, bytes]]):
    """To each batch those of its hashes that occur twice or more anywhere."""
    marked = np.concatenate([np.frombuffer(d, np.uint64) for _, d in rows])
    batch = np.repeat([b for b, _ in rows], [len(d) // 8 for _, d in rows])
    h = marked & ~np.uint64(1)
    order = np.argsort(h, kind="stable")
    edge = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    size = np.diff(np.r_[edge, len(h)])
    twice = (size > 1) | np.logical_or.reduceat((marked[order] & np.uint64(1)) > 0, edge)
    keep = order[np.repeat(twice, size)]
    keep = keep[np.argsort(batch[keep], kind="stable")]
    return split_by_batch(batch[keep], h[keep])


def split_by_batch(batch: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """Packed columns for each batch; batch numbers rise."""
    if not len(batch):
        return []
    edge = np.r_[np.flatnonzero(np.r_[True, batch[1:] != batch[:-1]]), len(batch)]
    return [(int(batch[a]), b"".join(c[a:b].tobytes() for c in columns)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def sliding_least(values: np.ndarray, width: int, places: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Least value and, if asked for, its leftmost place of each window of `width`; windows past the end are cut."""
    least, place = values.copy(), np.arange(len(values)) if places else None
    have = 1
    while have < width:
        step = min(have, width - have)
        if step >= len(values):
            break
        a, b = least[:-step], least[step:]
        if places:
            right = b < a
            place = np.r_[np.where(right, place[step:], place[:-step]), place[len(values) - step :]]
        least = np.r_[np.minimum(a, b), least[len(values) - step :]]
        have += step
    return least, place


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of `total` places lie in a window of `length` from one of the starts."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, total), -1)
    return edge.cumsum()[:-1] > 0
