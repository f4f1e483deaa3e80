"""Substring dedup by level-wise doubling of repeated windows.

A window of `length` words can only repeat if the windows inside it do.  The lengths double from a
short seed up to `length` (5, 10, 20).  At the seed length each full window is represented by its
least seed, chosen by hash, which equal windows choose alike.  Only windows whose seed repeats
anywhere are extended to twice the length, and so on until none survive or `length` is reached;
there the first place of every repeated window is found.  Longer levels could not change what is
removed.  Seeds are judged by 64-bit hashes (a clash only lets a candidate live), the last level by
128 bits.  Exact copies of a text are settled before: all their windows start earlier.

Nulls: a null text has no words, a null doc_id sorts after all others and comes out as null.  Rows
that repeat a doc_id (or have none) stand at the same place in the order, whatever their texts: a
window goes if it starts at a smaller (doc_id, place), so the first one always stays.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .batches import Batch, Rounds, among, covered, deal, mixed, reply_repeated, send_hashes, sliding_least, split_by_batch
from .common import doc_id_of, keyed_texts

LENGTH = 20
RESULT = "key long, n_words long, n_removed long, kept_sha256 string, n_spans long"


def levels(length: int) -> list[int]:
    out = [length]
    while out[0] % 2 == 0 and out[0] > 6:
        out.insert(0, out[0] // 2)
    return out


class Words:
    """The words of a batch in one row, and hashes of windows that do not cross documents."""

    def __init__(self, batch: Batch, length: int):
        self.batch, self.length, self.levels = batch, length, levels(length)
        self.words = [t.encode().split() for t in batch.texts]
        size = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = size.cumsum()
        self.starts = self.ends - size
        self.total = int(self.ends[-1]) if len(size) else 0
        # Copies are settled; their words do not take part.
        live = [not c for c in batch.copied]
        flat = [w for words in self.words for w in words]
        self.h = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, len(flat))
        self.doc = np.repeat(np.arange(len(size)), size)
        self.room = np.where(np.repeat(live, size), np.repeat(self.ends, size) - np.arange(self.total), 0) if self.total else np.zeros(0, np.int64)

    def windows(self, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        """Hash of the window of `size` words from each place (of no use where room is short)."""
        mask, out, have = (1 << 64) - 1, self.h, 1
        parts = [(1, self.h)]
        while have * 2 <= size:
            out = self._join(out, out, have, pow(base, have, mask + 1))
            have *= 2
            parts.append((have, out))
        for more, part in reversed(parts[:-1]):
            if have + more <= size:
                out = self._join(out, part, have, pow(base, more, mask + 1))
                have += more
        return mixed(out)

    @staticmethod
    def _join(left, right, at, factor):
        shifted = np.zeros_like(right)
        if at < len(right):
            shifted[:-at] = right[at:]
        return left * np.uint64(factor) + shifted

    def candidates(self, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows alive before level `upto`, and where each one's level window starts."""
        seed = self.levels[0]
        full = np.flatnonzero(self.room >= self.length)
        if not len(full):
            return full, full
        if seed == self.length:
            return full, full
        g = np.where(self.room >= seed, self.windows(seed), np.uint64(2**64 - 2))
        least, place = sliding_least(g, self.length - seed + 1)
        value, anchor = least[full], place[full]
        if upto == 0:
            return full, anchor
        alive = among(value, self.batch.hashes(1))
        full, anchor = full[alive], anchor[alive]
        for level, size in enumerate(self.levels[1:-1], 1):
            at = np.where(anchor + size <= full + self.length, anchor, anchor + seed - size)
            if level == upto:
                return full, at
            alive = among(self.windows(size)[at], self.batch.hashes(level + 1))
            full, anchor = full[alive], anchor[alive]
        return full, full

    def last(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows that reached the last level: start, two hashes, key, place in the document."""
        at, _ = self.candidates(len(self.levels) - 1)
        keys = np.array(self.batch.keys, np.int64)[self.doc[at]] if len(at) else np.zeros(0, np.int64)
        return at, self.windows(self.length)[at], self.windows(self.length, 0xC2B2AE3D27D4EB4F)[at], keys, at - self.starts[self.doc[at]]


def firsts(h1, h2, key, place):
    """Order by (hash, key, place), and where each hash's run starts in it."""
    order = np.lexsort((place, key, h2, h1))
    a, b = h1[order], h2[order]
    return order, np.flatnonzero(np.r_[len(a) > 0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])


def _reply_first(rows):
    """To each batch, for its windows that others have too: the earliest key and place anywhere."""
    fields = [np.frombuffer(d, np.int64).reshape(4, -1) for _, d in rows]
    h1, h2, key, place = np.concatenate(fields, axis=1)
    batch = np.repeat([b for b, _ in rows], [f.shape[1] for f in fields])
    order, edge = firsts(h1, h2, key, place)
    size = np.diff(np.r_[edge, len(order)])
    first = np.repeat(order[edge], size)
    shared = np.repeat(size > 1, size) & (order != first)
    order, first = order[shared], first[shared]
    by = np.argsort(batch[order], kind="stable")
    order, first = order[by], first[by]
    return split_by_batch(batch[order], h1[order], h2[order], key[first], place[first])


def dedupe(docs: DataFrame, length: int = LENGTH, batch_bytes: int = 6 << 20, shard_bytes: int = 16 << 20) -> DataFrame:
    """Per document the words left when every word of a window that starts earlier is removed."""
    steps = levels(length)
    rounds = Rounds(keyed_texts(docs), batch_bytes, shard_bytes)
    shards = rounds.shards

    for level, size in enumerate(steps[:-1]):

        def send(batch, level=level, size=size):
            words = Words(batch, length)
            _, at = words.candidates(level)
            return send_hashes(words.windows(size)[np.unique(at)], shards)

        rounds.ask(send, reply_repeated, level + 1)

    last = len(steps)

    def send_last(batch):
        at, h1, h2, key, place = Words(batch, length).last()
        order, edge = firsts(h1, h2, key, place)
        own = order[edge]
        return deal(h1[own], shards, h1[own].view(np.int64), h2[own].view(np.int64), key[own], place[own])

    rounds.ask(send_last, _reply_first, last)

    def finish(batch: Batch) -> pa.Table:
        words = Words(batch, length)
        at, h1, h2, key, place = words.last()
        told = [np.frombuffer(d, np.int64).reshape(4, -1) for d in batch.notes(last)]
        t1, t2, tk, tp = np.concatenate(told, axis=1) if told else np.zeros((4, 0), np.int64)
        every = [np.concatenate(x) for x in ((h1, t1.view(np.uint64)), (h2, t2.view(np.uint64)), (key, tk), (place, tp))]
        order, edge = firsts(*every)
        first = np.repeat(order[edge], np.diff(np.r_[edge, len(order)]))
        later = order[((every[2][first] != every[2][order]) | (every[3][first] != every[3][order])) & (order < len(at))]
        gone = covered(at[later], length, words.total)
        out = []
        for k, copied, own, a, b in zip(batch.keys, batch.copied, words.words, words.starts.tolist(), words.ends.tolist(), strict=True):
            cut = np.full(b - a, b - a >= length) if copied else gone[a:b]
            n = int(cut.sum())
            kept = own if not n else [w for w, c in zip(own, cut.tolist(), strict=True) if not c]
            spans = int((np.diff(np.r_[0, cut.astype(np.int8)]) == 1).sum())
            out.append((k, b - a, n, hashlib.sha256(b" ".join(kept)).hexdigest(), spans))
        columns = zip(*out, strict=True) if out else ((),) * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "n_words", "n_removed", "kept_sha256", "n_spans"])

    done = rounds.answer(finish, RESULT)
    return done.select(doc_id_of(done["key"]).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "n_spans")
