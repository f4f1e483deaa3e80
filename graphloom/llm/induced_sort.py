"""Suffix order and common prefixes of a shard's strings by induced sorting with disk-backed queues.

The order of the leftmost S-type (LMS) suffixes is found on the reduced string of their names; from
them all L-type suffixes are induced by a rising pass over a priority queue keyed by first byte, and
all S-type suffixes by a falling pass.  A queue entry is (place, common prefix with the entry pushed
before it under that byte); the common prefix of two induced suffixes is one more than the least
common prefix between their sources.  Entries of one byte are taken and pushed as blocks of numpy
arrays, and beyond `memory` bytes the queue writes its blocks to an unnamed temporary file, which
the system deletes with the task.  Common prefixes are exact up to `depth`, the order too.
"""

from __future__ import annotations

import tempfile

import numpy as np

ENTRY = np.dtype([("at", "<i4"), ("lcp", "<i2")])
FAR = 32000


class ByteQueue:
    """A monotone priority queue of suffix entries, keyed by byte."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file = memory, 0, None
        self.blocks: list[list] = [[] for _ in range(256)]

    def push(self, byte: int, at: np.ndarray, lcp: np.ndarray) -> None:
        block = np.empty(len(at), ENTRY)
        block["at"], block["lcp"] = at, lcp
        self.blocks[byte].append(block)
        self.held += block.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for blocks in self.blocks:
            for i, b in enumerate(blocks):
                if isinstance(b, np.ndarray):
                    blocks[i] = (self.file.tell(), len(b))
                    self.file.write(b.tobytes())
        self.held = 0

    def take(self, byte: int) -> np.ndarray | None:
        """What waits under this byte in the order of pushing, a memory's worth at most."""
        waiting, out, size = self.blocks[byte], [], 0
        while waiting and size <= self.memory:
            block = waiting.pop(0)
            if isinstance(block, tuple):
                self.file.seek(block[0])
                block = np.frombuffer(self.file.read(block[1] * ENTRY.itemsize), ENTRY)
            else:
                self.held -= block.nbytes
            out.append(block)
            size += block.nbytes
        return np.concatenate(out) if out else None

    def close(self) -> None:
        if self.file:
            self.file.close()


class _Pass:
    """One pass: pushes the suffixes before the scanned ones, with their common prefixes."""

    def __init__(self, queue: ByteQueue, depth: int):
        self.queue, self.depth = queue, depth
        self.since = np.full(256, -1, np.int64)  # least prefix since the last push under each byte; -1: none yet

    def scanned(self, at: np.ndarray, lcp: np.ndarray, before: np.ndarray, wanted: np.ndarray) -> None:
        """at: scanned suffixes with prefixes to the one scanned before; before: the byte before each."""
        if not len(at):
            return
        lcp = lcp.astype(np.int64)
        least = int(lcp.min())
        present = np.flatnonzero(np.bincount(before[wanted], minlength=256)) if wanted.any() else ()
        new = np.where(self.since >= 0, np.minimum(self.since, least), -1)
        for byte in present:
            i = np.flatnonzero(wanted & (before == byte))
            out = np.empty(len(i), np.int64)
            head = int(lcp[: i[0] + 1].min())
            out[0] = 0 if self.since[byte] < 0 else min(self.depth, 1 + min(int(self.since[byte]), head))
            if len(i) > 1:
                out[1:] = np.minimum(self.depth, 1 + np.minimum.reduceat(lcp[: i[-1] + 1], i[:-1] + 1))
            tail = lcp[i[-1] + 1 :]
            new[byte] = int(tail.min()) if len(tail) else FAR
            self.queue.push(int(byte), at[i] - 1, out)
        self.since = new


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it (S-type); the last byte is the least."""
    n = len(text)
    edge = np.r_[np.flatnonzero(text[1:] != text[:-1]), n - 1]  # the last place of each run
    up = np.r_[text[edge[:-1]] < text[edge[:-1] + 1], True]
    return np.repeat(up, np.diff(np.r_[-1, edge]))


def _words(text: np.ndarray, types: np.ndarray, start: np.ndarray, size: np.ndarray, skip: int) -> np.ndarray:
    """Seven (byte, type) symbols of each LMS substring from `skip` on, as one number; 0 beyond its end."""
    out = np.zeros(len(start), np.int64)
    for j in range(skip, skip + 7):
        at = np.minimum(start + j, len(text) - 1)
        out = out << 9 | np.where(j < size, text[at].astype(np.int64) * 2 + types[at], 0)
    return out


def _ranked(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks by the first key, then the second."""
    if len(keys) == 1:
        return np.unique(keys[0], return_inverse=True)[1]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = new.cumsum()
    return out


def _lms_order(text: np.ndarray, types: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """The LMS places in suffix order: names of LMS substrings, then ranks of the reduced string.

    The recursion is unrolled: each level joins the names of twice as many LMS substrings, until all
    differ or `depth` bytes are told apart (an LMS substring adds two bytes at least).
    """
    if len(lms) < 2:
        return lms
    size = np.r_[lms[1:] - lms[:-1] + 1, 1]
    name, skip = _ranked(_words(text, types, lms, size, 0)), 7
    while skip < min(int(size.max()), depth + 1):
        name = _ranked(name, _words(text, types, lms, size, skip))
        skip += 7
    span = 1
    while 2 * span <= depth + 2 and int(name.max()) + 1 < len(name):
        after = np.full(len(name), -1, np.int64)
        after[:-span] = name[span:]
        name = _ranked(name * (len(name) + 1) + after + 1)
        span *= 2
    return lms[np.argsort(name, kind="stable")]


def _prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, up to depth."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for j in range(depth):
        x, y = a[live] + j, b[live] + j
        ok = (x < len(text)) & (y < len(text))
        live, x, y = live[ok], x[ok], y[ok]
        live = live[text[x] == text[y]]
        if not len(live):
            break
        out[live] += 1
    return out


def _run_left(text: np.ndarray, at: int, depth: int) -> int:
    piece = text[at : at + depth]
    other = np.flatnonzero(piece != piece[0])
    return int(other[0]) if len(other) else len(piece)


def suffix_order(text: np.ndarray, depth: int, memory: int = 64 << 20):
    """Blocks (places, common prefixes with the suffix before), in suffix order.

    text: uint8, zero only as the end mark of each string, none of them empty.
    """
    n = len(text)
    if n == 0:
        return
    types = _types(text)
    lms = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    star = _lms_order(text, types, lms.astype(np.int64), depth)
    star_lcp = np.r_[0, _prefixes(text, star[1:], star[:-1], depth)].astype(np.int64) if len(star) else np.zeros(0, np.int64)
    star_edge = np.searchsorted(text[star], np.arange(257)) if len(star) else np.zeros(257, np.int64)
    larger, smaller = ByteQueue(memory), ByteQueue(memory)

    def preceding(at):
        return np.where(at > 0, text[np.maximum(at - 1, 0)], 0), at > 0

    # Rising: L-type suffixes from the LMS ones.  What is scanned is kept for the falling pass.
    rising, kept = _Pass(larger, depth), ByteQueue(memory)
    if not len(star):  # all bytes equal the end mark
        star, star_lcp, star_edge = np.array([n - 1]), np.zeros(1, np.int64), np.r_[0, np.ones(256, np.int64)]
    for byte in range(256):
        last = None
        while (block := larger.take(byte)) is not None:
            at, lcp = block["at"].astype(np.int64), block["lcp"]
            kept.push(byte, at, lcp)
            before, there = preceding(at)
            rising.scanned(at, lcp, before, there & (before >= byte))
            last = int(at[-1])
        own = slice(star_edge[byte], star_edge[byte + 1])
        at, lcp = star[own], star_lcp[own].copy()
        if len(at):
            lcp[0] = 0 if last is None else min(_run_left(text, last, depth), _run_left(text, int(at[0]), depth))
            before, there = preceding(at)
            rising.scanned(at, lcp, before, there & (before > byte))
    # Falling: S-type suffixes from the L-type ones.
    falling = _Pass(smaller, depth)
    found = ByteQueue(memory)
    counts = np.bincount(text, minlength=256)
    for byte in range(255, -1, -1):
        if not counts[byte]:
            continue
        last = None
        if byte == 0:  # the end mark of the whole text is the least suffix and has no source
            smaller.push(0, np.array([n - 1]), np.array([1 if smaller.blocks[0] else 0]))
        while (block := smaller.take(byte)) is not None:
            at, lcp = block["at"].astype(np.int64), block["lcp"]
            found.push(byte, at, lcp)
            before, there = preceding(at)
            falling.scanned(at, lcp, before, there & (before <= byte))
            last = int(at[-1])
        blocks = []
        while (block := kept.take(byte)) is not None:
            blocks.append(block)
        if blocks:
            # Falling order: the prefix to the entry scanned before is that of the next larger one.
            every = np.concatenate(blocks)[::-1]
            at = every["at"].astype(np.int64)
            lcp = np.r_[0, every["lcp"][:-1]].astype(np.int64)
            lcp[0] = 0 if last is None else min(_run_left(text, last, depth), _run_left(text, int(at[0]), depth))
            before, there = preceding(at)
            falling.scanned(at, lcp, before, there & (before < byte))
            larger.push(byte, every["at"][::-1], every["lcp"][::-1])
    for byte in range(256):
        last = None
        while (block := larger.take(byte)) is not None:
            yield block["at"].astype(np.int64), block["lcp"].astype(np.int64)
            last = int(block["at"][-1])
        blocks = []
        while (block := found.take(byte)) is not None:
            blocks.append(block)
        if blocks:
            every = np.concatenate(blocks)[::-1]
            at = every["at"].astype(np.int64)
            lcp = np.r_[0, every["lcp"][:-1]].astype(np.int64)
            lcp[0] = 0 if last is None else min(_run_left(text, last, depth), _run_left(text, int(at[0]), depth))
            yield at, lcp
    for q in (larger, smaller, kept, found):
        q.close()
