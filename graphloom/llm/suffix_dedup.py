"""Suffix-array dedup of bytes: external induced sorting of the strings that may repeat.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller
doc_id; strings are judged on the input.  Every string of that length is represented by the least
hash of its 24-byte grams, which equal strings share; consecutive strings with the same one form a
region of up to 76 bytes.  Two rounds follow over batches of documents and shards of hashes:

1. The batches name their hashes; the shards answer which of them several documents have.
2. The batches send the regions of those, once each, with the least doc_id; a shard sorts the
   suffixes of its distinct regions by external induction (`induced_sort`: disk-backed priority
   queues, common prefixes carried along) and answers each region's strings that start in a smaller
   doc_id.  Equal regions are settled without sorting: all but the first go.

Exact copies of a text are settled before both rounds.  No step holds more than a batch or a shard,
and the sort spills to disk beyond its memory.

Nulls: a null text is empty, a null doc_id sorts last and stays null.  Rows that repeat a doc_id, or
have none, may have different texts; none of them is earlier than another.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import Batch, Rounds, among, mixed, sliding_least, split_by_batch
from .common import doc_id_of, keyed_texts
from .induced_sort import suffix_order

LENGTH, GRAM = 50, 24
SLICE = 1 << 16
RESULT = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
ONE, TWO = 1, 2


class Regions:
    """The bytes of a batch's documents, copies left out, and the regions of like strings in them."""

    def __init__(self, batch: Batch, length: int):
        self.batch, self.length, self.most = batch, length, length - GRAM + 1
        raw = [b"" if c else t.encode() for c, t in zip(batch.copied, batch.texts, strict=True)]
        self.text = np.frombuffer(b"".join(raw), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.ends = size.cumsum()
        self.starts = self.ends - size
        found = [self._slice(a, min(a + SLICE, len(self.text))) for a in range(0, len(self.text), SLICE)]
        self.at, self.n, self.v, self.h = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.uint64, np.uint64)))
        self.doc = np.searchsorted(self.ends, self.at, "right")
        self.key = np.array(batch.keys, np.int64)[self.doc] if len(self.at) else np.zeros(0, np.int64)

    def _slice(self, a: int, b: int):
        """Regions of strings that start in [a, b): start, strings in it, least gram hash, region hash."""
        part = self.text[a : b + self.length]
        n = b - a
        g = _gram_hashes(part)
        least, _ = sliding_least(g, self.most, places=False)
        # Strings must end within their document.
        first = int(np.searchsorted(self.ends, a, "right"))
        last = int(np.searchsorted(self.ends, b, "left"))
        room = np.ones(n, bool)
        for end in self.ends[first : last + 1].tolist():
            room[max(0, end - self.length + 1 - a) : max(0, min(n, end - a))] = False
        room[max(0, len(self.text) - self.length + 1 - a) :] = False
        code = np.zeros(n, np.uint64)
        usable = min(n, len(least))
        code[:usable] = np.where(room[:usable], least[:usable] | np.uint64(1), 0)
        edge = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1]
        size = np.diff(np.r_[edge, n])
        edge, size = edge[code[edge] > 0], size[code[edge] > 0]
        if len(size) and size.max() > self.most:  # a run of one repeated gram is cut
            pieces = -(-size // self.most)
            k = np.arange(pieces.sum()) - np.repeat(pieces.cumsum() - pieces, pieces)
            edge = np.repeat(edge, pieces) + k * self.most
            size = np.minimum(self.most, np.repeat(size, pieces) - k * self.most)
        final = edge + size - 1 + self.length - GRAM
        m = np.uint64(0x9E3779B97F4A7C15)
        h = g[edge]
        for at in (np.minimum(edge + GRAM, final), np.minimum(edge + 3 * GRAM // 2, final), final):
            h = mixed((h + g[at]) * m + np.uint64(1))
        return edge + a, size, code[edge], mixed(h + size.astype(np.uint64) * m)

    def doubtful(self) -> np.ndarray:
        """Places of the regions whose gram hash several documents have."""
        told = _unpack5(b"".join(self.batch.notes(ONE)))
        return np.flatnonzero(among(self.v >> np.uint64(25), np.sort(told)))

    def distinct(self):
        """Doubtful regions, ordered by hash and key; and the first of each hash in that order."""
        at = self.doubtful()
        order = at[np.lexsort((self.key[at], self.h[at]))]
        h = self.h[order]
        return order, np.flatnonzero(np.r_[len(h) > 0, h[1:] != h[:-1]])


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes from each place, where they are all there."""
    f = 0x9E3779B97F4A7C15
    out = text * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019)
    have, eight = 1, None
    while have < 16:
        factor = np.uint64(pow(f, have, 1 << 64))
        if have == 8:
            eight = out
        out = out[:-have] * factor + out[have:] if len(out) > have else out[:0]
        have *= 2
    if len(out) <= 16:
        return out[:0]
    return mixed(out[: len(eight) - 16] * np.uint64(pow(f, 8, 1 << 64)) + eight[16:])


def _pack5(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack5(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _reply_shared(rows):
    """To each batch the gram hashes that two documents or more have."""
    marked = [_unpack5(d) for _, d in rows]
    batch = np.repeat([b for b, _ in rows], [len(m) for m in marked])
    x = np.concatenate(marked)
    h = x >> np.uint64(1)
    order = np.argsort(h, kind="stable")
    edge = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    shared = (np.diff(np.r_[edge, len(h)]) > 1) | np.logical_or.reduceat((x[order] & np.uint64(1)) > 0, edge)
    keep = order[np.repeat(shared, np.diff(np.r_[edge, len(h)]))]
    keep = keep[np.argsort(batch[keep], kind="stable")]
    b, h = batch[keep], h[keep]
    cut = np.r_[np.flatnonzero(np.r_[len(b) > 0, b[1:] != b[:-1]]), len(b)] if len(b) else np.zeros(1, int)
    return [(int(b[i]), _pack5(h[i:j])) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _gather(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes [at, at + size) of all, one after another."""
    ends = size.cumsum()
    return text[np.repeat(at - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


HEAD = np.dtype([("v", "<u8"), ("h", "<u8"), ("key", "<i8"), ("n", "u1")])


def _reply_earlier(length: int, memory: int):
    """Bit i of a region's answer: its i-th string also starts in a document with a smaller key."""

    def reply(rows):
        heads, texts = [], []
        for _, data in rows:
            n = int.from_bytes(data[:8], "little")
            heads.append(np.frombuffer(data, HEAD, n, 8))
            texts.append(np.frombuffer(data, np.uint8, offset=8 + n * HEAD.itemsize))
        batch = np.repeat([b for b, _ in rows], list(map(len, heads)))
        head, text = np.concatenate(heads), np.concatenate(texts)
        size = head["n"].astype(np.int64) + length - 1
        at = size.cumsum() - size
        order = np.lexsort((head["key"], head["h"], head["v"]))
        v, h = head["v"][order], head["h"][order]
        new = np.r_[True, (v[1:] != v[:-1]) | (h[1:] != h[:-1])]
        edge = np.flatnonzero(new)
        group = new.cumsum() - 1
        one = order[edge]  # the first document of each distinct region
        full = (np.uint64(1) << head["n"].astype(np.uint64)) - np.uint64(1)
        answer = np.zeros(len(head), np.uint64)
        late = head["key"][order] > head["key"][one][group]
        answer[order[late]] = full[order[late]]
        # Regions alone under their hash share no string with another one.
        gram = head["v"][one]
        lone = np.r_[True, gram[1:] != gram[:-1]] & np.r_[gram[1:] != gram[:-1], True]
        rest = one[~lone]
        gram = head["v"][rest]
        cut = np.flatnonzero(np.r_[len(gram) > 0, gram[1:] != gram[:-1]])
        # Whole hashes at a time; one hash with more than that is sorted on disk.
        step, begin = 1 << 17, 0
        ends = np.r_[cut[1:], len(rest)] if len(cut) else cut
        for end in ends.tolist():
            if end - begin >= step or end == len(rest):
                _mark(text, at, size, head, rest[begin:end], answer, length, memory)
                begin = end
        told = np.flatnonzero(answer)
        told = told[np.argsort(batch[told], kind="stable")]
        return split_by_batch(batch[told], head["h"][told], answer[told])

    return reply


def _mark(text, at, size, head, regions, answer, length, memory):
    """Set the bits of strings of these regions that start in a smaller key, from the suffix order."""
    if not len(regions):
        return
    n = size[regions]
    ends = (n + 1).cumsum()
    start = ends - n - 1
    joined = np.zeros(int(ends[-1]), np.uint8)
    joined[np.repeat(start - (n.cumsum() - n), n) + np.arange(int(n.sum()))] = _gather(text, at[regions], n) + 1
    owner = np.repeat(np.arange(len(regions)), n + 1)
    keys = head["key"][regions]
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle(place, lcp):
        """Runs of strings with a common prefix of `length`, whole in these arrays."""
        run = np.r_[True, lcp[1:] < length].cumsum() - 1
        who = owner[place]
        where = place - start[who]
        ok = where < n[who] - length + 1
        run, who, where = run[ok], who[ok], where[ok]
        if not len(run):
            return
        least = np.full(int(run[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, run, keys[who])
        late = keys[who] > least[run]
        np.bitwise_or.at(answer, regions[who[late]], np.uint64(1) << where[late].astype(np.uint64))

    for place, lcp in suffix_order(joined, length, memory):
        if held and lcp[0] >= length:
            lcp = lcp.copy()
        elif held:
            settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        held.append((place, lcp))
    if held:
        settle(*(np.concatenate(x) for x in zip(*held, strict=True)))


def dedupe(docs: DataFrame, length: int = LENGTH, batch_bytes: int = 6 << 20, shard_bytes: int = 12 << 20, memory: int = 64 << 20) -> DataFrame:
    """Per document its bytes, how many go in how many runs, and the digest of the rest."""
    if not 2 * GRAM + 2 <= length <= 87:
        raise ValueError("a region's strings must fit 64 bits and its grams must cover it")
    rounds = Rounds(keyed_texts(docs), batch_bytes, shard_bytes)
    shards = rounds.shards

    def dealt(v):
        """Order by shard, and the edges of the shards."""
        shard = ((v & np.uint64(0xFFFFFF)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def send_hashes(batch):
        r = Regions(batch, length)
        order = np.argsort(r.v, kind="stable")
        v, key = r.v[order], r.key[order]
        edge = np.flatnonzero(np.r_[len(v) > 0, v[1:] != v[:-1]])
        if not len(edge):
            return
        several = np.minimum.reduceat(key, edge) != np.maximum.reduceat(key, edge)
        own = v[edge]
        order, cut = dealt(own)
        x = ((own >> np.uint64(25)) << np.uint64(1) | several.astype(np.uint64))[order]
        for s in range(shards):
            yield s, _pack5(x[cut[s] : cut[s + 1]])

    rounds.ask(send_hashes, _reply_shared, ONE)

    def send_regions(batch):
        r = Regions(batch, length)
        order, edge = r.distinct()
        one = order[edge]
        by, cut = dealt(r.v[one])
        for s in range(shards):
            part = one[by[cut[s] : cut[s + 1]]]
            if len(part):
                head = np.empty(len(part), HEAD)
                head["v"], head["h"], head["key"], head["n"] = r.v[part], r.h[part], r.key[part], r.n[part]
                yield s, len(part).to_bytes(8, "little") + head.tobytes() + _gather(r.text, r.at[part], r.n[part] + length - 1).tobytes()

    rounds.ask(send_regions, _reply_earlier(length, memory), TWO)

    def finish(batch: Batch) -> pa.Table:
        r = Regions(batch, length)
        order, edge = r.distinct()
        told = [np.frombuffer(d, np.uint64).reshape(2, -1) for d in batch.notes(TWO)]
        th, tm = np.concatenate(told, axis=1) if told else np.zeros((2, 0), np.uint64)
        by = np.argsort(th)
        th, tm = th[by], tm[by]
        size = np.diff(np.r_[edge, len(order)])
        first = np.repeat(order[edge], size) if len(edge) else order
        full = (np.uint64(1) << r.n[order].astype(np.uint64)) - np.uint64(1)
        place = np.minimum(np.searchsorted(th, r.h[order]), max(0, len(th) - 1))
        known = th[place] == r.h[order] if len(th) else np.zeros(len(order), bool)
        bits = np.where(known, tm[place] if len(tm) else np.uint64(0), np.uint64(0))
        bits = np.where(r.key[order] > r.key[first], full, bits)
        edges = np.zeros(len(r.text) + 1, np.int32)
        whole = bits == full
        marks = [(r.at[order[whole]], r.n[order[whole]] + length - 1)]
        for j in range(r.most):
            hit = r.at[order[~whole & ((bits >> np.uint64(j)) & np.uint64(1) > 0)]] + j
            marks.append((hit, np.full(len(hit), length)))
        at, n = (np.concatenate(x) for x in zip(*marks, strict=True))
        np.add.at(edges, at, 1)
        np.add.at(edges, at + n, -1)
        gone = edges.cumsum()[:-1] > 0
        out = []
        for k, copied, text, a, b in zip(batch.keys, batch.copied, batch.texts, r.starts.tolist(), r.ends.tolist(), strict=True):
            if copied:
                raw = text.encode()
                cut = len(raw) if len(raw) >= length else 0
                out.append((k, len(raw), cut, int(cut > 0), hashlib.sha256(b"" if cut else raw).hexdigest()))
                continue
            cut = gone[a:b]
            n = int(cut.sum())
            kept = r.text[a:b][~cut] if n else r.text[a:b]
            spans = int((np.diff(np.r_[0, cut.astype(np.int8)]) == 1).sum()) if n else 0
            out.append((k, b - a, n, spans, hashlib.sha256(kept.tobytes()).hexdigest()))
        columns = zip(*out, strict=True) if out else ((),) * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = rounds.answer(finish, RESULT)
    return done.select(doc_id_of(done["key"]).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
