"""Near-duplicates by Jaccard similarity of five-word shingles, found exactly.

Fingerprints of 64 bits cannot promise a similarity: pairs of 0.8 and more lie up to 13 bits and
more apart.  So candidates come from the shingles themselves, by the prefix rule.  All shingles are
ordered by how many documents have them, then by hash; two sets that share `least` of the larger one
share one of the first `size - least * size + 1` shingles of either.  Shingles that only one document
has stand first and meet nothing: a document with more of them than its prefix is long has no near
duplicate, and is done with.  Frequencies come from one round over batches and shards (`batches`).

Documents that share a prefix shingle are joined to candidate groups, by star links in proportion to
their shingles.  A group is cut into blocks of at most `crowd` documents, in the order of a shingle that
each shares, so that like documents are mostly neighbours.  Within each block, pairs that share a prefix
shingle and are not connected yet are compared exactly.  Then the first documents of what is connected
so far are compared among themselves in the same way, which joins a large group of copies by its few
first documents.  At last two blocks meet where a shingle lies in both, in documents not connected yet.  A
task holds two blocks at most, whatever the size of the group.

Nulls: a null text is empty, and empty texts equal each other; a null doc_id sorts last, and rows are
told apart by id and text.  A text of fewer than five words is one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import placed
from . import simhash_neardup
from .batches import Batch, Rounds, deal, mixed, split_by_batch
from .common import NULL_KEY, keyed_texts, row_number, staged, text_id
from .components import components

SHINGLE = 5
#: The least similarity as a fraction, so that sizes are exact.
LEAST = (4, 5)
LOW = np.uint64(0xFF)
#: Characters of texts whose words are held at once.
SLICE = 1 << 18
FOUND = "key long, tid long, did long, copied boolean, prefix binary, shingles binary"


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def shingle_sets(texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    out, at, size = [], 0, 0
    for i, text in enumerate(texts):  # words are objects: those of a slice only are held at once
        size += len(text)
        if size > SLICE or i == len(texts) - 1:
            out += _shingle_sets(texts[at : i + 1], shingle)
            at, size = i + 1, 0
    return out


def _shingle_sets(texts: list[str], shingle: int) -> list[np.ndarray]:
    words = [t.encode().lower().split() for t in texts]
    flat = [w for own in words for w in own]
    h = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, len(flat))
    n = max(0, len(h) - shingle + 1)
    window = np.zeros(n, np.uint64)
    for j in range(shingle):
        window = window * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    window = mixed(window)
    out, at = [], 0
    for own in words:
        if len(own) < shingle:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(own), 1)], np.uint64))
        else:
            out.append(np.unique(window[at : at + len(own) - shingle + 1]))
        at += len(own)
    return out


class Live:
    """The distinct documents of a batch that are no copies, and their shingles."""

    def __init__(self, batch: Batch):
        rows = list(zip(batch.keys, batch.texts, strict=True))
        new = [i == 0 or rows[i] != rows[i - 1] for i in range(len(rows))]
        self.copies = [r for r, c, n in zip(rows, batch.copied, new, strict=True) if c and n]
        self.rows = [r for r, c, n in zip(rows, batch.copied, new, strict=True) if n and not c]
        self.sets = shingle_sets([t for _, t in self.rows])


def _reply_frequency(rows):
    """To each batch those of its shingles that two documents have, with a class of their frequency below."""
    x = np.concatenate([np.frombuffer(d, np.uint64) for _, d in rows])
    batch = np.repeat([b for b, _ in rows], [len(d) // 8 for _, d in rows])
    h, where = np.unique(x & ~LOW, return_inverse=True)
    total = np.bincount(where, weights=x & LOW)
    code = np.minimum(255, 8 * np.log2(np.maximum(total, 1))).astype(np.uint64)
    keep = np.flatnonzero(total[where] > 1)
    keep = keep[np.argsort(batch[keep], kind="stable")]
    return split_by_batch(batch[keep], h[where[keep]] | code[where[keep]])


def prefix(shingles: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The shingles by which a like set must be met; code is 0 where no other document has it."""
    size = len(shingles)
    length = size - -(-LEAST[0] * size // LEAST[1]) + 1
    first = np.lexsort((shingles, code))[:length]
    return shingles[first[code[first] > 0]]


def compare(dids: np.ndarray, base: np.ndarray, prefixes: list[np.ndarray], sets: list[np.ndarray], group: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the given groups where 'a base and a later row are alike', bases first: stars around the least did.

    If all rows are bases each meets the later ones, else those that are none.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, start = np.concatenate(sets), size.cumsum() - size
    met = np.concatenate(prefixes)
    owner = np.repeat(np.arange(len(sets)), list(map(len, prefixes)))
    by = np.lexsort((owner, met))
    met, owner = met[by], owner[by]
    given, group, alone = group, group.copy(), bool(base.all())
    for i in np.flatnonzero(base).tolist():
        open_ = group != group[i]
        open_[: i + 1] = False
        open_ &= alone | ~base
        if not open_.any():
            continue
        lo, hi = np.searchsorted(met, prefixes[i], "left"), np.searchsorted(met, prefixes[i], "right")
        seen = np.zeros(len(sets), bool)
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            seen[owner[a:b]] = True
        j = np.flatnonzero(seen & open_ & (LEAST[1] * size >= LEAST[0] * size[i]) & (LEAST[1] * size[i] >= LEAST[0] * size))
        if not len(j):
            continue
        n = size[j]
        ends = n.cumsum()
        theirs = flat[np.repeat(start[j] - (ends - n), n) + np.arange(int(ends[-1]))]
        at = np.minimum(np.searchsorted(sets[i], theirs), len(sets[i]) - 1)
        both = np.add.reduceat((sets[i][at] == theirs).astype(np.int64), ends - n)
        for k in j[LEAST[1] * both >= LEAST[0] * (size[i] + n - both)].tolist():
            if group[k] != group[i]:
                group[group == group[k]] = group[i]
    by = np.lexsort((dids, group))
    top = np.empty(len(dids), dids.dtype)
    new = np.concatenate(([True], np.diff(group[by]) != 0))
    top[by] = dids[by][np.flatnonzero(new)[np.cumsum(new) - 1]]
    _, one = np.unique(given[by], return_index=True)
    one = by[one]
    return [(int(a), int(b)) for a, b in zip(top[one], dids[one], strict=True) if a != b]


def _compare_blocks(batches):
    """Rows come sorted by root, i, j, bases first; each run of root, i and j is one comparison."""
    held, name = [], None

    def done(rows):
        found = []
        if len(rows) > 1:
            dids = np.array([r[0] for r in rows])
            group = np.unique([r[2] for r in rows], return_inverse=True)[1]
            found = compare(dids, np.array([r[1] for r in rows]), *([np.frombuffer(r[k], np.uint64) for r in rows] for k in (3, 4)), group)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        names = zip(*(batch[c].to_pylist() for c in ("root", "i", "j")), strict=True)
        rows = zip(*(batch[c].to_pylist() for c in ("did", "base", "label", "prefix", "shingles")), strict=True)
        for own, row in zip(names, rows, strict=True):
            if own != name:
                if held:
                    yield done(held)
                held, name = [], own
            held.append(row)
    if held:
        yield done(held)


def _entries(batches):
    for batch in batches:
        each = [np.frombuffer(d, np.int64) for d in batch["prefix"].to_pylist()]
        if each:
            did = np.repeat(batch["did"].to_numpy(), list(map(len, each)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each)), pa.array(did)], ["g", "did"])


def candidates(texts: DataFrame, batch_bytes: int, shard_bytes: int) -> DataFrame:
    """Copies of texts with a smaller key, and documents that may have a near duplicate with their shingles."""
    rounds = Rounds(texts, batch_bytes, shard_bytes)
    shards = rounds.shards

    def send(batch):
        sets = Live(batch).sets
        h, n = np.unique(np.concatenate(sets) & ~LOW if sets else np.zeros(0, np.uint64), return_counts=True)
        return deal(h, shards, h | np.minimum(n, 255).astype(np.uint64))

    rounds.ask(send, _reply_frequency, 1)

    def finish(batch: Batch) -> pa.Table:
        live = Live(batch)
        told = batch.hashes(1)
        above = told & ~LOW
        size = list(map(len, live.sets))
        flat = np.concatenate(live.sets) if size else np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(above, flat & ~LOW), max(0, len(above) - 1))
        # The class of two documents is 8, so 0 is free.
        code = np.where(above[at] == flat & ~LOW, told[at] & LOW, np.uint64(0)) if len(above) else np.zeros(len(flat), np.uint64)
        tid = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))  # noqa: E731  (Spark's xxhash64)
        out = [(k, tid(t), 0, True, None, None) for k, t in live.copies]
        end = 0
        for (k, t), own in zip(live.rows, live.sets, strict=True):
            begin, end = end, end + len(own)
            met = prefix(own, code[begin:end])
            if len(met):
                out.append((k, tid(t), row_number(k, t), False, met.tobytes(), own.tobytes()))
        columns = zip(*out, strict=True) if out else ((),) * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "tid", "did", "copied", "prefix", "shingles"])

    return staged(rounds.answer(finish, FOUND), "near-sets")


def blocks(shared: DataFrame, groups: DataFrame, crowd: int) -> DataFrame:
    """(did, root, block): each candidate group in blocks of at most crowd documents, those of like first shingles together.

    shared (did, g): shingles that several documents have; groups (node, root).
    """
    rows = groups.select(F.col("node").alias("did"), "root").join(shared.groupBy("did").agg(F.min("g").alias("g")), "did")
    large = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("root")
    cut = placed(rows.join(large, "root", "left_semi"), ["root"], [F.col("g"), F.col("did")]).select("did", "root", F.floor(F.col("place") / crowd).cast("int").alias("block"))
    return staged(rows.join(large, "root", "left_anti").select("did", "root", F.lit(0).alias("block")).unionByName(cut), "near-blocks")


def _compared(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links found in comparisons (root, i, j, did, base, label)."""
    ordered = rows.join(sets.select("did", "prefix", "shingles"), "did").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", F.desc("base"), "did")
    return staged(ordered.mapInArrow(_compare_blocks, "a long, b long"), "near-found")


def links(sets: DataFrame, crowd: int) -> DataFrame:
    """(a, b): a spanning forest's links at least, of documents that are alike."""
    entries = staged(sets.select("did", "prefix").mapInArrow(_entries, "g long, did long"), "near-entries")
    heads = entries.groupBy("g").agg(F.min("did").alias("head"), F.max("did").alias("last")).where("head < last").select("g", "head")
    shared = staged(entries.join(heads, "g").select("g", "did", "head"), "near-shared")
    groups = components(shared.where("did > head").select(F.col("head").alias("a"), F.col("did").alias("b")))
    at = blocks(shared, groups, crowd)
    found = _compared(at.select("did", "root", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(True).alias("base"), F.col("did").alias("label")), sets)
    several = staged(at.where("block > 0").select("root").distinct(), "near-several")
    if several.isEmpty():
        return found
    open_ = at.join(several, "root", "left_semi")
    stars = found.select(F.col("b").alias("did"), F.col("a").alias("label"))
    label = staged(open_.join(stars, "did", "left").select("did", "root", "block", F.coalesce("label", "did").alias("label")), "near-labels")
    first = label.where("did = label").select("did")
    if 2 * first.count() < label.count():
        more = staged(links(sets.join(first, "did", "left_semi"), crowd), "near-first")
        top = components(more).select(F.col("node").alias("label"), F.col("root").alias("top"))
        label = staged(label.join(top, "label", "left").select("did", "root", "block", F.coalesce("top", "label").alias("label")), "near-labels")
        found = found.unionByName(more)
    # A shingle leads two blocks together unless all its documents in both are connected.
    sides = shared.join(label, "did").groupBy("g", "root", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    one, two = (sides.select("g", "root", F.col("block").alias(b), F.col("low").alias(f"low_{b}"), F.col("high").alias(f"high_{b}")) for b in "ij")
    pairs = one.join(two, ["g", "root"]).where("i < j AND NOT (low_i = high_i AND low_j = high_j AND low_i = low_j)").select("root", "i", "j").distinct()
    pairs = staged(pairs, "near-pairs")
    meet = lambda b: pairs.join(label, (pairs["root"] == label["root"]) & (pairs[b] == label["block"])).select("did", pairs["root"], "i", "j", F.lit(b == "i").alias("base"), "label")
    return found.unionByName(_compared(meet("i").unionByName(meet("j")), sets)).distinct()


def keep_first(docs: DataFrame, batch_bytes: int = 2 << 20, shard_bytes: int = 6 << 20, crowd: int = 500, prints: DataFrame | None = None) -> DataFrame:
    """The documents that are the first of their group of near duplicates, all columns; of equal rows one stays.

    prints (key, tid, did, fp): fingerprints of all rows (`simhash_neardup`); what they link is in one group too.
    """
    more = None if prints is None else staged(simhash_neardup.row_links(prints), "near-simhash")
    found = candidates(keyed_texts(docs), batch_bytes, shard_bytes)
    sets = found.where("not copied")
    alike, rows = links(sets, crowd), sets
    if more is not None:
        alike, rows = alike.unionByName(more), prints
    groups = components(alike)
    named = staged(rows.select("key", "tid", "did").distinct().join(groups, F.col("did") == F.col("node")).select("key", "tid", "root"), "near-groups")
    first = named.groupBy("root").agg(F.min(F.struct("key", "tid")).alias("first"))
    late = named.join(first, "root").where(F.struct("key", "tid") > F.col("first")).select("key", "tid")
    gone = late.unionByName(found.where("copied").select("key", "tid")).select(F.col("key").alias("__gone_key"), F.col("tid").alias("__gone_tid"))
    known = docs.withColumns({"__key": F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_KEY)), "__tid": text_id(docs)})
    kept = known.join(gone, (F.col("__key") == F.col("__gone_key")) & (F.col("__tid") == F.col("__gone_tid")), "left_anti")
    return kept.dropDuplicates(["__key", "__tid"]).drop("__key", "__tid")
