"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits in three blocks of 21, 21 and 22.  Two fingerprints within 4 bits differ
by at most one bit in one of the blocks.  The anchors of a block are the words of a covering code
of radius 1: the perfect Hamming code on 15 bits, all values on the other bits.  Each fingerprint x
goes to its nearest anchor as a base, and as a visitor to every anchor within covering radius plus
block threshold (2 on the coded part, or 1 there and one other bit).  A pair within the threshold
thus meets at the base's anchor, where fingerprints are compared.

Copies share a fingerprint and are compared once.  What anchors compare comes out as a spanning
forest of links, so a group of near copies gives links in proportion to its size and not pairs.
An anchor with many bases is salted: its bases are dealt over several tasks, its visitors go to
all of them; no pair is lost.

Nulls: a null text is empty, and empty texts have fingerprint zero, linked like any other; a null
doc_id sorts last and comes out as null.  Repeated rows share fingerprint and component.  An empty
table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_id_of, keyed_texts, row_number, sliced, staged, text_id
from .components import components

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: (lowest bit, width) of the blocks; 15 bits of each are coded.
BLOCKS = ((0, 21), (21, 21), (42, 22))
CODED = 15


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bit i is set if more than half of the shingles' hashes have it; as a signed long."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        h = [digest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = size.cumsum()
        starts = (ends - size).tolist()
        h = [digest(line[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=False)]
    # The loop would cost a Python step a bit and hash; unpacking counts all bits at once.
    bits = np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):
        total += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big", signed=True)


def _fingerprints(batches):
    for batch in batches:
        for rows in sliced(batch, 4 << 20):
            prints = [fingerprint(t.encode().lower().split()) for t in rows["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([rows["key"], pa.array(prints, pa.int64())], ["key", "fp"])


def _syndromes() -> np.ndarray:
    """Syndrome of every 15-bit value: the exclusive or of the (1-based) numbers of its set bits."""
    out = np.zeros(1 << CODED, np.int64)
    for bit in range(CODED):
        out[np.arange(1 << CODED) >> bit & 1 == 1] ^= bit + 1
    return out


def anchors(values: np.ndarray, width: int, syndrome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each block value the nearest anchor (n) and the anchors it visits (n, k); -1 fills up."""
    coded, rest = values & ((1 << CODED) - 1), values >> CODED
    s = syndrome[coded]

    def flip(x, number):  # the bit of that number, none for 0
        return x ^ np.where(number > 0, 1 << np.maximum(number - 1, 0), 0)

    near = flip(coded, s)
    visits = [near | rest << CODED]
    # Words of the code two flips away: bits i and j with i xor j equal to the syndrome.
    for i in range(1, CODED + 1):
        j = s ^ i
        visits.append(np.where((s > 0) & (j > i), flip(flip(coded, np.full_like(s, i)), j) | rest << CODED, -1))
    visits += [near | (rest ^ 1 << bit) << CODED for bit in range(width - CODED)]
    return visits[0], np.stack(visits, 1)


def _replicas(batches):
    syndrome = _syndromes()
    for batch in batches:
        fp = batch["fp"].to_numpy()
        for block, (low, width) in enumerate(BLOCKS):
            near, visits = anchors(fp >> low & ((1 << width) - 1), width, syndrome)
            row, column = np.nonzero(visits >= 0)
            where = np.concatenate([near, visits[row, column]]) | block << 24
            who = np.concatenate([fp, fp[row]])
            base = np.zeros(len(who), bool)
            base[: len(fp)] = True
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(who), pa.array(base)], ["anchor", "fp", "base"])


def forest(bases: np.ndarray, visitors: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of 'base and visitor differ by at most threshold bits'."""
    top: dict[int, int] = {}

    def root(x):
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = top[x]
        return x

    links = []
    step = max(1, (1 << 20) // max(1, len(visitors)))
    for at in range(0, len(bases), step):
        part = bases[at : at + step]
        near = np.bitwise_count((part[:, None] ^ visitors[None, :]).view(np.uint64)) <= threshold
        near &= part[:, None] < visitors[None, :]
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            a, b = root(int(part[i])), root(int(visitors[j]))
            if a != b:
                top[max(a, b)] = min(a, b)
                links.append((int(part[i]), int(visitors[j])))
    return links


def _compare(threshold: int):
    """Rows come sorted by anchor and salt; each such run is one comparison."""

    def compare(batches):
        held = []

        def done(runs):
            where, fp, base = (np.concatenate(x) for x in zip(*runs, strict=True))
            edge = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            size = np.diff(np.r_[edge, len(where)])
            n_base = np.add.reduceat(base.astype(np.int64), edge)
            found = []
            for at, n in zip(edge[(n_base > 0) & (size > n_base)].tolist(), size[(n_base > 0) & (size > n_base)].tolist(), strict=True):
                b = base[at : at + n]
                f = fp[at : at + n]
                found += forest(f[b], f[~b], threshold)
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for rows in batches:
            where = rows["anchor"].to_numpy().astype(np.int64) << 20 | rows["salt"].to_numpy()
            fp, base = rows["fp"].to_numpy(), rows["base"].to_numpy(zero_copy_only=False)
            if not len(where):
                continue
            last = int(np.searchsorted(where, where[-1]))  # the run at the end may go on
            if last == 0 and (not held or held[-1][0][0] == where[0]):
                held.append((where, fp, base))
                continue
            held.append((where[:last], fp[:last], base[:last]))
            yield done(held)
            held = [(where[last:], fp[last:], base[last:])]
        if held:
            yield done(held)

    return compare


def _row_fingerprints(batches):
    for batch in batches:
        for rows in sliced(batch, 4 << 20):
            texts = rows["text"].to_pylist()
            names = [row_number(k, t) for k, t in zip(rows["key"].to_pylist(), texts, strict=True)]
            prints = [fingerprint(t.encode().lower().split()) for t in texts]
            yield pa.RecordBatch.from_arrays([rows["key"], rows["tid"], pa.array(names, pa.int64()), pa.array(prints, pa.int64())], ["key", "tid", "did", "fp"])


def row_fingerprints(docs: DataFrame) -> DataFrame:
    """(key, tid, did, fp): as `fingerprints`, with what tells rows of one id apart and a number for each row."""
    keyed = keyed_texts(docs)
    return keyed.withColumn("tid", text_id(keyed)).mapInArrow(_row_fingerprints, "key long, tid long, did long, fp long")


def row_links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links of rows (did, fp) to the least row of what their fingerprints' links reach."""
    rooted = prints.select("did", "fp").join(rooted_prints(prints, threshold), "fp")
    heads = rooted.groupBy("root").agg(F.min("did").alias("a"))
    return rooted.join(heads, "root").where("did > a").select("a", F.col("did").alias("b"))


def rooted_prints(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, root): each distinct fingerprint and the least that links reach."""
    groups = components(links(prints, threshold))
    return prints.select("fp").distinct().join(groups, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def fingerprints(docs: DataFrame) -> DataFrame:
    return keyed_texts(docs).mapInArrow(_fingerprints, "key long, fp long")


def links(prints: DataFrame, threshold: int = THRESHOLD, crowd: int = 2000) -> DataFrame:
    """(a, b) fingerprints, a spanning forest's links at least, of distinct `fp` within threshold."""
    if not 0 <= threshold <= 4:
        raise ValueError("three blocks cover up to 4 bits")
    copies = staged(prints.select("fp").distinct().mapInArrow(_replicas, "anchor int, fp long, base boolean"), "anchors")
    crowds = copies.where("base").groupBy("anchor").count().where(F.col("count") > crowd).select("anchor", F.ceil(F.col("count") / crowd).cast("int").alias("salts"))
    dealt = copies.join(crowds, "anchor", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
    dealt = dealt.select("anchor", "fp", "base", F.explode(F.when(F.col("base"), own).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))).alias("salt"))
    ordered = dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    return ordered.mapInArrow(_compare(threshold), "a long, b long").distinct()


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint and the smallest doc_id that links reach, per document."""
    prints = staged(fingerprints(docs), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("key").alias("least"))
    rooted = least.join(rooted_prints(prints, threshold), "fp")
    heads = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of = rooted.join(heads, "root").select("fp", "component")
    return prints.join(of, "fp").select(doc_id_of(F.col("key")).alias("doc_id"), hex_digits(F.col("fp")).alias("fingerprint"), doc_id_of(F.col("component")).alias("component_id"))
