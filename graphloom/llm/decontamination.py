"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may appear with up to k = m // `piece` errors.  It is split into k + 1
pieces; if it appears, one piece appears unchanged.  An automaton of all pieces finds the exact
hits in whole texts, and Myers' bit-parallel distance verifies the text around each hit.  Items and
texts are compared in lower case with every run of white space as one space.

The items are the query side: they are held in blocks of at most `block_bytes`, each matched
against all documents, so a benchmark of any size needs no more memory.  Documents are not shuffled.

Nulls: a null or blank item matches nothing, a null text is empty, a null doc_id stays null.
Repeated documents are judged row by row, repeated items give a row each; an empty table gives an
empty result; extra columns are ignored (`clean` keeps them).
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_id_of, keyed_texts, parts, sliced

PIECE = 16
BLOCK_BYTES = 8 << 20
MATCHES = "key long, item_id long, edits int, start long, end long"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def distance_ends(pattern_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least distance of the pattern to any stretch of the text, and where the first such one ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        eq = pattern_masks.get(c, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, at
    return best, end


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """All items of a block: the automaton of their pieces, and their bit masks."""

    def __init__(self, items: list[tuple[int | None, str]], piece: int = PIECE):
        import ahocorasick

        self.items = items
        self.budget = [len(t) // piece for _, t in items]
        self.masks: dict[int, tuple[dict, dict]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(items):
            n = self.budget[i] + 1
            edges = [len(text) * k // n for k in range(n + 1)]
            for a, b in zip(edges, edges[1:], strict=False):
                places.setdefault(text[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for word, where in places.items():
            self.automaton.add_word(word, (len(word), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, edits, start, end) of the best place of each item that appears."""
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for i, offset in where:
                starts.setdefault(i, set()).add(end + 1 - size - offset)
        out = []
        for i, found in starts.items():
            item, k = self.items[i][1], self.budget[i]
            m, best = len(item), None
            if i not in self.masks:
                self.masks[i] = masks(item), masks(item[::-1])
            ordered = sorted(found)
            low = ordered[0]
            # Hits that could belong to one appearance are verified together.
            for s, after in zip(ordered, [*ordered[1:], None], strict=True):
                if after is not None and after - s <= 2 * k:
                    continue
                a, b = max(0, low - k), min(len(text), s + m + k)
                edits, end = distance_ends(self.masks[i][0], m, text[a:b])
                if edits <= k and (best is None or edits < best[0]):
                    _, back = distance_ends(self.masks[i][1], m, text[max(0, a + end - m - k) : a + end][::-1])
                    best = edits, a + end - back, a + end
                low = after
            if best:
                out.append((self.items[i][0], *best))
        return out


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The items, normalized, a bounded block at a time."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), F.col("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = parts(total, block_bytes)
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        rows = [(r["item_id"], normal(r["text"])) for r in block.collect()]
        yield sorted((r for r in rows if r[1]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def matches(docs: DataFrame, benchmark: DataFrame, piece: int = PIECE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits, start, end (of the normalized text) of each item that a text holds."""

    def matcher(items):
        def run(batches):
            found = Matcher(items, piece)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            for batch in batches:
                for rows in sliced(batch, 8 << 20):
                    out = [(key, *m) for key, text in zip(rows["key"].to_pylist(), rows["text"].to_pylist(), strict=True) for m in (found.find(normal(text)) if text else ())]
                    columns = zip(*out, strict=True) if out else ((),) * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "item_id", "edits", "start", "end"])

        return run

    texts = keyed_texts(docs)
    found = [texts.mapInArrow(matcher(items), MATCHES) for items in _blocks(benchmark, block_bytes) if items]
    every = reduce(DataFrame.unionByName, found) if found else texts.sparkSession.createDataFrame([], MATCHES)
    return every.select(doc_id_of(every["key"]).alias("doc_id"), "item_id", "edits", "start", "end")


def clean(docs: DataFrame, benchmark: DataFrame, piece: int = PIECE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, that hold no benchmark item; no shuffle."""

    def keep(items):
        def run(batches):
            found = Matcher(items, piece)
            for batch in batches:
                for rows in sliced(batch, 8 << 20):
                    good = [not (t and found.find(normal(t))) for t in rows["text"].to_pylist()]
                    yield rows.filter(pa.array(good, pa.bool_()))

        return run

    for items in _blocks(benchmark, block_bytes):
        if items:
            docs = docs.mapInArrow(keep(items), docs.schema)
    return docs
