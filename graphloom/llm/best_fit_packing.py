"""Best-fit packing by a configuration linear program over the histogram of piece lengths.

A configuration is a multiset of lengths that fits one sequence.  The program asks for the fewest
configurations that cover the histogram, its lengths joined into groups of like numbers of tokens.
Multiplicative weights solve it: each round prices the groups, a knapsack dynamic program finds
the configuration of the highest price, and the weights of what it covers fall.  Rounding uses
each configuration a whole number of times; the room left, and the pieces left, are packed best
fit, longest first, in whole runs of equal sequences.  Only the histogram (at most `capacity`
lengths) and the plan (whose runs end only where a length runs out) reach the driver, however
many documents there are; documents get their places by an ordinal within their length, counted
by Spark.

Nulls: a null text is empty and packs as its end mark alone; a null doc_id stays null.  Repeated
rows each get a place of their own.  An empty table gives an empty result.  Extra columns are
ignored.  A text is tokenized whole, however long, and cut only beyond the capacity.
"""

from __future__ import annotations

import math
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_id_of, keyed_texts, parts, sliced, staged

CAPACITY, END_ID = 4096, 1
PIECES = "key long, piece int, start long, length long, ids_crc32 long"
#: Distinct words whose ids a task remembers.
REMEMBERED = 400_000


class WordIds:
    """Token ids of whole texts; white space never joins into a token, so each word is encoded once.

    Words are remembered until the memory is full; those met later are encoded again in each slice.
    """

    #: A special token that parts the words of one call to the encoder.
    PART, PART_ID = "<|endoftext|>", 49407

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.number: dict[bytes, int] = {}
        self.ids, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids per word)."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        line = self.PART + self.PART.join(w.decode() for w in words)
        ids = np.array(self.encoder.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
        part = ids == self.PART_ID
        return ids[~part], np.diff(np.r_[np.flatnonzero(part), len(ids)]) - 1

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        # The encoder lower-cases; doing A-Z first meets fewer distinct words.
        split = [t.encode().lower().split() for t in texts]
        plain = [b"<|" not in t.encode() for t in texts]
        number = self.number
        new = list(dict.fromkeys(w for words, ok in zip(split, plain, strict=True) if ok for w in words if w not in number))
        known = len(number)
        ids, size = self._encode(new)
        flat, sizes = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        number.update(zip(new, range(known, known + len(new)), strict=True))
        first = sizes.cumsum() - sizes
        out = []
        for text, words, ok in zip(texts, split, plain, strict=True):
            if not ok:  # it may hold a special token's own string
                out.append(np.array(self.encoder.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            n = sizes[at]
            ends = n.cumsum()
            total = int(ends[-1]) if len(ends) else 0
            out.append(flat[np.repeat(first[at] - ends + n, n) + np.arange(total)])
        if len(number) <= REMEMBERED:
            self.ids, self.size = flat, sizes
        else:
            for w in new:
                del number[w]
        return out


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for each worker process: its tasks share what it remembers."""
    return WordIds(path)


def _pieces(path: str, capacity: int, end_id: int):
    def cut(batches):
        encode = word_ids(path)
        for batch in batches:
            for rows in sliced(batch, 2 << 20):
                out = []
                for key, ids in zip(rows["key"].to_pylist(), encode(rows["text"].to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        out.append((key, k, start, len(part), zlib.crc32(part.tobytes())))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "piece", "start", "length", "ids_crc32"])

    return cut


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length stands in the configuration of the highest price; lengths rise."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    usable = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        k = usable[c]
        worth = best[c - lengths[:k]] + prices[:k]
        i = int(worth.argmax())
        if worth[i] > best[c - 1]:
            best[c], choice[c] = worth[i], i
        else:
            best[c] = best[c - 1]
    taken, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            taken[choice[c]] += 1
            c -= lengths[choice[c]]
    return taken


def configuration_lp(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int) -> list[tuple[np.ndarray, float]]:
    """Fractional uses of configurations that cover the demand, by multiplicative weights.

    Each round a configuration of the highest price answers the weights, and the weight of what it
    covers falls by its share of the demand; the mean over the rounds, scaled, is the solution.
    """
    weight, used = np.full(len(lengths), 1 / len(lengths)), {}
    rate = math.sqrt(8 * math.log(len(lengths) + 1) / rounds)
    for _ in range(rounds):
        row = knapsack(lengths, weight / demand, capacity)
        used[row.tobytes()] = used.get(row.tobytes(), 0) + 1
        share = row / demand
        weight *= np.exp(-rate * share / max(share.max(), 1e-300))
        weight /= weight.sum()
    rows = [(np.frombuffer(k, np.int64), x / rounds) for k, x in used.items()]
    cover = sum(x * row for row, x in rows) / demand
    scale = 1 / np.median(cover[cover > 0])
    return sorted(((row, x * scale) for row, x in rows), key=lambda r: -r[1])


def grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    """Linear grouping: the first index of each group of neighbouring lengths with like numbers of tokens."""
    tokens = counts * lengths
    middle = tokens.cumsum() - tokens / 2
    group = np.minimum((middle * groups / tokens.sum()).astype(int), groups - 1)
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1]])


def rounded(lengths, left, firsts, solution) -> list[tuple[np.ndarray, int]]:
    """Whole uses of group configurations, resolved into runs of equal sequences of real lengths."""
    ends = np.r_[firsts[1:], len(lengths)]
    out = []
    for row, x in solution:
        stock = np.add.reduceat(left, firsts)
        used = np.flatnonzero(row)
        times = int(min(math.floor(x), (stock[used] // row[used]).min()))
        while times > 0:
            # Each place takes the longest left of its group; a run ends where one of them runs out.
            take, here = np.zeros(len(lengths), np.int64), times
            for g in used:
                need = int(row[g])
                for i in range(ends[g] - 1, firsts[g] - 1, -1):
                    if need and left[i] > 0:
                        n = int(min(need, left[i]))
                        take[i] += n
                        need -= n
            at = take > 0
            here = int(min(times, (left[at] // take[at]).min()))
            left -= here * take
            times -= here
            out.append((take, here))
    return out


def fill(lengths, left, row, times, capacity):
    """Best fit into the room of `times` equal sequences; yields runs of equal sequences."""
    todo = [(row, times, capacity - int(row @ lengths))]
    while todo:
        row, times, room = todo.pop()
        k = int(np.searchsorted(lengths, room, "right"))
        at = np.flatnonzero(left[:k])
        if not len(at):
            yield row, times
            continue
        i = int(at[-1])
        some = int(min(times, left[i]))
        if some < times:
            todo.append((row, times - some, room))
        n = int(min(room // lengths[i], left[i] // some))
        new = row.copy()
        new[i] += n
        left[i] -= some * n
        todo.append((new, some, room - n * int(lengths[i])))


def plan(histogram: list[tuple[int, int]], capacity: int = CAPACITY, rounds: int = 400, groups: int = 64) -> tuple[np.ndarray, int]:
    """Rows (length, first ordinal, first sequence, copies in it, offset), and the number of sequences."""
    if not histogram:
        return np.zeros((0, 5), np.int64), 0
    lengths, counts = np.array(sorted(histogram), np.int64).T
    left, runs = counts.copy(), []
    program = np.flatnonzero(lengths < capacity)  # a full piece needs none
    if len(program):
        size, stock = lengths[program], left[program]
        firsts = grouped(size, stock, groups)
        longest = size[np.r_[firsts[1:], len(size)] - 1]  # a group counts as its longest member
        solution = configuration_lp(longest, np.add.reduceat(stock, firsts).astype(float), capacity, rounds)
        for take, times in rounded(size, stock, firsts, solution):
            row = np.zeros(len(lengths), np.int64)
            row[program] = take
            runs.append((row, times))
        left[program] = stock
        # A group counted as its longest member: the shortest piece of a sequence that is not full
        # goes back, and its place is filled again by real lengths.
        for row, times in runs:
            if int(row @ lengths) < capacity:
                i = int(np.flatnonzero(row)[0])
                row[i] -= 1
                left[i] += times
    chosen = []

    def longest_first():
        while (at := np.flatnonzero(left)).size:
            i = int(at[-1])
            row = np.zeros(len(lengths), np.int64)
            row[i] = min(capacity // lengths[i], left[i])
            times = int(left[i] // row[i])
            left[i] -= times * row[i]
            chosen.extend(fill(lengths, left, row, times, capacity))

    for row, times in sorted(runs, key=lambda r: int(r[0] @ lengths)):
        chosen += fill(lengths, left, row, times, capacity)
    longest_first()
    rows, sequence, given = [], 0, np.zeros(len(lengths), np.int64)
    for row, times in chosen:
        offset = 0
        for i in np.flatnonzero(row)[::-1]:
            rows.append((lengths[i], given[i], sequence, row[i], offset))
            offset += int(row[i] * lengths[i])
            given[i] += times * row[i]
        sequence += times
    rows.sort()
    return np.array(rows, np.int64), sequence


def _place(table: np.ndarray):
    def place(batches):
        key = (table[:, 0] << 44) + table[:, 1]
        for rows in batches:
            length, ordinal = (rows[c].to_numpy() for c in ("length", "ordinal"))
            at = np.searchsorted(key, (length << 44) + ordinal, "right") - 1
            k, copies = ordinal - table[at, 1], table[at, 3]
            sequence, offset = table[at, 2] + k // copies, table[at, 4] + (k % copies) * length
            names = ["key", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(rows[n] for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, rounds: int = 400) -> DataFrame:
    """One row per piece with its sequence and its offset there, gapless from 0."""
    pieces = staged(keyed_texts(docs).mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECES), "pieces")
    counts = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    table, _ = plan([tuple(r) for r in counts], capacity, rounds)
    # Ordinals within a length, salted: a frequent length is numbered in many tasks.
    salts = parts(sum(r["count"] for r in counts), 50_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt")
        .count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    inner = F.row_number().over(Window.partitionBy("length", "salt").orderBy("key", "piece", "start", "ids_crc32"))
    numbered = salted.withColumn("inner", inner - 1).join(before, ["length", "salt"]).withColumn("ordinal", F.col("before") + F.col("inner"))
    placed = numbered.select("key", "piece", "start", "length", "ids_crc32", "ordinal").mapInArrow(_place(table), PIECES + ", sequence_id long, offset long")
    return placed.select(doc_id_of(F.col("key")).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
