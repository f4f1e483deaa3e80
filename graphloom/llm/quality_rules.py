"""Quality rules: rule statistics of every document, judged by an isolation forest.

Statistics come from whole texts.  The forest is grown on a sample of at most `fit_rows` rows
labelled good, chosen by hash; its random axis splits are drawn over the range that all labelled rows
span, good or bad, so a document that lies where no good one does is parted from them after few
splits.  Path lengths alone judge.  The threshold is calibrated on the scores of all labelled rows,
gathered as a histogram of fixed size: the largest share of bad rows is rejected such that at most
`clean_loss` of the good ones go; rows that the base rule rejects have no part in it.  Features are
ratios, so a long document is no anomaly for its length.

Nulls: a null text has no words and fails the base rule; a null doc_id stays null and has no
label.  Documents without labels are judged like the others; where no row is labelled good and
bad, only the base rule rejects.  Of several labels of an id the worst counts; equal statistics get
equal scores.  Repeated rows give repeated results; an empty table gives an empty one; extra columns
are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, doc_id_of, keyed_texts, sliced, staged, text_id

SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8
STAT_NAMES = ["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbol", "duplicate", "repeat", "word_length", "upper", "digit", "mark", "common"]
SCHEMA = "key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"
SCORE_BINS = 2000


def window_hashes(words: list[bytes], length: int) -> np.ndarray:
    """64-bit polynomial hashes of all windows of `length` words."""
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    n = len(words) - length + 1
    acc = np.zeros(n, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for j in range(length):
        acc = acc * base + h[j : j + n]
    return acc


def repeated_words(words: list[bytes], length: int = WINDOW) -> int:
    """How many words lie in windows that occur twice or more."""
    if len(words) <= length:
        return 0
    h = window_hashes(words, length)
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return int((edge.cumsum()[:-1] > 0).sum())


def statistics(text: str) -> tuple:
    raw = text.encode()
    words = raw.split()
    n, joined = len(words), b"".join(words).decode()
    chars, symbols = len(joined), len(SYMBOLS.findall(text))
    seen, dup = set(), 0
    lines = text.split("\n")
    for line in lines:
        if line in seen:
            dup += bool(line.encode().split())
        seen.add(line)
    repeat = repeated_words(words)
    upper = sum(map(str.isupper, joined)) if not joined.islower() else 0
    digits = len(re.findall("[0-9]", joined))
    marks = len(re.findall(r"[!?;:=+_/\\~^{}\[\]]", joined))
    distinct = len(set(words))
    c, w = max(1, chars), max(1, n)
    return (n, chars, symbols, dup, repeat), [
        symbols / c,
        dup / max(1, len(lines)),
        repeat / w,
        math.log1p(chars / w),
        upper / c,
        digits / c,
        marks / c,
        # Distinct words against the usual growth with length.
        math.log(max(1, distinct)) / math.log(w + 1.5),
    ]


def _measure(batches):
    kinds = [pa.int64()] * 6 + [pa.list_(pa.float64())]
    for batch in batches:
        for rows in sliced(batch, 4 << 20):
            out = []
            for key, text in zip(rows["key"].to_pylist(), rows["text"].to_pylist(), strict=True):
                counts, features = statistics(text)
                out.append((key, *counts, features))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            more = [n for n in rows.schema.names if n == "tid"]
            yield pa.RecordBatch.from_arrays([*(rows[n] for n in more), *columns], [*more, *STAT_NAMES, "features"])


class IsolationForest:
    """Random axis splits over a box; a row's score is 2 ** (-mean path / the usual path), near 1 if it stands alone."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 128, sample: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(rows))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], low, high, rng) for _ in range(trees)]

    @staticmethod
    def usual(n):
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def _grow(self, rows, low, high, rng):
        """Arrays (feature or -1, split, left, right, path at a leaf); a leaf may be empty of rows."""
        limit = 2 * math.ceil(math.log2(max(2, len(rows))))
        nodes, todo = [], [(rows, 0, None, 0, low, high)]
        while todo:
            part, depth, parent, side, low, high = todo.pop()
            me = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + float(self.usual(len(part)))])
            if parent is not None:
                nodes[parent][2 + side] = me
            open_ = np.flatnonzero(high > low)
            if depth >= limit or not len(part) or not len(open_):
                continue
            f = int(rng.choice(open_))
            cut = rng.uniform(low[f], high[f])
            nodes[me][0], nodes[me][1] = f, cut
            below, at_f = part[:, f] < cut, np.arange(len(low)) == f
            todo += [(part[below], depth + 1, me, 0, low, np.where(at_f, cut, high)), (part[~below], depth + 1, me, 1, np.where(at_f, cut, low), high)]
        a = np.array(nodes)
        return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, path in self.trees:
            at, open_ = np.zeros(len(x), int), np.arange(len(x))
            while len(open_):
                here = at[open_]
                below = x[open_, feature[here]] < cut[here]
                at[open_] = np.where(below, left[here], right[here])
                open_ = open_[feature[at[open_]] >= 0]
            total += path[at]
        return 2.0 ** (-(total / len(self.trees)) / max(1e-9, float(self.usual(self.size))))


def calibrate(histogram, clean_loss: float) -> float | None:
    """The score from which on at most clean_loss of the good rows go, and as many bad ones as that allows.

    Of all bins with that outcome the middle one leaves equal room on both sides.
    """
    good, bad = np.zeros(SCORE_BINS), np.zeros(SCORE_BINS)
    for quality, b, n in histogram:
        (good if quality else bad)[b] += n
    if not good.sum() or not bad.sum():
        return None
    lost = good[::-1].cumsum()[::-1]
    ok = np.flatnonzero(lost <= clean_loss * good.sum())
    if not len(ok):
        return None
    caught = bad[::-1].cumsum()[::-1]
    return (ok[0] + np.flatnonzero(caught == caught[ok[0]])[-1]) // 2 / SCORE_BINS


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = 8192, clean_loss: float = 0.002, seed: int = 7) -> DataFrame:
    """One row per document: the statistics, base_failed, the forest's score and kept."""
    return _judged(keyed_texts(docs), SCHEMA, labels, fit_rows, clean_loss, seed)


def _judged(texts: DataFrame, schema: str, labels: DataFrame, fit_rows: int = 8192, clean_loss: float = 0.002, seed: int = 7) -> DataFrame:
    """`judge` on keyed texts; a column tid, if they have it, comes out first."""
    stats = staged(texts.mapInArrow(_measure, schema), "quality")
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.min("quality").alias("quality"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    labelled = stats.join(marked, "key").select("key", "features", "quality", base.alias("failed"))
    known = labelled.where("not failed").drop("failed")
    fit = known.where("quality = 1").orderBy(F.xxhash64("key", F.lit(seed)), "key", "features").limit(fit_rows).collect()
    forest, cut = None, None
    if len(fit) > 1:
        ends = labelled.agg(*(f(F.col("features")[i]) for f in (F.min, F.max) for i in range(len(FEATURES)))).first()
        low, high = np.array(ends).reshape(2, -1)
        forest = IsolationForest(np.array([r["features"] for r in sorted(fit, key=lambda r: (r["key"], r["features"]))]), low, high, seed=seed)

    def score(batches):
        for rows in batches:
            flat = rows["features"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = forest.score(flat) if forest is not None and len(flat) else np.zeros(len(flat))
            names = [n for n in rows.schema.names if n != "features"]
            yield pa.RecordBatch.from_arrays([*(rows[n] for n in names), pa.array(s, pa.float64())], [*names, "anomaly"])

    scored = stats.mapInArrow(score, schema.rsplit(",", 1)[0] + ", anomaly double")
    if forest is not None:
        bins = known.mapInArrow(score, "key long, quality int, anomaly double").groupBy("quality", F.least(F.floor(F.col("anomaly") * SCORE_BINS), F.lit(SCORE_BINS - 1)).cast("int").alias("bin")).count()
        cut = calibrate([tuple(r) for r in bins.collect()], clean_loss)
    odd = F.lit(False) if cut is None else F.floor(F.col("anomaly") * SCORE_BINS) >= F.lit(round(cut * SCORE_BINS))
    return scored.select(
        *(n for n in scored.columns if n == "tid"),
        doc_id_of(F.col("key")).alias("doc_id"),
        *STAT_NAMES[1:],
        base.alias("base_failed"),
        (~base & ~odd).alias("kept"),
        F.round("anomaly", 9).alias("anomaly"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that `judge` keeps; only rows of equal id and text share a verdict."""
    texts = keyed_texts(docs).withColumn("tid", F.xxhash64("text"))
    kept = _judged(texts, "tid long, " + SCHEMA, labels, **options).where("kept")
    verdict = kept.select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("__kept_key"), F.col("tid").alias("__kept_tid")).distinct()
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_KEY))
    return docs.join(verdict, (key == F.col("__kept_key")) & (text_id(docs) == F.col("__kept_tid")), "left_semi")
