"""Secret scan: fixed patterns plus a randomness test battery over token-like runs.

Base patterns always count.  Beyond them every maximal run of 16 token characters or more is a
candidate.  Its encoding is inferred from its alphabet (hex, base32, base62, base64, or all token
characters); then three tests of "drawn uniformly from that alphabet" run: chi-squared on symbol
counts, a runs test around the middle of the alphabet, and a serial-correlation test.  Fisher's method
joins the three p-values into one number, near 0 for words and anywhere up to 1 for random keys.

The null hypothesis is ordinary text.  How random text looks is measured on the corpus itself: all
shorter runs of every document, end to end, cut into windows as long as the least candidate of each
length class.  A candidate's p-value is the share of its class's windows that look as random as it
does; the candidates reported are chosen per length class by Benjamini-Hochberg at rate `fdr`, so
that at most this share of the spans added is expected to be text.  Both sides are histograms over the
whole corpus, of bounded size.

Nulls: a null text is empty, a null doc_id stays null.  Repeated rows give repeated results, equal
runs equal verdicts, an empty table gives an empty one, extra columns are ignored.  Texts are read
whole, however long.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_id_of, keyed_texts, sliced, staged

ASSIGN = re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
NO_TOKEN = bytes(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"))
KINDS = ("assign", "access", "hex", "random")
#: Alphabets by rising size; the first that holds all symbols of a run is its encoding.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("token", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Per alphabet the number of each byte in it, and per byte the alphabets that hold it, as bits.
NUMBER = np.zeros((len(ENCODINGS), 256), np.int64)
HOLDERS = np.zeros(256, np.uint8)
for _k, (_, _symbols) in enumerate(ENCODINGS):
    NUMBER[_k, list(_symbols.encode())] = np.arange(len(_symbols))
    HOLDERS[list(_symbols.encode())] |= 1 << _k
#: Length classes are powers of two; longer candidates are held against windows of the last one.
CLASSES = (4, 5, 6, 7, 8)
#: Bins of -log10 p, a tenth each; the last takes the rest.
BINS, BIN_WIDTH = 200, 0.1
SCHEMA = "key long, spans string, n_assign long, n_access long, n_hex long, base string, runs array<struct<start:int,end:int,length_class:int,bin:int>>, plain array<struct<length_class:int,bin:int,n:int>>"


def _upper_normal(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.fromiter(map(math.erfc, (z / math.sqrt(2)).tolist()), float, len(z))


def _upper_chi2(x: np.ndarray, df: float) -> np.ndarray:
    """Wilson-Hilferty tail of chi-squared."""
    return _upper_normal((np.cbrt(x / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def battery(x: np.ndarray, size: int) -> np.ndarray:
    """The joint p-value of the three uniformity tests, for rows of equally long runs of symbol numbers."""
    rows, n = x.shape
    counts = np.bincount((np.arange(rows)[:, None] * size + x).ravel(), minlength=rows * size).reshape(rows, size)
    # With few symbols a run is judged on groups of the alphabet, so that each expects five or more.
    groups = int(max(2, min(size, n // 5)))
    edges = np.searchsorted(np.arange(size) * groups // size, np.arange(groups))
    expected = n * np.diff(np.r_[edges, size]) / size
    p_uniform = _upper_chi2(((np.add.reduceat(counts, edges, axis=1) - expected) ** 2 / expected).sum(1), groups - 1)
    # Symbols that repeat too often: coincidences against their expectation.
    pairs, mean = (counts * (counts - 1)).sum(1) / 2, n * (n - 1) / 2 / size
    p_uniform = np.minimum(1.0, 2 * np.minimum(p_uniform, _upper_normal((pairs - mean) / math.sqrt(mean * (1 - 1 / size)))))
    high = 2 * x >= size
    runs, n1 = 1 + (high[:, 1:] != high[:, :-1]).sum(1), high.sum(1)
    mean = 1 + 2 * (n - n1) * n1 / n
    spread = np.sqrt(np.maximum(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    p_runs = np.where((n1 > 0) & (n1 < n), np.minimum(1.0, 2 * _upper_normal(np.abs(runs - mean) / spread)), 2.0 ** (1 - n))
    y = x - x.mean(1, keepdims=True)
    r = (y[:, 1:] * y[:, :-1]).sum(1) / np.maximum(1e-9, (y * y).sum(1))
    p_serial = np.minimum(1.0, 2 * _upper_normal(np.abs(r) * math.sqrt(n)))
    half = -sum(np.log(np.maximum(p, 1e-300)) for p in (p_uniform, p_runs, p_serial))
    return np.exp(-half) * (1 + half + half * half / 2)  # the exact tail for six degrees of freedom


def bins(raw: bytes, length: int) -> np.ndarray:
    """The bin of each of the runs of this length that stand end to end in raw; each by its least alphabet."""
    out, step = np.zeros(len(raw) // length, np.int64), max(1, (1 << 18) // length)
    for at in range(0, len(out), step):
        x = np.frombuffer(raw, np.uint8)[at * length : (at + step) * length].reshape(-1, length)
        fits = np.bitwise_and.reduce(HOLDERS[x], axis=1)
        least = np.log2(fits & -fits.astype(np.int16)).astype(int)
        for k in np.unique(least):
            own = np.flatnonzero(least == k)
            p = battery(NUMBER[k][x[own]], len(ENCODINGS[k][1]))
            out[at + own] = np.minimum(BINS - 1, (-np.log10(np.maximum(p, 1e-300)) / BIN_WIDTH).astype(int))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def length_class(length: int) -> int:
    return min(CLASSES[-1], length.bit_length() - 1)


def _scan(batches):
    for batch in batches:
        for rows in sliced(batch, 4 << 20):
            texts = rows["text"].to_pylist()
            found = [base_spans(t) for t in texts]
            tests, by_length = [[] for _ in texts], {}
            for i, (text, spans) in enumerate(zip(texts, found, strict=True)):
                for m in CANDIDATE.finditer(text):
                    if not any(s < m.end() and m.start() < e for s, _, e in spans):
                        own = {"start": m.start(), "end": m.end()}
                        tests[i].append(own)
                        body = m.group().rstrip("=")
                        by_length.setdefault(len(body), []).append((own, body))
            for length, each in by_length.items():
                for (own, _), b in zip(each, bins("".join(body for _, body in each).encode(), length).tolist(), strict=True):
                    own |= {"length_class": length_class(length), "bin": b}
            squeezed = [CANDIDATE.sub("", t).encode().translate(None, NO_TOKEN) for t in texts]
            # Windows are cut within documents, so their counts add up alike however rows are sliced.
            plain = []
            for c in CLASSES:
                got = np.bincount(bins(b"".join(q[: len(q) >> c << c] for q in squeezed), 1 << c), minlength=BINS)
                plain += [{"length_class": c, "bin": int(b), "n": int(got[b])} for b in np.flatnonzero(got)]
            out = []
            for key, spans, own in zip(rows["key"].to_pylist(), found, tests, strict=True):
                base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                n = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
                out.append((key, base, *n, hashlib.sha256(base.encode()).hexdigest(), own, [] if out else plain))
            columns = list(zip(*out, strict=True))
            counted = pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "end", "length_class", "bin")]))
            seen = pa.list_(pa.struct([(c, pa.int32()) for c in ("length_class", "bin", "n")]))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), counted, seen]
            names = ["key", "spans", "n_assign", "n_access", "n_hex", "base", "runs", "plain"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def reported_bins(candidates, plain, fdr: float) -> dict[int, int]:
    """Per length class the number of bins, from the most random one on, that Benjamini-Hochberg reports."""
    cut = {}
    for cls in CLASSES:
        tested, text = np.zeros(BINS), np.zeros(BINS)
        for table, into in ((candidates, tested), (plain, text)):
            for c, b, n in table:
                if c == cls:
                    into[b] += n
        p = (1 + text.cumsum()) / (1 + text.sum())  # text at least as random
        ok = np.flatnonzero(p * tested.sum() <= fdr * tested.cumsum())
        cut[cls] = int(ok[-1]) + 1 if tested.sum() and len(ok) else 0
    return cut


def scan_secrets(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """One row per document: base counts and digest, and all spans, base and random."""
    scanned = staged(keyed_texts(docs).mapInArrow(_scan, SCHEMA), "secrets")
    # At most classes x bins rows each.
    tested = scanned.select(F.explode("runs").alias("r")).groupBy("r.length_class", "r.bin").agg(F.count(F.lit(1)).alias("n")).collect()
    text = scanned.select(F.explode("plain").alias("r")).groupBy("r.length_class", "r.bin").agg(F.sum("r.n").alias("n")).collect()
    cut = reported_bins([tuple(h) for h in tested], [tuple(h) for h in text], fdr)
    limit = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair])
    keep = F.filter("runs", lambda r: r["bin"] < limit[r["length_class"]])
    base = F.transform(
        F.filter(F.split("spans", ","), lambda s: s != ""),
        lambda s: F.struct(
            F.split(s, ":")[1].cast("int").alias("start"),
            F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]).cast("int").alias("kind"),
            F.split(s, ":")[2].cast("int").alias("end"),
        ),
    )
    extra = F.transform(keep, lambda r: F.struct(r["start"].alias("start"), F.lit(4).alias("kind"), r["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(
        F.array_sort(F.concat(base, extra)),
        lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    return scanned.select(
        doc_id_of(F.col("key")).alias("doc_id"),
        "n_assign",
        "n_access",
        "n_hex",
        F.col("base").alias("base_sha256"),
        F.array_join(spans, ",").alias("spans"),
        F.size(keep).cast("long").alias("n_random"),
    )
