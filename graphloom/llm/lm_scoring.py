"""LM scoring: a causal self-attention model in numpy on subword ids, beside a smoothed unigram base.

Documents (A-Z lowered) are dealt by id and text into units of a bounded size, which depend on the
corpus alone.  A unit is packed once into a row: its distinct words, the numbers of its words, and
the ids of a public byte-level tokenizer for them, each document closed by an end id.

Base: each unit sends the hashes of its distinct words, with their training counts, to shards of the
hash space; a shard adds up and answers every unit, so a frequent word costs one entry a unit.  Words
are told apart by 64-bit hashes.

Model: one attention layer over classes of ids predicts the class of the next id; within the class
the id follows counts given the class before it.  These counts cover every training document.  The
attention weights are trained on consecutive windows over all ids of every training document, each id
predicted once, by rounds of local Adam steps in each unit whose weights are averaged: a round takes
its share of every document's windows.  Units and the exact sums of their weights do not depend on
how Spark cuts the table, nor do the scores.  The work grows with the corpus and nothing of its size
reaches the driver.  Scoring cuts each document into overlapping windows and scores every id once,
with at least `OVERLAP` ids before it, in masked batches.

Nulls: a null text is empty: one end token.  A null doc_id counts as empty text for the fold, sorts
last and stays null.  Repeated rows each count and get a row; ties between frequent ids fall to the
smaller id.  An empty table gives an empty result; extra columns are ignored.  Texts are scored
whole, however long: a unit holds its longest text at least.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, doc_id_of, parts, release, shared_dir, text_bytes

END, IDS = 50256, 50257
#: Input classes (own, shared) and output classes (own, shared) of ids by frequency.
INPUT, OUTPUT = (144, 48), (48, 16)
WIDTH, WINDOW, OVERLAP = 16, 32, 8
#: Weight of the plain class distribution against counts given the class before.
PRIOR = 5.0
#: Distinct words whose ids a worker remembers.
REMEMBERED = 400_000
#: Weights are added up as whole multiples of this, so that sums do not depend on their order.
GRAIN = 2.0**-20
#: Windows scored at once: their arrays stay within a core's cache.
BLOCK = 128
#: A unit: documents (keys, tids, held, sizes in words, lengths in ids), then words and ids end to end.
PACKED = "unit long, keys binary, held binary, sizes binary, lengths binary, words binary, hashes binary, counts binary, ids binary"
SCORES = "key long, held boolean, n_tokens long, n_known long, base_score double, score double"


class WordIds:
    """Ids of words, each encoded once with a space before it while there is room to remember it."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[bytes, bytes] = {}
        (self.newline,) = self.encode("\n")

    def _new(self, words: list[bytes]) -> list[bytes]:
        """Line by line in one call; a word with white space of its own might join with a line's end."""
        texts = [w.decode() for w in words]
        if not texts:
            return []
        if any(len(t.split()) != 1 for t in texts):
            return [np.array(self.encode(" " + t), np.uint16).tobytes() for t in texts]
        ids = np.array(self.encode(" " + "\n ".join(texts) + "\n"), np.uint16)
        ends = np.flatnonzero(ids == self.newline).tolist()
        raw, starts = ids.tobytes(), [0, *(e + 1 for e in ends)]
        return [raw[2 * a : 2 * b] for a, b in zip(starts, ends, strict=False)]

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, ids per word)."""
        known = self.known
        new = [w for w in words if w not in known]
        odd = [w for w in new if not w.isascii() and len(w.decode().split()) != 1]
        plain = [w for w in new if w not in set(odd)] if odd else new
        met = dict(zip(odd, self._new(odd), strict=True)) | dict(zip(plain, self._new(plain), strict=True)) if new else {}
        out = [met.get(w) or known[w] for w in words]
        if len(known) < REMEMBERED:
            known.update(met)
        return np.frombuffer(b"".join(out), np.uint16), np.fromiter(map(len, out), np.int64, len(out)) // 2


@lru_cache(maxsize=1)
def word_ids(path: str, pattern: str) -> WordIds:
    """One for each worker process: its tasks share what it remembers."""
    return WordIds(path, pattern)


def keyed(docs: DataFrame) -> DataFrame:
    """(key, held, text): held marks the fold not learnt from."""
    fold = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % 5
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_KEY)).alias("key"), (fold == 1).alias("held"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def _staged(df: DataFrame, label: str) -> DataFrame:
    """Like common.staged, packed tighter: ids are most of what this operator writes."""
    import uuid

    spark = df.sparkSession
    release(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _pack(path: str, pattern: str):
    def run(rows: pa.Table) -> pa.Table:
        docs = sorted(zip(rows["key"].to_pylist(), rows["text"].to_pylist(), rows["held"].to_pylist(), strict=True))
        split = [t.encode().lower().split() for _, t, _ in docs]
        # Words are numbered in the order of their hashes, which every answer to the unit follows.
        met = list(dict.fromkeys(chain.from_iterable(split)))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, met), np.uint64, len(met))
        order = np.argsort(hashes, kind="stable")
        hashes, number = hashes[order], {met[i]: n for n, i in enumerate(order.tolist())}
        size = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(size.sum()))
        held = np.array([h for _, _, h in docs], bool)
        learnt = np.bincount(words[np.repeat(~held, size)], minlength=len(number))
        ids, each = word_ids(path, pattern)(list(number))
        # The end comes after each document's words, as one more word.
        ids, each = np.append(ids, np.uint16(END)), np.append(each, 1)
        ends = (size + 1).cumsum() - 1
        flat = np.full(len(words) + len(docs), len(number), np.int64)
        inner = np.ones(len(flat), bool)
        inner[ends] = False
        flat[inner] = words
        n = each[flat]
        upto = n.cumsum()
        text_ids = ids[np.repeat((each.cumsum() - each)[flat] - (upto - n), n) + np.arange(int(upto[-1]))]
        lengths = np.diff(np.r_[0, upto[ends]])
        small = np.uint16 if len(number) < 1 << 16 else np.uint32
        out = (np.array([k for k, _, _ in docs], np.int64), held, size, lengths, words.astype(small), hashes, learnt.astype(np.uint32), text_ids.astype(np.uint16))
        names = PACKED.replace(" long", "").replace(" binary", "").split(", ")
        return pa.table([rows["unit"].slice(0, 1), *(pa.array([x.tobytes()], pa.binary()) for x in out)], names)

    return run


def packed(docs: DataFrame, tokenizer_path: str, pattern: str, unit_bytes: int) -> DataFrame:
    texts = keyed(docs)
    units = parts(text_bytes(docs), unit_bytes)
    dealt = texts.withColumn("unit", F.pmod(F.xxhash64("key", "text"), F.lit(units)))
    return _staged(dealt.groupBy("unit").applyInArrow(_pack(tokenizer_path, pattern), PACKED), "lm-units")


def _array(cell, kind) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _gather_counts(batches):
    """(before, id, n) of a partition's training documents."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for rows in batches:
        for ids, lengths, held in zip(rows["ids"], rows["lengths"], rows["held"], strict=True):
            size = _array(lengths, np.int64)
            ids = _array(ids, np.uint16).astype(np.int64)
            before = np.r_[END, ids[:-1]]
            before[size.cumsum() - size] = END
            new, n = np.unique((before * IDS + ids)[np.repeat(~_array(held, bool), size)], return_counts=True)
            keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
    for at in range(0, len(keys), 1 << 18):
        k = keys[at : at + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(k // IDS, pa.int32()), pa.array(k % IDS, pa.int32()), pa.array(counts[at : at + len(k)])], ["before", "id", "n"])


def training_windows(ids: np.ndarray, lengths: np.ndarray, learn: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """WINDOW + 1 ids from every WINDOW-th place of each document to learn from, -1 past its end; those of this round.

    A window predicts all its ids but the first, so every id of a document is predicted once over all
    rounds.
    """
    starts = lengths.cumsum() - lengths
    n = np.where(learn, -(-lengths // WINDOW), 0)
    number = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
    mine = (np.repeat(np.arange(len(n)), n) + number) % rounds == turn
    # Places count from the end id that stands before each document.
    at = (number * WINDOW)[mine, None] + np.arange(WINDOW + 1)
    out = ids[np.clip(np.repeat(starts, n)[mine, None] + at - 1, 0, len(ids) - 1)].astype(np.int32)
    out[at == 0] = END
    out[at > np.repeat(lengths, n)[mine, None]] = -1
    return out


def classes(counts: np.ndarray, own: int, shared: int) -> np.ndarray:
    """Class of each id: the most frequent ones alone, the rest in groups of like total counts."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    out = np.empty(len(counts), np.int64)
    out[order[:own]] = np.arange(own)
    rest = order[own:]
    mass = (counts[rest] + 0.5).cumsum()
    out[rest] = own + np.minimum(shared - 1, (mass * shared / mass[-1]).astype(np.int64))
    return out


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w as one product: numpy would do one for each window."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[1])


class Attention:
    """One layer: x = E[class]; h = x + softmax(x Wq (x Wk)' + R[distance]) x Wv Wo; logits = h U + b."""

    NAMES = ("E", "Q", "K", "V", "O", "U", "b", "R")

    def __init__(self, weights: dict[str, np.ndarray]):
        """All weights stand in one vector; w holds views of it by name."""
        self.all = np.concatenate([weights[k].ravel() for k in self.NAMES]).astype(np.float32)
        at, self.w = 0, {}
        for k in self.NAMES:
            self.w[k] = self.all[at : at + weights[k].size].reshape(weights[k].shape)
            at += weights[k].size

    @classmethod
    def fresh(cls, seed: int = 11) -> Attention:
        rng = np.random.default_rng(seed)
        n = lambda *s: rng.normal(0, 1 / math.sqrt(s[0]), s)
        return cls({"E": rng.normal(0, 0.3, (sum(INPUT), WIDTH)), "Q": n(WIDTH, WIDTH), "K": n(WIDTH, WIDTH), "V": n(WIDTH, WIDTH), "O": n(WIDTH, WIDTH) * 0.5, "U": n(WIDTH, sum(OUTPUT)), "b": np.zeros(sum(OUTPUT)), "R": np.zeros(WINDOW)})

    def attend(self, x: np.ndarray, first: int, there: np.ndarray):
        """Hidden states of places first.. of each window; there: which places hold an id.

        Attention weights come unscaled with their sums, so that the division is done on what they mix.
        """
        w = self.w
        q, k, v = _times(x[:, first:], w["Q"] / np.float32(math.sqrt(WIDTH))), _times(x, w["K"]), _times(x, w["V"])
        place, other = np.arange(first, x.shape[1])[:, None], np.arange(x.shape[1])[None, :]
        distance = place - other
        bias = np.where(distance >= 0, w["R"][np.maximum(distance, 0)], -1e9).astype(x.dtype)
        s = q @ k.transpose(0, 2, 1)
        s += bias
        if s.max(initial=0) > 60:
            s -= s.max(2, keepdims=True)
        a = np.exp(s, out=s)
        # Places after the last id are out of reach of any scored one; those before the first are not.
        part = np.flatnonzero(~there[:, : max(1, first)].all(1)) if first else np.flatnonzero(~there.all(1))
        if len(part):
            a[part] *= there[part][:, None, :]
        total = np.maximum(a.sum(2, keepdims=True), np.float32(1e-30))
        mixed = (a @ v) / total
        return x[:, first:] + _times(mixed, w["O"]), (a, total), q, k, v, mixed, distance

    def logits(self, h: np.ndarray) -> np.ndarray:
        return _times(h, self.w["U"]) + self.w["b"]

    def gradient(self, x_class: np.ndarray, y_class: np.ndarray, there: np.ndarray, scored: np.ndarray):
        w = self.w
        x = w["E"][x_class]
        h, (a, total), q, k, v, mixed, distance = self.attend(x, 0, there)
        a /= total
        z = self.logits(h)
        if z.max() > 60:
            z -= z.max(2, keepdims=True)
        p = np.exp(z, out=z).reshape(-1, z.shape[-1])
        weight = (scored / max(1, scored.sum())).astype(np.float32).ravel()
        p *= (weight / (p @ np.ones(p.shape[1], np.float32)))[:, None]
        p[np.arange(len(p)), y_class.ravel()] -= weight
        p = p.reshape(z.shape)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        g = {"U": flat(h).T @ flat(p), "b": flat(p).sum(0)}
        dh = _times(p, w["U"].T)
        dm = _times(dh, w["O"].T)
        g["O"] = flat(mixed).T @ flat(dh)
        da = dm @ v.transpose(0, 2, 1)
        dv = a.transpose(0, 2, 1) @ dm
        da -= (dm * mixed).sum(2, keepdims=True)  # the rows' sums of a times da
        ds = np.multiply(a, da, out=da)
        g["R"] = np.bincount(np.maximum(distance, 0).ravel(), weights=np.where(distance >= 0, ds.sum(0), 0).ravel(), minlength=WINDOW)[:WINDOW]
        dq, dk = ds @ k / np.float32(math.sqrt(WIDTH)), ds.transpose(0, 2, 1) @ q
        dx = dh + _times(dq, w["Q"].T) + _times(dk, w["K"].T) + _times(dv, w["V"].T)
        for name, d in (("Q", dq), ("K", dk), ("V", dv)):
            g[name] = flat(x).T @ flat(d)
        hot = x_class.ravel()
        g["E"] = np.stack([np.bincount(hot, weights=flat(dx)[:, c], minlength=sum(INPUT)) for c in range(WIDTH)], 1)
        return g

    def train(self, windows: np.ndarray, cin: np.ndarray, cout: np.ndarray, rate: float, batch: int = 64) -> None:
        """Adam steps over the windows, once each; -1 fills up short ones."""
        m, s = np.zeros_like(self.all), np.zeros_like(self.all)
        for step, at in enumerate(range(0, len(windows), batch), 1):
            ids = windows[at : at + batch]
            there, scored = ids[:, :-1] >= 0, ids[:, 1:] >= 0
            by_name = self.gradient(cin[np.maximum(ids[:, :-1], 0)], cout[np.maximum(ids[:, 1:], 0)], there, scored)
            g = np.concatenate([by_name[k].ravel() for k in self.NAMES]).astype(np.float32)
            m += np.float32(0.1) * (g - m)
            s += np.float32(0.01) * (g * g - s)
            self.all -= np.float32(rate / (1 - 0.9**step)) * m / (np.sqrt(s * np.float32(1 / (1 - 0.99**step))) + np.float32(1e-8))

    def flat(self) -> np.ndarray:
        return self.all.astype(np.float64)

    def unpacked(self, flat: np.ndarray) -> Attention:
        out, at = {}, 0
        for k in self.NAMES:
            n = self.w[k].size
            out[k] = flat[at : at + n].reshape(self.w[k].shape)
            at += n
        return Attention(out)


def log_probabilities(model: Attention, cin, cout, table, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Natural log probability of every id, documents end to end; each id scored once."""
    size = np.diff(np.r_[starts, len(ids)])
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[starts] = END
    seen = cin[before]
    step = WINDOW - OVERLAP
    n = -(-size // step)
    window = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
    low, end = np.repeat(starts, n), np.repeat(starts + size, n)
    out, ones = np.zeros(len(ids)), np.ones(sum(OUTPUT), np.float32)
    for at in range(0, len(window), BLOCK):
        a, lo, hi = window[at : at + BLOCK], low[at : at + BLOCK], end[at : at + BLOCK]
        place = (lo + a * step - OVERLAP)[:, None] + np.arange(WINDOW)
        there = (place >= lo[:, None]) & (place < hi[:, None])
        place = np.clip(place, 0, len(ids) - 1)
        h = model.attend(model.w["E"][seen[place]], OVERLAP, there)[0]
        where, ok = place[:, OVERLAP:], there[:, OVERLAP:]
        if not ok.all():
            h, where = h[ok], where[ok]
        z = model.logits(h.reshape(-1, WIDTH))
        if z.max() > 60:
            z -= z.max(1, keepdims=True)
        where = where.ravel()
        y = ids[where]
        mine = z[np.arange(len(y)), cout[y]]
        out[where] = mine - np.log(np.exp(z, out=z) @ ones) + table[seen[where], y]
    return out


def fit(units: DataFrame, rounds: int = 3, rate: float = 0.02):
    """(model, input classes, output classes, log P(id | class, class before)) from the training fold."""
    spark = units.sparkSession
    given_ids = units.select("ids", "lengths", "held")
    counted = _staged(given_ids.mapInArrow(_gather_counts, "before int, id int, n long"), "lm-counts")
    counts = np.zeros(IDS)
    for r in counted.groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most IDS rows
        counts[r["id"]] = r["n"]
    cin, cout = classes(counts, *INPUT), classes(counts, *OUTPUT)
    n_in, n_out = sum(INPUT), sum(OUTPUT)
    names = F.broadcast(spark.createDataFrame([(i, int(c)) for i, c in enumerate(cin)], "before int, class int"))  # IDS rows
    given = counted.join(names, "before").groupBy("class", "id").agg(F.sum("n").alias("n")).toArrow()  # classes x IDS rows at most
    pair = np.zeros((n_in, IDS), np.float32)
    pair[given["class"].to_numpy(), given["id"].to_numpy()] = given["n"].to_numpy()
    size = np.bincount(cout, minlength=n_out)
    plain = (counts + 0.5) / (np.bincount(cout, weights=counts, minlength=n_out) + 0.5 * size)[cout]
    for row in range(n_in):
        total = np.bincount(cout, weights=pair[row], minlength=n_out)
        pair[row] = np.log((pair[row] + PRIOR * plain) / (total + PRIOR)[cout])
    model = Attention.fresh()
    for k in range(rounds):

        def local(batches, model=model, rate=rate / (1 + k), turn=k):
            seen, total = 0, 0.0
            for rows in batches:
                for ids, lengths, held in zip(rows["ids"], rows["lengths"], rows["held"], strict=True):
                    windows = training_windows(_array(ids, np.uint16), _array(lengths, np.int64), ~_array(held, bool), turn, rounds)
                    if len(windows):
                        own = Attention(model.w)
                        own.train(windows, cin, cout, rate)
                        seen += len(windows)
                        total = total + len(windows) * np.rint(own.flat() / GRAIN)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "weights"])

        got = given_ids.mapInArrow(local, "n long, weights binary").withColumn("slot", F.pmod(F.xxhash64("weights"), F.lit(1024)))
        sums = got.groupBy("slot").applyInArrow(_added, "n long, weights binary").collect()  # 1,024 rows of 42 kB at most
        if sums:
            total = sum(np.frombuffer(r["weights"], "<f8") for r in sums)
            model = model.unpacked((total / sum(r["n"] for r in sums) * GRAIN).astype(np.float32))
    return model, cin, cout, pair


def _added(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(w, "<f8") for w in rows["weights"].to_pylist())
    return pa.table({"n": pa.array([int(rows["n"].to_numpy().sum())], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})


def _send(shards: int):
    """A unit's hashes and training counts, cut into ranges of the hash space: 12 bytes a word."""

    def send(batches):
        for rows in batches:
            out = []
            for unit, hashes, counts in zip(rows["unit"].to_pylist(), rows["hashes"], rows["counts"], strict=True):
                h, n = _array(hashes, np.uint64), _array(counts, np.uint32)
                shard = (h >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)
                edge = np.flatnonzero(np.diff(shard.astype(np.int64), prepend=-1, append=-1)).tolist()
                out += [(int(shard[x]), unit, h[x:y].tobytes() + n[x:y].tobytes()) for x, y in zip(edge[:-1], edge[1:], strict=True)]
            shard, unit, data = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(unit, pa.int64()), pa.array(data, pa.binary())], ["shard", "unit", "data"])

    return send


def _tally(rows: pa.Table) -> pa.Table:
    """To each unit the corpus counts of the hashes it sent, in their order, and for unit -1 the words and their total."""
    sent = [np.frombuffer(d, np.uint64, len(d) // 12) for d in rows["data"].to_pylist()]
    counts = [np.frombuffer(d, np.uint32, len(d) // 12, len(d) // 12 * 8) for d in rows["data"].to_pylist()]
    h, where = np.unique(np.concatenate(sent), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(counts).astype(np.float64), minlength=len(h)).astype(np.int64)
    found, at = [], 0
    for x in sent:
        c = total[where[at : at + len(x)]]
        small = c.max() < 1 << 32
        found.append((b"\4" if small else b"\10") + c.astype(np.uint32 if small else np.uint64).tobytes())
        at += len(x)
    found.append(np.array([(total > 0).sum(), total.sum()], np.int64).tobytes())
    shard = rows["shard"].to_pylist()
    return pa.table({"unit": pa.array([*rows["unit"].to_pylist(), -1], pa.int64()), "shard": pa.array([*shard, shard[0]], pa.int32()), "told": pa.array(found, pa.binary())})


def _counts(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, np.uint32 if cell[0] == 4 else np.uint64, offset=1).astype(np.int64)


def _model_scores(model, cin, cout, table):
    """Per unit the model's log10 probabilities of its documents."""

    def run(batches):
        for rows in batches:
            out = []
            for ids, lengths in zip(rows["ids"], rows["lengths"], strict=True):
                size = _array(lengths, np.int64)
                starts = size.cumsum() - size
                logs = log_probabilities(model, cin, cout, table, _array(ids, np.uint16).astype(np.int64), starts)
                out.append((np.add.reduceat(logs, starts) / math.log(10)).tobytes())
            yield pa.RecordBatch.from_arrays([rows["unit"], pa.array(out, pa.binary())], ["unit", "told"])

    return run


def _finish(n_train: int, v: int, n_ends: int):
    """Documents of a unit with both scores; what it was told is counts by ranges of the hash space, and one row of model scores."""
    scale = math.log10(n_train + 0.5 * (v + 1))

    def run(unit: pa.Table, told: pa.Table) -> pa.Table:
        if not len(unit):
            return pa.table({n: pa.array([], t) for n, t in zip(SCORES.replace(",", "").split()[::2], (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        cell = lambda name, kind: _array(unit[name][0], kind)
        by_shard = sorted(zip(told["shard"].to_pylist(), told["told"].to_pylist(), strict=True))
        score = np.frombuffer(by_shard[0][1], np.float64)  # the model's row stands under shard -1
        c = np.concatenate([np.zeros(0, np.int64), *(_counts(x) for _, x in by_shard[1:])])
        size, words = cell("sizes", np.int64), cell("words", np.uint16 if len(c) < 1 << 16 else np.uint32)
        doc = np.repeat(np.arange(len(size)), size)
        known = np.bincount(doc, weights=(c > 0)[words], minlength=len(size)).astype(np.int64) + (n_ends > 0)
        base = np.bincount(doc, weights=np.log10(c + 0.5)[words], minlength=len(size)) + math.log10(n_ends + 0.5) - (size + 1) * scale
        return pa.table({"key": cell("keys", np.int64), "held": pa.array(cell("held", bool)), "n_tokens": size + 1, "n_known": known, "base_score": base, "score": score})

    return run


def score(docs: DataFrame, tokenizer_path: str, pattern: str, rounds: int = 3, unit_bytes: int = 4 << 20, shard_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: base and model scores of its whole text."""
    units = packed(docs, tokenizer_path, pattern, unit_bytes)
    sent = units.select("unit", "hashes", "counts").mapInArrow(_send(parts(text_bytes(docs), shard_bytes)), "shard int, unit long, data binary")
    told = _staged(sent.groupBy("shard").applyInArrow(_tally, "unit long, shard int, told binary"), "lm-words")
    sums = told.where("unit = -1").mapInArrow(_totals, "v long, n long").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    ends = keyed(docs).where("not held").count()
    n_train, v = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    by_model = _staged(units.select("unit", "ids", "lengths").mapInArrow(_model_scores(*fit(units, rounds)), "unit long, told binary"), "lm-scores")
    both = told.where("unit >= 0").unionByName(by_model.withColumn("shard", F.lit(-1)))
    words = units.select("unit", "keys", "held", "sizes", "words")
    done = words.groupBy("unit").cogroup(both.groupBy("unit")).applyInArrow(_finish(n_train, v, ends), SCORES)
    return done.select(doc_id_of(F.col("key")).alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def _totals(batches):
    for rows in batches:
        each = np.frombuffer(b"".join(rows["told"].to_pylist()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(each[:, 0]), pa.array(each[:, 1])], ["v", "n"])
