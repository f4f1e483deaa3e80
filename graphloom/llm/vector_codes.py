"""Vector code compression: product codes learned by Lloyd rounds on kd-trees (the filtering method).

Components become whole numbers and each vector is cut into `parts` equal pieces with a codebook each.
Every task packs its vectors into blocks and builds one balanced kd-tree a block and part: cells are cut
at the median of their widest side, and each keeps its bounding box, sum and count.  The blocks are
written once to the shared folder; every round reads them and walks all cells of a level at once.  An
entry is dropped from a cell if its distance exceeds that of the entry nearest to the cell's middle
at the corner of the box that favours it most (or equals it, with a higher index); a cell with one entry
left is assigned whole from its cached sum and count, and only points in the leaves left over are
compared one by one.  All of this is exact in whole numbers, so the result does not depend on blocks.

A round moves parts x entries sums a task; the codebooks (parts x entries x side numbers) are all that
the driver holds.  Blocks have at most `BLOCK` vectors, whatever the table.

Nulls: vectors that are null or hold null or non-finite components are dropped; so are vectors whose
length differs from that of the first kept one (least vec_id whose length is a positive multiple of
`parts`).  A null vec_id sorts after all others and comes out null; equal ids start the codebooks in the
order of their components.  With fewer vectors than entries the codebooks are shorter.  Components
beyond +-2**26 after scaling count as that bound, which keeps all sums of squares in 64 bits.  Repeated rows are
kept, each with its code; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_KEY, doc_id_of, sliced, staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK, LEAF = 4096, 16
BOUND = 1 << 26
SMALL_LABELS = 100_000


def whole_vectors(rows: DataFrame, scale: int, parts: int) -> tuple[DataFrame, int]:
    """((key, label, v) of the kept vectors as whole numbers, their length)."""
    x = rows["embedding"]
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    inside = lambda c: F.least(F.lit(float(BOUND)), F.greatest(F.lit(-float(BOUND)), F.floor(c.cast("double") * scale).cast("double"))).cast("int")
    kept = rows.where(x.isNotNull() & ~odd & (F.size(x) > 0)).select(F.coalesce(rows["vec_id"].cast("long"), F.lit(NULL_KEY)).alias("key"), rows["label"], F.transform(x, inside).alias("v"))
    first = kept.where(F.size("v") % parts == 0).orderBy("key", "v").select(F.size("v").alias("n")).first()
    length = first["n"] if first else 0
    return kept.where(F.size("v") == length), length


# One block ------------------------------------------------------------------------------------------


def levels_of(n: int) -> int:
    """Levels of cells below the root, so that leaves hold LEAF points or a few more and none is empty."""
    return max(0, int(np.log2(max(1, n / LEAF))))


def bounds(n: int, level: int) -> np.ndarray:
    return (np.arange((1 << level) + 1) * n) >> level


def grow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, boxes, sums): points in cell order; low and high sides and sums of all cells, level by level."""
    n, order, boxes, sums = len(points), np.arange(len(points)), [], []
    for level in range(levels_of(n) + 1):
        cut = bounds(n, level)
        p = points[order]
        low, high = np.minimum.reduceat(p, cut[:-1]), np.maximum.reduceat(p, cut[:-1])
        boxes.append(np.stack([low, high], 1))
        sums.append(np.add.reduceat(p.astype(np.int64), cut[:-1]))
        if level < levels_of(n):
            cell = np.repeat(np.arange(1 << level), np.diff(cut))
            widest = (high - low).argmax(1)
            order = order[np.lexsort((p[np.arange(n), widest[cell]], cell))]
    return order, np.concatenate(boxes), np.concatenate(sums)


def squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all points and entries less the point's own square; exact."""
    high = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if high < 1 << 22 else np.int64  # products of whole numbers stay exact below 2 ** 53
    p, b = points.astype(kind), book.astype(kind)
    return (b * b).sum(1) - 2 * (p @ b.T)


def filtered(book: np.ndarray, n: int, boxes: np.ndarray):
    """Walk the cells: yields (level, cells, entry of each) for whole cells, at the end (level, cells, None) to compare."""
    own, square = np.arange(len(book)), (book * book).sum(1)
    cells, left = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    deepest = levels_of(n)
    for level in range(deepest + 1):
        box = boxes[(1 << level) - 1 + cells].astype(np.int64)
        low, high = box[:, 0, None], box[:, 1, None]
        middle = ((2 * book - (low + high)) ** 2).sum(2)
        middle[~left] = np.iinfo(np.int64).max
        best = middle.argmin(1)
        away = book[None] - book[best][:, None]
        gap = square - square[best][:, None] - 2 * (np.where(away > 0, high, low) * away).sum(2)
        left &= ~((gap > 0) | ((gap == 0) & (own > best[:, None])))
        alone = left.sum(1) == 1
        yield level, cells[alone], left[alone].argmax(1)
        cells, left = cells[~alone], left[~alone]
        if level == deepest or not len(cells):
            yield level, cells, None
            return
        cells, left = np.stack([2 * cells, 2 * cells + 1], 1).ravel(), np.repeat(left, 2, 0)


def places(cut: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Positions in cell order of all points of the cells."""
    size = (cut[1:] - cut[:-1])[cells]
    return np.repeat(cut[cells] - (size.cumsum() - size), size) + np.arange(size.sum())


def tally(points, order, boxes, sums, book) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) of the points by nearest entry."""
    n, total = len(points), np.zeros_like(book)
    count = np.zeros(len(book), np.int64)
    for level, cells, entry in filtered(book, n, boxes):
        cut = bounds(n, level)
        if entry is not None:
            np.add.at(count, entry, (cut[1:] - cut[:-1])[cells])
            np.add.at(total, entry, sums[(1 << level) - 1 + cells])
        elif len(cells):
            p = points[order[places(cut, cells)]]
            nearest = squares(p, book).argmin(1)
            np.add.at(count, nearest, 1)
            np.add.at(total, nearest, p)
    return count, total


def nearest(points, order, boxes, book) -> np.ndarray:
    """The entry of each point."""
    n, out = len(points), np.zeros(len(points), np.int64)
    for level, cells, entry in filtered(book, n, boxes):
        cut = bounds(n, level)
        at = order[places(cut, cells)]
        out[at] = squares(points[at], book).argmin(1) if entry is None else np.repeat(entry, (cut[1:] - cut[:-1])[cells])
    return out


# Spark ----------------------------------------------------------------------------------------------


def _trees(parts: int):
    """Arrow batches of (key, label, v) to blocks: the rows' columns and, by part, order, boxes and sums."""

    def blocks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                v = np.asarray(rows["v"].flatten()).reshape(rows.num_rows, -1)
                trees = [grow(p) for p in np.split(v, parts, 1)]
                raw = [[v.astype("<i4").tobytes()], *([b"".join(x.astype(t).tobytes() for x in column)] for column, t in zip(zip(*trees, strict=True), ("<u2", "<i4", "<i8"), strict=True))]
                one = pa.array([0, rows.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(one, rows[c]) for c in ("key", "label")]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array(x, pa.binary()) for x in raw)], ["keys", "labels", "v", "orders", "boxes", "sums"])

    return blocks


def _opened(block: dict, parts: int):
    """(n, points, order, boxes, sums) by part."""
    orders = np.frombuffer(block["orders"], "<u2").reshape(parts, -1)
    n = orders.shape[1]
    points = np.split(np.frombuffer(block["v"], "<i4").reshape(n, -1).astype(np.int64), parts, 1)
    side = points[0].shape[1]
    return zip(points, orders.astype(np.int64), np.frombuffer(block["boxes"], "<i4").reshape(parts, -1, 2, side), np.frombuffer(block["sums"], "<i8").reshape(parts, -1, side), strict=True)


def _each(batches, columns):
    for batch in batches:
        for rows in sliced(batch.select(columns), 8 << 20):
            for i in range(rows.num_rows):
                yield rows.slice(i, 1)


def _tallies(books: list[np.ndarray]):
    def run(batches):
        count, total = np.zeros((len(books), len(books[0])), np.int64), np.zeros((len(books), *books[0].shape), np.int64)
        for row in _each(batches, ["v", "orders", "boxes", "sums"]):
            for part, one in enumerate(_opened(row.to_pylist()[0], len(books))):
                c, t = tally(*one, books[part])
                count[part] += c
                total[part] += t
        part, entry, place = (x.ravel() for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, entry, place, total.ravel(), np.broadcast_to(count[..., None], total.shape).ravel())], ["part", "entry", "place", "total", "n"])

    return run


def _codes(books: list[np.ndarray]):
    def run(batches):
        for row in _each(batches, ["keys", "labels", "v", "orders", "boxes", "sums"]):
            block = row.select(["v", "orders", "boxes", "sums"]).to_pylist()[0]
            codes, error = [], 0
            for part, (points, order, boxes, _) in enumerate(_opened(block, len(books))):
                at = nearest(points, order, boxes, books[part])
                codes.append(at)
                error = error + ((points - books[part][at]) ** 2).sum(1)
            text = ["".join(f"{c:02x}" for c in code) for code in np.stack(codes, 1).tolist()]
            yield pa.RecordBatch.from_arrays([row["keys"].flatten(), row["labels"].flatten(), pa.array(text), pa.array(error)], ["key", "label", "code", "error"])

    return run


def learn(blocks: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """Lloyd rounds over the stored trees; entries that no part is nearest to stay."""
    for _ in range(rounds):
        moved = blocks.mapInArrow(_tallies(books), "part long, entry long, place long, total long, n long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        new = [b.copy() for b in books]
        for r in moved.where("n > 0").collect():  # one row a number of the codebooks
            new[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
        books = new
    return books


def digest_of(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """((key, label, code, error) of every kept vector, the codebooks by part)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    kept, length = whole_vectors(vectors, scale, parts)
    label = vectors.schema["label"].dataType
    starts = [r["v"] for r in kept.orderBy("key", "v").limit(entries).collect()] if length else []
    out = f"key long, label {label.simpleString()}, code string, error long"
    if not starts:
        return vectors.sparkSession.createDataFrame([], out), []
    books = np.split(np.array(starts, np.int64), parts, 1)
    columns = f"keys array<long>, labels array<{label.simpleString()}>, v binary, orders binary, boxes binary, sums binary"
    blocks = staged(kept.mapInArrow(_trees(parts), columns), "kd-trees")
    books = learn(blocks, books, rounds)
    return staged(blocks.mapInArrow(_codes(books), out), "codes"), books


def with_label_errors(coded: DataFrame, small: int = SMALL_LABELS) -> DataFrame:
    """coded with the error summed over rows of equal label, nulls together."""
    by_label = coded.groupBy(F.col("label").alias("its")).agg(F.sum("error").alias("label_error"))
    if by_label.limit(small + 1).count() <= small:
        by_label = F.broadcast(by_label)
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("its"))).drop("its")


def report(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector."""
    coded, books = compress(vectors)
    return with_label_errors(coded).select(doc_id_of(F.col("key")).alias("vec_id"), "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))
