"""Vector code compression: a codebook for each part of the vectors, improved in rounds, with exact integer distances pruned by LAESA pivots.

Components become integers, floor(1024 * c); vectors are cut into equal consecutive parts. Each part position has a few pivots, entries of its
first codebook that lie far apart and stay fixed. The distances of every part to its pivots are computed once and written with the vectors.
In each round the distances of the pivots to the entries, a small table, give for each part and entry the greatest difference of two
distances to one pivot, which the distance can't be below: entries are tried in the order of that bound, and those whose bound is over the
best exact distance are not tried at all. Bounds are in double precision with a margin for rounding; distances and sums are integers, so the result is
that of trying all entries, with ties to the lower index.

A round reads the written vectors once, without a shuffle of them: a task adds up its parts by entry, and what is shuffled and brought to the
driver has the size of the codebooks, whatever the table's. Codebooks go to the tasks with the code of the round; their size is fixed too.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do those of another length than most (the
least such length of several). A length that the number of parts doesn't divide is filled up with zeros. First entries come from the smallest ids, nulls last,
equal ids in the order of their vectors. With fewer vectors than entries the codebooks are as small as that. Components of any size are exact; an
error beyond 64 bits is null, and a sum over a label with it. Rows without a label are one label. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.jobs import numbered, refuse_columns, widened, with_totals, written
from tilewright.llm.vectors import NARROW, common_length, from_limbs, limbs, matrix, on_grid, whole

PARTS, ENTRIES, ROUNDS, PIVOTS = 4, 256, 4, 8
BLOCK = 1024
#: How many entries are tried between two looks at what is still open.
STEP = 4
LONG = (1 << 63) - 1


def _narrow(*arrays: np.ndarray) -> bool:
    return all(a.dtype != object and (not a.size or (a.max() < NARROW and a.min() > -NARROW)) for a in arrays)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    if not _narrow(a, b):
        a, b = a.astype(object), b.astype(object)
    step = a - b
    return (step * step).sum(-1)


def parts_of(grid: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width), filled up with zeros."""
    rows, d = grid.shape
    width = -(-d // parts)
    if width * parts != d:
        grid = np.concatenate([grid, np.zeros((rows, width * parts - d), grid.dtype)], 1)
    return grid.reshape(rows, parts, width)


def choose_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """Entries that lie far apart: each next one is the farthest from those before. (parts, pivots, width)."""
    out = []
    for book in entries:
        chosen = [0]
        apart = squared(book, book[0]).astype(float)
        while len(chosen) < min(count, len(book)):
            chosen.append(int(np.argmax(apart)))
            apart = np.minimum(apart, squared(book, book[chosen[-1]]).astype(float))
        out.append(book[chosen])
    return np.stack(out)


def pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(points, pivots) distances of points to the pivots of one part position."""
    return np.sqrt(np.stack([squared(points, p).astype(float) for p in pivots], 1)) if len(points) else np.zeros((0, len(pivots)))


def nearest(points: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, book_to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each point, ties to the lower index, its exact squared distance, and how many distances were computed."""
    rows, tried = len(points), 0
    exact = points.dtype if _narrow(points, book) else object
    best = np.full(rows, -1, exact)
    who = np.zeros(rows, np.int64)
    bound = np.zeros((rows, len(book)))
    for p in range(to_pivots.shape[1]):
        a, b = to_pivots[:, p, None], book_to_pivots[None, :, p]
        np.maximum(bound, np.abs(a - b) - 1e-12 * (a + b), out=bound)
    order = np.argsort(bound, 1, kind="stable")
    bound = np.take_along_axis(bound, order, 1)
    bound *= bound
    open_rows = np.arange(rows)
    for at in range(0, len(book), STEP):
        if at:
            limit = best[open_rows].astype(float) * (1 + 1e-12)
            open_rows = open_rows[bound[open_rows, at] <= limit]
            if not len(open_rows):
                break
        for j in range(at, min(at + STEP, len(book))):
            candidate = order[open_rows, j]
            apart = squared(points[open_rows], book[candidate])
            tried += len(open_rows)
            held = best[open_rows]
            better = (held < 0) | (apart < held) | ((apart == held) & (candidate < who[open_rows]))
            won = open_rows[better]
            best[won], who[won] = apart[better], candidate[better]
    return who, best, tried


class Codebooks:
    """The entries (parts, entries, width) and the fixed pivots with their distances to the entries."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries, self.pivots = entries, pivots
        self.to_pivots = [pivot_distances(book, own) for book, own in zip(entries, pivots, strict=True)]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, parts: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(rows, parts) indexes, and for each part the exact squared distances."""
        codes, errors = np.zeros(parts.shape[:2], np.int64), []
        for p in range(parts.shape[1]):
            codes[:, p], error, _ = nearest(parts[:, p], to_pivots[:, p], self.entries[p], self.to_pivots[p])
            errors.append(error)
        return codes, errors


def _compact(entries: np.ndarray) -> np.ndarray:
    """int64 where that is enough."""
    return entries.astype(np.int64) if not entries.size or max(map(abs, entries.ravel().tolist())) < NARROW else entries.astype(object)


def _blocks(batches: Iterator[pa.RecordBatch], d: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            block = batch.slice(at, BLOCK)
            yield block, parts_of(on_grid(matrix(block.column("vector"), d)), parts)


def _held(block: pa.RecordBatch, parts: int) -> np.ndarray:
    flat = block.column("to_pivots").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(block.num_rows, parts, -1)


def fit(kept: DataFrame, first: np.ndarray, d: int, parts: int = PARTS, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[Codebooks, DataFrame]:
    """The codebooks after all rounds, and the written vectors with their distances to the pivots."""
    books = Codebooks(first, choose_pivots(first, pivots))
    fixed = books.pivots

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, cut in _blocks(batches, d, parts):
            far = np.stack([pivot_distances(cut[:, p], fixed[p]) for p in range(parts)], 1)
            flat = far.reshape(len(cut), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*block.columns, lists], [*block.schema.names, "to_pivots"])

    table = written(kept.mapInArrow(measure, widened(kept, to_pivots="array<double>")))
    width = first.shape[2]
    columns = [f"s{j}" for j in range(width)]
    for _ in range(rounds):

        def add_up(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
            size = books.entries.shape[1]
            count, total = np.zeros(parts * size, np.int64), np.zeros((parts * size, width), object)
            for block, cut in _blocks(batches, d, parts):
                codes, _ = books.assign(cut, _held(block, parts))
                slot = (codes + np.arange(parts) * size).ravel()
                own = np.zeros((parts * size, width), cut.dtype)
                np.add.at(own, slot, cut.reshape(-1, width))
                count += np.bincount(slot, minlength=parts * size)
                used = np.unique(slot)
                total[used] += own[used].astype(object)
            used = np.flatnonzero(count)
            if len(used):
                for k, limb in enumerate(limbs(total[used])):
                    counted = count[used] if k == 0 else np.zeros(len(used), np.int64)
                    rows = [used, np.full(len(used), k), counted, *limb.T]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r), pa.int64()) for r in rows], ["slot", "limb", "n", *columns])

        schema = "slot long, limb long, n long, " + ", ".join(f"{c} long" for c in columns)
        sums = table.select("vector", "to_pivots").mapInArrow(add_up, schema).groupBy("slot", "limb").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns])
        entries = books.entries.astype(object).reshape(-1, width)
        counts: dict[int, int] = {}
        held: dict[tuple[int, int], dict[int, int]] = {}
        for row in sums.collect():  # as many rows as the codebooks have entries, by the limbs of a sum
            counts[row["slot"]] = counts.get(row["slot"], 0) + row["n"]
            for j, c in enumerate(columns):
                held.setdefault((row["slot"], j), {})[row["limb"]] = row[c]
        for (slot, j), found in held.items():
            entries[slot, j] = from_limbs(found) // counts[slot]
        books = Codebooks(_compact(entries.reshape(first.shape)), fixed)
    return books, table


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", keep: list[str] | None = None,
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS,
) -> tuple[DataFrame, Codebooks | None]:
    """The columns ``keep`` (id and label, if None), code, error, label_error and codebooks_sha256 of each vector that takes part; and the codebooks."""
    keep = [id_col, label_col] if keep is None else keep
    refuse_columns(df.select(*[F.col(f"`{c}`") for c in keep]), "code", "error", "label_error", "codebooks_sha256")
    narrow, names = numbered(df, keep, F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    there = narrow.filter(whole(F.col("vector")))
    d = common_length(there, "vector")
    there = there.filter(F.size("vector") == d)
    first_rows = there.orderBy(F.asc_nulls_last("id"), "vector").select("vector").limit(entries).collect() if d else []  # a codebook's size
    if not first_rows:
        empty = narrow.limit(0).select(*names, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return empty.toDF(*keep, "code", "error", "label_error", "codebooks_sha256"), None
    first = _compact(parts_of(on_grid(np.array([r["vector"] for r in first_rows], np.float64)), parts).transpose(1, 0, 2))
    books, table = fit(there.select(*names, "label", "vector"), first, d, parts, rounds, pivots)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(max(entries, 256))], object)
        for block, cut in _blocks(batches, d, parts):
            codes, errors = books.assign(cut, _held(block, parts))
            error = sum(e.astype(object) for e in errors)
            rest = [block.column(c) for c in [*names, "label"]]
            made = [pa.array(digits[codes].sum(1).tolist(), pa.string()), pa.array([e if e <= LONG else None for e in error.tolist()], pa.int64())]
            yield pa.RecordBatch.from_arrays([*rest, *made], [*names, "label", "code", "error"])

    coded = written(table.mapInArrow(encode, widened(table.select(*names, "label"), code="string", error="long")))
    totals = coded.groupBy("label").agg(F.when(F.count(F.when(F.col("error").isNull(), 1)) == 0, F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long").alias("label_error"))
    out = with_totals(coded, totals, "label").select(*names, "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
    return out.toDF(*keep, "code", "error", "label_error", "codebooks_sha256"), books
