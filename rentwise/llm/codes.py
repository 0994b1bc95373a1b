"""Vector codes: a codebook per part position, nearest entries found by an equal-average search.

Components become integers, a vector is cut into ``PARTS`` equal parts, and a part's
code is the index of the nearest entry of its position's codebook. The search keeps
the entries sorted by their component sums. Of d components with a sum gap of g the
squared distance is at least g * g / d, so it starts at the part's own sum, expands
outward to the nearer side, and ends when g * g / d strictly exceeds the best
distance (an equal bound may still hide an equal distance with a lower index). All
numbers are integers, so codes, sums and ties are exact.

A round sends the codebooks (``ENTRIES`` parts a position, a bounded table) to the tasks,
which return sums and counts per entry; only those meet in a shuffle. No round moves vectors.

Defined cases: rows whose vector is null, or holds null, NaN or infinite components,
are dropped. The dimension is that of the smallest kept vec_id; vectors of another
length have no code and no error (null). A dimension that is no multiple of ``PARTS`` is
padded with zeros. A null vec_id is the largest; rows that repeat a vec_id are coded
each, and for the first codebook they rank by their components. With fewer kept vectors than
``ENTRIES`` the codebooks have fewer entries. Components beyond 2**30 over a part's width are
computed in unbounded integers; an error, or a label's sum, beyond a long is null. Without kept rows the result is empty.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, source, staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
EXACT = 1 << 30  # a larger component times the width of a part could overflow 64-bit distances
LANES = 1 << 18  # parts searched at a time
LARGEST = 10 ** 38


def kept_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, vector (doubles) without the rows that have no whole finite vector."""
    rows = source(vectors, vec_id=key, vector=vector, label=label).withColumn("vector", F.col("vector").cast("array<double>"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vector").isNotNull() & ~bad)


def _integers(values: np.ndarray, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(SCALE))
    if scaled.size and np.abs(scaled).max() * width > EXACT:
        # the scale is a power of two, so the product is exact unless it overflows a double
        return np.array([SCALE * int(v) if abs(v) > 2.0 ** 60 else int(s) for v, s in zip(values.ravel(), scaled.ravel())],
                        object).reshape(values.shape)
    return scaled.astype(np.int64)


def part_matrix(flat: np.ndarray, dimension: int) -> np.ndarray:
    """(vectors, PARTS, width) integers of vectors laid end to end, padded with zeros."""
    width = -(-dimension // PARTS)
    rows = _integers(flat.reshape(-1, dimension), width)
    out = np.zeros((len(rows), PARTS * width), rows.dtype)
    out[:, :dimension] = rows
    return out.reshape(-1, PARTS, width)


class Codebooks:
    """The entries of all positions, (PARTS, entries, width), with their order by component sum."""

    def __init__(self, entries: np.ndarray):
        wide = entries.size and max(abs(int(entries.max())), abs(int(entries.min()))) * entries.shape[2] > EXACT
        self.entries = entries.astype(object if wide else np.int64)
        sums = self.entries.sum(axis=2)
        self.order = np.stack([np.argsort(s, kind="stable") for s in sums])
        self.sums = np.take_along_axis(sums, self.order, 1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of every part, (vectors, PARTS) each."""
        step = max(1, LANES // PARTS)
        found = [self._search(parts[i:i + step]) for i in range(0, len(parts), step)]
        if not found:
            return np.zeros((0, PARTS), np.int64), np.zeros((0, PARTS), np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _search(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, _, width = parts.shape
        size = self.entries.shape[1]
        kind = object if object in (parts.dtype, self.entries.dtype) else np.int64
        lanes = parts.reshape(n * PARTS, width)
        place = np.tile(np.arange(PARTS), n)
        own = lanes.sum(axis=1)
        right = np.empty(n * PARTS, np.int64)
        for p in range(PARTS):
            right[p::PARTS] = np.searchsorted(self.sums[p], own[p::PARTS])
        left = right - 1
        best = np.full(n * PARTS, -1, kind)  # -1: none yet
        code = np.full(n * PARTS, size, np.int64)
        live = np.arange(n * PARTS)
        while len(live):
            p, at_left, at_right, sums = place[live], left[live], right[live], own[live]
            low = sums - self.sums[p, np.maximum(at_left, 0)]
            high = self.sums[p, np.minimum(at_right, size - 1)] - sums
            go_left = (at_left >= 0) & ((at_right >= size) | (low <= high).astype(bool))
            gap = np.where(go_left, low, high)
            on = ((at_left >= 0) | (at_right < size)) & ((best[live] < 0) | (gap * gap <= best[live] * width)).astype(bool)
            live, p, go_left = live[on], p[on], go_left[on]
            entry = self.order[p, np.where(go_left, at_left[on], at_right[on])]
            apart = lanes[live] - self.entries[p, entry]
            far = (apart * apart).sum(axis=1)
            now = best[live]
            better = ((now < 0) | (far < now) | ((far == now) & (entry < code[live]))).astype(bool)
            best[live[better]], code[live[better]] = far[better], entry[better]
            left[live] -= go_left
            right[live] += ~go_left
        return code.reshape(n, PARTS), best.reshape(n, PARTS)

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


def first_codebooks(rows: DataFrame, dimension: int, entries: int = ENTRIES) -> Codebooks:
    """The parts of the vectors with the smallest ids: at most ``entries`` rows reach the driver."""
    fit = rows.where(F.size("vector") == dimension).orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries)
    chosen = [r.vector for r in fit.select("vector").collect()]
    parts = part_matrix(np.array(chosen, float).ravel(), dimension) if dimension else np.zeros((len(chosen), PARTS, 1), np.int64)
    return Codebooks(parts.transpose(1, 0, 2))


def _fitting(batch, column: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of the batch have the dimension, and their parts."""
    vectors = batch.column(column)
    fits = vectors.value_lengths().to_numpy(zero_copy_only=False) == dimension
    chosen = vectors.filter(pa.array(fits))
    flat = chosen.flatten().to_numpy(zero_copy_only=False)
    parts = part_matrix(flat, dimension) if dimension else np.zeros((int(fits.sum()), PARTS, 1), np.int64)
    return fits, parts


def updated(rows: DataFrame, books: Codebooks, dimension: int) -> Codebooks:
    """One round: every entry becomes the floor of its parts' mean, unused entries stay.

    A task returns at most one row per entry and component; their sums meet in a shuffle.
    """
    shape = books.entries.shape

    def run(batches):
        sums, counts = np.zeros(shape, object), np.zeros(shape[:2], np.int64)
        for batch in batches:
            _, parts = _fitting(batch, 0, dimension)
            if not len(parts):
                continue
            codes, _ = books.nearest(parts)
            for p in range(PARTS):
                order = np.argsort(codes[:, p], kind="stable")
                used, starts, n = np.unique(codes[order, p], return_index=True, return_counts=True)
                sums[p, used] += np.add.reduceat(parts[order, p], starts, axis=0).astype(object)
                counts[p, used] += n
        p, e = np.nonzero(counts)
        at = np.indices((len(p), shape[2]))
        p, e, n, total = p[at[0].ravel()], e[at[0].ravel()], counts[p, e][at[0].ravel()], sums[p, e].ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(at[1].ravel(), pa.int32()), pa.array(n, pa.int64()),
             pa.array([str(t) for t in total], pa.string())], ["part", "entry", "place", "n", "total"])

    sums = (rows.select("vector").mapInArrow(run, "part int, entry int, place int, n long, total string")
            .groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.expr("try_cast(total AS decimal(38,0))")).alias("total")))
    entries = books.entries.astype(object)
    for r in sums.collect():  # at most as many rows as the codebooks have components
        if r.total is not None:
            entries[r.part, r.entry, r.place] = int(r.total) // r.n
    return Codebooks(entries)


def encode(rows: DataFrame, books: Codebooks, dimension: int) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances, summed, a decimal) of every row."""
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        for batch in batches:
            fits, parts = _fitting(batch, 1, dimension)
            codes, errors = books.nearest(parts)
            code, error = np.full(len(fits), None, object), np.full(len(fits), None, object)
            code[fits] = ["".join(row) for row in digits[codes].tolist()]
            error[fits] = [Decimal(e) if e < LARGEST else None for e in errors.astype(object).sum(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.string()), pa.array(error, pa.decimal128(38))],
                                             ["keys", "code", "error"])

    keyed = rows.select(F.struct("vec_id", "label").alias("keys"), "vector")
    kinds = f"struct<vec_id:{rows.schema['vec_id'].dataType.simpleString()},label:{rows.schema['label'].dataType.simpleString()}>"
    return keyed.mapInArrow(run, f"keys {kinds}, code string, error decimal(38,0)").select("keys.vec_id", "keys.label", "code", "error")


def compress_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                     rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error (of its label) and codebooks_sha256."""
    rows = kept_vectors(vectors, key, vector, label)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select(F.size("vector").alias("d")).first()
    dimension = first.d if first else 0
    books = first_codebooks(rows, dimension)
    for _ in range(rounds if first else 0):
        books = updated(rows, books, dimension)
    coded = staged(encode(rows, books, dimension), "vector-codes")
    labels = coded.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("total"))
    return join_hot(coded, labels, "label").select(
        "vec_id", "code", F.expr("try_cast(error AS long)").alias("error"), F.expr("try_cast(total AS long)").alias("label_error"), F.lit(books.digest()).alias("codebooks_sha256"))
