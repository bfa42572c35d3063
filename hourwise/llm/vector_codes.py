"""Vectors compressed to one byte a part: codebooks refined over all vectors, nearest entries found through memoised cells.

Components become whole numbers, vectors are cut into parts, and each part has a codebook that starts with that part of the first
vectors and is refined by rounds of assignment and averaging. The nearest entry of a part is found through a grid: the hash of the
part's coarse cell leads to the entries that can be nearest anywhere in the cell's box. An entry is left out if its smallest
distance to the box exceeds the smallest of all largest distances; ties stay in. Only the entries left are compared exactly.
A cell is worked out when a worker first meets it and remembered (bounded; forgotten as a whole when full); its coordinates are
kept beside its hash and compared, and vectors whose hash belongs to another cell are compared with all entries.

A round is one map with sums per entry made in the task; those sums, of a size fixed by the codebooks, are added by Spark and
come to the driver as new codebooks, which go out with the next round.

Defined results: vectors that are null, hold null or non-finite components, or have another length than most (the longer one in
a tie) are dropped; components beyond what squared distances in 64 bits can hold (2^27 for 64 of them) count as that limit;
a length that `parts` does not divide gives parts that differ by one; with fewer vectors than entries there are fewer entries;
rows that repeat a vec_id are vectors of their own, ordered by their components where the first are chosen; a null vec_id comes last;
null labels are one label; an empty table gives an empty table; other columns, whatever their names, are not looked at."""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwise.session import cut_lineage

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
CELLS = 4096                 # cells of a part's grid within the box around its codebook
MOST_CELLS = 50_000          # cells of a part that a worker remembers
ROWS = 4096                  # vectors compared at once
SMALL_LABELS = 50_000        # labels up to which their sums are sent to all executors
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Grid:
    """The nearest entries of one part."""

    def __init__(self, entries: np.ndarray, cells: int = CELLS):
        size = entries.shape[1]
        side = max(2, round(cells ** (1 / size))) if size else 1
        self.entries, self.low = entries, entries.min(0)
        self.width = np.maximum(1, -(-(entries.max(0) - self.low + 1) // side))
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.cells = np.zeros((0, self.entries.shape[1]), np.int64)
        self.near = np.zeros((0, len(self.entries)), bool)

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """Which entries can be nearest to a point of each cell."""
        a = (self.low + cells * self.width)[:, None]
        b = a + self.width - 1
        inside = np.maximum(np.maximum(a - self.entries, self.entries - b), 0)
        across = np.maximum(np.abs(self.entries - a), np.abs(self.entries - b))
        return (inside ** 2).sum(2) <= (across ** 2).sum(2).min(1)[:, None]

    def _masks(self, cells: np.ndarray) -> np.ndarray:
        """The candidates of every row of `cells`."""
        h = np.full(len(cells), cells.shape[1], np.uint64)
        for k in range(cells.shape[1]):
            h = (h ^ cells[:, k].astype(np.uint64)) * _STEP
            h ^= h >> np.uint64(29)
        distinct, first, row = np.unique(h, return_index=True, return_inverse=True)
        if len(self.slots) + len(distinct) > MOST_CELLS:
            self.clear()
        keys = distinct.tolist()
        fresh = [k for k, x in enumerate(keys) if x not in self.slots]
        if fresh:
            found = cells[first[fresh]]
            self.slots.update((keys[k], len(self.cells) + i) for i, k in enumerate(fresh))
            self.cells = np.concatenate([self.cells, found])
            self.near = np.concatenate([self.near, *(self.candidates(found[i:i + 1024]) for i in range(0, len(found), 1024))])
        slot = np.array([self.slots[x] for x in keys], np.int64)[row]
        masks = self.near[slot]
        masks[(self.cells[slot] != cells).any(1)] = True              # the hash belongs to another cell
        return masks

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lowest of equals) and squared distance of each point."""
        row, entry = np.nonzero(self._masks((points - self.low) // self.width))
        gap = points[row] - self.entries[entry]
        distance = (gap * gap).sum(1)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.minimum.reduceat(distance, starts)
        hit = np.flatnonzero(distance == best[row])[::-1]
        code = np.zeros(len(points), np.int64)
        code[row[hit]] = entry[hit]                                   # written last: the lowest
        return code, best


def bounds(dims: int, parts: int) -> list[tuple[int, int]]:
    return [(dims * k // parts, dims * (k + 1) // parts) for k in range(parts)]


def whole_numbers(values: np.ndarray, dims: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of rows of `dims` components, within what squared distances can hold."""
    limit = math.isqrt(2 ** 62 // max(1, dims)) // 2
    return np.clip(np.floor(scale * values.astype(np.float64)), -limit, limit).astype(np.int64).reshape(-1, dims)


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))


def usable_vectors(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows whose vector is whole and of the common length, and that length."""
    held = vectors.where(_usable(F.col(vector)))
    common = held.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dims = common["d"] if common else 0
    return held.where(F.size(vector) == dims), dims


def _numbers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    column = batch.column("v")
    return whole_numbers(column.flatten().to_numpy(zero_copy_only=False), dims) if dims else np.zeros((len(column), 0), np.int64)


def refined(held: DataFrame, vector: str, books: list[np.ndarray], dims: int) -> list[np.ndarray]:
    """The codebooks after one round over all vectors."""
    cuts = bounds(dims, len(books))

    def run(batches):
        grids, most = [Grid(b) for b in books], max(len(b) for b in books)
        counts, sums = np.zeros((len(books), most), np.int64), np.zeros((dims, most), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _numbers(batch.slice(at, ROWS), dims)
                for k, (a, b) in enumerate(cuts):
                    code, _ = grids[k].nearest(x[:, a:b])
                    np.add.at(counts[k], code, 1)
                    for d in range(a, b):
                        np.add.at(sums[d], code, x[:, d])
        part, entry = np.nonzero(counts)
        if len(part):
            rows = [(d, e, n, sums[d, e]) for k, e, n in zip(part, entry, counts[part, entry]) for d in range(*cuts[k])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["d", "e", "n", "s"])
    added = held.select(F.col(vector).alias("v")).mapInArrow(run, "d int, e int, n bigint, s bigint").groupBy("d", "e").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    new = [b.copy() for b in books]
    for row in added.collect():                                       # one row per entry and dimension
        k = next(k for k, (a, b) in enumerate(cuts) if a <= row["d"] < b)
        new[k][row["e"], row["d"] - cuts[k][0]] = row["s"] // row["n"]
    return new


def codebooks(held: DataFrame, dims: int, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A matrix of entries for each part."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    first = held.orderBy(F.col(vec_id).asc_nulls_last(), vector).select(vector).limit(entries).collect()
    start = whole_numbers(np.array([r[0] for r in first], np.float64), dims) if first and dims else np.zeros((max(1, len(first)), dims), np.int64)
    books = [start[:, a:b] for a, b in bounds(dims, parts)]
    for _ in range(rounds if first else 0):
        books = refined(held, vector, books, dims)
    return books


def encode(held: DataFrame, books: list[np.ndarray], dims: int, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every vector."""
    cuts = bounds(dims, len(books))
    source = held.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    kinds = dict(source.dtypes)

    def run(batches):
        grids = [Grid(b) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                x = _numbers(piece, dims)
                codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
                for k, (a, b) in enumerate(cuts):
                    code, distance = grids[k].nearest(x[:, a:b])
                    codes[:, k], error = code, error + distance
                digits, step = codes.tobytes().hex(), 2 * len(books)
                text = [digits[i:i + step] for i in range(0, len(digits), step)]
                yield pa.RecordBatch.from_arrays([piece.column("vec_id"), piece.column("label"), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])
    return source.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def books_digest(books: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error) of all usable vectors, and the codebooks."""
    held, dims = usable_vectors(vectors, vector)
    books = codebooks(held, dims, vec_id, vector, parts, entries, rounds)
    coded = cut_lineage(encode(held, books, dims, vec_id, vector, label))
    sums = cut_lineage(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "other"))
    if sums.count() <= SMALL_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("other"))).drop("other"), books
