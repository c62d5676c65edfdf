"""Vector codes by product quantization in whole numbers, with an integer Walsh-Hadamard transform.

Components become integers, floor(4096 * x), and each vector is cut into equal parts with a codebook each. Distances are
taken between Walsh-Hadamard transforms of zero-padded parts and entries: for length n they are n times the squared
distances, and most of a part's energy stands in few coefficients. Squared differences are added in order of
sequency; an entry whose sum exceeds that of a whole candidate is out. All of it is exact: int64 where no sum can
overflow, Python's integers beyond.

A round of training is a narrow pass in which each task puts out one row of sums per entry and component, and an
aggregation of these rows; the driver holds the codebooks (parts x entries x part length numbers) and nothing else.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import split_join
from .shared import stored

SCALE = 4096
#: Bits of a limb, in which tasks put out their sums: up to 2^38 tasks' limbs add up in a long.
LIMB = 24
#: Label rows up to which their sums are broadcast; beyond, that join shuffles.
BROADCAST_LABELS = 100_000
LONGEST = (1 << 63) - 1


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transforms of rows whose length is a power of two, in natural order."""
    out, n = rows.copy(), rows.shape[1]
    half = 1
    while half < n:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(rows), n)
        half *= 2
    return out


def sequency(n: int) -> np.ndarray:
    """Places of the transform's coefficients in order of their sign changes."""
    signs = hadamard(np.eye(n, dtype=np.int64))
    return np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")


def transformed(parts: np.ndarray) -> np.ndarray:
    """Zero-padded parts transformed, coefficients in order of sequency."""
    n = 1 << max(0, parts.shape[1] - 1).bit_length()
    wide = np.zeros((len(parts), n), parts.dtype)
    wide[:, : parts.shape[1]] = parts
    return hadamard(wide)[:, sequency(n)]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point's nearest entry (ties: the lower one) and n times the squared distance; both are transformed."""
    n = points.shape[1]
    sums = (points[:, :1] - entries[:, 0]) ** 2
    guess = sums.argmin(axis=1)
    bound = ((points - entries[guess]) ** 2).sum(axis=1)  # a whole candidate: what exceeds it is out
    row, entry = np.nonzero(sums <= bound[:, None])
    total = sums[row, entry]
    for j in range(1, n):
        total = total + (points[row, j] - entries[entry, j]) ** 2
        live = (total <= bound[row]).astype(bool)
        row, entry, total = row[live], entry[live], total[live]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(total, starts) if len(starts) else total
    best = np.flatnonzero((total == least[row]).astype(bool))  # rows stand in order, each with all of its entries left
    _, first = np.unique(row[best], return_index=True)
    return entry[best[first]], least


def quantized(x: np.ndarray) -> np.ndarray:
    """floor(4096 * x): int64, or Python's integers where a component is large."""
    if not x.size or np.abs(x).max() < 2.0**40:
        return np.floor(x * SCALE).astype(np.int64)
    whole = [int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


@dataclass
class Codebooks:
    """entries[part][entry]: components as Python's integers; wide: sums may exceed int64."""

    entries: list[list[list[int]]]
    wide: bool

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, comma-joined."""
        flat = ",".join(str(v) for part in self.entries for entry in part for v in entry)
        return hashlib.sha256(flat.encode()).hexdigest()

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Integer components, and by part the nearest entries and squared distances, of vectors x."""
        kind = object if self.wide else np.int64
        q = quantized(x).astype(kind)
        parts, length = len(self.entries), len(self.entries[0][0])
        index, far = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), kind)
        if length:
            n = 1 << (length - 1).bit_length()
            for p, book in enumerate(self.entries):
                at, total = nearest(transformed(q[:, p * length : (p + 1) * length]), transformed(np.array(book, kind).reshape(len(book), length)))
                index[:, p], far[:, p] = at, total // n
        return q, index, far


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def whole_vectors(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector has no null and only finite components."""
    bad = F.exists(F.col(vector_col).cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _sums(kept: DataFrame, books: Codebooks, limbs: int) -> DataFrame:
    """part, entry, place (-1: the count), limb, total of what each task's vectors add to their nearest entries."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = len(books.entries[0][0])
        counts = [[0] * len(p) for p in books.entries]
        sums = [[np.zeros(length, object) for _ in p] for p in books.entries]
        for batch in batches:
            if not batch.num_rows:
                continue
            q, index, _ = books.assign(_matrix(batch.column(0)))
            for p in range(len(books.entries)):
                own = q[:, p * length : (p + 1) * length]
                for e in np.unique(index[:, p]).tolist():
                    mine = index[:, p] == e
                    counts[p][e] += int(mine.sum())
                    sums[p][e] = sums[p][e] + own[mine].sum(axis=0).astype(object)
        rows = []
        for p, part in enumerate(counts):
            for e, times in enumerate(part):
                if times:
                    rows.append((p, e, -1, 0, times))
                    for place, v in enumerate(sums[p][e].tolist()):
                        rows += [(p, e, place, k, v >> LIMB * k if k == limbs - 1 else (v >> LIMB * k) & ((1 << LIMB) - 1)) for k in range(limbs)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "limb", "total"])

    made = kept.mapInArrow(work, "part long, entry long, place long, limb long, total long")
    return made.groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total"))


def train_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks | None:
    """Codebooks of the whole vectors; None where there are none.

    Each part's codebook starts as that part of the `entries` smallest ids (nulls last; equal ids by their vectors; fewer
    if there are fewer rows). Each round assigns all vectors and moves an entry to the floor of its parts' mean; unused
    entries stay. Vectors of unlike length, or of one that `parts` does not divide, raise a ValueError.
    """
    kept = whole_vectors(vectors, vector_col).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    size = F.size("v")
    rows, low, high, most = kept.agg(F.count(F.lit(1)), F.min(size), F.max(size), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not rows:
        return None
    if low != high or low % parts:
        raise ValueError(f"vectors must all have one length that {parts} divides; here are {low} to {high}")
    length = low // parts
    start = [r.v for r in kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
    first = quantized(np.array(start, np.float64).reshape(len(start), -1))
    most = int(most or 0) * SCALE + SCALE
    n = 1 << max(0, length - 1).bit_length()
    books = Codebooks([[[int(v) for v in row[p * length : (p + 1) * length]] for row in first] for p in range(parts)], wide=4 * n**3 * most * most > LONGEST)
    limbs = 1 if rows * most <= LONGEST else -(-(rows * most).bit_length() // LIMB) + 1
    for _ in range(rounds):
        found: dict[tuple[int, int, int], int] = {}
        for part, entry, place, limb, total in _sums(kept.select("v"), books, limbs).collect():  # one row per number of the codebooks and limb
            found[part, entry, place] = found.get((part, entry, place), 0) + (total << LIMB * limb)
        moved = [
            [[found[p, e, j] // found[p, e, -1] for j in range(length)] if (p, e, -1) in found else entry for e, entry in enumerate(book)]
            for p, book in enumerate(books.entries)
        ]
        settled = moved == books.entries
        books = Codebooks(moved, books.wide)
        if settled:  # the same codebooks give the same assignments again
            break
    return books


def encode_vectors(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id_col, label_col, code (two hex digits per part), error (squared distance; null beyond a long) of the whole vectors."""
    kept = whole_vectors(vectors, vector_col).select(F.col(id_col), F.col(label_col), F.col(vector_col).cast("array<double>").alias("v"))
    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in (id_col, label_col))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, index, far = books.assign(_matrix(batch.column(2)))
            code = ["".join(f"{e:02x}" for e in row) for row in index.tolist()]
            error = [t if (t := sum(row)) <= LONGEST else None for row in far.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=[id_col, label_col, "code", "error"])

    return kept.mapInArrow(work, f"{kinds}, code string, error long")


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """id_col, code, error, label_error, codebooks_sha256 of every row with a whole vector.

    Rows whose vector is null, or holds a null or non-finite component, are left out; a table without others gives no
    rows. Repeated rows are coded each; null ids are coded too, and stand last for the codebooks' start. label_error is
    the sum of error over equal labels, nulls together (null where a sum does not fit a long). Columns other than the
    three named are not read. The vectors are read once per round: a costly plan should be stored first.
    """
    out = (F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"))
    books = train_codebooks(vectors, id_col, vector_col, parts, entries, rounds)
    if books is None:
        return vectors.where("false").select(id_col, *out, F.lit("").alias("codebooks_sha256"))
    coded = stored(encode_vectors(vectors, books, id_col, vector_col, label_col), "vector-codes")
    labelled = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit("")))
    total = F.sum(F.col("error").cast("decimal(20,0)")).try_cast("long")
    whole = F.count("error") == F.count(F.lit(1))
    sums = stored(labelled.groupBy("_label").agg(F.when(whole, total).alias("label_error"), F.count(F.lit(1)).alias("_times")), "label-errors")
    labels, rows = sums.agg(F.count(F.lit(1)), F.sum("_times")).first()
    if labels <= BROADCAST_LABELS:
        met = labelled.join(F.broadcast(sums.drop("_times")), "_label")
    else:
        met = split_join(labelled, sums, "_label", "_times", rows)
    return met.select(id_col, "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
