"""Blocks of queries that meet blocks of vectors: the k nearest of each query, exact, in tasks of bounded memory.

Queries are dealt into groups and vectors into parts; a cell of that grid is one task, which holds its group and reads its
part block by block. Only the k nearest so far stay of what it has read. Products are in single precision and tell which few
pairs can be near; the distances of these are computed in double precision, from the pair alone, so no block's shape decides
anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Vectors in a block, and queries of a task that meet a block as one matrix product (4 MB of similarities).
BLOCK, TILE = 2_000, 500
#: Places of distances: their last bits must not decide between equal vectors.
PLACES = 12
#: Bits for a block's number within its partition.
PLACE_BITS = 32
#: Queries of a task at most, and the bytes of their vectors.
GROUP, GROUP_BYTES = 32_768, 128 << 20
#: Tasks for each core, where the blocks suffice, and the blocks of vectors that each reads at least: the first ones find most.
TASKS, PART = 4, 32


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; zero rows stay."""
    m = m.astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def number_kind(df: DataFrame, vector: str) -> type:
    """The numbers that a table's vectors are kept as."""
    return np.float32 if df.schema[vector].dataType.simpleString() == "array<float>" else np.float64


def id_array(column: pa.Array) -> np.ndarray:
    """Ids as numbers where they are, else as objects."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _joined(ids: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(ids if len({x.dtype for x in ids}) == 1 else [x.astype(object) for x in ids])


def _ranks(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids, nulls first."""
    if ids.dtype != object:
        return ids
    rank = {x: r for r, x in enumerate(sorted(set(ids.tolist()), key=lambda x: (x is not None, x)))}
    return np.array([rank[x] for x in ids.tolist()], np.int64)


def _equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal ids in a and in b."""
    if object in (a.dtype, b.dtype):
        both = _ranks(_joined([a, b]).astype(object))
        a, b = both[: len(a)], both[len(a) :]
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b, a, side, order) for side in ("left", "right"))
    many = high - low
    line = np.repeat(np.arange(len(a)), many)
    return line, order[np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(line))]


class Nearest:
    """The k nearest vectors so far of each query, by distance to PLACES places, then id.

    limit: by query the distance that none may exceed.
    """

    def __init__(self, ids: np.ndarray, unit: np.ndarray, k: int, limit: np.ndarray | None = None):
        self.ids, self.unit, self.single, self.k = ids, unit, unit.astype(np.float32), k
        self.limit = np.full(len(ids), np.inf) if limit is None else limit
        self.distance, self.found = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)
        #: More than a similarity in single precision can be off.
        self.slack = (unit.shape[1] + 8) * 2.0**-23

    def meet(self, ids: np.ndarray, unit: np.ndarray, other: bool = False, hidden: Callable | None = None, chosen: Callable | None = None) -> None:
        """Take in a block of vectors.

        With `other`, a query's own id is left out. chosen(rows) tells which vectors a tile of queries reads at all, and
        hidden(rows, columns) which pairs of these do not count.
        """
        whole = np.isfinite(unit).all(axis=1)  # others are near to nothing
        single = unit.astype(np.float32)
        own = _equal(self.ids, ids) if other else None
        room = np.empty((TILE, len(ids)), np.float32)  # one for all tiles
        for at in range(0, len(self.ids), TILE):
            rows = slice(at, at + TILE)
            read = whole if chosen is None else whole & chosen(rows)
            columns = np.arange(len(ids)) if read.all() else np.flatnonzero(read)
            if not len(columns):
                continue
            mine = self.single[rows]
            s = np.matmul(mine, (single if len(columns) == len(ids) else single[columns]).T, out=room.reshape(-1)[: len(mine) * len(columns)].reshape(len(mine), -1))
            if hidden is not None:
                s[hidden(rows, columns)] = -2
            if own is not None:
                a, b = np.searchsorted(own[0], (at, at + TILE))
                line, place = own[0][a:b] - at, np.searchsorted(columns, own[1][a:b])
                there = (place < len(columns)) & (columns[np.minimum(place, len(columns) - 1)] == own[1][a:b])
                s[line[there], place[there]] = -2
            limit = np.minimum(self.limit[rows], self.distance[rows, -1])
            least = np.where(np.isfinite(limit), 1 - limit - self.slack, -1.5)  # -2: no pair
            if len(columns) > self.k and len(new := np.flatnonzero(np.isinf(self.distance[rows, -1]))):
                kth = np.partition(s[new], len(columns) - self.k, axis=1)[:, len(columns) - self.k]
                least[new] = np.fmax(least[new], kth - 2 * self.slack)
                least = np.maximum(least, -1.5)
            near = np.flatnonzero(s.max(axis=1) >= least)
            if len(near):
                line, column = np.divmod(np.flatnonzero(s[near] >= least[near, None]), len(columns))
                self._add(near[line] + at, columns[column], ids, unit)

    def _add(self, line: np.ndarray, column: np.ndarray, ids: np.ndarray, unit: np.ndarray) -> None:
        step = max(1, (32 << 20) // (16 * unit.shape[1]))
        parts = [1 - np.einsum("ij,ij->i", self.unit[line[i : i + step]], unit[column[i : i + step]]) for i in range(0, len(line), step)]
        d = np.round(np.concatenate(parts), PLACES) if parts else np.zeros(0)
        if ids.dtype == object and self.found.dtype != object:
            self.found = self.found.astype(object)
        last = self.distance[line, -1]
        nearer = (d < last) | ((d == last) & (True if object in (ids.dtype, self.found.dtype) else ids[column] < self.found[line, -1]))
        keep = nearer & (d <= self.limit[line])
        line, d = line[keep], d[keep]
        if not len(line):
            return
        touched = np.unique(line)
        old, place = np.nonzero(np.isfinite(self.distance[touched]))
        old = touched[old]
        line, d, i = np.concatenate([line, old]), np.concatenate([d, self.distance[old, place]]), _joined([ids[column[keep]], self.found[old, place]])
        order = np.lexsort((_ranks(i), d, line))
        line, d, i = line[order], d[order], i[order]
        start = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        place = np.arange(len(line)) - np.repeat(start, np.diff(np.r_[start, len(line)]))
        top = place < self.k
        self.distance[line[top], place[top]], self.found[line[top], place[top]] = d[top], i[top]

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of queries, ids of vectors and distances, in pieces."""
        for at in range(0, len(self.ids), BLOCK):
            line, place = np.nonzero(np.isfinite(self.distance[at : at + BLOCK]))
            yield self.ids[line + at], self.found[line + at, place], self.distance[line + at, place]


def as_bytes(column: pa.Array, kind: type) -> bytes:
    """Vectors, numbers or bytes, one behind another."""
    if pa.types.is_binary(column.type):
        return b"".join(column.to_pylist())
    return (matrix(column, kind) if pa.types.is_list(column.type) else column.to_numpy(zero_copy_only=False)).tobytes()


def stored_blocks(rows: DataFrame, kind: str, number: type, extra: str, label: str, block: int = BLOCK) -> DataFrame:
    """Rows id, v (a vector or its bytes) and extra (a number or bytes), packed in their order and stored: place, i (ids), m and extra (bytes)."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = (TaskContext.get().partitionId() if TaskContext.get() else 0) << PLACE_BITS
        held: list[pa.RecordBatch] = []

        def one(n: int) -> pa.RecordBatch:
            nonlocal held, place
            taken, left = [], []
            for batch in held:
                taken.append(batch.slice(0, n))
                left.append(batch.slice(n))
                n = max(0, n - batch.num_rows)
            held = [b for b in left if b.num_rows]
            ids = pa.concat_arrays([b.column(0) for b in taken])
            joined = [b"".join(as_bytes(b.column(c), number) for b in taken) for c in (1, 2)]
            place += 1
            whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([place - 1], pa.int64()), whole, *(pa.array([x], pa.binary()) for x in joined)], names=["place", "i", "m", extra])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= block:
                yield one(block)
        if left := sum(b.num_rows for b in held):
            yield one(left)

    return stored(rows.select("id", "v", extra).mapInArrow(pack, f"place long, i array<{kind}>, m binary, {extra} binary"), label)


def _numbered(stored_rows: DataFrame) -> tuple[DataFrame, int, int, int]:
    """Stored blocks with places from 0 on, without gaps; how many there are, their rows and their bytes."""
    partition = F.shiftright("place", PLACE_BITS).cast("int")
    told = {r[0]: r[1:] for r in stored_rows.groupBy(partition).agg(F.count(F.lit(1)), F.sum(F.size("i")), F.sum(F.length("m"))).collect()}  # a row per partition
    first, count = [], 0
    for p in range(max(told, default=-1) + 1):
        first.append(F.lit(count).cast("long"))
        count += told.get(p, (0,))[0]
    ahead = F.get(F.array(*first), partition) if first else F.lit(0).cast("long")
    return stored_rows.withColumn("place", ahead + F.col("place").bitwiseAND((1 << PLACE_BITS) - 1)), count, sum(x[1] for x in told.values()), sum(x[2] for x in told.values())


def meet(queries: DataFrame, vectors: DataFrame, k: int, kind: str, kinds: tuple[type, type], task: Callable) -> DataFrame:
    """query, id, distance: up to k rows of each query from each cell; the nearest k are among them.

    Both sides are stored blocks; those of the queries have the column q_extra, those of the vectors v_extra (bytes). kinds
    are the numbers of queries and of vectors. task(ids, unit, extra) makes a cell's Nearest of its queries, and
    a function that takes in a block of vectors with ids, unit and extra.
    """
    spark = queries.sparkSession
    queries, most, n, size = _numbered(queries)
    vectors, shelves, _, _ = _numbered(vectors)
    if not most or not shelves:
        return spark.createDataFrame([], f"query {kind}, id {kind}, distance double")
    width = max(1, size // n // np.dtype(kinds[0]).itemsize)
    group = min(GROUP, max(BLOCK, GROUP_BYTES // (12 * width)))
    tasks, least = TASKS * spark.sparkContext.defaultParallelism, min(most, -(-n // group))
    parts = max(1, min(-(-tasks // least), shelves // PART))
    groups = min(most, max(least, -(-tasks // parts)))
    parts = max(parts, min(shelves, -(-tasks // groups)))  # few queries: their vectors are dealt all the more
    some = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    a = queries.select(F.pmod("place", F.lit(groups)).alias("g"), some(parts).alias("p"), F.lit(0).alias("side"), "place", "i", "m", F.col("q_extra").alias("o"))
    b = vectors.select(some(groups).alias("g"), F.pmod("place", F.lit(parts)).alias("p"), F.lit(1).alias("side"), "place", "i", "m", F.col("v_extra").alias("o"))
    cells = a.unionByName(b).withColumn("cell", (F.col("g") * parts + F.col("p")).cast("int")).select("cell", "side", "place", "i", "m", "o")
    dealt = cells.repartitionById(groups * parts, "cell").sortWithinPartitions("side", "place").drop("cell", "place")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        near = take = type_of = None  # until the queries are there

        def joined(kind_of: type) -> tuple:
            ids, m, o = _joined([h[0] for h in held]), np.concatenate([np.frombuffer(h[1], kind_of).reshape(len(h[0]), -1) for h in held]), [h[2] for h in held]
            held.clear()
            return ids, unit_rows(m), b"".join(x or b"" for x in o)

        for batch in batches:
            type_of = batch.schema.field(1).type.value_type
            for row in range(batch.num_rows):
                if batch.column(0)[row].as_py() and take is None:
                    if not held:  # no queries
                        continue
                    near, take = task(*joined(kinds[0]))
                held.append((id_array(batch.column(1)[row].values), batch.column(2)[row].as_py(), batch.column(3)[row].as_py()))
                if take and sum(len(h[0]) for h in held) >= BLOCK:
                    take(*joined(kinds[1]))
        if take is None:
            return
        if held:
            take(*joined(kinds[1]))
        for query, i, d in near.rows():
            yield pa.RecordBatch.from_arrays([pa.array(query.tolist(), type_of), pa.array(i.tolist(), type_of), pa.array(d)], names=["query", "id", "distance"])

    return dealt.mapInArrow(run, f"query {kind}, id {kind}, distance double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query, id, distance, rank: the k nearest of all that were found."""
    order = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

