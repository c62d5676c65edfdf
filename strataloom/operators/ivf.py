"""An inverted-file index of vectors: lists around centres, few of which a query reads; distances are exact.

Centres are fitted by spherical k-means on a bounded sample: the SAMPLE vectors whose ids have the smallest hashes. Every
vector is indexed: it stands in its nearest centre's list, and blocks of up to BLOCK vectors hold lists one after another; the
largest angle to the centre is noted per list. A query carries one bit per list that it reads, and queries of neighbouring lists
meet the blocks together (nearest.meet), so no query is copied per list; how many lists give the wanted recall is measured
against the exact search on a sample of queries. An exact search reads, in a second pass, each list that the angles do not rule
out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..storage import stored
from .nearest import BLOCK, Nearest, matrix, meet, number_kind, ranked, stored_blocks, unit_rows
from .vectors import topk_join

#: Vectors that centres are fitted on, and queries that probes are measured with.
SAMPLE, PROBE_SAMPLE = 20_000, 200
#: Lists at most: the centres are held by the driver and shipped to every task (4,096 x 1,024 numbers are 32 MB).
MOST_LISTS = 4_096
ROUNDS = 12
#: Vectors whose similarities with all centres are held at once.
SLICE = 1_000


def fit_centres(vectors: DataFrame, key: str = "id", vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Unit centres, one row each; none for a table without vectors. By default four times the root of the number of vectors."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(key).alias("h"))
    n = rows.count()
    drawn = [r[0] for r in rows.orderBy("h", "v").limit(sample).select("v").collect()]
    if not drawn:
        return np.zeros((0, 0))
    x = np.array(drawn, np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    wanted = min(lists or int(4 * n**0.5), MOST_LISTS, len(np.unique(x, axis=0)), max(1, len(x) // 4))
    random = np.random.default_rng(0)
    centres = x[random.choice(len(x), max(1, wanted), replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([(x[at : at + SLICE] @ centres.T).argmax(axis=1) for at in range(0, len(x), SLICE)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        empty = size[:, 0] < 1e-12
        centres = np.divide(sums, size, out=np.zeros_like(sums), where=size > 1e-12)
        centres[empty] = x[random.choice(len(x), int(empty.sum()))]
    return centres


@dataclass
class Index:
    """rows: id, list; blocks: place, vi (ids), m (vectors as bytes), v_extra (their lists); sizes: by list its vectors, parts and largest angle."""

    centres: np.ndarray
    rows: DataFrame
    blocks: DataFrame
    sizes: DataFrame
    kind: str
    number: type

    @property
    def n_lists(self) -> int:
        return len(self.centres)


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _each(m: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    return pa.array([r.tobytes() for r in m], pa.binary())


def build_index(vectors: DataFrame, key: str = "id", vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE) -> Index:
    """Index every vector; those that are null are in no list. Lists with many vectors are several parts, so that no task holds all of one."""
    kind, number = vectors.schema[key].dataType.simpleString(), number_kind(vectors, vector)
    centres = fit_centres(vectors, key, vector, lists, sample)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            m = matrix(batch.column(1), number)
            cosines = unit_rows(m) @ centres.T
            own = cosines.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array(_angle(cosines[np.arange(len(m)), own])), _each(m)], names=["id", "list", "angle", "v"])

    placed = stored(vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), vector).mapInArrow(assign, f"id {kind}, list int, angle double, v binary"), "index-rows")
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("long"))
    sizes = stored(sizes, "index-lists")  # at most MOST_LISTS rows
    parted = placed.join(F.broadcast(sizes.select("list", "parts")), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    shelved = parted.repartitionByRange("list", "part").sortWithinPartitions("list", "part").withColumn("v_extra", F.col("list"))
    blocks = stored_blocks(shelved, kind, number, "v_extra", "index", BLOCK).withColumnRenamed("i", "vi")
    return Index(centres, placed.select("id", "list"), blocks, sizes, kind, number)


def _meet(probes: DataFrame, index: Index, k: int, number: type, other: bool, within: bool) -> DataFrame:
    """query, id, distance of queries id, home (a list), v, q_extra (a bit per list, the largest distance): the nearest of the lists that a query
    reads. With `within` vectors of other lists may be among them, and none farther than the largest distance.
    """
    near = probes.repartitionByRange("home", F.xxhash64("id")).sortWithinPartitions("home")
    asked = stored_blocks(near, index.kind, number, "q_extra", "probe-blocks", BLOCK)

    def task(ids: np.ndarray, unit: np.ndarray, extra: bytes) -> tuple[Nearest, Callable]:
        told = np.frombuffer(extra, np.uint8).reshape(len(ids), -1)
        bits = told[:, :-8]
        near = Nearest(ids, unit, k, told[:, -8:].copy().view(np.float64)[:, 0])

        def take(ids: np.ndarray, unit: np.ndarray, extra: bytes) -> None:
            lists = np.frombuffer(extra, np.int32)
            low, high = lists.min() // 8, lists.max() // 8 + 1
            place = lists - 8 * low

            def reads(rows: slice) -> np.ndarray:
                return np.unpackbits(bits[rows, low:high], axis=1).view(bool)

            near.meet(ids, unit, other, None if within else lambda rows, columns: ~reads(rows)[:, place[columns]], lambda rows: reads(rows).any(axis=0)[place])

        return near, take

    return meet(asked, index.blocks.withColumnRenamed("vi", "i"), k, index.kind, (number, index.number), task)


def index_search(queries: DataFrame, index: Index, k: int = K.NEIGHBOURS, probes: int = 8, key: str = "id", vector: str = "embedding", other: bool = False, exact: bool = False) -> DataFrame:
    """V3, V5. query, id, distance, rank: the k nearest vectors in the `probes` lists nearest to each query.

    With `exact`, a second pass reads each list that could hold one as near as the k-th found: no vector of a list is
    nearer to the query than the angle to the centre less the list's largest angle. With `other`, a query's own id is
    left out.
    """
    spark, kind, centres = queries.sparkSession, index.kind, index.centres
    if not index.n_lists:
        return spark.createDataFrame([], f"query {kind}, id {kind}, distance double, rank int")
    number = number_kind(queries, vector)
    radius = np.full(len(centres), -np.inf)
    for c, r in index.sizes.select("list", "radius").collect():  # at most MOST_LISTS rows
        radius[c] = r

    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of the first pass; where a k-th distance is known, those of the second."""
        for batch in _slices(batches):
            m = matrix(batch.column(1), number)
            cosines = unit_rows(m) @ centres.T
            limit = np.full(len(m), np.inf)
            if batch.num_columns == 3:
                bound = batch.column(2).to_numpy(zero_copy_only=False)  # not a number: fewer than k were found
                limit = np.where(np.isnan(bound), np.inf, bound)
                least = 1 - np.cos(np.maximum(0, _angle(cosines) - radius))
                read = ~(least > limit[:, None] + 1e-7)  # angles near 0 are off by some 1e-8
            else:
                read = np.zeros(cosines.shape, bool)
                np.put_along_axis(read, np.argsort(-cosines, axis=1, kind="stable")[:, :probes], True, axis=1)
            told = np.hstack([np.packbits(read & np.isfinite(radius), axis=1), limit[:, None].view(np.uint8)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cosines.argmax(axis=1), pa.int32()), _each(m), _each(told)], names=["id", "home", "v", "q_extra"])

    schema = f"id {kind}, home int, v binary, q_extra binary"
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast(kind).alias("id"), F.col(vector).alias("q"))
    found = ranked(_meet(stored(asked.mapInArrow(lists, schema), "probes"), index, k, number, other, False), k)
    if not exact:
        return found
    kth = stored(found.where(F.col("rank") == k).select(F.col("query").alias("k_query"), F.col("distance").alias("kth")), "near")
    again = asked.join(kth, F.col("id") == F.col("k_query"), "left").select("id", "q", F.coalesce("kth", F.lit(float("nan"))).alias("kth"))
    return ranked(_meet(stored(again.mapInArrow(lists, schema), "probes"), index, k, number, other, True), k)


def measured_probes(vectors: DataFrame, index: Index, k: int = K.NEIGHBOURS, recall: float = 0.95, key: str = "id", vector: str = "embedding", sample: int = PROBE_SAMPLE) -> tuple[int, float]:
    """The fewest lists that give the wanted mean recall on a sample of queries (by hash), and the recall that they give.

    The sample's true neighbours come from the exact search over all vectors; which lists they stand in tells all recalls at once.
    """
    drawn = stored(vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("embedding")).orderBy(F.xxhash64("id", F.lit(7))).limit(sample), "probe-sample")
    true = topk_join(drawn, vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("embedding")), k, other=True).select("query", "id")
    rows = true.join(index.rows, "id").groupBy("query").agg(F.collect_list("list").alias("lists")).join(drawn.withColumnRenamed("id", "query"), "query").select("lists", "embedding").collect()  # `sample` rows
    if not rows:
        return 1, 1.0
    x = np.array([r.embedding for r in rows])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    rank = np.argsort(np.argsort(-(x @ index.centres.T), axis=1, kind="stable"), axis=1)
    needed = np.array([rank[i, c] for i, r in enumerate(rows) for c in r.lists])
    shares = np.cumsum(np.bincount(needed, minlength=index.n_lists)) / len(needed)
    probes = int(np.argmax(shares >= recall)) + 1
    return probes, float(shares[probes - 1])
