"""Vector search: exact top-k in blocks, self-kNN, retrieval with graph expansion."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .nearest import Nearest, meet, number_kind, ranked, stored_blocks


def cosine(a: str, b: str) -> Column:
    """V6. Cosine similarity of two array columns; 0 where a norm is 0."""
    sums = [F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v) for x, y in ((a, b), (a, a), (b, b))]
    norm = F.sqrt(sums[1]) * F.sqrt(sums[2])
    return F.when(norm == 0, 0.0).otherwise(sums[0] / norm)


def topk_join(queries: DataFrame, vectors: DataFrame, k: int = K.NEIGHBOURS, key: str = "id", vector: str = "embedding", other: bool = False, before: str | None = None) -> DataFrame:
    """V3, V5. query, id, distance, rank (from 1): the k nearest vectors of each query, by distance, then id.

    Exact: each query meets every vector, in the cells of a grid (nearest.meet). With `other`, a query's own
    id is left out (self-kNN); with `before`, only vectors whose value in that column is smaller than the query's count.
    """
    kind = vectors.schema[key].dataType.simpleString()
    place = F.col(before).cast("long") if before else F.lit(0).cast("long")

    def packed(rows: DataFrame, side: str) -> DataFrame:
        own = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast(kind).alias("id"), F.col(vector).alias("v"), place.alias(f"{side}_extra"))
        return stored_blocks(own, kind, number_kind(rows, vector), f"{side}_extra", f"{side}-blocks")

    v = packed(vectors, "v")
    q = v.withColumnRenamed("v_extra", "q_extra") if queries is vectors else packed(queries, "q")

    def task(ids: np.ndarray, unit: np.ndarray, extra: bytes) -> tuple[Nearest, Callable]:
        near, own = Nearest(ids, unit, k), np.frombuffer(extra, np.int64)

        def take(ids: np.ndarray, unit: np.ndarray, extra: bytes) -> None:
            theirs = np.frombuffer(extra, np.int64)
            near.meet(ids, unit, other, (lambda rows, columns: theirs[None, columns] >= own[rows, None]) if before else None)

        return near, take

    return ranked(meet(q, v, k, kind, (number_kind(queries, vector), number_kind(vectors, vector)), task), k)


def search(queries: DataFrame, vectors: DataFrame, k: int = K.NEIGHBOURS, where: Column | None = None, key: str = "id", vector: str = "embedding") -> DataFrame:
    """V3. Top-k cosine distance, after an optional filter on the vectors' columns."""
    return topk_join(queries, vectors.where(where) if where is not None else vectors, k, key, vector)


def role_search(queries: DataFrame, vectors: DataFrame, role: str, k: int = K.NEIGHBOURS, key: str = "id", vector: str = "embedding") -> DataFrame:
    """V4. Top-k cosine similarity among the vectors that the role may see: query, id, score, rank."""
    found = search(queries, vectors, k, F.array_contains("roles", role), key, vector)
    return found.select("query", "id", (1 - F.col("distance")).alias("score"), "rank")


def self_knn(vectors: DataFrame, k: int = K.NEIGHBOURS, key: str = "id", vector: str = "embedding") -> DataFrame:
    """V5. src, dst, distance, rank."""
    return topk_join(vectors, vectors, k, key, vector, other=True).select(F.col("query").alias("src"), F.col("id").alias("dst"), "distance", "rank")


def expand_hits(hits: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """V7. query, id, heading, text, section, distance, graph_expanded, place.

    Hits, then the heads of their outgoing DEPENDS_ON and CONFLICTS_WITH edges that are no hits themselves, in
    order of id, at the placeholder distance. One row per query and clause.
    """
    out = edges.where(F.col("type").isin(*K.EXPANDING_TYPES)).select("src", "dst")
    heads = hits.select("query", F.col("id").alias("src")).join(out, "src").select("query", F.col("dst").alias("id")).distinct()
    new = heads.join(hits.select("query", "id"), ["query", "id"], "left_anti")
    rows = hits.select("query", "id", "distance", F.lit(False).alias("graph_expanded")).unionByName(
        new.select("query", "id", F.lit(K.EXPANDED_DISTANCE).alias("distance"), F.lit(True).alias("graph_expanded"))
    )
    place = Window.partitionBy("query").orderBy("graph_expanded", F.when(~F.col("graph_expanded"), F.col("distance")), "id")
    return rows.join(nodes.select("id", "heading", "text", "section"), "id").withColumn("place", F.row_number().over(place))
