"""Clauses that arrive as a stream: each micro-batch is one write of vectors, nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..operators.graph import insert_clauses
from ..operators.vectors import topk_join
from ..plans.pipelines import embedded
from ..sources.stores import GraphStore, VectorStore, vector_rows
from ..storage import stored


def insert_batch(clauses: DataFrame, embed, vectors: VectorStore, graph: GraphStore, threshold: float = K.SIMILAR_DISTANCE, model=None, writer: str | None = None, epoch: int | None = None) -> None:
    """G7 for a batch of clauses (id, heading, text, section, idx, pos).

    A clause is linked with the nearest of those before it by pos, in the store or in its own batch; so clauses that arrive
    in order of pos give the same graph however they are cut into batches. (One that arrives late is linked with those
    before it; those after it do not look at it again.) Of equal ids in a batch the last counts. Vectors and graph
    share one log (see clause_base): all change in one version, and a batch that the writer has written before, by its
    epoch, is not even embedded again.
    """
    log = vectors.log
    if graph.log is not log:
        raise ValueError("vectors and graph must be kept under one log")
    if writer is not None and epoch is not None and log.seen(writer, epoch):
        return
    last = clauses.groupBy("id").agg(F.max_by(F.struct(*clauses.columns), "pos").alias("c")).select("c.*")
    new = stored(embedded(last, embed), "inserted")
    if new.isEmpty():
        return
    held = vectors.rows().join(new.select("id"), "id", "left_anti").select("id", "embedding", "pos")
    near = topk_join(new, held.unionByName(new.select("id", "embedding", "pos")), K.IMPACT_NEIGHBOURS, before="pos")
    pairs = near.join(new.select(F.col("id").alias("query"), "pos"), "query").select(F.col("query").alias("src"), F.col("id").alias("dst"), "distance", (F.col("pos") * 1000 + F.col("rank")).alias("seq"))
    nodes, edges = insert_clauses(log.read("nodes"), log.read("edges"), new, stored(pairs, "neighbours"), threshold, model)
    log.write({"vectors": vector_rows(new), "nodes": nodes, "edges": edges}, writer=writer, epoch=epoch)


def stream_inserts(stream: DataFrame, embed, vectors: VectorStore, graph: GraphStore, checkpoint: str, threshold: float = K.SIMILAR_DISTANCE, model=None, writer: str = "stream") -> StreamingQuery:
    """A query that inserts each micro-batch once, also where Spark replays it; a writer's name belongs to one checkpoint."""
    return (
        stream.writeStream.foreachBatch(lambda batch, epoch: insert_batch(batch, embed, vectors, graph, threshold, model, writer, epoch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
