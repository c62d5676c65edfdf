"""Statistics and views of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .traversal import score_label


def edge_types(edges: DataFrame) -> DataFrame:
    """A1. type, count, first_seq: order by first_seq for insertion order, or by type."""
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("count"), F.min("edge_seq").alias("first_seq"))


def sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A2."""
    return nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("what"), "n").unionByName(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("what"), "n"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A4. id, heading, node_seq, in_degree, out_degree, degree."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    zero = F.lit(0).cast("long")
    return nodes.select("id", "heading", "node_seq").join(sums, "id", "left").select(
        "id", "heading", "node_seq", F.coalesce("i", zero).alias("in_degree"), F.coalesce("o", zero).alias("out_degree"), F.coalesce(F.col("i") + F.col("o"), zero).alias("degree")
    )


def top_degrees(nodes: DataFrame, edges: DataFrame, n: int = 15) -> DataFrame:
    """A4. A report of the n best connected nodes."""
    return degrees(nodes, edges).orderBy(F.desc("degree"), "node_seq").limit(n)


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A5."""
    return nodes.join(_ends(edges), "id", "left_anti")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A3. id, component (smallest id of the weakly connected component); a node without edges is its own."""
    ends = connected_components(edges.select("src", "dst"), "src", "dst")
    joined = nodes.select("id").join(ends, F.col("id") == F.col("node"), "left")
    return joined.select("id", F.coalesce("component", "id").alias("component"))


def component_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return components(nodes, edges).agg(F.countDistinct("component").alias("components"))


def _named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = (nodes.select(F.col("id").alias(e), F.col("heading").alias(f"{e}_heading")) for e in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst")


def conflict_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A6."""
    return _named(edges.where("type = 'CONFLICTS_WITH'"), nodes).select("src_heading", "dst_heading", F.round("score", 2).alias("score"), "edge_seq")


def defined_terms(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A7."""
    return _named(edges.where("type = 'DEFINES'"), nodes).select("src_heading", "dst_heading", "term", "edge_seq")


def adjacency(nodes: DataFrame, edges: DataFrame, clause_id) -> DataFrame:
    """A8. Outgoing edges of one clause with their band."""
    return _named(edges.where(F.col("src") == clause_id), nodes).select("dst", "dst_heading", "type", "score", score_label("score").alias("band"), "edge_seq")


def ego(nodes: DataFrame, edges: DataFrame, centre: DataFrame, hops: int = 2, types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """A9. Nodes within `hops` of centre's ids, whatever the types, and the edges among them of the types."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = centre.select("id").distinct()
    for _ in range(hops):
        near = seen.select(F.col("id").alias("src")).join(both, "src").select(F.col("dst").alias("id"))
        seen = seen.union(near).distinct()
    kept = edges.join(seen.select(F.col("id").alias("src")), "src", "left_semi").join(seen.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.join(seen, "id", "left_semi"), kept.where(F.col("type").isin(*types)) if types else kept


def ego_rows(edges: DataFrame, clause_id) -> DataFrame:
    """A10. Outgoing, then incoming edges; the reason falls back to the term."""
    why = F.coalesce("reason", "term", F.lit("")).alias("reason")
    out = edges.where(F.col("src") == clause_id).select(F.lit("out").alias("direction"), F.col("dst").alias("id"), "type", "score", why, "edge_seq")
    into = edges.where(F.col("dst") == clause_id).select(F.lit("in").alias("direction"), F.col("src").alias("id"), "type", "score", why, "edge_seq")
    return out.unionByName(into)


def filtered(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...], drop_isolates: bool = True) -> tuple[DataFrame, DataFrame]:
    """A11."""
    kept = edges.where(F.col("type").isin(*types))
    return (nodes.join(_ends(kept), "id", "left_semi") if drop_isolates else nodes), kept


def severity_rank(col: str = "severity"):
    """High, medium, low; others come last."""
    return F.when(F.col(col) == "HIGH", 0).when(F.col(col) == "MEDIUM", 1).when(F.col(col) == "LOW", 2).otherwise(3)


def worst_severity(risks: DataFrame) -> DataFrame:
    """A12. clause_id, severity, rank."""
    worst = risks.groupBy("clause_id").agg(F.min(F.struct(severity_rank().alias("rank"), "severity")).alias("w"))
    return worst.select("clause_id", "w.severity", "w.rank")


def hotspots(nodes: DataFrame, edges: DataFrame, risks: DataFrame) -> DataFrame:
    """A13. Risky clauses that are nodes: id, heading, severity, degree, place by (rank, -degree, node_seq).

    The places are a running number over the result, which is as long as the list of risky clauses.
    """
    rows = degrees(nodes, edges).join(worst_severity(risks).withColumnRenamed("clause_id", "id"), "id")
    return rows.select("id", "heading", "severity", "rank", "degree", "node_seq").orderBy("rank", F.desc("degree"), "node_seq")


# Colours.
EDGE_COLOURS = {"SIMILAR_TO": "#9aa0a6", "DEPENDS_ON": "#1a73e8", "CONFLICTS_WITH": "#d93025", "OVERRIDES": "#f9ab00", "DEFINES": "#188038", "USES": "#9334e6"}
SEVERITY_COLOURS = {"HIGH": "#d93025", "MEDIUM": "#f9ab00", "LOW": "#188038"}


def visuals(nodes: DataFrame, edges: DataFrame, risks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A14. Node sizes by degree and colours by worst severity; edge widths by score and colours by type."""
    d = degrees(nodes, edges).withColumn("size", 12 + F.least(3 * F.col("degree"), F.lit(30)))
    colour = F.lit("#5f6368")
    if risks is not None:
        d = d.join(worst_severity(risks).withColumnRenamed("clause_id", "id"), "id", "left")
        for k, v in SEVERITY_COLOURS.items():
            colour = F.when(F.col("severity") == k, v).otherwise(colour)
    shade = F.lit("#9aa0a6")
    for k, v in EDGE_COLOURS.items():
        shade = F.when(F.col("type") == k, v).otherwise(shade)
    return d.withColumn("colour", colour), edges.withColumn("width", 1 + 3 * F.col("score")).withColumn("colour", shade)


def running_place(rows: DataFrame, key: str, *order) -> DataFrame:
    """Places of rows inside a key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
