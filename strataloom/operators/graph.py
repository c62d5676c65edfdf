"""The typed clause graph: nodes, edges and their upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.parsing import lenient_array, readable_array
from ..functions.text import first_chars
from ..storage import stored

RELATION_REPLY = "array<struct<source:string,target:string,type:string,score:double,reason:string>>"


def nodes_of(clauses: DataFrame) -> DataFrame:
    """G1. One node per clause, in clause order; missing attributes get their defaults."""
    return clauses.select(
        "id", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("section", F.lit("")).alias("section"),
        F.coalesce("idx", F.lit(-1)).alias("idx"), F.array().cast("array<string>").alias("defined_terms"), F.col("pos").alias("node_seq"),
    )


def similar_edges(near: DataFrame, threshold: float = K.SIMILAR_DISTANCE) -> DataFrame:
    """G2. SIMILAR_TO in both directions for each unordered pair of src, dst, distance, seq; the first seen counts."""
    pairs = near.where(F.col("distance") <= threshold).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "src", "dst", "distance", "seq")
    first = pairs.groupBy("a", "b").agg(F.min_by(F.struct("src", "dst", "distance", "seq"), "seq").alias("p")).select("p.*")
    score, none = F.round(1 - F.col("distance"), 4), F.lit(None).cast("string")
    ahead = first.select("src", "dst", F.lit("SIMILAR_TO").alias("type"), score.alias("score"), none.alias("term"), none.alias("reason"), (F.col("seq") * 2).alias("edge_seq"))
    back = first.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("SIMILAR_TO").alias("type"), score.alias("score"), none.alias("term"), none.alias("reason"), (F.col("seq") * 2 + 1).alias("edge_seq"))
    return ahead.unionByName(back)


def pairs_to_classify(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """G3. Unordered SIMILAR_TO pairs with both ends known; a is the node inserted earlier."""
    ends = nodes.select("id", "node_seq", "heading", "text")
    a = ends.select(F.col("id").alias("a"), F.col("node_seq").alias("a_seq"), F.col("heading").alias("a_heading"), F.col("text").alias("a_text"))
    b = ends.select(F.col("id").alias("b"), F.col("node_seq").alias("b_seq"), F.col("heading").alias("b_heading"), F.col("text").alias("b_text"))
    found = edges.where("type = 'SIMILAR_TO'").select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge_seq")
    return found.join(a, "a").join(b, "b").where("a_seq < b_seq")


def relation_prompt():
    """G4. Asks for a JSON array of source, target (A or B), type, score and reason."""
    asked = F.lit("Name the relations between clauses A and B. Reply with a JSON array of objects with the keys source and target (A or B), type (DEPENDS_ON, CONFLICTS_WITH or OVERRIDES), score (0.5 to 1) and reason.\n\nA: ")
    return F.concat(asked, F.col("a_heading"), F.lit("\n"), F.col("a_text"), F.lit("\n\nB: "), F.col("b_heading"), F.lit("\n"), F.col("b_text"))


def classified_edges(replies: DataFrame) -> DataFrame:
    """G4. Edges of replies (a, b, edge_seq, reply): other source than A means B, other target than B means A.

    Self pairs go; a missing score is 0.5; an unreadable reply or an item without type voids its pair. Reasons
    are kept.
    """
    items = lenient_array("reply", RELATION_REPLY)
    good = F.coalesce(readable_array("reply"), F.lit(False)) & ~F.exists(items, lambda i: i.isNull() | i["type"].isNull())
    rows = replies.where(good).select("a", "b", "edge_seq", F.posexplode(items).alias("k", "i"))
    ends = rows.withColumn("src", F.when(F.col("i.source") == "A", F.col("a")).otherwise(F.col("b"))).withColumn("dst", F.when(F.col("i.target") == "B", F.col("b")).otherwise(F.col("a")))
    return ends.where("src <> dst").select(
        "src", "dst", F.col("i.type").alias("type"), F.coalesce("i.score", F.lit(0.5)).alias("score"), F.lit(None).cast("string").alias("term"),
        first_chars(F.col("i.reason"), 200).alias("reason"), (F.col("edge_seq") * 1000 + F.col("k")).alias("edge_seq"),
    )


def upsert_edges(*stages: DataFrame) -> DataFrame:
    """G5. One edge per (src, dst): type, score and reason of the last write, place of the first.

    Stages are written one after another, each in order of its edge_seq; a term or reason once set stays until
    another is written.
    """
    rows = None
    for number, stage in enumerate(stages):
        one = stage.withColumn("w", F.struct(F.lit(number).alias("stage"), F.col("edge_seq").alias("seq")))
        rows = one if rows is None else rows.unionByName(one)
    merged = rows.groupBy("src", "dst").agg(
        F.max_by(F.struct("type", "score"), "w").alias("v"),
        F.max_by("term", F.when(F.col("term").isNotNull(), F.col("w"))).alias("term"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("w"))).alias("reason"),
        F.min("w").alias("first"),
    )
    return merged.select("src", "dst", "v.type", "v.score", "term", "reason", (F.col("first.stage").cast("long") * (1 << 48) + F.col("first.seq")).alias("edge_seq"))


def build_graph(clauses: DataFrame, near: DataFrame, threshold: float = K.SIMILAR_DISTANCE, model=None) -> tuple[DataFrame, DataFrame]:
    """G6. Nodes and edges: similar pairs, their classification by the model if there is one, terms and their uses."""
    from .terms import add_terms, clause_terms, merge_uses, uses

    nodes, edges = nodes_of(clauses), similar_edges(near, threshold)
    if model:
        asked = model(pairs_to_classify(edges, nodes).withColumn("prompt", relation_prompt()))
        edges = upsert_edges(edges, classified_edges(asked))
    terms = clause_terms(clauses, model)
    return add_terms(nodes, terms), merge_uses(edges, uses(clauses, terms))


def insert_clause(nodes: DataFrame, edges: DataFrame, clause: DataFrame, near: DataFrame, threshold: float = K.SIMILAR_DISTANCE, model=None) -> tuple[DataFrame, DataFrame]:
    """G7. The graph with one clause more; nothing is stored.

    near has src (the new id), dst, distance and seq. SIMILAR_TO edges are thresholded, but the model classifies
    all neighbours; the new clause is A. Its own terms are noted; uses of them by others, and of others' terms
    by it, are added.
    """
    from .terms import add_terms, clause_terms

    last = nodes.agg(F.max("node_seq")).first()[0]
    fresh = nodes_of(clause).withColumn("node_seq", F.lit(0 if last is None else last + 1).cast("long"))
    everyone = nodes.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)
    stages = [edges, similar_edges(near, threshold)]
    if model:
        a = fresh.select(F.col("id").alias("a"), F.col("heading").alias("a_heading"), F.col("text").alias("a_text"))
        b = nodes.select(F.col("id").alias("b"), F.col("heading").alias("b_heading"), F.col("text").alias("b_text"))
        pairs = near.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("seq").alias("edge_seq")).join(a, "a").join(b, "b")
        stages.append(classified_edges(model(pairs.withColumn("prompt", relation_prompt()))))
    return add_terms(everyone, clause_terms(clause, model)), upsert_edges(*stages)


def insert_clauses(nodes: DataFrame, edges: DataFrame, clauses: DataFrame, near: DataFrame, threshold: float = K.SIMILAR_DISTANCE, model=None) -> tuple[DataFrame, DataFrame]:
    """G7 for many clauses: the rows of nodes and edges that are new or change; all others stay as they are.

    near has src (a new id), dst, distance and seq, of clauses before it. A node that is written again gets the new
    attributes and keeps its place and the terms it had.
    """
    from .terms import add_terms, clause_terms

    fresh = add_terms(nodes_of(clauses), clause_terms(clauses, model))
    held = nodes.select(F.col("id").alias("h_id"), F.col("defined_terms").alias("h_terms"), F.col("node_seq").alias("h_seq"))
    none = F.array().cast("array<string>")
    changed = fresh.join(held, F.col("id") == F.col("h_id"), "left").select(
        "id", "heading", "text", "section", "idx", F.array_union(F.coalesce("h_terms", none), F.coalesce("defined_terms", none)).alias("defined_terms"), F.coalesce("h_seq", "node_seq").alias("node_seq")
    )
    stages = [similar_edges(near, threshold)]
    if model:
        a = fresh.select(F.col("id").alias("a"), F.col("heading").alias("a_heading"), F.col("text").alias("a_text"))
        b = nodes.unionByName(fresh).dropDuplicates(["id"]).select(F.col("id").alias("b"), F.col("heading").alias("b_heading"), F.col("text").alias("b_text"))
        pairs = near.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("seq").alias("edge_seq")).join(a, "a").join(b, "b")
        stages.append(stored(classified_edges(model(pairs.withColumn("prompt", relation_prompt()))), "classified"))
    keys = reduce(DataFrame.union, [s.select("src", "dst") for s in stages]).distinct()
    return changed, upsert_edges(edges.join(keys, ["src", "dst"], "left_semi").select(*edges.columns), *stages)
