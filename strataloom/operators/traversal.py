"""Bounded walks over typed edges, neighbours by type, and impact reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..storage import stored
from .keyed import HOT_KEYS, split_join
from .numbering import numbered


def score_label(score: str | Column) -> Column:
    """B9."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= K.STRONG, "strong").when(s >= K.MODERATE, "moderate").otherwise("weak")


def score_icon(score: str | Column) -> Column:
    """B10. With the same cut points."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= K.STRONG, "🔴").when(s >= K.MODERATE, "🟡").otherwise("🟢")


def _numbered_steps(steps: DataFrame, total: int) -> DataFrame:
    """Steps with a consecutive number `no` of the node that each leads to."""
    ends = steps.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    return split_join(steps, numbered(ends, "id", name="no"), "id", "times", total)


def walk(edges: DataFrame, starts: DataFrame, kind: str, max_hops: int, forward: bool = True) -> DataFrame:
    """B1. start, id, hop, score, reason, place: nodes reached along edges of one type, from each id of starts.

    Breadth first: each node once, at its smallest hop, by the first edge in queue order, which is the order of
    (parent's place, edge_seq). Levels are joined one by one; a level's places number it inside its start, so
    many starts run as one plan. Each level is stored, so that no hop computes the ones before it again. Results are
    ordered by hop and falling score through `rank`.

    The edges of a hub (a node with over one in HOT_KEYS of all) are parted by salt, and each part meets a copy of the
    frontier's rows there, so no task has a hub's edges alone. What a start has seen is a set of bits: 64 nodes, by
    their numbers, are one long, so a start that has seen much takes a row per 64 nodes.
    """
    here, there = ("src", "dst") if forward else ("dst", "src")
    steps = edges.where(F.col("type") == kind).select(F.col(here).alias("at"), F.col(there).alias("id"), F.coalesce("score", F.lit(0.5)).alias("score"), F.coalesce("reason", F.lit("")).alias("reason"), "edge_seq")
    steps = stored(steps, "walk-steps")
    total = steps.count()
    steps = _numbered_steps(steps, total)
    hubs = steps.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT_KEYS > total)
    hubs = stored(hubs.select(F.col("at").alias("hub"), F.ceil(F.col("n") * HOT_KEYS / max(1, total)).cast("long").alias("parts")), "walk-hubs")  # fewer than HOT_KEYS rows
    part = F.coalesce(F.pmod(F.xxhash64("id", "edge_seq"), F.col("parts")), F.lit(0).cast("long"))
    steps = stored(steps.join(F.broadcast(hubs), F.col("at") == F.col("hub"), "left").withColumn("part", part).drop("hub", "parts"), "walk-steps")

    def bits(rows: DataFrame) -> DataFrame:
        return rows.select("start", F.shiftright("no", 6).alias("word"), F.expr("shiftleft(1L, cast(no & 63 as int))").alias("bit")).groupBy("start", "word").agg(F.bit_or("bit").alias("bits"))

    level = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("place")).distinct()
    own = level.join(steps.select("id", "no").distinct(), "id").select("start", "no")
    seen, found = stored(bits(own), "walk-seen"), None
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))
    for hop in range(1, max_hops + 1):
        frontier = level.select("start", F.col("id").alias("at"), F.col("place").alias("parent")).join(F.broadcast(hubs), F.col("at") == F.col("hub"), "left")
        met = frontier.select("start", "at", "parent", copies.alias("part")).join(steps, ["at", "part"])
        new = met.groupBy("start", "id", "no").agg(F.min(F.struct("parent", "edge_seq", "score", "reason")).alias("e"))
        new = new.withColumn("word", F.shiftright("no", 6)).join(seen, ["start", "word"], "left")
        fresh = F.expr("coalesce(bits, 0L) & shiftleft(1L, cast(no & 63 as int))") == 0
        order = Window.partitionBy("start").orderBy("e.parent", "e.edge_seq", "id")
        level = stored(new.where(fresh).select("start", "id", "no", F.lit(hop).alias("hop"), F.col("e.score").alias("score"), F.col("e.reason").alias("reason"), F.row_number().over(order).alias("place")), "walk-level")
        found = level if found is None else found.unionByName(level)
        if hop < max_hops:
            seen = stored(seen.unionByName(bits(level)).groupBy("start", "word").agg(F.bit_or("bits").alias("bits")), "walk-seen")
    rank = F.row_number().over(Window.partitionBy("start").orderBy("hop", F.desc("score"), "place"))
    return found.drop("no").withColumn("rank", rank)


def dependencies(edges: DataFrame, starts: DataFrame, max_hops: int = 3) -> DataFrame:
    """B2."""
    return walk(edges, starts, "DEPENDS_ON", max_hops)


def dependents(edges: DataFrame, starts: DataFrame, max_hops: int = 3) -> DataFrame:
    """B3."""
    return walk(edges, starts, "DEPENDS_ON", max_hops, forward=False)


def _touching(edges: DataFrame, starts: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    own = edges.where(F.col("type") == kind)
    ids = starts.select(F.col("id").alias("start")).distinct()
    cols = ("start", "id", "score", "reason", "edge_seq")
    out = own.withColumns({"start": F.col("src"), "id": F.col("dst")}).select(*cols).join(ids, "start")
    into = own.withColumns({"start": F.col("dst"), "id": F.col("src")}).select(*cols).join(ids, "start")
    return out, into


def conflicts(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """B4. start, id, score, reason, rank: neighbours either way, once each, the outgoing edge first; by score."""
    out, into = _touching(edges, starts, "CONFLICTS_WITH")
    both = out.withColumn("side", F.lit(0)).unionByName(into.withColumn("side", F.lit(1)))
    once = both.groupBy("start", "id").agg(F.min(F.struct("side", "edge_seq", "score", "reason")).alias("e")).select("start", "id", "e.*")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy(F.desc("score"), "side", "edge_seq"))).select("start", "id", "score", "reason", "rank")


def overrides(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """B5. start, id, direction (overrides or overridden_by), score, reason, rank in order of insertion."""
    out, into = _touching(edges, starts, "OVERRIDES")
    both = out.withColumn("direction", F.lit("overrides")).unionByName(into.withColumn("direction", F.lit("overridden_by")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("start", "direction").orderBy("edge_seq"))).select("start", "id", "direction", "score", "reason", "rank")


def similar(edges: DataFrame, starts: DataFrame, least: float = K.MIN_SIMILAR_SCORE) -> DataFrame:
    """B6. start, id, score, rank."""
    out, _ = _touching(edges.where(F.col("score") >= least), starts, "SIMILAR_TO")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy(F.desc("score"), "edge_seq"))).select("start", "id", "score", "rank")


def change_list(nodes: DataFrame, deps: DataFrame, depd: DataFrame, conf: DataFrame, over: DataFrame) -> DataFrame:
    """B8. start, group, rank, message: dependencies, dependents, conflicts, overriders, in this order."""
    label, head = score_label("score"), F.col("heading")
    q = F.lit("'")
    groups = (
        (1, deps.select("start", "id", "score", "rank", "hop"), F.concat(F.lit("Ensure '"), head, F.lit("' exists and is consistent ("), label, F.lit(" dependency, hop "), F.col("hop").cast("string"), F.lit(")"))),
        (2, depd.select("start", "id", "score", "rank", "hop"), F.concat(F.lit("Review '"), head, F.lit("' — it depends on this clause and may need updating ("), label, F.lit(" link)"))),
        (3, conf.select("start", "id", "score", "rank"), F.concat(F.lit("CONFLICT: '"), head, q, F.lit(" directly contradicts this clause — one must be amended ("), label, F.lit(" conflict)"))),
        (4, over.where("direction = 'overridden_by'").select("start", "id", "score", "rank"), F.concat(F.lit("WARNING: '"), head, F.lit("' already overrides this clause — check precedence rules ("), label, F.lit(" override)"))),
    )
    out = None
    for number, rows, message in groups:
        named = rows.join(nodes.select("id", "heading"), "id", "left").withColumn("heading", F.coalesce("heading", F.lit("")))
        one = named.select("start", F.lit(number).alias("group"), "rank", message.alias("message"))
        out = one if out is None else out.unionByName(one)
    return out


def impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_hops: int = 2) -> DataFrame:
    """B7. One row per start: counts, changes in order, and an error where the clause is unknown."""
    ids = starts.select(F.col("id").alias("start")).distinct()
    deps, depd = dependencies(edges, starts, max_hops), dependents(edges, starts, max_hops)
    conf, over, near = conflicts(edges, starts), overrides(edges, starts), similar(edges, starts)

    def n(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("start").agg(F.count(F.lit(1)).alias(name))

    changes = change_list(nodes, deps, depd, conf, over).groupBy("start").agg(F.array_sort(F.collect_list(F.struct("group", "rank", "message"))).alias("c"))
    out = ids.join(nodes.select(F.col("id").alias("start"), F.lit(True).alias("known")), "start", "left")
    parts = (n(deps, "n_dependencies"), n(depd, "n_dependents"), n(conf, "n_conflicts"), n(over, "n_overrides"), n(near, "n_similar"))
    for part in parts:
        out = out.join(part, "start", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_dependencies", "n_dependents", "n_conflicts", "n_overrides", "n_similar")}
    return out.join(changes, "start", "left").withColumns(counts).select(
        "start", *counts, (F.col("n_dependents") + F.col("n_conflicts")).alias("total_affected"),
        F.coalesce(F.transform("c", lambda x: x["message"]), F.array().cast("array<string>")).alias("changes"),
        F.when(F.col("known").isNull(), F.concat(F.lit("Unknown clause: "), F.col("start"))).alias("error"),
    )
