"""Vectors, graph building, walks and statistics."""

import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import graph as G
from strataloom.operators import insight as I
from strataloom.operators import traversal as V
from strataloom.operators import vectors as X

EDGE = "src string, dst string, type string, score double, term string, reason string, edge_seq long"


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, t, s, None, None, n) for n, (a, b, t, s) in enumerate(rows)], EDGE)


def nodes_of(spark, ids):
    return spark.createDataFrame([(i, i.upper(), "t", "1", n) for n, i in enumerate(ids)], "id string, heading string, text string, section string, node_seq long")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_topk_matches_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(200, [0.0] * 8), (201, None)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    got = {(x["query"], x["rank"]): x["id"] for x in X.topk_join(v.where("id < 10"), v, 4, other=True).collect()}
    m = {i: [float(x) for x in e] for i, e in rows if e}

    def cos(a, b):
        na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na and nb else 0.0

    for q in range(10):
        want = sorted((round(1 - cos(m[q], m[i]), 6), i) for i in m if i != q)[:4]
        assert [got[q, k + 1] for k in range(4)] == [i for _, i in want]


def test_similar_edges_first_seen(spark):
    near = spark.createDataFrame([("a", "b", 0.1, 0), ("b", "a", 0.2, 1), ("a", "c", 0.3, 2)], "src string, dst string, distance double, seq long")
    got = sorted((r["src"], r["dst"], r["score"]) for r in G.similar_edges(near).collect())
    assert got == [("a", "b", 0.9), ("b", "a", 0.9)]


def test_upsert_and_classification(spark):
    e = edges_of(spark, [("a", "b", "SIMILAR_TO", 0.9), ("b", "a", "SIMILAR_TO", 0.9)])
    replies = spark.createDataFrame([("a", "b", 0, '[{"source": "A", "target": "B", "type": "DEPENDS_ON", "score": 0.8, "reason": "r"}, {"source": "A", "target": "A", "type": "X"}]'), ("a", "c", 1, "no")], "a string, b string, edge_seq long, reply string")
    merged = {(r["src"], r["dst"]): (r["type"], r["score"], r["reason"]) for r in G.upsert_edges(e, G.classified_edges(replies)).collect()}
    assert merged == {("a", "b"): ("DEPENDS_ON", 0.8, "r"), ("b", "a"): ("SIMILAR_TO", 0.9, None)}
    again = G.upsert_edges(G.upsert_edges(e, e), e)
    assert again.count() == 2


def test_walk_diamond_and_cycle(spark):
    e = edges_of(spark, [("s", "a", "D", 0.5), ("s", "b", "D", 0.9), ("b", "x", "D", 0.8), ("a", "x", "D", 0.3), ("x", "s", "D", 0.9), ("x", "y", "D", 0.4), ("s", "z", "E", 1.0)])
    got = V.walk(e, ids(spark, "s"), "D", 2).orderBy("rank").collect()
    # x is discovered through a, whose edge comes first
    assert [(r["id"], r["hop"], r["score"]) for r in got] == [("b", 1, 0.9), ("a", 1, 0.5), ("x", 2, 0.3)]
    assert {r["id"] for r in V.walk(e, ids(spark, "x"), "D", 5, forward=False).collect()} == {"a", "b", "s"}


def test_walk_minimal_hops(spark):
    r = random.Random(2)
    names = [f"n{i}" for i in range(15)]
    rows = [(a, b, "D", 0.5) for a in names for b in names if a != b and r.random() < 0.12]
    got = {(x["start"], x["id"]): x["hop"] for x in V.walk(edges_of(spark, rows), ids(spark, *names[:5]), "D", 3).collect()}
    want = {}
    for s in names[:5]:
        level, seen = {s}, {s}
        for hop in (1, 2, 3):
            level = {b for a, b, *_ in rows if a in level} - seen
            seen |= level
            want |= {(s, x): hop for x in level}
    assert got == want


def test_conflicts_prefer_outgoing_and_impact(spark):
    e = edges_of(spark, [("b", "a", "CONFLICTS_WITH", 0.9), ("a", "b", "CONFLICTS_WITH", 0.6), ("c", "a", "CONFLICTS_WITH", 0.8), ("d", "a", "OVERRIDES", 0.4), ("a", "e", "DEPENDS_ON", 0.9)])
    got = [(r["id"], r["score"]) for r in V.conflicts(e, ids(spark, "a")).orderBy("rank").collect()]
    assert got == [("c", 0.8), ("b", 0.6)]
    report = {r["start"]: r for r in V.impact(nodes_of(spark, "abcde"), e, ids(spark, "a", "q")).collect()}
    assert report["a"]["total_affected"] == 2 and report["q"]["error"] == "Unknown clause: q" and not report["q"]["changes"]
    assert [c.split(":")[0].split(" ")[0] for c in report["a"]["changes"]] == ["Ensure", "CONFLICT", "CONFLICT", "WARNING"]


@pytest.mark.parametrize("n", [1, 40])
def test_components_of_paths(spark, n):
    names = [f"{i:03d}" for i in range(n)]
    e = edges_of(spark, [(a, b, "D", 1.0) for a, b in zip(names, names[1:], strict=False)])
    got = I.components(nodes_of(spark, [*names, "zz"]), e).collect()
    assert {r["component"] for r in got} == {"000", "zz"}


def test_insight(spark):
    n, e = nodes_of(spark, "abcd"), edges_of(spark, [("a", "b", "D", 0.9), ("b", "c", "E", 0.5), ("c", "a", "D", 0.1)])
    assert [r["id"] for r in I.isolates(n, e).collect()] == ["d"]
    assert [(r["id"], r["degree"]) for r in I.top_degrees(n, e, 2).collect()] == [("a", 2), ("b", 2)]
    risks = spark.createDataFrame([("a", "LOW"), ("a", "HIGH"), ("d", "ODD"), ("x", "HIGH")], "clause_id string, severity string")
    assert [(r["id"], r["severity"], r["degree"]) for r in I.hotspots(n, e, risks).collect()] == [("a", "HIGH", 2), ("d", "ODD", 0)]
    nodes, kept = I.ego(n, e, ids(spark, "a"), 1, ("D",))
    assert sorted(r["id"] for r in nodes.collect()) == ["a", "b", "c"] and kept.count() == 2
    assert [r["direction"] for r in I.ego_rows(e, "a").orderBy(F.desc("direction")).collect()] == ["out", "in"]
    sized, drawn = I.visuals(n, e, risks)
    assert sized.where("id = 'a'").first()["size"] == 18 and drawn.count() == 3


def _brute_components(pairs):
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {x: find(x) for x in least}


def test_connected_components(spark):
    import random

    from strataloom.operators.components import connected_components

    r = random.Random(5)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(5_000, 1_000 + i) for i in range(700)]  # its hub has the largest id, and most of all edges
    other = [(r.randint(100, 400), r.randint(100, 400)) for _ in range(150)]
    pairs = [(a, b) for a, b in [*chain, *star, *other, (7, 7)] if a != b]
    frame = spark.createDataFrame([*pairs, (9_999, 9_999), (None, 3)], "src long, dst long")
    got = {x["node"]: x["component"] for x in connected_components(frame, "src", "dst").collect()}
    assert got == _brute_components(pairs)
    assert connected_components(frame.where("false"), "src", "dst").count() == 0
    texts = spark.createDataFrame([("b", "c"), ("a", "b")], "src string, dst string")
    assert {x["component"] for x in connected_components(texts, "src", "dst").collect()} == {"a"}


def test_components_that_do_not_settle_raise(spark):
    import pytest

    from strataloom.operators.components import connected_components

    with pytest.raises(RuntimeError):
        connected_components(spark.range(40).selectExpr("id as a", "id + 1 as b"), most_rounds=1)


def test_split_join_keeps_all_rows(spark):
    from pyspark.sql import functions as F

    from strataloom.operators.keyed import split_join

    rows = spark.createDataFrame([(None, 0)] + [(1, i) for i in range(500)] + [(i, i) for i in range(2, 300)], "k long, v long")
    values = rows.where("k <> 299").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("k") * 2)
    left = {(x["k"], x["v"], x["w"]) for x in split_join(rows, values, "k", "n", 799, "left").collect()}
    assert left == {(k, v, None if k in (None, 299) else 2 * k) for k, v in map(tuple, rows.collect())}
    inner = split_join(rows, values, "k", "n", 799).select("k", "v")
    assert sorted(map(tuple, inner.collect())) == sorted((k, v) for k, v in map(tuple, rows.collect()) if k not in (None, 299))
