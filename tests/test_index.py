"""The inverted-file index, walks at hubs, and cached results."""

import random
from collections import deque

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from strataloom.operators import ivf, keyed, nearest, traversal, vectors
from strataloom.sources.cache import ResultCache, versions
from strataloom.sources.logstore import Keyed, LogStore


def clustered(spark, n=600, size=12, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, size))
    rows = [(i, (centres[i % 9] + 0.4 * r.normal(size=size)).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(40)] + [(n + 40, None), (n + 41, [0.0] * size)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)


def pairs(df):
    return sorted((r["query"], r["id"], round(r["distance"], 9), r["rank"]) for r in df.collect())


def test_exact_search_and_recall(spark, monkeypatch):
    monkeypatch.setattr(ivf, "BLOCK", 25)  # lists of several parts, blocks of some rows
    v = clustered(spark)
    index = ivf.build_index(v, lists=10)
    assert index.blocks.agg(F.sum(F.size("vi"))).first()[0] == v.where("embedding is not null").count()
    assert index.sizes.agg(F.max("parts")).first()[0] > 1
    asked = v.where("id % 7 = 0")
    exact = pairs(vectors.topk_join(asked, v, 4))
    assert pairs(ivf.index_search(asked, index, 4, probes=1, exact=True)) == exact
    assert pairs(ivf.index_search(asked, index, 4, probes=index.n_lists)) == exact
    probes, recall = ivf.measured_probes(v, index, 4, 0.9)
    assert 1 <= probes < index.n_lists and recall >= 0.9
    near = {p[:2] for p in pairs(ivf.index_search(v, index, 4, probes, other=True))}
    true = {p[:2] for p in pairs(vectors.topk_join(v, v, 4, other=True))}
    assert len(near & true) >= 0.9 * len(true)


def test_search_of_few_and_none(spark):
    none = spark.createDataFrame([(1, None)], "id long, embedding array<double>")
    index = ivf.build_index(none)
    assert ivf.index_search(none, index).isEmpty() and ivf.measured_probes(none, index) == (1, 1.0)
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    assert len(pairs(ivf.index_search(two, ivf.build_index(two), 5, exact=True))) == 4


def test_vectors_before(spark):
    v = clustered(spark, 60).where("embedding is not null").withColumn("pos", F.col("id") * 3)
    got = {(r["query"], r["id"]) for r in vectors.topk_join(v, v, 3, before="pos").collect()}
    rows = {r["id"]: np.array(r["embedding"]) for r in v.collect()}
    unit = {i: x / np.linalg.norm(x) if x.any() else x for i, x in rows.items()}
    want = {(q, i) for q in unit for _, i in sorted((round(1 - unit[q] @ unit[i], 12), i) for i in unit if i < q)[:3]}
    assert got == want


def naive_walk(edges, start, hops):
    out, queue, seen = {}, deque([(start, 0)]), {start}
    while queue:
        at, hop = queue.popleft()
        if hop == hops:
            continue
        for _, dst, score, seq in sorted((e for e in edges if e[0] == at), key=lambda e: e[3]):
            if dst not in seen:
                seen.add(dst)
                out[dst] = (hop + 1, score, seq)
                queue.append((dst, hop + 1))
    return out


def test_walks_at_hubs(spark, monkeypatch):
    r = random.Random(8)
    edges = [(f"n{r.randrange(40)}", f"n{r.randrange(120)}", round(r.random(), 2), i) for i in range(200)]
    edges += [("hub", f"n{i}", 0.5, 1000 + i) for i in range(120)] + [(f"n{i}", "hub", 0.6, 2000 + i) for i in range(0, 120, 3)]
    df = spark.createDataFrame([(s, d, "DEPENDS_ON", w, None, n) for s, d, w, n in edges], "src string, dst string, type string, score double, reason string, edge_seq long")
    starts = spark.createDataFrame([("n1",), ("n3",), ("hub",), ("nowhere",), ("n1",)], "id string")
    monkeypatch.setattr(traversal, "HOT_KEYS", 8)
    monkeypatch.setattr(keyed, "HOT_KEYS", 8)
    got = {}
    for row in traversal.walk(df, starts, "DEPENDS_ON", 3).collect():
        got.setdefault(row["start"], {})[row["id"]] = (row["hop"], row["score"])
    for start in ("n1", "n3", "hub"):
        assert got[start] == {i: x[:2] for i, x in naive_walk(edges, start, 3).items()}, start
    assert "nowhere" not in got


def test_a_new_ingest_never_serves_old_results(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"), {"a": Keyed("k long, v string", ("k",)), "b": Keyed("k long", ("k",))})
    cache, runs = ResultCache(spark, str(tmp_path / "cache")), []

    def risks(**parameters):
        def compute():
            runs.append(1)
            return store.read("a").withColumn("risk", F.concat(F.lit("risk of "), "v"))

        return {r["risk"] for r in cache.get("risks", versions(store, "a"), compute, **parameters).collect()}

    def put(table, *rows):
        store.write({table: spark.createDataFrame(list(rows), "k long, v string" if table == "a" else "k long")})

    put("a", (1, "old"))
    assert risks() == {"risk of old"} == risks() and len(runs) == 1
    assert risks(model="other") == {"risk of old"} and len(runs) == 2
    put("b", (1,))
    store.compact()
    assert risks() == {"risk of old"} == risks(model="other") and len(runs) == 2  # the table itself did not change
    put("a", (1, "new"))
    assert risks() == {"risk of new"} == risks(model="other") and len(runs) == 4
    assert sum(p.is_dir() for p in (tmp_path / "cache" / "risks").iterdir()) == 2  # the old ones are gone
    assert risks() == {"risk of new"} and len(runs) == 4
    cache.clear("risks")
    assert risks() == {"risk of new"} and len(runs) == 5


def test_queries_are_not_copied_per_list(spark, monkeypatch):
    """Each query is one row of either pass, however many lists it reads: its copies per list did not fit in memory."""
    r = np.random.default_rng(11)
    v = spark.createDataFrame([(i, r.normal(size=16).tolist()) for i in range(3000)], "id long, embedding array<float>").repartition(1)
    index, met = ivf.build_index(v, lists=200), []
    monkeypatch.setattr(ivf, "meet", lambda q, *a: met.append(q.agg(F.sum(F.size("i"))).first()[0]) or nearest.meet(q, *a))
    got = pairs(ivf.index_search(v, index, 3, exact=True, other=True))
    assert got == pairs(vectors.topk_join(v, v, 3, other=True)) and len(got) == 9000
    assert met == [3000, 3000]


@pytest.mark.parametrize("kind", [int, str])
def test_nearest_of_blocks(kind):
    """Ties by id over blocks, zero rows, rows that are no numbers, hidden pairs, and a limit, against a plain search."""
    r = np.random.default_rng(5)
    m = nearest.unit_rows(np.vstack([r.normal(size=(90, 6)), np.repeat(r.normal(size=(3, 6)), 30, axis=0), np.zeros((4, 6)), np.full((2, 6), np.nan)]))
    ids = np.array([kind(x) for x in r.permutation(len(m))], np.int64 if kind is int else object)
    limit = np.where(np.arange(len(m)) % 9 == 4, 0.3, np.inf)
    near = nearest.Nearest(ids, m, 7, limit)
    for at in range(0, len(m), 40):
        near.meet(ids[at : at + 40], m[at : at + 40], True, lambda rows, columns, at=at: (np.arange(len(m))[rows, None] + columns + at) % 11 == 0)
    got = {}
    for q, i, d in near.rows():
        for x in zip(q.tolist(), i.tolist(), d.tolist(), strict=True):
            got.setdefault(x[0], []).append((round(x[2], 9), x[1]))
    want = {}
    for a, q in enumerate(ids.tolist()):
        d = [(abs(round(1 - float(m[a] @ m[b]), 9)), i) for b, i in enumerate(ids.tolist()) if i != q and (a + b) % 11 and np.isfinite(m[a] @ m[b])]
        if found := sorted(x for x in d if x[0] <= limit[a])[:7]:
            want[q] = found
    assert {q: [(abs(d), i) for d, i in x] for q, x in got.items()} == want


def test_similarities_with_centres_are_cut(monkeypatch):
    """An executor holds similarities of a slice with all centres, not of a batch of 10,000 vectors."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(2_345))], names=["id"])
    got = list(ivf._slices([batch, batch.slice(0, 0), batch.slice(0, 10)]))
    assert [b.num_rows for b in got] == [ivf.SLICE, ivf.SLICE, 345, 10]
    monkeypatch.setattr(ivf, "SLICE", 2_000)
    assert [b.num_rows for b in ivf._slices([batch])] == [2_000, 345]


def test_queries_stay_in_bounded_groups(spark, monkeypatch):
    """Groups of few queries and parts of few vectors, each met in a task of its own, give what one plain search gives."""
    monkeypatch.setattr(nearest, "GROUP_BYTES", 1)
    monkeypatch.setattr(nearest, "PART", 1)
    v = clustered(spark, 300).repartition(7)
    cells = []
    monkeypatch.setattr(DataFrame, "repartitionById", lambda df, n, key, f=DataFrame.repartitionById: cells.append(n) or f(df, n, key))
    got = pairs(vectors.topk_join(v, v, 4, other=True))
    rows = {r["id"]: np.array(r["embedding"]) for r in v.where("embedding is not null").collect()}
    ids, unit = np.array(list(rows)), nearest.unit_rows(np.stack(list(rows.values())))
    want = []
    for q, u in zip(ids.tolist(), unit, strict=True):
        near = sorted((abs(round(1 - float(u @ w), 9)), i) for i, w in zip(ids.tolist(), unit, strict=True) if i != q)[:4]
        want += [(q, i, d, rank + 1) for rank, (d, i) in enumerate(near)]
    assert [(q, i, abs(d), r) for q, i, d, r in got] == sorted(want)
    assert cells[0] >= 14


def test_few_pairs_need_a_distance(monkeypatch):
    """Of a self-join's pairs all but a few are told far by single precision alone, in one room for all tiles."""
    r = np.random.default_rng(2)
    m, asked, rooms = nearest.unit_rows(r.normal(size=(12_000, 32))), [], set()
    monkeypatch.setattr(nearest.Nearest, "_add", lambda self, line, *a, f=nearest.Nearest._add: asked.append(len(line)) or f(self, line, *a))
    monkeypatch.setattr(np, "matmul", lambda a, b, out, f=np.matmul: rooms.add(out.ctypes.data) or f(a, b, out=out))
    near = nearest.Nearest(np.arange(1_000), m[:1_000], 5)
    near.meet(np.arange(12_000), m, True)
    assert sum(asked) < 0.002 * 12_000_000 and len(rooms) == 1
    for q in range(0, 1_000, 97):
        d = np.round(1 - m @ m[q], 9)
        assert near.found[q].tolist() == [i for i in np.lexsort((np.arange(12_000), d)) if i != q][:5]
