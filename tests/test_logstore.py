"""The log-structured store, idempotent stream inserts, and consecutive numbers."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from strataloom.operators.numbering import numbered
from strataloom.providers import hashed_embeddings
from strataloom.sources.logstore import Conflict, Keyed, LogStore, _fields
from strataloom.sources.stores import clause_base
from strataloom.streaming.inserts import insert_batch, stream_inserts

TABLES = {"a": Keyed("k long, v string, x array<struct<p:int,q:int>>", ("k",)), "b": Keyed("s string, t string, n int", ("s", "t"))}
EMBED = hashed_embeddings(16)


def rows(spark, pairs):
    return spark.createDataFrame([(k, v, [(1, 2)]) for k, v in pairs], TABLES["a"].schema)


def content(df):
    return {r["k"]: r["v"] for r in df.collect()}


def files(path):
    return {p.name for p in (path / "data").iterdir()} if (path / "data").exists() else set()


def test_newest_wins_and_appends_write_their_own_rows(spark, tmp_path):
    s = LogStore(spark, str(tmp_path), TABLES, buckets=4, most_deltas=3)
    assert s.read("a").isEmpty() and s.version() == 0 and s.changed("a") == 0
    s.write({"a": rows(spark, [(i, "old") for i in range(50)])})
    before = files(tmp_path)
    s.write({"a": rows(spark, [(3, "new"), (60, "new")])})
    (added,) = files(tmp_path) - before
    assert spark.read.parquet(str(tmp_path / "data" / added)).count() == 2 and before <= files(tmp_path)
    want = {i: "old" for i in range(50)} | {3: "new", 60: "new"}
    assert content(s.read("a")) == want and content(s.read("a", 1)) == {i: "old" for i in range(50)}
    s.write({}, gone={"a": rows(spark, [(4, ""), (99, "")])})
    del want[4]
    assert content(s.read("a")) == want
    assert s.lookup("a", 3).first()["v"] == "new" and s.lookup("a", 4).isEmpty() and s.lookup("a", 5).first()["x"] == [(1, 2)]
    changed = s.changed("a")
    s.compact()
    assert content(s.read("a")) == want and s.state()["tables"]["a"]["deltas"] == [] and s.changed("a") == changed
    assert s.vacuum() > 0 and content(s.read("a")) == want


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    s = LogStore(spark, str(tmp_path), TABLES, buckets=8)
    s.write({"a": rows(spark, [(i, "old") for i in range(80)])})
    s.compact()
    first = s.state()["tables"]["a"]["base"]
    s.write({"a": rows(spark, [(7, "new")])})
    s.compact()
    now = s.state()["tables"]["a"]["base"]
    assert len(first) == 8 and sum(now[b] != first[b] for b in first) == 1
    assert content(s.read("a")) == {i: "new" if i == 7 else "old" for i in range(80)}


def test_random_writes_equal_a_dict(spark, tmp_path):
    s, r, want = LogStore(spark, str(tmp_path), TABLES, buckets=3, most_deltas=2), random.Random(4), {}
    for step in range(7):
        new = {r.randrange(20): f"s{step}" for _ in range(6)}
        gone = {r.randrange(20) for _ in range(2)} - set(new)
        s.write({"a": rows(spark, new.items())}, gone={"a": rows(spark, [(k, "") for k in gone])} if gone else None)
        want = {k: v for k, v in {**want, **new}.items() if k not in gone}
        assert content(s.read("a")) == want


def test_order_decides_within_a_write(spark, tmp_path):
    s = LogStore(spark, str(tmp_path), TABLES)
    df = rows(spark, [(1, "x"), (1, "z"), (1, "y")]).withColumn("at", F.col("v"))
    s.write({"a": df}, order={"a": "at"})
    assert content(s.read("a")) == {1: "z"}


def test_half_a_write_is_no_write(spark, tmp_path, monkeypatch):
    s = LogStore(spark, str(tmp_path), TABLES)
    s.write({"a": rows(spark, [(1, "old")]), "b": spark.createDataFrame([("s", "t", 1)], TABLES["b"].schema)})
    monkeypatch.setattr(LogStore, "_commit", lambda self, state: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        s.write({"a": rows(spark, [(1, "new")]), "b": spark.createDataFrame([("s", "t", 2)], TABLES["b"].schema)})
    monkeypatch.undo()
    again = LogStore(spark, str(tmp_path), TABLES)
    assert content(again.read("a")) == {1: "old"} and again.read("b").first()["n"] == 1
    assert again.vacuum() == 2 and content(again.read("a")) == {1: "old"}


def test_versions_are_taken_once_and_epochs_count_once(spark, tmp_path):
    s = LogStore(spark, str(tmp_path), TABLES)
    s.write({"a": rows(spark, [(1, "one")])}, writer="w", epoch=3)
    stale = s.state()
    assert s.write({"a": rows(spark, [(1, "again")])}, writer="w", epoch=3) == 1 and content(s.read("a")) == {1: "one"}
    s.write({"a": rows(spark, [(1, "two")])}, writer="w", epoch=4)
    with pytest.raises(Conflict):
        s._commit(stale)
    assert content(s.read("a")) == {1: "two"} and s.seen("w", 4) and not s.seen("w", 5) and not s.seen("v", 0)


def test_clear_and_fields(spark, tmp_path):
    s = LogStore(spark, str(tmp_path), TABLES)
    s.write({"a": rows(spark, [(1, "one")])})
    s.write({"a": rows(spark, [(2, "two")])}, clear=("a",))
    assert content(s.read("a")) == {2: "two"}
    assert _fields("k long, x array<struct<p:int,q:map<int,int>>>, y int") == ["k long", "x array<struct<p:int,q:map<int,int>>>", "y int"]


WORDS = "the board decides on all matters of the college and its members alone or with others".split()
CLAUSES = "id string, heading string, text string, section string, idx int, pos long"


def clauses(spark, n=24):
    r = random.Random(9)
    return [(f"c{i}", f"h{i}", " ".join(r.choice(WORDS) for _ in range(12)), "1", i, i) for i in range(n)]


def tables(base):
    return {t: sorted(map(str, base[0].log.read(t).collect())) for t in ("vectors", "nodes", "edges")}


def test_any_cut_into_batches_is_one_insert(spark, tmp_path):
    """Cuts, one of them with a replayed batch, against one insert."""
    made = clauses(spark)
    told = {}
    for name, cuts in (("one", [24]), ("three", [5, 6, 24])):
        base, last = clause_base(spark, str(tmp_path / name)), 0
        for epoch, cut in enumerate(cuts):
            part = spark.createDataFrame(made[last:cut], CLAUSES)
            for _ in range(2 if epoch == 1 else 1):
                insert_batch(part, EMBED, *base, threshold=0.3, writer="t", epoch=epoch)
            last = cut
        told[name] = tables(base)
    assert told["one"] == told["three"]
    assert len(told["one"]["edges"]) > 20 and len(told["one"]["nodes"]) == 24


def test_replayed_stream(spark, tmp_path):
    """A stream that loses its checkpoint's last commit runs its batch again: nothing changes."""
    made = clauses(spark, 9)
    for i in range(3):
        spark.createDataFrame(made[3 * i : 3 * i + 3], CLAUSES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    base = clause_base(spark, str(tmp_path / "base"))

    def run():
        stream = spark.readStream.schema(CLAUSES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream_inserts(stream, EMBED, *base, str(tmp_path / "cp"), threshold=0.3).awaitTermination()

    run()
    first, version = tables(base), base[0].log.version()
    assert version >= 3
    (tmp_path / "cp" / "commits" / "2").unlink()
    shutil.rmtree(tmp_path / "cp" / "commits" / ".2.crc", ignore_errors=True)
    crc = tmp_path / "cp" / "commits" / ".2.crc"
    if crc.exists():
        crc.unlink()
    run()
    assert tables(base) == first and base[0].log.version() == version
    one = clause_base(spark, str(tmp_path / "one"))
    insert_batch(spark.createDataFrame(made, CLAUSES), EMBED, *one, threshold=0.3)
    assert tables(one) == first


def test_numbers(spark):
    r = random.Random(2)
    values = [(r.choice([None, 1, 2, 3]), str(i)) for i in range(300)]
    got = numbered(spark.createDataFrame(values, "a int, b string").repartition(5), "a", "b", start=10).orderBy("number").collect()
    assert [x["number"] for x in got] == list(range(10, 310))
    assert [(x["a"], x["b"]) for x in got] == sorted(values, key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
