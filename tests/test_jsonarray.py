"""Elements of large JSON documents by byte ranges."""

import json
import random

import pytest

from strataloom.sources.jsonarray import json_elements, write_document


def document(seed, n):
    r = random.Random(seed)
    text = ["plain", 'quote " and \\ slash', "brace } and { and ]", "été 🙂", "", "a" * 300, '\\"}', "[1, {"]
    item = lambda: {"id": str(r.randrange(1000)), "text": r.choice(text) * r.randrange(3), "inner": [{"x": r.choice(text)} for _ in range(r.randrange(4))], "none": None}
    return {"version": 'v"1}', "other": [1, {"items": [2]}, "x"], "items": [item() for _ in range(n)], "data": {"items": [3, 4], "more": {}}, "last": [], 'odd}"key': [{"id": "z"}]}


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", ["900", "1000000"])
def test_elements(spark, tmp_path, indent, size):
    doc = document(5, 60)
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "e.json").write_text(json.dumps({"items": [], "x": 1}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        if size == "900":
            assert spark.read.option("lineSep", "}").text(str(tmp_path / "d.json")).rdd.getNumPartitions() > 8
        for key in ("items", "other", "last", 'odd}"key') if size == "900" else ("items", "data", "absent"):
            got = json_elements(spark, str(tmp_path), key).orderBy("file", "position").collect()
            want = doc.get(key, []) if isinstance(doc.get(key, []), list) else []
            assert [json.loads(r["text"]) for r in got] == want and [r["position"] for r in got] == list(range(len(want))), key
        typed = json_elements(spark, str(tmp_path / "d.json"), "items", "id string, inner array<struct<x:string>>").orderBy("position").collect()
        assert [(r["id"], [i["x"] for i in r["inner"]]) for r in typed] == [(i["id"], [j["x"] for j in i["inner"]]) for i in doc["items"]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_written_documents_are_one_json(spark, tmp_path):
    rows = [(i * 3, f'text "{i}" }}', None if i % 2 else i) for i in range(40)]
    df = spark.createDataFrame(rows, "at long, text string, n int").repartition(5)
    write_document(df, "at", str(tmp_path / "out"), "rows", {"name": 'a "b"'})
    (part,) = (tmp_path / "out").glob("part-*")
    doc = json.loads(part.read_text())
    assert doc["name"] == 'a "b"' and [r["text"] for r in doc["rows"]] == [r[1] for r in rows]
    assert json_elements(spark, str(tmp_path / "out"), "rows").count() == 40
    write_document(df.where("false"), "at", str(tmp_path / "none"), "rows")
    assert json_elements(spark, str(tmp_path / "none"), "rows").isEmpty()
