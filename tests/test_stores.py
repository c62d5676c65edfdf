"""Sources, stores, pipelines and streams."""

import json

from pyspark.sql import functions as F

from strataloom.operators.answers import role_label, roles_of
from strataloom.plans import pipelines as L
from strataloom.providers import hashed_embeddings, http_embeddings, recorded, replay, stub
from strataloom.sources import readers, stores

EMBED = hashed_embeddings(16)
TEXT = "1 Board Powers\nThe board decides on all matters of the college alone.\n2 Board Rules\nThe board decides on all matters of the college together.\n3 Library\nBooks are lent to every student for three weeks.\n"


def test_sources(spark, tmp_path):
    contract = {"data": [{"title": "T", "paragraphs": [{"context": "c", "qas": [{"question": "License Grant", "answers": [{"text": " x "}, {"text": " "}]}, {"question": "Other", "answers": []}]}]}]}
    (tmp_path / "c.json").write_text(json.dumps(contract))
    rows = readers.contract_clauses(spark, str(tmp_path / "c.json")).collect()
    assert [(r["document_id"], r["text"], r["roles"], r["approved"]) for r in rows] == [("cuad_0", "x", ["legal", "sde", "external"], True)]
    (tmp_path / "qa.json").write_text(json.dumps({"document": "d", "qa_pairs": [{"id": "1", "question": "q", "ground_truth": "g", "category": "term"}]}))
    (tmp_path / "a.json").write_text(json.dumps({"document": "d", "records": [{"question": "q", "answer": "g", "latency_seconds": 1.5}]}))
    pairs = readers.qa_pairs(spark, str(tmp_path / "qa.json"))
    records = readers.cached_answers(spark, str(tmp_path / "a.json"), pairs)
    scored, total = L.evaluate(records, pairs)
    assert scored.first()["rouge1_recall"] == 1.0 and total.first()["mean_latency_seconds"] == 1.5
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.pdf").write_bytes(b"one|two| ")
    got = readers.pdf_text(spark, str(tmp_path / "t"), lambda b: b.decode().split("|")).first()
    assert got["text"] == "one\n\ntwo"
    stores.write_results(total, str(tmp_path / "out"), "s1")
    assert spark.read.json(str(tmp_path / "out" / "latest.json")).count() == 1


def test_stores(spark, tmp_path):
    v = stores.VectorStore(spark, str(tmp_path / "v"))
    c = spark.createDataFrame([("a", [1.0], "h", "t", "1", 0, 0), ("a", [2.0], "h2", "t", "1", 1, 1), ("b", [3.0], "h", "t", "1", 2, 2)], "id string, embedding array<float>, heading string, text string, section string, idx int, pos long")
    v.add(c)
    v.add(c.where("false"))
    assert v.count() == 2 and v.get("a")["heading"] == "h2" and v.get("a")["idx"] == "1" and v.get("z") is None
    v.add(c.where("id = 'b'").withColumn("heading", F.lit("new")))
    assert v.get("b")["heading"] == "new" and v.count() == 2
    v.clear()
    assert v.count() == 0
    h = stores.History(spark, str(tmp_path / "h"))
    assert [h.save_document(f, 3, "s", at) for f, at in (("x", "2024-01-01"), ("y", "2024-02-01"))] == [1, 2]
    h.save_flags(1, spark.createDataFrame([("t", "c", "w", "HIGH")], "title string, clause string, why string, severity string"))
    h.save_question(1, "q1", "a", "2024-01-01")
    h.save_question(1, "q2", "a", "2024-01-02")
    assert [r["filename"] for r in h.documents().collect()] == ["y", "x"]
    assert h.flags(1).count() == 1 and h.flags(2).count() == 0
    assert [r["question"] for r in h.questions(1).collect()] == ["q2", "q1"]


def test_ingest_ask_and_impact(spark, tmp_path):
    docs = spark.createDataFrame([("d", TEXT)], "doc_id string, text string")
    vectors, graph = stores.VectorStore(spark, str(tmp_path / "v")), stores.GraphStore(spark, str(tmp_path / "g"))
    assert graph.load() is None
    clauses, nodes, edges = L.ingest(docs, EMBED, vectors=vectors, graph=graph, threshold=0.3)
    assert clauses.count() == 3 and vectors.count() == 3
    nodes, edges = graph.load()
    assert {r["type"] for r in edges.collect()} == {"SIMILAR_TO"} and edges.count() == 2
    questions = spark.createDataFrame([("q", "Who decides on matters of the college?")], "query string, question string")
    reply = L.ask(questions, vectors.rows(), nodes, edges, EMBED, stub(lambda p: F.concat(F.lit("n="), F.length(p).cast("string"))), k=2).first()
    assert reply["n_hits"] == 2 and reply["context"].count("---") == 1
    model = stub(lambda p: F.lit('[{"source": "A", "target": "B", "type": "DEPENDS_ON", "score": 0.9, "reason": "r"}]'))
    report = L.new_clause_impact(spark, "The board decides on all books.", "1 Board Powers", nodes, edges, vectors.rows(), EMBED, model, stub(F.lit("fine")), graph, vectors)
    row = report.first()
    assert row["start"].endswith("_2") and row["n_dependencies"] == 3 and row["summary"] == "fine"
    assert vectors.count() == 3  # nothing is stored without commit
    L.new_clause_impact(spark, "The board decides on all books.", "New", nodes, edges, vectors.rows(), EMBED, None, None, graph, vectors, commit=True).count()
    assert vectors.count() == 4 and graph.load()[0].count() == 4


def test_role_questions(spark):
    rows = [("a", "d", "License Grant", "the licence is free"), ("b", "d", "Audit Rights", "audits are yearly")]
    c = EMBED(spark.createDataFrame(rows, "clause_id string, document_id string, clause_type string, text string")).withColumn("roles", roles_of("clause_type"))
    q = spark.createDataFrame([("q", "is the licence free")], "query string, question string")
    got = L.role_questions(q, c, "sde", EMBED, stub(F.lit("Yes.\nCONFIDENCE: 0.4"))).first()
    assert got["escalated"] and [s["clause_id"] for s in got["source_clauses"]] == ["a"]
    none = L.role_questions(q, c, "nobody", EMBED, stub(F.lit("x"))).first()
    assert none["confidence"] == 0.0 and none["escalated"]
    names = spark.createDataFrame([("hr",), ("boss",)], "r string").select(role_label("r").alias("l")).collect()
    assert [r["l"] for r in names] == ["Human Resources", "BOSS"]


def test_providers(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    io = recorded(stub(F.upper("prompt"))(df), "stub", "m")
    assert sorted(r["reply"] for r in replay(io)(df).collect()) == ["A", "B"]
    made = http_embeddings("http://x", "m", post=lambda url, body, timeout: {"embedding": [len(body["prompt"])]}, delay=0, calls=1)(spark.createDataFrame([("abc",), (" ",)], "text string"))
    assert sorted((r["embedding"] or [0])[0] for r in made.collect()) == [0, 3]
