"""The evaluation run: options, resumption after a kill, report."""

import json

import pytest
from pyspark.sql import functions as F

from strataloom.plans import evaluation as E
from strataloom.providers import hashed_embeddings

EMBED = hashed_embeddings(16)
TEXT = "1 Board Powers\nThe board decides on all matters of the college alone.\n2 Board Rules\nThe board decides on all matters of the college together.\n3 Library\nBooks are lent to every student for three weeks.\n"
QUESTIONS = [(f"q{i}", f"Who decides on matter {i} of the college?", "The board decides.") for i in range(5)]


@pytest.fixture
def files(tmp_path):
    pairs = [{"id": i, "question": q, "ground_truth": g, "ground_truth_contexts": [], "category": "term"} for i, q, g in QUESTIONS]
    (tmp_path / "qa.json").write_text(json.dumps({"document": "d", "qa_pairs": pairs}))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "doc.txt").write_text(TEXT)
    return tmp_path


class Model:
    """Answers, notes whom it asked, and breaks down at its n-th batch."""

    def __init__(self, breaks_at=None):
        self.asked, self.calls, self.breaks_at = [], 0, breaks_at

    def __call__(self, rows):
        if "query" not in rows.columns:
            return rows.withColumn("reply", F.lit(None).cast("string"))
        self.calls += 1
        if self.calls == self.breaks_at:
            raise KeyboardInterrupt
        self.asked += [r[0] for r in rows.select("query").collect()]
        return rows.withColumn("reply", F.when(F.col("query") != "q4", F.concat(F.lit("The board decides. Context of "), F.length("prompt")))).withColumn("seconds", F.lit(0.5))


def run(spark, files, model, said=None, **more):
    return E.evaluate_file(spark, str(files / "qa.json"), str(files / "out"), EMBED, model, batch=2, say=(said if said is not None else []).append, **more)


def test_a_killed_run_asks_no_question_twice(spark, files):
    first = Model(breaks_at=2)
    with pytest.raises(KeyboardInterrupt):
        run(spark, files, first, pdf=str(files / "in"))
    assert first.asked == ["q0", "q1"]
    second, said = Model(), []
    row = run(spark, files, second, said, pdf=str(files / "in")).first()
    assert second.asked == ["q2", "q3", "q4"] and not any(s.startswith("Ingested") for s in said)
    assert row["questions_total"] == 5 and row["questions_answered"] == 4 and row["mean_latency_seconds"] == 0.5
    assert row["rouge1_recall"] == 1.0
    table = [s for s in said if s.startswith("q")]
    assert len(table) >= 6 and any("not scored: no answer" in s for s in table) and said[0].startswith("Questions: 4 answered of 5")
    assert spark.read.json(str(files / "out" / "questions" / "latest.json")).count() == 5
    assert E.EvaluationRun(spark, str(files / "out")).answers().isEmpty()  # a finished run leaves no checkpoint
    third = Model()
    run(spark, files, third, skip_ingest=True, use_graph=False, top_k=1)
    assert third.asked == [f"q{i}" for i in range(5)]


def test_scoring_resumes_too(spark, files, monkeypatch):
    def broken(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(E.EvaluationRun, "finish", broken)
    with pytest.raises(KeyboardInterrupt):
        run(spark, files, Model(), pdf=str(files / "in"), families=("bleu",))
    monkeypatch.undo()
    scored = []
    real = E.score_records
    monkeypatch.setattr(E, "score_records", lambda records, *a, **k: scored.append(records.count()) or real(records, *a, **k))
    again = Model()
    run(spark, files, again, pdf=str(files / "in"), families=("bleu",))
    assert again.asked == [] and scored == []
    with pytest.raises(ValueError):
        run(spark, files, again, families=("luck",), skip_ingest=True)


def test_given_answers_and_missing_files(spark, files):
    records = [{"question": q, "answer": g, "latency_seconds": 2.0} for _, q, g in QUESTIONS]
    (files / "a.json").write_text(json.dumps({"document": "d", "records": records}))
    row = E.evaluate_file(spark, str(files / "qa.json"), str(files / "out2"), answers=str(files / "a.json"), families=("bleu", "rouge"), say=lambda s: None).first()
    assert row["questions_answered"] == 5 and row["rougeL_f1"] == 1.0 and row["mean_latency_seconds"] == 2.0
    with pytest.raises(FileNotFoundError):
        run(spark, files, Model(), pdf=str(files / "nothing.txt"))
    with pytest.raises(ValueError):
        run(spark, files, Model(), skip_ingest=True)


def test_command_line(spark, files, capsys):
    with pytest.raises(SystemExit):
        E.main(["--dataset", str(files / "qa.json"), "--pdf", str(files / "in")])
    spark.createDataFrame([("x", "y")], "prompt_sha string, response string").write.parquet(str(files / "io"))
    told = E.main(["--dataset", str(files / "qa.json"), "--pdf", str(files / "in"), "--replay", str(files / "io"), "--out", str(files / "cli"), "--top-k", "2", "--no-graph", "--metrics", "bleu"])
    assert told == 0 and "Questions: 0 answered of 5" in capsys.readouterr().out
