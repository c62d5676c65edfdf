"""BLEU, ROUGE and evaluation metrics."""

import math
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from strataloom.operators import metrics as M

PAIRS = [
    ("same", "the cat sat on the mat today", "the cat sat on the mat today"),
    ("apart", "one two three four five", "six seven eight nine"),
    ("short", "the cat sat", "the cat sat"),
    ("empty", "", "a b c d"),
    ("none", None, "a b c d"),
    ("mixed", "The cat, the cat on a mat costs 3.5", "a cat sat on the mat; it costs 3.5 now"),
]


def plain_bleu(c, r):
    logs = []
    for n in range(1, 5):
        cg, rg = Counter(zip(*[c[i:] for i in range(n)], strict=False)), Counter(zip(*[r[i:] for i in range(n)], strict=False))
        total = sum(cg.values())
        if not total:
            return 0.0
        same = sum((cg & rg).values())
        logs.append(math.log(same / total if same else 0.1 / total))
    bp = 1 if len(c) > len(r) else math.exp(1 - len(r) / len(c))
    return round(bp * math.exp(sum(logs) / 4), 4)


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "id string, candidate string, reference string")


def test_bleu(pairs):
    import re

    got = {r["key"]: r["bleu"] for r in M.sentence_bleu(pairs).collect()}
    for key, c, r in PAIRS:
        tokens = [re.findall(r"[a-z0-9]+(?:\.[0-9]+)?", (x or "").lower()) for x in (c, r)]
        assert abs(got[key] - (plain_bleu(*tokens) if tokens[0] else 0.0)) < 2e-4, key
    assert got["same"] == 1.0 and got["short"] == 0.0
    assert 0 < M.corpus_bleu(pairs).first()["bleu"] < 1


def test_rouge(pairs):
    got = {r["key"]: r for r in M.rouge_scores(pairs).collect()}
    assert got["same"]["rouge1"]["f1"] == got["same"]["rougeL"]["f1"] == 1.0
    assert got["apart"]["rouge1"]["f1"] == 0.0 and got["none"]["rougeL"]["recall"] == 0.0
    assert got["mixed"]["rouge1"]["recall"] == 0.7
    assert M.aggregate_rouge(M.rouge_scores(pairs)).count() == 1
    assert M.aggregate_rouge(M.rouge_scores(pairs).where("false")).count() == 0


@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
def test_lcs(a, b):
    assert M.lcs_length(a, b) == M.naive_lcs(a, b)


def test_precision(spark):
    rows = [("a", 1, 1), ("a", 2, 0), ("a", 3, 1), ("b", 1, 0), ("b", 2, 0)]
    got = {r["key"]: r["score"] for r in M.context_precision(spark.createDataFrame(rows, "key string, k int, useful int")).collect()}
    assert got == {"a": round((1 + 2 / 3) / 2, 4), "b": 0.0}


def test_harmonic_and_rubric(spark):
    rows = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.0, 1.0), (3, None, 0.4), (4, None, None)], "i int, a double, b double")
    assert [r["v"] for r in rows.orderBy("i").select(M.harmonic("a", "b").alias("v")).collect()] == [round(2 / 3, 4), 0.0, 0.4, None]
    replies = spark.createDataFrame([("x", 'ok {"correctness": {"score": 4}, "completeness": {"score": "4/5"}, "groundedness": {"score": true}, "clarity": 2}'), ("y", "no")], "key string, reply string")
    got = {r["key"]: r for r in M.rubric(replies).collect()}
    assert [got["x"][d] for d in ("correctness", "completeness", "groundedness", "clarity")] == [4, 4, None, 2]
    assert got["x"]["mean_5"] == 3.33 and got["x"]["normalised"] == 0.5833 and got["y"]["mean_5"] is None
    total = M.aggregate_rubric(M.rubric(replies)).first()
    assert (total["judged"], total["total"], total["correctness"]) == (1, 2, 4.0)


def test_model_metrics(spark):
    answers = spark.createDataFrame([("k", "The fee is due. It is high enough.", "context text", "What fee?")], "key string, answer string, context string, question string")

    def model(df):
        from pyspark.sql import functions as F

        return df.withColumn("reply", F.when(F.contains("prompt", F.lit("Which claims")), '[{"claim": "a", "supported": 1}, {"claim": "b", "supported": "no"}]').otherwise('["a", "b"]'))

    assert M.faithfulness(answers, model).first()["score"] == 0.5


def test_diagnosis(spark):
    cols = "bleu double, judge double, recall double, faithfulness double, precision double, rouge1_recall double"
    rows = spark.createDataFrame([(0.1, 0.9, 0.5, 0.9, 0.4, 0.3), (0.1, None, 0.9, 0.9, 0.9, 0.9)], cols)
    assert [len(r["notes"]) for r in M.diagnosis(rows).collect()] == [5, 1]
