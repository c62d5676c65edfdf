"""Parsers of model replies."""

import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.functions import parsing as P
from strataloom.operators import risk as R


def values(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", expression.alias("v")).collect()
    return [r["v"] for r in sorted(rows)]


def test_lenient_array(spark):
    texts = ['```json\n["a", "b"]\n```', "Sure: ['a', 'b',] ok", "nothing", "[broken", None, '["it\'s"]']
    assert values(spark, texts, P.lenient_array("t", "array<string>")) == [["a", "b"], ["a", "b"], None, None, None, ["it's"]]


def test_balanced():
    assert P.first_balanced('x {"a": "}"} [1]') == '{"a": "}"}'
    assert P.first_balanced("```json\n[1, 2]\n```") == "[1, 2]"
    assert P.first_balanced("[broken {\"a\": 1}") == '{"a": 1}'
    assert P.first_balanced("none") is None and P.first_balanced(None) is None


def test_binary_and_clamp(spark):
    assert values(spark, ["true", "false", "0.5", "0.4", '" YES"', '"no"', None, "[1]"], P.coerce_binary("t")) == [1, 0, 1, 0, 1, 0, 0, 0]
    assert values(spark, ["4", '"4/5"', '"4.5"', "2.5", "true", "9", None, "0", '"x"'], P.clamp_score("t")) == [4, 4, 5, 2, None, 5, None, 1, None]


def test_confidence(spark):
    texts = ["Yes.\nCONFIDENCE: 0.9", "Yes.", "A CONFIDENCE: 0.1 B\nCONFIDENCE: 0.5", "Yes CONFIDENCE: high", "INSUFFICIENT_CONTEXT\nCONFIDENCE: 0.9", "Yes CONFIDENCE: 0.49"]
    got = values(spark, texts, P.confidence("t"))
    assert [(g["confidence"], g["escalated"]) for g in got] == [(0.9, False), (0.5, False), (0.5, False), (0.5, False), (0.9, True), (0.49, True)]
    assert got[2]["answer"] == "A CONFIDENCE: 0.1 B"


def test_flags(spark):
    texts = ["FLAG: a\nCLAUSE: c\nWHY: w\nSEVERITY: HIGH\n---\nFLAG: b\n---\nFLAG: d\nWHY: e", "FLAG: a\nWHY: w\nNO FLAGS FOUND", ""]
    got = values(spark, texts, P.flags("t"))
    assert [[(f["title"], f["severity"]) for f in g] for g in got] == [[("a", "HIGH"), ("d", None)], [], []]


def test_risks(spark):
    good = '[{"category": "NO_APPEAL", "severity": "low", "score": 0.7}, {"category": "X", "score": 1}, {"category": "NO_APPEAL", "score": 0.4}]'
    rows = [("a", good), ("b", good.replace("0.4", '"0.4"')), ("c", "no"), ("d", None), ("e", '[{"category": "NO_APPEAL", "score": 0.5}]')]
    replies = spark.createDataFrame([(i, "h", "a text of some length", n, r) for n, (i, r) in enumerate(rows)], "id string, heading string, text string, pos long, reply string")
    got = [(r["clause_id"], r["severity"], r["score"]) for r in R.by_severity(R.parse_risks(replies)).collect()]
    assert got == [("e", "MEDIUM", 0.5), ("a", "LOW", 0.7)]
    assert R.parse_risks(replies.withColumn("text", F.lit("short"))).count() == 0


def test_fold(spark):
    chunks = spark.createDataFrame([("d", n, f"t{n}") for n in (2, 0, 1)] + [("e", 0, "u"), (None, 0, "v")], "doc_id string, chunk_no int, text string")
    asked = []

    def model(rows):
        asked.append(rows.count())
        so_far, text = (F.regexp_extract("prompt", r"(?s)Summary: (.*)\n\nText:\n(.*)", n) for n in (1, 2))
        return rows.withColumn("reply", F.when(text != "t1", F.concat(so_far, F.lit("+"), text)))

    got = {(r["doc_id"], r["chunk_no"]): r["summary"] for r in R.fold_summaries(chunks, model, 5).collect()}
    assert got == {("d", 0): "(none)+t0", ("d", 1): "(none)+t0", ("d", 2): "(none)+t0+t2", ("e", 0): "(none)+u", (None, 0): "(none)+v"}
    assert asked == [3, 1, 1, 0]  # all documents at once, a chunk each
    assert {r["doc_id"]: r["summary"] for r in R.full_summaries(chunks, model, 2).collect()}["d"] == "(none)+t0"
    assert R.fold_summaries(chunks.where("false"), model).isEmpty()


def plain_balanced(text):
    """Each bracket's own scan, one after another."""
    for start in (i for i, c in enumerate(text) if c in "[{"):
        stack, quoted, escaped = [], False, False
        for end in range(start, len(text)):
            c = text[end]
            if quoted:
                escaped, quoted = (c == "\\" and not escaped), (escaped or c != '"')
            elif c == '"':
                quoted = True
            elif c in "[{":
                stack.append("]" if c == "[" else "}")
            elif c in "]}":
                if not stack or stack.pop() != c:
                    break
                if not stack:
                    try:
                        return json.dumps(json.loads(text[start : end + 1]))
                    except ValueError:
                        break
    return None


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(['"', "\\", "[", "]", "{", "}", "1", ",", ":", '"a"', '"a":', " x ", '\\"', '["', '"]', "[1]", '{"a":2}']), max_size=24).map("".join))
def test_balanced_equals_scans(text):
    assert P.first_balanced("x" + text) == plain_balanced("x" + text)


@pytest.mark.parametrize("part", ["[", '["\\"', '{"a": [1, 2,], ', "[[1,]", '"[', '["[x', "[]", '"[]\\"', "[x ", '["\\"]'])
def test_balanced_is_linear(part):
    times = []
    for size in (50_000, 200_000):
        text = "x " + part * (size // len(part)) + ("" if part != "[]" else "")
        began = time.process_time()
        P.first_balanced(text)
        times.append(time.process_time() - began)
    assert times[1] < 10 * times[0] + 0.5 and times[1] < 8, times


def test_balanced_of_long_and_deep_replies():
    assert P.first_balanced("x " + "[1," * 300_000 + '{"a": 1}') == '{"a": 1}'
    deep = "x " + "[" * 200_000 + "]" * 200_000
    assert 1 < P.first_balanced(deep).count("[") <= 200_000
