"""Tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

import pytest

WORDS = "the board may grant a right of appeal to any member who asks for it in writing within thirty days after notice été Straße İstanbul".split()
SCHEMA = "doc_id long, text string, id string, t string, key string, block long, kept string, spans string, host string, b long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (f"{r.randint(0, 999)}" if r.random() < 0.4 else "") for _ in range(n))


def texts():
    shared = prose(1, 60)
    near = prose(2, 120).split(" ")
    out = {i: prose(100 + i, 30 + 7 * i) for i in range(12)}
    out |= {20: shared, 21: "Intro one. " + shared + " Tail one.", 22: shared, 23: " ".join(near), 24: " ".join([*near[:60], "changed", *near[61:]])}
    out |= {25: " ".join([*near, "more"]), 26: "", 27: None, 28: " \n\t ", 29: "x" * 30_000, 30: ("word " * 9_000).strip(), 31: prose(3, 6_000)}
    out |= {32: "one two", 33: "One two", 34: "tab\x0bform\x0cfeed\x1cfs\x85nel\xa0nbsp " + prose(4, 60), 35: "line a b\nline a b\nother\n" * 20, 36: "漢字かな交じり文 " * 30 + "🙂" * 40}
    return out


@pytest.fixture(scope="session")
def messy_rows():
    rows = [(i, t) for i, t in texts().items()]
    return [*rows, (20, texts()[20]), (None, prose(1, 60)), (None, None)]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame([(i, t, "i", "t", "k", 1, "yes", "s", "h", 2) for i, t in messy_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
