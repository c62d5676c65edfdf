"""Cleaning, headings, clauses, chunks, sentences, terms."""

import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.operators import clauses as C
from strataloom.operators import terms as D
from strataloom.plans.queries import ORACLES, QUERIES


def values(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", expression.alias("v")).collect()
    return [r["v"] for r in sorted(rows)]


def test_clean_text_order(spark):
    texts = ["ﬁrst “quote” – x", "constitu-\ntion", "a\n\n 12 \n\nb", "a\n\n\n\nb", "a   \n \n\n\nb", "  x  ", "café-\nété"]
    assert values(spark, texts, T.clean_text("t")) == ['first "quote" - x', "constitution", "a\n\nb", "a\n\nb", "a\n\n\nb", "x", "caféété"]


def test_headings(spark):
    texts = ["1.2 X", "Article I X", "Section 2.1 X", "Article I. X", "30 days after", "Article I", "1) X", "section mid x", "", "12"]
    assert values(spark, texts, T.is_heading("t")) == [True, True, False, False, True, False, False, True, False, False]


def test_slug_and_section(spark):
    got = values(spark, ["  My Clause - Two  ", "my clause two", "x" * 100], T.slug_id("t"))
    assert got[0].startswith("my_clause_two_") and len(got[0]) == len("my_clause_two_") + 8
    assert got[0] != got[1] and len(got[2]) == 89
    assert values(spark, ["3.1 Scope", "Article IV Rules", "Preamble"], T.section_of("t")) == ["3", "IV", "0"]


def test_rule_split_and_duplicates(spark):
    text = "intro\n1 First\nalpha\n2 Second\nbeta\n1 First\ngamma\n3 Empty\n"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    blocks = [(r["heading"], r["section"], r["text"]) for r in C.rule_split(docs).orderBy("doc_id", "block").collect()]
    assert blocks == [("Preamble", "0", "intro"), ("1 First", "1", "alpha"), ("2 Second", "2", "beta"), ("1 First", "1", "gamma")]
    rows = C.extract_clauses(docs).orderBy("pos").collect()
    assert [(r["text"], r["idx"], r["pos"]) for r in rows] == [("intro", 0, 0), ("gamma", 3, 1), ("beta", 2, 2)]


def test_model_split(spark):
    long = "word " * 200
    docs = spark.createDataFrame([(1, "1 Big\n" + long), (2, "1 Big\n" + long), (3, "1 Big\n" + long)], "doc_id int, text string")
    reply = F.when(F.col("doc_id") == 1, '```json\n[{"heading": "A", "text": " one "}, {"heading": "B", "text": ""}, {"heading": "C", "text": "two",}]\n```').when(F.col("doc_id") == 2, "no array here")

    def model(df):
        return df.withColumn("reply", reply)

    got = {d: [r["text"] for r in C.extract_clauses(docs, model).where(F.col("doc_id") == d).orderBy("idx").collect()] for d in (1, 2, 3)}
    assert got[1] == ["one", "two"] and got[2] == [long.strip()] and got[3] == [long.strip()]
    strict = C.extract_clauses(docs, model, strict_parity=True)
    assert strict.where("doc_id = 2").count() == 0 and strict.where("doc_id = 3").count() == 1


@given(st.text(alphabet="ab. !?\n", max_size=900), st.integers(60, 200), st.integers(0, 50))
def test_chunks_cover_text(text, size, overlap):
    parts = list(C._windows(text, size, overlap))
    assert [s for s, _ in parts] == sorted({s for s, _ in parts})
    covered = "".join(sorted(set(text) - set(" \n")))
    assert all(c in "".join(p for _, p in parts) for c in covered)
    if text.strip():
        assert parts and all(len(p) <= size for _, p in parts)


def test_chunk_tail(spark):
    docs = spark.createDataFrame([(1, ""), (2, "x" * 200), (3, "x" * 201), (4, "x" * 2001), (5, None)], "doc_id int, text string")
    got = {r["doc_id"]: r["n"] for r in C.chunks(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {2: 1, 3: 2, 4: 3}


def test_sentences(spark):
    text = "Pay $30,000.00 to Mr. Smith of Acme Inc. today. Short. The J. Doe clause applies! Is it so? yes"
    assert values(spark, [text], T.sentences("t"))[0] == ["Pay $30,000.00 to Mr. Smith of Acme Inc. today.", "The J. Doe clause applies!"]


def test_sentences_keep_their_text(spark):
    text = "A text with <DOT> in it. It stays as it is! See No. 5 of the U.S. list. Done now, really."
    assert values(spark, [text], T.sentences("t"))[0] == ["A text with <DOT> in it.", "It stays as it is!", "See No. 5 of the U.S. list.", "Done now, really."]


def plain_sentences(text):
    out = re.sub(r"(\d)\.(\d)", r"\1<DOT>\2", text)
    out = re.sub(r"\b([A-Za-z])\.", r"\1<DOT>", out)
    out = re.sub(r"\b(No|Inc|Ltd|Corp|Co|LLP|LLC|St|Mr|Ms|Dr)\.", r"\1<DOT>", out)
    parts = [p.replace("<DOT>", ".").strip() for p in re.split(r"(?<=[.!?])\s+", out)]
    return [p for p in parts if len(p) > 10]


def test_sentences_of_all_languages(spark, tmp_path):
    """Every language and none, letters that only Unicode classes know, fragments of 10 and 11 characters."""
    texts = ["Der Preis ist 1.5 Euro i.e. viel. Größe a. M. beträgt vier. 1234567890. Ende gut!", "Il a vu étéa. Puis éNo. La\u00a0fin est là.\u2003Nous y sommes.", "¿Qué pasa? El niño b. vive. Dr. Ñandú dice aquí. 123456789. 12345678.", "It ends here. Mr. J. R. Doe came at last!", "", None]
    rows = [(i * 10 + k, t, lang) for i, lang in enumerate(["en", "de", "fr", "es", None]) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (len(p), sum(map(len, p))) for i, t, _ in rows if (p := plain_sentences(t or ""))}
    got = {r["doc_id"]: (r["n"], r["chars"]) for r in QUERIES["sentences_all"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 20
    duckdb = pytest.importorskip("duckdb")
    sql = ORACLES["sentences_all"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert {i: (n, c) for i, n, c in duckdb.sql(sql).fetchall()} == want


def test_sentences_of_english_as_their_sql(spark, tmp_path):
    """English documents hold other letters and blanks than ASCII's, marks, and every end of a sentence before every blank."""
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(3)
    parts = ["word", "No", "Mr", "St", "é", "éNo", "_No", "1", "1.2", "a", "B", "ß", "x1", "<DOT>", "\x01", ".", ".", "!", "?", " ", " ", "  ", "\n", "\t", "\r", "\f", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\u2028", "𝒳", "longer words here"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(600)]
    texts += [f"Some longer text {a}{e}{b}and then some more" for a in parts for e in ".!?" for b in parts] + [None, "", "It ends.\u00a0Here it goes on. Or not so.\u2028"]
    rows = [(i, t, "en" if i % 20 else "de") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    sql = ORACLES["sentences"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {i: (n, c) for i, n, c in duckdb.sql(sql).fetchall()}
    assert {x["doc_id"]: (x["n"], x["chars"]) for x in QUERIES["sentences"](spark, str(tmp_path)).collect()} == want and len(want) > 2000


def test_terms_and_uses(spark):
    rows = [("a", 0, '"Board Member" means a person.'), ("b", 1, "Every board member votes."), ("c", 2, '“Quorum” means half. "Board Member" shall mean others.'), ("d", 3, "the quorum of boards"), ("e", 4, "")]
    clauses = spark.createDataFrame(rows, "id string, pos long, text string")
    terms = D.clause_terms(clauses)
    assert {r["id"]: sorted(r["terms"]) for r in terms.collect()} == {"a": ["Board Member"], "c": ["Board Member", "Quorum"]}
    assert {r["term"]: r["definer"] for r in D.definers(terms).collect()} == {"board member": "c", "quorum": "c"}
    used = D.uses(clauses, terms)
    assert sorted((r["src"], r["dst"], r["term"]) for r in used.collect()) == [("a", "c", "board member"), ("b", "c", "board member"), ("d", "c", "quorum")]
    one_by_one = D.uses(clauses, terms, block_terms=1)
    assert sorted(map(str, one_by_one.collect())) == sorted(map(str, used.collect()))
    assert "Exchange" not in D._found(clauses.select("id", "text"), [("quorum", "c", 2, 0)], "string")._jdf.queryExecution().executedPlan().toString()
    edges = spark.createDataFrame([("b", "c", "SIMILAR_TO", 0.9, None, None, 1), ("d", "c", "OVERRIDES", 0.7, None, "r", 2)], "src string, dst string, type string, score double, term string, reason string, edge_seq long")
    merged = {(r["src"], r["dst"]): (r["type"], r["score"], r["term"], r["reason"]) for r in D.merge_uses(edges, used).collect()}
    assert merged["b", "c"] == ("USES", 0.9, "board member", None)
    assert merged["d", "c"] == ("OVERRIDES", 0.7, None, "r")
    assert merged["a", "c"][:3] == ("USES", 1.0, "board member")


@pytest.mark.parametrize("text", ["means ", "As used in this", "nothing"])
def test_looks_definitional(spark, text):
    assert values(spark, [text], T.looks_definitional("t")) == [bool(re.search("means |as used in", text.lower()))]


def test_uses_at_edges_of_words(spark):
    rows = [("a", 0, "x"), ("b", 1, "preschool board"), ("c", 2, "the board's été_board and Board"), ("d", 3, "boards, (board)"), ("e", 4, None), ("f", 5, "über-board c++ c++x"), ("g", 6, "a.b board")]
    clauses = spark.createDataFrame(rows, "id string, pos long, text string")
    terms = spark.createDataFrame([("a", 0, ["board", "été", "c++"]), ("b", 1, ["Board", "school"])], "id string, pos long, terms array<string>")
    got = {(r["src"], r["dst"], r["term"]) for r in D.uses(clauses, terms).collect()}
    words = {"board": "b", "school": "b", "été": "a", "c++": "a"}
    want = {}
    for i, _, t in rows:
        for place, (w, d) in enumerate((("c++", "a"), ("été", "a"), ("board", "b"), ("school", "b"))):
            if i != d and re.search(rf"\b{re.escape(w)}\b", (t or "").lower()):
                want.setdefault((i, d), []).append(w)
    order = {"board": (0, 0), "été": (0, 1), "c++": (0, 2), "school": (1, 1)}
    assert got == {(i, d, min(ws, key=order.get)) for (i, d), ws in want.items()} and words["board"] == "b"


def test_terms_of_runs_of_words(spark):
    r = random.Random(7)
    parts = ["the", "Board", "member", "a", "x", "means", "shall mean", "meansx", "refers to", "is defined as", ",", ".", "5", "é", '"', "\n", "  ", "_", "-"]
    texts = ["".join(r.choice(parts) + r.choice([" ", " ", " ", ""]) for _ in range(r.randrange(25))) for _ in range(400)]
    want = [re.findall("(?i)" + T.TERM_PATTERNS[1], t) for t in texts]
    assert values(spark, texts, T._run_terms("t")) == want
    long = "word " * 60_000 + "means it"
    assert [len(v) for v in values(spark, [long, "word " * 60_000], T.pattern_terms("t"))] == [1, 0]
