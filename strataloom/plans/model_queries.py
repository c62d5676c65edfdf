"""Driver queries of operators that ask a model: the replies are rules over the rows, which the SQL states too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import text as T
from ..operators import answers as A
from ..operators import clauses as C
from ..operators import graph as G
from ..operators import insight as I
from ..operators import metrics as M
from ..operators import vectors as X
from . import pipelines as L
from .queries import _ALL_PIECES, _EDGES, _TURNS, _V, _WHITE, derived_edges, derived_nodes, derived_pairs, derived_vectors, query, read


def told(rows: DataFrame) -> DataFrame:
    """An embedding model for texts that hold their own vector."""
    return rows.withColumn("embedding", F.from_json(F.regexp_extract("text", r"\[.*\]", 0), "array<float>"))


def derived_questions(spark, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 50, as questions that hold them."""
    v = derived_vectors(spark, sf_dir).where("id % 50 = 0")
    return v.select(F.col("id").alias("query"), F.to_json("embedding").alias("question"))


@query("""WITH d AS (SELECT doc_id, doc_id % 4 AS kind, 'h' || doc_id AS heading, text FROM documents),
p AS (SELECT doc_id, 0 AS part, heading, text, 'h' || doc_id AS name FROM d WHERE kind IN (1, 2)
UNION ALL SELECT doc_id, 0, 'a', 'first of ' || doc_id, heading || '_a' FROM d WHERE kind IN (0, 3) UNION ALL SELECT doc_id, 1, 'B c', 'it''s second', heading || '_B c' FROM d WHERE kind = 3)
SELECT doc_id, CAST(part AS INT) AS part, heading, md5(text) AS text_md5, replace(lower(name), ' ', '_') || '_' || left(md5(name), 8) AS id FROM p""")
def block_splits(spark, sf_dir):
    """T5: one item with another that is blank, prose, no reply, and two items."""
    kind = F.col("doc_id") % 4
    one = F.concat(F.lit('[{"heading": "a", "text": "first of '), "doc_id", F.lit('"}, {"heading": "b", "text": " "}]'))
    two = F.concat(F.lit('Two: ```[{"heading": "a", "text": " first of '), "doc_id", F.lit('"}, {"heading": "B c", "text": "it\'s second"},]```'))
    two = F.regexp_replace(two, ",\\]", "]")
    reply = F.when(kind == 0, one).when(kind == 1, "I cannot split this.").when(kind == 3, two)
    blocks = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("block"), F.concat(F.lit("h"), "doc_id").alias("heading"), F.lit("0").alias("section"), "text", reply.alias("reply"))
    return C.apply_splits(blocks).select("doc_id", "part", "heading", F.md5(F.col("text").cast("binary")).alias("text_md5"), "id")


@query("SELECT doc_id AS id, unnest(['Alpha ' || doc_id, 'Beta term']) AS term FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'Own words' FROM documents WHERE doc_id % 3 = 1")
def fallback_terms(spark, sf_dir):
    """The model is asked for texts that only look definitional; short, repeated and unreadable terms are none."""
    from ..operators.terms import clause_terms

    kind = F.col("doc_id") % 3
    text = F.when(kind == 0, "For the purposes of this part").when(kind == 1, 'The "Own words" means this').otherwise("As used in this part")
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), text.alias("text"))
    found = clause_terms(rows, lambda asked: asked.withColumn("reply", F.when(F.col("id") % 3 == 0, F.concat(F.lit('["Alpha '), "id", F.lit('", " Beta term ", "xy", "Beta term"]'))).otherwise("none")))
    return found.select("id", F.explode("terms").alias("term"))


@query(f"""WITH {_EDGES}, n AS (SELECT b.vec_id id FROM v a JOIN v b ON true WHERE a.vec_id = 7 ORDER BY 1 - list_cosine_similarity(a.e, b.e), CAST(b.vec_id AS VARCHAR) LIMIT 8),
r AS (SELECT id FROM n UNION SELECT dst FROM e JOIN n ON src = n.id WHERE type = 'DEPENDS_ON')
SELECT 0::BIGINT AS n_conflicts, (SELECT count(*) FROM r) AS n_dependencies, 'summary of ' || (SELECT count(*) FROM r) || ' lines' AS summary""")
def new_clause(spark, sf_dir):
    """A clause with the vector of clause 7, of which the model says that it depends on its eight neighbours."""
    v, e, n = derived_vectors(spark, sf_dir), derived_edges(spark, sf_dir), derived_nodes(spark, sf_dir)
    texts = {c: F.col(c).cast("string") for c in ("src", "dst")}
    nodes = n.select(F.col("id").cast("string").alias("id"), "heading", "text", "section", F.lit(0).alias("idx"), F.array().cast("array<string>").alias("defined_terms"), "node_seq")
    vectors = v.select(F.col("id").cast("string").alias("id"), "embedding")
    text = v.where("id = 7").select(F.to_json("embedding")).first()[0]
    reply = '[{"source": "A", "target": "B", "type": "DEPENDS_ON", "score": 0.9, "reason": "r"}]'
    lines = F.size(F.filter(F.split("prompt", "\n"), lambda x: x.startswith("- ")))
    report = L.new_clause_impact(
        spark, text, "New clause", nodes, e.withColumns(texts), vectors, told, lambda asked: asked.withColumn("reply", F.lit(reply)), lambda asked: asked.withColumn("reply", F.concat(F.lit("summary of "), lines, F.lit(" lines")))
    )
    return report.select(F.col("n_conflicts").cast("long").alias("n_conflicts"), F.col("n_dependencies").cast("long").alias("n_dependencies"), "summary")


_VEC = "[length({0}), length({0}) - length(replace({0}, 'e', '')), 1]::DOUBLE[]"


@query(f"WITH {_TURNS} SELECT id AS key, round((1 + list_cosine_similarity({_VEC.format('reference')}, {_VEC.format('candidate')})) / 2, 4) AS score FROM p")
def relevancy(spark, sf_dir):
    """The model gives the question itself and the answer as questions; vectors are lengths and numbers of the letter e."""
    good = derived_pairs(spark, sf_dir).select(F.col("id").alias("key"), F.col("reference").alias("question"), F.col("candidate").alias("answer"))
    embed = lambda rows: rows.withColumn("embedding", F.array(F.length("text"), F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit(""))), F.lit(1)).cast("array<float>"))
    return M.answer_relevancy(good, lambda asked: asked.withColumn("reply", F.to_json(F.array("question", "answer"))), embed)


_SENTENCES = f"(SELECT count(*) FROM (SELECT regexp_replace(replace(unnest(string_split({_ALL_PIECES.replace('text', 'candidate')}, chr(1))), '<DOT>', '.'), '^{_WHITE}+|{_WHITE}+$', '', 'g') AS s) WHERE length(s) > 10)"


@query(f"WITH {_TURNS}, n AS (SELECT id, CASE WHEN id % 3 = 0 THEN least({_SENTENCES}, 12) ELSE 2 END AS n FROM p) SELECT id AS key, round((n // 2) / n, 4) AS score FROM n WHERE n > 0")
def claim_support(spark, sf_dir):
    """For every third answer the model gives no claims and its sentences stand in; every second claim is supported."""
    good = derived_pairs(spark, sf_dir).select(F.col("id").alias("key"), F.col("candidate").alias("answer"), F.col("reference").alias("context"))

    def model(rows: DataFrame) -> DataFrame:
        if "claims" not in rows.columns:
            return rows.withColumn("reply", F.when(F.col("key") % 3 != 0, '["one claim", "another claim"]').otherwise("[]"))
        verdicts = F.transform("claims", lambda c, i: F.struct(c.alias("claim"), (i % 2).alias("supported")))
        return rows.withColumn("reply", F.concat(F.lit("Verdicts: "), F.to_json(verdicts)))

    return M.faithfulness(good, model)


@query("""WITH d AS (SELECT doc_id, doc_id % 5 + 1 AS a, greatest(1, least(5, doc_id % 7)) AS b FROM documents)
SELECT doc_id AS key, CAST(a AS INT) AS correctness, CAST(b AS INT) AS completeness, CAST(4 AS INT) AS groundedness, CAST(NULL AS INT) AS clarity, round((a + b + 4) / 3, 2) AS mean_5, round(((a + b + 4) / 3 - 1) / 4, 4) AS normalised FROM d""")
def rubric_scores(spark, sf_dir):
    """A number, one beyond the scale, a fraction in words, and a verdict that is none."""
    reply = F.concat(F.lit('Here: {"correctness": {"score": '), F.col("doc_id") % 5 + 1, F.lit(', "reason": "r}"}, "completeness": '), F.col("doc_id") % 7, F.lit(', "groundedness": {"score": "4/5"}, "clarity": true}'))
    return M.rubric(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), reply.alias("reply")))


@query("SELECT vec_id AS query, CASE WHEN vec_id % 100 = 0 THEN 'seen 5' ELSE 'INSUFFICIENT_CONTEXT' END AS answer, (vec_id % 9) / 10.0::DOUBLE AS confidence, vec_id % 100 <> 0 OR (vec_id % 9) / 10.0 < 0.5 AS escalated, 5::BIGINT AS sources FROM embeddings WHERE vec_id % 50 = 0")
def role_answers(spark, sf_dir):
    """Questions of hr, who may see even labels; every second reply says that the clauses do not tell."""
    v = derived_vectors(spark, sf_dir)
    roles = F.when(F.col("label") % 2 == 0, F.array(F.lit("legal"), F.lit("hr"))).otherwise(F.array(F.lit("legal")))
    clauses = v.select(F.col("id").alias("clause_id"), F.lit("d").alias("document_id"), F.lit("kind").alias("clause_type"), F.concat(F.lit("text "), "label").alias("text"), roles.alias("roles"), "embedding")
    seen = F.size(F.regexp_extract_all("prompt", F.lit(r"(\[\d\] kind\ntext [02468])"), F.lit(1)))
    body = F.when(F.col("query") % 100 == 0, F.concat(F.lit("seen "), seen)).otherwise("INSUFFICIENT_CONTEXT")
    model = lambda rows: rows.withColumn("reply", F.concat(body, F.lit("\nCONFIDENCE: "), F.format_string("%.1f", F.col("query") % 9 / 10)))
    got = L.role_questions(derived_questions(spark, sf_dir), clauses, "hr", told, model)
    return got.select("query", "answer", "confidence", "escalated", F.size("source_clauses").cast("long").alias("sources"))


_HITS = f"""{_EDGES}, h AS (SELECT query, id, dist FROM (SELECT a.vec_id query, b.vec_id id, 1 - list_cosine_similarity(a.e, b.e) dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.e, b.e), b.vec_id) rk FROM v a, v b WHERE a.vec_id % 50 = 0) WHERE rk <= 5),
x AS (SELECT DISTINCT query, dst id FROM h JOIN e ON h.id = e.src WHERE type IN ('DEPENDS_ON', 'CONFLICTS_WITH') AND NOT EXISTS (SELECT 1 FROM h k WHERE k.query = h.query AND k.id = e.dst)),
a AS (SELECT query, id, dist, 0 expanded FROM h UNION ALL SELECT query, id, 0.0, 1 FROM x),
c AS (SELECT query, string_agg('[Clause ' || id || ']' || chr(10) || 'text ' || label, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY expanded, dist, id) context, count(*) n_hits FROM a JOIN embeddings ON vec_id = id GROUP BY query)"""


@query(f"WITH {_HITS} SELECT query, n_hits, md5(context) AS context_md5, 'read ' || length(context) AS reply FROM c")
def asked(spark, sf_dir):
    """Questions over the graph; the model tells how long the context in its prompt is."""
    within = F.length(F.regexp_replace("prompt", r"(?s)^.*\n\nText:\n|\n\nQuestion: .*$", ""))
    # first_words joins the context's words by single blanks
    model = lambda rows: rows.withColumn("reply", F.when(within == F.length(T.first_words("context")), F.concat(F.lit("read "), F.length("context"))))
    got = L.ask(derived_questions(spark, sf_dir), derived_vectors(spark, sf_dir), derived_nodes(spark, sf_dir), derived_edges(spark, sf_dir), told, model)
    return got.select("query", F.col("n_hits").cast("long").alias("n_hits"), F.md5(F.col("context").cast("binary")).alias("context_md5"), "reply")


@query(f"WITH {_HITS} SELECT query, id, CASE expanded WHEN 1 THEN 'graph-expanded' ELSE 'similarity ' || printf('%.2f', 1 - dist) END AS tag FROM a")
def hit_tags(spark, sf_dir):
    """P3."""
    v = derived_vectors(spark, sf_dir)
    hits = X.expand_hits(X.search(v.where("id % 50 = 0"), v), derived_edges(spark, sf_dir), derived_nodes(spark, sf_dir))
    return L.similarity_tag(hits).select("query", "id", "tag")


@query("""SELECT doc_id, '{"a": [' || doc_id || ', {"b": "}"}]}' AS balanced, '[' || doc_id || ']' AS fenced FROM documents""")
def reply_parts(spark, sf_dir):
    """An object behind an unreadable part, with a brace in a string; an array in a fence."""
    reply = F.concat(F.lit('Sure {not: it} and "quoted [ {"a": ['), "doc_id", F.lit(', {"b": "}"}]} rest ['))
    fenced = F.concat(F.lit("```json\n["), "doc_id", F.lit("]\n``` "))
    return read(spark, sf_dir, "documents").select("doc_id", P.balanced_json(reply).alias("balanced"), P.unfence(fenced).alias("fenced"))


@query("""SELECT conv_id, md5(string_agg('[' || k || '] ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY k)) AS context_md5, string_agg(left(text, 30), '|' ORDER BY k) AS heads
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id""")
def role_contexts(spark, sf_dir):
    """Turns as clauses of a role's prompt, and their heads for display."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    heads = F.array_join(F.transform("t", lambda x: T.first_chars(x["text"], 30)), "|")
    return c.select("conv_id", F.md5(T.role_context("t.role", "t.text").cast("binary")).alias("context_md5"), heads.alias("heads"))


@query("SELECT doc_id, source FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def visible_rows(spark, sf_dir):
    """What hr may see."""
    roles = F.when((F.col("doc_id") % 3 == 0) | (F.col("doc_id") % 5 == 0), F.array(F.lit("legal"), F.lit("hr"))).otherwise(F.array(F.lit("legal")))
    return A.visible(read(spark, sf_dir, "documents").withColumn("roles", roles), "hr").select("doc_id", "source")


@query(f"WITH {_EDGES} SELECT 'Clause ' || src AS src_heading, 'Clause ' || dst AS dst_heading, 'term ' || src AS term FROM e WHERE type = 'OVERRIDES'")
def term_list(spark, sf_dir):
    """Overriding edges stand for definitions."""
    e = derived_edges(spark, sf_dir).withColumn("term", F.concat(F.lit("term "), "src")).withColumn("type", F.when(F.col("type") == "OVERRIDES", "DEFINES").otherwise(F.col("type")))
    return I.defined_terms(derived_nodes(spark, sf_dir), e).drop("edge_seq")


@query(f"""WITH {_V}, near AS (SELECT a.vec_id src, b.vec_id dst, 1 - list_cosine_similarity(a.e, b.e) dist FROM v a JOIN v b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.e, b.e), CAST(b.vec_id AS VARCHAR)) <= 5),
s AS (SELECT DISTINCT least(src, dst) a, greatest(src, dst) b FROM near WHERE dist <= 0.65)
SELECT 'DEPENDS_ON' AS type, count(*) AS n FROM s HAVING count(*) > 0 UNION ALL SELECT 'SIMILAR_TO', count(*) FROM s HAVING count(*) > 0 UNION ALL SELECT 'node', count(*) FROM v""")
def built_graph(spark, sf_dir):
    """Similar pairs, of which the model says that the earlier clause depends on the later one."""
    v = derived_vectors(spark, sf_dir)
    c = v.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Clause "), "id").alias("heading"), F.concat(F.lit("text "), "label").alias("text"), F.lit("1").alias("section"), F.col("id").cast("int").alias("idx"), F.col("id").alias("pos"), "embedding")
    reply = '[{"source": "A", "target": "B", "type": "DEPENDS_ON"}]'
    nodes, edges = G.build_graph(c, L.neighbours(c), 0.65, lambda rows: rows.withColumn("reply", F.lit(reply)))
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).unionByName(nodes.agg(F.count(F.lit(1)).alias("n")).withColumn("type", F.lit("node")))


@query("SELECT doc_id, length(trim('search_document: h' || doc_id || chr(10) || chr(10) || text, ' ' || chr(10) || chr(9) || chr(13))) AS n FROM documents WHERE length(text) < 7000")
def embedded_clauses(spark, sf_dir):
    """V1, V2: texts whose input is not cut, embedded by a model that counts its characters."""
    d = read(spark, sf_dir, "documents").where(F.length("text") < 7000)
    rows = d.select("doc_id", F.concat(F.lit("h"), "doc_id").alias("heading"), "text")
    got = L.embedded(rows, lambda asked: asked.withColumn("embedding", F.array(F.length("text").cast("float"))))
    return got.select("doc_id", F.col("embedding")[0].cast("long").alias("n"))
