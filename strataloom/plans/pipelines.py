"""Compositions: ingestion, questions, impact of a new clause, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import embed_input, query_input, slug_id
from ..operators import metrics as M
from ..operators.answers import answer, cited_answers, contexts
from ..operators.clauses import ready_clauses
from ..operators.graph import build_graph, insert_clause
from ..operators.traversal import impact
from ..operators.vectors import expand_hits, role_search, search, self_knn
from ..sources.stores import vector_rows
from ..storage import stored


def embedded(clauses: DataFrame, embed) -> DataFrame:
    """V2. Clauses with their embedding."""
    kept = clauses.columns
    own = clauses.withColumnRenamed("text", "own_text").withColumn("text", embed_input("heading", "own_text"))
    return embed(own).drop("text").withColumnRenamed("own_text", "text").select(*kept, "embedding")


def neighbours(vectors: DataFrame, k: int = K.NEIGHBOURS) -> DataFrame:
    """V5 with the order that edges are written in."""
    order = vectors.select(F.col("id").alias("src"), "pos")
    return self_knn(vectors, k).join(order, "src").withColumn("seq", F.col("pos") * 1000 + F.col("rank")).select("src", "dst", "distance", "seq")


def ingest(docs: DataFrame, embed, model=None, vectors=None, graph=None, threshold: float = K.SIMILAR_DISTANCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P1. Clauses with embeddings, nodes and edges of documents; stored where stores are given, all in one version if these share a log."""
    clauses = stored(embedded(ready_clauses(docs, model), embed), "ingested")
    nodes, edges = build_graph(clauses, neighbours(clauses), threshold, model)
    if vectors is not None and graph is not None and vectors.log is graph.log:
        vectors.log.write({"vectors": vector_rows(clauses), "nodes": nodes, "edges": edges}, order={"vectors": "pos"}, clear=("vectors", "nodes", "edges"))
        return clauses, nodes, edges
    if vectors is not None:
        vectors.log.write({"vectors": vector_rows(clauses)}, order={"vectors": "pos"}, clear=("vectors",))
    if graph is not None:
        graph.save(nodes, edges)
    return clauses, nodes, edges


def retrieve(questions: DataFrame, vectors: DataFrame, nodes: DataFrame, edges: DataFrame, embed, k: int = K.NEIGHBOURS, use_graph: bool = True) -> DataFrame:
    """V7 for a table of questions (query, question): one plan for one question or many."""
    asked = embed(questions.select(F.col("query").alias("id"), query_input("question").alias("text")))
    hits = search(asked, vectors, k)
    return expand_hits(hits, edges if use_graph else edges.where("false"), nodes)


def similarity_tag(hits: DataFrame) -> DataFrame:
    """P3. Shows the similarity of hits and names the expanded ones, by their flag."""
    return hits.withColumn("tag", F.when(F.col("graph_expanded"), "graph-expanded").otherwise(F.format_string("similarity %.2f", 1 - F.col("distance"))))


def ask(questions: DataFrame, vectors: DataFrame, nodes: DataFrame, edges: DataFrame, embed, model, k: int = K.NEIGHBOURS, use_graph: bool = True) -> DataFrame:
    """P2. query, question, reply, context, n_hits."""
    told = contexts(retrieve(questions, vectors, nodes, edges, embed, k, use_graph))
    return answer(questions.join(told, "query", "left"), model).select("query", "question", "reply", "context", "n_hits")


def role_questions(questions: DataFrame, clauses: DataFrame, role: str, embed, model, k: int = K.NEIGHBOURS) -> DataFrame:
    """C4. clauses has clause_id, document_id, clause_type, text, roles, embedding."""
    asked = embed(questions.select(F.col("query").alias("id"), F.col("question").alias("text")))
    hits = role_search(asked, clauses.withColumnRenamed("clause_id", "id"), role, k)
    return cited_answers(questions, hits, clauses, model)


def free_id(nodes: DataFrame, wanted: str) -> str:
    """The wanted id, or with the smallest free number behind it."""
    taken = {r[0] for r in nodes.where(F.col("id").rlike(f"^\\Q{wanted}\\E(_[0-9]+)?$")).select("id").collect()}
    n = 1
    while (name := wanted if n == 1 else f"{wanted}_{n}") in taken:
        n += 1
    return name


def new_clause_impact(spark: SparkSession, text: str, heading: str, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, embed, model=None, summarise=None, graph=None, store=None, commit: bool = False) -> DataFrame:
    """B11, B12. The impact report of a clause that is not in the graph yet; stores change only on commit."""
    if nodes.isEmpty() or vectors.isEmpty():
        return spark.createDataFrame([("The graph or the vector store is empty.",)], "error string")
    wanted = spark.range(1).select(slug_id(F.lit(heading))).first()[0]
    own = free_id(nodes, wanted)
    clause = spark.createDataFrame([(own, heading, text, "0", -1, 0)], "id string, heading string, text string, section string, idx int, pos long")
    clause = embedded(clause, embed)
    near = search(clause, vectors, K.IMPACT_NEIGHBOURS).select(F.col("query").alias("src"), F.col("id").alias("dst"), "distance", F.col("rank").cast("long").alias("seq"))
    new_nodes, new_edges = insert_clause(nodes, edges, clause, near, model=model)
    report = impact(new_nodes, new_edges, clause.select("id"))
    if summarise:
        none = F.array(F.lit("none"))
        listed = F.array_join(F.transform(F.when(F.size("changes") > 0, F.col("changes")).otherwise(none), lambda c: F.concat(F.lit("- "), c)), "\n")
        prompt = F.concat(F.lit(f"Sum up in 3 to 5 sentences what a new clause named {heading} changes.\n\n"), listed)
        report = summarise(report.withColumn("prompt", prompt)).withColumn("summary", F.coalesce("reply", F.lit("No summary is available."))).drop("prompt", "reply")
    if commit and graph is not None and store is not None:
        graph.save(new_nodes, new_edges)
        store.add(clause)
    return report


def run_questions(pairs: DataFrame, vectors: DataFrame, nodes: DataFrame, edges: DataFrame, embed, model, k: int = K.NEIGHBOURS, use_graph: bool = True) -> DataFrame:
    """M24. Answer records of all questions at once: position, question, answer, contexts, context_string, error."""
    asked = pairs.select(F.col("id").alias("query"), "question", "position")
    hits = retrieve(asked, vectors, nodes, edges, embed, k, use_graph)
    each = F.array_sort(F.collect_list(F.struct("place", "id", "heading", "section", "distance", "graph_expanded", F.substring("text", 1, K.PREVIEW_CHARS).alias("text_preview"), "text")))
    got = hits.groupBy("query").agg(each.alias("h"))
    told = answer(asked.join(contexts(hits), "query", "left").join(got, "query", "left"), model)
    # the model's own time, where it tells: questions run side by side, so no clock around them means anything
    latency = F.col("seconds") if "seconds" in told.columns else F.lit(0.0)
    return told.select(
        "position", "query", "question", F.coalesce("reply", F.lit("")).alias("answer"), F.transform("h", lambda x: x["text"]).alias("contexts"), F.col("context").alias("context_string"),
        latency.alias("latency_seconds"), F.when(F.col("reply").isNull(), "the model gave no reply").alias("error"),
    )


FAMILIES = ("bleu", "rouge", "ragas", "judge")


def score_records(records: DataFrame, pairs: DataFrame, families: tuple[str, ...] = ("bleu", "rouge"), model=None, embed=None) -> DataFrame:
    """M19. Records with ground truth by position, scored by the chosen families only."""
    if unknown := set(families) - set(FAMILIES):
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    both = records.join(pairs.select("position", "id", "ground_truth", "category"), "position").withColumn("note", F.when(~M.usable(records), "not scored: no answer"))
    good = both.where(M.usable(records)).select(F.col("id").alias("key"), "question", "ground_truth", "answer", F.coalesce("context_string", F.lit("")).alias("context"), F.col("answer").alias("candidate"), F.col("ground_truth").alias("reference"), "contexts")
    out = []
    if "bleu" in families:
        out.append(M.sentence_bleu(good, "key").select("key", "bleu"))
    if "rouge" in families:
        r = M.rouge_scores(good, "key")
        out.append(r.select("key", "rouge1", "rouge2", "rougeL", F.col("rouge1.recall").alias("rouge1_recall")))
    if "ragas" in families:
        chunks = good.select("key", "question", "ground_truth", F.posexplode("contexts").alias("k", "chunk"))
        parts = {"faithfulness": M.faithfulness(good, model), "answer_relevancy": M.answer_relevancy(good, model, embed), "context_precision": M.judged_precision(chunks, model), "context_recall": M.context_recall(good, model)}
        joined = reduce(lambda a, b: a.join(b, "key", "left"), [p.withColumnRenamed("score", n) for n, p in parts.items()], good.select("key"))
        out.append(joined.withColumn("ragas_score", M.harmonic(*parts)))
    if "judge" in families:
        prompt = F.concat(F.lit("Rate the answer from 1 to 5 on " + ", ".join(K.JUDGE_DIMENSIONS) + ". Reply with a JSON object of objects with the keys score and reason.\n\nQuestion: "), F.col("question"), F.lit("\nAnswer: "), F.col("answer"), F.lit("\nReference: "), F.col("ground_truth"), F.lit("\nContext:\n"), F.substring("context", 1, K.JUDGE_CHARS))
        out.append(M.rubric(model(good.withColumn("prompt", prompt))))
    scored = both.withColumnRenamed("id", "key")
    for part in out:
        scored = scored.join(part, "key", "left")
    return scored.withColumnRenamed("key", "id")


def evaluate(records: DataFrame, pairs: DataFrame, families: tuple[str, ...] = ("bleu", "rouge"), model=None, embed=None) -> tuple[DataFrame, DataFrame]:
    """M19, M21. Scored records and the summary row."""
    scored = score_records(records, pairs, families, model, embed)
    fields = [c for c in ("bleu", "rouge1_recall", "faithfulness", "answer_relevancy", "context_precision", "context_recall", "ragas_score", "normalised") if c in scored.columns]
    return scored, M.summary(scored, tuple(fields))
