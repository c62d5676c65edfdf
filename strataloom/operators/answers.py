"""Questions, confidence and roles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.parsing import confidence
from ..functions.text import clause_context, first_words, join_context, role_context

Model = Callable[[DataFrame], DataFrame]


def contexts(hits: DataFrame) -> DataFrame:
    """T15. query, context: the entries of each query's hits in order of place."""
    entries = F.array_sort(F.collect_list(F.struct("place", clause_context("heading", "text").alias("e"))))
    return hits.groupBy("query").agg(join_context(F.transform(entries, lambda x: x["e"])).alias("context"), F.count(F.lit(1)).alias("n_hits"))


def answer_prompt(question: str = "question", context: str = "context", summary: str | None = None) -> Column:
    """C1. The first 3000 words of the context, and a summary if there is one."""
    told = F.coalesce(F.nullif(F.col(summary), F.lit("")), F.lit("(none)")) if summary else F.lit("(none)")
    return F.concat(
        F.lit("Answer the question from the text only.\n\nSummary: "), told, F.lit("\n\nText:\n"), first_words(context), F.lit("\n\nQuestion: "), F.col(question)
    )


def answer(asked: DataFrame, model: Model, summary: str | None = None) -> DataFrame:
    """C1. asked has question and context; adds reply."""
    return model(asked.withColumn("prompt", answer_prompt(summary=summary)))


def cited_answers(questions: DataFrame, hits: DataFrame, clauses: DataFrame, model: Model) -> DataFrame:
    """C2, C4. query, question, answer, confidence, escalated, source_clauses.

    hits has query, id, score and rank; clauses has clause_id, document_id, clause_type and text. A question
    without clauses gets a fixed answer, confidence 0 and escalation, without a model call.
    """
    rows = hits.join(clauses, F.col("id") == F.col("clause_id"))
    each = F.array_sort(F.collect_list(F.struct("rank", F.struct("clause_id", "document_id", "clause_type", "text", "score").alias("c"))))
    found = rows.groupBy("query").agg(F.transform(each, lambda x: x["c"]).alias("source_clauses"))
    both = questions.join(found, "query", "left")
    kinds, texts = F.col("source_clauses.clause_type"), F.col("source_clauses.text")
    prompt = F.concat(
        F.lit("Answer from the clauses only; write " + K.NO_CONTEXT + " if they do not tell. End with " + K.CONFIDENCE + " and a number from 0 to 1.\n\n"),
        role_context(kinds, texts), F.lit("\n\nQuestion: "), F.col("question"),
    )
    told = model(both.where("source_clauses is not null").withColumn("prompt", prompt)).withColumn("r", confidence("reply"))
    yes = told.select("query", "question", F.col("r.answer"), F.col("r.confidence"), F.col("r.escalated"), "source_clauses")
    none = both.where("source_clauses is null").select(
        "query", "question", F.lit("No relevant clauses were found.").alias("answer"), F.lit(0.0).alias("confidence"), F.lit(True).alias("escalated"), "source_clauses"
    )
    return yes.unionByName(none)


def roles_of(clause_type: str) -> Column:
    """C5. Roles that see a clause type: legal always, others by their lists; all four where no list has it."""
    kind = F.col(clause_type)
    others = [F.when(kind.isin(*types), F.lit(role)) for role, types in K.ROLE_TYPES.items()]
    found = F.array_compact(F.array(F.lit("legal"), *others))
    none = reduce(lambda a, b: a & b, [~F.coalesce(kind.isin(*types), F.lit(False)) for types in K.ROLE_TYPES.values()])
    return F.when(none, F.array(*map(F.lit, K.ROLES))).otherwise(found)


def role_label(role: str) -> Column:
    """C6."""
    known = F.create_map(*[F.lit(x) for kv in K.ROLE_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.col(role)), F.upper(role))


def visible(rows: DataFrame, role: str) -> DataFrame:
    """C7. Rows that a role may see."""
    return rows.where(F.array_contains("roles", role))
