"""Risks, red flags and summaries over chunks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.parsing import flags, unfence
from ..functions.text import first_chars, strip
from ..storage import fresh_path, stored, until_end
from .insight import severity_rank

#: Scores are read as text first: one that is no number voids the clause's whole reply.
RISK_REPLY = "array<struct<category:string,severity:string,score:string,reason:string,suggestion:string>>"


def risk_prompt():
    return F.concat(
        F.lit("List governance risks of this clause as a JSON array of objects with the keys category (" + ", ".join(K.RISK_CATEGORIES) + "), severity (HIGH, MEDIUM or LOW), score (0 to 1), reason and suggestion. Reply [] if there are none.\n\n"),
        F.col("heading"), F.lit("\n"), F.col("text"),
    )


def parse_risks(replies: DataFrame) -> DataFrame:
    """R1. Risks of replies (id, heading, text, pos, reply): known category, score of 0.5 or more.

    Texts under 20 characters are skipped; a reply that cannot be read, or holds an item whose score is a
    string or which lacks a key, gives nothing for its clause; severity is upper-cased and MEDIUM by default.
    """
    own = unfence("reply")
    as_variant = F.try_parse_json(own)
    rows = replies.where(F.length(strip("text")) >= K.MIN_RISK_CHARS).withColumn("items", F.when(as_variant.isNotNull(), F.from_json(own, RISK_REPLY)))
    rows = rows.withColumn("quoted", own.rlike(r'"score"\s*:\s*"'))
    good = rows.where(F.col("items").isNotNull() & ~F.col("quoted") & ~F.exists("items", lambda i: i["score"].isNotNull() & i["score"].try_cast("double").isNull()))
    each = good.select("id", "heading", "pos", F.posexplode("items").alias("k", "i"))
    score = F.coalesce(F.col("i.score").try_cast("double"), F.lit(0.0))
    return each.where((score >= K.RISK_SCORE) & F.col("i.category").isin(*K.RISK_CATEGORIES)).select(
        F.col("id").alias("clause_id"), "heading", F.col("i.category").alias("category"), F.upper(F.coalesce("i.severity", F.lit("MEDIUM"))).alias("severity"),
        score.alias("score"), first_chars(F.coalesce("i.reason", F.lit("")), 400).alias("reason"), first_chars(F.coalesce("i.suggestion", F.lit("")), 400).alias("suggestion"), (F.col("pos") * 1000 + F.col("k")).alias("risk_seq"),
    )


def analyse_risks(clauses: DataFrame, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """R2, R3. Risks of clauses by the model, worst first."""
    return by_severity(parse_risks(model(clauses.withColumn("prompt", risk_prompt()))))


def by_severity(risks: DataFrame) -> DataFrame:
    return risks.orderBy(severity_rank(), F.desc("score"), "risk_seq")


def risk_summary(risks: DataFrame) -> DataFrame:
    """R4. kind (total, severity, category), name, n: all severities and categories, with zeros, and unknown ones."""
    spark = risks.sparkSession
    zero = F.coalesce("n", F.lit(0)).alias("n")
    total = risks.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit("total").alias("name"), "n")
    per = risks.groupBy(F.col("severity").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    severities = spark.createDataFrame([(s,) for s in K.SEVERITIES], "name string").join(per, "name", "full_outer").select(F.lit("severity").alias("kind"), "name", zero)
    of = risks.groupBy(F.col("category").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    categories = spark.createDataFrame([(c,) for c in K.RISK_CATEGORIES], "name string").join(of, "name", "left").select(F.lit("category").alias("kind"), "name", zero)
    return total.unionByName(severities).unionByName(categories)


def category_table(risks: DataFrame) -> DataFrame:
    """R5. Categories with risks, most first."""
    return risks.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def filter_risks(risks: DataFrame, severities: tuple[str, ...] = ("HIGH", "MEDIUM"), categories: tuple[str, ...] = K.RISK_CATEGORIES) -> DataFrame:
    """R6."""
    return risks.where(F.col("severity").isin(*severities) & F.col("category").isin(*categories))


def summary_prompt(summary: str = "summary", text: str = "text"):
    """R7. The summary so far and the next chunk."""
    return F.concat(F.lit("Continue the summary with what the text adds, in one paragraph.\n\nSummary: "), F.coalesce(summary, F.lit("(none)")), F.lit("\n\nText:\n"), F.col(text))


def fold_summaries(chunks: DataFrame, model: Callable[[DataFrame], DataFrame], most: int = K.SUMMARY_CHUNKS) -> DataFrame:
    """R7, R8. doc_id, chunk_no, summary: the running summary after each of a document's first chunks.

    A round asks the model for all documents' chunks of one number at once, each with its document's summary from the round
    before, and stores what it replies: rounds follow one another as the fold demands, documents run side by side, and a
    lost executor costs its share of one round. Without a reply the summary so far stays. Chunks are kept by number, so
    that a round reads its own.
    """
    spark = chunks.sparkSession
    path = fresh_path(spark, "fold-chunks")
    chunks.where(F.col("chunk_no") < most).select("doc_id", "chunk_no", "text").write.partitionBy("chunk_no").parquet(path)
    until_end(spark, path)
    kind = chunks.schema["doc_id"].dataType.simpleString()
    kept = spark.read.schema(f"doc_id {kind}, text string, chunk_no int").parquet(path)
    none = spark.createDataFrame([], f"doc_id {kind}, chunk_no int, summary string")
    state, rounds = none, []
    for number in range(most):
        asked = kept.where(F.col("chunk_no") == number).join(state.select("doc_id", "summary"), "doc_id", "left")
        told = model(asked.withColumn("prompt", summary_prompt())).select("doc_id", "chunk_no", F.coalesce("reply", "summary").alias("summary"))
        state = stored(told, "summaries")
        if state.isEmpty():
            break
        rounds.append(state)
    return reduce(DataFrame.unionByName, rounds, none)


def full_summaries(chunks: DataFrame, model: Callable[[DataFrame], DataFrame], most: int = K.SUMMARY_CHUNKS) -> DataFrame:
    """R8. doc_id, summary after a document's last chunk of the first ones."""
    return fold_summaries(chunks, model, most).groupBy("doc_id").agg(F.max_by("summary", "chunk_no").alias("summary"))


def red_flags(chunks: DataFrame, summarise: Callable[[DataFrame], DataFrame], model: Callable[[DataFrame], DataFrame], most: int = K.SUMMARY_CHUNKS) -> DataFrame:
    """R9. Flags of the first chunks: each is read with the summary of those before it."""
    sums = fold_summaries(chunks, summarise, most).withColumn("chunk_no", F.col("chunk_no") + 1)
    told = chunks.where(F.col("chunk_no") < most).join(sums, ["doc_id", "chunk_no"], "left")
    prompt = F.concat(
        F.lit("List red flags as FLAG:, CLAUSE:, WHY: and SEVERITY: lines with --- between entries, or write " + K.NO_FLAGS + ".\n\nSo far: "),
        F.coalesce("summary", F.lit("")), F.lit("\n\nText:\n"), F.col("text"),
    )
    return parse_flags(model(told.withColumn("prompt", prompt)))


def parse_flags(replies: DataFrame) -> DataFrame:
    """R10. doc_id, chunk_no, k, title, clause, why, severity."""
    return replies.select("doc_id", "chunk_no", F.posexplode(flags("reply")).alias("k", "f")).select("doc_id", "chunk_no", "k", "f.*")
