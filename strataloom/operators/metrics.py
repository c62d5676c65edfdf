"""Answer quality: BLEU, ROUGE, retrieval metrics, rubric scores, and their aggregation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .. import constants as K
from ..functions.parsing import balanced_json, clamp_score, coerce_binary
from ..functions.text import metric_tokens, numbered, sentences
from .vectors import cosine

Model = Callable[[DataFrame], DataFrame]
EPSILON = 0.1


def ngrams(tokens: Column, n: int) -> Column:
    """M1. The n-grams of a token array, joined by blanks."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(
        F.array().cast("array<string>")
    )


def _tokenised(pairs: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    return pairs.select(F.col(key).alias("key"), metric_tokens(F.coalesce(F.col(candidate), F.lit(""))).alias("c"), metric_tokens(F.coalesce(F.col(reference), F.lit(""))).alias("r"))


def clipped_counts(pairs: DataFrame, key: str = "id", candidate: str = "candidate", reference: str = "reference", orders: int = 4) -> DataFrame:
    """M2. key, n, clipped, cand_total, ref_total, c_len, r_len for each order.

    Both sides' n-grams go through one grouping (per pair and n-gram, counts of either side), so there is one
    exchange by key and n-gram and one by key, each after partial sums, and no join.
    """
    t = _tokenised(pairs, key, candidate, reference)
    orders_of = [F.struct(F.lit(n).alias("n"), ngrams(F.col("c"), n).alias("c"), ngrams(F.col("r"), n).alias("r")) for n in range(1, orders + 1)]
    by_order = t.select("key", F.size("c").alias("c_len"), F.size("r").alias("r_len"), F.explode(F.array(*orders_of)).alias("o"))
    marked = F.concat(F.transform("o.c", lambda g: F.struct(g.alias("g"), F.lit(1).alias("c"), F.lit(0).alias("r"))), F.transform("o.r", lambda g: F.struct(g.alias("g"), F.lit(0).alias("c"), F.lit(1).alias("r"))))
    each = by_order.select("key", "c_len", "r_len", F.col("o.n").alias("n"), F.explode_outer(marked).alias("m"))
    grams = each.groupBy("key", "c_len", "r_len", "n", F.col("m.g").alias("g")).agg(F.sum("m.c").alias("c"), F.sum("m.r").alias("r"))
    zero = F.lit(0).cast("long")
    return grams.groupBy("key", "c_len", "r_len", "n").agg(
        F.coalesce(F.sum(F.least("c", "r")), zero).alias("clipped"), F.coalesce(F.sum("c"), zero).alias("cand_total"), F.coalesce(F.sum("r"), zero).alias("ref_total")
    )


def brevity(c: Column, r: Column) -> Column:
    """M3."""
    return F.when(c == 0, 0.0).when(c > r, 1.0).otherwise(F.exp(1 - r / F.nullif(c, F.lit(0))))


def _bleu(counts: DataFrame, by: list[str], orders: int) -> DataFrame:
    p = F.when(F.col("cand_total") == 0, None).when(F.col("clipped") == 0, EPSILON / F.col("cand_total")).otherwise(F.col("clipped") / F.col("cand_total"))
    agg = counts.withColumn("p", p).groupBy(*by).agg(
        F.sum(F.log("p")).alias("logs"), F.count("p").alias("n"), F.max("c_len").alias("c_len"), F.max("r_len").alias("r_len"), F.min("cand_total").alias("fewest")
    )
    value = F.when((F.col("c_len") == 0) | (F.col("r_len") == 0) | (F.col("n") < orders), 0.0).otherwise(brevity(F.col("c_len"), F.col("r_len")) * F.exp(F.col("logs") / orders))
    return agg.select(*by, F.round(value, 4).alias("bleu"), F.round(brevity(F.col("c_len"), F.col("r_len")), 4).alias("brevity_penalty"), "c_len", "r_len")


def sentence_bleu(pairs: DataFrame, key: str = "id", candidate: str = "candidate", reference: str = "reference", orders: int = 4) -> DataFrame:
    """M4. key, bleu, brevity_penalty, c_len, r_len; 0 where an order has no n-grams."""
    return _bleu(clipped_counts(pairs, key, candidate, reference, orders), ["key"], orders)


def corpus_bleu(pairs: DataFrame, key: str = "id", candidate: str = "candidate", reference: str = "reference", orders: int = 4) -> DataFrame:
    """M5. Counts and lengths are pooled before dividing: bleu, brevity_penalty, c_len, r_len."""
    pooled = clipped_counts(pairs, key, candidate, reference, orders).groupBy("n").agg(*[F.sum(c).alias(c) for c in ("clipped", "cand_total", "c_len", "r_len")])
    return _bleu(pooled.withColumn("all", F.lit(1)), ["all"], orders).drop("all")


def prf(match: Column, c: Column, r: Column) -> tuple[Column, Column, Column]:
    """M6. Precision, recall and F1, each rounded by itself."""
    p = F.when(c > 0, match / F.nullif(c, F.lit(0))).otherwise(0.0)
    q = F.when(r > 0, match / F.nullif(r, F.lit(0))).otherwise(0.0)
    f = F.when(p + q > 0, 2 * p * q / F.nullif(p + q, F.lit(0.0))).otherwise(0.0)
    return F.round(p, 4).alias("precision"), F.round(q, 4).alias("recall"), F.round(f, 4).alias("f1")


def rouge_n(pairs: DataFrame, n: int = 1, key: str = "id", candidate: str = "candidate", reference: str = "reference") -> DataFrame:
    """M7. key, precision, recall, f1."""
    counts = clipped_counts(pairs, key, candidate, reference, n).where(F.col("n") == n)
    return counts.select("key", *prf(F.col("clipped"), F.col("cand_total"), F.col("ref_total")))


def lcs_length(a: list, b: list) -> int:
    """M8. Longest common subsequence: the rows of the table are bits of one number, updated by one addition."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    row = 0
    for y in b:
        x = row | places.get(y, 0)
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


@F.pandas_udf(IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def rouge_l(pairs: DataFrame, key: str = "id", candidate: str = "candidate", reference: str = "reference") -> DataFrame:
    """M9. key, precision, recall, f1 by the longest common subsequence."""
    t = _tokenised(pairs, key, candidate, reference)
    return t.withColumn("m", _lcs("c", "r")).select("key", *prf(F.col("m"), F.size("c"), F.size("r")))


def rouge_scores(pairs: DataFrame, key: str = "id", candidate: str = "candidate", reference: str = "reference") -> DataFrame:
    """M10. key and the structs rouge1, rouge2, rougeL."""
    t = clipped_counts(pairs, key, candidate, reference, 2)
    both = t.groupBy("key").agg(*[F.max(F.when(F.col("n") == n, F.struct(*prf(F.col("clipped"), F.col("cand_total"), F.col("ref_total"))))).alias(f"rouge{n}") for n in (1, 2)])
    return both.join(rouge_l(pairs, key, candidate, reference).select("key", F.struct("precision", "recall", "f1").alias("rougeL")), "key")


def mean4(col: Column | str) -> Column:
    """M20. Mean of what is there, at four places."""
    return F.round(F.avg(col), 4)


def aggregate_rouge(scores: DataFrame) -> DataFrame:
    """M11. Means of the rounded fields; no row for no scores."""
    cols = [mean4(f"{r}.{m}").alias(f"{r.lower()}_{m}") for r in ("rouge1", "rouge2", "rougeL") for m in ("precision", "recall", "f1")]
    return scores.agg(*cols, F.count(F.lit(1)).alias("n")).where("n > 0").drop("n")


def verdict_share(verdicts: DataFrame, key: str = "key", verdict: str = "verdict") -> DataFrame:
    """M12, M15. key, score: share of supported ones among the verdicts given; no row without any."""
    return verdicts.groupBy(key).agg(mean4(coerce_binary(verdict).cast("double")).alias("score"))


def claims_of(answers: DataFrame, text: str = "answer", most: int = K.MAX_CLAIMS) -> DataFrame:
    """M12. The sentences that stand in for claims where a model gives none: key, k, claim."""
    return answers.select("key", F.posexplode(F.slice(sentences(text), 1, most)).alias("k", "claim"))


def _array_or_none(raw: Column) -> Column:
    return F.from_json(balanced_json(raw), "array<string>")


def faithfulness(answers: DataFrame, model: Model) -> DataFrame:
    """M12. answers has key, answer and context; two model passes: claims, then their verdicts."""
    asked = model(answers.withColumn("prompt", F.concat(F.lit("List the factual claims of this answer as a JSON array of strings.\n\n"), F.col("answer"))))
    told = F.slice(F.coalesce(F.when(F.size(_array_or_none(F.col("reply"))) > 0, _array_or_none(F.col("reply"))), sentences("answer")), 1, K.MAX_CLAIMS)
    claims = asked.withColumn("claims", told).drop("reply").where(F.size("claims") > 0)
    prompt = F.concat(F.lit("Which claims does the context support? Reply with a JSON array of objects with the keys claim, supported (1 or 0) and reason.\n\nContext:\n"), F.substring("context", 1, K.JUDGE_CHARS), F.lit("\n\nClaims:\n"), numbered("claims"))
    return verdict_share(_verdicts(model(claims.withColumn("prompt", prompt)), "supported"))


def _verdicts(replies: DataFrame, field: str) -> DataFrame:
    items = F.from_json(balanced_json("reply"), "array<map<string,string>>")
    rows = replies.select("key", F.explode(items).alias("i")).where(F.col("i").isNotNull())
    value = F.try_element_at("i", F.lit(field))
    return rows.select("key", F.when(value.rlike("^(true|false|-?[0-9.]+)$"), value).otherwise(F.concat(F.lit('"'), F.coalesce(value, F.lit("")), F.lit('"'))).alias("verdict"))


def answer_relevancy(answers: DataFrame, model: Model, embed: Model, n: int = K.MAX_QUESTIONS) -> DataFrame:
    """M13. Mean cosine of the question with up to n questions that the answer would answer."""
    asked = model(answers.withColumn("prompt", F.concat(F.lit(f"Write {n} questions that this answer answers, as a JSON array of strings.\n\n"), F.col("answer"))))
    made = asked.select("key", F.explode(F.slice(_array_or_none(F.col("reply")), 1, n)).alias("text"))
    own = embed(answers.select("key", F.col("question").alias("text"))).select("key", F.col("embedding").alias("q"))
    return embed(made).join(own, "key").groupBy("key").agg(mean4(cosine("q", "embedding")).alias("score"))


def context_precision(verdicts: DataFrame, key: str = "key", place: str = "k", useful: str = "useful") -> DataFrame:
    """M14. key, score: mean of precision@k over the useful places; 0 where none is useful. useful is 0 or 1."""
    w = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    rows = verdicts.select(key, F.col(useful).alias("u"), (F.sum(useful).over(w) / F.count(F.lit(1)).over(w)).alias("p"))
    got = rows.groupBy(key).agg(F.sum(F.col("u") * F.col("p")).alias("s"), F.sum("u").alias("n"))
    return got.select(key, F.round(F.when(F.col("n") > 0, F.col("s") / F.nullif(F.col("n"), F.lit(0))).otherwise(0.0), 4).alias("score"))


def judged_precision(rows: DataFrame, model: Model) -> DataFrame:
    """M14. rows has key, k, question, ground_truth and chunk; an unreadable verdict counts as not useful."""
    prompt = F.concat(F.lit("Is this passage useful for the answer? Reply with a JSON object with the keys useful (1 or 0) and reason.\n\nQuestion: "), F.col("question"), F.lit("\nAnswer: "), F.col("ground_truth"), F.lit("\nPassage:\n"), F.substring("chunk", 1, K.PRECISION_CHARS))
    told = model(rows.withColumn("prompt", prompt))
    value = F.try_element_at(F.from_json(balanced_json("reply"), "map<string,string>"), F.lit("useful"))
    return context_precision(told.withColumn("useful", F.coalesce(coerce_binary(value), F.lit(0))))


def context_recall(rows: DataFrame, model: Model) -> DataFrame:
    """M15. rows has key, ground_truth and context: share of its sentences found; 0 for an empty context."""
    listed = rows.withColumn("claims", sentences("ground_truth")).where(F.size("claims") > 0)
    prompt = F.concat(F.lit("Can each sentence be attributed to the context? Reply with a JSON array of objects with the keys sentence, attributed (1 or 0) and reason.\n\nContext:\n"), F.substring("context", 1, K.JUDGE_CHARS), F.lit("\n\nSentences:\n"), numbered("claims"))
    full = F.coalesce(F.trim("context"), F.lit("")) != ""
    some = verdict_share(_verdicts(model(listed.where(full).withColumn("prompt", prompt)), "attributed"))
    return some.unionByName(listed.where(~full).select("key", F.lit(0.0).alias("score")))


def harmonic(*scores: str) -> Column:
    """M16. Harmonic mean of what is there; 0 if any is 0 or less, null if none is."""
    there = F.array_compact(F.array(*[F.col(s).cast("double") for s in scores]))
    total = F.aggregate(there, F.lit(0.0), lambda a, x: a + F.when(x > 0, 1 / F.nullif(x, F.lit(0.0))).otherwise(0.0))
    return F.when(F.size(there) == 0, None).when(F.exists(there, lambda x: x <= 0), 0.0).otherwise(F.round(F.size(there) / F.nullif(total, F.lit(0.0)), 4))


def rubric(replies: DataFrame, key: str = "key", reply: str = "reply") -> DataFrame:
    """M17. key, the four dimensions (1 to 5 or null), mean_5, normalised."""
    parsed = replies.select(F.col(key).alias("key"), F.from_json(balanced_json(reply), "map<string,string>").alias("m"))
    dims = []
    for d in K.JUDGE_DIMENSIONS:
        inner = F.try_element_at("m", F.lit(d))
        score = F.coalesce(F.get_json_object(inner, "$.score"), inner)
        shown = F.when(inner.rlike(r'"score"\s*:\s*"'), F.concat(F.lit('"'), score, F.lit('"'))).otherwise(score)
        dims.append(clamp_score(shown).alias(d))
    return rubric_means(parsed.select("key", *dims))


def rubric_means(rows: DataFrame) -> DataFrame:
    there = F.array_compact(F.array(*[F.col(d) for d in K.JUDGE_DIMENSIONS]))
    mean = F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(there), F.lit(0))
    return rows.withColumn("mean_5", F.round(mean, 2)).withColumn("normalised", F.round((mean - 1) / 4, 4))


def aggregate_rubric(rows: DataFrame) -> DataFrame:
    """M18. Means per dimension at two places, their mean, its normalised value, and how many were judged."""
    means = [F.round(F.avg(d), 2).alias(d) for d in K.JUDGE_DIMENSIONS]
    judged = F.greatest(*[F.col(d).isNotNull().cast("int") for d in K.JUDGE_DIMENSIONS])
    got = rows.agg(*means, F.sum(judged).alias("judged"), F.count(F.lit(1)).alias("total"))
    there = F.array_compact(F.array(*[F.col(d) for d in K.JUDGE_DIMENSIONS]))
    overall = F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(there), F.lit(0))
    return got.withColumn("overall", F.round(overall, 2)).withColumn("normalised", F.round((overall - 1) / 4, 4))


def usable(records: DataFrame) -> Column:
    """M19. Records that are scored: no error, and an answer that is not blank."""
    return F.col("error").isNull() & (F.trim(F.coalesce("answer", F.lit(""))) != "")


def summary(records: DataFrame, scores: tuple[str, ...] = ()) -> DataFrame:
    """M21. Totals, mean latency over all records, and mean scores over the usable ones; one pass."""
    ok = usable(records)
    return records.agg(
        F.count(F.lit(1)).alias("questions_total"), F.sum(ok.cast("int")).cast("long").alias("questions_answered"), mean4("latency_seconds").alias("mean_latency_seconds"),
        *[mean4(F.when(ok, F.col(s))).alias(s) for s in scores],
    )


def cell(value: Column, width: int = 8) -> Column:
    """M22. A number at four places, or a dash, to the right."""
    return F.lpad(F.coalesce(F.format_string("%.4f", value), F.lit("-")), width, " ")


def report_rows(scored: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """M22. One line of text per question."""
    return scored.select("id", F.concat_ws(" ", F.rpad(F.substring("id", 1, 30), 30, " "), *[cell(F.col(c)) for c in columns]).alias("line"))


# Thresholds and texts of the rules.
RULES = (
    ("low_bleu", "bleu < 0.15 and judge > 0.6", "Wording differs from the reference although the judge is content."),
    ("low_recall", "recall < 0.6", "Retrieval misses clauses that the answer needs."),
    ("wrong_context", "faithfulness > 0.8 and recall < 0.6", "Answers follow their context, but it is not the right one."),
    ("low_precision", "precision < 0.5", "Useful clauses are ranked below others."),
    ("low_rouge", "rouge1_recall < 0.4", "Answers cover little of the reference."),
)
NO_FINDING = "No weakness stands out; look at the questions with the lowest scores."


def diagnosis(summaries: DataFrame) -> DataFrame:
    """M23. Notes for bleu, judge, recall, faithfulness, precision, rouge1_recall; a rule without its inputs is silent."""
    notes = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(rule), F.lit(False)), note) for _, rule, note in RULES]))
    return summaries.withColumn("notes", F.when(F.size(notes) > 0, notes).otherwise(F.array(F.lit(NO_FINDING))))


def naive_lcs(a: list, b: list) -> int:
    """The textbook table, for tests."""
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return int(t[-1, -1])
