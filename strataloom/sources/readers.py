"""Sources: PDF and text files, contract question sets, evaluation data."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, strip
from ..operators.answers import roles_of
from .jsonarray import json_elements


def pdf_text(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """S1. path, text of PDF files: their pages in order, blank ones skipped, a blank line between.

    pages takes a file's bytes and returns its pages' texts; by default the pypdf library is asked for, where
    it is installed.
    """

    def default(content: bytes) -> list[str]:
        import io

        from pypdf import PdfReader

        return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]

    read_pages = pages or default

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["\n\n".join(p for p in read_pages(bytes(c)) if p.strip()) for c in batch.content]
            yield pd.DataFrame({"path": batch.path, "text": texts})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, text string")


def clean_pdf_text(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """S2."""
    return pdf_text(spark, path, pages).withColumn("text", clean_text("text"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """S4. doc_id (the file's name), path, text: one row per file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), "path", "text")


CONTRACT = "title string, paragraphs array<struct<context:string,qas:array<struct<question:string,answers:array<struct<text:string>>>>>>"


def contract_clauses(spark: SparkSession, path: str, max_documents: int | None = 50) -> DataFrame:
    """S3. Clauses of a question-answer contract set: one per answer with text.

    Ids derive from the place in the file, so reading again gives the same ones; with max_documents None all
    contracts are read (the limit is by place, as a loader's argument). One large file is read by many tasks.
    """
    contract = json_elements(spark, path, "data", CONTRACT).withColumnRenamed("position", "d")
    some = contract.where(F.col("d") < max_documents) if max_documents is not None else contract
    answers = (
        some.select("d", "title", F.posexplode("paragraphs").alias("p", "par"))
        .select("d", "title", "p", F.posexplode("par.qas").alias("q", "qa"))
        .select("d", "title", "p", "q", "qa.question", F.posexplode("qa.answers").alias("a", "answer"))
        .withColumn("text", strip("answer.text"))
        .where("text <> ''")
    )
    at = F.concat_ws("/", "d", "p", "q", "a")
    return answers.select(
        F.sha2(at.cast("binary"), 256).alias("clause_id"), F.concat(F.lit("cuad_"), "d").alias("document_id"), "title", F.lit("cuad").alias("source"),
        F.col("question").alias("clause_type"), "text", roles_of("question").alias("roles"), F.lit(True).alias("approved"),
    )


def contract_documents(clauses: DataFrame) -> DataFrame:
    """Documents with their clauses nested."""
    one = F.struct("clause_id", "document_id", "clause_type", "text", "roles", "approved")
    return clauses.groupBy("document_id", "title", "source").agg(F.collect_list(one).alias("clauses"))


QA = "id string, question string, ground_truth string, ground_truth_contexts array<string>, category string"
ANSWER = "question string, answer string, contexts array<string>, retrieved_clauses array<struct<id:string,heading:string,section:string,distance:double,graph_expanded:boolean,text_preview:string>>, context_string string, latency_seconds double, error string"


def qa_pairs(spark: SparkSession, path: str) -> DataFrame:
    """S5. position, id, question, ground_truth, ground_truth_contexts, category."""
    return json_elements(spark, path, "qa_pairs", QA).drop("file").withColumn("position", F.col("position").cast("int"))


def cached_answers(spark: SparkSession, path: str, pairs: DataFrame | None = None) -> DataFrame:
    """S6. position and the answer record; an error where their number is not that of the pairs."""
    records = json_elements(spark, path, "records", ANSWER).drop("file").withColumn("position", F.col("position").cast("int"))
    if pairs is not None and (n := records.count()) != (m := pairs.count()):
        raise ValueError(f"{n} answers for {m} questions")
    return records
