"""Corpus pipeline: quality rules, near-dedup, benchmark decontamination, secret scan, packing.

Each stage takes all that the one before it kept, written as Parquet to the shared folder and read again. The
first four return the columns of documents; the last one the pieces of packed sequences.

Every stage takes empty tables (no rows come back), repeated rows, more columns than documents has (they are
carried, whatever their names), and nulls in any column. What a null or empty text does is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.decontaminate import decontaminate
from strataloom.llm.neardedup import drop_near_duplicates
from strataloom.llm.packing import pack_documents
from strataloom.llm.repetition import quality_rules
from strataloom.llm.secretscan import ordinary_samples, random_samples, scan_secrets, train
from strataloom.llm.shared import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, among them null, empty and very short texts; repeated rows are judged alike."""
    judged = quality_rules(docs.withColumn("row", F.struct(*docs.columns)), carry=("row",))
    return judged.where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; repeated rows are copies, of which one stays.

    Texts without words, and null ones, are duplicates of nothing.
    """
    return drop_near_duplicates(docs)


def _with_text(found: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The carried row with another text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return found.select(*[(new[c] if c in new else F.col(f"row.{c}")).alias(c) for c in columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark items are cut; documents that consist of them mostly go.

    A text without words, or null, has nothing to cut and stays as it is; n_chars is the new text's length.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = decontaminate(docs.withColumn("row", F.struct(*rest)), table(spark, sf_dir, "benchmark"), carry=("row",))
    return _with_text(found.where("clean is not null or n_words = 0"), "clean", docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes, and a null text stays null."""
    model = train(random_samples(spark).union(ordinary_samples(docs, table(spark, sf_dir, "labels"))))
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    return _with_text(scan_secrets(docs.withColumn("row", F.struct(*rest)), model, carry=("row",)), "redacted", docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; ids_crc32 stands for their ids. A null or empty text is its end id alone; repeated rows are packed each."""
    return pack_documents(docs, forget=True).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("packing", packing),
]

#: Shingle links and token ids are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
