"""Documents to clause rows and chunks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.parsing import array_slice, lenient_array, readable_array
from ..functions.text import clean_text, is_heading, long_enough, needs_split, section_of, slug_id, strip

SPLIT_REPLY = "array<struct<heading:string,text:string>>"


def rule_split(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """T3. Heading-delimited blocks: doc_id, block, heading, section, text; blocks without text are left out.

    Lines are numbered inside each document and a running count of headings numbers the blocks, so one
    exchange by document serves the window and the grouping.
    """
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    marked = lines.withColumn("head", F.coalesce(is_heading("line"), F.lit(False)))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blocks = marked.withColumn("block", F.sum(F.col("head").cast("int")).over(w))
    body = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line"))))
    grouped = blocks.groupBy("doc_id", "block").agg(
        F.coalesce(F.max(F.when(F.col("head"), strip("line"))), F.lit("Preamble")).alias("heading"),
        strip(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("text"),
    )
    named = grouped.withColumn("section", F.when((F.col("block") == 0), "0").otherwise(section_of("heading")))
    return named.where(F.col("text") != "").select("doc_id", "block", "heading", "section", "text")


def split_prompt(heading: str, text: str):
    """T5. Asks for a JSON array of heading and text."""
    return F.concat(
        F.lit("Split the passage below into self-contained clauses. Reply with a JSON array of objects with the keys heading and text.\n\nHeading: "),
        F.col(heading), F.lit("\n\nPassage:\n"), F.col(text),
    )


def apply_splits(blocks: DataFrame, reply: str = "reply", strict_parity: bool = False) -> DataFrame:
    """T5. Blocks with a model reply become its items; unreadable replies keep the block.

    With strict_parity, a reply without any array loses the block.
    """
    items = F.filter(lenient_array(reply, SPLIT_REPLY), lambda i: F.coalesce(strip(i["text"]), F.lit("")) != "")
    lost = F.lit(strict_parity) & F.col(reply).isNotNull() & array_slice(reply).isNull()
    keep = ~F.coalesce(readable_array(reply), F.lit(False)) & ~lost
    whole = F.array(F.struct(F.col("heading").alias("heading"), F.col("text").alias("text"), slug_id("heading").alias("id")))
    parts = F.transform(items, lambda i: F.struct(i["heading"].alias("heading"), strip(i["text"]).alias("text"), slug_id(F.concat_ws("_", "heading", i["heading"])).alias("id")))
    made = F.when(keep, whole).when(lost, F.slice(whole, 1, 0)).otherwise(parts)
    return blocks.withColumn("made", made).select("doc_id", "block", "section", F.posexplode("made").alias("part", "c")).select(
        "doc_id", "block", "part", F.col("c.id").alias("id"), F.col("c.heading").alias("heading"), F.col("c.text").alias("text"), "section"
    )


def extract_clauses(docs: DataFrame, model=None, doc_id: str = "doc_id", text: str = "text", strict_parity: bool = False) -> DataFrame:
    """T6. Clause rows: of equal ids in a document the last text stands at the first one's place; indexes keep gaps.

    Only oversized blocks go to the model (a function of a DataFrame with `prompt` that adds `reply`), which is
    why the two branches are separate frames: an expression around a model call would call it for every row.
    """
    blocks = rule_split(docs, doc_id, text)
    plain = blocks.where(~needs_split("text")) if model else blocks
    rows = plain.select("doc_id", "block", F.lit(0).alias("part"), slug_id("heading").alias("id"), "heading", "text", "section")
    if model:
        asked = model(blocks.where(needs_split("text")).withColumn("prompt", split_prompt("heading", "text")))
        rows = rows.unionByName(apply_splits(asked, strict_parity=strict_parity))
    numbered = rows.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("block", "part")) - 1)
    latest = numbered.groupBy("doc_id", "id").agg(F.max_by(F.struct("heading", "text", "section", "idx"), "idx").alias("c"), F.min("idx").cast("long").alias("pos"))
    return latest.select("doc_id", "id", "c.heading", "c.text", "c.section", "c.idx", "pos")


def ready_clauses(docs: DataFrame, model=None) -> DataFrame:
    """Clean text, clauses, and the least length: what ingestion stores."""
    cleaned = docs.withColumn("text", clean_text("text"))
    return extract_clauses(cleaned, model).where(long_enough("text"))


def _windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    start, n = 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            stop = max(text.rfind(mark, max(start, end - 200), end) for mark in ".!?")
            end = stop + 1 if stop >= 0 else end
        if part := text[start:end].strip():
            yield start, part
        start = end - overlap if end - overlap > start else end


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = K.CHUNK_CHARS, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """T10. Overlapping windows that end after the last full stop near their end: doc_id, chunk_no, start, text.

    Each window's start depends on the last one's end, so a document's windows are made one after another, in
    an Arrow batch; documents are independent and nothing is shuffled.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, s, p) for d, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) if isinstance(t, str) for i, (s, p) in enumerate(_windows(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "start", "text"])

    return docs.select(doc_id, text).mapInPandas(cut, f"doc_id {kind}, chunk_no int, start int, text string")
