"""Sinks and stores: vectors, graphs, history, results. All but results are tables of a log-structured store."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.numbering import numbered
from .jsonarray import write_document
from .logstore import Keyed, LogStore


class VectorStore:
    """K15, K1-K3, S8, S9. Vectors by id: a write adds its own rows only."""

    def __init__(self, spark: SparkSession, path: str, log: LogStore | None = None) -> None:
        self.log = log or LogStore(spark, path, {"vectors": Keyed(K.VECTORS, ("id",))})
        if log is None and not self.log.version():
            self.log.write({}, clear=("vectors",))

    def add(self, clauses: DataFrame, writer: str | None = None, epoch: int | None = None) -> None:
        """K1, K2. Upsert; the last of equal ids (by pos) counts; idx is kept as a string; an empty frame is no change."""
        new = vector_rows(clauses)
        if not new.isEmpty():
            self.log.write({"vectors": new}, order={"vectors": "pos"}, writer=writer, epoch=epoch)

    def clear(self) -> None:
        """K3."""
        self.log.write({}, clear=("vectors",))

    def rows(self) -> DataFrame:
        return self.log.read("vectors")

    def get(self, clause_id: str) -> dict | None:
        """S8. Only the id's bucket is read."""
        row = self.log.lookup("vectors", clause_id).first()
        return row.asDict() if row else None

    def ids(self) -> DataFrame:
        return self.rows().select("id")

    def count(self) -> int:
        return self.rows().count()


def vector_rows(clauses: DataFrame) -> DataFrame:
    """Clauses with embeddings as rows of the vector table."""
    roles = F.col("roles") if "roles" in clauses.columns else F.lit(None).cast("array<string>")
    return clauses.select("id", "embedding", "heading", "text", "section", F.col("idx").cast("string").alias("idx"), roles.alias("roles"), F.col("pos").cast("long").alias("pos"))


class ContractStore:
    """K4, K5. Clauses with roles and vectors, keyed by clause id, so writing again changes nothing."""

    SCHEMA = K.CONTRACT_CLAUSES + ", embedding array<float>"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.log = LogStore(spark, path, {"clauses": Keyed(self.SCHEMA, ("clause_id",))})
        if not self.log.version():
            self.log.write({}, clear=("clauses",))

    def rows(self) -> DataFrame:
        return self.log.read("clauses")

    def upsert(self, clauses: DataFrame, embed) -> None:
        """Of equal ids in one call the last text counts."""
        new = embed(clauses).select("clause_id", "document_id", "clause_type", "text", "roles", "approved", "embedding")
        self.log.write({"clauses": new}, order={"clauses": "text"})


GRAPH = {"nodes": Keyed(K.NODES, ("id",)), "edges": Keyed(K.EDGES, ("src", "dst"))}


class GraphStore:
    """K6, S7. Nodes and edges, written in one version."""

    def __init__(self, spark: SparkSession, path: str, log: LogStore | None = None) -> None:
        self.log = log or LogStore(spark, path, GRAPH)

    def save(self, nodes: DataFrame, edges: DataFrame) -> None:
        """The whole graph anew."""
        self.log.write({"nodes": nodes, "edges": edges}, clear=("nodes", "edges"))

    def load(self) -> tuple[DataFrame, DataFrame] | None:
        return (self.log.read("nodes"), self.log.read("edges")) if self.log.changed("nodes") else None


def clause_base(spark: SparkSession, path: str) -> tuple[VectorStore, GraphStore]:
    """Vectors, nodes and edges under one log, so that one write can change all three at once."""
    log = LogStore(spark, path, {"vectors": Keyed(K.VECTORS, ("id",)), **GRAPH})
    return VectorStore(spark, path, log), GraphStore(spark, path, log)


class History:
    """K7-K10, S10-S12. Documents, flags and questions; rows are added in bulk or one at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.log = LogStore(spark, path, {name: Keyed(schema, ("id",)) for name, schema in K.HISTORY.items()})
        if not self.log.version():
            self.log.write({}, clear=tuple(K.HISTORY))

    def _add(self, name: str, rows: DataFrame, *order: str) -> DataFrame:
        """Number the rows on from the largest id, in the given order, and add them."""
        last = self.log.read(name).agg(F.max("id")).first()[0] or 0
        made = numbered(rows, *order, start=last + 1, name="id")
        self.log.write({name: made.select(*[f.split()[0] for f in K.HISTORY[name].split(", ")])})
        return made

    def save_documents(self, rows: DataFrame) -> DataFrame:
        """K8 for many: filename, uploaded_at, word_count, summary; their rows with ids, by time and name."""
        return self._add("documents", rows, "uploaded_at", "filename")

    def save_document(self, filename: str, word_count: int, summary: str, at: str | None = None) -> int:
        """K8. The new document's id."""
        row = [(filename, at or datetime.now(UTC).isoformat(), word_count, summary)]
        return self.save_documents(self.spark.createDataFrame(row, "filename string, uploaded_at string, word_count int, summary string")).first()["id"]

    def save_all_flags(self, flags: DataFrame) -> None:
        """K9 for many documents: document_id, title, clause, why, severity."""
        self._add("flags", flags, "document_id", "title", "why")

    def save_flags(self, document_id: int, flags: DataFrame) -> None:
        """K9. flags has title, clause, why, severity."""
        self.save_all_flags(flags.withColumn("document_id", F.lit(document_id).cast("long")))

    def save_questions(self, rows: DataFrame) -> None:
        """K10 for many: document_id, question, answer, asked_at."""
        self._add("questions", rows, "asked_at", "document_id", "question")

    def save_question(self, document_id: int, question: str, answer: str, at: str | None = None) -> None:
        """K10."""
        row = [(document_id, question, answer, at or datetime.now(UTC).isoformat())]
        self.save_questions(self.spark.createDataFrame(row, "document_id long, question string, answer string, asked_at string"))

    def documents(self) -> DataFrame:
        """S10. Newest first."""
        return newest_documents(self.log.read("documents"))

    def flags(self, document_id: int) -> DataFrame:
        """S11."""
        return self.log.read("flags").where(F.col("document_id") == document_id).select("title", "clause", "why", "severity")

    def questions(self, document_id: int) -> DataFrame:
        """S12. Newest first."""
        return self.log.read("questions").where(F.col("document_id") == document_id).orderBy(F.desc("asked_at")).select("question", "answer", "asked_at")


def newest_documents(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("uploaded_at")).select("id", "filename", "uploaded_at", "word_count")


def write_answers(records: DataFrame, document: str, path: str) -> None:
    """K11. One JSON document with all answer records in order of position."""
    write_document(records, "position", path, "records", {"document": document})


def write_results(run: DataFrame, folder: str, stamp: str) -> None:
    """K13. The run under its time stamp, and again as the latest one."""
    for name in (f"results_{stamp}", "latest"):
        run.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}.json")


class Checkpoint:
    """K12. Scored questions so far: those not in it are scored, and it goes when the run succeeds."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id") -> None:
        self.key = key
        self.log = LogStore(spark, path, {"scored": Keyed(schema, (key,))})

    def rows(self) -> DataFrame:
        return self.log.read("scored")

    def missing(self, questions: DataFrame) -> DataFrame:
        return questions.join(self.rows().select(self.key), self.key, "left_anti") if self.log.version() else questions

    def add(self, scored: DataFrame) -> None:
        """The rows of some questions, in one version: a run that ends meanwhile has all of them or none."""
        self.log.write({"scored": scored})

    def clear(self) -> None:
        self.log.write({}, clear=("scored",))
        self.log.vacuum()
