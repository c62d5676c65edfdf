"""An evaluation run that can be ended at any time and taken up again.

Questions are asked, and answers scored, in batches. Each batch's rows enter a log-structured table in one version, keyed by
question, and a run first leaves out what is there: after a kill the batch that was under way is repeated, no other.
Without a failure the tables go at the end, and the results stay.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import clean_text
from ..operators import metrics as M
from ..operators.numbering import numbered
from ..sources.logstore import Keyed, LogStore
from ..sources.readers import cached_answers, pdf_text, qa_pairs, text_files
from ..sources.stores import clause_base, write_answers, write_results
from ..storage import stored
from .pipelines import FAMILIES, ingest, run_questions, score_records

ANSWERS = "id string, position int, question string, answer string, contexts array<string>, context_string string, latency_seconds double, error string"
#: The scores of a question; those of families that were not asked for are null.
SCORES = {
    "bleu": ("bleu",), "rouge": ("rouge1_f1", "rouge1_recall", "rouge2_f1", "rougeL_f1"), "ragas": ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "ragas_score"),
    "judge": (*K.JUDGE_DIMENSIONS, "mean_5", "normalised"),
}
ALL_SCORES = tuple(c for own in SCORES.values() for c in own)
SCORED = "id string, families string, note string, " + ", ".join(f"{c} double" for c in ALL_SCORES)


def ingest_file(spark: SparkSession, path: str, embed, base: tuple, model=None, pages=None) -> dict:
    """M25. Ingests one PDF or text file, or a folder of them: counts and seconds; an error where there is nothing at path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(path)
    began = time.perf_counter()
    read = pdf_text(spark, path, pages) if path.lower().endswith(".pdf") else text_files(spark, path)
    docs = read.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), clean_text("text").alias("text"))
    ingest(docs, embed, model, *base)
    nodes, edges = base[1].load()
    return {"clauses": base[0].count(), "nodes": nodes.count(), "edges": edges.count(), "seconds": time.perf_counter() - began}


class EvaluationRun:
    """Answers and scores of a question set so far, below a folder."""

    def __init__(self, spark: SparkSession, folder: str, batch: int = 8) -> None:
        self.spark, self.folder, self.batch = spark, folder.rstrip("/"), batch
        self.log = LogStore(spark, f"{self.folder}/checkpoint", {"answers": Keyed(ANSWERS, ("id",)), "scored": Keyed(SCORED, ("id", "families"))}, buckets=8)

    def _batches(self, rows: DataFrame) -> Iterator[DataFrame]:
        """The rows in batches of consecutive positions."""
        placed = stored(numbered(rows, "position", name="_n"), "evaluation")
        for n in range(-(-placed.count() // self.batch)):
            yield placed.where((F.col("_n") >= n * self.batch) & (F.col("_n") < (n + 1) * self.batch)).drop("_n")

    def answers(self) -> DataFrame:
        return self.log.read("answers")

    def ask(self, pairs: DataFrame, base: tuple, embed, model, k: int = K.NEIGHBOURS, use_graph: bool = True) -> DataFrame:
        """M24 for the questions without an answer record; a model without a reply leaves a record with an error."""
        vectors, (nodes, edges) = base[0].rows(), base[1].load()
        for part in self._batches(pairs.join(self.answers().select("id"), "id", "left_anti")):
            told = run_questions(part, vectors, nodes, edges, embed, model, k, use_graph).withColumnRenamed("query", "id")
            self.log.write({"answers": told})
        return self.answers()

    def scored(self, families: tuple[str, ...]) -> DataFrame:
        return self.log.read("scored").where(F.col("families") == ",".join(sorted(families))).drop("families")

    def score(self, records: DataFrame, pairs: DataFrame, families: tuple[str, ...], model=None, embed=None) -> DataFrame:
        """M19 for the records that these families have not scored yet."""
        named = records if "id" in records.columns else records.join(pairs.select("position", "id"), "position")
        for part in self._batches(named.join(self.scored(families).select("id"), "id", "left_anti")):
            own = score_records(part.drop("id"), pairs.join(part.select("id"), "id", "left_semi"), families, model, embed)
            for name in ("rouge1", "rouge2", "rougeL"):
                if name in own.columns:
                    own = own.withColumn(f"{name}_f1", F.col(f"{name}.f1"))
            flat = [(F.col(c) if c in own.columns else F.lit(None)).cast("double").alias(c) for c in ALL_SCORES]
            self.log.write({"scored": own.select("id", F.lit(",".join(sorted(families))).alias("families"), "note", *flat)})
        return self.scored(families)

    def finish(self, summary: DataFrame, scored: DataFrame, stamp: str) -> None:
        """The summary and every question's scores under the stamp and as the latest; then the checkpoint goes."""
        write_results(summary, f"{self.folder}/summary", stamp)
        write_results(scored, f"{self.folder}/questions", stamp)
        self.log.write({}, clear=("answers", "scored"))
        self.log.vacuum()


def summarised(records: DataFrame, scored: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """M21. The summary row: totals, mean latency, and the means of the families' scores."""
    both = records.select("id", "answer", "error", "latency_seconds").join(scored, "id")
    return M.summary(both, tuple(c for f in FAMILIES if f in families for c in SCORES[f]))


def report(summary: DataFrame, scored: DataFrame, families: tuple[str, ...]) -> Iterator[str]:
    """M22, M23. Lines: totals, each family's means, a table of questions, and what the numbers suggest."""
    row = summary.first().asDict()

    def shown(value) -> str:
        return "n/a" if value is None else f"{value:.4f}"

    yield f"Questions: {row['questions_answered']} answered of {row['questions_total']}; mean latency {shown(row['mean_latency_seconds'])} s"
    for family in FAMILIES:
        if family in families:
            yield f"{family}: " + ", ".join(f"{c} {shown(row[c])}" for c in SCORES[family])
    columns = tuple(c for c in ("bleu", "rouge1_f1", "rougeL_f1", "faithfulness", "context_recall", "normalised") if any(c in SCORES[f] for f in families))
    yield " ".join(["question".ljust(30), *(c[:14].rjust(14) for c in columns)])
    lines = scored.orderBy("id").select("id", F.concat_ws(" ", F.rpad(F.substring("id", 1, 30), 30, " "), *[M.cell(F.col(c), 14) for c in columns], F.col("note")).alias("line"))
    for (line,) in lines.select("line").toLocalIterator():
        yield line.rstrip()
    asked = {"bleu": "bleu", "judge": "normalised", "recall": "context_recall", "faithfulness": "faithfulness", "precision": "context_precision", "rouge1_recall": "rouge1_recall"}
    have = summary.select(*[(F.col(c) if c in row else F.lit(None)).cast("double").alias(n) for n, c in asked.items()])
    yield from M.diagnosis(have).first()["notes"]


def evaluate_file(
    spark: SparkSession, dataset: str, folder: str, embed=None, model=None, judge=None, pdf: str | None = None, top_k: int = K.NEIGHBOURS, use_graph: bool = True, skip_ingest: bool = False,
    families: tuple[str, ...] = ("bleu", "rouge"), answers: str | None = None, batch: int = 8, pages=None, say=print,
) -> DataFrame:
    """The whole run: ingest (unless skipped), ask (unless answers are given), score, report; the summary row."""
    if unknown := set(families) - set(FAMILIES):
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    pairs, run = stored(qa_pairs(spark, dataset), "pairs"), EvaluationRun(spark, folder, batch)
    if answers is not None:
        records = stored(cached_answers(spark, answers, pairs).join(pairs.select("position", "id"), "position"), "records")
    else:
        base = clause_base(spark, f"{folder}/base")
        if not skip_ingest:
            if pdf is None:
                raise ValueError("a file to ingest is needed, or skip_ingest")
            if base[1].load() is None or run.answers().isEmpty():  # a resumed run has its clauses
                say("Ingested: {clauses} clauses, {edges} edges in {seconds:.1f} s".format(**ingest_file(spark, pdf, embed, base, model, pages)))
        if base[1].load() is None:
            raise ValueError("nothing is ingested")
        records = stored(run.ask(pairs, base, embed, model, top_k, use_graph), "records")
        write_answers(records.drop("id"), pdf or "", f"{folder}/answers")
    scored = stored(run.score(records, pairs, families, judge or model, embed), "scored")
    summary = stored(summarised(records, scored, families), "summary")
    for line in report(summary, scored, families):
        say(line)
    run.finish(summary, scored, spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0])
    return summary


def main(argv: list[str] | None = None) -> int:
    """M26. Ingests a document, asks a question set, scores the answers and prints the report; takes up a run that was ended."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("--dataset", required=True)
    parser.add_argument("--pdf", help="a PDF or text file, or a folder, to ingest")
    parser.add_argument("--top-k", type=int, default=K.NEIGHBOURS)
    parser.add_argument("--no-graph", action="store_true", help="retrieve without expansion over the graph")
    parser.add_argument("--skip-ingest", action="store_true", help="use what an earlier run ingested")
    parser.add_argument("--from-answers", help="score these answers instead of asking")
    parser.add_argument("--metrics", nargs="+", choices=FAMILIES, default=["bleu", "rouge"])
    parser.add_argument("--out", default="strataloom-evaluation", help="the run's folder")
    parser.add_argument("--batch", type=int, default=8, help="questions between two checkpoints")
    parser.add_argument("--model-url")
    parser.add_argument("--model", default="")
    parser.add_argument("--embedding-url")
    parser.add_argument("--embedding-model", default="")
    parser.add_argument("--replay", help="recorded replies (prompt_sha, response) in place of a model")
    args = parser.parse_args(argv)
    from ..providers import hashed_embeddings, http_embeddings, http_judge, http_text, replay
    from ..session import session

    spark = session()
    model = judge = None
    if args.replay:
        model = judge = replay(spark.read.parquet(args.replay))
    elif args.model_url:
        model, judge = http_text(args.model_url, args.model), http_judge(args.model_url, args.model)
    elif not args.from_answers or {"ragas", "judge"} & set(args.metrics):
        parser.error("--model-url or --replay is needed")
    embed = http_embeddings(args.embedding_url, args.embedding_model) if args.embedding_url else hashed_embeddings(256)
    evaluate_file(spark, args.dataset, args.out, embed, model, judge, args.pdf, args.top_k, not args.no_graph, args.skip_ingest, tuple(args.metrics), args.from_answers, args.batch)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
