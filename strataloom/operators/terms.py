"""Defined terms and their use."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import lenient_array
from ..functions.text import looks_definitional, pattern_terms, tidy_terms
from ..storage import stored
from .numbering import numbered


def clause_terms(clauses: DataFrame, model=None) -> DataFrame:
    """D3, D5. id, pos, terms of clauses with at least one; the model reads those that only look definitional."""
    found = clauses.select("id", "pos", "text", pattern_terms("text").alias("raw"))
    terms = found.select("id", "pos", tidy_terms("raw").alias("terms"))
    if model:
        ask = found.where((F.size("raw") == 0) & looks_definitional("text"))
        prompt = F.concat(F.lit("List the terms that this clause defines, as a JSON array of strings.\n\n"), F.col("text"))
        told = model(ask.withColumn("prompt", prompt)).select("id", "pos", tidy_terms(F.coalesce(lenient_array("reply", "array<string>"), F.array())).alias("terms"))
        terms = terms.where(F.size("terms") > 0).unionByName(told)
    return terms.where(F.size("terms") > 0)


def add_terms(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """D6. Nodes with the clause's terms added to those they have."""
    new = terms.select(F.col("id").alias("t_id"), F.col("terms").alias("t_terms"))
    both = F.array_union(F.coalesce("defined_terms", F.array().cast("array<string>")), "t_terms")
    return nodes.join(new, F.col("id") == F.col("t_id"), "left").withColumn("defined_terms", F.when(F.col("t_id").isNull(), F.col("defined_terms")).otherwise(both)).drop("t_id", "t_terms")


def definers(terms: DataFrame) -> DataFrame:
    """D7. term (lower-cased), definer: the last clause that defines it; term_seq: by first definition."""
    rows = terms.select("id", "pos", F.posexplode("terms").alias("k", "t")).select("id", "pos", "k", F.lower("t").alias("term"))
    return rows.groupBy("term").agg(F.max_by("id", F.struct("pos", "k")).alias("definer"), F.min(F.struct("pos", "k")).alias("term_seq"))


#: Terms in an automaton, and their characters: more terms are looked for in further passes over the clauses.
BLOCK_TERMS, BLOCK_CHARS = 200_000, 8_000_000

_held: dict[int, ahocorasick.Automaton] = {}


def _automaton(number: int, terms: list[tuple]) -> ahocorasick.Automaton:
    """The automaton of a broadcast block of terms; a worker keeps one."""
    if number not in _held:
        _held.clear()
        made = ahocorasick.Automaton()
        for row in terms:
            made.add_word(row[0], row)
        made.make_automaton()
        _held[number] = made
    return _held[number]


def _edge(text: str, at: int) -> bool:
    """Whether a word begins or ends before place `at`."""
    before, after = (0 <= i < len(text) and (text[i].isalnum() or text[i] == "_") for i in (at - 1, at))
    return before != after


def _found(lower: DataFrame, block: list[tuple], kind: str) -> DataFrame:
    """src, dst, term, pos, k: uses of a block of terms (term, definer, pos, k), the first defined one of each definer."""
    shipped = lower.sparkSession.sparkContext.broadcast(block)
    number = shipped._jbroadcast.id()

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            finder = _automaton(number, shipped.value)
            rows = []
            for src, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen, first = set(), {}
                for end, (term, definer, pos, k) in finder.iter(low or ""):
                    if term not in seen and definer != src and _edge(low, end + 1) and _edge(low, end + 1 - len(term)):
                        seen.add(term)
                        first[definer] = min(first.get(definer, (pos, k, term)), (pos, k, term))
                rows += [(src, definer, term, pos, k) for definer, (pos, k, term) in first.items()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (batch.schema.field(0).type,) * 2 + (pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["src", "dst", "term", "pos", "k"])

    return lower.mapInArrow(search, f"src {kind}, dst {kind}, term string, pos long, k int")


def uses(clauses: DataFrame, terms: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """D8. src (clause), dst (definer), term, term_seq: of several terms of one definer, the first defined one.

    An automaton of all terms runs once over each clause's lower-cased text, in a narrow pass; a use is a term between two
    edges of words (a word's characters are letters, digits and the underscore of any script). Terms beyond a block's
    bounds take further passes, one block each; a block is all that the driver and a worker hold, and texts are never
    shuffled.
    """
    known = stored(numbered(definers(terms), "term", name="n"), "terms")
    n, chars = known.agg(F.count(F.lit(1)), F.sum(F.length("term"))).first()
    kind = clauses.schema["id"].dataType.simpleString()
    passes = max(-(-n // block_terms), -(-(chars or 0) // BLOCK_CHARS))
    lower = clauses.select("id", F.lower("text").alias("low"))
    found = clauses.sparkSession.createDataFrame([], f"src {kind}, dst {kind}, term string, pos long, k int")
    for p in range(passes):
        own = known.where((F.col("n") >= p * n // passes) & (F.col("n") < (p + 1) * n // passes))
        block = [tuple(r) for r in own.select("term", "definer", "term_seq.pos", "term_seq.k").collect()]
        found = found.union(_found(lower, block, kind))
    one = found.groupBy("src", "dst").agg(F.min(F.struct("pos", "k", "term")).alias("t"))
    return one.select("src", "dst", "t.term", F.struct("t.pos", "t.k").alias("term_seq"))


def merge_uses(edges: DataFrame, used: DataFrame) -> DataFrame:
    """USES edges enter where no edge is, or in place of SIMILAR_TO (which keeps its score and gets no reason)."""
    u = used.select(F.col("src").alias("u_src"), F.col("dst").alias("u_dst"), F.col("term").alias("u_term"))
    joined = edges.join(u, (F.col("src") == F.col("u_src")) & (F.col("dst") == F.col("u_dst")), "full_outer")
    new, turned = F.col("src").isNull(), (F.col("type") == "SIMILAR_TO") & F.col("u_src").isNotNull()
    return joined.select(
        F.coalesce("src", "u_src").alias("src"),
        F.coalesce("dst", "u_dst").alias("dst"),
        F.when(new | turned, "USES").otherwise(F.col("type")).alias("type"),
        F.when(new, 1.0).otherwise(F.col("score")).alias("score"),
        F.when(new | turned, F.col("u_term")).otherwise(F.col("term")).alias("term"),
        F.when(new, F.concat(F.lit("Uses the defined term '"), F.col("u_term"), F.lit("'"))).otherwise(F.col("reason")).alias("reason"),
        # new edges stand behind all others, by their ends
        F.when(new, F.lit(1 << 62) + F.pmod(F.xxhash64("u_src", "u_dst"), F.lit(1 << 40))).otherwise(F.col("edge_seq")).alias("edge_seq"),
    )


def definition_counts(edges: DataFrame) -> DataFrame:
    """D9. Edges of the two definition types."""
    return edges.where(F.col("type").isin("DEFINES", "USES")).groupBy("type").count()
