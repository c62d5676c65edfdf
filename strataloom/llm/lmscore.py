"""Language-model scores by subword lattice likelihood.

A word's probability is the sum over all its segmentations into pieces of an existing vocabulary, each weighted
by the pieces' scores: a forward recursion in log space over the word's bytes. Pieces never cross white space,
so the marginal probability of a document is the product over its words, times that of its end.

The vocabulary's scores are the first weights; expectation maximisation over the lattices of the training words
(forward and backward recursion, expected uses of each piece, summed by Spark) fits them to the corpus, in as many
rounds as the likelihood still gains by. A word that training has is a piece of its own beside the vocabulary: its lattice has an edge over the whole word, so what is
learned grows with the corpus. The shares of the two kinds of edges are those of Witten and Bell: N tokens' worth of
whole words, V (the number of different ones) of vocabulary pieces.

Training counts are joined without sending texts: documents are read once into blocks that hold their tokens as
numbers and each distinct token as text once. Counts are summed by token after partial sums; each distinct word of the
table goes through the recursion once, and its count and marginal go back to the blocks by a join that splits words
which are in most blocks. A block's documents then are sums of looked-up numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from copy import copy
from itertools import accumulate
from math import exp, inf, log, log1p

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import split_join
from .setsketch import words_of
from .shared import bounded_batches, stored

FOLDS, HELD_OUT = 10, 0
SMOOTH = 0.1
#: Bytes of text in a block, at least one document; a block's words and numbers take about as much memory.
BLOCK_BYTES = 16_000_000
#: Words up to this many bytes go through the recursion together; longer ones one by one.
TOGETHER = 40
#: Training ends with the round before which log10 of the training words' mean likelihood gained less than this, and
#: how many uses of pieces the vocabulary's own scores stand for in each round.
TOLERANCE, PRIOR = 0.02, 1_000.0
#: Bytes of words that one step of training takes together.
STRETCH_BYTES = 1_500_000
END = ""
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


_MIX = np.uint64(0xD6E8FEB86659FD93)


class Lattice:
    """Pieces (as bytes, a word's first one with a blank before it) and their log probabilities.

    The vocabulary's scores are ranks of merges, so a piece of rank r weighs 1 / (r + 2.7) at first, as word
    frequencies do; single bytes, which cover what no piece does, weigh as the last rank.
    """

    def __init__(self, scores: dict[bytes, float]) -> None:
        self.longest, self.bits = max(map(len, scores)), 22
        keys = np.array([self._hash(p) for p in scores], np.uint64)
        order = np.argsort(keys)
        pieces = list(scores)
        self.keys, self.pieces = keys[order], [pieces[k] for k in order.tolist()]
        self.values = np.array(list(scores.values()))[order]
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[keys >> np.uint64(64 - self.bits)] = True

    @classmethod
    def from_sentencepiece(cls, path: str) -> Lattice:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ranked = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                ranked[sp.id_to_piece(i).replace("▁", " ").encode()] = -sp.get_score(i)
        last = max(ranked.values())
        for b in range(256):
            ranked.setdefault(bytes([b]), last)
        weights = {p: 1 / (r + 2.7) for p, r in ranked.items()}
        total = sum(weights.values())
        return cls({p: log(w / total) for p, w in weights.items()})

    def weighted(self, values: np.ndarray) -> Lattice:
        """The same pieces with other log probabilities, in the order of `pieces`."""
        other = copy(self)
        other.values = values
        return other

    def maximised(self, uses: np.ndarray, prior: np.ndarray) -> Lattice:
        """The pieces weighted by their expected uses and PRIOR uses that are shared out by the prior (log) weights."""
        weights = uses + PRIOR * np.exp(prior)
        return self.weighted(np.log(weights / weights.sum()))

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return (h * int(_MIX)) & 0xFFFFFFFFFFFFFFFF

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are a piece's, and of which."""
        hit = np.flatnonzero(self.seen[key >> np.uint64(64 - self.bits)])
        place = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
        right = self.keys[place] == key[hit]
        return hit[right], place[right]

    def many(self, words: list[bytes], counts: np.ndarray | None = None, uses: np.ndarray | None = None) -> np.ndarray:
        """log probabilities of words, those of one length at a time; adds to uses the pieces' expected uses in counts of each."""
        out = np.zeros(len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(sizes > TOGETHER).tolist():
            out[k] = self._long(words[k], None if counts is None else float(counts[k]), uses)
        for size in np.unique(sizes[sizes <= TOGETHER]).tolist():
            places = np.flatnonzero(sizes == size)
            for at in range(0, len(places), 20_000):
                some = places[at : at + 20_000]
                out[some] = self._same_length([words[k] for k in some.tolist()], size, None if counts is None else counts[some], uses)
        return out

    def _same_length(self, words: list[bytes], size: int, counts: np.ndarray | None, uses: np.ndarray | None) -> np.ndarray:
        n, m = len(words), size + 1
        text = np.full((m, n), 0x20, np.uint64)
        if size:
            text[1:] = np.frombuffer(b"".join(words), np.uint8).reshape(n, size).T
        prefix = np.zeros((m + 1, n), np.uint64)
        for j in range(m):
            prefix[j + 1] = prefix[j] * _BASE + text[j] + np.uint64(1)
        powers = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(m + 1)]
        forward = np.full((m + 1, n), -np.inf)
        forward[0] = 0
        edges = []
        for j in range(1, m + 1):
            for i in range(max(0, j - self.longest), j):
                hit, place = self._find((prefix[j] - prefix[i] * powers[j - i]) * _MIX)
                if len(hit):
                    forward[j, hit] = np.logaddexp(forward[j, hit], forward[i, hit] + self.values[place])
                    edges.append((i, j, hit, place))
        if uses is not None:
            backward = np.full((m + 1, n), -np.inf)
            backward[m] = 0
            for i, j, hit, place in sorted(edges, key=lambda e: -e[0]):  # all edges into later places come first
                backward[i, hit] = np.logaddexp(backward[i, hit], self.values[place] + backward[j, hit])
            shares = [np.exp(forward[i, hit] + self.values[place] + backward[j, hit] - forward[m, hit]) * counts[hit] for i, j, hit, place in edges]
            uses += np.bincount(np.concatenate([e[3] for e in edges]), np.concatenate(shares), len(uses))
        return forward[m]

    def _long(self, word: bytes, count: float | None, uses: np.ndarray | None) -> float:
        """The same of one word of any length: edges by hashes of all its strings of each length, then one step per edge."""
        text = np.frombuffer(b" " + word, np.uint8).astype(np.uint64)
        m = len(text)
        begins, ends, places = [], [], []
        hashes = np.zeros(m, np.uint64)  # of the strings of one length that begin at each place
        for size in range(1, min(self.longest, m) + 1):
            hashes = hashes[: m - size + 1] * _BASE + text[size - 1 :] + np.uint64(1)
            hit, place = self._find(hashes * _MIX)
            begins.append(hit)
            ends.append(hit + size)
            places.append(place)
        begin, end, place = (np.concatenate(x) for x in (begins, ends, places))
        order = np.argsort(end, kind="stable")
        begin, end, place = begin[order], end[order], place[order]
        values = self.values[place]
        forward = _recursion(begin.tolist(), end.tolist(), values.tolist(), m)
        if uses is not None:
            back = np.argsort(-begin, kind="stable")
            backward = _recursion((m - end[back]).tolist(), (m - begin[back]).tolist(), values[back].tolist(), m)[::-1]
            share = np.exp(np.array(forward)[begin] + values + np.array(backward)[end] - forward[m]) * count
            uses += np.bincount(place, share, len(uses))
        return forward[m]


def _recursion(begins: list[int], ends: list[int], values: list[float], m: int) -> list[float]:
    """log sums over paths from 0 to each place, by edges in order of their ends."""
    forward = [0.0, *[-inf] * m]
    for i, j, v in zip(begins, ends, values, strict=True):
        x, y = forward[j], forward[i] + v
        if x < y:
            x, y = y, x
        forward[j] = x + log1p(exp(y - x)) if y > -inf else x
    return forward


_lattices: dict[str, Lattice] = {}


def lattice(vocabulary: str) -> Lattice:
    if vocabulary not in _lattices:
        from .fasttok import public_file

        _lattices[vocabulary] = Lattice.from_sentencepiece(public_file(vocabulary))
    return _lattices[vocabulary]


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Blocks of documents: words (END first), how often each occurs in training, and the documents' numbers."""
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    schema = f"block long, words array<string>, counts array<long>, ids array<{kind}>, held array<boolean>, sizes array<long>, tokens binary"

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        number: dict[bytes, int] = {}
        ids: list = []
        held: list[bool] = []
        parts: list[np.ndarray] = []
        size, id_type = 0, None

        def close() -> pa.RecordBatch:
            flat = np.concatenate(parts)
            training = np.repeat(~np.array(held), [len(p) for p in parts])
            counts = np.bincount(flat[training], minlength=len(number) + 1)
            row = [block, [END, *(w.decode("utf-8", "replace") for w in number)], counts, ids, held, [len(p) for p in parts], zstandard.ZstdCompressor(level=1).compress(flat.tobytes())]
            types = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
            names = ["block", "words", "counts", "ids", "held", "sizes", "tokens"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                # 0 is the end token's number
                parts.append(np.fromiter([*[number.setdefault(w, len(number) + 1) for w in words], 0], np.int32, len(words) + 1))
                ids.append(i)
                held.append(zlib.crc32(str("" if i is None else i).encode()) % FOLDS == HELD_OUT)
                size += len(text or "")
                if size >= block_bytes:
                    yield close()
                    block += 1
                    number, ids, held, parts, size = {}, [], [], [], 0
        if ids:
            yield close()

    return chosen.mapInArrow(read, schema)


_LIKELIHOOD, _TOKENS = -1, -2


def train(words: DataFrame, vocabulary: str, tolerance: float = TOLERANCE) -> np.ndarray:
    """log weights of the vocabulary's pieces, fitted to words and their counts (word, c).

    One expected number per piece comes to the driver in each round, whatever the number of words. No round lowers the
    likelihood (but for the prior's share), so the rounds end.
    """
    first = lattice(vocabulary)
    values = first.values

    def expect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(vocabulary).weighted(values)
        uses, sums = np.zeros(len(values)), np.zeros(2)

        def take() -> None:
            c = np.concatenate(counts)
            sums[:] += float(c @ model.many(words, c, uses)), c.sum()

        words, counts, size = [], [], 0
        for batch in batches:  # the recursion is over many words at once, batches are small
            words += [w.encode() for w in batch.column(0).to_pylist()]
            counts.append(batch.column(1).to_numpy().astype(float))
            size += batch.column(0).nbytes
            if size >= STRETCH_BYTES:
                take()
                words, counts, size = [], [], 0
        if words:
            take()
        some = np.flatnonzero(uses)
        piece = np.concatenate([some, [_LIKELIHOOD, _TOKENS]])
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(np.concatenate([uses[some], sums]), pa.float64())], names=["piece", "uses"])

    before = -inf
    while True:
        found = dict(words.select("word", "c").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses")).collect())
        tokens, total = found.pop(_TOKENS, 0.0), found.pop(_LIKELIHOOD, 0.0)
        if not tokens:
            return values
        uses = np.zeros(len(values))
        uses[list(found)] = list(found.values())
        values = first.maximised(uses, first.values).values
        mean = total / tokens / log(10)
        if mean - before < tolerance:
            return values
        before = mean


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", block_bytes: int = BLOCK_BYTES, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score.

    score is the log10 marginal probability of the text: of each word, N / (N + V) times the share that it has in
    the N training tokens, and V / (N + V) times its marginal over the trained vocabulary pieces; that is the sum over
    all segmentations, the whole word's edge included. lattice_score is that of the pieces alone, with the end's share
    of training tokens as its chance after each word. Null and empty texts are an end alone; a null id counts as the
    text "" when folds are dealt; repeated rows are texts of their own; words may have any length. Without training
    documents N and V are 0, the vocabulary's own scores are the model, and the end's share is 1/2. Other columns are
    not read; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = stored(_blocks(docs, id_col, text_col, block_bytes), "lm-blocks")
    # END is the first word of each block; its counts need no exchange
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w")).where("pos > 0").select("block", "pos", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = stored(pairs.groupBy("word").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("times")), "lm-words")
    total = blocks.agg(F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")), F.sum(F.expr("counts[0]"))).first()
    n_all, n_ends = total[0] or 0, total[1] or 0
    seen, rows = words.agg(F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum("times"), F.lit(0))).first()
    distinct = seen + (1 if n_ends else 0)
    trained = train(words.where("c > 0"), vocabulary, tolerance)
    end_share = n_ends / n_all if n_all else 0.5

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(vocabulary).weighted(trained)
        held, size = [], 0

        def row() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            marginal = model.many([w.encode() for w in whole.column(0).to_pylist()])
            return pa.RecordBatch.from_arrays([*whole.columns, pa.array(marginal, pa.float64())], names=["word", "c", "times", "m"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(0).nbytes
            if size >= STRETCH_BYTES:
                yield row()
                held, size = [], 0
        if held:
            yield row()

    weighed = stored(words.mapInArrow(weigh, "word string, c long, times long, m double"), "lm-marginals")

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []

        def row() -> pa.RecordBatch:
            both = [pa.array([np.concatenate(p).tobytes()], pa.binary()) for p in zip(*parts, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *both], names=["b", "c", "m"])

        for batch in batches:
            b, c, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if b[lo] != block and block is not None:
                    yield row()
                    parts = []
                block = int(b[lo])
                parts.append((c[lo:hi].astype(np.int64), m[lo:hi].astype(float)))
        if block is not None:
            yield row()

    counted = split_join(pairs.select("block", "pos", "word"), weighed, "word", "times", rows, "inner", ("block",)).select("block", "pos", "c", "m")
    known = stored(counted.repartition("block").sortWithinPartitions("block", "pos").mapInArrow(gather, "b long, c binary, m binary"), "lm-counts")
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for k in range(batch.num_rows):
                c = np.concatenate(([n_ends], np.frombuffer(batch.column(4)[k].as_py() or b"", np.int64)))
                sizes = np.array(batch.column(2)[k].as_py(), np.int64)
                flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column(3)[k].as_py()), np.int32)
                own = np.frombuffer(batch.column(5)[k].as_py() or b"", np.float64) + np.log1p(-min(end_share, 1 - 1e-9))
                marginal = np.concatenate(([log(end_share) if end_share else -np.inf], own))
                base = np.log10((c + SMOOTH) / (n_all + SMOOTH * (distinct + 1)))
                if n_all:
                    adapted = np.logaddexp(np.log(np.maximum(c, 1e-300)), np.log(distinct) + marginal) - np.log(n_all + distinct)
                else:
                    adapted = marginal
                ends = list(accumulate(sizes.tolist()))
                starts = [0, *ends[:-1]]
                sums = [np.add.reduceat(v[flat], starts) for v in (base, adapted / log(10), marginal / log(10))] if len(starts) else [[]] * 3
                known_tokens = np.add.reduceat((c > 0)[flat].astype(np.int64), starts)
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[k].values, batch.column(1)[k].values, pa.array(sizes), pa.array(known_tokens), pa.array([n_all] * n, pa.int64()), *map(pa.array, sums)],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score"],
                )

    together = blocks.join(known, F.col("block") == F.col("b"), "left").select("ids", "held", "sizes", "tokens", "c", "m")
    return together.mapInArrow(score, schema).withColumnRenamed("id", id_col)
