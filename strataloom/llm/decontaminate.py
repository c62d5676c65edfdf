"""Benchmark decontamination by a generalised suffix automaton of normalised test items.

The automaton is over word numbers. Training words are streamed through it and the longest suffix that also
occurs in some item is tracked; at a length of a whole window (10 words, or a shorter item's whole text), the
words that it covers are hit. Words outside the items' vocabulary, and neighbours that no item has side by
side, end every match, so numpy cuts a text at those first and only the stretches between are streamed.

Items are dealt into blocks of bounded size, each with its own automaton. Tasks get the items' words (compressed, in
passes of bounded size) and build the automata: up to HELD_BLOCKS are kept by a worker, more are built one after
another for each stretch of texts, so that what a worker holds does not grow with the items.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import alone, bounded_batches, remember, stored

WINDOW = 10
#: Words of test items in one automaton; it has at most twice as many states (some 500 bytes each).
BLOCK_WORDS = 200_000
#: Automata that a worker keeps; bytes of texts that meet one automaton after another where there are more.
HELD_BLOCKS, STRETCH_BYTES = 2, 32_000_000
#: Bytes of compressed items that are broadcast in one pass over the texts; larger sets of items take several passes.
PASS_BYTES = 64_000_000
# Fixed value: bytes of words after A-Z are lower-cased; all others part them.
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if (b + 32 if 0x41 <= b <= 0x5A else b) in _WORD_BYTES else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then words: in UTF-8, runs of digits, a-z and bytes from 0x80 on."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class _Numbers(dict):
    """Word to number; 0 for words of no item, which are not kept."""

    def __missing__(self, key: bytes) -> int:
        return 0


class SuffixAutomaton:
    """Of several sequences: each state stands for the strings with one set of ending places."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, set[int]] = {}

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of p's strings with c behind them, parted from q's longer ones."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # an earlier item has this prefix
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, {}, -1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, sequence: list[int]) -> None:
        state = 0
        for c in sequence:
            state = self._extend(state, c)

    def mark(self, sequence: list[int], item: int, least: int) -> None:
        """Note the item at every state of its strings of `least` words or more; to be called when all sequences are in."""
        state = 0
        for c in sequence:
            state = up = self.next[state][c]
            while self.length[up] >= least and item not in self.items.setdefault(up, set()):
                self.items[up].add(item)
                up = self.link[up]


@dataclass
class Block:
    """An automaton and what the stream needs beside it."""

    numbers: _Numbers
    automaton: SuffixAutomaton
    ids: list[int]
    pairs: np.ndarray
    shortest: int
    whole: dict[tuple[int, int], set[int]]  # (state, length): short items that are that string
    lengths: list[int]  # of short items

    @classmethod
    def of(cls, items: list[tuple[int, list[bytes]]], window: int) -> Block:
        numbers, automaton = _Numbers(), SuffixAutomaton()
        coded = [(i, [numbers.setdefault(w, len(numbers) + 1) for w in words]) for i, words in items]
        for _, sequence in coded:
            automaton.add(sequence)
        for k, (_, sequence) in enumerate(coded):
            automaton.mark(sequence, k, window)
        pairs = {a * (len(numbers) + 1) + b for _, s in coded for a, b in zip(s, s[1:], strict=False)}
        whole: dict[tuple[int, int], set[int]] = {}
        for k, (_, s) in enumerate(coded):
            if len(s) < window:
                state = 0
                for c in s:
                    state = automaton.next[state][c]
                whole.setdefault((state, len(s)), set()).add(k)
        return cls(numbers, automaton, [i for i, _ in items], np.array(sorted(pairs), np.int64), min([window, *(len(s) for _, s in coded)]), whole, sorted({n for _, n in whole}))

    def stream(self, words: list[bytes], window: int, hit: np.ndarray, short: np.ndarray) -> set[int]:
        """Mark hit words, and those of short items; return the items (by place in ids) of which a window occurs."""
        n = len(words)
        coded = np.fromiter(map(self.numbers.__getitem__, words), np.int64, n)
        found: set[int] = set()
        if n < self.shortest:
            return found
        if self.shortest > 1:
            key = coded[:-1] * (len(self.numbers) + 1) + coded[1:]
            place = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
            joined = (coded[:-1] > 0) & (self.pairs[place] == key) if len(self.pairs) else np.zeros(n - 1, bool)
            edge = np.diff(np.concatenate(([0], joined.view(np.int8), [0])))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        else:
            edge = np.diff(np.concatenate(([0], (coded > 0).view(np.int8), [0])))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= self.shortest
        step, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            state = size = 0
            for i, c in enumerate(coded[a:b].tolist(), a):
                while state and c not in step[state]:
                    state = link[state]
                    size = length[state]
                if c in step[state]:
                    state = step[state][c]
                    size += 1
                if size >= window:
                    hit[i - window + 1 : i + 1] = True  # words before these were hit when the match was shorter
                    up = state
                    while length[link[up]] >= window:
                        up = link[up]
                    found |= self.automaton.items[up]
                for m in self.lengths:
                    if m > size:
                        break
                    up = state
                    while length[link[up]] >= m:
                        up = link[up]
                    if (up, m) in self.whole:
                        hit[i - m + 1 : i + 1] = short[i - m + 1 : i + 1] = True
                        found |= self.whole[up, m]
        return found


def item_blocks(items: DataFrame, item_id: str, text_col: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """size, items: bounded blocks of items with an id and words, each as one compressed list; a longer item is a block."""
    named = items.select(F.col(item_id).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    chars = named.agg(F.sum(F.length("t"))).first()[0] or 0

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held, size = [], 0

        def block() -> pa.RecordBatch:
            content = zstandard.ZstdCompressor(level=3).compress(pickle.dumps(held))
            return pa.RecordBatch.from_arrays([pa.array([len(content)], pa.int64()), pa.array([content], pa.binary())], names=["size", "items"])

        for batch in batches:
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                if words:
                    held.append((i, b" ".join(words)))
                    size += len(words)
                if size >= block_words:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    return named.repartition(max(1, -(-chars // (block_words * 8))), "i").mapInArrow(deal, "size long, items binary")


def open_block(content: bytes, window: int) -> Block:
    import zstandard

    return Block.of([(i, words.split(b" ")) for i, words in pickle.loads(zstandard.ZstdDecompressor().decompress(content))], window)


_kept: dict[tuple[str, int], Block] = {}
remember("automata", _kept.clear)


def automata(name: str, contents: list[bytes], window: int) -> Iterator[Block]:
    """The blocks' automata: a few are kept by the worker, more are built one after another."""
    for k, content in enumerate(contents):
        if len(contents) > HELD_BLOCKS:
            yield open_block(content, window)
        else:
            if (name, k) not in _kept:
                for other in [x for x in _kept if x[0] != name]:
                    del _kept[other]
                _kept[name, k] = open_block(content, window)
            yield _kept[name, k]


@dataclass(frozen=True)
class Limits:
    """Spans of at least span_words hit words, or with a whole short item, are cut; a text hit by more than coverage goes as a whole."""

    span_words: int = 10
    coverage: float = 0.5


def clean_text(text: str, hit: np.ndarray, short: np.ndarray, limits: Limits) -> tuple[str | None, list[tuple[int, int]]]:
    """The text without its exceeding spans (None where it goes as a whole), and the spans in code points."""
    if not hit.any():
        return text, []
    places = [m.span() for m in _WORD.finditer(text)]
    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    runs = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)
    spans = [(places[a][0], places[b - 1][1]) for a, b in runs if b - a >= limits.span_words or short[a:b].any() or b - a == len(places)]
    if hit.mean() > limits.coverage:
        return None, spans
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]]), spans


SCHEMA = "id {id}, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, spans array<struct<s:long,e:long>>, clean string"


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    limits: Limits | None = None,
    block_words: int = BLOCK_WORDS,
    with_text: bool = True,
    carry: tuple[str, ...] = (),
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Find test items in texts: id_col, n_words, n_hit, n_items, items_sha256, contaminated, items, spans, clean, carry.

    items has the ids whose windows occur, as sorted strings; spans the removed parts in code points; clean
    the text without them, null where the coverage limit removes it all (and for a null text). Null and empty
    texts have no words and no hits; repeated rows are each judged; items without words or id are left out, and
    without items nothing is hit; columns that are not named are not read.
    """
    limits = limits or Limits()
    bounded_batches(docs.sparkSession)
    blocks = stored(item_blocks(items, item_id, item_text, block_words), "test-items")
    sizes = [r[0] for r in blocks.select("size").collect()]
    passes = max(1, -(-sum(sizes) // pass_bytes))
    # one number per block comes to the driver beside what a pass broadcasts
    numbered = blocks.withColumn("pass", F.pmod(F.xxhash64("items"), F.lit(passes)))
    state = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).withColumn("seen", F.lit(None).cast(SEEN))
    for k in range(passes - 1):
        state = stored(_pass(state, numbered.where(F.col("pass") == k), window, None), "test-items-seen")
    kind, extra = docs.schema[id_col].dataType.simpleString(), "".join(f", {f.name} {f.dataType.simpleString()}" for f in state.schema[2:-1])
    out = _pass(state, numbered.where(F.col("pass") == passes - 1), window, (limits, with_text, SCHEMA.format(id=kind) + extra))
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "items", "spans", "clean",
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)],
    )


#: What earlier passes have found: hit words, those of short items (a bit each), and item ids.
SEEN = "struct<hit:binary,short:binary,items:array<string>>"


def _pass(state: DataFrame, blocks: DataFrame, window: int, final: tuple[Limits, bool, str] | None) -> DataFrame:
    """One pass of all texts over some blocks; state has t, id, carried columns and seen. The last pass reports."""
    shared = state.sparkSession.sparkContext.broadcast([bytes(r[0]) for r in blocks.select("items").collect()])
    name = uuid.uuid4().hex
    types = [*[pa.int64()] * 3, pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.string()]
    seen_type = pa.struct([("hit", pa.binary()), ("short", pa.binary()), ("items", pa.list_(pa.string()))])

    def found(texts: list[str | None], seen: list[dict | None]) -> list[tuple]:
        """words, hit, short and item ids of each text."""
        out = []
        for text, s in zip(texts, seen, strict=True):
            words = words_of(text)
            n = len(words)
            hit, short = (np.unpackbits(np.frombuffer(s[c], np.uint8), count=n).astype(bool) if s else np.zeros(n, bool) for c in ("hit", "short"))
            out.append((words, hit, short, set(s["items"] if s else ())))
        for block in automata(name, shared.value, window):
            for words, hit, short, ids in out:
                ids |= {str(block.ids[k]) for k in block.stream(words, window, hit, short)}
        return out

    def report(text: str | None, words: list, hit: np.ndarray, short: np.ndarray, ids: set) -> tuple:
        limits, with_text, _ = final
        names = sorted(ids)
        clean, spans = clean_text(text, hit, short, limits) if with_text and text is not None else (None, [])
        return len(words), int(hit.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), names, [{"s": s, "e": e} for s, e in spans], clean

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("automata")
        for part in _stretches(batches, len(shared.value) > HELD_BLOCKS):
            texts = part.column(0).to_pylist()
            got = found(texts, part.column(part.num_columns - 1).to_pylist())
            carried, names = part.columns[2:-1], part.schema.names[2:-1]
            if final is None:
                kept = [{"hit": np.packbits(h).tobytes(), "short": np.packbits(s).tobytes(), "items": sorted(i)} for _, h, s, i in got]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(kept, seen_type)], names=part.schema.names)
                continue
            columns = list(zip(*(report(t, *g) for t, g in zip(texts, got, strict=True)), strict=True)) or [[]] * len(types)
            made = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(1), *made, *carried], names=["id", "n_words", "n_hit", "n_items", "items_sha256", "items", "spans", "clean", *names])

    return state.mapInArrow(judge, final[2] if final else state.schema)


def _stretches(batches: Iterable[pa.RecordBatch], long: bool) -> Iterator[pa.RecordBatch]:
    """Batches of up to 1,000 rows; where automata are built anew for each, of about STRETCH_BYTES."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            held.append(part)
            size += part.get_total_buffer_size() * part.num_rows // max(1, batch.num_rows) if long else STRETCH_BYTES
            if size >= STRETCH_BYTES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
