"""Best-fit decreasing packing of documents into fixed windows.

Each task packs the documents that it reads, in groups of a bounded number of ids: no shuffle, and a lost
executor costs its own tasks only. Overlong documents are first cut into full windows, each a sequence of its
own. The remaining pieces, longest first, go to the open window with the least room that still holds them; a
segment tree over remaining capacities finds it in log2(capacity) steps. Windows that the last pieces of a
group leave part-empty are cut at powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fasttok import forget_pieces, public_file, tokenizer
from .shared import alone, bounded_batches, give_back

WINDOW = 4096
END_ID = 2
#: Ids packed together in one task: about 1,000 windows, 16 MB.
GROUP_IDS = 4_000_000
#: A window with more than this share of padding is cut at powers of two.
PADDING = 0.02
SEQUENCES_PER_TASK = 33  # bits


class CapacityTree:
    """Open windows by remaining capacity; the tree's leaves count them, inner nodes hold sums."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, window) of the tightest open window with this room at least."""
        node = self.leaves + least
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of indexes into lengths (each between 1 and capacity)."""
    tree, windows = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[i])
        if found is None:
            windows.append([i])
            room = capacity - lengths[i]
            number = len(windows) - 1
        else:
            room, number = found
            windows[number].append(i)
            room -= lengths[i]
        if room:
            tree.add(room, number)
    return windows


def plan_group(sizes: list[int], capacity: int, padding: float = PADDING) -> list[list[tuple[int, int, int]]]:
    """Sequences for documents of these sizes: lists of (document, start, length), in order of offset."""
    full, rest = [], []
    for d, n in enumerate(sizes):
        cut = n - n % capacity
        full += [[(d, s, capacity)] for s in range(0, cut, capacity)]
        if n > cut:
            rest.append((d, cut, n - cut))
    for window in best_fit_decreasing([p[2] for p in rest], capacity):
        pieces = [rest[i] for i in window]
        total = sum(p[2] for p in pieces)
        while pieces and total < capacity * (1 - padding):
            size = 1 << (total.bit_length() - 1)  # the largest power of two that these pieces fill
            head, got = [], 0
            while got < size:
                d, s, n = pieces.pop(0)
                take = min(n, size - got)
                head.append((d, s, take))
                got += take
                if take < n:
                    pieces.insert(0, (d, s + take, n - take))
            full.append(head)
            total -= size
        if pieces:
            full.append(pieces)
    return full


SCHEMA = "id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "word_bpe_49k.json",
    window: int = WINDOW,
    end_id: int = END_ID,
    group_ids: int = GROUP_IDS,
    forget: bool = False,
) -> DataFrame:
    """One row per piece: id_col, start, length, ids (little-endian unsigned 32 bit), doc_tokens, sequence_id, offset.

    Every document's ids and its end id lie in exactly one piece each; null and empty texts have the end id
    only; repeated rows (or ids) are documents of their own; null ids stay; an empty table gives no rows;
    other columns are not read. A sequence's pieces are gapless from offset 0 and at most `window` ids long.
    With forget, workers keep no pieces of text between tasks: more CPU seconds, less memory where others follow.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = docs.select(F.col(id_col).alias("id")).schema

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = pa.schema([*to_arrow_schema(id_type), *[(n, pa.int64()) for n in ("start", "length")], ("ids", pa.binary()), *[(n, pa.int64()) for n in ("doc_tokens", "sequence_id", "offset")]])
        alone("pieces")
        coder, end = tokenizer(public_file(vocabulary)), end_id.to_bytes(4, "little")
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << SEQUENCES_PER_TASK
        ids, parts, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, parts, held, sequence
            columns: list[list] = [[] for _ in range(7)]
            for pieces in plan_group([len(p) // 4 for p in parts], window):
                offset = 0
                for d, start, length in pieces:
                    for c, v in zip(columns, (ids[d], start, length, parts[d][4 * start : 4 * (start + length)], len(parts[d]) // 4, sequence, offset), strict=True):
                        c.append(v)
                    offset += length
                sequence += 1
            ids, parts, held = [], [], 0
            for i in range(0, len(columns[0]), 4000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 4000], f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                parts.append((coder.encode(t) if t else b"") + end)
                held += len(parts[-1]) // 4
                if held >= group_ids:
                    yield from flush()
        if ids:
            yield from flush()
        if forget:
            forget_pieces()
        give_back()

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(pack, SCHEMA.format(id=kind))
    return out.withColumnRenamed("id", id_col)
