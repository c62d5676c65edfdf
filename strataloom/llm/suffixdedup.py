"""Removal of bytes that repeat from earlier documents: distributed suffix sorting of sampled suffixes.

A string of 50 bytes repeats exactly where the suffixes that start in it do. Of the suffixes it is enough to
sort sampled ones: each 50-byte window has an anchor, the leftmost position among its first 31 whose 20-byte
string has the smallest hash. Equal windows have equal anchors at equal offsets, so the windows of two
documents that are equal lie around suffixes with 20 equal bytes, and sorting the anchors' suffixes brings
them together. About one position in 16 is an anchor.

1. Texts are read into blocks of bounded size, a table bucketed by block, so that later joins move no text.
2. Blocks send the distinct hashes of their anchors, dealt by hash; those met in one document only cannot be
   shared, and their suffixes are left out of the sort.
3. Each block sorts the suffixes of its shared anchors, one for each distinct context with the smallest
   document id that has it, and exchanges them as front-coded runs by key range. A range merges its runs by a
   stable sort, which finds them in order. Neighbours with 20 equal bytes are one group; in it the
   windows, which reach up to 30 bytes to the left of the anchor, are compared as whole 50-byte strings, and
   each gets the smallest document id that has it.
4. These go back to the blocks, which mark what an earlier document has.

A passage that very many documents share is one suffix per block, however many documents have it. A 20-byte
string that occurs HOT times or more (a rule, a run of blanks) would be one group with all of its contexts, so its
suffixes are dealt by further bytes: windows that reach 15 bytes beyond it by those bytes, all others by the 15
bytes before it, which they hold whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, fresh_path, stored, until_end
from .suffixmerge import front_code_rows, front_decode_rows

LENGTH = 50
GRAM = 20
REACH = LENGTH - GRAM  # bytes of a window before its anchor, at most
#: Bytes of text in a block, at least one document.
BLOCK_BYTES = 16_000_000
#: 20-byte strings that are hashed at once, a power of two: few enough for a core's cache.
SEGMENT = 1 << 15
#: Key ranges, and partitions of any exchange, at most. Beyond this many blocks each range is merged in several parts,
#: one after another, so what a task holds does not grow with the data.
MOST_RANGES = 16_384
#: Occurrences from which a 20-byte string's suffixes are dealt by SIDE further bytes.
HOT, SIDE = 4_096, 15
#: Suffixes in the sample that parts the key ranges.
SAMPLE = 10_000
#: Rows of a range that are resolved at once (groups are never parted).
RESOLVE_ROWS = 30_000
#: Bytes of runs in a batch.
SENT_BYTES = 1 << 20
#: Of a 64-bit hash, those that tell which strings are shared; strings with one hash are only sorted in vain.
KEY_BITS = 48
_MUL = 0x9E3779B97F4A7C15
_U = np.uint64
_NO_ID = np.iinfo(np.int64).max


@dataclass
class Anchors:
    at: np.ndarray  # of the anchor in the block
    low: np.ndarray  # first and last window start, relative to it
    high: np.ndarray
    hash: np.ndarray
    doc: np.ndarray  # place of the document in the block


def gram_ranks(data: np.ndarray) -> np.ndarray:
    """32-bit hashes of the 20-byte strings at each position: by doubling, 1, 2, 4, 8, 16, 16 + 4."""
    h, held = data.astype(np.uint32) + np.uint32(1), {}
    for n in (1, 2, 4, 8):
        h = h[:-n] * np.uint32(pow(_MUL, n, 1 << 32)) + h[n:]
        held[2 * n] = h
    m = len(data) - GRAM + 1
    h = held[16][:m] * np.uint32(pow(_MUL, 4, 1 << 32)) + held[4][16 : 16 + m]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def gram_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the 20-byte strings at these positions."""
    words = np.zeros((len(at), 24), np.uint8)
    if len(at):
        words[:, :GRAM] = np.lib.stride_tricks.sliding_window_view(data, GRAM)[at]
    words = words.view("<u8")
    h = np.zeros(len(at), _U)
    for j in range(3):
        h = (h + words[:, j] + _U(1)) * _U(_MUL)
        h ^= h >> _U(29 + j)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
    return h


def find_anchors(data: np.ndarray, sizes: np.ndarray) -> Anchors:
    """The anchors of all windows that lie within one document each; documents lie one behind another.

    A position's number in its segment stands in the low bits of its string's hash, so one minimum finds the
    smallest hash and, of equal ones, the leftmost.
    """
    whole = np.maximum(sizes - (LENGTH - 1), 0)  # window starts of each document; from the others a window would leave it
    good_at = np.repeat(np.tile([True, False], len(sizes)), np.stack((whole, sizes - whole), axis=1).reshape(-1))
    low_bits = np.uint32(SEGMENT - 1)
    number = np.arange(SEGMENT, dtype=np.uint32)
    parts: list[tuple] = []
    last = len(data) - LENGTH + 1
    for lo in range(0, max(0, last), SEGMENT - REACH):
        hi = min(lo + SEGMENT - REACH, last)
        good = good_at[lo:hi]
        if not good.any():
            continue
        ranks = gram_ranks(data[lo : hi + LENGTH - 1])
        value = (ranks & ~low_bits) | number[: len(ranks)]
        width = 1
        while width < REACH + 1:
            step = min(width, REACH + 1 - width)
            value = np.minimum(value[: len(value) - step], value[step:])
            width += step
        value &= low_bits
        cut = np.flatnonzero((value[1:] != value[:-1]) | (good[1:] != good[:-1])) + 1
        cut = np.concatenate(([0], cut))
        stop = np.append(cut[1:], hi - lo) - 1
        real = good[cut]
        cut, stop = cut[real], stop[real]
        index = value[cut].astype(np.int64)
        at = index + lo
        parts.append((at, (cut - index).astype(np.int8), (stop - index).astype(np.int8), gram_hashes(data, at)))
    if not parts:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int8), np.zeros(0, _U))]
    at, low, high, key = (np.concatenate(c) for c in zip(*parts, strict=True))
    return Anchors(at, low, high, key, np.searchsorted(np.cumsum(sizes), at, side="right").astype(np.int32))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted distinct numbers as compressed byte planes of their differences."""
    import zstandard

    steps = np.diff(values, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.T).tobytes())


def unpack_sorted(content: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(content), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=_U)


@dataclass
class Block:
    ids: np.ndarray
    sizes: np.ndarray
    data: np.ndarray

    @classmethod
    def read(cls, ids: list, sizes: list, content: bytes) -> Block:
        import zstandard

        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(content), np.uint8)
        return cls(np.array([_NO_ID if i is None else i for i in ids], np.int64), np.array(sizes, np.int64), data)


#: A suffix row: 50 bytes from the anchor on, the 30 before it (nearest last), low and high plus 31, and a 1.
ROW = LENGTH + REACH + 3


@dataclass
class Shared:
    """Hashes that several documents share, in order, and which of them are hot."""

    keys: np.ndarray
    hot: np.ndarray

    @classmethod
    def read(cls, parts: list[dict]) -> Shared:
        keys = [unpack_sorted(p["keys"]) for p in parts]
        hot = [np.unpackbits(np.frombuffer(p["hot"], np.uint8), count=len(k)).astype(bool) for p, k in zip(parts, keys, strict=True)]
        keys, hot = np.concatenate(keys), np.concatenate(hot)
        order = np.argsort(keys)
        return cls(keys[order], hot[order])


#: Of a suffix row's 50 and 30 bytes, those inside the windows: by high plus 30, and by low plus 30.
_RIGHT = np.where(np.arange(LENGTH)[None, :] < np.arange(-REACH, 1)[:, None] + LENGTH, 255, 0).astype(np.uint8)
_LEFT = np.where(np.arange(-REACH, 0)[None, :] >= np.arange(-REACH, 1)[:, None], 255, 0).astype(np.uint8)


def suffix_rows(block: Block, anchors: Anchors) -> np.ndarray:
    """One row per anchor; bytes outside its windows are 0."""
    rows = np.empty((len(anchors.at), ROW), np.uint8)
    if not len(rows):
        return rows
    around = np.concatenate((np.zeros(REACH, np.uint8), block.data, np.zeros(LENGTH, np.uint8)))
    for i in range(0, len(rows), 10_000):
        to = slice(i, i + 10_000)
        text = np.lib.stride_tricks.sliding_window_view(around, REACH + LENGTH)[anchors.at[to]]
        low, high = anchors.low[to].astype(np.int64) + REACH, anchors.high[to].astype(np.int64) + REACH
        rows[to, :LENGTH] = text[:, REACH:] & _RIGHT[high]
        rows[to, LENGTH:-3] = text[:, :REACH] & _LEFT[low]
        rows[to, -3], rows[to, -2] = low + 1, high + 1
    rows[:, -1] = 1
    return rows


def shared_suffixes(block: Block, shared: Shared) -> tuple[Anchors, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors whose hash is shared; their distinct suffix rows in order; each anchor's row; which rows are hot."""
    found = find_anchors(block.data, block.sizes)
    key = found.hash >> _U(64 - KEY_BITS)
    chosen = place = np.zeros(0, np.int64)
    if len(shared.keys):
        seen = np.zeros(1 << 22, bool)  # by leading bits: leaves most keys out of the search
        seen[shared.keys >> _U(KEY_BITS - 22)] = True
        chosen = np.flatnonzero(seen[key >> _U(KEY_BITS - 22)])
        place = np.minimum(np.searchsorted(shared.keys, key[chosen]), len(shared.keys) - 1)
        real = shared.keys[place] == key[chosen]
        chosen, place = chosen[real], place[real]
    found = Anchors(*(getattr(found, f)[chosen] for f in ("at", "low", "high", "hash", "doc")))
    rows = suffix_rows(block, found)
    distinct, number = np.unique(rows.view(f"S{ROW}").reshape(-1), return_inverse=True)
    hot = np.zeros(len(distinct), bool)
    if len(chosen):
        hot[number] = shared.hot[place]
    return found, distinct.view(np.uint8).reshape(-1, ROW) if len(distinct) else rows, number, hot


def parted(rows: np.ndarray, hot: np.ndarray, parts: int, hot_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with their places and parts: hot ones are dealt by their further bytes, to the right and to the left."""
    plain = np.flatnonzero(~hot)
    sub = (_mixed(rows[plain, :GRAM]) % _U(parts)).astype(np.int64) if parts > 1 else np.zeros(len(plain), np.int64)
    out = [(rows[plain], plain, sub)]
    few = np.flatnonzero(hot)
    for side, columns in enumerate((slice(GRAM, GRAM + SIDE), slice(LENGTH + REACH - SIDE, LENGTH + REACH))):
        these = rows[few].copy()
        if side == 0:  # windows that start less than SIDE + 1 bytes before the anchor hold SIDE bytes behind its string
            these[:, -3] = np.maximum(these[:, -3], REACH + 1 - SIDE)
        else:
            these[:, -2] = np.minimum(these[:, -2], REACH - SIDE)
        good = these[:, -3] <= these[:, -2]
        these = these[good]
        dealt = _mixed(np.concatenate((these[:, :GRAM], these[:, columns]), axis=1)) % _U(hot_parts)
        out.append((these, few[good], parts + 2 * dealt.astype(np.int64) + side))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _mixed(bytes_of: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row."""
    h = np.zeros(len(bytes_of), _U)
    for j in range(bytes_of.shape[1]):
        h = (h ^ bytes_of[:, j]) * _U(_MUL)
        h ^= h >> _U(32)
    return h


def resolve(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For rows of whole groups: the smallest id that has each window, by its start from -30 to 0."""
    n = len(rows)
    text = np.concatenate((rows[:, LENGTH : LENGTH + REACH], rows[:, :LENGTH]), axis=1)  # in page order
    low, high = rows[:, -3].astype(np.int16) - (REACH + 1), rows[:, -2].astype(np.int16) - (REACH + 1)
    prefix = np.zeros((LENGTH + REACH + 1, n), _U)
    columns = np.ascontiguousarray(text.T).astype(_U)
    for j in range(LENGTH + REACH):
        prefix[j + 1] = prefix[j] * _U(_MUL) + columns[j] + _U(1)
    power = _U(pow(_MUL, LENGTH, 1 << 64))
    out = np.full((n, REACH + 1), _NO_ID, np.int64)
    for r in range(-REACH, 1):
        live = np.flatnonzero((low <= r) & (r <= high))
        if not len(live):
            continue
        c = REACH + r
        key = (prefix[c + LENGTH, live] - prefix[c, live] * power) * _U(0xD6E8FEB86659FD93)
        order = np.argsort(key)
        live, key = live[order], key[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        window = text[live, c : c + LENGTH]
        if not (window == window[starts][group]).all():  # two strings of one hash: compare the strings themselves
            group = np.unique(np.ascontiguousarray(window).view(f"V{LENGTH}").reshape(-1), return_inverse=True)[1]
            order = np.argsort(group, kind="stable")
            live, group = live[order], group[order]
            starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        out[live, r + REACH] = np.minimum.reduceat(least[live], starts)[group]
    return out


def _resolved(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """As resolve, of sorted rows; those that several blocks have alike are resolved once."""
    new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))
    return resolve(rows[new], np.minimum.reduceat(least, np.flatnonzero(new)))[np.cumsum(new) - 1]


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids, parts, size = [], [], 0

        def close() -> pa.RecordBatch:
            content = zstandard.ZstdCompressor(level=3).compress(b"".join(parts))
            row = [(block, pa.int64()), (ids, pa.list_(pa.int64())), ([len(p) for p in parts], pa.list_(pa.int64())), (content, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], names=["block", "ids", "sizes", "data"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                parts.append((text or "").encode("utf-8", "surrogatepass"))
                size += len(parts[-1])
                if size >= block_bytes:
                    yield close()
                    block, ids, parts, size = block + 1, [], [], 0
        if ids:
            yield close()

    spark, name, path = docs.sparkSession, f"suffix_blocks_{uuid.uuid4().hex}", fresh_path(docs.sparkSession, "suffix-blocks")
    made = chosen.mapInArrow(read, "block long, ids array<long>, sizes array<long>, data binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.option("path", path).option("compression", "uncompressed").bucketBy(buckets, "block").saveAsTable(name)
    blocks = spark.table(name)
    blocks.schema  # resolved: the name can go, the files stay
    spark.sql(f"DROP TABLE {name}")
    until_end(spark, path)
    return blocks


def _batch(types: list, columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, with_text: bool = False, hot_count: int = HOT) -> DataFrame:
    """One row per row of docs: id_col (as long), n_bytes, n_removed, n_spans, kept_sha256, kept (binary or null).

    A byte is removed where it lies in a 50-byte string of its own document that also starts in a document
    with a smaller id. Null and empty texts have no bytes; a null id counts as larger than all others; rows of
    one id do not remove each other's bytes; matches never cross documents; other columns are not read; an
    empty table gives no rows. kept has the remaining bytes where with_text is set.
    """
    bounded_batches(docs.sparkSession)
    blocks = _blocks(docs, id_col, text_col, block_bytes)
    n_blocks = max(1, blocks.count())
    ranges = min(MOST_RANGES, max(64, 2 * n_blocks))
    parts, hot_parts = -(-2 * n_blocks // MOST_RANGES), max(64, n_blocks)
    buckets = 1 << (max(64, 4 * n_blocks) - 1).bit_length()
    shift = _U(KEY_BITS + 1 - buckets.bit_length())
    spread = min(MOST_RANGES, buckets)
    wanted = max(1, SAMPLE // n_blocks)

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for k in range(batch.num_rows):
                number = batch.column(0)[k].as_py()
                block = Block.read(*(batch.column(c)[k].as_py() for c in (1, 2, 3)))
                found = find_anchors(block.data, block.sizes)
                order = np.argsort(found.hash)
                key, doc = found.hash[order] >> _U(64 - KEY_BITS), found.doc[order]
                new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
                starts = np.flatnonzero(new)
                ids = block.ids[doc]
                several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts) if len(starts) else np.zeros(0, bool)
                times = np.minimum(np.diff(starts, append=len(key)), 255).astype(np.uint8)
                key = key[starts]
                bucket = (key >> shift).astype(np.int64) if len(key) else np.zeros(0, np.int64)
                cuts = np.flatnonzero(np.concatenate(([True], np.diff(bucket) != 0, [True]))) if len(key) else np.zeros(0, np.int64)
                out: list[list] = [[], [], [], [], []]
                for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                    for c, v in zip(out, (int(bucket[a]), number, pack_sorted(key[a:b]), np.packbits(several[a:b]).tobytes(), press(times[a:b].tobytes())), strict=True):
                        c.append(v)
                if len(found.at):
                    picks = np.random.default_rng(number & 0xFFFFFFFF).integers(0, len(found.at), wanted)
                    grams = b"".join(block.data[p : p + GRAM].tobytes() for p in found.at[picks].tolist())
                    for c, v in zip(out, (-1, number, grams, b"", b""), strict=True):
                        c.append(v)
                yield _batch([pa.int64(), pa.int64(), *[pa.binary()] * 3], out, ["bucket", "block", "keys", "several", "times"])

    sent = stored(blocks.select("block", "ids", "sizes", "data").mapInArrow(hashes, "bucket long, block long, keys binary, several binary, times binary"), "suffix-hashes")
    sampled = sent.where("bucket < 0").where(F.pmod(F.xxhash64("block"), F.lit(max(1, n_blocks // SAMPLE))) == 0).select("keys").collect()
    grams = sorted(k[i : i + GRAM] for (k,) in sampled for i in range(0, len(k), GRAM))
    splitters = [bytes(grams[len(grams) * i // ranges]) for i in range(1, ranges)] if grams else []

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        now = None

        def answer() -> pa.RecordBatch:
            keys, marks, times = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            order = np.argsort(keys, kind="stable")
            keys, marks, times = keys[order], marks[order], times[order]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            counts = np.diff(starts, append=len(keys))
            many, hot = np.empty(len(keys), bool), np.empty(len(keys), bool)  # of each key that was sent
            many[order] = np.repeat(np.logical_or.reduceat(marks, starts) | (counts > 1), counts)
            hot[order] = np.repeat(np.add.reduceat(times, starts) >= hot_count, counts)
            out: list[list] = [[], [], []]
            at = 0
            for number, k, _, _ in held:
                good = np.flatnonzero(many[at : at + len(k)])
                if len(good):
                    for c, v in zip(out, (number, pack_sorted(k[good]), np.packbits(hot[at + good]).tobytes()), strict=True):
                        c.append(v)
                at += len(k)
            return _batch([pa.int64(), pa.binary(), pa.binary()], out, ["b", "keys", "hot"])

        for batch in batches:
            for bucket, number, keys, several, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield answer()
                    held = []
                now = bucket
                k = unpack_sorted(keys)
                each = np.frombuffer(zstandard.ZstdDecompressor().decompress(times), np.uint8).astype(np.int64)
                held.append((number, k, np.unpackbits(np.frombuffer(several, np.uint8), count=len(k)).astype(bool), each))
        if held:
            yield answer()

    dealt = sent.where("bucket >= 0").repartition(spread, "bucket").sortWithinPartitions("bucket", "block")
    lists = dealt.mapInArrow(shared, "b long, keys binary, hot binary").groupBy("b").agg(F.sort_array(F.collect_list(F.struct("keys", "hot"))).alias("keys"))
    lists = stored(lists, "suffix-shared")
    pieces = pa.schema([("range", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("run", pa.binary())])

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for k in range(batch.num_rows):
                number = batch.column(0)[k].as_py()
                block = Block.read(*(batch.column(c)[k].as_py() for c in (1, 2, 3)))
                found, rows, which, hot = shared_suffixes(block, Shared.read(batch.column(4)[k].as_py()))
                ids = block.ids[found.doc]
                least, most = np.full(len(rows), _NO_ID, np.int64), np.full(len(rows), -(1 << 63), np.int64)
                np.minimum.at(least, which, ids)
                np.maximum.at(most, which, ids)
                heads = rows[:, :GRAM].copy().view(f"V{GRAM}").reshape(-1)
                range_of = np.searchsorted(_places(heads, splitters), np.arange(len(rows)), side="right")
                rows, place, part = parted(rows, hot, parts, hot_parts)
                order = np.lexsort((place, part, range_of[place]))
                rows, place, part = rows[order], place[order], part[order]
                here = range_of[place]
                cuts = np.flatnonzero(np.concatenate(([True], (np.diff(here) != 0) | (np.diff(part) != 0), [True]))).tolist() if len(rows) else []
                begins = [lo for a, b in zip(cuts, cuts[1:], strict=False) for lo in range(a, b, 100_000)]
                prefixes, rests, offsets = front_code_rows(rows[:, :LENGTH], np.array(begins, np.int64))
                out: list[list] = [[], [], [], []]
                size = 0
                for lo, hi in zip(begins, [*begins[1:], len(rows)], strict=True):
                    at = slice(lo, hi)
                    steps = np.diff(place[at], prepend=0).astype("<i4")
                    run = [prefixes[at], rests[offsets[lo] : offsets[hi]], rows[at, LENGTH : ROW - 1], least[place[at]], most[place[at]], steps]
                    run = (hi - lo).to_bytes(4, "little") + press(b"".join(x.tobytes() for x in run))
                    for c, v in zip(out, (int(here[lo]), int(part[lo]), number, run), strict=True):
                        c.append(v)
                    size += len(run)
                    if size >= SENT_BYTES:
                        yield _batch(pieces.types, out, pieces.names)
                        out, size = [[], [], [], []], 0
                if size:
                    yield _batch(pieces.types, out, pieces.names)

    with_lists = blocks.join(lists, F.col("block") == F.col("b")).select("block", "ids", "sizes", "data", "keys")
    sorted_runs = with_lists.mapInArrow(runs, "range int, part long, block long, run binary")

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        merged: list[Merged] = []
        waiting, now = 0, None
        for batch in batches:
            for r, part, number, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (r, part) != now and held:
                    merged.append(_merged(held))
                    waiting, held = waiting + len(merged[-1].rows), []
                    if waiting >= RESOLVE_ROWS:
                        yield _told(merged)
                        merged, waiting = [], 0
                now = (r, part)
                held.append((number, run))
        if held:
            merged.append(_merged(held))
        if merged:
            yield _told(merged)

    met = sorted_runs.repartition(spread, "range", "part").sortWithinPartitions("range", "part", "block")
    verdicts = stored(met.mapInArrow(merge, "b long, marks binary").groupBy("b").agg(F.sort_array(F.collect_list("marks")).alias("marks")), "suffix-verdicts")
    told = lists.withColumnRenamed("b", "lb").join(verdicts, F.col("lb") == F.col("b")).select("b", "keys", "marks")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block.read(*(batch.column(c)[k].as_py() for c in (1, 2, 3)))
                gone = np.zeros(0, bool)
                if batch.column(4)[k].is_valid:
                    gone = _covered(block, Shared.read(batch.column(4)[k].as_py()), batch.column(5)[k].as_py())
                ids = batch.column(1)[k].values
                yield from _judged(block, gone, ids, with_text)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    final = blocks.join(told, F.col("block") == F.col("b"), "left").select("block", "ids", "sizes", "data", "keys", "marks")
    return final.mapInArrow(apply, schema).withColumnRenamed("id", id_col)


def _places(heads: np.ndarray, splitters: list[bytes]) -> list[int]:
    """Where each splitter falls among sorted 20-byte heads."""
    out, n = [], len(heads)
    for s in splitters:
        lo, hi = out[-1] if out else 0, n
        while lo < hi:
            mid = (lo + hi) // 2
            if heads[mid].tobytes() < s:
                lo = mid + 1
            else:
                hi = mid
        out.append(lo)
    return out


MARK = np.dtype([("row", "<i4"), ("low", "i1"), ("high", "i1"), ("least", "<i8")])


@dataclass
class Merged:
    """A range's rows in order, or a part's."""

    rows: np.ndarray
    least: np.ndarray
    most: np.ndarray
    owner: np.ndarray  # the block, and the row's number there
    number: np.ndarray
    first: np.ndarray  # of a group


def _merged(held: list[tuple[int, bytes]]) -> Merged:
    """Merge a range's runs."""
    import zstandard

    rows, least, most, number = [], [], [], []
    unpress = zstandard.ZstdDecompressor().decompress
    for _, content in held:
        n = int.from_bytes(content[:4], "little")
        data = unpress(content[4:])
        prefixes = np.frombuffer(data, np.uint8, n)
        end = n + n * LENGTH - int(prefixes.sum())
        whole = np.empty((n, ROW), np.uint8)
        whole[:, :LENGTH] = front_decode_rows(prefixes, np.frombuffer(data[n:end], np.uint8), LENGTH)
        whole[:, LENGTH : ROW - 1] = np.frombuffer(data, np.uint8, n * (REACH + 2), end).reshape(n, REACH + 2)
        whole[:, -1] = 1
        rows.append(whole)
        end += n * (REACH + 2)
        ids = np.frombuffer(data, "<i8", 2 * n, end)
        least.append(ids[:n])
        most.append(ids[n:])
        number.append(np.cumsum(np.frombuffer(data, "<i4", n, end + 16 * n)))
    owner = np.repeat(np.array([block for block, _ in held], np.int64), [len(r) for r in rows])
    rows = np.concatenate(rows)
    order = np.argsort(rows.view(f"S{ROW}").reshape(-1), kind="stable")  # a merge: the sort finds the runs
    rows = rows[order]
    first = np.concatenate(([True], (rows[1:, :GRAM] != rows[:-1, :GRAM]).any(axis=1)))
    return Merged(rows, np.concatenate(least)[order], np.concatenate(most)[order], owner[order], np.concatenate(number)[order], first)


def _told(merged: list[Merged]) -> pa.RecordBatch:
    """Tell each block the smallest ids of its rows' windows. Rows of several parts are resolved at once: equal windows lie in one."""
    rows, least, most, owner, number, first = (np.concatenate([getattr(m, f) for m in merged]) for f in ("rows", "least", "most", "owner", "number", "first"))
    starts = np.flatnonzero(first)  # of groups
    parts, at = [], 0
    while at < len(rows):
        k = np.searchsorted(starts, at + RESOLVE_ROWS)
        end = int(starts[k]) if k < len(starts) else len(rows)
        mins = _resolved(rows[at:end], least[at:end])
        change = np.concatenate((np.ones((end - at, 1), bool), mins[:, 1:] != mins[:, :-1]), axis=1)
        line, low = np.nonzero(change)
        high = np.concatenate((low[1:], [0])) - 1
        high[np.concatenate((line[1:] != line[:-1], [True]))] = REACH
        value = mins[line, low]
        useful = value < most[at:end][line]
        marks = np.empty(int(useful.sum()), MARK)
        marks["row"], marks["low"], marks["high"], marks["least"] = number[at:end][line[useful]], low[useful] - REACH, high[useful] - REACH, value[useful]
        parts.append((owner[at:end][line[useful]], marks))
        at = end
    who, marks = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(who, kind="stable")
    who, marks = who[order], marks[order]
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(who) != 0, [True]))).tolist() if len(who) else []
    return _batch([pa.int64(), pa.binary()], [[int(who[a]) for a in cuts[:-1]], [marks[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]], ["b", "marks"])


def _covered(block: Block, shared: Shared, marks: list[bytes] | None) -> np.ndarray:
    """Which of the block's bytes an earlier document has."""
    found, _, which, _ = shared_suffixes(block, shared)
    told = np.frombuffer(b"".join(marks or []), MARK)
    told = told[np.argsort(told["row"], kind="stable")]
    first, last = np.searchsorted(told["row"], which, side="left"), np.searchsorted(told["row"], which, side="right")
    anchor = np.repeat(np.arange(len(which)), last - first)
    mark = told[np.repeat(first, last - first) + np.arange(len(anchor)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)]
    low = np.maximum(mark["low"], found.low[anchor]).astype(np.int64)
    high = np.minimum(mark["high"], found.high[anchor]).astype(np.int64)
    hit = (low <= high) & (mark["least"] < block.ids[found.doc[anchor]])
    begin, end = found.at[anchor][hit] + low[hit], found.at[anchor][hit] + high[hit] + LENGTH
    gone = np.zeros(len(block.data), bool)
    if len(begin):
        order = np.argsort(begin, kind="stable")
        begin, reached = begin[order], np.maximum.accumulate(end[order])
        first = np.flatnonzero(np.concatenate(([True], begin[1:] > reached[:-1])))
        starts, stops = begin[first], reached[np.append(first[1:], len(begin)) - 1]
        edges = np.append(np.stack((starts, stops), axis=1).reshape(-1), len(gone))
        gone = np.repeat(np.arange(len(edges)) % 2 == 1, np.diff(edges, prepend=0))
    return gone


def _judged(block: Block, gone: np.ndarray, ids: pa.Array, with_text: bool) -> Iterator[pa.RecordBatch]:
    columns: list[list] = [[], [], [], [], []]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    begun, start = 0, 0
    for k, size in enumerate(block.sizes.tolist()):
        text, lost = block.data[start : start + size], gone[start : start + size]
        removed = int(lost.sum())
        spans = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum()) if removed else 0
        kept = (text[~lost] if removed else text).tobytes()
        for c, v in zip(columns, (size, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
            c.append(v)
        start += size
        if k + 1 - begun >= 1000 or k + 1 == len(block.sizes):
            yield pa.RecordBatch.from_arrays([ids[begun : k + 1], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)
            columns, begun = [[], [], [], [], []], k + 1
