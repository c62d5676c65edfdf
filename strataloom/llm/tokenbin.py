"""Token ids in binary files, bit-plane shuffled.

A file holds the ids of consecutive documents. Ids are dealt into chunks of a fixed number; a chunk's ids are
transposed into planes (one per byte of the id, or one per bit) and each plane is compressed with zstandard
by itself, so that the almost constant high planes cost next to nothing. A chunk index and a document index at
the end let a reader fetch one document by decoding the chunks that it lies in.

    file    = "SLPLANE1" chunk* index index_length(u64) "SLPLANE1"
    chunk   = planes, each a zstandard frame
    index   = zstandard frame of JSON {kind, chunk_ids, n_ids, chunks: [[offset, [plane sizes]]], docs, lengths}

Files are ranges of ascending document ids: one range exchange and a sort inside each range, then each task
writes its range as files of a bounded size under a temporary name that is moved into place when complete, so
a task that runs again leaves the same files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fasttok import public_file, tokenizer
from .shared import alone, bounded_batches, stored

MAGIC = b"SLPLANE1"
SUFFIX = ".planes"
CHUNK_IDS = 65_536
#: A file is closed at this many ids (16 MB before compression).
FILE_IDS = 4_000_000
#: Rows that a range holds, until there are MOST_RANGES; ranges then grow, but files and memory do not.
RANGE_ROWS = 8_192
MOST_RANGES = 8_192
END_ID = 2


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of little-endian 32-bit ids: four of bytes, or 32 of bits."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(octets[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).copy().view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


def encode_file(docs: list[int | None], ids: list[bytes], kind: str = "byte", chunk_ids: int = CHUNK_IDS, level: int = 3) -> bytes:
    import zstandard

    press = zstandard.ZstdCompressor(level=level).compress
    flat = np.frombuffer(b"".join(ids), "<u4")
    out, chunks, at = [MAGIC], [], len(MAGIC)
    for i in range(0, len(flat), chunk_ids):
        planes = [press(p) for p in to_planes(flat[i : i + chunk_ids], kind)]
        chunks.append([at, [len(p) for p in planes]])
        out += planes
        at += sum(map(len, planes))
    index = press(json.dumps({"kind": kind, "chunk_ids": chunk_ids, "n_ids": len(flat), "chunks": chunks, "docs": docs, "lengths": [len(x) // 4 for x in ids]}).encode())
    return b"".join([*out, index, len(index).to_bytes(8, "little"), MAGIC])


def read_index(content: bytes) -> dict:
    import zstandard

    if content[:8] != MAGIC or content[-8:] != MAGIC:
        raise ValueError("not a complete plane file")
    n = int.from_bytes(content[-16:-8], "little")
    return json.loads(zstandard.ZstdDecompressor().decompress(content[-16 - n : -16]))


def read_ids(content: bytes, index: dict, first: int, last: int) -> np.ndarray:
    """Ids first to last (exclusive) of the file, from the chunks that hold them."""
    import zstandard

    size, parts = index["chunk_ids"], []
    expand = zstandard.ZstdDecompressor().decompress
    for k in range(first // size, -(-last // size) if last > first else first // size):
        at, planes = index["chunks"][k][0], []
        for n in index["chunks"][k][1]:
            planes.append(expand(content[at : at + n]))
            at += n
        ids = from_planes(planes, min(size, index["n_ids"] - k * size), index["kind"])
        parts.append(ids[max(0, first - k * size) : last - k * size])
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _put(folder: str, name: str, content: bytes) -> None:
    """Write a whole file under another name, then move it into place."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    temporary = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as f:
        f.write(content)
    store.move(temporary, f"{path}/{name}")


MANIFEST = "shard int, file_no int, name string, n_docs long, n_ids long, n_bytes long"


def write_token_files(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int = END_ID,
    kind: str = "byte",
    chunk_ids: int = CHUNK_IDS,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write the ids of every document, each with end_id behind it, to files in folder; return their manifest.

    Documents are in ascending order of id_col (whole numbers; nulls first, repeated ids by text) over shard,
    file_no and place. Null and empty texts have end_id only. An empty table writes no file. Other columns
    are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    ranges = min(MOST_RANGES, max(1, -(-docs.count() // RANGE_ROWS)))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("pieces")
        coder, end = tokenizer(public_file(vocabulary)), end_id.to_bytes(4, "little")
        shard, made, ids, parts, held = TaskContext.get().partitionId(), [], [], [], 0

        def close() -> None:
            name, content = f"{shard:06d}-{len(made):06d}{SUFFIX}", encode_file(ids, parts, kind, chunk_ids)
            _put(folder, name, content)
            made.append((shard, len(made), name, len(ids), held, len(content)))

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                parts.append((coder.encode(t) if t else b"") + end)
                held += len(parts[-1]) // 4
                if held >= file_ids:
                    close()
                    ids, parts, held = [], [], 0
        if ids:
            close()
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(types)], names=[f.split()[0] for f in MANIFEST.split(", ")])

    dealt = rows.repartitionByRange(ranges, "id").sortWithinPartitions(F.col("id").asc_nulls_first(), "t")
    return stored(dealt.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document in the files: id_col, start (ids of all documents before it), n_tokens, ids (binary)."""
    files = manifest.select("shard", "file_no", "n_ids")
    totals = sorted(files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # at most MOST_RANGES rows
    before = spark.createDataFrame(
        [(r["shard"], at) for r, at in zip(totals, accumulate([0, *[r["n"] for r in totals]]), strict=False)], "shard int, before long"
    )
    earlier = Window.partitionBy("shard").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.withColumn("inside", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).join(F.broadcast(before), "shard").select(
        F.col("shard").alias("b_shard"), F.col("file_no").alias("b_file_no"), (F.col("before") + F.col("inside")).alias("base")
    )

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                shard, number = path.as_py().rsplit("/", 1)[-1].removesuffix(SUFFIX).split("-")
                data = content.as_py()
                index = read_index(data)
                start = 0
                for i in range(0, len(index["docs"]), 1000):
                    ids, sizes = index["docs"][i : i + 1000], index["lengths"][i : i + 1000]
                    ends = [start, *(start + n for n in accumulate(sizes))]
                    flat = read_ids(data, index, start, ends[-1]).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(shard)] * len(ids), pa.int32()),
                            pa.array([int(number)] * len(ids), pa.int32()),
                            pa.array(ids, pa.int64()),
                            pa.array(ends[:-1], pa.int64()),
                            pa.array(sizes, pa.int64()),
                            pa.array([flat[4 * (a - start) : 4 * (b - start)] for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
                        ],
                        names=["shard", "file_no", "id", "inside_file", "n_tokens", "ids"],
                    )
                    start = ends[-1]

    if not totals:  # no documents, so no folder
        return spark.createDataFrame([], f"{id_col} long, start long, n_tokens long, ids binary")
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("path", "content")
    rows = found.mapInArrow(decode, "shard int, file_no int, id long, inside_file long, n_tokens long, ids binary")
    few = manifest.count() <= 100_000
    return rows.join(
        F.broadcast(bases) if few else bases, (F.col("shard") == F.col("b_shard")) & (F.col("file_no") == F.col("b_file_no"))
    ).select(F.col("id").alias(id_col), (F.col("base") + F.col("inside_file")).alias("start"), "n_tokens", "ids")
