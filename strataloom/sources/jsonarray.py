"""One large JSON document, read and written by many tasks: the elements of an array under one of its root's keys.

Files are cut into byte ranges by Spark's text reader, at closing braces. What a range means depends on what stands before
it, so it is read three times: for either case (within a string or not) how the range ends and how deep it goes; then,
with each range's beginning known, which root keys and array elements begin in it; then for the elements themselves. The
driver joins up a few numbers and root keys per range. An element that reaches over ranges comes in pieces, and only
pieces are shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..storage import stored

_TOKENS = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("?)|[\[\]{},:]', re.DOTALL)
_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)


class _Reader:
    """What a place in the document is: within a string or not, how deep, under which root key, in an array or not."""

    def __init__(self, quoted: bool, depth: int, key: str | None = None, array: bool = False) -> None:
        self.quoted, self.depth, self.key, self.array, self.string = quoted, depth, key, array, ""

    def events(self, text: str) -> Iterator[tuple[str, int, str]]:
        """kind, place and value of what matters at the root's level and in its arrays: key, open, comma, close."""
        at = 0
        if self.quoted:
            rest = _REST.match(text)
            self.string += text[: rest.end() - 1] if rest else text
            if not rest:
                return
            self.quoted, at = False, rest.end()
        for match in _TOKENS.finditer(text, at):
            c = text[match.start()]
            if c == '"':
                self.quoted = not match.group(1)
                if self.depth == 1 or self.quoted:
                    self.string = text[match.start() + 1 : match.end() - (not self.quoted)]
            elif c in "[{":
                self.depth += 1
                if self.depth == 2:
                    self.array = c == "["
                    yield "open", match.start(), c
            elif c in "]}":
                if self.depth == 2:
                    yield "close", match.start(), ""
                self.depth -= 1
            elif self.depth == 2 and c == ",":
                yield "comma", match.start(), ""
            elif self.depth == 1 and c == ":":
                self.key = json.loads(f'"{self.string}"')
                yield "key", match.start(), self.key


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """file, begin (of its byte range), value: the document's text between closing braces, in order within a range."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """(file, begin) and text of each fragment, with its brace back."""
    for batch in batches:
        for file, begin, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield (file, begin), value + "}"


def _first_pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, begin, and for a beginning outside and inside of a string: whether the range ends in one, and its depth."""
    found: dict[tuple[str, int], list[_Reader]] = {}
    for place, text in _ranges(batches):
        readers = found.setdefault(place, [_Reader(False, 1 << 20), _Reader(True, 1 << 20)])  # so deep that nothing is told
        for r in readers:
            r.string = ""
            for _ in r.events(text):
                pass
    rows = [(f, b, o.quoted, o.depth - (1 << 20), i.quoted, i.depth - (1 << 20)) for (f, b), (o, i) in found.items()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "begin", "out", "out_depth", "in_", "in_depth"])


def _second_pass(starts: dict):
    """file, begin, events of each range: root keys, openings and ends of what they hold, and numbers of commas between."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], tuple[_Reader, list]] = {}
        for place, text in _ranges(batches):
            if place not in found:
                found[place] = (_Reader(*starts[place]), [])
            reader, events = found[place]
            for kind, _, value in reader.events(text):
                if kind != "comma":
                    events.append([kind, value, 1])
                elif events and events[-1][0] == "comma":
                    events[-1][2] += 1
                else:
                    events.append(["comma", "", 1])
        rows = [(f, b, json.dumps(e)) for (f, b), (_, e) in found.items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["file", "begin", "events"])

    return read


def _third_pass(starts: dict, key: str):
    """file, position, begin, whole, text: elements, or pieces of those that reach over ranges."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, reader, inside, position, pieces, whole = None, None, False, 0, [], False
        rows: list[tuple] = []

        def leave(closed: bool) -> None:
            if text := "".join(pieces):
                rows.append((place[0], position, place[1], whole and closed, text))
            pieces.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            rows.clear()
            types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "position", "begin", "whole", "text"])

        for here, text in _ranges(batches):
            if here != place:
                if inside:
                    leave(False)
                place = here
                *state, inside, position = starts[place]
                reader, whole = _Reader(*state), False  # what a range begins with began before it
            last = 0
            for kind, at, _ in reader.events(text):
                if inside and kind in ("comma", "close"):
                    pieces.append(text[last:at])
                    leave(True)
                    inside, position, whole, last = kind == "comma", position + 1, True, at + 1
                elif kind == "open" and reader.key == key and reader.array:
                    inside, position, whole, last = True, 0, True, at + 1
            if inside:
                pieces.append(text[last:])
            if len(rows) >= 1000:
                yield out()
        if inside:
            leave(False)
        yield out()

    return read


def json_elements(spark: SparkSession, path: str, key: str, schema: str | None = None) -> DataFrame:
    """file, position (from 0), and text of each element of the array under a root key; with a DDL schema its columns instead of text.

    path is a file with one JSON document, or a folder of such. A key that is missing or holds no array has no elements; of
    a key that comes twice, both arrays are read. What is no JSON at all gives elements that no schema fits (nulls).
    """
    rows = _fragments(spark, path)
    first = rows.mapInArrow(_first_pass, "file string, begin long, out boolean, out_depth long, in_ boolean, in_depth long").collect()  # one row per range
    begins: dict[tuple[str, int], tuple] = {}
    file, quoted, depth = None, False, 0
    for r in sorted(first, key=lambda r: (r["file"], r["begin"])):
        if r["file"] != file:
            file, quoted, depth = r["file"], False, 0
        begins[r["file"], r["begin"]] = (quoted, depth)
        quoted, depth = (r["in_"], depth + r["in_depth"]) if quoted else (r["out"], depth + r["out_depth"])
    second = rows.mapInArrow(_second_pass(begins), "file string, begin long, events string").collect()  # root keys and a few numbers per range
    starts: dict[tuple[str, int], tuple] = {}
    file = None
    for r in sorted(second, key=lambda r: (r["file"], r["begin"])):
        if r["file"] != file:
            file, own, array, inside, position = r["file"], None, False, False, 0
        starts[r["file"], r["begin"]] = (*begins[r["file"], r["begin"]], own, array, inside, position)
        for kind, value, n in json.loads(r["events"]):
            if kind == "key":
                own = value
            elif kind == "open":
                array = value == "["
                inside, position = own == key and array, 0
            elif kind == "comma" and inside:
                position += n
            elif kind == "close":
                inside = False
    found = stored(rows.mapInArrow(_third_pass(starts, key), "file string, position long, begin long, whole boolean, text string"), "json-elements")
    parts = F.array_sort(F.collect_list(F.struct("begin", "text")))
    joined = found.where("not whole").groupBy("file", "position").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    each = found.where("whole").select("file", "position", "text").unionByName(joined).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return each if schema is None else each.select("file", "position", F.from_json("text", schema).alias("e")).select("file", "position", "e.*")


def write_document(rows: DataFrame, order: str, path: str, key: str, head: dict[str, str] | None = None) -> None:
    """One JSON document: head's keys and an array of the rows (without the column `order`, in its order) under key.

    The format is one file, so one task writes it; rows stream through it, a line each, sorted by the tasks before.
    """
    spark = rows.sparkSession
    placed = numbered(rows, order, name="_n")
    own = F.to_json(F.struct(*[c for c in rows.columns if c != order]))
    lines = placed.select("_n", F.concat(F.when(F.col("_n") > 0, ",").otherwise(""), own).alias("value"))
    begin = "{" + "".join(f"{json.dumps(k)}: {json.dumps(v)}, " for k, v in (head or {}).items()) + f"{json.dumps(key)}: ["
    ends = spark.createDataFrame([(-1, begin), ((1 << 62), "]}")], "_n long, value string")
    lines.unionByName(ends).orderBy("_n").select("value").coalesce(1).write.mode("overwrite").text(path)
