"""SentencePiece encoding with the place of every piece in the original bytes, and decoding.

A model file holds pieces and a normalizer: a compiled character map (a double-array trie over UTF-8 and the
replacements it points to) and three switches for blanks. Text is normalized here, longest prefix first, and every
normalized character keeps the byte at which its source began; pieces are cut from normalized text, so their places
follow. Where no rule of the map can begin (found by one regular expression over the rules' first characters), runs
are taken over as they are.

Normalized text is encoded by the sentencepiece library, with the same pieces and a normalizer that changes nothing; a
piece's number of characters tells where the next one begins. A text's words are not remembered: where most words are new,
looking them up costs more than it saves (measured: 2.1 against 2.5 MB a second).
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fasttok import public_file
from .shared import alone, bounded_batches, remember

BLANK = "▁"
# Fields and types of the model file's format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, USER, BYTE = 1, 4, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _message(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """Field number, value and raw bytes of each field of a protocol-buffers message."""
    at = 0
    while at < len(data):
        begin = at
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"not a model file: wire type {kind}")
        yield key >> 3, value, data[begin:at]


class CharacterMap:
    """A compiled character map: replacements of the longest prefixes."""

    def __init__(self, compiled: bytes) -> None:
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4) if compiled else np.zeros(0, np.uint32)
        self.walk = self.units.tolist()
        self.texts = compiled[4 + size :]
        self.begin = self._first_characters()

    @staticmethod
    def _offset(unit):
        return (unit >> 10) << ((unit & 512) >> 6)

    def _text(self, place: int) -> str:
        return self.texts[place : self.texts.index(b"\0", place)].decode()

    def _keys(self) -> list[bytes]:
        """All keys, level by level over the trie."""
        if not len(self.units):
            return []
        keys: list[bytes] = []
        base, prefix = np.array([self._offset(int(self.units[0]))], np.int64), [b""]
        labels = np.arange(1, 256)
        while len(base):
            place = base[:, None] ^ labels
            inside = place < len(self.units)
            unit = self.units[np.where(inside, place, 0)].astype(np.int64)
            node, label = np.nonzero(inside & ((unit & 0x800000FF) == labels))
            found = unit[node, label]
            prefix = [prefix[i] + bytes([c + 1]) for i, c in zip(node.tolist(), label.tolist(), strict=True)]
            keys += [p for p, leaf in zip(prefix, ((found >> 8) & 1).tolist(), strict=True) if leaf]
            base = place[node, label] ^ self._offset(found)
        return keys

    def _first_characters(self) -> re.Pattern | None:
        """Where a rule may apply: characters that are rules, and first characters of longer rules before a second one."""
        keys = [k.decode(errors="ignore") for k in self._keys()]
        single = {k for k in keys if len(k) == 1}
        first, second = {k[0] for k in keys if len(k) > 1} - single, {k[1] for k in keys if len(k) > 1}
        some = [f"[{_ranges(single)}]"] if single else []
        if first:
            some.append(f"[{_ranges(first)}](?=[{_ranges(second)}])")
        return re.compile("|".join(some)) if some else None

    def replacement(self, data: bytes) -> tuple[int, str] | None:
        """Bytes of the longest rule that data begins with, and its replacement."""
        best, units, size = None, self.walk, len(self.walk)
        at = self._offset(units[0])
        for n, byte in enumerate(data, 1):
            at ^= byte
            if byte == 0 or at >= size or units[at] & 0x800000FF != byte:
                break
            unit = units[at]
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                best = n, units[at] & 0x7FFFFFFF
        return None if best is None else (best[0], self._text(best[1]))


def _ranges(chars: set[str]) -> str:
    """A character class's inside."""
    points = np.array(sorted(map(ord, chars)))
    runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1)
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)


class PieceModel:
    """A model file's pieces, normalizer and encoder."""

    def __init__(self, content: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.pieces: list[str] = []
        kinds: list[int] = []
        kept, trainer, normalizer = [], {}, {}
        for number, value, raw in _message(content):
            if number == PIECES:
                piece = {f: v for f, v, _ in _message(value)}
                self.pieces.append(piece.get(1, b"").decode())
                kinds.append(piece.get(3, NORMAL))
            elif number == TRAINER:
                trainer = {f: v for f, v, _ in _message(value)}
            elif number == NORMALIZER:
                normalizer = {f: v for f, v, _ in _message(value)}
            if number != NORMALIZER:
                kept.append(raw)
        if not trainer.get(35) or trainer.get(24):
            raise ValueError("models without byte fallback, or with blanks behind words, are not supported")
        self.map = CharacterMap(normalizer.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(normalizer.get(f, 1)) for f in (3, 4, 5))
        own = [self.pieces[i] for i, k in enumerate(kinds) if k == USER]
        self.user = re.compile("|".join(map(re.escape, sorted(own, key=len, reverse=True)))) if own else None
        same = b"".join(bytes([f << 3, 0]) for f in (3, 4))  # no blank in front, none taken away
        same = b"\x0a\x08identity" + same + b"\x28\x01"
        self.library = SentencePieceProcessor(model_proto=b"".join(kept) + bytes([NORMALIZER << 3 | 2, len(same)]) + same)
        self.decoder = SentencePieceProcessor(model_proto=content)
        # bytes of byte pieces, else -1; characters of all pieces
        self.byte = np.array([int(p[1:-1], 16) if k == BYTE else -1 for p, k in zip(self.pieces, kinds, strict=True)], np.int64)
        self.chars = np.array([len(p) for p in self.pieces], np.int64)

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """Normalized text, and by character (and at its end) the original byte at which its source begins."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        byte = np.r_[0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)]
        out, at, done = [], [], 0
        for begin, end, new in self._changes(text):
            out += [text[done:begin], new]
            at += [byte[done:begin], np.full(len(new), byte[begin])]
            done = end
        out.append(text[done:])
        at.append(byte[done:-1])
        norm, source, last = "".join(out), np.concatenate(at), int(byte[-1])
        if self.squeeze:  # no blank at either end, none behind another
            blank = np.frombuffer(norm.encode("utf-32-le"), np.uint32) == 32
            keep = ~(blank & np.r_[True, blank[:-1]]) if len(norm) else blank
            if tail := len(norm) - len(norm.rstrip(" " + BLANK if self.escape else " ")):
                last = int(source[len(norm) - tail])
                keep[len(norm) - tail :] = False
            first = int(source[np.argmax(keep)]) if keep.any() else 0
            norm, source = "".join(np.array(list(norm))[keep].tolist()) if not keep.all() else norm, source[keep]
        else:
            first = 0
        if norm and self.prefix:
            norm, source = " " + norm, np.r_[first, source]
        return (norm.replace(" ", BLANK) if self.escape else norm), np.r_[source, last]

    def _changes(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Begin, end and replacement of what normalization changes, in order; pieces of the user's own stay."""
        rules, at = self.map.begin, 0
        if rules is None:
            return
        own = self.user.search(text) if self.user else None
        while found := rules.search(text, at):
            while own and own.start() <= found.start():
                if own.end() > found.start():
                    at = own.end()
                own = self.user.search(text, own.end())
            if at > found.start():
                continue
            got = self.map.replacement(text[found.start() : found.start() + 64].encode())
            if got is None:
                at = found.start() + 1
                continue
            end = found.start() + len(text[found.start() : found.start() + 64].encode()[: got[0]].decode())
            yield found.start(), end, got[1]
            at = end

    def _lengths(self, ids: np.ndarray) -> np.ndarray:
        """Characters that each piece stands for: of a character's byte pieces the last has it, the others have none."""
        out, value = self.chars[ids], self.byte[ids]
        raw = np.flatnonzero(value >= 0)
        if len(raw):
            lead = value[raw]
            follows = (lead & 0xC0) == 0x80
            out[raw] = np.r_[~follows[1:], True]  # the next byte piece begins another character
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each piece's first and last (exclusive) byte in the text."""
        norm, source = self.normalize(text)
        ids = np.array(self.library.encode(norm), np.int32)
        sizes = self._lengths(ids)
        ends = np.cumsum(sizes)
        return ids, source[ends - sizes], source[ends]


_models: dict[str, PieceModel] = {}
remember("codec", _models.clear)


def piece_model(path: str) -> PieceModel:
    """The model at path (or of a public vocabulary's name), held by the worker."""
    if path not in _models:
        with open(path if os.path.isabs(path) else public_file(path), "rb") as file:
            _models[path] = PieceModel(file.read())
    return _models[path]


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, ids (array<int>), begins and ends (array<int>: each piece's bytes in the text, end exclusive).

    Ids are those of the sentencepiece library, without begin or end ids; path is the model file's. Pieces tile the text,
    but for blanks that normalization drops; of the byte pieces of one character the last has its bytes. Null and empty texts
    have no pieces; rows are independent, so repeated ones come out alike, and other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    names = [f"_{i}" for i in range(len(carry))]  # so that no carried name clashes with the results'
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    ints = pa.list_(pa.int32())

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("codec")
        model = piece_model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [model.encode(t) for t in part.column(len(names)).to_pylist()]
                cuts = pa.array(np.r_[0, np.cumsum([len(m[0]) for m in made])], pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([m[k] for m in made]).astype(np.int32))) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *(x.cast(ints) for x in lists)], names=[*names, "ids", "begins", "ends"])

    made = rows.mapInArrow(work, f"{kinds}{', ' if kinds else ''}ids array<int>, begins array<int>, ends array<int>")
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], "ids", "begins", "ends")


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns, and decoded: the text of the ids by the sentencepiece library; null ids give an empty text."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    place = encoded.columns.index(ids_col)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = piece_model(path).decoder
        for batch in batches:
            ids = batch.column(place)
            flat, ends = ids.flatten().to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
            texts = [decoder.decode(own.tolist()) if len(own) else "" for own in np.split(flat, ends[:-1])][: len(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(work, f"{kinds}, decoded string")
