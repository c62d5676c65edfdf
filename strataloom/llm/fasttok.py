"""Exact token ids of whole texts, each distinct piece of text tokenized once.

A byte-pair vocabulary never merges across the pieces of its pre-tokenizer, so a text's ids are those of its
pieces, one after another. Pieces repeat: they are cut out by one regular expression and looked up in a
bounded memory; only new ones go to the tokenizers library. Where that cut could depend on Unicode tables
(any character from U+0180 on), the whole text goes to the library instead. Both ways give the same ids,
which the tests hold against the library on whole texts.

Both vocabularies are byte-level, and new pieces go straight to their merges: nothing before them changes a piece
that is lower-cased and cut already, and the library spends more on preparing each piece than on merging it.
"""

from __future__ import annotations

import os
import re
import struct
from codecs import charmap_decode
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from .shared import remember

#: Ids of this many distinct pieces are remembered by one Python worker (some 120 MB), in two generations.
MEMORY_PIECES = 700_000

# Letters, numbers and white space below U+0180.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
WHITE = "\\x09-\\x0d\\x20\\x85\\xa0"
#: Piece patterns by the vocabulary's own pre-tokenizer.
PIECES = {
    "words": f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{WHITE}{LETTERS}{NUMBERS}]+",
    "bytes": f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{WHITE}{LETTERS}{NUMBERS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+",
}
_WIDE = re.compile("[^\x00-ſ]")
# The characters that stand for bytes 0 to 255 in a byte-level vocabulary: printable ones for themselves, the
# others, in order, by those from U+0100 on.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = "".join(chr(b if b in _SELF else 0x100 + sum(c not in _SELF for c in range(b))) for b in range(256))


class BytePieces(dict[str, bytes]):
    """Ids by piece of a byte-level vocabulary; a new piece comes from the older generation, else from the model."""

    def __init__(self, tokenize: Callable[[str], list], older: dict[str, bytes]) -> None:
        self.tokenize, self.older = tokenize, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            tokens = self.tokenize(charmap_decode(piece.encode(), "strict", BYTE_CHARS)[0])
            ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        self[piece] = ids
        return ids


@dataclass
class FastTokenizer:
    path: str
    remember: int = MEMORY_PIECES
    known: BytePieces = field(init=False)
    older: dict[str, bytes] = field(init=False)

    def __post_init__(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(self.path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.lowers = self.library.normalizer is not None
        self.find = re.compile(PIECES["words" if self.lowers else "bytes"]).findall
        self.forget()

    def forget(self) -> None:
        self.older = {}
        self.known = BytePieces(self.library.model.tokenize, self.older)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if _WIDE.search(text):
            return self.whole(text)
        if self.lowers:
            text = text.lower()
            if "̇" in text:  # the one letter here whose lower case is two characters
                return self.whole(text)
        ids = b"".join(map(self.known.__getitem__, self.find(text)))
        if len(self.known) > self.remember // 2:
            self.older = self.known
            self.older.older = {}  # two generations at most
            self.known = BytePieces(self.older.tokenize, self.older)
        return ids


_opened: dict[tuple[str, int], FastTokenizer] = {}


# other operators need neither the pieces nor the tokenizers, which are opened again in half a second
remember("pieces", _opened.clear)


def forget_pieces() -> None:
    """Let go of all remembered pieces, not of the tokenizers; so an idle worker is small until its next task."""
    for t in _opened.values():
        t.forget()


def tokenizer(path: str) -> FastTokenizer:
    """The tokenizer of this file, opened once in each Python worker."""
    key = (path, os.getpid())
    if key not in _opened:
        _opened[key] = FastTokenizer(path)
    return _opened[key]


def public_file(name: str) -> str:
    """Where a public vocabulary file lies; asked on the worker, as places may differ from the driver's."""
    import public_tokenizers

    return public_tokenizers.path(name)
