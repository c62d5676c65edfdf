"""Quality rules by repetition coverage.

Each text is read as UTF-8 bytes whose words are numbered in order of first use. Running sums of the words' values
times the powers of an odd base are made once; the hash of any window of n words rolls out of them as one difference
and one product with the base's inverse power, all windows of a text at once in numpy, whatever n is. The windows whose
hash occurs twice mark their words, and the share of word characters below marked words is that n's coverage. Windows
of three words, on which the base rule stands, are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import alone, bounded_batches

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(sorted(set(range(256)) - set(SYMBOLS)))
_CONTINUATION = bytes(range(0x80, 0xC0))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Limits:
    """Highest shares of a text's word characters that may lie in repeated parts.

    The figures for duplicated n-grams are those published for the Gopher corpus, tripled, and for lines
    doubled: there they choose high-quality pages, here they reject what is largely repetition and leave clean
    texts alone, such as a short one with a line that comes twice.
    """

    min_words: int = 50
    repeat_words_percent: int = 50
    line_chars: float = 0.40
    ngram_chars: dict[int, float] = field(default_factory=lambda: {5: 0.45, 6: 0.42, 7: 0.39, 8: 0.36, 9: 0.33, 10: 0.30})
    symbols_per_word: float = 0.30


class Rolling:
    """Hashes of all windows of any length over a text's word numbers, each in a constant number of steps."""

    def __init__(self, ids: np.ndarray) -> None:
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _ODD
        mixed ^= mixed >> np.uint64(29)
        mixed *= _ODD
        mixed ^= mixed >> np.uint64(32)
        self.sums = np.zeros(len(ids) + 1, np.uint64)  # modulo 2**64, as all that follows
        np.cumsum(mixed * _powers(_BASE, len(ids)), out=self.sums[1:])
        self.back = _powers(_INVERSE, len(ids))

    def windows(self, n: int) -> np.ndarray:
        m = len(self.back) - n + 1
        return (self.sums[n:] - self.sums[:m]) * self.back[:m]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def exact_windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of all windows of n words, equal where the windows are."""
    m = len(ids) - n + 1
    key = ids[:m].astype(np.int64)
    for i in range(1, n):
        wide = int(ids.max()) + 1
        if int(key.max()) >= (1 << 62) // wide:  # fold what is too wide into dense numbers first
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * wide + ids[i : i + m]
    return key


def duplicated_words(ids: np.ndarray, n: int, exact: bool = False, rolling: Rolling | None = None) -> np.ndarray:
    """Which words lie in an n-word window that the text has twice or more (all its places marked)."""
    if len(ids) <= n:
        return np.zeros(len(ids), dtype=bool)
    key = exact_windows(ids, n) if exact else (rolling or Rolling(ids)).windows(n)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(key) + n, dtype=np.int32)
    starts = np.flatnonzero(twice)
    edge[starts] += 1
    edge[starts + n] -= 1  # starts differ, so do ends
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, limits: Limits) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, shares, base_failed, kept of one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at exactly the six white-space bytes of the contract
    n_words = len(words)
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    sizes = np.fromiter((len(w.translate(None, _CONTINUATION)) for w in words), np.int64, n_words) if not data.isascii() else np.fromiter(map(len, words), np.int64, n_words)
    word_chars = int(sizes.sum())
    seen: set[bytes] = set()
    n_dup_lines, dup_line_chars = 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            if line in seen:
                n_dup_lines += 1
                dup_line_chars += sum(len(w.translate(None, _CONTINUATION)) for w in line.split())
            else:
                seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n_words)
    n_repeat_words = int(duplicated_words(ids, 3, exact=True).sum())
    shares = []
    rolling = Rolling(ids) if n_repeat_words >= min(limits.ngram_chars, default=n_words + 1) else None
    for n in sorted(limits.ngram_chars):
        # a repeated n-gram lies wholly in repeated trigrams, so texts without those need no further hashing
        shares.append(float(sizes[duplicated_words(ids, n, rolling=rolling)].sum()) / word_chars if n_repeat_words >= n else 0.0)
    line_share = dup_line_chars / word_chars if word_chars else 0.0
    base_failed = n_words < limits.min_words or 100 * n_repeat_words > limits.repeat_words_percent * n_words
    fine = line_share <= limits.line_chars and n_symbols <= limits.symbols_per_word * n_words
    fine = fine and all(s <= limits.ngram_chars[n] for n, s in zip(sorted(limits.ngram_chars), shares, strict=True))
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line_share, max(shares, default=0.0), base_failed, fine and not base_failed


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_share", "dup_ngram_share", "base_failed", "kept"]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, dup_ngram_share double, base_failed boolean, kept boolean"
_TYPES = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Measure and judge each text: id_col, the columns of SCHEMA, then the columns named in carry.

    A narrow pass: no shuffle, one text in memory at a time beside its Arrow batch. Null and empty texts have
    no words and fail the base rule; repeated rows are each judged; an empty table gives no rows; columns not
    named are not read, so clashing names in docs do no harm.
    """
    bounded_batches(docs.sparkSession)
    limits = limits or Limits()
    schema = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).schema

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in batches:
            rows = [measure(t, limits) for t in batch.column(0).to_pylist()]
            made = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)] if rows else [pa.array([], t) for t in _TYPES]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*batch.schema.names[1:], *[f"m{i}" for i in range(len(made))]])

    made = ", ".join(f"m{i} {kind.split()[1]}" for i, kind in enumerate(SCHEMA.split(", ")))
    out = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).mapInArrow(
        judge, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in schema] + [made])
    )
    return out.select(F.col("id").alias(id_col), *[F.col(f"m{i}").alias(n) for i, n in enumerate(NAMES)], *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
