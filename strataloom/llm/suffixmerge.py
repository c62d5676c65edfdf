"""Front-coded sorted suffix runs, as arrays and in a plain form, and a plain merge by a loser tree that keeps common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, of which `start` bytes are known."""
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    return start


def front_code(suffixes: list[bytes]) -> tuple[bytes, list[bytes]]:
    """Of sorted suffixes: each one's common prefix with the one before it (a byte each), and the rests."""
    prefixes, rests, last = bytearray(), [], b""
    for s in suffixes:
        n = common_prefix(last, s, 0)
        prefixes.append(n)
        rests.append(s[n:])
        last = s
    return bytes(prefixes), rests


def front_code_rows(rows: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As front_code, of runs of equally long suffixes that begin at these rows: prefixes, all rests, where each begins."""
    n, width = rows.shape
    prefixes = np.zeros(n, np.uint8)
    if n > 1:
        other = rows[1:] != rows[:-1]
        prefixes[1:] = np.where(other.any(axis=1), other.argmax(axis=1), width)
    prefixes[begins] = 0
    rests = rows[np.arange(width, dtype=np.uint8)[None, :] >= prefixes[:, None]]
    return prefixes, rests, np.concatenate(([0], np.cumsum(width - prefixes.astype(np.int64))))


def front_decode(prefixes: bytes, rests: list[bytes]) -> list[bytes]:
    out, last = [], b""
    for n, rest in zip(prefixes, rests, strict=True):
        last = last[:n] + rest
        out.append(last)
    return out


def front_decode_rows(prefixes: np.ndarray, rests: np.ndarray, width: int) -> np.ndarray:
    """As front_decode, of one run of equally long suffixes."""
    own = np.arange(width, dtype=np.uint8)[None, :] >= prefixes[:, None]
    rows = np.empty((len(prefixes), width), np.uint8)
    rows[own] = rests
    source = np.maximum.accumulate(np.where(own, np.arange(len(prefixes))[:, None], 0), axis=0)
    return np.take_along_axis(rows, source, axis=0)


def merge_runs(runs: list[tuple[list[bytes], bytes]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs of (suffixes, common prefixes): (run, place, common prefix with the suffix before).

    A loser tree. With each run's head stands its common prefix with the last suffix put out; of two heads the
    one with the longer prefix is the smaller, and only heads with equal prefixes are compared, from there on.
    So no byte of a known prefix is read again. A run's next suffix that equals the one just put out follows
    it at once.
    """
    k = len(runs)
    if not k:
        return
    size = 1
    while size < k:
        size *= 2
    place = [0] * size
    heads: list[bytes | None] = [runs[i][0][0] if i < k and runs[i][0] else None for i in range(size)]
    known = [0 if heads[i] is not None else -1 for i in range(size)]  # -1: the run is over

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads; the loser's prefix becomes that with the winner."""
        a, b = known[i], known[j]
        if a != b:
            return (i, j) if a > b else (j, i)
        if a < 0:
            return i, j
        x, y = heads[i], heads[j]
        n = common_prefix(x, y, a)
        if x <= y:
            known[j] = n
            return i, j
        known[i] = n
        return j, i

    loser = [0] * size
    winners = list(range(size))
    level = size
    while level > 1:  # the first round, from the leaves up
        level //= 2
        winners_above = []
        for node in range(level):
            w, lost = play(winners[2 * node], winners[2 * node + 1])
            loser[level + node] = lost
            winners_above.append(w)
        winners = winners_above
    w, out = winners[0], 0
    while known[w] >= 0:
        suffixes, prefixes = runs[w]
        at = place[w]
        yield w, at, known[w] if out else 0
        out, at = 1, at + 1
        while at < len(suffixes) and prefixes[at] == len(suffixes[at]) == len(suffixes[at - 1]):
            yield w, at, prefixes[at]
            at += 1
        place[w] = at
        if at < len(suffixes):
            heads[w], known[w] = suffixes[at], prefixes[at]
        else:
            heads[w], known[w] = None, -1
        node = (size + w) // 2
        while node:
            other = loser[node]
            if known[other] != known[w]:
                if known[other] > known[w]:
                    loser[node], w = w, other
            elif known[w] >= 0:
                w, loser[node] = play(w, other)
            node //= 2
