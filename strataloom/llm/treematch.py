"""Simple tree matching of pruned page trees, with equal texts before structure.

The weight of a pair of nodes with one label is 1, EQUAL more for two equal texts, and the largest sum of weights
that an order-keeping alignment of their children has; nodes with different labels weigh 0. EQUAL outweighs any
structure, so of all alignments those with most equal texts are taken, and of these the one with most nodes.
Everything is iterative: trees may be as deep or as wide as they like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

EQUAL = 1 << 20
#: Cells of an alignment's table that are held at once; larger ones are halved (time stays, memory is a row).
CELLS = 4_000_000
#: Weights of structures that a worker remembers.
MEMORY = 500_000


class Tree:
    """Nodes in page order: label, parent's number, and the hash of a text (0 for elements)."""

    def __init__(self, labels: list[str], parents: list[int], texts: list[int]) -> None:
        n = len(labels)
        self.labels, self.parents, self.texts = labels, parents, texts
        self.kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            self.kids[parents[i]].append(i)
        self.end = [0] * n  # behind the last node below
        self.shape, self.whole, self.full, self.size = [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            below = self.kids[i]
            self.end[i] = self.end[below[-1]] if below else i + 1
            self.shape[i] = hash((labels[i], *[self.shape[k] for k in below]))
            self.whole[i] = hash((labels[i], texts[i], *[self.whole[k] for k in below]))
            self.size[i] = 1 + sum(self.size[k] for k in below)
            self.full[i] = 1 + (EQUAL if texts[i] else 0) + sum(self.full[k] for k in below)

    def holds(self, some: set[int]) -> list[bool]:
        """Whether each node has one of the texts at or below it."""
        out = [t in some for t in self.texts]
        for i in range(len(out) - 1, 0, -1):
            if out[i]:
                out[self.parents[i]] = True
        return out


_shapes: dict[tuple[int, int], int] = {}
#: Pairs of children up to which each is weighed by itself, without looking up which share a text.
FEW = 64


class _Weights:
    """Weights of the pairs of two lists: those of their shapes, and others for pairs that share a text."""

    def __init__(self, table: np.ndarray, own: list[int], other: list[int], extra: dict[int, list[tuple[int, int]]]) -> None:
        self.table, self.own, self.other = table, own, np.array(other, np.int64)
        self.extra = {i: tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) for i, found in extra.items()}

    def row(self, i: int) -> np.ndarray:
        out = self.table[self.own[i], self.other]
        if i in self.extra:
            at, values = self.extra[i]
            out[at] = values
        return out

    def last_row(self, a: int, b: int, c: int, d: int, back: bool = False) -> np.ndarray:
        """The last row of the alignment's table of rows a to b and columns c to d: the best for each number of columns."""
        best = np.zeros(d - c + 1, np.int64)
        for i in reversed(range(a, b)) if back else range(a, b):
            weights = self.row(i)[c:d]
            new = best.copy()
            np.maximum(best[1:], best[:-1] + (weights[::-1] if back else weights), out=new[1:])
            best = np.maximum.accumulate(new)
        return best

    def best(self) -> int:
        return int(self.last_row(0, len(self.own), 0, len(self.other))[-1])

    def align(self) -> list[tuple[int, int]]:
        """The pairs of a best order-keeping alignment."""
        out: list[tuple[int, int]] = []
        stack = [(0, len(self.own), 0, len(self.other))]
        while stack:
            a, b, c, d = stack.pop()
            if a == b or c == d:
                continue
            if b - a > 1 and (b - a + 1) * (d - c + 1) > CELLS:
                mid = (a + b) // 2
                cut = c + int(np.argmax(self.last_row(a, mid, c, d) + self.last_row(mid, b, c, d, back=True)[::-1]))
                stack += [(a, mid, c, cut), (mid, b, cut, d)]
                continue
            rows = np.zeros((b - a + 1, d - c + 1), np.int64)
            for i in range(b - a):
                np.maximum(rows[i, 1:], rows[i, :-1] + self.row(a + i)[c:d], out=rows[i + 1, 1:])
                np.maximum.accumulate(rows[i + 1], out=rows[i + 1])
            i, j = b - a, d - c
            while i and j:
                if rows[i, j] == rows[i - 1, j]:
                    i -= 1
                elif rows[i, j] == rows[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((a + i, c + j))
        return out


class Match:
    """Two trees, of whose nodes it is known which hold texts that both trees have.

    Pairs of nodes that share no text weigh as their shapes do, which is remembered for all trees of a worker; others
    (deep ones) are weighed by their own children.
    """

    def __init__(self, a: Tree, b: Tree) -> None:
        self.a, self.b = a, b
        self.common = (set(a.texts) & set(b.texts)) - {0}
        self.mine, self.yours = a.holds(self.common), b.holds(self.common)
        self.known: dict[tuple[int, int], int] = {}

    def _at_once(self, p: int, q: int, deep: bool) -> int | None:
        a, b = self.a, self.b
        if a.labels[p] != b.labels[q]:
            return 0
        if not deep:
            return a.size[p] if a.shape[p] == b.shape[q] else _shapes.get((a.shape[p], b.shape[q]))
        if a.whole[p] == b.whole[q]:
            return a.full[p]
        return self.known.get((p, q)) if a.kids[p] or b.kids[q] else 1

    def _middle(self, p: int, q: int, deep: bool) -> tuple[list[int], list[int], int]:
        """The children without equal heads and tails, which some best alignment pairs, and how many heads there are."""
        a, b = self.a.kids[p], self.b.kids[q]
        x, y = (self.a.whole, self.b.whole) if deep else (self.a.shape, self.b.shape)
        head, most = 0, min(len(a), len(b))
        while head < most and x[a[head]] == y[b[head]]:
            head += 1
        tail = 0
        while tail < most - head and x[a[-1 - tail]] == y[b[-1 - tail]]:
            tail += 1
        return a[head : len(a) - tail], b[head : len(b) - tail], head

    def _sharing(self, rows: list[int], cols: list[int]) -> dict[int, list[int]]:
        """Places of columns that may share a text with each row, of few pairs all that hold common texts."""
        if len(rows) * len(cols) <= FEW:
            some = [j for j, y in enumerate(cols) if self.yours[y]]
            return {i: some for i, x in enumerate(rows) if self.mine[x]} if some else {}
        where: dict[int, set[int]] = {}
        for j, y in enumerate(cols):
            if self.yours[y]:
                for t in self.b.texts[y : self.b.end[y]]:
                    if t in self.common:
                        where.setdefault(t, set()).add(j)
        found = {i: set().union(*(where.get(t, ()) for t in self.a.texts[x : self.a.end[x]] if t in self.common)) for i, x in enumerate(rows) if self.mine[x]}
        return {i: sorted(js) for i, js in found.items() if js}

    def _needs(self, rows: list[int], cols: list[int], deep: bool) -> tuple[list, list, dict, list[tuple[int, int, bool]]]:
        """Shapes of rows and columns (a node of each, and each one's), sharing pairs, and all pairs to be weighed."""
        sides = []
        for nodes, tree in ((rows, self.a), (cols, self.b)):
            first: dict[tuple[str, int], int] = {}
            number = [first.setdefault((tree.labels[i], tree.shape[i]), len(first)) for i in nodes]
            one = dict(zip(number, nodes, strict=True))
            sides.append(([one[k] for k in range(len(first))], number))
        sharing = self._sharing(rows, cols) if deep else {}
        pairs = [(x, y, False) for x in sides[0][0] for y in sides[1][0]]
        pairs += [(rows[i], cols[j], True) for i, js in sharing.items() for j in js]
        return sides[0], sides[1], sharing, pairs

    def _weighed(self, rows: list[int], cols: list[int], deep: bool, weigh) -> _Weights:
        (first, own), (second, other), sharing, _ = self._needs(rows, cols, deep)
        table = np.array([[weigh(x, y, False) for y in second] for x in first], np.int64).reshape(len(first), len(second))
        return _Weights(table, own, other, {i: [(j, weigh(rows[i], cols[j], True)) for j in js] for i, js in sharing.items()})

    def weight(self, p: int, q: int, deep: bool = True) -> int:
        """The weight of a pair, by the recursion over pairs of their children."""
        stack = [(p, q, deep)]
        while stack:
            i, j, way = stack[-1]
            if self._at_once(i, j, way) is not None:
                stack.pop()
                continue
            rows, cols, _ = self._middle(i, j, way)
            missing = [x for x in self._needs(rows, cols, way)[3] if self._at_once(*x) is None]
            if missing:
                stack.extend(missing)
                continue
            value = self._weighed(rows, cols, way, self._at_once).best() if rows and cols else 0
            value += 1 + self._trimmed(i, rows, way)
            if way:
                self.known[i, j] = value
            else:
                if len(_shapes) >= MEMORY:
                    _shapes.clear()
                _shapes[self.a.shape[i], self.b.shape[j]] = value
            stack.pop()
        return self._at_once(p, q, deep)

    def _trimmed(self, i: int, rows: list[int], deep: bool) -> int:
        """Weight of the heads and tails that _middle has left out."""
        weights = self.a.full if deep else self.a.size
        return sum(weights[k] for k in self.a.kids[i]) - sum(weights[k] for k in rows)

    def _aligned(self, i: int, j: int) -> Iterator[tuple[int, int]]:
        """Pairs of children in a best alignment."""
        a, b = self.a.kids[i], self.b.kids[j]
        if len(a) == len(b) == 1:
            if self.a.labels[a[0]] == self.b.labels[b[0]]:
                yield a[0], b[0]
            return
        rows, cols, head = self._middle(i, j, True)
        yield from zip(a[:head], b[:head], strict=True)
        tail = len(a) - head - len(rows)
        if tail:
            yield from zip(a[-tail:], b[-tail:], strict=True)
        if rows and cols:
            yield from ((rows[x], cols[y]) for x, y in self._weighed(rows, cols, True, self.weight).align())

    def equal_texts(self) -> Iterator[tuple[int, int]]:
        """Pairs of text nodes that the roots' best alignment pairs and that are equal."""
        if not self.common or self.a.labels[0] != self.b.labels[0]:
            return
        stack = [(0, 0)]
        while stack:
            i, j = stack.pop()
            if self.a.whole[i] == self.b.whole[j]:
                for k in range(self.a.end[i] - i):
                    if self.a.texts[i + k]:
                        yield i + k, j + k
                continue
            stack += [(x, y) for x, y in self._aligned(i, j) if self.mine[x] and self.yours[y]]
