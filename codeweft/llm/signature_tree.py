"""Signature trees: set-similarity joins by traversing two hierarchies of bitmaps at once.

A leaf holds a few sets; each set has its size and a bitmap with one bit per token hash. A node
holds the OR of its sets' bitmaps, the range of their sizes, and the most tokens any of them has
beyond its bits. Two sets below nodes A and B share at most

    popcount(A.bits & B.bits) + min(A.beyond, B.beyond)

tokens, and need at least t / (1 + t) * (A.least + B.least), so a pair of nodes that cannot get there,
or whose sizes differ too much, is left with all that lies below it. Pairs of sets that pass
the same test are compared exactly. Sets already linked, directly or not, need no comparison.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from codeweft.llm.arrays import U64

LEAF = 16
FANOUT = 4
MOST_BITS = 1 << 14


@dataclass
class Level:
    """Nodes of one level: bitmaps, size ranges, tokens beyond bits, and the sets they span."""

    bits: np.ndarray
    least: np.ndarray
    most: np.ndarray
    beyond: np.ndarray
    bounds: np.ndarray


def bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(sets), width // 64), dtype=U64)
    for row, tokens in zip(out, sets, strict=True):
        place = tokens & U64(width - 1)
        np.bitwise_or.at(row, (place >> U64(6)).astype(np.intp), U64(1) << (place & U64(63)))
    return out


class Tree:
    """Sets in a fixed order, the levels above them from single sets to one root."""

    def __init__(self, sets: list[np.ndarray], width: int) -> None:
        sizes = np.array([len(s) for s in sets])
        bits = bitmaps(sets, width)
        level = Level(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(axis=1), np.arange(len(sets) + 1))
        self.levels = [level]
        step = LEAF
        while len(level.least) > 1:
            cuts = np.arange(0, len(level.least), step)
            level = Level(
                np.bitwise_or.reduceat(level.bits, cuts, axis=0),
                np.minimum.reduceat(level.least, cuts),
                np.maximum.reduceat(level.most, cuts),
                np.maximum.reduceat(level.beyond, cuts),
                np.append(level.bounds[cuts], level.bounds[-1]),
            )
            self.levels.append(level)
            step = FANOUT


class Linker:
    """Links of sets at similarity ``num / den``, found by dual traversal."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int) -> None:
        self.sets, self.num, self.den = sets, num, den
        self.label = np.arange(len(sets))  # of the sets linked so far
        self.edges: list[tuple[int, int]] = []

    def linked(self, a: int, b: int) -> bool:
        x, y = self.sets[a], self.sets[b]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        shared = int((y[at] == x).sum())
        return self.den * shared >= self.num * (len(x) + len(y) - shared)

    def join(self, a: int, b: int) -> None:
        self.edges.append((a, b))
        old, new = self.label[b], self.label[a]
        self.label[self.label == old] = new

    def possible(self, a: Level, i: np.ndarray, b: Level, j: np.ndarray) -> np.ndarray:
        """For pairs of nodes: whether two sets below them can be similar enough."""
        near = (a.most[i] * self.den >= b.least[j] * self.num) & (b.most[j] * self.den >= a.least[i] * self.num)
        at = np.flatnonzero(near)
        shared = np.bitwise_count(a.bits[i[at]] & b.bits[j[at]]).sum(axis=1, dtype=np.int64) + np.minimum(a.beyond[i[at]], b.beyond[j[at]])
        near[at] = shared * (self.num + self.den) >= self.num * (a.least[i[at]] + b.least[j[at]])
        return near

    def settled(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        """Whether all sets of both spans are linked to each other already."""
        one = self.label[a[0]]
        return bool((self.label[a[0] : a[1]] == one).all() and (self.label[b[0] : b[1]] == one).all())

    def traverse(self, a: Tree, a0: int, b: Tree, b0: int) -> None:
        """Link the sets below two trees whose sets begin at ``a0`` and ``b0``; a tree may meet itself."""
        same = a is b
        top = max(len(a.levels), len(b.levels)) - 1
        level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
        stack = [(top, 0, 0)]
        while stack:
            k, i, j = stack.pop()
            la, lb = level(a, k), level(b, k)
            span_a = (a0 + la.bounds[i], a0 + la.bounds[i + 1])
            span_b = (b0 + lb.bounds[j], b0 + lb.bounds[j + 1])
            if k and self.settled(span_a, span_b):
                continue
            if k == 0:
                x, y = a0 + i, b0 + j
                if self.label[x] != self.label[y] and self.linked(x, y):
                    self.join(x, y)
                continue
            na, nb = level(a, k - 1), level(b, k - 1)
            below = lambda low, l, t: np.arange(np.searchsorted(low.bounds, l.bounds[t]), np.searchsorted(low.bounds, l.bounds[t + 1]))  # noqa: E731, E741
            ii, jj = below(na, la, i), below(nb, lb, j)
            pi, pj = np.repeat(ii, len(jj)), np.tile(jj, len(ii))
            if same and i == j:
                keep = pi < pj if k == 1 else pi <= pj
                pi, pj = pi[keep], pj[keep]
            good = self.possible(na, pi, nb, pj)
            # Pairs of one node with itself come off the stack first: they link near sets cheaply.
            pi, pj = pi[good], pj[good]
            order = np.argsort(same * (pi == pj), kind="stable")
            if k > 1:
                stack.extend((k - 1, p, q) for p, q in zip(pi[order].tolist(), pj[order].tolist(), strict=True))
                continue
            for p, q in zip((a0 + pi).tolist(), (b0 + pj).tolist(), strict=True):
                if self.label[p] != self.label[q] and self.linked(p, q):
                    self.join(p, q)


def width_for(sets: list[np.ndarray]) -> int:
    """Eight bits per token of the median set, within bounds."""
    middle = int(np.median([len(s) for s in sets]))
    return min(MOST_BITS, max(256, 1 << (8 * middle - 1).bit_length()))


def link_within(sets: list[np.ndarray], num: int, den: int, part: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges that connect just those sets that a chain of links connects.

    With ``part``, only sets of different parts (there are two) are compared.
    """
    if len(sets) == 2:
        own = Linker(sets, num, den)
        return [(0, 1)] if own.linked(0, 1) else []
    least = np.array([s[0] for s in sets])
    groups = [np.arange(len(sets))] if part is None else [np.flatnonzero(np.array(part) == p) for p in sorted(set(part))]
    order = np.concatenate([g[np.argsort(least[g], kind="stable")] for g in groups])
    ordered = [sets[i] for i in order]
    width = width_for(sets)
    own = Linker(ordered, num, den)
    trees, at = [], 0
    for g in groups:
        trees.append((Tree(ordered[at : at + len(g)], width), at))
        at += len(g)
    own.traverse(*trees[0], *trees[-1])
    return [(int(order[a]), int(order[b])) for a, b in own.edges]
