"""Signature trees over shingle sets, and the dual traversal that joins two of them.

A leaf is one set: a bitmap of its hashed shingles, its size, and how many of
its shingles share a bit with another (its slack).  An inner node holds the OR
of its children's bitmaps, their size range and their largest slack.  For sets
below nodes A and B the overlap is at most

    min(max size A, max size B, popcount(OR_A & OR_B) + min(slack A, slack B))

and a link needs 100 * overlap >= least * union, so a pair of nodes whose bound
fails is dropped with everything below it.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8


class Tree:
    """levels[0] are the leaves, in `order`; the last level is one root."""

    __slots__ = ("order", "levels", "sets")

    def __init__(self, sets: list[np.ndarray], width: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        smallest = np.array([int(s[0]) for s in sets], np.uint64)
        band = np.floor(np.log(sizes) / np.log(1.2)).astype(np.int64)
        self.order = np.lexsort((smallest, band))  # near copies mostly share their smallest hash
        self.sets = [sets[i] for i in self.order]
        bits = np.zeros((len(sets), width // 64), np.uint64)
        for row, s in enumerate(self.sets):
            at = (s & np.uint64(width - 1)).astype(np.int64)
            np.bitwise_or.at(bits[row], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        sizes = sizes[self.order]
        slack = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, slack)]
        while len(bits) > 1:
            at = np.arange(0, len(bits), FANOUT)
            _, low, high, slack = self.levels[-1]
            bits = np.bitwise_or.reduceat(bits, at, axis=0)
            self.levels.append((bits, np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))


def width_for(sets: list[np.ndarray]) -> int:
    """Bits for about a quarter of them set by the largest set; a power of two from 256 to 2**17."""
    return 1 << min(17, max(8, (4 * max(len(s) for s in sets) - 1).bit_length()))


def _bounds(a, b, i, j, step: int = 1 << 21) -> np.ndarray:
    """Largest possible overlap of each node pair, minus what the smallest sizes need (times 37/17: see least)."""
    rows = max(1, step // a[0].shape[1])
    common = np.concatenate([np.bitwise_count(a[0][i[k : k + rows]] & b[0][j[k : k + rows]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), rows)])
    return np.minimum(np.minimum(a[2][i], b[2][j]), common + np.minimum(a[3][i], b[3][j]))


class Groups:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def join(left: Tree, right: Tree, least: int, groups: Groups, offset: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between the sets of two trees (or inside one, left is right), as positions in the given lists.

    Only links that join two groups are returned, and pairs already in one group
    are not verified again: the links span every component, so none is lost for
    reachability.  offset: what is added to the positions to number them in groups.
    """
    same = left is right
    top = max(len(left.levels), len(right.levels)) - 1
    i = j = np.zeros(1, np.int64)
    for level in range(top, -1, -1):
        a, b = left.levels[min(level, len(left.levels) - 1)], right.levels[min(level, len(right.levels) - 1)]
        if same:
            keep = i < j if level == 0 else i <= j
            i, j = i[keep], j[keep]
        if not len(i):
            return []
        most = _bounds(a, b, i, j)
        low, high = a[1][i], b[1][j]
        fits = (100 + least) * most >= least * (low + high)
        fits &= (100 * a[2][i] >= least * high) & (100 * b[2][j] >= least * low)
        i, j, most = i[fits], j[fits], most[fits]
        if level:
            i, j, = _children(i, j, left, right, level)
    links = []
    score = most / np.maximum(a[1][i], b[1][j])
    for k in np.argsort(-score, kind="stable").tolist():
        x, y = int(i[k]), int(j[k])
        p, q = int(left.order[x]), int(right.order[y])
        if groups.find(p + offset[0]) == groups.find(q + offset[1]):
            continue
        s, t = left.sets[x], right.sets[y]
        overlap = len(s) + len(t) - len(np.union1d(s, t))
        if 100 * overlap >= least * (len(s) + len(t) - overlap):
            groups.union(p + offset[0], q + offset[1])
            links.append((p, q))
    return links


def _children(i, j, left, right, level):
    """The node pairs one level below; a tree that is lower than the level stays where it is."""
    def below(tree, at):
        if level > len(tree.levels) - 1:
            return at[:, None], np.ones((len(at), 1), bool)
        kids = at[:, None] * FANOUT + np.arange(FANOUT)
        return kids, kids < len(tree.levels[level - 1][1])

    x, x_ok = below(left, i)
    y, y_ok = below(right, j)
    ok = x_ok[:, :, None] & y_ok[:, None, :]
    shape = ok.shape
    return np.broadcast_to(x[:, :, None], shape)[ok], np.broadcast_to(y[:, None, :], shape)[ok]
