"""Lexical placement of documents in shards: documents with the same telling
words get neighbouring places, and shards are runs of places.

A bounded sample gives document frequencies and a tree of hyperplanes over
hashed tf-idf vectors. A node is split in two by 2-means; the cut goes through
the widest gap of the middle half, so a dense group is cut last. A document goes
down the tree to a leaf, leaves are numbered in tree order, and inside a leaf a
cell is its place along the leaf's main direction. Leaves that follow each other
share a shard while they fit; a leaf over the size of a shard is split by
cells, and a cell over it (one group of equal texts) by a hash.
"""

from __future__ import annotations

import numpy as np

DIMS = 256
SAMPLE = 1 << 15
SAMPLE_PER_SHARD = 64
PER_LEAF = 16
CELLS = 256
K1 = 1.2


def hashed(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sign) of every id."""
    rng = np.random.default_rng(17)
    return rng.integers(0, DIMS, size), rng.choice(np.array([-1.0, 1.0]), size)


class Tree:
    """Places of documents, given as (ids, counts) pairs."""

    def __init__(self, sample: list[tuple[np.ndarray, np.ndarray]], size: int, per_leaf: int = PER_LEAF):
        df = np.zeros(size)
        for terms, _ in sample:
            df[terms] += 1
        self.bucket, sign = hashed(size)
        self.value = np.where(df > 0, sign * np.log1p((len(sample) - df + 0.5) / (df + 0.5)), 0.0)
        self.plane, self.cut, self.child = [], [], []  # a child >= 0 is a node, ~child a leaf
        self.line, self.span = [], []
        x = self.vectors(sample)
        self.root = self._grow(x, per_leaf)
        self.plane = np.array(self.plane, np.float32).reshape(-1, DIMS)
        self.cut, self.child = np.array(self.cut, np.float32), np.array(self.child, np.int64).reshape(-1, 2)
        self.line, self.span = np.array(self.line, np.float32), np.array(self.span, np.float32)

    def vectors(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not docs:
            return np.zeros((0, DIMS), np.float32)
        terms = np.concatenate([t for t, _ in docs])
        counts = np.concatenate([c for _, c in docs])
        row = np.repeat(np.arange(len(docs)) * DIMS, [t.size for t, _ in docs])
        x = np.bincount(row + self.bucket[terms], self.value[terms] * (counts / (counts + K1)), len(docs) * DIMS)
        x = x.reshape(len(docs), DIMS).astype(np.float32)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        return x / np.maximum(norm, 1e-9)[:, None]

    @staticmethod
    def _direction(x: np.ndarray) -> np.ndarray:
        y = x - x.mean(0)
        v = y[np.argmax(np.einsum("ij,ij->i", y, y))]
        for _ in range(12):
            v = y.T @ (y @ v)
            v = v / (np.linalg.norm(v) + 1e-12)
        return v

    def _split(self, x: np.ndarray):
        mean, v = x.mean(0), self._direction(x)
        a, b = mean + 0.1 * v, mean - 0.1 * v
        for _ in range(8):
            near = x @ (a - b) > (a @ a - b @ b) / 2
            if near.all() or not near.any():
                break
            a, b = x[near].mean(0), x[~near].mean(0)
        plane = a - b
        at = x @ plane
        p = np.sort(at)
        lo = len(p) // 4
        k = lo + int(np.argmax(np.diff(p[lo:len(p) - lo])))
        cut = (p[k] + p[k + 1]) / 2
        right = at > cut
        return (plane, cut, right) if right.any() and not right.all() else None

    def _grow(self, x: np.ndarray, per_leaf: int) -> int:
        found = self._split(x) if len(x) >= 2 * per_leaf else None
        if found is None:
            v = self._direction(x) if len(x) else np.zeros(DIMS, np.float32)
            at = x @ v if len(x) else np.zeros(1)
            self.line.append(v)
            self.span.append((at.min(), at.max()))
            return ~(len(self.line) - 1)
        plane, cut, right = found
        node = len(self.plane)
        self.plane.append(plane)
        self.cut.append(cut)
        self.child.append(None)
        self.child[node] = (self._grow(x[~right], per_leaf), self._grow(x[right], per_leaf))
        return node

    def places(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, cell) of every document."""
        x = self.vectors(docs)
        node = np.full(len(docs), self.root, np.int64)
        open_ = np.flatnonzero(node >= 0)
        while open_.size:
            at = node[open_]
            right = np.einsum("ij,ij->i", x[open_], self.plane[at]) > self.cut[at]
            node[open_] = self.child[at, right.astype(np.int64)]
            open_ = open_[node[open_] >= 0]
        leaf = ~node
        low, high = self.span[leaf, 0], self.span[leaf, 1]
        along = (np.einsum("ij,ij->i", x, self.line[leaf]) - low) / np.maximum(high - low, 1e-9)
        return leaf, np.clip(along * CELLS, 0, CELLS - 1).astype(np.int64)


def deal(cells: list[tuple[int, int, int]], limit: int) -> list[tuple[int, int, int, int]]:
    """(leaf, cell, first shard, shards) from (leaf, cell, ids): a shard takes
    whole leaves, then whole cells, up to ``limit`` ids."""
    leaves: dict[int, list] = {}
    for leaf, cell, n in sorted(cells):
        leaves.setdefault(leaf, []).append((cell, n))
    out, shard, held = [], 0, 0

    def put(leaf, group):
        nonlocal shard, held
        n = sum(x for _, x in group)
        if held and held + n > limit:
            shard, held = shard + 1, 0
        if n > limit and len(group) > 1:
            for one in group:
                put(leaf, [one])
            return
        parts = max(1, -(-n // limit))
        out.extend((leaf, cell, shard, parts) for cell, _ in group)
        if parts > 1:
            shard, held = shard + parts, 0
        else:
            held += n

    for leaf, group in leaves.items():
        put(leaf, group)
    return out
