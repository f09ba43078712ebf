"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives a vector a string of BITS bits, the sides of seeded random planes
through its shard's mean, and is a sorted array of those strings. The forest of a shard is
built once and kept beside its vectors.

A query descends each tree to its longest matching prefixes, up to the first whose ranges
hold FIRST rows for each that is asked for, and takes from those that most trees hold a
first bound for the kth distance (or the better one that other shards have given). Then it ascends all trees at once to shorter prefixes, for more
candidates. Two vectors at an angle t share a bit with probability 1 - t / pi, so at the
bound's angle the number of trees whose prefix range holds a row is binomial; rows that
fewer trees hold than it has with probability EXPECTED are no candidates. The prefix
length is the one at which the ranges and the candidates that independent rows would give
cost least. Candidates are ranked by exact distance in double precision, on the original
vectors. So close neighbours are found among few candidates, and more are looked at where
the kth neighbour is hardly nearer than the rest; see the README for figures.

Every row is indexed; a query searches all shards. Zero vectors take no part; see
``vectors`` for nulls, repeated rows, ties, empty tables and partitioning.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import search

TREES, BITS, SEED = 96, 16, 9
EXPECTED = 0.8
QUERIES = 1024  # so many queries at once: their strings and ranges take some 40 MB
FIRST = 64  # so many rows for each that is asked for in the ranges from which the first bound is taken
#: What a row costs in a prefix range, in multiplications.
RANGE_COST = 4.0

_CHOOSE = np.array([math.lgamma(TREES + 1) - math.lgamma(j + 1) - math.lgamma(TREES - j + 1) for j in range(TREES + 1)])


@functools.lru_cache(4)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim, TREES * BITS))


def strings(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """(trees, rows) of hash strings, as integers whose leading bits are the prefix."""
    side = ((x - mean) @ _planes(x.shape[1]) > 0).reshape(len(x), TREES, BITS)
    return (side @ (1 << np.arange(BITS - 1, -1, -1, dtype="i4"))).T.astype("i4")


def plant(x: np.ndarray) -> bytes:
    """The forest of a shard: its mean, sorted strings and their rows; zero vectors are left out."""
    x = x.astype("f8")
    rows = np.flatnonzero(np.any(x != 0, axis=1))
    mean = x[rows].mean(axis=0) if len(rows) else np.zeros(x.shape[1])
    code = strings(x[rows], mean)
    order = np.argsort(code, axis=1, kind="stable")
    return mean.tobytes() + np.take_along_axis(code, order, 1).astype("u2").tobytes() + rows[order].astype("i4").tobytes()


def at_least(p: np.ndarray) -> np.ndarray:
    """(probabilities, TREES + 1): that so many trees or more succeed."""
    p = np.clip(p, 1e-300, 1 - 1e-16)[:, None]
    j = np.arange(TREES + 1)
    pmf = np.exp(_CHOOSE + j * np.log(p) + (TREES - j) * np.log1p(-p))
    return np.cumsum(pmf[:, ::-1], axis=1)[:, ::-1]


_LENGTHS = np.arange(BITS + 1)
_BY_CHANCE = at_least(0.5**_LENGTHS)


def ascent(bit: float, dim: int, expected: float = EXPECTED) -> tuple[int, int]:
    """(prefix length, trees) for rows that share a bit with this probability; (0, 0) is every row."""
    need = np.count_nonzero(at_least(bit**_LENGTHS) >= expected, axis=1) - 1
    cost = TREES * 0.5**_LENGTHS * RANGE_COST + dim * _BY_CHANCE[_LENGTHS, need]
    cost[need < 1] = np.inf
    cost[0] = dim
    n = int(np.argmin(cost))
    return (n, int(need[n])) if n else (0, 0)


def _near(x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((y[rows] - x) ** 2).sum(axis=1))


def forest_search(qids: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, extra: bytes, k: int, at_most: np.ndarray, expected: float = EXPECTED, looked: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, distance) of each query's k nearest among the candidates of this shard; ``looked`` gets numbers of candidates."""
    if len(x) > QUERIES:
        parts = []
        for a in range(0, len(x), QUERIES):
            own = slice(a, a + QUERIES)
            at, found, dist = forest_search(qids[own], x[own], ids, y, extra, k, at_most[own], expected, looked)
            parts.append((at + a, found, dist))
        return tuple(np.concatenate(z) for z in zip(*parts, strict=True))
    x, y = x.astype("f8"), y.astype("f8")
    dim = y.shape[1]
    n = (len(extra) - 8 * dim) // (6 * TREES)
    mean = np.frombuffer(extra, "f8", dim)
    arrays = np.frombuffer(extra, "u2", n * TREES, 8 * dim).reshape(TREES, n).astype("i4")
    order = np.frombuffer(extra, "i4", n * TREES, 8 * dim + 2 * n * TREES).reshape(TREES, n)
    if not n or not len(x):
        return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "f8")
    ask = strings(x, mean)

    @functools.cache
    def level(at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, trees): where the range of each prefix of this length begins and ends; rows in all ranges of a query."""
        first = (ask >> (BITS - at)) << (BITS - at)
        lo, hi = (np.stack([np.searchsorted(arrays[t], first[t] + more) for t in range(TREES)], axis=1) for more in (0, 1 << (BITS - at)))
        return lo, hi, (hi - lo).sum(axis=1)

    def ranges(at: int, q: int) -> np.ndarray:
        lo, hi, _ = level(at)
        return np.concatenate([order[0, :0], *(order[t, a:b] for t, (a, b) in enumerate(zip(lo[q].tolist(), hi[q].tolist(), strict=True)) if b > a)])

    def longest(q: int, rows: int) -> int:
        """The longest prefix whose ranges hold so many rows, or 0."""
        low, high = 0, BITS + 1
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if level(mid)[2][q] >= rows else (low, mid)
        return low

    size, length = np.sqrt(((y - mean) ** 2).sum(axis=1)), np.sqrt(((x - mean) ** 2).sum(axis=1))
    typical, out = float(np.sqrt((size[order[0]] ** 2).mean())), []
    for q in np.flatnonzero(np.any(x != 0, axis=1)):
        own = ids == qids[q]
        bound, of = float(at_most[q]), typical
        rows, dist = np.empty(0, "i8"), np.empty(0)
        if deep := longest(q, FIRST * k):  # down to the longest prefixes that hold some rows, and those in most trees
            rows, trees = np.unique(ranges(deep, q), return_counts=True)
            rows = rows[np.argsort(-trees, kind="stable")[: FIRST // 4 * k + 1]]
            rows = rows[~own[rows]]
            dist = _near(x[q], y, rows)
            if len(rows) >= k:
                best = np.argpartition(dist, k - 1)[:k]
                if dist[best].max() <= bound:
                    bound, of = float(dist[best].max()), float(np.sqrt((size[rows[best]] ** 2).mean()))
        at, need = 0, 0
        if np.isfinite(bound) and length[q] > 0 and of > 0:
            cosine = (length[q] ** 2 + of**2 - bound**2) / (2 * length[q] * of)
            at, need = ascent(1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi, dim, expected)
        held = np.bincount(ranges(at, q), minlength=len(ids)) >= need if at else np.bincount(order[0], minlength=len(ids)) > 0
        held[rows] = False
        held &= ~own
        more = np.flatnonzero(held)
        if looked is not None:
            looked.append(len(rows) + len(more))
        rows, dist = np.append(rows, more), np.append(dist, _near(x[q], y, more))
        near = dist <= at_most[q]
        rows, dist = rows[near], dist[near]
        best = np.lexsort((ids[rows], dist))[:k]
        out.append((np.full(len(best), q), ids[rows[best]], dist[best]))
    if not out:
        return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "f8")
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found, by Euclidean distance."""
    kind = "f8" if "double" in vectors.schema["embedding"].dataType.simpleString() else "f4"
    out = search(vectors, is_query, k, kind, "double", False, forest_search, plant)
    return out.select("query_id", "rank", "vec_id", F.col("score"))
