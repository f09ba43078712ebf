"""Exact top-k by inner product with block-at-a-time pruning.

Documents (vectors of integer term weights) are kept in document-range blocks, each
with its terms' maxima and minima, its longest row and a block forward index (its rows of
weights). For a query the blocks are ordered by the summed term bounds (no more than the
product of lengths allows), scored in that order through their forward indexes, some
blocks at a time (1, 2, 4, ...), and left when the best bound that remains is below the
kth score; blocks whose bound equals it are still scored, as ties go to smaller ids. The
kth score is at least what the pilot pass and earlier shards have found (see ``vectors``).

How many blocks a bound can spare is a matter of the data: see the README for figures.

Weights are floor(256 * x) of each component in double precision. Products are summed
in doubles while they are exact there, else in Python's integers and held to 64 bits.
See ``vectors`` for nulls, repeated rows, empty tables and partitioning.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import search

BLOCK = 128
SCALE = 256.0


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T as exact integers."""
    if len(x) and len(y) and float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] >= 2.0**53:
        whole = np.vectorize(int, otypes=[object])
        out = whole(x) @ whole(y).T
        return np.vectorize(lambda v: max(-(2**63), min(2**63 - 1, v)), otypes=["i8"])(out)
    return (x @ y.T).astype("i8")


def block_bounds(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(queries, blocks): no row of the block has a greater product."""
    top, low = np.maximum.reduceat(y, starts), np.minimum.reduceat(y, starts)
    longest = np.maximum.reduceat(np.sqrt((y * y).sum(axis=1)), starts)
    bound = np.minimum(np.maximum(x, 0) @ top.T + np.minimum(x, 0) @ low.T, np.sqrt((x * x).sum(axis=1))[:, None] * longest)
    return bound + np.abs(bound) * 1e-9  # sums of large weights are rounded


def block_search(qids: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, extra: bytes, k: int, at_least: np.ndarray, scored: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of each query's k best among these rows that reach ``at_least``; ``scored`` gets numbers of scored pairs."""
    x, y = np.floor(x.astype("f8") * SCALE), np.floor(y.astype("f8") * SCALE)
    starts = np.arange(0, len(ids), BLOCK)
    bound = block_bounds(x, y, starts)
    turn = np.argsort(-bound, axis=1, kind="stable")
    kth = at_least.copy()
    at, found, scores = np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "i8")
    open_, done, step = np.arange(len(x)), 0, 1
    while len(open_) and done < len(starts):
        blocks = turn[open_, done : done + step]
        go = bound[open_[:, None], blocks] >= kth[open_][:, None]
        hits = [(at, found, scores)]
        for b in np.unique(blocks[go]):
            q = open_[(go & (blocks == b)).any(axis=1)]
            rows = slice(starts[b], starts[b] + BLOCK)
            s = _products(x[q], y[rows])
            if scored is not None:
                scored.append(s.size)
            i, j = np.nonzero((s >= kth[q][:, None]) & (ids[rows][None, :] != qids[q][:, None]))
            hits.append((q[i], ids[rows][j], s[i, j]))
        at, found, scores = (np.concatenate(z) for z in zip(*hits, strict=True))
        order = np.lexsort((found, ~scores, at))  # ~s orders like -s and cannot overflow
        at, found, scores = at[order], found[order], scores[order]
        start = np.searchsorted(at, at)
        place = np.arange(len(at)) - start
        full = place == k - 1
        kth[at[full]] = np.maximum(kth[at[full]], scores[full].astype("f8"))
        keep = place < k
        at, found, scores = at[keep], found[keep], scores[keep]
        done, step = done + step, 2 * step
        open_ = open_[go[:, -1]]
    return at, found, scores


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest inner products; ties to smaller ids."""
    kind = "f8" if "double" in vectors.schema["embedding"].dataType.simpleString() else "f4"
    out = search(vectors, is_query, k, kind, "long", True, block_search)
    return out.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
