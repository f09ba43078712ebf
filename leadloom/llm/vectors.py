"""What both vector searches share: an index of shards that stays in place, and passes of queries over it.

Vectors are dealt in ranges of their ids (rows of one id by their place in the input, so a
repeated id is dealt too), some SHARD to an index row, and written once; that is the only
shuffle of vectors. Queries go over the index in chunks of at most CHUNK_BYTES: a pilot
pass over the first shard of each length tells how good a query's kth row is at least,
then the other shards are searched with that bound, which tightens from shard to shard
within a task. Only rows that reach the bound leave a task, and a window over them picks the best
of all. So each query meets all rows, in blocks; what is sent to tasks is bounded by the
chunk, and what is shuffled by what reaches the bounds.

Vectors that are null, empty, or hold null or non-finite components take no part, nor
do null ids. Vectors of different lengths are never compared. A row never meets rows of
its own id; repeated (id, vector) rows are one query but as many candidates. An empty
table gives no rows. Columns other than vec_id and embedding are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

SHARD = 8192
CHUNK_BYTES = 8 << 20

PACKED = "dim int, n int, low long, bytes long, qkeys binary, ids binary, data binary, extra binary"
FOUND = "qkey long, query_id long, vec_id long, score {}"
COLUMNS = ["dim", "n", "low", "bytes", "qkeys", "ids", "data", "extra"]


def _packer(dtype: str, rows: int, build: Callable[[np.ndarray], bytes]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def made(dim: int, most: int) -> Iterator[pd.DataFrame]:
            """Full packs of a length, and with most 0 what is left."""
            keys, ids, x = (np.concatenate(z) for z in zip(*kept[dim], strict=True))
            at = 0
            while len(ids) - at >= max(1, most):
                own = slice(at, at + rows)
                at += rows
                yield pd.DataFrame([(dim, len(ids[own]), int(ids[own][0]), x[own].nbytes + 16 * len(ids[own]), keys[own].tobytes(), ids[own].tobytes(), x[own].tobytes(), build(x[own]))], columns=COLUMNS)
            kept[dim] = [(keys[at:], ids[at:], x[at:])]

        for batch in batches:
            lengths = batch["v"].map(len).to_numpy()
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                x = np.stack(batch["v"].to_numpy()[own]).astype("f8")
                good = np.isfinite(x).all(axis=1)
                kept.setdefault(dim, []).append((batch["qkey"].to_numpy(dtype="i8")[own][good], batch["vec_id"].to_numpy(dtype="i8")[own][good], x[good].astype(dtype)))
                if sum(len(z[1]) for z in kept[dim]) >= rows:
                    yield from made(dim, rows)
        for dim in kept:
            yield from made(dim, 0)

    return pack


def packed(vectors: DataFrame, dtype: str, what: str, build: Callable[[np.ndarray], bytes] = lambda x: b"", rows: int = SHARD) -> DataFrame:
    """Valid vectors, ``rows`` to a row in ranges of their ids, with what is built from each pack."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    v = v.filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    v = v.withColumns({"qkey": F.xxhash64("vec_id", "v"), "turn": F.monotonically_increasing_id()})
    parts = max(1, -(-v.count() // rows))
    order = [F.size("v"), "vec_id", "turn"]
    dealt = v.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return durable(dealt.select("vec_id", "v", "qkey").mapInPandas(_packer(dtype, rows, build), PACKED), what)


def unpack(row, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query keys, ids, vectors) of a packed row."""
    return np.frombuffer(row.qkeys, "i8"), np.frombuffer(row.ids, "i8"), np.frombuffer(row.data, dtype).reshape(-1, row.dim)


def search(vectors: DataFrame, is_query: Column, k: int, dtype: str, score: str, best_first: bool, in_shard: Callable, build: Callable[[np.ndarray], bytes] = lambda x: b"") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query; best_first: greater scores are better.

    in_shard(query ids, query vectors, ids, vectors, extra, k, bound) returns arrays (query
    index, vec_id, score) that hold all rows whose score reaches the bound, or the k best of them.
    """
    index = packed(vectors, dtype, "index", build)
    asked = packed(vectors.filter(is_query).dropDuplicates(["vec_id", "embedding"]), dtype, "queries", rows=1024)
    is_first = F.lit(False)
    for row in index.groupBy("dim").agg(F.min("low").alias("low")).collect():  # one for each length of vectors
        is_first = is_first | ((F.col("dim") == row.dim) & (F.col("low") == row.low))
    pilot, others = index.filter(is_first), index.filter(~is_first)
    sign = 1 if best_first else -1

    def scan(asks: list[tuple]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = [bound.copy() for *_, bound in asks]
            for shards in batches:
                for shard in shards.itertuples():
                    _, ids, y = unpack(shard, dtype)
                    for (dim, qkeys, qids, x, _), bound in zip(asks, best, strict=True):
                        if dim == shard.dim:
                            at, found, scores = in_shard(qids, x, ids, y, shard.extra, k, bound)
                            yield pd.DataFrame({"qkey": qkeys[at], "query_id": qids[at], "vec_id": found, "score": scores})
                            _tighten(bound, at, scores, k, sign)

        return run

    schema, found = FOUND.format(score), []
    for chunk in _chunks(asked):
        asks = []  # the chunk's queries of each length, and their bounds
        for dim in sorted({row.dim for row in chunk}):
            keys, ids, x = (np.concatenate(z) for z in zip(*(unpack(row, dtype) for row in chunk if row.dim == dim), strict=True))
            asks.append((dim, keys, ids, x, np.full(len(ids), -np.inf if best_first else np.inf)))
        found.append(durable(pilot.mapInPandas(scan(asks), schema), "pilot"))
        seen = found[-1].toPandas()  # some k rows for each query of the chunk
        for _, keys, ids, _, bound in asks:
            at = pd.Series(np.arange(len(ids)), index=pd.MultiIndex.from_arrays([keys, ids]))
            own = seen[pd.MultiIndex.from_frame(seen[["qkey", "query_id"]]).isin(at.index)]
            if len(own):
                _tighten(bound, at.loc[list(zip(own["qkey"], own["query_id"], strict=True))].to_numpy(), own["score"].to_numpy(), k, sign)
        found.append(durable(others.mapInPandas(scan(asks), schema), "found"))
    if not found:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, vec_id long, score {score}")
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    best = W.partitionBy("qkey", "query_id").orderBy(F.desc("score") if best_first else F.asc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _chunks(asked: DataFrame) -> Iterator[list]:
    """Packs of queries, brought to the driver some CHUNK_BYTES at a time."""
    places = asked.select("dim", "low", "bytes").withColumn("file", F.input_file_name()).distinct().orderBy("dim", "low", "file").collect()  # one short row for each 1,024 queries
    turn, size = [], 0
    for i, p in enumerate(places):
        turn, size = [*turn, p], size + p.bytes
        if size >= CHUNK_BYTES or i == len(places) - 1:
            wanted = F.lit(False)
            for q in turn:
                wanted = wanted | ((F.col("dim") == q.dim) & (F.col("low") == q.low) & (F.input_file_name() == q.file))
            yield asked.filter(wanted).collect()
            turn, size = [], 0


def _tighten(bound: np.ndarray, at: np.ndarray, scores: np.ndarray, k: int, sign: int) -> None:
    """Raise bounds (lower them, with sign -1) to the kth of the scores found for each query."""
    if not len(at):
        return
    order = np.lexsort((-sign * scores.astype("f8"), at))
    at, scores = at[order], scores[order]
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    count = np.diff(np.append(start, len(at)))
    full = start[count >= k]
    kth = scores[full + k - 1].astype("f8")
    bound[at[full]] = np.maximum(bound[at[full]], kth) if sign > 0 else np.minimum(bound[at[full]], kth)
