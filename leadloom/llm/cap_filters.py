"""Near duplicates among embeddings with spherical-cap filters.

Two vectors of one label and length are linked when their cosine reaches the threshold.

1. Rows of equal label and vector (by 128 bits of hash) are one node.
2. Filters are caps around code words: a vector, turned by a fixed rotation, is cut into blocks, every
   block has its own code of random unit vectors, and a code word is one of each. A cap holds the
   vectors that come within a margin of their own greatest product with any word; the words that a
   vector exceeds so far are listed block by block, dropping what is too far behind already, so few
   words are ever looked at. (With one height for all vectors 42 % of pairs at the threshold
   shared no cap in 64 dimensions, since products of block codes clump: lucky vectors have hundreds
   of words and others none.)
3. The margin is twice the standard deviation by which products of linked vectors differ; code sizes
   follow from the greatest number of nodes of a label, so that few strangers share a
   cap, and from how many words random vectors have. Of 20,000 pairs at the threshold in 64
   dimensions none was without a common cap; closer pairs share more.
4. In every cap with several nodes one is the pivot. Each node is verified against the pivot of
   its fullest cap, and links are joined to components; that settles most groups of copies.
5. Caps that still hold several components are compared across them in blocks; from
   there come the links that join components.
6. All links are within components: each node's links are counted there, in blocks
   of SLICE rows, by matrix products. Pairs are never listed, and rows of equal vectors
   count by their number. Small components share blocks.

The work of step 6 is quadratic in a component's distinct vectors, dealt over tasks.

Vectors that are null, empty or zero, or hold null or non-finite components, and rows without
label link with nothing: their component is their own id. Rows without id link with
nothing, have no component and are kept. Rows that repeat an id are vectors of their own, so a repeated row is
linked with its copy. Vectors of different lengths are never linked. An empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .graph import components
from .near_dups import _dealt

LEAST_COSINE = 0.98
MARGIN = 2.0  # standard deviations
STRANGERS, USUAL_WORDS, MOST_WORDS = 2, 60, 400
LEAST_NODES = 500
SLICE = 2048
SEED = 13


@lru_cache(maxsize=32)
def filters_for(dim: int, nodes: int, cosine: float) -> tuple[np.ndarray, list[tuple[slice, np.ndarray]], float]:
    """(rotation, codes of the blocks, margin) for so many nodes of one label; the same on every machine."""
    margin = MARGIN * np.sqrt((2 - 2 * cosine) / dim)
    blocks = 4 if dim >= 16 else 2 if dim >= 4 else 1
    size = int(np.ceil((USUAL_WORDS**2 * max(nodes, LEAST_NODES) / STRANGERS) ** (1 / blocks)))
    while True:
        g = np.random.default_rng([SEED, dim, size])
        rotation = np.linalg.qr(g.standard_normal((dim, dim)))[0]
        codes = []
        for part in np.array_split(np.arange(dim), blocks):
            code = g.standard_normal((size, len(part)))
            codes.append((slice(part[0], part[-1] + 1), code / np.linalg.norm(code, axis=1, keepdims=True) / np.sqrt(blocks)))
        some = g.standard_normal((16, dim))
        row, _ = decode(some / np.linalg.norm(some, axis=1, keepdims=True), rotation, codes, margin)
        if size <= 4 or len(row) <= MOST_WORDS * len(some):
            return rotation, codes, margin
        size = int(0.8 * size)


def decode(x: np.ndarray, rotation: np.ndarray, codes: list[tuple[slice, np.ndarray]], margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, code word) of all words that the unit vectors x exceed, that is whose caps hold them."""
    y = x @ rotation
    row, word, behind = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for part, code in codes:
        product = y[:, part] @ code.T
        lost = (product.max(axis=1, keepdims=True) - product)[row] + behind[:, None]
        at, c = np.nonzero(lost <= margin)
        row, word, behind = row[at], word[at] * len(code) + c, lost[at, c]
    return row, word


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of unit length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _list_words(batches: Iterator[pa.RecordBatch], most: dict[int, int], cosine: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch.column("dim").to_numpy()
        for dim in np.unique(lengths).tolist():
            own = batch.filter(pa.array(lengths == dim))
            words = filters_for(dim, most[dim], cosine)
            step = min(128, max(4, 20_000 // len(words[1][0][1])))  # vectors that are decoded at once
            for at in range(0, own.num_rows, step):
                part = own.slice(at, step)
                row, word = decode(_matrix(part.column("v")), *words)
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(row)) for c in ("kind", "dim", "node")] + [pa.array(word)], names=["kind", "dim", "node", "word"])


def _verify(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch.column("dim").to_numpy()
        for dim in np.unique(lengths).tolist():
            own = batch.filter(pa.array(lengths == dim))
            near = np.einsum("ij,ij->i", _matrix(own.column("x")), _matrix(own.column("y"))) >= cosine
            yield own.select(["a", "b"]).filter(pa.array(near))


def _strips(x: np.ndarray, y: np.ndarray, cosine: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Which rows of y are near rows of x, some rows of x at a time."""
    for at in range(0, len(x), 512):
        yield slice(at, at + 512), x[at : at + 512] @ y.T >= cosine


def _join_across(table: pa.Table, cosine: float) -> pa.Table:
    """Links of one block between components, enough to join all that are linked."""
    table = table.sort_by("node")
    node, side = table.column("node").to_numpy(), table.column("side").to_numpy()
    names, part = np.unique(table.column("label").to_numpy(), return_inverse=True)
    _, group = np.unique(table.column("n").to_numpy(), return_inverse=True)
    parent, out = np.arange(len(names)), []
    for kind in np.unique(group):  # one label and length; several only where two keys have one hash
        left, right = np.flatnonzero((side == 0) & (group == kind)), np.flatnonzero((side == 1) & (group == kind))
        diagonal = not (side == 1).any()
        right = left if diagonal else right
        if not len(left) or not len(right):
            continue
        x = np.stack([np.frombuffer(v, "f8") for v in table.column("sketch").take(pa.array(left)).to_pylist()])
        y = x if diagonal else np.stack([np.frombuffer(v, "f8") for v in table.column("sketch").take(pa.array(right)).to_pylist()])
        for own, near in _strips(x, y, cosine):
            near &= part[left[own]][:, None] != part[right][None, :]
            for i, j in zip(*np.nonzero(near), strict=True):
                a, b = left[own][i], right[j]
                if parent[part[a]] != parent[part[b]]:
                    out.append((node[a], node[b]))
                    parent[parent == parent[part[b]]] = parent[part[a]]
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes, for blocks."""
    for batch in batches:
        lengths = batch.column("dim").to_numpy()
        for dim in np.unique(lengths).tolist():
            own = batch.filter(pa.array(lengths == dim))
            yield pa.RecordBatch.from_arrays([own.column("node"), own.column("n"), pa.array([r.tobytes() for r in _matrix(own.column("v"))], pa.binary())], names=["node", "n", "sketch"])


def _count(table: pa.Table, cosine: float) -> pa.Table:
    """(node, links) of one block: rows linked with each node, those of its own vector left out."""
    nodes, links = [], []
    lengths = table.column("dim").to_numpy()
    for dim in np.unique(lengths).tolist():
        own = table.filter(pa.array(lengths == dim)).combine_chunks().sort_by("node")
        x = _matrix(own.column("v").combine_chunks())
        side, part, c = (own.column(k).to_numpy() for k in ("side", "component", "c"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        diagonal = not len(right) and not (table.column("side").to_numpy() == 1).any()
        right = left if diagonal else right
        found = np.zeros(len(side), np.int64)
        for rows, near in _strips(x[left], x[right], cosine):
            near &= part[left[rows]][:, None] == part[right][None, :]
            if diagonal:
                near[np.arange(near.shape[0]), np.arange(near.shape[0]) + rows.start] = False
            found[left[rows]] += near @ c[right]
            if not diagonal:
                found[right] += near.T @ c[left[rows]]
        nodes.append(own.column("node").to_numpy())
        links.append(found)
    return pa.table([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(links))], names=["node", "links"])


def _counted(nodes: DataFrame, joined: DataFrame, cosine: float) -> DataFrame:
    """(node, links) of the nodes of components; each pair of a component meets in one block."""
    sizes = durable(joined.groupBy("component").agg(F.count("*").alias("size")), "cap-sizes")
    few = sizes.filter(F.col("size") <= SLICE // 2).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    of = joined.join(sizes, "component").join(nodes.select("node", "dim", "v", "c"), "node")
    is_small = F.col("size") <= SLICE // 2
    block = F.when(is_small, F.pmod(F.xxhash64("component"), F.lit(max(1, few // SLICE)))).otherwise(F.col("component"))
    parts = F.when(is_small, 1).otherwise(F.ceil(F.col("size") / SLICE)).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("parts")).cast("int")
    of = of.withColumns({"is_small": is_small, "block": block, "parts": parts}).withColumn("mine", mine)
    turn = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: F.struct(F.least("mine", t).alias("i"), F.greatest("mine", t).alias("j"), F.when(F.col("mine") <= t, 0).otherwise(1).alias("side"))))
    dealt = of.select("is_small", "block", "node", "component", "dim", "v", "c", turn.alias("t")).select("is_small", "block", "t.*", "node", "component", "dim", "v", "c")
    counts = dealt.groupBy("is_small", "block", "i", "j").applyInArrow(lambda t: _count(t, cosine), "node long, links long")
    return counts.groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(vectors: DataFrame, cosine: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("string").alias("kind"), vectors["embedding"].cast("array<double>").alias("v"))
    usable = F.expr("vec_id IS NOT NULL AND kind IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x != 0)")
    named = rows.withColumns({"h1": F.when(usable, F.xxhash64("kind", "v")), "h2": F.when(usable, F.xxhash64(F.lit(SEED), "v", "kind"))})
    made = named.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min("vec_id").alias("least"), F.first("kind").alias("kind"), F.first("v").alias("v"))
    nodes = durable(made.withColumns({"dim": F.size("v"), "node": F.monotonically_increasing_id()}), "cap-nodes")
    most = {r.dim: r.n for r in nodes.groupBy("kind", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).collect()}  # one row for each length of vectors
    words = durable(nodes.select("kind", "dim", "node", "v").mapInArrow(partial(_list_words, most=most, cosine=cosine), "kind string, dim int, node long, word long"), "cap-words")
    key = ["kind", "dim", "word"]
    caps = words.groupBy(*key).agg(F.count("*").alias("size"), F.min_by("node", F.xxhash64("word", "node")).alias("pivot")).filter("size > 1")
    members = durable(words.join(durable(caps, "caps"), key), "cap-members")
    pairs = durable(members.filter("node != pivot").groupBy(F.col("node").alias("a"), "dim").agg(F.max_by("pivot", F.struct("size", "word")).alias("b")), "cap-pairs")
    x, y = nodes.select(F.col("node").alias("a"), F.col("v").alias("x")), nodes.select(F.col("node").alias("b"), F.col("v").alias("y"))
    links = durable(pairs.join(x, "a").join(y, "b").select("a", "b", "dim", "x", "y").mapInArrow(partial(_verify, cosine=cosine), "a long, b long"), "cap-links")
    found = components(links)
    own = durable(members.join(found, "node", "left").select(F.xxhash64(*key).alias("key"), "node", F.xxhash64("kind", "dim").alias("n"), F.coalesce("label", "node").alias("label")), "cap-labelled")
    mixed = durable(own.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key"), "cap-mixed")
    across = own.join(mixed, "key")
    asked = durable(across.select("node", "n").distinct(), "cap-asked")
    units = durable(nodes.join(asked, "node").select("node", "dim", "n", "v").mapInArrow(_unit, "node long, n long, sketch binary"), "cap-units")
    blocks = _dealt(durable(across.join(units.drop("n"), "node"), "cap-across")).groupBy("key", "i", "j", "kind")
    more = durable(blocks.applyInArrow(lambda t: _join_across(t, cosine), "a long, b long"), "cap-more")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    joined = found.select("node", F.col("label").alias("component"))
    least = durable(joined.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id")), "cap-least")
    judged = joined.join(least, "component").join(_counted(nodes, joined, cosine), "node").select("node", "component_id", "links")
    ends = durable(nodes.select("h1", "h2", "node", "c", "least").join(judged, "node", "left").select("h1", "h2", (F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "cap-ends")
    out = named.select("vec_id", "h1", "h2").join(ends, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
