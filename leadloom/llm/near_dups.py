"""Near-duplicate classes with SetSketch registers.

A document's set is its distinct 5-word shingles, as 64-bit hashes. A register holds the
least of an exponential variate over the set (rate RATE), on the scale of powers of
BASE and cut to 0..255; registers of a union are the maxima of registers, and two
sets' registers agree about as often as the sets do.

1. Documents with equal sets (by 128 bits of hash) are one node; what follows is over nodes,
   which are numbered.
2. Bands of ROWS registers are hashed. In every bucket each node is paired with the
   bucket's pivot (the least by a hash that differs from band to band), so a bucket of
   n nodes gives n - 1 pairs.
3. A pair's similarity is estimated by maximum likelihood from how many registers are
   greater, less and equal, given both sizes. Pairs more than MARGIN standard errors
   under the threshold go.
4. Each node's best pair is verified on full sets, and verified pairs are joined to
   components. In most groups this leaves one component.
5. In buckets that still hold several components, pairs across them are compared in
   blocks, each pair in the first bucket that it shares. The members of a bucket's largest
   component are compared with the others alone, so they are sent once for each block of
   others. Sketches go first; only nodes that have a plausible partner bring their full
   sets, in blocks bounded by rows and by bytes, where pairs that pass the estimate are
   verified until a block has nothing left to join. So every pair that shares a bucket is
   either inside one component or has been tested.

The threshold is a parameter, 0.85 for op3 and 0.80 in the pipeline. Two sets of
similarity 0.85 share no bucket with probability (1 - 0.85^6)^32 < 3e-7, two of
similarity 0.80 with (1 - 0.80^6)^32, about 6e-5. The bands are not made for less.

Null and empty texts, and texts without words, have an empty set and link with nothing.
Rows without id are never linked; their component is null and they are kept. Rows that
repeat an id and text get equal results. Very long texts have large sets and are like
others. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import _M1, _M2, mix
from .common import durable
from .graph import components

K_WORDS = 5
LEAST_SHARE = (85, 100)
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
RATE, BASE = 20.0, 1.1
MARGIN = 5.0
SURELY_LESS = 0.5  # with fewer registers alike no estimate comes near the threshold
SLICE, SLICE_BYTES = 512, 24 << 20
WORDS_KEPT = 50_000  # some 10 MB in every Python worker, idle ones too
SMALL_SIDE = 500_000

_RNG = np.random.default_rng(31)
_MUL = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)


class _Words(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None, k: int = K_WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, ordered."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six white-space characters of ASCII
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * _M1 + h[j : j + n] + _M2)
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set that is not empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for a in range(0, len(x), 2048):
        y = np.multiply.outer(_MUL, x[a : a + 2048])
        y += _ADD[:, None]
        np.minimum(least, y.min(axis=1), out=least)
    e = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, 255).astype(np.uint8)


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(one, other)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def likely_similarity(n1: np.ndarray, n2: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Jaccard similarities of greatest likelihood, given sizes and how many registers of the first are greater and less."""
    u = n1 / (n1 + n2)
    v = 1 - u
    same = REGISTERS - more - less
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)

    def fit(j: np.ndarray) -> np.ndarray:
        a, b = _p(u - v * j), _p(v - u * j)
        tiny = 1e-12
        return more * np.log(a + tiny) + less * np.log(b + tiny) + same * np.log(np.maximum(1 - a - b, tiny))

    for _ in range(22):
        third = (hi - lo) / 3
        left = fit(lo + third) < fit(hi - third)
        lo, hi = np.where(left, lo + third, lo), np.where(left, hi, hi - third)
    return (lo + hi) / 2


def least_estimate(least_share: tuple[int, int]) -> float:
    t = least_share[0] / least_share[1]
    return t - MARGIN * (t * (1 - t) / REGISTERS) ** 0.5


_SIGS = "doc_id long, n long, name binary, sketch binary"


def _name(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, name, sketch = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingles(text)
            n.append(len(s))
            name.append(_name(s) if len(s) else None)
            sketch.append(registers(s).tobytes() if len(s) else None)
        yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "n", "name", "sketch"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column("node").to_numpy()
        s = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(node), BANDS, ROWS)
        packed = (s.astype(np.uint64) << (np.arange(ROWS, dtype=np.uint64) * np.uint64(8))).sum(axis=2)
        key = mix(packed * _M1 + np.arange(1, BANDS + 1, dtype=np.uint64) * _M2)
        key = key // np.uint64(BANDS) * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)  # a key tells its band
        yield pa.record_batch([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(node, BANDS))], names=["key", "node"])


def _compare(s1: np.ndarray, s2: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    return likely_similarity(n1.astype(float), n2.astype(float), (s1 > s2).sum(axis=-1), (s1 < s2).sum(axis=-1))


def _estimate(batches: Iterator[pa.RecordBatch], least_share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        s1, s2 = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("s1", "s2"))
        j = _compare(s1, s2, batch.column("n1").to_numpy(), batch.column("n2").to_numpy())
        keep = pa.array(j >= least_estimate(least_share))
        yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(j).filter(keep)], names=["a", "b", "est"])


def _verify(batches: Iterator[pa.RecordBatch], least_share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    most, of = least_share
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(x) + len(y) - len(np.union1d(x, y))
            ok.append(of * common >= most * (len(x) + len(y) - common))
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([pa.array([_name(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["name", "hashes"])


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How much of each of the others is in one; all are ordered."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    sizes = np.array([len(x) for x in others])
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)


def _block(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(order, side, node, label, n, sketch, band) of one block, by node."""
    order = np.argsort(table.column("node").to_numpy(), kind="stable")
    side, node, label, n = (table.column(c).to_numpy()[order] for c in ("side", "node", "label", "n"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, REGISTERS)[order]
    return order, side, node, label, n, sketch, table.column("key")[0].as_py() % BANDS


def _plausible(i: int, r: np.ndarray, n: np.ndarray, sketch: np.ndarray, band: int, least_share: tuple[int, int]) -> np.ndarray:
    """Those of r that may be linked with i and share no earlier bucket with it."""
    most, of = least_share
    r = r[np.minimum(n[r], n[i]) * of >= np.maximum(n[r], n[i]) * most]
    same = sketch[r] == sketch[i]
    new = ~same[:, : band * ROWS].reshape(len(r), band, ROWS).all(axis=2).any(axis=1) if band and len(r) else np.ones(len(r), bool)
    return r[new & (same.sum(axis=1) >= SURELY_LESS * REGISTERS)]


def _with_partner(table: pa.Table, least_share: tuple[int, int]) -> pa.Table:
    """(key, node) of nodes with a plausible partner of another component in this block."""
    _, side, node, label, n, sketch, band = _block(table)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    diagonal, found = not len(right), np.zeros(len(node), bool)
    for turn, i in enumerate(left):
        r = left[turn + 1 :] if diagonal else right
        r = _plausible(i, r[label[r] != label[i]], n, sketch, band, least_share)
        found[r] = True
        found[i] |= len(r) > 0
    key = np.full(int(found.sum()), table.column("key")[0].as_py())
    return pa.table([pa.array(key), pa.array(node[found])], names=["key", "node"])


def _across(table: pa.Table, least_share: tuple[int, int]) -> pa.Table:
    """Links between components in one block, enough to join all that can be joined."""
    most, of = least_share
    order, side, node, label, n, sketch, band = _block(table)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    sets = [sets[i] for i in order]
    names, part = np.unique(label, return_inverse=True)
    parent = np.arange(len(names))
    largest = np.bincount(part).argmax()
    diagonal = not (side == 1).any()
    left = np.flatnonzero(side == 0)
    left = np.concatenate([left[part[left] != largest], left[part[left] == largest]])
    right = left if diagonal else np.flatnonzero(side == 1)
    out: list[tuple[int, int]] = []
    for turn, i in enumerate(left):
        r = right[turn + 1 :] if diagonal else right
        r = _plausible(i, r[parent[part[r]] != parent[part[i]]], n, sketch, band, least_share)
        if not len(r):
            continue
        j = _compare(sketch[i][None], sketch[r], np.full(len(r), n[i]), n[r])
        r = r[np.argsort(-j, kind="stable")[: int((j >= least_estimate(least_share)).sum())]]
        while len(r):
            now, r = r[:32], r[32:]
            c = _common(sets[i], [sets[k] for k in now])
            for k in now[of * c >= most * (n[now] + n[i] - c)]:
                if parent[part[k]] != parent[part[i]]:
                    out.append((node[i], node[k]))
                    parent[parent == parent[part[k]]] = parent[part[i]]
            r = r[parent[part[r]] != parent[part[i]]]
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])


def near_duplicates(docs: DataFrame, least_share: tuple[int, int] = LEAST_SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text); sets of least_share or more are linked."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    sigs = durable(rows.mapInArrow(_sign, _SIGS), "sigs")
    named = sigs.filter("name IS NOT NULL AND doc_id IS NOT NULL")
    first = named.groupBy("name").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = durable(first.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # aggregates are written before they are joined: only then can Spark split a hot bucket or component
    bands = durable(nodes.select("node", "sketch").mapInArrow(_bands, "key long, node long"), "bands")
    pivots = bands.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("key", "node").alias("o"), "node")).alias("p")).filter("c > 1")
    members = durable(bands.join(durable(pivots.select("key", "c", F.col("p.node").alias("pivot")), "pivots"), "key"), "members")
    labels = _link(rows, nodes, members, least_share)
    least = nodes.select("node", "least")
    of_label = durable(labels.join(least, "node").groupBy("label").agg(F.min("least").alias("component")), "of-label")
    moved = durable(labels.join(of_label, "label").select("node", "component"), "components")
    ids = durable(nodes.select("name", "node", "least").join(moved, "node", "left").select("name", F.coalesce("component", "least").alias("component")), "ids")
    out = sigs.join(ids, "name", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _link(rows: DataFrame, nodes: DataFrame, members: DataFrame, least_share: tuple[int, int]) -> DataFrame:
    """(node, label) of all nodes that have a link."""
    sized = lambda i: nodes.select(F.col("node").alias("ab"[i]), F.col("n").alias(f"n{i + 1}"), F.col("sketch").alias(f"s{i + 1}"))
    pairs = members.filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    likely = pairs.join(sized(0), "a").join(sized(1), "b").mapInArrow(partial(_estimate, least_share=least_share), "a long, b long, est double")
    best = durable(likely.groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b")), "best")
    needed = durable(members.select("node").distinct().join(nodes.select("node", "name", F.col("least").alias("doc_id")), "node"), "needed")
    ids = needed.select("doc_id").distinct()
    if needed.count() <= SMALL_SIDE:  # 8 bytes each; beyond that the texts are shuffled
        ids = F.broadcast(ids)
    texts = rows.join(ids, "doc_id").select("text")
    sets = durable(texts.mapInArrow(_sets, "name binary, hashes binary").join(needed.select("name", "node"), "name").dropDuplicates(["node"]).select("node", "hashes"), "sets")
    x, y = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    tested = best.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(partial(_verify, least_share=least_share), "a long, b long, ok boolean")
    links = durable(tested.filter("ok").select("a", "b"), "links")
    labels = components(links)
    own = durable(members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "labelled")
    mixed = own.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    mixed = durable(mixed, "mixed-keys")
    own = durable(own.join(mixed, "key").join(nodes.select("node", "n", "sketch"), "node"), "mixed")
    deal = lambda x, f, schema: _dealt(x).groupBy("key", "i", "j", "kind").applyInArrow(f, schema)
    some = durable(deal(own, lambda t: _with_partner(t, least_share), "key long, node long").distinct(), "plausible")
    full = own.join(some, ["key", "node"]).join(sets, "node")
    more = durable(deal(full, lambda t: _across(t, least_share), "a long, b long"), "across")
    return labels if more.isEmpty() else components(links.unionByName(more))


def _dealt(own: DataFrame) -> DataFrame:
    """Members of buckets dealt to blocks (key, i, j, kind): slices of the others with each other and with those of the largest component.

    side 0 is slice i of the others, side 1 what it meets; where both are one slice there is side 0 alone.
    """
    size = F.when(F.lit("hashes" in own.columns), F.col("n") * 8).otherwise(F.lit(0)) + REGISTERS
    parts = own.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum(size).alias("b"))
    sums = parts.groupBy("key").agg(F.max(F.struct("c", "label", "b")).alias("top"), F.sum("c").alias("c"), F.sum("b").alias("b"))
    slices = lambda c, b: F.greatest(F.ceil(c / SLICE), F.ceil(b / SLICE_BYTES), F.lit(1)).cast("int")
    sums = sums.select("key", F.col("top.label").alias("top"), slices(F.col("top.c"), F.col("top.b")).alias("p_top"), slices(F.col("c") - F.col("top.c"), F.col("b") - F.col("top.b")).alias("p"))
    own = own.join(durable(sums, "bucket-sizes"), "key").withColumn("is_top", F.col("label") == F.col("top"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("is_top"), F.col("p_top")).otherwise(F.col("p"))).cast("int")
    own = own.withColumn("mine", mine)
    turn = lambda i, j, kind, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(kind).alias("kind"), side.cast("int").alias("side"))
    among = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda t: turn(F.least("mine", t), F.greatest("mine", t), "others", F.when(F.col("mine") <= t, 0).otherwise(1)))
    with_top = F.transform(F.sequence(F.lit(0), F.col("p_top") - 1), lambda t: turn(F.col("mine"), t, "top", F.lit(0)))
    as_top = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda t: turn(t, F.col("mine"), "top", F.lit(1)))
    turns = F.explode(F.when(F.col("is_top"), as_top).otherwise(F.concat(among, with_top)))
    kept = [c for c in ("key", "node", "label", "n", "sketch", "hashes") if c in own.columns]
    dealt = own.select(*kept, turns.alias("t")).select(*kept, "t.i", "t.j", "t.kind", "t.side")
    # few bytes but much work: so many tasks that Spark's sizing by bytes does not lump them
    return dealt.repartition(4 * int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "i", "j", "kind")


def one_of_each(docs: DataFrame, least_share: tuple[int, int] = LEAST_SHARE) -> DataFrame:
    """docs without near duplicates: the rows with the smallest id of each component, once; rows without id stay.

    Of several rows of one id the one whose text has the least hash stays. Texts stay in
    place where the ids that go are few enough (SMALL_SIDE) to be broadcast.
    """
    judged = near_duplicates(docs, least_share).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("c"))
    judged = durable(judged.filter("NOT kept OR c > 1"), "judged")

    def listed(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= SMALL_SIDE else ids

    out = docs.join(listed(judged.select("doc_id")), "doc_id", "left_anti")
    again = judged.filter("kept").select("doc_id")
    if again.isEmpty():
        return out
    row = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.join(listed(again), "doc_id", "left_semi").select(docs["doc_id"].alias("id"), F.struct(F.xxhash64(docs["text"]), F.xxhash64(*[docs[c] for c in docs.columns])).alias("turn"), row.alias("row"))
    return out.select(docs.columns).unionByName(rows.groupBy("id").agg(F.min_by("row", "turn").alias("row")).select("row.*"))
