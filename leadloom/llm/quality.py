"""Quality scores from a byte-level convolutional network, in numpy.

A text's UTF-8 bytes are read in chunks of CHUNK bytes that overlap by half. First-layer
filters have a weight for each place and byte, and one for how many of the chunk's
bytes repeat what stood up to LAGS bytes before (a 4-byte equality, computed beside the
bytes; the README has figures without it). Second-layer filters read SPAN neighbouring
chunks. Each is max-pooled over the whole document, however long, and a logistic unit
combines the maxima.

The network is fitted on whole texts of at most TRAIN_ROWS labelled rows of each class,
chosen by a hash of the text's id, and of those on as many as hold TRAIN_BYTES in that
order; of rows that share an id the one whose text has the least hash counts. A step keeps
no more than what gave a maximum. Scores are made from the text alone.

Null texts are empty. An empty text gets the score of a network that sees only padding.
Without labels of both classes the score is the smoothed share of label 1. Labels that
are null or not 0 or 1 are ignored, repeated ones count once. Repeated rows get equal
scores, null ids keep theirs, and an empty table gives no rows. Extra columns are ignored,
whatever their names; good_documents keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK, STEP, SPAN, STRIDE = 16, 8, 4, 2
FIELD = STEP * (SPAN - 1) + CHUNK  # bytes that a second-layer filter sees
EACH = STEP * STRIDE
LAGS = 32
FILTERS, SECOND = 16, 16
PAD = 64  # after each document: more than FIELD and than LAGS + 4
PIECE = 1 << 20
TRAIN_ROWS, TRAIN_BYTES = 800, 64 << 20
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY, SEED = 8, 200, 32, 4e-3, 1e-4, 4
THRESHOLD = 0.3
FOLDS = 5


@dataclass
class Net:
    w: np.ndarray  # (CHUNK, 256, FILTERS)
    r: np.ndarray  # (FILTERS,)
    b: np.ndarray
    v: np.ndarray  # (SPAN * FILTERS, SECOND)
    c: np.ndarray
    u: np.ndarray  # (SECOND,)
    d: np.ndarray  # (1,)

    def parts(self) -> list[np.ndarray]:
        return [self.w, self.r, self.b, self.v, self.c, self.u, self.d]


def fresh_net(seed: int = SEED) -> Net:
    g = np.random.default_rng(seed)
    f = lambda *shape, s: (g.normal(size=shape) * s).astype(np.float32)
    zero = lambda n: np.zeros(n, np.float32)
    return Net(f(CHUNK, 256, FILTERS, s=0.15), f(FILTERS, s=0.5), zero(FILTERS), f(SPAN * FILTERS, SECOND, s=0.15), zero(SECOND), f(SECOND, s=0.3), zero(1))


def buffers(texts: Sequence[bytes], most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, document of each slot, its first second-layer place, its end) by buffers; long texts take several slots."""
    slots: list[tuple[int, int, int, int]] = []
    size = 0

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        buf, at, first, end = np.zeros(size + 2 * PAD, np.uint8), PAD, [], []
        for i, lo, hi, skip in slots:
            buf[at : at + hi - lo] = np.frombuffer(texts[i], np.uint8, hi - lo, lo)
            places = max(1, -(-(min(hi, lo + skip + PIECE) - lo) // EACH))
            first.append(at // EACH + skip // EACH)
            end.append(at // EACH + max(places, skip // EACH + 1))
            at += _room(hi - lo)
        return buf, np.array([s[0] for s in slots]), np.array(first), np.array(end)

    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t)), PIECE):
            lo = max(0, a - 3 * EACH)
            hi = min(len(t), a + PIECE + PAD)
            if slots and size + _room(hi - lo) > most:
                yield made()
                slots, size = [], 0
            slots.append((i, lo, hi, a - lo))
            size += _room(hi - lo)
    if slots:
        yield made()


def _room(n: int) -> int:
    return -(-n // EACH) * EACH + PAD


def repeats(buf: np.ndarray) -> np.ndarray:
    """For each STEP bytes how many begin 4 bytes that also begin up to LAGS bytes before."""
    g = np.ndarray((len(buf) - 3,), dtype="<u4", buffer=buf, strides=(1,)).copy()
    again = np.zeros(len(buf), bool)
    for lag in range(1, LAGS + 1):
        again[lag : len(g)] |= g[lag:] == g[:-lag]
    again[: len(g)] &= g != 0
    return again[: len(buf) // STEP * STEP].reshape(-1, STEP).sum(axis=1).astype(np.float32)


def first_layer(net: Net, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(outputs, repeat counts) of all chunks of a buffer."""
    n = (len(buf) - CHUNK) // STEP + 1
    out = np.empty((n, FILTERS), np.float32)
    out[:] = net.b
    for k in range(CHUNK):
        out += net.w[k].take(buf[k::STEP][:n], axis=0)
    r = repeats(buf)
    count = (r[:n] + np.append(r[1:], 0)[:n]) / CHUNK
    out += count[:, None] * net.r
    np.maximum(out, 0, out=out)
    return out, count


def second_layer(net: Net, one: np.ndarray) -> np.ndarray:
    n = (len(one) - SPAN) // STRIDE + 1
    wide = np.lib.stride_tricks.as_strided(one, (n, SPAN * FILTERS), (one.strides[0] * STRIDE, one.strides[1]))
    return np.maximum(wide @ net.v + net.c, 0)


def pooled(net: Net, texts: Sequence[bytes]) -> np.ndarray:
    """(documents, SECOND) maxima over whole texts."""
    out = np.zeros((len(texts), SECOND), np.float32)
    for buf, doc, first, end in buffers(texts):
        two = second_layer(net, first_layer(net, buf)[0])
        cuts = np.stack([first, np.minimum(end, len(two) - 1)], axis=1).ravel()
        np.maximum.at(out, doc, np.maximum.reduceat(two, cuts, axis=0)[::2])
    return out


def scores(net: Net, texts: Sequence[bytes]) -> np.ndarray:
    z = pooled(net, texts).astype(np.float64) @ net.u.astype(np.float64) + float(net.d[0])
    return np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 6)  # what stands beside a text in a batch moves the last digits of a sum


def _gradients(net: Net, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss; a maximum passes its gradient to the place that gave it."""
    best, some = np.zeros((len(texts), SECOND), np.float32), np.zeros((len(texts), SECOND), bool)
    wide = np.zeros((len(texts), SECOND, SPAN, FILTERS), np.float32)  # what the place that gave it saw of the first layer, and its bytes and repeat counts
    seen, again = np.zeros((len(texts), SECOND, FIELD), np.uint8), np.zeros((len(texts), SECOND, SPAN), np.float32)
    for buf, doc, first, end in buffers(texts):
        one, count = first_layer(net, buf)
        two = second_layer(net, one)
        for i, a, b in zip(doc, first, end, strict=True):
            at = a + two[a:b].argmax(axis=0)
            top = two[at, np.arange(SECOND)]
            g = np.flatnonzero((top > best[i]) | ~some[i])
            best[i, g], some[i, g] = top[g], True
            chunks = at[g][:, None] * STRIDE + np.arange(SPAN)
            wide[i, g], again[i, g] = one[chunks], count[chunks]
            seen[i, g] = buf[at[g][:, None] * EACH + np.arange(FIELD)]
    p = 1 / (1 + np.exp(-(best @ net.u + net.d)))
    dz = ((p - y) / len(y)).astype(np.float32)
    i, g = np.nonzero(best > 0)
    d2 = dz[i] * net.u[g]
    wide, seen, again = wide[i, g], seen[i, g], again[i, g]
    dv, dc = np.zeros_like(net.v), np.bincount(g, d2, SECOND).astype(np.float32)
    np.add.at(dv.T, g, wide.reshape(len(i), -1) * d2[:, None])
    d1 = (net.v.T[g] * d2[:, None]).reshape(len(i), SPAN, FILTERS) * (wide > 0)
    dw = np.zeros_like(net.w)
    for s in range(SPAN):
        for k in range(CHUNK):
            np.add.at(dw[k], seen[:, s * STEP + k], d1[:, s])
    return [dw, (d1 * again[:, :, None]).sum(axis=(0, 1)), d1.sum(axis=(0, 1)), dv, dc, best.T @ dz, np.array([dz.sum()], np.float32)]


def fit(texts: Sequence[bytes], labels: Sequence[int], epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """A network fitted by Adam; the same rows in the same order give the same network."""
    net, g = fresh_net(seed), np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    m = [np.zeros_like(x) for x in net.parts()]
    s = [np.zeros_like(x) for x in net.parts()]
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(texts) // BATCH)))
    step, total = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = g.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            step += 1
            rate = RATE * min(1.0, 2.0 * (1 - step / (total + 1))) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for x, dx, mi, si in zip(net.parts(), _gradients(net, [texts[i] for i in own], y[own]), m, s, strict=True):
                dx = dx + DECAY * x
                mi += 0.1 * (dx - mi)
                si += 0.001 * (dx * dx - si)
                x -= rate * mi / (np.sqrt(si) + 1e-8)
    return net


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> Net | float:
    """A network from the labelled rows that are not held out, or a constant where a class is missing."""
    marked = labels.filter("quality IN (0, 1)").select("doc_id", "quality").filter(fold(F.col("doc_id")) != 0).distinct()
    turn = F.xxhash64("doc_id", F.lit(SEED))
    chosen = marked.filter("quality = 0").orderBy(turn, "doc_id").limit(rows).union(marked.filter("quality = 1").orderBy(turn, "doc_id").limit(rows))
    # at most twice TRAIN_ROWS keys, so they may go to every task
    text = F.coalesce(docs["text"], F.lit(""))
    own = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    own = own.filter(F.octet_length("text") <= most // 16)  # a text that would leave no room for others is no example
    up_to = F.sum(F.octet_length("text")).over(W.orderBy(turn, "doc_id", "quality"))  # over the chosen rows
    own = own.withColumn("up_to", up_to).filter(F.col("up_to") <= most).collect()
    own.sort(key=lambda x: (x.doc_id, x.quality))
    y = [x.quality for x in own]
    if len(set(y)) < 2:
        return (sum(y) + 1) / (len(y) + 2)
    return fit([x.text.encode() for x in own], y)


def _score(batches: Iterator[pa.RecordBatch], net: Net | float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        got = np.full(len(texts), net) if isinstance(net, float) else scores(net, texts)
        yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(got, pa.float64()), pa.array((got >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    net = train(docs, labels)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (fold(docs["doc_id"]) == 0).alias("held_out"), "text")
    return rows.mapInArrow(lambda it: _score(it, net), "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score reaches the threshold."""
    net = train(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            got = np.full(len(texts), net) if isinstance(net, float) else scores(net, texts)
            yield batch.filter(pa.array(got >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
