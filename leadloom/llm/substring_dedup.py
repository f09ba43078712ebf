"""Removal of repeated byte strings by suffix sorting.

Every byte covered by a string of WINDOW bytes that also starts in a document with a
smaller id is removed; strings are judged on the input. Matches never cross documents.

1. Anchors (see ``anchors``) are found in every whole text. Equal windows share their
   least gram, so only documents that share an anchor can match there. What an anchor
   serves is its context of CONTEXT bytes. Copies of one context in one batch are
   settled there: all but the smallest id are removed, one goes on.
2. Anchors are shuffled, packed, by gram. Equal contexts of different batches are
   settled; where a gram has several contexts, their bytes are asked for.
3. Those contexts are cut from the texts (joined by row) and shuffled by gram. In each
   shard the suffixes that start at the anchors, and the reversed prefixes that end
   there, are put in order by deep-shallow sorting. A window that starts l bytes before
   an anchor is a group of suffixes with WINDOW - l bytes in common whose prefixes have
   l in common; all but the smallest id of each group are removed.
4. What is removed is gathered by row and applied to the text.

Anchors of one document with equal contexts at equal distances are one row (first place, step,
how many more), so a run of one byte, or of any short period, is a few rows however long it is, and
so are its contexts. What is found for the first place holds for all of them.

Grams that COMMON_LEAST documents of a sample of one in SAMPLE hold (about 6,400 of all;
of those the COMMON_MOST most frequent, so the list is bounded) are spread: step 2 by whole
context, step 3 by window, on 88 bits of hash of its bytes. The limit is a number, not a
share, so a shard's work at one gram does not grow with the corpus. The sample decides only
which way a gram goes, not what is found. Shards grow in number with the bytes of input.

Equal contexts are told by their gram (48 bits) and a hash of all 64 bits, mixed
otherwise; m contexts at one gram give about m^2 / 2^65 false copies, m windows of common
grams about m^2 / 2^89.

Null texts are empty. Rows without id are left as they are and are no source. Rows of
one id never match one another; rows that repeat id and text get equal results. Texts
under WINDOW bytes have nothing to remove. Long texts are searched in pieces that overlap by
more than a context; a text and its marks (some 12 bytes a byte) are held by one task.
An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import CONTEXT, NEVER, SPREAD, WINDOW, anchors, buffers, gram_hashes, hash_at, mix, words
from .common import durable
from .suffix_sort import deep_shallow

SHARD_BYTES = 4 << 20
SAMPLE, COMMON_LEAST, COMMON_MOST = 64, 100, 1_000_000
ALL = (1 << (SPREAD + 1)) - 1

_PACKED = "shard int, kind int, blob binary"
_ASKED = "key long, id long, full array<int>, want array<int>"
_MASKS = "key long, id long, full array<int>, at array<int>, mask array<long>"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _planes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of each number, byte by byte, so that high zeros compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _numbers(blob: memoryview, n: int, count: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = np.frombuffer(blob, np.uint8, n * count).reshape(n, count).T
    return out.view("<u8").ravel()


KEY_BYTES = 5


def pack(docs: np.ndarray, place: np.ndarray, fields: list[tuple[np.ndarray, int]], extra: bytes = b"") -> bytes:
    """docs: a table of (row key, id); place: each row's place in it; fields: numbers and the bytes that each is given.

    Only the documents that occur are kept. Numbers go byte by byte, so ids that lie
    close together and small positions compress.
    """
    own, at = np.unique(place, return_inverse=True)
    head = np.array([len(place), len(own)], "<i8").tobytes()
    table = _planes(docs[own, 0], KEY_BYTES) + _planes(docs[own, 1], 8)
    return b"".join([head, table, _planes(at, 4), *[_planes(x, n) for x, n in fields], extra])


def unpack(blob: bytes, widths: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray], memoryview]:
    v = memoryview(blob)
    count, rows = (int(x) for x in np.frombuffer(v, "<i8", 2))
    at = 16
    table = []
    for n in (KEY_BYTES, 8):
        table.append(_numbers(v[at:], n, rows).astype("i8"))
        at += n * rows
    out = []
    for n in (4, *widths):
        out.append(_numbers(v[at:], n, count))
        at += n * count
    return np.stack(table, axis=1)[out[0].astype(np.int64)], out[1:], v[at:]


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of ordered keys begins."""
    out = np.ones(len(keys[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(x or "").encode() for x in batch.column("text").to_pylist()]


def _docs_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column("key").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False)], axis=1)


def _blobs(shard: np.ndarray, kind: int, docs: np.ndarray, place: np.ndarray, fields: list[tuple[np.ndarray, int]], wide: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes]]:
    """Packed rows of each shard, ordered by the first field; wide rows of bytes are compressed, as those of one gram are much alike."""
    o = np.lexsort((fields[0][0], shard))
    starts = np.append(np.flatnonzero(_firsts(shard[o])), len(o)) if len(o) else [0]
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        own = o[a:b]
        yield int(shard[own[0]]), kind, pack(docs, place[own], [(x[own], n) for x, n in fields], zstandard.compress(wide[own].tobytes(), 3) if wide is not None else b"")


def _progressions(same: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, step, more) of ordered positions; same tells which belong with the one before: those at one distance are one row."""
    gap = np.append(0, np.diff(pos))
    on = same & np.append(False, same[:-1]) & np.append(False, gap[1:] == gap[:-1])
    first = np.flatnonzero(~on)
    more = np.diff(np.append(first, len(pos))) - 1
    return first, np.where(more > 0, np.append(gap, 0)[first + 1], 0), more


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    s, k, b = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(s, pa.int32()), pa.array(k, pa.int32()), pa.array(b, pa.binary())], names=["shard", "kind", "blob"])


def _common(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    return np.isin(h, common) if len(common) else np.zeros(len(h), bool)


def _find(batches: Iterator[pa.RecordBatch], shards: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Step 1: packed anchors (kind 0) and those already settled (kind 1)."""
    for batch in batches:
        docs = _docs_of(batch)
        for buf, at, h, text, pos in anchors(_texts(batch)):
            h = h >> np.uint64(16)
            c = hash_at(words(buf), at - SPREAD, CONTEXT)
            ids = docs[text, 1]
            o = np.lexsort((pos, text, ids, c, h))
            h, c, text, ids, pos = h[o], c[o], text[o], ids[o], pos[o]
            new = _firsts(h, c)
            least = ids[np.flatnonzero(new)][np.cumsum(new) - 1] if len(new) else ids
            first, step, more = _progressions(~_firsts(h, c, text), pos) if len(h) else (new.nonzero()[0], pos, pos)
            h, c, text, pos, done = h[first], c[first], text[first], pos[first], (ids > least)[first]
            key = np.where(_common(h, common), mix(h ^ mix(c)), mix(h))
            shard = (key % np.uint64(shards)).astype(np.int64)
            go = ~done
            rows = list(_blobs(shard[go], 0, docs, text[go], [(h[go], 6), (c[go], 8), (pos[go], 4), (step[go], 4), (more[go], 4)]))
            if done.any():
                rows += _blobs(np.full(int(done.sum()), int(shard[done][0])), 1, docs, text[done], [(pos[done], 4), (step[done], 4), (more[done], 4)])
            yield _batch(rows)


def _settle(table: pa.Table, common: np.ndarray) -> pa.Table:
    """Step 2: rows of ids with the anchors whose context is a copy, and those whose bytes are needed, as (first, step, more) each."""
    docs, h, c, runs = [np.empty((0, 2), "i8")], [np.empty(0, "u8")], [np.empty(0, "u8")], [np.empty((0, 3), "i8")]
    done_docs, done_runs = [np.empty((0, 2), "i8")], [np.empty((0, 3), "i8")]
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
        if kind:
            d, run, _ = unpack(blob, (4, 4, 4))
            done_docs.append(d)
            done_runs.append(np.stack(run, axis=1).astype("i8"))
        else:
            d, (a, b, *run), _ = unpack(blob, (6, 8, 4, 4, 4))
            for to, x in ((docs, d), (h, a), (c, b), (runs, np.stack(run, axis=1).astype("i8"))):
                to.append(x)
    docs, h, c, runs = map(np.concatenate, (docs, h, c, runs))
    o = np.lexsort((docs[:, 1], c, h))
    docs, h, c, runs = docs[o], h[o], c[o], runs[o]
    new = _firsts(h, c) if len(h) else np.zeros(0, bool)
    least = docs[np.flatnonzero(new), 1][np.cumsum(new) - 1] if len(h) else docs[:, 1]
    full = docs[:, 1] > least
    gram = _firsts(h) if len(h) else new
    starts = np.flatnonzero(gram)
    want = np.zeros(len(h), bool)
    if len(h):
        kinds = np.add.reduceat(new.astype("i8"), starts)
        low, high = np.minimum.reduceat(least, starts), np.maximum.reduceat(least, starts)
        want = ~full & (((kinds > 1) & (low < high))[np.cumsum(gram) - 1] | _common(h, common))
    docs = np.concatenate([docs[full], docs[want], *done_docs])
    runs = np.concatenate([runs[full], runs[want], *done_runs]).astype(np.int32)
    wanted = np.zeros(len(runs), bool)
    wanted[int(full.sum()) : int(full.sum()) + int(want.sum())] = True
    o = np.lexsort((docs[:, 0], docs[:, 1]))
    docs, runs, wanted = docs[o], runs[o], wanted[o]
    at = np.flatnonzero(_firsts(docs[:, 0], docs[:, 1])) if len(o) else np.empty(0, "i8")

    def lists(own: np.ndarray) -> pa.Array:
        before = 3 * np.append(0, np.cumsum(own))
        return pa.ListArray.from_arrays(pa.array(np.append(before[at], before[-1]).astype(np.int32)), pa.array(runs[own].ravel()))

    return pa.table([pa.array(docs[at, 0]), pa.array(docs[at, 1]), lists(~wanted), lists(wanted)], names=["key", "id", "full", "want"])


def _cut(batches: Iterator[pa.RecordBatch], shards: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Step 3a: contexts of the anchors asked for (kind 2); windows of common grams (kind 3)."""
    back = np.arange(SPREAD + 1)
    for batch in batches:
        docs, texts = _docs_of(batch), _texts(batch)
        asked = [np.unique(x.values.to_numpy().astype(np.int64).reshape(-1, 3), axis=0) for x in batch.column("want")]
        for buf, pieces in buffers(texts):
            at, text, runs = [], [], []
            for i, place, lo, _, a, b in pieces:
                p = asked[i][(asked[i][:, 0] >= a) & (asked[i][:, 0] < b)]
                at.append(p[:, 0] - lo + place)
                text.append(np.full(len(p), i))
                runs.append(p)
            at, text, runs = map(np.concatenate, (at, text, runs))
            pos, step, more_of = runs.T
            if not len(at):
                continue
            w = words(buf)
            h = gram_hashes_at(buf, at)
            rows = []
            hot = _common(h, common)
            if not hot.all():
                cold = ~hot
                ctx = np.lib.stride_tricks.sliding_window_view(buf, CONTEXT)[at[cold] - SPREAD]
                rows += _blobs((mix(h[cold]) % np.uint64(shards)).astype("i8"), 2, docs, text[cold], [(h[cold], 6), (pos[cold], 4), (step[cold], 4), (more_of[cold], 4)], ctx)
            if hot.any():
                n = np.array([len(t) for t in texts])[text[hot]]
                start = pos[hot][:, None] - back
                e, l = np.nonzero((start >= 0) & (start + WINDOW <= n[:, None]))
                window = hash_at(w, at[hot][e] - back[l], WINDOW, 7)
                more = hash_at(w, at[hot][e] - back[l], WINDOW, 8) >> np.uint64(40)
                who, run = text[hot][e], runs[hot][e]
                o = np.lexsort((docs[who, 1], more, window))
                window, more, who, run, l = window[o], more[o], who[o], run[o], l[o]
                new = _firsts(window, more)
                least = docs[who[np.flatnonzero(new)], 1][np.cumsum(new) - 1]
                mine = (mix(window) % np.uint64(shards)).astype("i8")
                later = docs[who, 1] > least
                for kind, own_rows in ((3, ~later), (4, later)):
                    if own_rows.any():
                        fields = [(x, 4) for x in run[own_rows].T] + [(l[own_rows], 1)]
                        fields = [(window[own_rows], 8), (more[own_rows], 3), *fields] if kind == 3 else fields
                        rows += _blobs(mine[own_rows], kind, docs, who[own_rows], fields)
            yield _batch(rows)


def gram_hashes_at(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What ``gram_hashes`` has at these places, cut to 48 bits."""
    grams = np.lib.stride_tricks.sliding_window_view(buf, 32)[at]
    return gram_hashes(np.ascontiguousarray(grams).ravel())[::32] >> np.uint64(16) if len(at) else np.empty(0, "u8")


def window_groups(gram: np.ndarray, ids: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """For each context a mask of the l for which the window l bytes before its anchor starts in a smaller id too."""
    m = len(ids)
    right, left = contexts[:, SPREAD:], contexts[:, SPREAD - 1 :: -1]
    (ro, rc), (lo, lc) = deep_shallow(gram, right), deep_shallow(gram, left)
    room_right = np.where((right == NEVER).any(axis=1), (right == NEVER).argmax(axis=1), WINDOW)
    room_left = np.where((left == NEVER).any(axis=1), (left == NEVER).argmax(axis=1), SPREAD)
    mask = np.zeros(m, np.int64)
    r_id, l_id = np.empty(m, np.int64), np.empty(m, np.int64)
    for l in range(SPREAD + 1):
        own = np.flatnonzero((room_left >= l) & (room_right >= WINDOW - l))
        if not len(own):
            continue
        r_id[ro], l_id[lo] = np.cumsum(rc < WINDOW - l), np.cumsum(lc < l)
        pair = r_id[own] * (m + 1) + l_id[own]
        o = np.argsort(pair, kind="stable")
        starts = np.flatnonzero(_firsts(pair[o]))
        least = np.minimum.reduceat(ids[own][o], starts)
        size = np.diff(np.append(starts, len(o)))
        later = np.empty(len(own), bool)
        later[o] = ids[own][o] > np.repeat(least, size)
        mask[own[later]] |= np.int64(1) << l
    return mask


def _sort(table: pa.Table) -> pa.Table:
    """Step 3b: masks of the windows of each anchor that start in a smaller id too."""
    docs, h, runs, ctx = [np.empty((0, 2), "i8")], [np.empty(0, "u8")], [np.empty((0, 3), "i8")], [np.empty((0, CONTEXT), np.uint8)]
    wd, wh, wm, wr, wl = [np.empty((0, 2), "i8")], [np.empty(0, "u8")], [np.empty(0, "u8")], [np.empty((0, 3), "i8")], [np.empty(0, "u8")]
    done = []
    together = lambda run: np.stack(run, axis=1).astype("i8")
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
        if kind == 2:
            d, (a, *run), rest = unpack(blob, (6, 4, 4, 4))
            for to, x in ((docs, d), (h, a), (runs, together(run)), (ctx, np.frombuffer(zstandard.decompress(rest), np.uint8).reshape(-1, CONTEXT))):
                to.append(x)
        elif kind == 3:
            d, (a, b, *run, l), _ = unpack(blob, (8, 3, 4, 4, 4, 1))
            for to, x in zip((wd, wh, wm, wr, wl), (d, a, b, together(run), l), strict=True):
                to.append(x)
        else:
            d, (*run, l), _ = unpack(blob, (4, 4, 4, 1))
            done.append((d, together(run), np.int64(1) << l.astype("i8")))
    docs, h, runs, ctx = map(np.concatenate, (docs, h, runs, ctx))
    found = window_groups(h, docs[:, 1], ctx) if len(h) else np.empty(0, "i8")
    wd, wh, wm, wr, wl = map(np.concatenate, (wd, wh, wm, wr, wl))
    if len(wh):
        o = np.lexsort((wd[:, 1], wm, wh))
        new = _firsts(wh[o], wm[o])
        later = o[wd[o, 1] > wd[o[np.flatnonzero(new)], 1][np.cumsum(new) - 1]]
        done.append((wd[later], wr[later], np.int64(1) << wl[later].astype("i8")))
    some = found != 0
    done.append((docs[some], runs[some], found[some]))
    docs, runs, mask = (np.concatenate(x) for x in zip(*done, strict=True))
    o = np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0], docs[:, 0], docs[:, 1]))
    docs, runs, mask = docs[o], runs[o], mask[o]
    if len(runs):  # one mask for each row of anchors
        starts = np.flatnonzero(_firsts(docs[:, 0], docs[:, 1], *runs.T))
        docs, runs, mask = docs[starts], runs[starts], np.bitwise_or.reduceat(mask, starts)
    first = np.flatnonzero(_firsts(docs[:, 0], docs[:, 1])) if len(runs) else np.empty(0, "i8")
    ends = np.append(first, len(runs)).astype(np.int32)
    empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(first) + 1, np.int32)), pa.array([], pa.int32()))
    lists = [pa.ListArray.from_arrays(pa.array(3 * ends), pa.array(runs.astype(np.int32).ravel())), pa.ListArray.from_arrays(pa.array(ends), pa.array(mask.astype("i8")))]
    return pa.table([pa.array(docs[first, 0]), pa.array(docs[first, 1]), empty, *lists], names=["key", "id", "full", "at", "mask"])


def _marked(n: int, full: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which places of a text of n bytes begin a window to remove, from rows (first, step, more) of anchors."""
    hit = np.zeros(n - WINDOW + 1, bool)
    single = (full[:, 2] == 0) | (full[:, 1] <= SPREAD + 1)  # the windows of close anchors touch
    if single.any():
        change = np.zeros(n - WINDOW + 2, np.int32)
        last = full[single, 0] + full[single, 1] * full[single, 2]
        np.add.at(change, np.maximum(full[single, 0] - SPREAD, 0), 1)
        np.add.at(change, np.minimum(last, n - WINDOW) + 1, -1)
        hit |= np.cumsum(change, out=change)[:-1] > 0
    for first, step, more in full[~single]:
        for back in range(SPREAD + 1):
            own = np.arange(first, first + step * more + 1, step) - back
            hit[own[(own >= 0) & (own < len(hit))]] = True
    alone = at[:, 2] == 0
    e, l = np.nonzero((mask[alone][:, None] >> np.arange(SPREAD + 1)) & 1)
    hit[at[alone, 0][e] - l] = True
    for (first, step, more), bits in zip(at[~alone], mask[~alone], strict=True):
        for back in np.flatnonzero((bits >> np.arange(SPREAD + 1)) & 1):
            hit[first - back : first - back + step * more + 1 : step] = True
    return hit


def removed_spans(n: int, full: np.ndarray, at: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes to remove from a text of n bytes."""
    full, at = full.reshape(-1, 3), at.reshape(-1, 3)
    if n < WINDOW or not len(full) + len(at):
        return []
    hit = np.flatnonzero(np.diff(_marked(n, full, at, mask).view(np.int8), prepend=0, append=0))
    lo, hi = hit[::2], hit[1::2] - 1 + WINDOW  # windows that begin one after the other
    cut = np.flatnonzero(lo[1:] > hi[:-1])  # runs that touch are one
    return list(zip(lo[np.append(0, cut + 1)].tolist(), hi[np.append(cut, len(hi) - 1)].tolist(), strict=True)) if len(lo) else []


def _apply(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Step 4."""
    for batch in batches:
        out: list[tuple] = []
        lists = [batch.column(c) for c in ("full", "at", "mask")]
        for t, doc_id, *found in zip(_texts(batch), batch.column("doc_id").to_pylist(), *lists, strict=True):
            spans = removed_spans(len(t), *(np.zeros(0, np.int64) if x.values is None else x.values.to_numpy().astype(np.int64) for x in found))
            ends = [0, *[b for _, b in spans]]
            left = b"".join(t[a:b] for a, b in zip(ends, [*[a for a, _ in spans], len(t)], strict=True))
            out.append((doc_id, len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left, [x for s in spans for x in s]))
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.int64())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        keep = 7 if with_text else 5
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][:keep], names=names[:keep])


def common_grams(docs: DataFrame, least: int = COMMON_LEAST, most: int = COMMON_MOST) -> np.ndarray:
    """Grams that anchor at least ``least`` documents of a sample, the ``most`` most frequent."""
    sample = docs.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SAMPLE)) == 0)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, text, _ in anchors(_texts(batch)):
                pairs = np.unique(np.stack([(h >> np.uint64(16)).astype("i8"), text], axis=1), axis=0)
                yield pa.record_batch([pa.array(pairs[:, 0])], names=["h"])

    counts = sample.mapInArrow(grams, "h long").groupBy("h").count().filter(F.col("count") >= least)
    rows = counts.orderBy(F.desc("count"), "h").limit(most).select("h").collect()
    return np.sort(np.array([r.h for r in rows], "u8"))


def remove_repeats(documents: DataFrame, with_text: bool = False, common: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with_text: also the bytes kept and the spans (start, end, ...)."""
    text = F.coalesce(documents["text"], F.lit(""))
    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2 ** (8 * KEY_BYTES) - 1)))
    docs = keyed.filter("doc_id IS NOT NULL").select("key", F.col("doc_id").alias("id"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(12, total // SHARD_BYTES)
    if common is None:
        common = common_grams(docs)
    found = docs.mapInArrow(lambda it: _find(it, shards, common), _PACKED)
    asked = durable(found.groupBy("shard").applyInArrow(lambda t: _settle(t, common), _ASKED), "repeats")
    by_row = lambda c: F.flatten(F.collect_list(c)).alias(c)
    row = ["key", "id"]  # the key only tells apart rows that share an id
    want = asked.filter(F.size("want") > 0).groupBy(*row).agg(by_row("want"))
    source = keyed.select("key", F.col("doc_id").alias("id"), "text")
    # a left join first, so that both joins with the texts can read one shuffle of them
    cut = source.join(want, row, "left").filter("want IS NOT NULL").select(*row, "text", "want").mapInArrow(lambda it: _cut(it, shards, common), _PACKED)
    masks = cut.groupBy("shard").applyInArrow(_sort, _MASKS)
    nothing = [F.array().cast("array<int>").alias("at"), F.array().cast("array<long>").alias("mask")]
    both = asked.filter(F.size("full") > 0).select(*row, "full", *nothing).unionByName(masks)
    removed = both.groupBy(*row).agg(by_row("full"), by_row("at"), by_row("mask"))
    out = source.join(removed, row, "left").select(F.col("id").alias("doc_id"), "text", "full", "at", "mask")
    return out.mapInArrow(lambda it: _apply(it, with_text), _RESULT + (", kept binary, spans array<long>" if with_text else ""))
