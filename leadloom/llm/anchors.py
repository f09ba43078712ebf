"""Content anchors: positions that any two equal windows of bytes choose alike.

A position is an anchor where the hash of its GRAM bytes is least among the grams of
some window of WINDOW bytes. Equal windows hold equal grams, so they have the same least
gram at the same offset: two equal windows always share an anchor, whatever else their
documents hold. About two positions in WINDOW - GRAM + 2 are anchors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

WINDOW, GRAM = 50, 16
SPREAD = WINDOW - GRAM  # an anchor serves windows that start up to so many bytes before it
CONTEXT = SPREAD + WINDOW  # bytes that hold all windows that an anchor serves
PIECE = 1 << 20
GAP = CONTEXT + 16  # bytes between documents in a buffer
NEVER = 0xFF  # no byte of UTF-8

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte on, as big-endian numbers; a view."""
    return np.ndarray((len(buf) - 7,), dtype=">u8", buffer=buf, strides=(1,))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def hash_at(w: np.ndarray, at: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of n bytes (8 at least) from each place."""
    out = np.full(len(at), seed * 2 + 1, np.uint64)
    for i in [*range(0, n - 8, 8), n - 8]:
        out = mix(out * _M1 + w[at + i].astype(np.uint64) * _M3 + _M2)
    return out


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each place on, for all places that have GAP bytes after them."""
    w = words(buf)[: len(buf) - GRAM + 1].astype(np.uint64)
    h = w[:-8] * _M1
    h ^= h >> np.uint64(31)
    h += w[8:] * _M3
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def _slide(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over x[i : i + n] for each i that has n."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


def buffers(texts: Sequence[bytes], most: int = 2 * PIECE) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int, int, int]]]]:
    """Buffers with the pieces that they hold: (text, place in buffer, first byte, end, own first, own end).

    A long text comes in pieces that overlap by more than what its anchors see.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    size = 0

    def made() -> tuple[np.ndarray, list]:
        buf, at, out = np.full(size + 2 * GAP, NEVER, np.uint8), GAP, []
        for i, lo, hi, a, b in pieces:
            buf[at : at + hi - lo] = np.frombuffer(texts[i], np.uint8, hi - lo, lo)
            out.append((i, at, lo, hi, a, b))
            at += hi - lo + GAP
        return buf, out

    for i, t in enumerate(texts):
        if len(t) < WINDOW:
            continue
        for a in range(0, len(t), PIECE):
            b = min(len(t), a + PIECE)
            lo, hi = max(0, a - 2 * CONTEXT), min(len(t), b + 2 * CONTEXT)
            if pieces and size + hi - lo > most:
                yield made()
                pieces, size = [], 0
            pieces.append((i, lo, hi, a, b))
            size += hi - lo + GAP
    if pieces:
        yield made()


def anchors(texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(buffer, places in it, gram hashes, text numbers, positions in the text) of the anchors, by buffers."""
    for buf, pieces in buffers(texts):
        h = gram_hashes(buf)
        valid = np.zeros(len(h), bool)  # starts of windows
        text, shift = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        starts = np.array([p[1] for p in pieces])
        own = np.zeros(len(h), bool)
        for j, (i, at, lo, hi, a, b) in enumerate(pieces):
            valid[at : at + hi - lo - WINDOW + 1] = True
            own[at + a - lo : at + b - lo] = True
            text[j], shift[j] = i, lo - at
        least = _slide(h, SPREAD + 1, np.minimum)
        least[~valid[: len(least)]] = 0
        most = _slide(least, SPREAD + 1, np.maximum)  # over the windows that start SPREAD places on, up to the place itself
        chosen = np.zeros(len(h), bool)
        chosen[SPREAD : SPREAD + len(most)] = most == h[SPREAD : SPREAD + len(most)]
        at = np.flatnonzero(chosen & own)
        j = np.searchsorted(starts, at, side="right") - 1
        yield buf, at, h[at], text[j], at + shift[j]
