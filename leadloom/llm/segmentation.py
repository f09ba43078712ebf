"""SentencePiece encoding and decoding with segmentations sampled without replacement.

The lattice of a text has an edge for every vocabulary piece that fits and, where no
piece covers a character, one of byte pieces. No piece crosses the start of a run of
``▁`` or a line feed, so the lattice is a chain of small ones, and one is built for each
distinct chunk (an array trie finds its edges, a backward pass the total weight from
each place on). Chunks are told apart by hashes and compared with what they are taken
for; their lattices serve later texts until they hold KEPT characters. An edge's
conditional log probability is then its own plus the weight after it less the weight
before it.

Segmentations come out by a perturbed A* search. The agenda of a text is a heap of
regions, ordered by their perturbed bounds: a region's log mass plus Gumbel noise,
conditioned to lie below the bound of the region it was split from. The lattice's own
masses are the heuristic, so a bound is attained and regions leave the heap in the order
of the keys of the best segmentation in each. Regions are

* what parts from a found segmentation inside one chunk, at any place of it: when such a
  region is opened, it is split into its branches, of which one keeps its bound;
* one branch: the found segmentation up to a place, then another edge. When it is opened,
  its best segmentation is drawn edge by edge and comes out with the bound as its key,
  and what parts from that one later, chunk by chunk, joins the agenda.

So the first k are a sample of k without replacement, with keys in order, and the next
bound on the agenda is the threshold for their inclusion scores,
1 - exp(-exp(log probability - threshold)). Of the regions of one split only those that
can still be among the first k are put on the heap. Noise is a hash of the row's key,
sample, chunk and place, so results do not depend on batches or partitions.

The scores of a BPE model are ranks of merges; its pieces weigh as words do in text,
1 / (rank + RANK_SHIFT). Those of a unigram model (by_rank=False) keep their scores.
Pieces that never merge and byte pieces weigh least.

A literal ``▁`` is encoded as bytes, so decoding gives back every text exactly. Empty and
null texts have one segmentation, without pieces, of log probability 0; texts with
fewer than k segmentations give all they have. Rows of equal id draw equal noise. Null
ids draw the noise of a null. An empty table gives no rows. Columns other than doc_id
and text are ignored, whatever their names. A text is worked on as a whole, with some
hundred bytes of memory for each of its characters.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import _M1, _M2, _M3, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED = 2, 7
RANK_SHIFT = 10.0
SPACE, LITERAL = "▁", "\ud800"  # a lone surrogate stands for a literal ▁: no text holds one
LONG = 64
BLOCK = 1 << 19  # characters that are worked on at once
KEPT = 1 << 19  # characters of chunks whose lattices are kept


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    return ((key.astype(np.uint64) * _M1) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


@dataclass
class Vocabulary:
    """Pieces as an array trie; small enough (by the model's size) to go to every task."""

    raw: list[bytes]  # what a piece decodes to
    log_p: np.ndarray
    byte_ids: np.ndarray  # of the 256 byte pieces
    alphabet: np.ndarray
    steps: np.ndarray  # state * len(alphabet) + letter, by slot of a hash table; -1 where it is free
    to: np.ndarray
    piece_at: np.ndarray  # of a state, or -1

    def __post_init__(self) -> None:
        self.ends = np.cumsum([len(x) for x in self.raw])
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states after a letter, -1 where there is none."""
        key = state * len(self.alphabet) + letter
        slot = _slot(key, len(self.steps))
        out = np.where(self.steps[slot] == key, self.to[slot], -1)
        more = np.flatnonzero((out < 0) & (self.steps[slot] >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) % len(self.steps)
            there = self.steps[slot[more]]
            hit = there == key[more]
            out[more[hit]] = self.to[slot[more[hit]]]
            more = more[~hit & (there >= 0)]
        out[letter < 0] = -1
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids, as it was before the leading space was put in front."""
        n = np.diff(self.ends, prepend=0)[ids]
        return self.flat[_ranges(self.ends[ids] - n, n)].tobytes()[1:]


def load(path: str = MODEL, by_rank: bool = True) -> Vocabulary:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.vocab_size()
    pieces, score = [p.id_to_piece(i) for i in range(n)], np.array([p.get_score(i) for i in range(n)])
    is_byte = np.array([p.is_byte(i) for i in range(n)])
    plain = np.array([not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) for i in range(n)])
    for i in np.flatnonzero(plain):
        if SPACE in pieces[i].lstrip(SPACE) or ("\n" in pieces[i] and pieces[i] != "\n"):
            plain[i] = False  # would cross the places at which texts are cut
    if is_byte.sum() != 256:
        raise ValueError("the model must have byte pieces")
    if by_rank:
        w = -np.log(np.where(plain & (score > -1e8), -score, n) + RANK_SHIFT)
    else:
        w = np.where(plain & (score > -1e8), score, score[plain & (score > -1e8)].min() - 10)
    w = w - np.logaddexp.reduce(w[plain | is_byte])
    raw = [bytes([int(x[1:-1], 16)]) if b else x.replace(SPACE, " ").encode() if ok else b"" for x, b, ok in zip(pieces, is_byte, plain, strict=True)]
    alphabet = np.array(sorted({ord(c) for i in np.flatnonzero(plain) for c in pieces[i]}), np.int64)
    letter = {int(c): j for j, c in enumerate(alphabet)}
    trie, ends = {}, [-1]
    for i in np.flatnonzero(plain):
        s = 0
        for c in pieces[i]:
            s = trie.setdefault((s, letter[ord(c)]), len(trie) + 1)
            if s == len(ends):
                ends.append(-1)
        ends[s] = int(i)
    steps = np.array([s * len(alphabet) + c for s, c in trie], np.int64)
    slots = 8 << len(trie).bit_length()
    table, to = np.full(slots, -1, np.int64), np.zeros(slots, np.int64)
    for x, slot, state in zip(steps.tolist(), _slot(steps, slots).tolist(), trie.values(), strict=True):
        while table[slot] >= 0:
            slot = (slot + 1) % slots
        table[slot], to[slot] = x, state
    byte_ids = np.empty(256, np.int64)
    byte_ids[[x[0] for x, b in zip(raw, is_byte, strict=True) if b]] = np.flatnonzero(is_byte)
    return Vocabulary(raw, w, byte_ids, alphabet, table, to, np.array(ends, np.int64))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Lattice:
    """Edges of distinct chunks, by place; places count through all chunks."""

    def __init__(self, v: Vocabulary, chars: np.ndarray, size: np.ndarray) -> None:
        self.chars = chars
        self.off = np.append(0, np.cumsum(size))
        n = len(chars)
        end = np.repeat(self.off[1:], size)
        letter = np.minimum(np.searchsorted(v.alphabet, chars), len(v.alphabet) - 1)
        letter[v.alphabet[letter] != chars] = -1
        at, state = np.arange(n), np.zeros(n, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            state = v.step(state, letter[at + len(found)])
            ok = state >= 0
            at, state = at[ok], state[ok]
            piece = v.piece_at[state]
            some = piece >= 0
            found.append((at[some], piece[some]))
            more = at + len(found) < end[at]
            at, state = at[more], state[more]
        covered = np.zeros(n, bool)
        if found:
            covered[found[0][0]] = True
        bare = np.flatnonzero(~covered)
        # a character without a piece: an edge numbered below zero, by its code, for its bytes
        codes, number = np.unique(chars[bare], return_inverse=True)
        w_bare = np.array([v.log_p[v.byte_ids[np.frombuffer(spelled(c), np.uint8)]].sum() for c in codes.tolist()])
        found = [*found, (np.empty(0, np.int64),) * 2] if not found else found
        degree = np.zeros(n, np.int64)
        for starts, _ in found:
            degree[starts] += 1
        degree[bare] += 1
        self.first = np.append(0, np.cumsum(degree))
        total = int(self.first[-1])
        self.length, self.piece, own, w = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total, np.int64), np.empty(total)
        free = self.first[:-1].copy()
        for length in range(len(found), 0, -1):  # long pieces, the likely ones, come first at a place
            starts, piece = found[length - 1]
            e = free[starts]
            self.length[e], self.piece[e], own[e], w[e] = length, piece, starts, v.log_p[piece]
            free[starts] += 1
        e = free[bare]
        self.length[e], self.piece[e], own[e] = 1, -1 - chars[bare], bare
        w[e] = w_bare[number] if len(bare) else 0
        target = own + self.length
        # after[x]: log of the total weight of all paths from x to the end of its chunk; ends are 0 where they are read
        beyond, left = np.zeros(n + 1), end - np.arange(n)
        beta = beyond[:-1]
        inner = target < end[own]
        by = np.argsort(np.minimum(left, LONG + 1).astype(np.uint8), kind="stable")
        cuts = np.cumsum(np.bincount(np.minimum(left, LONG + 1), minlength=LONG + 2))[: LONG + 1]
        for d in range(len(cuts) - 1):
            places = by[cuts[d] : cuts[d + 1]]
            if len(places):
                counts = degree[places]
                e = _ranges(self.first[places], counts)
                x = w[e] + beyond[target[e]] * inner[e]
                heads = np.cumsum(counts) - counts
                top = np.maximum.reduceat(x, heads)
                beta[places] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, counts)), heads))
        long = by[cuts[-1] :]
        for p in long[np.argsort(left[long])].tolist():  # the heads of long chunks, one by one
            xs = [w[e] + (beta[target[e]] if inner[e] else 0.0) for e in range(self.first[p], self.first[p + 1])]
            top = max(xs)
            beta[p] = top + math.log(sum(math.exp(x - top) for x in xs))
        self.cond = w + beyond[target] * inner - beta[own]
        # for each edge, what the edges of its place up to it weigh, and what all but it weigh
        p = np.exp(self.cond)
        self.up_to, self.rest = np.full(total, 2.0), np.zeros(total)  # the last edge of a place takes what is left
        for g in range(2, int(degree.max(initial=0)) + 1):
            e = self.first[:-1][degree == g][:, None] + np.arange(g)
            up, down = np.cumsum(p[e], axis=1), np.cumsum(p[e[:, ::-1]], axis=1)[:, ::-1]
            self.up_to[e[:, :-1]] = up[:, :-1]
            self.rest[e[:, 1:]] = up[:, :-1]
            self.rest[e[:, :-1]] += down[:, 1:]
        self.end = self.off[1:]

    def own(self, e: np.ndarray) -> np.ndarray:
        """The places at which edges start."""
        return np.searchsorted(self.first, e, side="right") - 1

    def only(self, chunks: np.ndarray) -> Lattice:
        """These chunks alone, in this order."""
        out = object.__new__(Lattice)
        size = self.off[chunks + 1] - self.off[chunks]
        places = _ranges(self.off[chunks], size)
        degree = self.first[places + 1] - self.first[places]
        edges = _ranges(self.first[places], degree)
        out.off, out.first, out.chars = np.append(0, np.cumsum(size)), np.append(0, np.cumsum(degree)), self.chars[places]
        out.end = out.off[1:]
        for name in ("length", "piece", "cond", "up_to", "rest"):
            setattr(out, name, getattr(self, name)[edges])
        return out

    def absorb(self, other: Lattice) -> None:
        """Put another lattice's chunks behind these."""
        n, e = len(self.chars), len(self.piece)
        for name in ("chars", "length", "piece", "cond", "up_to", "rest"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(other, name)]))
        self.off, self.first = np.concatenate([self.off, other.off[1:] + n]), np.concatenate([self.first, other.first[1:] + e])
        self.end = self.off[1:]


def spelled(code: int) -> bytes:
    """The bytes of a character of a chunk."""
    return (SPACE if code == ord(LITERAL) else " " if code == ord(SPACE) else chr(code)).encode()


class Book:
    """Lattices of the chunks met so far. Beyond ``kept`` characters those that one block alone had are forgotten."""

    def __init__(self, v: Vocabulary, kept: int = KEPT) -> None:
        self.v, self.kept, self.salt = v, kept, 0
        self._clear()

    def _clear(self) -> None:
        self.lattice = Lattice(self.v, np.empty(0, np.int32), np.empty(0, np.int64))
        self.hashes, self.numbers, self.blocks = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _forget(self) -> None:
        keep = self.blocks[self.numbers] > 1
        if self.lattice.off[-1] < 2 * (self.lattice.off[self.numbers[keep] + 1] - self.lattice.off[self.numbers[keep]]).sum():
            return self._clear()
        self.lattice = self.lattice.only(self.numbers[keep])
        self.hashes, self.numbers = self.hashes[keep], np.arange(int(keep.sum()))
        self.blocks = np.ones(len(self.numbers), np.int64)

    def look_up(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(chunk of each place in the chains of all texts, chunks of each text)."""
        chars = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le"), "<i4").copy()
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        space = chars == 32
        chars[chars == ord(SPACE)] = ord(LITERAL)
        chars[space] = ord(SPACE)
        line = chars == 10
        starts = line | (space & np.append(True, ~space[:-1])) | np.append(True, line[:-1]) if len(chars) else np.empty(0, bool)
        starts[(np.cumsum(size) - size)[size > 0]] = True
        start = np.flatnonzero(starts)
        length = np.diff(np.append(start, len(chars)))
        per_text = np.add.reduceat(starts, np.append(0, np.cumsum(size))[:-1][size > 0], dtype=np.int64) if len(chars) else np.empty(0, np.int64)
        counts = np.zeros(len(texts), np.int64)
        counts[size > 0] = per_text
        if not len(start):
            return np.empty(0, np.int64), counts
        inside = np.arange(len(chars)) - np.repeat(start, length)
        if self.lattice.off[-1] > self.kept:
            self._forget()
        while True:
            h = np.add.reduceat(mix(chars.astype(np.uint64) * _M1 + inside.astype(np.uint64) * _M3 + np.uint64(self.salt)), start)
            distinct, where, which = np.unique(h, return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
            known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
            number = np.empty(len(distinct), np.int64)
            number[known] = self.numbers[at[known]]
            new = np.flatnonzero(~known)
            if len(new):
                number[new] = len(self.lattice.end) + np.arange(len(new))
                took = where[new]
                self.lattice.absorb(Lattice(self.v, chars[_ranges(start[took], length[took])], length[took]))
                self.hashes, self.numbers = np.append(self.hashes, distinct[new]), np.append(self.numbers, number[new])
                self.blocks = np.append(self.blocks, np.zeros(len(new), np.int64))
                order = np.argsort(self.hashes)
                self.hashes, self.numbers = self.hashes[order], self.numbers[order]
            self.blocks[number] += 1
            chunk = number[which]
            off = self.lattice.off
            if (off[chunk + 1] - off[chunk] == length).all() and (self.lattice.chars[np.repeat(off[chunk], length) + inside] == chars).all():
                return chunk, counts
            self.salt += 1  # two chunks of one hash
            self._clear()


def uniform(key: np.ndarray) -> np.ndarray:
    """52 bits in (0, 1)."""
    return ((mix(key * _M3 + _M2) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def held_gumbel(log_p: np.ndarray, most: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Gumbel variates at log_p, conditioned to lie below ``most``."""
    return -np.logaddexp(-most, np.log(-np.log(u)) - log_p)


def split_bound(log_p: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbel variates at log_p, conditioned on ``bound`` as their greatest."""
    g = log_p - np.log(-np.log(u))
    top = g.argmax()
    with np.errstate(divide="ignore"):
        v = bound - g + np.log(-np.expm1(np.minimum(g - g[top], 0.0)))
    out = bound - np.maximum(0.0, v) - np.log1p(np.exp(-np.abs(v)))
    out[top] = bound
    return out


def _follow(lat: Lattice, noise: np.ndarray, chunk: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paths drawn from each start to the end of its chunk: (steps, edges, log probability, mass of what parts from it)."""
    n, at, end, off = len(chunk), start.copy(), lat.end[chunk], lat.off[chunk]
    log_p, parts, steps = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    go, path = np.flatnonzero(at < end), []
    while len(go):
        place = at[go]
        e = lat.first[place]
        u = uniform(noise[go] + (place - off[go]).astype(np.uint64) * _M1)
        on = np.flatnonzero(u >= lat.up_to[e])
        while len(on):
            e[on] += 1
            on = on[u[on] >= lat.up_to[e[on]]]
        path.append((go, e))
        before = log_p[go]
        parts[go] += np.exp(before) * lat.rest[e]
        log_p[go] = before + lat.cond[e]
        steps[go] += 1
        at[go] = place + lat.length[e]
        go = go[at[go] < end[go]]
    base = np.cumsum(steps) - steps
    edges = np.empty(int(steps.sum()), np.int64)
    for s, (go, e) in enumerate(path):
        edges[base[go] + s] = e
    return steps, edges, log_p, parts


class _Path:
    """A segmentation: its edges, the first edge and the log probability before each chunk, and from where on it may be left."""

    __slots__ = ("edge", "cut", "before", "word", "step", "base")

    def __init__(self, edge: np.ndarray, cut: np.ndarray, before: np.ndarray, word: int, step: int, base: float) -> None:
        self.edge, self.cut, self.before, self.word, self.step, self.base = edge, cut, before, word, step, base


class _Agenda:
    """One text's regions by perturbed bound, and the segmentations found."""

    __slots__ = ("heap", "paths", "keys", "made")

    def __init__(self) -> None:
        self.heap: list[tuple[float, int, int, int, int, float]] = []
        self.paths: list[_Path] = []
        self.keys: list[float] = []
        self.made = 0

    def put(self, bound: float, path: int, step: int, edge: int, base: float) -> None:
        """A branch; with edge -1 all that parts from the path in the chunk numbered ``step``."""
        self.made += 1
        heapq.heappush(self.heap, (-bound, self.made, path, step, edge, base))


def _first_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest keys that are finite."""
    at = np.argpartition(-keys, n - 1)[:n] if len(keys) > n else np.arange(len(keys))
    return at[keys[at] > -np.inf]


def _open(lat: Lattice, a: _Agenda, bound: float, path: int, word: int, seed: np.uint64, left: int) -> None:
    """Split what parts from a path in one chunk into branches."""
    p = a.paths[path]
    lo, base = (p.step, p.base) if word == p.word else (int(p.cut[word]), float(p.before[word]))
    steps = np.arange(lo, int(p.cut[word + 1]))
    taken = p.edge[steps]
    own = lat.own(taken)
    counts = lat.first[own + 1] - lat.first[own]
    edges = _ranges(lat.first[own], counts)
    of = np.repeat(np.arange(len(steps)), counts)
    other = edges != taken[of]
    edges, of = edges[other], of[other]
    cond = lat.cond[taken]
    before = base + np.cumsum(cond) - cond
    noise = seed + np.uint64(0xA5A5 + path) * _M2 + steps[of].astype(np.uint64) * _M3 + (edges - lat.first[own][of]).astype(np.uint64) * _M1
    bounds = split_bound(before[of] + lat.cond[edges], bound, uniform(mix(noise)))
    for j in _first_of(bounds, left).tolist():
        a.put(float(bounds[j]), path, int(steps[of[j]]), int(edges[j]), float(before[of[j]]))


def sample_block(book: Book, keys: Sequence[int], texts: Sequence[str | None], k: int = SAMPLES, seed: int = SEED) -> tuple[list[_Agenda], np.ndarray]:
    """Each text's agenda with its segmentations, and the thresholds of their inclusion scores."""
    chunk, size = book.look_up(texts)
    lat, m = book.lattice, len(texts)
    base = np.cumsum(size) - size
    agendas, threshold = [_Agenda() for _ in range(m)], np.full(m, -np.inf)
    with np.errstate(over="ignore"):
        seeds = mix(np.array([x & (2**64 - 1) for x in keys], np.uint64) + np.uint64(seed) * _M2)
        root = -np.log(-np.log(uniform(seeds)))
        # what is followed in this round: chunks of texts, each from some place on
        doc, start = np.repeat(np.arange(m), size), lat.off[chunk]
        at, cuts, opened = np.arange(len(chunk)), np.append(base, len(chunk)), [(i, -1, 0, 0, 0.0) for i in range(m)]
        for s in range(k):
            word = (at - base[doc]).astype(np.uint64)
            salt = np.uint64((s + 1) * int(_M1) % 2**64)
            steps, edges, log_p, parts = _follow(lat, mix(seeds[doc] + salt + word * _M3), chunk[at], start)
            with np.errstate(divide="ignore"):
                mass = np.log(parts)
                noise = np.log(-np.log(uniform(mix(seeds[doc] + salt + word * _M3 + _M2))))
            ends = np.append(0, np.cumsum(steps))
            for j, (i, path, step, edge, before) in enumerate(opened):
                a, x, y = agendas[i], cuts[j], cuts[j + 1]
                mine, upto = edges[ends[x] : ends[y]], ends[x : y + 1] - ends[x]
                if path < 0:
                    key, front, p = float(root[i]), 0.0, _Path(mine, upto, np.append(0.0, np.cumsum(log_p[x:y])), 0, 0, 0.0)
                else:
                    old, key = a.paths[path], a.keys.pop()
                    w, front = int(word[x]), before + float(lat.cond[edge])
                    p = _Path(
                        np.concatenate([old.edge[:step], [edge], mine]), np.concatenate([old.cut[: w + 1], step + 1 + upto[1:]]),
                        np.concatenate([old.before[: w + 1], front + np.cumsum(log_p[x:y])]), w, step + 1, front,
                    )
                a.paths.append(p)
                a.keys.append(key)
                if y > x:
                    here = np.append(front, p.before[p.word + 1 : -1])
                    bounds = -np.logaddexp(-key, noise[x:y] - here - mass[x:y])
                    for z in _first_of(bounds, k - s).tolist():
                        a.put(float(bounds[z]), len(a.paths) - 1, p.word + z, -1, 0.0)
            again = []
            for i, *_ in opened:
                a = agendas[i]
                if not a.heap:
                    continue
                if s == k - 1:
                    threshold[i] = -a.heap[0][0]
                    continue
                bound, _, path, step, edge, before = heapq.heappop(a.heap)
                if edge < 0:
                    _open(lat, a, -bound, path, step, seeds[i], k - s)
                    bound, _, path, step, edge, before = heapq.heappop(a.heap)
                a.keys.append(-bound)
                again.append((i, path, step, edge, before))
            if not again:
                break
            opened = again
            # the rest of the chunk that parts, then all chunks after it
            heads = np.array([base[i] + np.searchsorted(agendas[i].paths[path].cut, step, side="right") - 1 for i, path, step, _, _ in opened])
            doc = np.array([i for i, *_ in opened])
            rest = base[doc] + size[doc] - heads
            at, cuts, doc = _ranges(heads, rest), np.append(0, np.cumsum(rest)), np.repeat(doc, rest)
            start = lat.off[chunk[at]]
            turn = np.array([x[3] for x in opened])
            start[cuts[:-1]] = lat.own(turn) + lat.length[turn]
    return agendas, threshold


def _ids(v: Vocabulary, lat: Lattice, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all edges, ids of each edge)."""
    piece = lat.piece[edges].astype(np.int64)
    bare = np.flatnonzero(piece < 0)
    counts = np.ones(len(piece), np.int64)
    if not len(bare):
        return piece, counts
    codes, number = np.unique(-1 - piece[bare], return_inverse=True)
    raw = [spelled(c) for c in codes.tolist()]
    size = np.array([len(x) for x in raw])
    counts[bare] = size[number]
    out = np.repeat(piece, counts)
    out[out < 0] = v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)][_ranges((np.cumsum(size) - size)[number], size[number])]
    return out, counts


def sample_batch(v: Vocabulary, keys: Sequence[int], texts: Sequence[str | None], k: int = SAMPLES, seed: int = SEED, book: Book | None = None) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(text, sample from 0, ids, log probability, key, inclusion score), by text and sample."""
    book = book or Book(v)
    at, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars > BLOCK or i == len(texts) - 1:
            text, sample, counts, flat, log_p, key, inclusion = _columns(book, keys[at : i + 1], texts[at : i + 1], k, seed)
            ends = np.cumsum(counts)
            for j in range(len(text)):
                yield at + int(text[j]), int(sample[j]), flat[ends[j] - counts[j] : ends[j]], float(log_p[j]), float(key[j]), float(inclusion[j])
            at, chars = i + 1, 0


def _columns(book: Book, keys: Sequence[int], texts: Sequence[str | None], k: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text, sample, number of ids, all ids, log probability, key, inclusion score) of a block's samples."""
    agendas, threshold = sample_block(book, keys, texts, k, seed)
    paths = [p for a in agendas for p in a.paths]
    steps = np.array([len(p.edge) for p in paths], np.int64)
    flat, each = _ids(book.v, book.lattice, np.concatenate([p.edge for p in paths]) if paths else np.empty(0, np.int64))
    total, ends = np.append(0, np.cumsum(each)), np.append(0, np.cumsum(steps))
    counts = np.diff(total[ends])
    found = np.array([len(a.paths) for a in agendas], np.int64)
    text = np.repeat(np.arange(len(texts)), found)
    sample = np.arange(len(text)) - np.repeat(np.cumsum(found) - found, found)
    log_p = np.minimum(np.array([p.before[-1] for p in paths], float), 0.0)
    most = threshold[text]
    inclusion = np.where(np.isfinite(most), -np.expm1(-np.exp(np.minimum(700.0, log_p - most))), 1.0)
    return text, sample, counts, flat, log_p, np.array([x for a in agendas for x in a.keys], float), inclusion


SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, key double, inclusion double, round_trip boolean, ids {}"


def _encode(batches: Iterator[pa.RecordBatch], v: Vocabulary, k: int, seed: int, packed: bool) -> Iterator[pa.RecordBatch]:
    book = Book(v)
    for batch in batches:
        # lattices and results of some BLOCK characters at a time
        size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        block = size // BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(cuts):
            if b > a:
                yield _encode_block(batch.slice(a, b - a), book, k, seed, packed)


def _encode_block(batch: pa.RecordBatch, book: Book, k: int, seed: int, packed: bool) -> pa.RecordBatch:
    texts, keys = batch.column("text").to_pylist(), batch.column("key").to_pylist()
    text, sample, counts, flat, log_p, key, inclusion = _columns(book, keys, texts, k, seed)
    same = _decodes_to(book.v, flat, counts, [(texts[i] or "").encode() for i in text.tolist()])
    ends = np.append(0, np.cumsum(counts)).astype(np.int32)
    if packed:
        width = 4 if len(book.v.raw) > 65536 else 2
        ids = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends * width), pa.py_buffer(flat.astype(f"<u{width}"))])
    else:
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
    cols = [batch.column("doc_id").take(pa.array(text)), pa.array(sample.astype(np.int32)), pa.array(counts), pa.array(log_p), pa.array(key), pa.array(inclusion), pa.array(same), ids]
    return pa.record_batch(cols, names=["doc_id", "sample", "n_pieces", "log_prob", "key", "inclusion", "round_trip", "ids"])


def _decodes_to(v: Vocabulary, flat: np.ndarray, counts: np.ndarray, want: list[bytes]) -> np.ndarray:
    """Whether the ids of each segmentation decode to the bytes that are wanted."""
    n = np.diff(v.ends, prepend=0)[flat]
    got = v.flat[_ranges(v.ends[flat] - n, n)]
    total, ends = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(counts))
    size = np.diff(total[ends])
    have = np.array([len(x) + 1 if x else 0 for x in want], np.int64)
    if (size == have).all():
        differs = got != np.frombuffer(b"".join([b" " + x for x in want if x]), np.uint8)
        wrong = np.append(0, np.cumsum(differs))[total[ends]]
        return np.diff(wrong) == 0
    return np.array([v.decode(flat[a:b]) == x for a, b, x in zip(ends[:-1], ends[1:], want, strict=True)], bool)


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, model: str = MODEL, seed: int = SEED, packed: bool = False, by_rank: bool = True) -> DataFrame:
    """Up to k rows for each row of docs (doc_id, text); packed: ids as little-endian numbers of 2 bytes (4 above 65,536 pieces)."""
    v = load(model, by_rank)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.xxhash64("doc_id").alias("key"))
    return rows.mapInArrow(lambda it: _encode(it, v, k, seed, packed), SCHEMA.format("binary" if packed else "array<int>"))


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows with a column ``text`` decoded from the array column ``ids``."""
    v = load(model)
    back = F.pandas_udf(lambda s: s.map(lambda x: v.decode(np.asarray(x, np.int64)).decode(), na_action="ignore"), "string")
    return rows.withColumn("text", back("ids"))
