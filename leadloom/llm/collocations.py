"""Phrase collocation mining with suffix-sigma.

Texts are cut into pieces and pieces into words; everything is per language. A phrase's
frequency counts all its occurrences within pieces, overlaps included.

1. A sieve of CELLS counters, by hash of language and one to SIEVED words in a row, is filled from
   all texts. A cell that stays under ``least`` proves that no phrase of that frequency holds
   its words; a full one proves nothing, so results do not depend on the sieve, only the
   rows that are shuffled do. Its bits, CELLS / 8 bytes, are broadcast. Beyond some tens of GB of text
   most cells are full and it rules out little.
2. Every word starts a suffix of at most MOST_WORDS words, which ends with its piece or before the
   first words that the sieve rules out. Equal suffixes are counted where they are read: texts
   are split CHUNK bytes at a time, and a task's counts merged while they fit into HELD bytes.
3. Suffixes are shuffled by ranges of language and suffix, so by language and first word, a hot first
   word over many partitions, and sorted reverse-lexicographically.
4. One stack of open prefixes counts all prefixes in that order. Those that are open at a
   partition's edges may go on in the next and are summed afterwards whatever their count; all
   others are complete.
5. Phrases are joined with their parts. Every cut's score is floor(1000 * a * n / (l * r)) in
   decimals of 38 digits; the least counts. A phrase goes when a longer one with its
   words in a row is as frequent; one word more at either end shows that, as all
   phrases in between are as frequent too.

Null texts are empty, rows without language have the language ``und``. Long texts are read in slices that
are cut at words and look MOST_WORDS - 1 words ahead, so that no phrase is lost. Ties go to the smaller
cut and the phrase that sorts first. Repeated rows count as often as they occur. An empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

LEAST, MOST_WORDS, TOP = 100, 5, 2000
CELLS, BLOCK, SIEVED = 1 << 27, 1 << 16, 3
CHUNK, HELD = 4 << 20, 32 << 20
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: One pass over bytes: breaks become LF, blanks a space, A-Z a-z.
PLAIN = bytes.maketrans(BREAKS + BLANKS + bytes(range(65, 91)), b"\n" * len(BREAKS) + b" " * len(BLANKS) + bytes(range(97, 123)))
_GAP = re.compile(rb"[ \n]")
_AHEAD = re.compile(rb"(?: *[^ \n]+){0,%d}" % (MOST_WORDS - 1))
ODD = np.uint64(0x9E3779B97F4A7C15)
COUNTED = "lang string, suffix string, c long"


def _slices(text: bytes, chunk: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, how many of them are the slice's own; the rest looks ahead)."""
    at = 0
    while len(text) - at > chunk and (gap := _GAP.search(text, at + chunk)):
        yield text[at : _AHEAD.match(text, gap.start()).end()], gap.start() - at
        at = gap.start()
    yield text[at:], len(text) - at


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[str, list[tuple[bytes, int]]]]:
    """(language, slices of its texts), some ``chunk`` bytes at a time."""
    held: dict[str, list[tuple[bytes, int]]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for part in _slices(text.as_buffer().to_pybytes().translate(PLAIN), chunk):
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part[0]) + 1
                if size[lang] >= chunk:
                    yield lang, held.pop(lang)
                    size[lang] = 0
    yield from held.items()


class Words:
    """The words of a chunk: ids in a dictionary, hashes, which follow on in a piece, which start suffixes."""

    def __init__(self, lang: str, parts: list[tuple[bytes, int]]) -> None:
        flat = np.frombuffer(b"\n".join(x for x, _ in parts) + b"\n", np.uint8)
        gap = (flat == 32) | (flat == 10)
        before = np.append(True, gap[:-1])
        start, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        base = np.cumsum([0, *(len(x) + 1 for x, _ in parts[:-1])])
        of = np.searchsorted(base, start, "right") - 1
        self.starts = start - base[of] < np.array([own for _, own in parts])[of]
        piece = np.cumsum(flat == 10)[start] if len(start) else start
        self.goes_on = np.append(piece[1:] == piece[:-1], False) if len(start) else np.zeros(0, bool)
        offsets = np.append(0, np.cumsum(end - start)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(flat[~gap].tobytes())])
        coded = words.dictionary_encode()
        self.ids, self.dictionary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        seed = xxhash.xxh64_intdigest(lang.encode())
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        self.hashes = hashes[self.ids]

    def cells(self, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one word, two and so on: the sieve's cells by first word, and where so many words are in one piece."""
        shift = np.uint64(64 - (cells.bit_length() - 1))
        here, there = self.hashes, np.ones(len(self.hashes), bool)
        for k in range(SIEVED):
            if k:
                there = there & np.append(self.goes_on[k - 1 :], np.zeros(k - 1, bool))[: len(there)]
                here = here * ODD + np.append(self.hashes[k:], np.zeros(k, np.uint64))[: len(here)]
                here = (here ^ (here >> np.uint64(29))) * ODD
            yield (here >> shift).astype(np.int64), there


def _fill(batches: Iterator[pa.RecordBatch], least: int, chunk: int, cells: int) -> Iterator[pa.RecordBatch]:
    """(block, counts): what a task's texts add to the sieve, a block of cells a row, and the languages' words."""
    counts = np.zeros(cells, np.uint8 if least < 256 else np.uint32)
    most = np.iinfo(counts.dtype).max
    for lang, parts in _chunks(batches, chunk):
        words = Words(lang, parts)
        for cell, there in words.cells(cells):
            cell, n = np.unique(cell[words.starts & there], return_counts=True)
            counts[cell] = np.minimum(counts[cell].astype(np.int64) + n, most)
    for block in np.flatnonzero(counts.reshape(-1, BLOCK).any(axis=1)):
        part = counts[block * BLOCK : (block + 1) * BLOCK]
        at = np.flatnonzero(part)
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "at": [at.astype(np.uint16).tobytes()], "c": [part[at].astype(np.uint32 if least >= 256 else np.uint8).tobytes()]})


def _merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(block, bits of the cells that reach ``least``); a block's rows come together."""
    now, counts = None, np.zeros(BLOCK, np.int64)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()), "bits": [np.packbits(counts >= least).tobytes()]})

    for batch in batches:
        for block, at, c in zip(*(batch.column(k) for k in ("block", "at", "c")), strict=True):
            if block.as_py() != now:
                if now is not None:
                    yield done()
                now, counts[:] = block.as_py(), 0
            counts[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(c.as_buffer(), np.uint32 if least >= 256 else np.uint8)
    if now is not None:
        yield done()


def sieve(texts: DataFrame, least: int, chunk: int = CHUNK, cells: int = CELLS) -> np.ndarray:
    """One bit for every cell (a power of two of them): whether it reaches ``least``; cells / 8 bytes come to the driver."""
    filled = texts.mapInArrow(partial(_fill, least=least, chunk=chunk, cells=cells), "block int, at binary, c binary")
    merged = filled.repartition("block").sortWithinPartitions("block").mapInArrow(partial(_merge, least=least), "block int, bits binary")
    bits = np.zeros(cells // 8, np.uint8)
    for row in merged.toLocalIterator():
        bits[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def _suffixes(batches: Iterator[pa.RecordBatch], bits, chunk: int, cells: int) -> Iterator[pa.RecordBatch]:
    """(language, suffix, count): the words of a suffix, each followed by a space; '' counts all words."""
    known = bits.value
    full = lambda cell: (known[cell >> 3] >> (7 - (cell & 7))) & 1 > 0
    held: list[pa.RecordBatch] = []
    schema = pa.schema([("lang", pa.string()), ("suffix", pa.string()), ("c", pa.int64())])

    def merged(most: int) -> Iterator[pa.RecordBatch]:
        """What is held, merged, if that is still more than so many bytes; else it is held on."""
        table = pa.Table.from_batches(held, schema).group_by(["lang", "suffix"]).aggregate([("c", "sum")]).rename_columns({"c_sum": "c"}).select(schema.names)
        held[:] = table.combine_chunks().to_batches() if table.nbytes <= most else []
        if table.nbytes > most:
            yield from table.to_batches(max_chunksize=100_000)

    for lang, parts in _chunks(batches, chunk):
        words = Words(lang, parts)
        held.append(pa.RecordBatch.from_pydict({"lang": [lang], "suffix": [""], "c": [int(words.starts.sum())]}, schema=schema))
        # longest[i]: of how many words, up to SIEVED, a phrase from word i may be
        longest = np.zeros(len(words.ids), np.int64)
        for k, (cell, there) in enumerate(words.cells(cells)):
            inner = np.append(longest[1:], 0)[: len(longest)] >= k
            longest += (longest == k) & inner & there & full(cell)
        size = np.where(words.starts, longest, 0)
        for k in range(SIEVED, MOST_WORDS):
            size += (size == k) & (np.append(longest[k - SIEVED + 1 :], np.zeros(k - SIEVED + 1, np.int64))[: len(longest)] == SIEVED)
        at = np.flatnonzero(size >= 1)
        rank = words.ids[at]
        for k in range(1, MOST_WORDS + 1):
            if not len(at):
                break
            last = size[at] == k
            found, first, n = np.unique(rank[last], return_index=True, return_counts=True)
            if len(found):
                places = at[last][first]
                text = [words.dictionary.take(pa.array(words.ids[places + j])).cast(pa.large_string()) for j in range(k)]
                joined = pc.binary_join_element_wise(*text, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
                held.append(pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(found), np.int64))), joined.cast(pa.string()), pa.array(n)], schema=schema))
            at, rank = at[~last], rank[~last]
            if len(at) and k < MOST_WORDS:
                _, rank = np.unique(rank * (len(words.dictionary) + 1) + words.ids[at + k], return_inverse=True)
        if sum(x.nbytes for x in held) > 2 * HELD:
            yield from merged(HELD)
    if held:
        yield from merged(0)


def _count_prefixes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(language, phrase, words, count) of sorted suffixes: complete counts from ``least`` on, and all that touch an edge.

    stack[k - 1] is the open prefix of k words: [language, phrase, count, whether the partition's
    first row has it]. What opens and closes within a batch is summed by array operations.
    """
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])
    stack: list[list] = []
    is_first = True

    def pop(depth: int, at_edge: bool = False) -> pa.RecordBatch:
        out = [(x[0], x[1], k + 1, x[2]) for k, x in enumerate(stack) if k >= depth and (x[2] >= least or x[3] or at_edge)]
        del stack[depth:]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], schema.types[i]) for i in range(4)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        split = pc.split_pattern(batch.column("suffix"), " ")
        size = pc.list_value_length(split).to_numpy() - 1
        begin = split.offsets.to_numpy()[:-1]
        coded = split.values.dictionary_encode()
        flat, names = coded.indices.to_numpy(), coded.dictionary
        lang = batch.column("lang").dictionary_encode()
        same = np.append(False, np.diff(lang.indices.to_numpy()) == 0)
        c = batch.column("c").to_numpy()
        heads, tails, whole = [], [], 0
        for k in range(1, int(size.max()) + 1):
            has = size >= k
            word = np.where(has, flat[np.minimum(begin + k - 1, len(flat) - 1)], -1)
            same = same & has & np.append(False, has[:-1]) & np.append(False, word[1:] == word[:-1])
            rows = np.flatnonzero(has)
            run = np.flatnonzero(~same[rows])
            total, start = np.add.reduceat(c[rows], run), rows[run]
            keep = total >= least
            keep[[0] * bool(has[0]) + [-1] * bool(has[-1])] = True
            who = lang.take(pa.array(start[keep])).cast(pa.string())
            text = [names.take(pa.array(flat[begin[start[keep]] + j])) for j in range(k)]
            phrase = pc.binary_join_element_wise(*text, " ") if k > 1 else text[0]
            total = total[keep]
            edge = lambda i: [who[i].as_py(), phrase[i].as_py(), int(total[i]), False]  # noqa: E731, B023
            if has[0]:
                heads.append(edge(0))
            if has[-1]:
                tails.append(edge(len(total) - 1))
            whole += bool(has[0] and has[-1] and len(run) == 1 and whole == k - 1)
            inner = slice(int(has[0]), len(total) - int(has[-1] and not (has[0] and len(run) == 1)))
            out = [who[inner], phrase[inner], pa.array(np.full(len(total[inner]), k, np.int32)), pa.array(total[inner])]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays(out, schema=schema)
        for k, head in enumerate(heads):  # each goes on with an open prefix or closes it
            if k < len(stack) and stack[k][:2] == head[:2]:
                stack[k][2] += head[2]
            else:
                yield pop(k)
                stack.append([*head[:3], is_first])
        yield pop(len(heads))
        yield pop(whole)
        stack += tails[whole:]
        is_first = False
    yield pop(0, at_edge=True)


def phrase_counts(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of up to MOST_WORDS words with f >= least; (lang, n) of all languages."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    bits = spark.sparkContext.broadcast(sieve(texts, least, chunk, cells))
    rows = durable(texts.mapInArrow(partial(_suffixes, bits=bits, chunk=chunk, cells=cells), COUNTED), "phrase-suffixes")
    words = durable(rows.filter("suffix = ''").groupBy("lang").agg(F.sum("c").alias("n")), "phrase-words")
    suffixes = rows.filter("suffix != ''")
    sort = [F.asc("lang"), F.desc(F.left("suffix", F.lit(64)))]  # ranges of bounded keys; the order within is of whole suffixes
    dealt = suffixes.repartitionByRange(*sort).sortWithinPartitions("lang", F.desc("suffix"))
    parts = dealt.mapInArrow(partial(_count_prefixes, least=least), "lang string, phrase string, words int, f long")
    phrases = parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return durable(phrases, "phrases"), words


def scored_phrases(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK, cells: int = CELLS) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two words and more that no longer one stands for."""
    phrases, words = phrase_counts(docs, least, chunk, cells)
    many = phrases.filter("words > 1").withColumn("w", F.split("phrase", " "))
    cut = many.select("lang", "phrase", F.col("f").alias("a"), "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    joined = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cuts = cut.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("second"))
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("second", "r"), ["lang", "second"]).join(F.broadcast(words) if words.count() <= 10_000 else words, "lang")
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    both = both.withColumn("score", F.expr(f"({wide('1000')} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b"))
    shorter = many.filter("words > 2").select("lang", "f", F.explode(F.array(joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1))).alias("phrase"))
    within = shorter.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = best.join(within, ["lang", "phrase"], "left").filter("most IS NULL OR 100 * most < 100 * b.a")
    return kept.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score, frequency and bytes."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    scored = scored_phrases(docs, least).withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = scored.withColumn("rank", F.row_number().over(W.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
