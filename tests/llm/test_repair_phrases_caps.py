"""Conversation repair, phrase mining and near copies of vectors against brute force, on small fixtures."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from leadloom.llm import cap_filters, collocations, conversations

TALK = "conv_id long, turn long, role string, text string, audit long"


# --- 11 ------------------------------------------------------------------

def cheapest(signature):
    """(cost, audit) by search over all edits, the least string of the cheapest."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if i == len(signature) and last in ("", "a"):
            return cost, audit
        if (cost, audit, i, last) in seen:
            continue
        seen.add((cost, audit, i, last))
        for role in "ua":
            if (last, role) in legal:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role))
        if i == len(signature):
            continue
        c = signature[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last))
        if not c.isdigit():
            more = 3 * c.isupper()
            if (last, c.lower()) in legal:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, c.lower()))
            for role in "ua":
                if (last, role) in legal:
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, role))
    raise AssertionError


def test_signatures_are_solved_like_a_search():
    g = np.random.default_rng(11)
    for _ in range(300):
        s = "".join(g.choice(list("suaoSUAO0167"), g.integers(0, 7)))
        assert conversations.solve(s)[:2] == cheapest(s), s
    assert re.fullmatch("(?:s?(?:ua)+)?", "".join((r or "x")[0] for _, r, _ in conversations.solve("oooo")[2]))


def test_long_signatures_do_not_exhaust_the_stack():
    cost, audit, lines = conversations.solve("us" * 20_000)
    assert cost == 3 * 20_000 and len(audit) == 40_000 and len(lines) == 40_000


def brute_repair(rows, solver=cheapest):
    """{conv_id: all of the contract's columns} in plain Python."""
    out, by = {}, {}
    key = lambda x: " " if x is None else str(x)
    for conv, turn, role, text, *_ in rows:
        kept = by.setdefault(conv, [])
        act = zlib.crc32(f"{key(conv)}:{key(turn)}".encode()) % 20
        role, text = key(role), key(text)
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        kept += [(turn, "user" if act == 4 else role, text)] * (0 if act == 0 else 2 if act == 3 else 1)
    for conv, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        code, seen = "", set()
        for _, role, text in kept:
            who = "suao".index(role[0]) if role[:1] in ("s", "u", "a") else 3
            tail = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            code += ("0123" if not tail else "4567" if (role, text) in seen else "SUAO" if tail not in ".!?" else "suao")[who]
            seen.add((role, text))
        cost, audit = solver(code)
        lines, i = [], 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else kept[i][1:]
            i += edit != "I"
            if edit in "RI":
                role = "assistant" if lines and lines[-1][0][:1] == "u" else "user"
            if edit != "D":
                lines.append((role, text))
        who = [r[1][:1] for r in kept]
        turns = {r[0] for r in kept} - {None}
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, sum(c in "0123" for c in code), sum(c in "4567" for c in code), sum(c in "SUAO" for c in code), sum(a + b not in ("su", "ua", "au") for a, b in zip(who, who[1:])), cost, audit, sha)
    return out


def test_repair_agrees_with_brute_force(spark):
    g = np.random.default_rng(12)
    texts = ["Hello there.", "Cut off", "", " \t\n", "Why?\n ", "é!", None, "x" * 200_000 + "."]
    rows = [(int(c), int(t), str(g.choice(["system", "user", "assistant", "tool", ""])), texts[g.integers(len(texts))], 9) for c in range(40) for t in range(g.integers(1, 7))]
    rows += [(None, None, None, "a.", 1), (None, 3, "user", "b.", 1), (7, None, "user", "first.", 1), (7, 2, "user", "tie b.", 1), (7, 2, "user", "tie a.", 1), (7, 2, "user", "tie a.", 1), (2**62, 0, "user", "Q?", 1)]
    got = {r[0]: tuple(r)[1:] for r in conversations.repair_digests(conversations.damage(spark.createDataFrame(rows, TALK))).collect()}
    assert got == brute_repair(rows)


def test_repaired_lines_of_undamaged_rows_and_of_nothing(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", 0), (1, 1, "user", "b.", 0), (2, 0, "system", "s.", 0), (3, 0, "user", "u.", 0), (3, 1, "assistant", "v.", 0)], TALK)
    found, lines = conversations.audit_conversations(conversations.undamaged(rows))
    assert {r.conv_id: (r.audit, r.cost) for r in found.collect()} == {1: ("KR", 6), 2: ("D", 4), 3: ("KK", 0)}
    assert sorted((r.conv_id, r.position, r.edit, r.role, r.text) for r in lines.collect()) == [(1, 0, "K", "user", "a"), (1, 1, "R", "assistant", "b."), (3, 0, "K", "user", "u."), (3, 1, "K", "assistant", "v.")]
    assert conversations.repair_digests(conversations.damage(spark.createDataFrame([], TALK))).collect() == []


def test_a_hot_conversation_lies_in_several_pieces(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t % 900}{'.' if t % 7 else ''}", 0) for t in range(1500)]
    df = spark.createDataFrame(rows, TALK)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert conversations._pieces(conversations._facts(conversations.damage(df))).count() > 1
        got = tuple(conversations.repair_digests(conversations.damage(df)).first())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {got[0]: got[1:]} == brute_repair(rows, lambda s: conversations.solve(s)[:2])


# --- 4, 10 ---------------------------------------------------------------

def test_one_huge_text_does_not_empty_the_training_set(spark):
    from leadloom.llm import quality

    g = np.random.default_rng(3)
    rows = [(i, "".join(g.choice(list("ab " if i % 2 else "xyz,"), 300)) if i else "q" * 200_000) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    assert not isinstance(quality.train(docs, labels, most=100_000), float)


def test_long_runs_of_one_byte_are_few_rows():
    from leadloom.llm import substring_dedup

    texts = ["a" * 300_000, "a" * 150_000 + "b" + "a" * 150_000, "xyz" * 90_000]
    batch = pa.record_batch([pa.array(range(3), pa.int64()), pa.array(range(3), pa.int64()), pa.array(texts)], names=["key", "id", "text"])
    found = pa.Table.from_batches(list(substring_dedup._find(iter([batch]), 1, np.empty(0, "u8"))))
    assert sum(map(len, found.column("blob").to_pylist())) < 100_000


@pytest.mark.parametrize("seed", range(3))
def test_periodic_texts_agree_with_brute_force(spark, seed):
    from test_llm_operators import brute_removed

    from leadloom.llm import anchors, substring_dedup

    g = np.random.default_rng(seed)

    def text():
        units = ["".join(g.choice(list("ab"), g.integers(1, int(g.choice([2, 4, 40, 90]))))) for _ in range(g.integers(1, 5))]
        return "".join(u * int(g.integers(1, max(2, 300 // len(u)))) for u in units)

    rows = [(int(i), text()) for i in g.permutation(10)]
    rows += [(10, rows[0][1] + "b" + rows[1][1]), (11, "a" * 4000), (12, "a" * 2000 + "b" + "a" * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    grams = np.unique(np.concatenate([h >> np.uint64(16) for _, _, h, _, _ in anchors.anchors([t.encode() for _, t in rows])]))
    for common in (None, grams):
        assert Counter(map(tuple, substring_dedup.remove_repeats(df, common=common).collect())) == brute_removed(rows)


# --- 12 ------------------------------------------------------------------

def brute_phrases(rows, least):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        plain = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", plain):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = {}
    for (lang, *w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        cuts = [((1000 * a * n[lang]) // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang, *w] = (a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], score)
    inside = {(p[0], *p[1 + i : 1 + i + k]) for p in out for k in range(2, len(p) - 1) for i in range(len(p) - k) if f[p[0], *p[1 + i : 1 + i + k]] == out[p][0]}
    return {(p[0], " ".join(p[1:])): x for p, x in out.items() if p not in inside}


def phrase_rows(seed, n):
    g = np.random.default_rng(seed)
    words = ["the", "The", "a", "new", "york", "times", "é", "x\x01", "x", "|", "b\x1f", "of"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]
    some = ["".join(str(g.choice(words)) + str(g.choice(gaps)) for _ in range(g.integers(0, 60))) for _ in range(n)]
    return [(str(g.choice(["en", "de"])), t) for t in some] + [(None, "new york new york new york"), ("und", "new york"), ("en", None), ("en", ""), ("fr", "a b c d e f g " * 30)]


@pytest.mark.parametrize("chunk", [8 << 20, 64])
def test_phrases_agree_with_brute_force(spark, chunk):
    rows = phrase_rows(5, 120)
    docs = spark.createDataFrame([(x, y, 1, "a") for x, y in rows], "lang string, text string, n long, phrase string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in collocations.scored_phrases(docs, 4, chunk, 1 << 17).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_phrases(rows, 4) and len(got) > 100


def test_slices_look_ahead_and_lose_no_phrase():
    text = b"one two three four five six. seven eight nine ten " * 9
    whole, own, at = text.translate(collocations.PLAIN), 0, 0
    for part, size in collocations._slices(whole, 40):
        assert whole[at : at + len(part)] == part
        words = collocations.Words("en", [(part, size)])
        own, at = own + int(words.starts.sum()), at + size
    assert at == len(whole) and own == 90


def test_open_prefixes_are_carried_over_batches():
    g = np.random.default_rng(3)
    suffixes = Counter(" ".join(g.choice(["a", "b", "c"], g.integers(1, 6))) + " " for _ in range(400))
    rows = sorted(suffixes.items(), key=lambda x: x[0].encode(), reverse=True)
    plain = Counter()
    for s, c in rows:
        w = s.split()
        plain.update({" ".join(w[:k]): c for k in range(1, len(w) + 1)})
    for size in (1, 2, 5, 1000):
        batches = [pa.RecordBatch.from_pydict({"lang": ["x"] * len(rows[i : i + size]), "suffix": [s for s, _ in rows[i : i + size]], "c": [c for _, c in rows[i : i + size]]}) for i in range(0, len(rows), size)]
        got = [r for b in collocations._count_prefixes(iter(batches), 3) for r in b.to_pylist()]
        assert len({r["phrase"] for r in got}) == len(got)
        assert {r["phrase"]: r["f"] for r in got if r["f"] >= 3} == {p: f for p, f in plain.items() if f >= 3}


def test_ranks_ties_and_nothing(spark):
    docs = spark.createDataFrame([("en", "b c. a d. ", 1)] * 3 + [(None, "b c", 1)], "lang string, text string, rank long")
    assert [(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(docs, 3, 1).collect()] == [("en", 1, "a d", 3, 3, 3, 12, 4000)]
    assert collocations.collocations(docs.limit(0), 3).collect() == []


def test_scores_beyond_64_bits_are_exact(spark):
    from pyspark.sql import functions as F

    a, n, left, right = 999_999_999_999_999_989, 9_999_999_999, 77_777_777_777_777_777, 987_654_321_987_654_321
    row = spark.range(1).select(F.expr(f"(cast(1000 as decimal(38, 0)) * cast({a}L as decimal(38, 0)) * cast({n}L as decimal(38, 0))) div (cast({left}L as decimal(38, 0)) * cast({right // 10**9}L as decimal(38, 0)))").alias("x")).first()
    assert row.x == Fraction(1000 * a * n, left * (right // 10**9)).__floor__()


# --- 13 ------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, kept long"


def brute_links(rows, cosine=0.98):
    unit = {}
    for i, (vec_id, v, label, *_) in enumerate(rows):
        if vec_id is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, "f4").astype("f8")
            unit[i] = x / np.linalg.norm(x)
    near = {i: [j for j in unit if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in unit}
    out = []
    for i, (vec_id, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = set(near.get(todo.pop(), [])) - seen
            seen |= new
            todo += new
        least = min((rows[j][0] for j in seen), default=None) if vec_id is not None else None
        out.append((vec_id, len(near.get(i, [])), least, vec_id is None or least == vec_id))
    return sorted(out, key=str)


def vector_rows(seed, dim=12):
    g = np.random.default_rng(seed)
    rows = []
    for centre in range(30):
        c = g.standard_normal(dim)
        for _ in range(int(g.integers(1, 12))):
            x = c + g.standard_normal(dim) * 0.12 * g.random()
            rows.append(((x * g.random()).tolist(), int(centre % 3)))
    rows += [(rows[0][0], rows[0][1])] * 3 + [(rows[0][0], 7), (rows[0][0], None), ([0.0] * dim, 1), (None, 1), ([], 1), ([float("nan")] * dim, 1), ([None] * dim, 1), ([float("inf")] + [1.0] * (dim - 1), 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([3.0], 1), ([9.0], 1), ([-9.0], 1)]
    ids = g.permutation(len(rows)).tolist()
    return [(i, v, label, 5) for i, (v, label) in zip(ids, rows, strict=True)] + [(None, rows[0][0], rows[0][1], 5), (ids[0], rows[0][0], rows[0][1], 5)]


@pytest.mark.parametrize("size", [2048, 8])
def test_links_agree_with_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(cap_filters, "SLICE", size)
    rows = vector_rows(size)
    got = cap_filters.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, got), key=str) == brute_links(rows)


def test_vectors_of_nothing(spark):
    assert cap_filters.near_duplicate_vectors(spark.createDataFrame([], VECTORS)).collect() == []


@pytest.mark.parametrize(("dim", "nodes"), [(64, 500), (64, 50_000), (16, 5000), (8, 500), (3, 500)])
def test_pairs_at_the_threshold_share_caps(dim, nodes):
    words = cap_filters.filters_for(dim, nodes, 0.98)
    g = np.random.default_rng(7)
    x = g.standard_normal((3000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = g.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    found = [set(), set()]
    for own, v in zip(found, (x, y), strict=True):
        for at in range(0, len(v), 100):
            row, word = cap_filters.decode(v[at : at + 100], *words)
            own.update(zip((row + at).tolist(), word.tolist(), strict=True))
    assert len({row for row, _ in found[0] & found[1]}) == len(x)
    assert len(found[0]) <= 1.5 * cap_filters.MOST_WORDS * len(x)


def test_listed_words_are_all_within_the_margin():
    rotation, codes, margin = cap_filters.filters_for(16, 500, 0.98)
    codes = [(part, code[:5]) for part, code in codes]
    x = np.random.default_rng(2).standard_normal((20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, word = cap_filters.decode(x, rotation, codes, margin)
    y = x @ rotation
    sums = sum(np.meshgrid(*[np.zeros(5)] * 4, indexing="ij"))[None] + sum((y[:, part] @ code.T).reshape(20, *[5 if j == i else 1 for j in range(4)]) for i, (part, code) in enumerate(codes))
    sums = sums.reshape(20, -1)
    want = {(i, j) for i, j in zip(*np.nonzero(sums >= sums.max(axis=1, keepdims=True) - margin - 1e-12), strict=True)}
    assert set(zip(row.tolist(), word.tolist(), strict=True)) <= want and len(want) - len(row) <= 1
