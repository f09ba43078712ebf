"""The pipeline's stages: columns, whole inputs and effects, on a small corpus."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import mixing, near_dups, quality, secrets, segmentation


def test_stages(spark, tmp_path):
    good = "the quick brown fox jumps over lazy dogs and walks home at night number {}"
    rows = [(i, " ".join(good.format(i * 7 + k) for k in range(6)) if i % 4 else "JUNK!! " * 40 + str(i), "en", f"s{i % 3}", 0) for i in range(80)]
    rows += [(200, rows[1][1], "en", "s0", 0), (201, "my token = abcdefgh12345 " + rows[2][1][:200], "en", "s1", 0), (202, None, "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        assert name == "segments" or docs.columns == columns
    ids = {n: {r.doc_id for r in rs} for n, rs in kept.items()}
    assert not ids["quality"] & {i for i in range(0, 80, 4)} and ids["quality"] >= {1, 2, 3, 200, 201}
    assert 200 not in ids["near_dups"] and 1 in ids["near_dups"] and len(kept["near_dups"]) == len(ids["near_dups"])
    assert all("abcdefgh12345" not in (r.text or "") for r in kept["secrets"]) and all(r.n_chars == len(r.text) for r in kept["secrets"] if r.text is not None)
    assert ids["mixing"] <= ids["secrets"] and all(r.round_trip for r in kept["segments"])
    assert Counter(r.doc_id for r in kept["segments"]) == Counter(r.doc_id for r in kept["mixing"] for _ in range(2 if r.text else 1))
    assert near_dups.LEAST_SHARE == (85, 100) and secrets.redact(None) is None


def test_near_dups_stage_has_its_own_threshold(spark):
    words = [f"w{i}" for i in range(100)]
    copy = words[:91] + [f"v{i}" for i in range(9)]  # 87 of 105 shingles in common: 0.829
    other = words[:88] + [f"u{i}" for i in range(12)]  # 84 of 108: 0.778
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1}
    assert {r.component_id for r in near_dups.near_duplicates(docs).collect()} == {1, 2}
    docs = spark.createDataFrame([(1, " ".join(words)), (3, " ".join(other))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 3}


def plain_near_dups(rows):
    """Ids that stay: the least of each class of texts that share 80% of their 5-word shingles."""
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    of = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            of = {i: min(of[a], of[b]) if c in (of[a], of[b]) else c for i, c in of.items()}
    return {i for i in sets if of[i] == i}


def plain_redaction(text):
    """For texts in which the lexer adds nothing."""
    spans = []
    for kind, p, flags, least, group in (("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, 8, 2), ("access", r"AKIA[A-Z0-9]+", 0, 16, 0), ("hex", r"[0-9a-f]+", 0, 32, 0)):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(p, text, flags) if len(m[group]) >= least]
    out, at = "", 0
    for a, kind, b in sorted(spans, key=lambda x: x[0]):
        if a >= at:
            out += text[at:a] + f"[secret:{kind}]"
        at = max(at, b)
    return out + text[at:]


def plain_copies(rows, weights=(5, 2, 1), most=3):
    """{id: copies} by whole copies and Pareto order sampling, source by source, with running sums."""
    size = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: [i for i, _, x in rows if x == s] for s in names}
    words = {s: sum(size[i] for i in own[s]) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, free = {}, float(sum(words.values())), list(names)
    while full := [s for s in free if left * weight[s] / sum(weight[x] for x in free) >= most * words[s]]:
        target |= {s: float(most * words[s]) for s in full}
        left, free = left - sum(target[s] for s in full), [s for s in free if s not in full]
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    out = {}
    for s in names:
        out |= {i: 1 for i in own[s] if not size[i]}
        some = [i for i in own[s] if size[i]]
        measure = {i: 2 ** (size[i].bit_length() // 2) for i in some}
        capped, rate = set(), 0.0
        while True:
            rest = [i for i in some if i not in capped]
            if not rest:
                break
            rate = (target[s] - most * sum(size[i] for i in capped)) / sum(measure[i] * size[i] for i in rest)
            over = {i for i in rest if rate * measure[i] >= most}
            if not over:
                break
            capped |= over
        share = {i: float(most) if i in capped else rate * measure[i] for i in some}
        out |= {i: math.floor(share[i]) for i in some}
        want = target[s] - sum(out[i] * size[i] for i in some)
        u = {i: (int(hashlib.md5(f"{i}:{mixing.SEED}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in some}
        p = {i: share[i] - out[i] for i in some}
        drawn = sorted((u[i] / (1 - u[i]) / (p[i] / (1 - p[i])), i) for i in some if 0 < p[i] < 1)
        up_to = 0
        for _, i in drawn:
            if up_to + size[i] / 2 > want:
                break
            out[i] += 1
            up_to += size[i]
    return out


def test_each_stage_agrees_with_a_plain_version(spark):
    g = np.random.default_rng(12)
    word = lambda: "".join(g.choice(list("abcdefghijk"), int(g.integers(2, 8))))
    rows = []
    for i in range(70):
        words = [word() for _ in range(int(g.integers(1, 90)))]
        if i % 5 == 4:  # a near copy or a copy of an earlier row, or almost one
            words = rows[i - 3][1].split()
            for at in g.integers(0, max(1, len(words)), int(g.integers(0, 4))):
                words[at] = word()
        rows.append((i, " ".join(words) + (f" token={word()}12345678 " + "ab12" * 9 if i % 6 == 0 else ""), "en", (None, "a", "b", "c", "d")[i % 5], 0))
    rows += [(80, "", "en", "a", 0), (81, None, "en", "e", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    text = {i: t for i, t, *_ in rows}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == plain_near_dups([(i, t) for i, t, *_ in rows])
    clean = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.hide_secrets(spark, docs, "").collect()}
    assert {i: t for i, (t, _) in clean.items()} == {i: t if t is None else plain_redaction(t) for i, t in text.items()}
    assert all(n == (None if t is None else len(t)) for t, n in clean.values()) and any("[secret:hex]" in (t or "") for t, _ in clean.values())
    assert Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, "").collect()) == Counter(plain_copies([(i, t, s) for i, t, _, s, _ in rows]))
    v = segmentation.load()
    for r in corpus_pipeline.encode(spark, docs, "").collect():
        assert v.decode(np.frombuffer(bytes(r.ids), "<u2").astype(np.int64)).decode() == (text[r.doc_id] or "") and r.round_trip


def test_the_quality_stage_keeps_what_the_network_keeps(spark, tmp_path):
    rows = [(i, ("good words in rows %d " % i) * 3 if i % 3 else "!!JUNK%d!! " % (i % 7) * 4, "en", "s", 0) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, str(tmp_path)).collect()}
    net = quality.train(docs, labels)
    assert kept == {i for (i, t, *_), s in zip(rows, quality.scores(net, [r[1].encode() for r in rows]), strict=True) if s >= quality.THRESHOLD} == {i for i in range(90) if i % 3}
    assert corpus_pipeline.keep_good(spark, docs.filter(F.lit(False)), str(tmp_path)).count() == 0


def test_stages_meet_awkward_rows_clashing_names_and_nothing(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(None, "a row without an id and with some words"), (None, None), (1, None), (2, ""), (3, " \n"), (4, long), (5, long), (6, "tie one two three four five six"), (6, "tie one two three four five six"), (7, "token = abcdefgh12345 in a text")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, size long, key string, node long"
    docs = spark.createDataFrame([(i, t, None, None, len(t or ""), "k", "s", 1, "x", 2) for i, t in rows], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    nothing = docs.limit(0)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs.write.parquet(f"{tmp_path}/{n}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{n}"), str(tmp_path))
        assert docs.columns == nothing.columns and stage(spark, nothing, str(tmp_path)).count() == 0, name
        got = [(r.doc_id, r.text) for r in docs.collect()]
        assert {r.kept for r in docs.collect()} == {"k"}, name
        if name == "quality":
            assert len(got) == len(rows)
        if name == "near_dups":
            assert Counter(i for i, _ in got) == {None: 2, 1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 7: 1}
        if name == "secrets":
            assert (1, None) in got and "abcdefgh12345" not in dict(got)[7]
        if name == "mixing":
            assert {(1, None), (2, ""), (None, None)} <= set(got)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert all(r.round_trip for r in out) and {r.n_pieces for r in out if r.doc_id in (1, 2)} == {0}
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, str(tmp_path)).count() == 0
