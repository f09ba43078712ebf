"""The training-data operators against brute force, round trips and held-out rows, on small fixtures.

Every operator meets null ids and texts, empty and long texts, ties, repeated rows,
empty tables, and extra columns whose names clash with its own.
"""

from __future__ import annotations

import gzip
import hashlib
import itertools
import math
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadloom.llm import mixing, near_dups, neighbours, quality, secrets, segmentation, substring_dedup, suffix_sort, topk, urls, warc
from leadloom.llm.common import fresh_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n):
    g = np.random.default_rng(seed)
    return " ".join("".join(g.choice(list("abcdefgh"), 5)) for _ in range(n))


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 -------------------------------------------------------------------

def test_urls(spark):
    rows = [(1, "https://A.Example.NET/en/1?x", 9), (2, "http://x.org/fr/2#y", 9), (3, "http://x.net", 9), (4, "nothing", 9), (5, None, 9), (6, "http://b.example.com/de/5", 9), (6, "http://b.example.com/de/5", 9), (7, "ftp://org/fr/", 9), (8, "http://anet/x", 9)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, verdict long")).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[2] == ("x.org", "/fr/2", "org/fr/", "allow")
    assert got[3] == ("x.net", "", None, "allow") and got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("example.com/de/", "block") and got[7][2:] == ("org/fr/", "allow") and got[8][2:] == (None, "allow")


def brute_templates(rows):
    """{(host, segments): template} by plain recursion, and each template's (rows, labelled, blocked)."""
    from pyspark.sql import SparkSession

    of, stats = {}, {}
    shape = lambda segs: re.sub("[0-9]+", "0", re.sub(r"[^\W\d_]+", "a", "/".join(segs)))
    shapes = sorted({shape(segs[d:]) for _, segs, _ in rows for d in range(len(segs) + 1)})
    spark = SparkSession.active()
    bucket = {r.s: r.b for r in spark.createDataFrame([(x,) for x in shapes], "s string").select("s", F.pmod(F.xxhash64("s"), F.lit(urls.SUFFIX_BUCKETS)).alias("b")).collect()}

    def chi(part, pool):
        n, pool_n = sum(part.values()), sum(pool.values())
        return sum((part[c] - n * pool[c] / pool_n) ** 2 / (n * pool[c] / pool_n) for c in pool if n * pool[c])

    def grow(own, d, prefix):
        ends = [r for r in own if len(r[1]) == d]
        own = [r for r in own if len(r[1]) > d]
        of.update({(r[0], r[1]): prefix for r in ends})
        if len({r[1] for r in own}) == 1:
            of[own[0][0], own[0][1]] = prefix + "/" + "/".join(own[0][1][d:])
        elif own:
            kids = {}
            for r in own:
                kids.setdefault(r[1][d], []).append(r)
            after = lambda rs: Counter(bucket[shape(r[1][d + 1 :])] for r in rs)
            labels = lambda rs: Counter(r[2] for r in rs if r[2] is not None)
            variable = len(kids) >= 5 and 2 * sum(len(k) == 1 for k in kids.values()) >= len(own)
            stars = [s for s, k in kids.items() if len(kids) > 1 and (variable or len(k) >= 5 and chi(after(k), after(own)) < 24.32 and chi(labels(k), labels(own)) < 10.83)]
            if stars:
                grow([r for s in stars for r in kids[s]], d + 1, prefix + "/*")
            for s in kids.keys() - set(stars):
                grow(kids[s], d + 1, prefix + "/" + s)

    for host in {r[0] for r in rows}:
        grow([r for r in rows if r[0] == host], 0, "")
    for h, segs, label in rows:
        x = stats.setdefault((h, of[h, segs]), [0, 0, 0])
        x[0] += 1
        x[1] += label is not None
        x[2] += label == 1
    return of, stats


def test_templates_agree_with_plain_recursion(spark):
    g = np.random.default_rng(4)
    paths = []
    for host in ("a", "b", "c"):
        for _ in range(150):
            kind = g.integers(0, 7)
            x = int(g.integers(0, 40))
            paths.append((host, [f"/ads/item/{x}", f"/news/{x}.html", f"/blog/item/{x}/", f"/shop/item/{x}", f"/u/{x}/posts/{x % 3}", "/", f"/é/ü{x}/" + "deep/" * int(g.integers(0, 12))][kind], [1, 0, None, None, None, None, 1][kind] if host != "c" else None))
    paths += paths[:20] + [("a", "/once/" + "x/" * 400, None), ("", "", None)]
    want, stats = brute_templates([(h, tuple(x for x in p.split("/") if x), v) for h, p, v in paths])
    got = urls.path_templates(spark.createDataFrame(paths, "host string, path string, label int")).collect()
    assert {(r.host, tuple(x for x in r.shape.split("/") if x)): r.template for r in got} == want and len(got) == len(want)
    assert all(stats[r.host, r.template] == [r.t_rows, r.t_labelled, r.t_blocked] for r in got)
    assert any("*" in t for t in want.values())


def test_templates_decide_for_urls_without_a_rule(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{lang}/{i}", 0) for i in range(400) for lang in ("de", "en")] + [(i, f"http://x.org/{lang}/{i}", 0) for i in range(50) for lang in ("fr", "es")] + [(1000, "http://h0.example.com/about/us/now", 0)]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, template long")).collect()
    said = {(r.host, r.path.split("/")[1], r.rule is None): r.verdict for r in got}
    assert said["h0.example.com", "en", True] == "block" and said["x.org", "es", True] == "allow" and said["h0.example.com", "about", True] == "allow"
    none = urls.filter_urls(spark.createDataFrame([], "page_id long, url string"))
    assert none.count() == 0 and none.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]


# --- 2 -------------------------------------------------------------------

def brute_base(text):
    out = []
    for kind, (p, flags, least, group) in enumerate(((r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, 8, 2), (r"AKIA[A-Z0-9]+", 0, 16, 0), (r"[0-9a-f]+", 0, 32, 0))):
        out += [(m.start(), kind, m.end()) for m in re.finditer(p, text, flags) if len(m[group]) >= least]
    return sorted(out)


SECRETS = ["", None, 'token = "abcdefgh1"', "PASSWORD:short then Api_Key='x1y2z3w4v5'", "AKIA" + "A1" * 8 + " AKIAshort", "a" * 31 + " " + "b" * 32, "paſſword=longenough1 Key", 'x = "S3cr3tValue99"\nprivate_key = x', "db:\n  auth: Zx9_kLmN0pQr\nname: plain", "é token: éabcdefgh"]


def test_secret_spans_agree_with_the_patterns(spark):
    for t in SECRETS:
        assert secrets.base_spans(t or "") == brute_base(t or "")
    got = {r.doc_id: r for r in secrets.scan_secrets(docs_of(spark, list(enumerate(SECRETS)) + [(None, "token=abcdefghi")])).collect()}
    for i, t in enumerate(SECRETS):
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in brute_base(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[None].n_assign == 1 and secrets.scan_secrets(empty(spark)).count() == 0


def test_constants_are_followed():
    assert [SECRETS[7][a:b] for a, b in secrets.lexed_spans(SECRETS[7])] == ["S3cr3tValue99"]
    assert [SECRETS[8][a:b] for a, b in secrets.lexed_spans(SECRETS[8])] == ["Zx9_kLmN0pQr"]
    assert secrets.lexed_spans("the key: is under the mat. token = undefined") == []
    assert secrets.redact('a token = "abcdefgh1" b') == 'a [secret:assign]" b'
    assert secrets.lexed_spans("salt = a1\na1 = a2\na2 = a1\n") == []  # a circle


def test_lexed_spans_of_written_code():
    """Statements are written with the spans that they must give."""
    g = np.random.default_rng(8)
    letters = list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789")
    value = lambda: "x7" + "".join(g.choice(letters, 14))
    for _ in range(60):
        text, want, constants = "", set(), {}
        for n in range(25):
            v, w = value(), value()
            name = str(g.choice(["private_key", "authSalt", "bearer", "cookie"]))
            plain = str(g.choice(["colour", "title", "width"]))
            kind = int(g.integers(0, 13))
            before, literal, after, hit = [
                (f'{name} = "', v, '"\n', True), (f"  {name}: ", v, "\n", True), (f'"{name}": "', v, '",\n', True), (f"<{name}>", v, f"</{name}>\n", True), (f"run --{name} ", v, " now\n", True),
                (f"<x {name}='", v, "'/>\n", True), (f"{name} = ('", f"{v}' # first\n   '{w}", "')\n", True), (f'{name} := "', f'{v}"\n  + "{w}', '"\n', True), (f'{name} = r"""', v, '"""\n', True),
                (f"{plain} = '", v, "'\n", False), (f"# {name} = ", v, " # old\n", True), (f"const{n} = '", v, "'\n", None), (f"{name} = const{int(g.integers(0, 25))}\n", "", "", None),
            ][kind]
            at = len(text) + len(before)
            text += before + literal + after
            if hit:
                want.add((at, at + len(literal)))
            elif kind == 11:
                constants[f"const{n}"] = (at, at + len(literal))
        want |= {constants[c] for c in re.findall(r"= (const\d+)\n", text) if c in constants}
        assert set(secrets.lexed_spans(text)) == want


@pytest.mark.parametrize("text", ["a" * 1_000_000 + " x=1", 'x="' * 200_000, "\\\"x='" * 200_000, "-" * 1_000_000, "token" + " " * 1_000_000 + "<a>" * 100_000, "a = 'x'\n# c\n" * 60_000])
def test_scans_take_time_in_proportion(text):
    import time

    began = time.process_time()
    secrets.scan(text)
    assert time.process_time() - began < 20  # a scan that is quadratic would take hours


def test_secret_scans_keep_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "token=abcdefghi", 5), (1, "token=abcdefghi", 5), (None, None, 6), (3, "x" * 300_000 + " token=abcdefghi", 7)], "doc_id long, text string, spans long")
    got = secrets.scan_secrets(df).collect()
    assert Counter(r.n_assign for r in got) == Counter({1: 3, 0: 1}) and len({r.spans for r in got if r.doc_id == 1}) == 1
    assert secrets.redact_secrets(df).columns == df.columns and Counter(r.spans for r in secrets.redact_secrets(df).collect()) == Counter({5: 2, 6: 1, 7: 1})


# --- 3 -------------------------------------------------------------------

def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    part = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            part = [part[a] if x == part[b] else x for x in part]
    return {(i, len(s), min(rows[k][0] for k in range(len(rows)) if part[k] == part[j])) for j, ((i, _), s) in enumerate(zip(rows, sets, strict=True))}


def near_rows():
    rows, g = [], np.random.default_rng(5)
    for base in range(3):
        words = prose(base, 120).split()
        for k in range(12):
            w = list(words)
            for at in g.integers(0, len(w), int(g.integers(0, 4))):
                w[at] = f"new{base}{k}{at}"
            rows.append((100 * base + k, " ".join(w)))
    return [*rows, (900, ""), (901, None), (902, "One Two"), (903, "one  two\n"), (904, "one two three four five"), (905, " "), (0, rows[0][1])]


def test_near_duplicates_agree_with_brute_force(spark):
    rows = near_rows()
    for n in (1, 6):
        got = near_dups.near_duplicates(docs_of(spark, rows).repartition(n)).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == len(rows)


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    assert near_dups.near_duplicates(empty(spark)).count() == 0
    kept = near_dups.one_of_each(docs_of(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, 1]


def test_blocks_join_what_pivots_leave(spark, monkeypatch):
    """Many overlapping groups around the threshold, in blocks of a few nodes."""
    rows, g = [], np.random.default_rng(9)
    for base in range(2):
        words = prose(70 + base, 200).split()
        for k in range(40):
            w = list(words)
            for at in g.choice(len(w), int(g.integers(2, 6)), replace=False):
                w[at] = f"new{base}{k}{at}"
            rows.append((100 * base + k, " ".join(w)))
    monkeypatch.setattr(near_dups, "SLICE", 4)
    got = near_dups.near_duplicates(docs_of(spark, rows)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_one_of_each_with_repeats_and_clashing_names(spark):
    long = prose(3, 30_000)
    rows = [(1, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "a b c d e f", 2), (3, "x y", 3), (3, "x z", 4), (3, "x y", 3), (4, long, 5), (5, long + " end", 6), (None, None, 7), (None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, nd_place long").withColumn("row", F.lit(1)).withColumn("node", F.lit(2))
    got = near_dups.one_of_each(df)
    assert got.columns == df.columns and Counter(r.doc_id for r in got.collect()) == Counter({1: 1, 3: 1, 4: 1, None: 2})
    none = df.limit(0)
    assert near_dups.one_of_each(none).count() == 0


def test_registers_merge_and_estimate():
    g = np.random.default_rng(0)
    x, y = g.integers(0, 2**63, 900).astype(np.uint64), g.integers(0, 2**63, 100).astype(np.uint64)
    a, b = np.unique(np.append(x, y[:50])), np.unique(np.append(x, y[50:]))
    ra, rb = near_dups.registers(a), near_dups.registers(b)
    assert (near_dups.merged(ra, rb) == near_dups.registers(np.union1d(a, b))).all()
    j = near_dups.likely_similarity(np.array([950.0]), np.array([950.0]), np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]))[0]
    assert abs(j - 0.9) < 0.1


# --- 4 -------------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    texts = [(i, prose(i, 60).upper().replace(" ", "!! ") if i % 3 == 0 else prose(i, 60)) for i in range(240)]
    rows = [*texts, (1000, ""), (1001, None), (None, prose(1, 9))]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, _ in texts] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(docs_of(spark, rows), labels).collect()}
    held = [r for i, r in got.items() if r.held_out and i is not None and i < 240]
    assert len(held) > 20 and np.mean([r.predicted == int(r.doc_id % 3 != 0) for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(docs_of(spark, [(1, "x"), (2, None)]), none).collect()} == {0.5}


def test_long_texts_are_pooled_whole(monkeypatch):
    net, text = quality.fresh_net(), (prose(1, 400) + "!!" + prose(2, 400)).encode()
    whole = quality.pooled(net, [text, b"", b"a"])
    monkeypatch.setattr(quality, "PIECE", 256)
    assert np.allclose(quality.pooled(net, [text, b"", b"a"]), whole, atol=1e-5)


def plain_score(net, text):
    """The network by loops over places."""
    b = np.frombuffer(text, np.uint8)
    places = max(1, -(-len(b) // quality.EACH))
    byte = lambda j: int(b[j]) if 0 <= j < len(b) else 0
    gram = lambda j: bytes(byte(j + m) for m in range(4))
    again = lambda j: any(gram(j) == gram(j - lag) for lag in range(1, quality.LAGS + 1)) and gram(j) != b"\0\0\0\0"

    def chunk(at):
        z = net.b + sum(net.w[k, byte(at + k)] for k in range(quality.CHUNK)) + net.r * (sum(again(at + k) for k in range(quality.CHUNK)) / quality.CHUNK)
        return np.maximum(z, 0)

    top = np.zeros(quality.SECOND)
    for p in range(places):
        wide = np.concatenate([chunk(p * quality.EACH + s * quality.STEP) for s in range(quality.SPAN)])
        top = np.maximum(top, wide @ net.v + net.c)
    return 1 / (1 + np.exp(-(top @ net.u + net.d[0])))


def test_scores_agree_with_plain_loops():
    net = quality.fit([prose(i, 30).encode() if i % 2 else (b"spam! " * 30) for i in range(24)], [i % 2 for i in range(24)], epochs=2)
    texts = [b"", b"a", prose(1, 40).encode(), "é日本 x".encode() * 9, b"line\nline\n" * 12, prose(2, 3).encode()]
    assert np.allclose(quality.scores(net, texts), [plain_score(net, t) for t in texts], atol=1e-4)


def test_gradients_agree_with_differences(monkeypatch):
    net, texts, y = quality.fresh_net(3), [prose(1, 20).encode(), b"x" * 90, prose(5, 60).encode()], np.array([1, 0, 1], np.float32)
    loss = lambda: float(-np.mean(np.log(np.where(y == 1, s := 1 / (1 + np.exp(-(quality.pooled(net, texts).astype(float) @ net.u + net.d))), 1 - s))))
    got = quality._gradients(net, texts, y)
    for part, grad in zip(net.parts(), got, strict=True):
        for at in np.argsort(-np.abs(grad.ravel()))[:3]:  # the largest
            x = part.ravel()
            old, step = x[at], 1e-3
            x[at] = old + step
            up = loss()
            x[at] = old - step
            down = loss()
            x[at] = old
            assert abs((up - down) / (2 * step) - grad.ravel()[at]) < 0.1 * abs(grad.ravel()[at]) + 1e-3
    monkeypatch.setattr(quality, "PIECE", 128)
    monkeypatch.setattr(quality.buffers, "__defaults__", (128,))
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(got, quality._gradients(net, texts, y), strict=True))


def test_quality_of_nothing_repeats_and_clashing_names(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1)] * 5, "doc_id long, quality int")
    rows = [(i, prose(i, 20) if i % 2 else "JUNK " * 20, 5) for i in range(60)] + [(3, prose(3, 20), 5)] * 30 + [(None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score long").withColumn("quality", F.lit(7)).withColumn("held_out", F.lit(1))
    got = quality.score_quality(df, labels).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 3}) == 1
    again = quality.score_quality(df.repartition(5), labels).collect()
    assert {(r.doc_id, round(r.score, 4)) for r in got} == {(r.doc_id, round(r.score, 4)) for r in again}
    assert quality.good_documents(df, labels).columns == df.columns
    assert quality.score_quality(empty(spark), labels).count() == 0


# --- 5 and 9 -------------------------------------------------------------

def vectors(spark, n=300, dim=8):
    g = np.random.default_rng(3)
    x = g.normal(size=(n, dim)).astype("f4")
    x[10:60] = x[10]  # ties
    rows = [(int(i), [float(v) for v in x[i]], 1) for i in range(n)]
    odd = [(1000, None, 1), (1050, [None] * dim, 1), (1100, [float("nan")] * dim, 1), (1150, [0.0] * dim, 1), (1200, [], 1), (None, [1.0] * dim, 1), (100, rows[100][1], 1), (1300, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int"), x


def test_exact_top_k(spark):
    df, x = vectors(spark)
    z = np.floor(x.astype("f8") * 256).astype(int)
    want = {}
    ids = [*range(300), 1150, 100]
    z = np.vstack([z, np.zeros((1, 8), int), z[100]])
    for q in [*range(0, 300, 50), 1150]:
        own = z[ids.index(q)]
        want[q] = sorted(((-int(own @ z[j]), i) for j, i in enumerate(ids) if i != q))[:5]
    got = {}
    for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (-r.score, r.vec_id)
    got.pop(1300, None)
    assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == want


def test_exact_products_beyond_doubles():
    x = np.array([[2.0**40, 1.0]])
    assert topk._products(x, x)[0, 0] == 2**63 - 1 and topk._products(x, np.array([[1.0, 1.0]]))[0, 0] == 2**40 + 1


def test_neighbours_of_a_shard_that_holds_none_within_the_bound(monkeypatch):
    """A copy in another shard bounds the distance by 0: no prefix range of this shard need hold a row."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 16)).astype("f4"), rng.normal(size=(200, 16)).astype("f4")
    y[:5] = x[45:]
    ids, extra = np.arange(200) + 1000, neighbours.plant(y)
    ask = lambda bound: neighbours.forest_search(np.arange(50), x, ids, y, extra, 3, np.full(50, bound))
    at, found, dist = ask(0.0)
    assert at.tolist() == [45, 46, 47, 48, 49] and found.tolist() == ids[:5].tolist() and not dist.any()
    whole = ask(np.inf)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    assert [z.tolist() for z in ask(np.inf)] == [z.tolist() for z in whole] and len(whole[0]) == 150


def test_neighbours_recall_and_ties(spark):
    df, x = vectors(spark)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(got) == {0, 100, 200} and all([k for k, _, _ in sorted(v)] == list(range(1, 11)) for v in got.values())
    hit = 0
    for q, v in got.items():
        d = np.sqrt(((x.astype("f8") - x[q].astype("f8")) ** 2).sum(axis=1))
        true = sorted((d[i], i) for i in range(300) if i != q)[:10]
        hit += len({i for _, i in true} & {i for _, _, i in v})
        assert all(s == d[i] for _, s, i in v) and [(s, i) for _, s, i in sorted(v)] == sorted((s, i) for _, s, i in v)
    assert hit >= 27


def test_forest_recall_and_candidates():
    g = np.random.default_rng(1)
    x = g.normal(size=(4000, 16)) + 12 * g.normal(size=(60, 16))[g.integers(0, 60, 4000)]
    ids, q, looked = np.arange(4000), np.arange(0, 4000, 100), []
    at, found, _ = neighbours.forest_search(ids[q], x[q], ids, x, neighbours.plant(x), 10, np.full(len(q), np.inf), looked=looked)
    hit = 0
    for j, i in enumerate(q):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hit += len(set(np.argsort(d)[:10]) & set(found[at == j]))
    assert hit / (10 * len(q)) >= 0.9 and sum(looked) < 0.1 * 4000 * len(q)  # groups that are apart are found without looking at the rest


def test_blocks_are_left_where_bounds_allow_it():
    g = np.random.default_rng(2)
    x = np.repeat(g.normal(size=(32, 16)), 128, axis=0) + 0.05 * g.normal(size=(4096, 16))
    ids, scored = np.arange(4096), []
    q = np.arange(0, 4096, 50)
    at, found, got = topk.block_search(ids[q], x[q], ids, x, b"", 5, np.full(len(q), -np.inf), scored)
    z = np.floor(x * 256)
    for j, i in enumerate(q):
        s = (z @ z[i]).astype(int)
        assert list(zip(-got[at == j], found[at == j], strict=True)) == sorted((-s[c], c) for c in range(4096) if c != i)[:5]
    assert sum(scored) < 0.2 * 4096 * len(q)


def test_searches_in_several_shards_and_chunks(spark, monkeypatch):
    from leadloom.llm import vectors as shared

    df, _ = vectors(spark)
    one = {r.query_id: [] for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()}
    whole = sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()))
    monkeypatch.setattr(shared, "SHARD", 64)
    monkeypatch.setattr(shared.packed, "__defaults__", (shared.packed.__defaults__[0], 64))
    monkeypatch.setattr(shared, "CHUNK_BYTES", 1)
    assert sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect())) == whole and one
    assert neighbours.nearest(df, F.col("vec_id") % 100 == 0).groupBy("query_id").count().filter("count = 10").count() == 3


def test_vector_searches_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.exact_top_k(none, F.col("vec_id") % 50 == 0).count() == 0 and neighbours.nearest(none, F.col("vec_id") % 100 == 0).count() == 0


# --- 6 -------------------------------------------------------------------

def brute_targets(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_mixing_targets_and_taken_words(spark):
    g = np.random.default_rng(2)
    rows = [(i, prose(i, int(g.integers(1, 40))), "x", ["hot", "hot", "a", "b", None][i % 5], 0) for i in range(1000)] + [(5000, None, "x", "empty", 0), (5001, "  ", "x", "empty", 0), (7, prose(7, 9), "x", "a", 0), (None, "w w", "x", "b", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = [r.asDict() for r in mixing.mixed_sizes(df).collect()]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = brute_targets(dict(sizes))
    by_size = {}
    for r in got:
        by_size.setdefault((r["source_size"], round(r["target"], 6)), []).append(r)
    assert {(sizes[s], round(t, 6)) for s, t in want.items()} == set(by_size)
    assert all(abs(sum(r["taken"] for r in rs) - t) <= 40 for (_, t), rs in by_size.items())
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got) and len(got) == len(rows)
    again = [r.asDict() for r in mixing.mixed_sizes(df.repartition(7)).collect()]
    order = lambda r: (r["doc_id"] or -1, r["size"], r["taken"], r["target"])
    assert sorted(got, key=order) == sorted(again, key=order)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in got)
    assert mixing.mixed_sizes(empty(spark)).count() == 0


def test_inclusion_follows_each_documents_own_probability(spark):
    g = np.random.default_rng(6)
    rows = [(i, "w " * (3 if i % 2 else 60), "x", "a" if i < 2400 else "b", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    plan = {(r.mix_source, r.k): r for r in mixing.mixing_plan(df)[1].collect()}
    got = mixing.mixed_sizes(df).collect()
    for source, k, size in (("a", 1, 3), ("a", 3, 60), ("b", 1, 3), ("b", 3, 60)):
        own = [r.taken // r.size for r in got if r.size == size and (r.doc_id < 2400) == (source == "a")]
        p = plan[source, k]
        assert abs(np.mean(own) - (p.whole + p.p)) < 0.06 and set(own) <= {p.whole, p.whole + 1}
    assert plan["a", 3].whole + plan["a", 3].p == pytest.approx(min(3, 4 * (plan["a", 1].whole + plan["a", 1].p)))  # by their measures
    ids = {r.doc_id for r in got if r.taken} ^ {r.doc_id for r in mixing.mixed_sizes(df, seed=int(g.integers(100, 200))).collect() if r.taken}
    assert ids


def test_mixing_with_many_sources_repeats_and_clashing_names(spark):
    rows = [(i % 40, "w " * (i % 9), f"s{i % 60}", 0, 0, 0.5, "r") for i in range(900)] + [(7, "w w w", "s1", 0, 0, 0.5, "r")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, k long, size long, u double, row string")
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(r[1].split())
    got = mixing.mixed_sizes(df.repartition(3)).collect()
    want = brute_targets(dict(sizes))
    assert len(got) == len(rows) and sum({(r.source_size, round(r.target, 6)): 0 for r in got}.values()) == 0
    assert {(sizes[s], round(t, 6)) for s, t in want.items()} == {(r.source_size, round(r.target, 6)) for r in got}
    assert len({r.taken for r in got if r.doc_id == 7 and r.size == 3 and r.source_size == sizes["s1"]}) == 1
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r.taken for r in got)
    assert mixing.mixed_documents(empty(spark)).count() == 0


# --- 7 -------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return segmentation.load()


def all_segmentations(v, text):
    s = "▁" + text.replace("▁", "\ud800").replace(" ", "▁")
    plain = {x.decode().replace(" ", "▁"): i for i, x in enumerate(v.raw) if x and i not in set(v.byte_ids.tolist())}
    out = {}

    def go(i, ids, p):
        if i == len(s):
            out[tuple(ids)] = p
            return
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in plain:
                go(j, [*ids, plain[s[i:j]]], p + v.log_p[plain[s[i:j]]])
        if s[i] not in plain:
            b = [int(v.byte_ids[x]) for x in ("▁" if s[i] == "\ud800" else s[i]).encode()]
            go(i + 1, ids + b, p + sum(v.log_p[b]))

    go(0, [], 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {k: x - z for k, x in out.items()}


@pytest.mark.parametrize("text", ["the", "is it\n", "é▁ç x", "a  b"])
def test_samples_are_without_replacement(vocabulary, text):
    want, n, first, pairs = all_segmentations(vocabulary, text), 3000, Counter(), Counter()
    for i, group in itertools.groupby(segmentation.sample_batch(vocabulary, range(n), [text] * n, 3), key=lambda r: r[0]):
        rows = list(group)
        ids = [tuple(r[2].tolist()) for r in rows]
        assert len(set(ids)) == len(ids) == min(3, len(want)) and all(abs(want[x] - r[3]) < 1e-8 for x, r in zip(ids, rows, strict=True))
        assert [r[4] for r in rows] == sorted((r[4] for r in rows), reverse=True)
        first[ids[0]] += 1
        pairs[tuple(ids[:2])] += 1
    for x, p in want.items():
        assert abs(first[x] / n - math.exp(p)) < 0.03
    for x, y in itertools.permutations(sorted(want, key=want.get)[-3:], 2):
        assert abs(pairs[x, y] / n - math.exp(want[x] + want[y]) / max(1e-12, 1 - math.exp(want[x]))) < 0.04 or math.exp(want[x]) > 0.99


def test_segmentation_round_trip(spark, vocabulary):
    texts = ["", None, " ", "hello  world\n\n x", "▁literal ▁▁", "日本 \U0001f600 é", "x" * 3000, prose(1, 300), prose(1, 300)]
    df = docs_of(spark, list(enumerate(texts)) + [(7, prose(1, 300))])
    got = segmentation.sample_segmentations(df, k=2)
    rows = got.collect()
    assert all(r.round_trip for r in rows) and Counter(r.doc_id for r in rows)[0] == 1 and Counter(r.doc_id for r in rows)[7] == 4
    back = {r.doc_id: r.text for r in segmentation.decode(got.filter("sample = 0")).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert {(r.doc_id, r.sample, tuple(r.ids)) for r in segmentation.sample_segmentations(df.repartition(5), k=2).collect()} == {(r.doc_id, r.sample, tuple(r.ids)) for r in rows}


def test_blocks_and_forgotten_lattices_do_not_matter(monkeypatch, vocabulary):
    args = (vocabulary, list(range(40)), [prose(i % 7, 60 + i) for i in range(40)], 3)
    whole = [(r[0], r[1], r[2].tolist(), r[3:]) for r in segmentation.sample_batch(*args)]
    monkeypatch.setattr(segmentation, "BLOCK", 900)
    book = segmentation.Book(vocabulary, kept=1500)
    assert [(r[0], r[1], r[2].tolist(), r[3:]) for r in segmentation.sample_batch(*args, book=book)] == whole


def test_chunks_with_one_hash_are_told_apart(monkeypatch, vocabulary):
    texts = [prose(i, 40) for i in range(6)]
    want = [r[2].tolist() for r in segmentation.sample_batch(vocabulary, range(6), texts, 2)]
    real = segmentation.mix
    book = segmentation.Book(vocabulary)
    monkeypatch.setattr(segmentation, "mix", lambda x: real(x) if book.salt else real(x) & np.uint64(3))
    book.look_up(texts)
    assert book.salt == 1
    monkeypatch.setattr(segmentation, "mix", real)
    assert [r[2].tolist() for r in segmentation.sample_batch(vocabulary, range(6), texts, 2, book=book)] == want


def test_segmentation_of_nothing_and_of_clashing_columns(spark):
    assert segmentation.sample_segmentations(empty(spark)).count() == 0
    rows = [(1, "some words", 5, 6), (None, "x", 5, 6), (1, "some words", 5, 6)]
    got = segmentation.sample_segmentations(spark.createDataFrame(rows, "doc_id long, text string, key long, sample long"), packed=True).collect()
    assert {r.doc_id for r in got} == {1, None} and all(r.round_trip for r in got) and len({bytes(r.ids) for r in got if r.doc_id == 1}) == 2


# --- 8 -------------------------------------------------------------------

def test_archives_round_trip(spark):
    rows = [(1, "http://a", "x\r\n\r\nWARC/1.1\r\n", 7), (2, "http://b", "x\r\n\r\nWARC/1.1\r\n", 7), (3, None, None, 7), (4, "u\r\nEvil: 1", "", 7), (5, "e", "é" * 2000, 7), (None, "n", "", 7), (2, "http://b", "x\r\n\r\nWARC/1.1\r\n", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n long")
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages.select("page_id", "url", "html"), path)
    got = warc.read_archives(spark, path, with_payload=True).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter({(1, "revisit", 2): 1, (2, "response", None): 2, (3, "revisit", 4): 1, (4, "response", None): 1, (5, "response", None): 1, (None, "response", None): 1})
    html = {i: (h or "").encode() for i, _, h, _ in rows}
    for r in got:
        assert bytes(r.payload) == html[r.page_id] and r.payload_bytes == len(html[r.page_id]) and r.payload_digest == __import__("base64").b32encode(hashlib.sha1(html[r.page_id]).digest()).decode()
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("small", [500_000, 0])
def test_archives_of_awkward_payloads(spark, monkeypatch, small):
    monkeypatch.setattr(warc, "SMALL", small)
    texts = ["a\r\n", "\r\n", "\r\n\r\n", "\r\n\r\n\r\n", "b\r\n\r\n\r\n\r", "\r", "\n", "", "x" * 3_000_000, "é\r\n\r\né"]
    rows = [(i, f"http://h/{i}", t, 1) for i, t in enumerate(texts * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long").repartition(3)
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages, path, per_file=4)
    got = {r.page_id: r for r in warc.read_archives(spark, path, with_payload=True).collect()}
    n = len(texts)
    assert len(got) == 2 * n and all(bytes(got[i].payload) == texts[i % n].encode() for i in got)
    assert all((got[i].record_type, got[i].refers_to) == (("revisit", i + n) if i < n else ("response", None)) for i in got)
    kinds = Counter(h["WARC-Type"] for f in spark.read.format("binaryFile").load(path).select("content").collect() for h, _ in warc.parse_records(gzip.decompress(f.content).removesuffix(b"\r\n\r\n").split(b"\r\n\r\n")))
    assert kinds == Counter(response=n, revisit=n, warcinfo=1)


# --- 10 ------------------------------------------------------------------

def brute_removed(rows):
    first, out = {}, []
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - 49 if i is not None else 0):
            first[b[s : s + 50]] = min(i, first.get(b[s : s + 50], i))
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49 if i is not None else 0):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return Counter(out)


def test_repeats_agree_with_brute_force(spark):
    shared = prose(1, 30)
    rows = [(i, prose(10 + i, 20) + shared[: 60 + i] + prose(50 + i, 20)) for i in range(12)] + [(20, shared), (21, shared), (21, shared), (22, shared[:49]), (23, shared[:50]), (24, ""), (25, None), (None, shared), (26, "é" * 100), (27, "é" * 60), (28, "a" * 300), (29, "a" * 400)]
    df = docs_of(spark, rows).withColumnRenamed("n_chars", "id")
    want = brute_removed(rows)
    for common in (None, "all"):
        if common == "all":
            common = np.unique(np.concatenate([h >> np.uint64(16) for _, _, h, _, _ in __import__("leadloom.llm.anchors", fromlist=["x"]).anchors([(t or "").encode() for _, t in rows])]))
        assert Counter(map(tuple, substring_dedup.remove_repeats(df.repartition(5), common=common).collect())) == want
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_deep_shallow_orders_like_sorting():
    g = np.random.default_rng(0)
    x = g.integers(97, 99, (600, 50)).astype(np.uint8)
    x[200:400, :40] = x[0, :40]
    x[400:420] = x[0]
    group = g.integers(0, 3, 600).astype(np.uint64)
    order, common = suffix_sort.deep_shallow(group, x)
    rows = [(int(group[i]), x[i].tobytes()) for i in order]
    assert rows == sorted(rows)
    for a in range(1, 600):
        same = rows[a][0] == rows[a - 1][0]
        assert common[a] == (next((j for j, (p, q) in enumerate(zip(rows[a][1], rows[a - 1][1], strict=True)) if p != q), 50) if same else -1)


def test_long_texts_in_pieces(monkeypatch):
    from leadloom.llm import anchors

    text = prose(3, 900).encode()
    whole = [(int(h), int(p)) for _, _, hs, _, ps in anchors.anchors([text]) for h, p in zip(hs, ps, strict=True)]
    monkeypatch.setattr(anchors, "PIECE", 700)
    assert sorted((int(h), int(p)) for _, _, hs, _, ps in anchors.anchors([text]) for h, p in zip(hs, ps, strict=True)) == sorted(whole)


def test_contexts_with_the_same_high_bits_of_hash_are_told_apart(monkeypatch):
    rng = np.random.default_rng(5)
    shared = bytes(rng.integers(97, 123, 64, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 123, 200, dtype=np.uint8)) + shared + bytes(rng.integers(97, 123, 200, dtype=np.uint8)) for _ in range(40)]
    real = substring_dedup.hash_at
    monkeypatch.setattr(substring_dedup, "hash_at", lambda *a: real(*a) & np.uint64(0xFFFFFF))  # 40 high bits alike
    batch = pa.record_batch([pa.array(range(40), pa.int64()), pa.array(range(40), pa.int64()), pa.array([t.decode() for t in texts])], names=["key", "id", "text"])
    none = np.empty(0, "u8")
    found = pa.Table.from_batches(list(substring_dedup._find(iter([batch]), 1, none)))
    got = substring_dedup._settle(found, none).to_pylist()
    assert any(r["want"] for r in got) and not any(r["full"] for r in got)


def test_words_that_a_worker_keeps_take_few_bytes():
    near_dups._words.clear()
    found = near_dups.shingles(" ".join(f"word{i}" for i in range(300_000)))
    held = sum(sys.getsizeof(x) for pair in near_dups._words.items() for x in pair) + sys.getsizeof(near_dups._words)
    assert len(found) == 299_996 and held < 12 << 20
