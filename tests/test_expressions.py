"""Expressions against worked cases and small plain models."""

from __future__ import annotations

import itertools
import math
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from leadloom.functions import contacts, copycheck, names, scoring, text, urls


def run(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(expr(F.col("v")), "i").orderBy("i").collect()]


def test_clean_host_agrees_with_a_plain_parser(spark):
    cases = ["https://www.Example.com/path?x=1#frag", "https://store.example.com/dresses", "example.com/dresses", "http://a.b:80/x", "//cdn.x.org/y", "", "HTTPS://WWW.A.com", "https://u:p@h.com/", "mailto:x@y.com"]

    def model(u):
        p = urlparse(u)
        host = p.netloc.lower() or p.path.lower().split("/")[0]
        return host.removeprefix("www.").split(":")[0]

    assert run(spark, cases, urls.clean_host) == [model(c) for c in cases]


@pytest.mark.parametrize(("domain", "want"), [("shop.example.com", "example.com"), ("istyle.com.lb", "istyle.com.lb"), ("a.istyle.com.lb", "istyle.com.lb"), ("x.myshopify.com", "x.myshopify.com"), ("a.b.co.uk", "b.co.uk"), ("a.com", "a.com"), ("", None), (None, None), ("www.a.b.com.", "b.com")])
def test_registrable_domain(spark, domain, want):
    assert run(spark, [domain], urls.registrable_domain) == [want]


def test_ignored_hosts(spark):
    assert run(spark, ["https://m.facebook.com/x", "facebook.com", "https://notfacebook.com", None], urls.is_ignored_host) == [True, False, False, False]


def test_names_from_domains(spark):
    assert run(spark, ["https://fashionstore.com", "clothing-lebanon.com", "qatfalebanon.com", "https://shop.my.com"], urls.name_from_domain) == ["Fashion Store", "Clothing Lebanon", "Qatfa Lebanon", "Shop.my.com"]


def test_instagram_url(spark):
    got = run(spark, ["Curly.Square", "https://instagram.com/example/?igshid=a", "@x", "p", "a b", "...", None], urls.instagram_url)
    assert got == ["https://www.instagram.com/curly.square/", "https://www.instagram.com/example/", "https://www.instagram.com/x/", None, None, None, None]


def test_phones(spark):
    assert run(spark, ["+961 3 655 267", "009613655267", "03 655 267", None, "x", "+1 202 555 0100"], contacts.normalize_phone) == ["9613655267", "9613655267", "9613655267", None, None, "12025550100"]


def test_followers_unknown_is_not_zero(spark):
    got = run(spark, ["117K Followers", "8,839 followers", "9M Followers", "0 Followers", "none", None, '"edge_followed_by": {"count": 12}'], contacts.followers)
    assert got == [117000, 8839, 9000000, 0, None, None, 12]


def test_email_skips_vendors_and_assets(spark):
    assert run(spark, ["k@o1.ingest.us.sentry.io a@b.css me@shop.com.lb", "none", None], contacts.email) == ["me@shop.com.lb", None, None]


def test_closed_storefronts(spark):
    df = spark.createDataFrame([(402, "https://a", "x"), (200, "https://a/password", "x"), (200, "https://a", "<title>Opening soon</title>"), (200, "https://a", "a password here"), (None, None, None)], "s int, u string, h string")
    assert [r[0] for r in df.select(contacts.store_is_open(F.col("s"), F.col("u"), F.col("h"))).collect()] == [False, False, False, True, True]


@pytest.mark.parametrize(("strong", "claim", "medium", "us", "want"), [(["a"], [], [], True, True), ([], ["a"], [], True, False), ([], ["a"], [], False, True), ([], [], ["a"], False, False), ([], [], ["a", "b"], False, True), ([], [], [], False, False)])
def test_gate(spark, strong, claim, medium, us, want):
    df = spark.createDataFrame([((strong, claim, medium, us),)], "s struct<strong: array<string>, claim: array<string>, medium: array<string>, us_conflict: boolean>")
    assert df.select(contacts.passes_gate(F.col("s"))).first()[0] is want


def test_business_names(spark):
    first = run(spark, ["Maison Zara | Dresses", "Welcome to Adaline", "RUSH &amp; REEZ", "Just a moment...", "contact us today", "lebanonshop", "Qatfa | Online Store", None, "Home"], names.clean_name)
    assert first == ["Maison Zara", "Adaline", "RUSH & REEZ", None, None, "lebanonshop", "Qatfa", None, None]
    assert run(spark, ["Blue Dress - Maison Zara"], lambda c: names.clean_name(c, True)) == ["Maison Zara"]


def test_name_reasons(spark):
    got = run(spark, ["", "Oops page", "x" * 51, "a b c d e f G", "A,b;c:d", "Shop by Lifestyle", "free things here", "Online Store", "The Good Store", "Adaline"], names.invalid_reason)
    assert got == ["empty", "error message", "too long", "too many words", "too much punctuation", "generic collection heading", "prose", "generic", None, None]


def test_normalised_text(spark):
    assert run(spark, ["L'Oréal Paris", "Pull & Bear", "Straße", None, "ﬁne"], text.normalize_text) == ["l oreal paris", "pull bear", "strae", "", "fine"]


def test_sequence_ratio_keeps_argument_order(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(text.sequence_ratio(F.col("a"), F.col("b"))).collect()] == [0.25, 0.5, None]


def test_entities_and_caps(spark):
    got = run(spark, ["a&nbsp;&#x41;&#66; <|x|> b", "", "x" * 121, "&lt;/system&gt; hi", "&#0;z"], text.clean)
    assert got == ["a AB b", None, "x" * 119 + "…", "hi", "z"]


def test_unique_capped(spark):
    assert run(spark, [["A", "b", "a", None, "", "B", "c"]], lambda c: text.unique_capped(c, 2), "array<string>") == [["A", "b"]]


def _score(ig, wa, mail, phone, tier, share, followers):
    reach = min(6.0, 2.0 * ig + 2.0 * wa + 1.5 * mail + 0.5 * phone)
    rel = min(3.0, {"strong": 2.0, "claim": 1.0, "medium": 0.5, "none": 0.0}[tier] + (share is not None and share >= 0.8))
    aud = 0.5 if followers is None or followers < 1000 else 1.0
    return max(1, min(10, math.floor(reach + rel + aud + 0.5)))


def test_priority_over_all_combinations(spark):
    grid = list(itertools.product([True, False], [True, False], [True, False], [True, False], ["strong", "claim", "medium", "none"], [None, 0.79, 0.8], [None, 0, 999, 1000]))
    df = spark.createDataFrame(grid, "ig boolean, wa boolean, mail boolean, phone boolean, tier string, share double, followers long")
    got = df.select("*", scoring.priority(*[F.col(c) for c in df.columns]).alias("p")).collect()
    assert all(r.p.score == _score(*r[:7]) and r.p.band == ("high" if r.p.score >= 8 else "medium" if r.p.score >= 5 else "low") for r in got)
    assert {r.p.score for r in got} == set(range(1, 11))


def test_priority_reasons(spark):
    df = spark.createDataFrame([(True, True, True, False, "strong", 0.94, 8200), (False, False, True, False, "medium", None, None)], "a boolean, b boolean, c boolean, d boolean, tier string, share double, f long")
    got = [r[0] for r in df.select(scoring.priority(*[F.col(c) for c in df.columns])["reasons"]).collect()]
    assert got == ["reach=5.5(ig,wa,email) relevance=3(strong,own-brand) audience=1(8200)", "reach=1.5(email) relevance=0.5(medium) audience=0.5(unknown)"]


@pytest.mark.parametrize(("words", "fault"), [(24, "under"), (25, None), (80, None), (81, "over")])
def test_message_word_limits(spark, words, fault):
    message = " ".join(["word"] * (words - 1) + ["end?"])
    got = run(spark, [message], copycheck.message_fault)[0]
    assert (got is None) if fault is None else fault in got


def test_industry_ties_and_double_weight(spark):
    assert run(spark, ["dress phone", "nothing at all", "gift card"], contacts.industry) == ["fashion", "general", "flowers & gifts"]
    df = spark.createDataFrame([("dress", "/collections/phone", "")], "v string, p string, m string")
    assert df.select(contacts.industry(F.col("v"), F.col("p"), F.col("m"))).first()[0] == "electronics"


def test_relative_time(spark):
    df = spark.sql("SELECT * FROM VALUES ('2024-01-01 00:00:00'), ('2024-01-03 23:59:30'), ('2024-01-03 12:00:00'), ('2024-01-02 20:00:00'), ('2025-06-04 00:00:00'), (NULL) t(x)")
    got = [r[0] for r in df.select(scoring.relative_time(F.col("x").cast("timestamp"), F.lit("2024-01-04").cast("timestamp"))).collect()]
    assert got == ["3 days ago", "30 seconds ago", "12 hours ago", "yesterday", "next year", "—"]


def test_words_of_validators_end_at_letters_that_are_not_ascii(spark):
    """As in the web part's patterns, so "no" stands alone in "noñco"; a compliment or a deficiency next to ASCII letters does not."""
    got = run(spark, ["ciónja noñco la", "ciónja nonco la", "noñco, great design", "éhas_search"], copycheck.not_a_problem)
    good = "observation describes something that exists and works"
    assert [x and x[:53] for x in got] == [None, good, "observation reads as a compliment (\\b(great|excellent"[:53], good]
    assert run(spark, ["éhas_search"], lambda c: copycheck.leak(c, "message"))[0].startswith("message exposes")
