"""Operators on small tables of our own, and invariance under partitioning."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from leadloom import literals as L
from leadloom import queries as Q
from leadloom.functions import markup
from leadloom.operators import brands, catalogue, discover, evidence, grounding, identity, reads
from leadloom.plans import analysis, lead_run
from leadloom.sources import store
from leadloom.sources.readers import BrandListError, brand_table
from leadloom.sources.schemas import ANALYSES, CANDIDATES, LEADS, REJECTED


def test_discovery_order_and_exhaustion(spark):
    rows = [(0, "a", 2, 1, "https://y1.com/late", "L", False), (0, "a", 1, 1, "https://www.y1.com/a", "A", False), (0, "a", 3, 0, None, None, True), (0, "a", 4, 1, "https://never.com", "N", False), (1, "b", 1, 1, "https://y1.com/b", "B", False)]
    for n in (1, 5):
        got = discover.candidates(spark.createDataFrame(rows, CANDIDATES).repartition(n)).collect()
        assert [(r.domain, r.title) for r in got] == [("y1.com", "A")]


def test_vendor_ties_go_to_the_first_seen(spark):
    body = json.dumps({"products": [{"vendor": " B "}, {"vendor": "A"}, {"vendor": ""}, {"vendor": "A"}, {"vendor": "B"}, {"title": "x"}]})
    rows = spark.createDataFrame([("s", body), ("t", "not json"), ("u", '{"products": 5}'), ("v", None)], "site string, body string")
    got = catalogue.dominant_vendors(catalogue.parse_products(rows, "site", "body")).collect()
    assert [(r.site, r.product_count, r.dominant_vendor, r.dominant_share, r.vendors) for r in got] == [("s", 6, "B", 0.5, {"A": 2, "B": 2})]


BRANDS = json.dumps({"brands": [{"name": "Apple", "match": "generic_word", "domains": ["apple.com"]}, {"name": "Lacoste"}, {"name": "Mike Sport", "scope": "lebanon"}, {"name": "ABC", "match": "exact_token"}]})


@pytest.mark.parametrize(("name", "domain", "want"), [
    ("Mike Sport ABC", None, "Mike Sport"), ("Pineapple Boutique", "pineapple.com", None), ("Apple Orchard", None, None), ("x", "store.apple.com", "Apple"), ("x", "lacoste-lb.com", "Lacoste"), ("x", "mikesport.com", "Mike Sport"),
    ("ABC Verdun", None, "ABC"), ("Lacostee", None, "Lacoste"), ("Lacosta", None, None), (None, None, None), ("", "", None), ("x", "apple.org", "Apple"),
])
def test_brand_matching(spark, name, domain, want):
    rows = spark.createDataFrame([(1, name, domain)], "row_id long, n string, d string")
    got = brands.match_brands(rows, brand_table(spark, BRANDS), "n", "d").collect()
    assert [r.brand for r in got] == ([want] if want else [])


def test_generic_words_match_vendors(spark):
    rows = spark.createDataFrame([(1, "Apple"), (2, "Mike Sport International")], "row_id long, n string")
    got = brands.match_brands(rows, brand_table(spark, BRANDS), "n", None, generic_words=True, scopes=("international",)).collect()
    assert [(r.row_id, r.brand) for r in got] == [(1, "Apple")]


@pytest.mark.parametrize("bad", ["{", "[]", '{"brands": {}}', '{"brands": [{}]}', '{"brands": [{"name": "!!"}]}'])
def test_a_bad_brand_list_stops(spark, bad):
    with pytest.raises(BrandListError):
        brand_table(spark, bad)


def test_clusters_are_greedy(spark):
    got = {r.id: r.cluster for r in identity.duplicate_clusters(L.RECORDS.df(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 11: 11, 13: 11}  # 12 matches only 13, which is with 11


def test_kept_is_not_the_closure(spark):
    rows = spark.createDataFrame([(1, "d1.com", "i1"), (2, "d1.com", "i2"), (3, "d2.com", "i2")], "id long, domain string, instagram string")
    assert {r.id: r.kept_id for r in identity.kept_and_aliases(rows).collect()} == {1: 1, 2: 1, 3: 3}


HTML = """<html><head><title>Blue Dress - Curly Square</title><meta property="og:site_name" content="Curly Square"><meta name="keywords" content="dress">
<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "Blue"}, {"@type": "Organization", "name": "Curly &amp; Square", "sameAs": ["https://instagram.com/curlysquare"]}]}</script></head>
<body><header><a class="logo" href="/"><img alt="Curly"></a></header><div class="grid"><a href="https://instagram.com/influencer">x</a><a href="https://instagram.com/influencer">x</a></div>
<footer><p>Beirut, +961 3 655 267</p><a href="https://www.instagram.com/curlysquare/" rel="me">ig</a></footer><script>cdn.shopify.com</script></body></html>"""


def test_page_tree():
    got = markup.read_page(HTML)
    assert got["site_names"][:2] == ["Curly & Square", "Curly Square"] and got["site_names"][2] == "Curly"
    assert got["title"] == "Blue Dress - Curly Square" and "beirut" in got["contact_text"] and "shopify" not in got["visible_text"]
    best = {}
    for m in got["mentions"]:
        best[m["handle"]] = max(best.get(m["handle"], 0), m["points"])
    assert best == {"influencer": 0, "curlysquare": 7}
    assert markup.read_page(None)["site_names"] == [] and markup.read_page("<a <b></c>")["mentions"] == []


def _acquired(spark, sites):
    results = spark.createDataFrame([(0, "q", 1, i + 1, f"https://{d}/p", d, False) for i, d in enumerate(sites)], CANDIDATES)
    pages = spark.createDataFrame([(d, h, 200, f"https://{d}/") for d, h in sites.items() if h], "domain string, html string, status int, final_url string")
    products = spark.createDataFrame([("curlysquare.com", '{"products": [{"vendor": "Curly"}]}')], "domain string, body string")
    profiles = spark.createDataFrame([("curlysquare", "8,200 Followers")], "handle string, body string")
    return results, pages, products, profiles


def test_lead_run_end_to_end(spark, tmp_path):
    sites = {"known.com": HTML, "curlysquare.com": HTML, "alias.com": HTML, "plain.com": "<p>hi</p>", "gone.com": None, "other.com.lb": "cdn.shopify.com <title>Other Things</title>", "lacoste.com.lb": "cdn.shopify.com <title>Lacoste</title>"}
    s = store.TableStore(spark, f"file://{tmp_path}/t")
    s.write("rejected_sites", spark.createDataFrame([("known.com", "x", None)], REJECTED))
    now = F.lit("2024-01-01")
    run = lead_run.run_and_store(s, *_acquired(spark, sites), brand_table(spark, BRANDS), now)
    leads = {r.domain: r for r in s.read("leads", LEADS).collect()}
    assert set(leads) == {"curlysquare.com", "other.com.lb"}
    curly = leads["curlysquare.com"]
    assert (curly.id, curly.business_name, curly.contact_priority_score, curly.instagram_followers, curly.aka_domains) == (1, "Curly & Square", 7, 8200, ["alias.com"])
    assert {(r.domain, r.result) for r in s.read("rejected_sites", REJECTED).collect()} == {("known.com", "x"), ("plain.com", "not_shopify"), ("lacoste.com.lb", "large_brand")}
    c = run.counts.first()
    assert (c.discovered, c.already_known, c.unreachable, c.analysed, c.not_shopify, c.large_brand, c.saved) == (7, 2, 1, 5, 1, 1, 2)
    again = lead_run.run_and_store(s, *_acquired(spark, sites), brand_table(spark, BRANDS), now)
    assert again.saved.count() == 0 and s.read("leads", LEADS).count() == 2


def test_lead_run_stops_at_the_target(spark):
    sites = {f"s{i}.com.lb": f"cdn.shopify.com <title>Name{i} Things</title>" for i in range(5)}
    none = lambda schema: spark.createDataFrame([], schema)
    run = lead_run.lead_run(*_acquired(spark, sites), brand_table(spark, BRANDS), none(LEADS), none(REJECTED), F.lit("2024-01-01"), target=2)
    assert [r.domain for r in run.saved.orderBy("row_id").collect()] == ["s0.com.lb", "s1.com.lb"]
    assert run.counts.first().discovered == 2


def test_a_run_analyses_little_beyond_its_stop(spark):
    sites = {f"s{i:03}.com.lb": f"cdn.shopify.com <title>Name{i} Things</title>" if i % 4 == 0 else "<p>no shop</p>" for i in range(60)}
    none = lambda schema: spark.createDataFrame([], schema)
    run = lead_run.lead_run(*_acquired(spark, sites), brand_table(spark, BRANDS), none(LEADS), none(REJECTED), F.lit("2024-01-01"), target=3)
    assert [r.domain for r in run.saved.orderBy("row_id").collect()] == ["s000.com.lb", "s004.com.lb", "s008.com.lb"]
    c = run.counts.first()
    assert (c.discovered, c.analysed, c.not_shopify, c.saved) == (9, 9, 6, 3) and run.decided.count() == 12


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    from leadloom.streaming.ingest import ingest

    results, *rest = _acquired(spark, {"curlysquare.com": HTML})
    results.write.parquet(f"{tmp_path}/in")
    s = store.TableStore(spark, f"file://{tmp_path}/t")
    for n in range(2):
        ingest(spark.readStream.schema(CANDIDATES).parquet(f"{tmp_path}/in"), s, *rest, brand_table(spark, BRANDS), f"{tmp_path}/cp{n}").awaitTermination()
    assert [r.domain for r in s.read("leads", LEADS).collect()] == ["curlysquare.com"]


def test_store_operations(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, domain string, v string")
    new = spark.createDataFrame([(3, "b", None), (4, "c", "z"), (5, "c", "later")], "id long, domain string, v string")
    assert {(r.id, r.domain) for r in store.insert_absent(old, new, "domain", F.col("id")).collect()} == {(4, "c")}
    assert {(r.id, r.domain, r.v) for r in store.upsert(old, new, ["domain"], F.desc("id")).collect()} == {(1, "a", "x"), (3, "b", None), (5, "c", "later")}


PAGE = '<title>T</title><nav><a>Shop</a><a>About</a></nav><a href="/products/a?x"><img></a><a href="/products/a"><b>Dress</b></a> now $40 <a href="/products/b">Hat</a>' + "." * 700


def test_page_evidence_groups_cards(spark):
    df = spark.createDataFrame([("d", 0, "https://d/", "homepage", PAGE), ("d", 1, "https://d/c", "collection", "<h1>C</h1>"), ("d", 2, "https://d/p", "product", ""), ("d", 3, "https://d/x", "collection", "")], "domain string, page_no int, url string, kind string, html string")
    got = evidence.collect(evidence.extract_pages(df)).first()
    assert got.pages_fetched == 3 and [(p.name, p.price) for p in got.pages[0].products] == [("Dress", "$40"), ("Hat", None)]
    assert (got.pages[0].title, got.pages[0].nav_labels, got.pages[0].price_detection, got.pages[2].price_detection, got.pages[2].title) == ("T", ["Shop", "About"], "present", "unknown", None)


def test_grounding_reasons(spark):
    got = {r.id: r.ungrounded for r in Q.queries()["claim_grounding"](spark, "").collect()}
    assert got[1] is None and got[7] is None
    for i, part in ((2, "price we did not extract"), (3, "'unknown'"), (4, "did not resolve"), (5, "overlaps"), (6, "no evidence_refs"), (8, "no content")):
        assert part in got[i]


GOOD = {"status": "success", "website_opportunity": {"category": "nav", "observation": "Prices are missing on cards", "evidence": "dress has no price", "problem_type": "missing", "confidence": 1.7, "evidence_refs": ["pages[0].title"]}, "outreach_angle": " ask ", "message": " ".join(["word"] * 29 + ["right?"])}


@pytest.mark.parametrize(("change", "status", "reason"), [
    ({}, "success", None), ({"status": "no_strong_opportunity"}, "no_strong_opportunity", None), ({"status": "odd"}, "failed", "unrecognised"), ({"website_opportunity": None}, "failed", "no website_opportunity"), ({"message": " "}, "failed", "no message"),
    ({"website_opportunity": GOOD["website_opportunity"] | {"problem_type": "nice"}}, "no_strong_opportunity", "problem_type"), ({"website_opportunity": GOOD["website_opportunity"] | {"observation": "A lovely menu"}}, "no_strong_opportunity", "exists and works"),
    ({"outreach_angle": "nav_labels"}, "insufficient_evidence", "internal"), ({"website_opportunity": GOOD["website_opportunity"] | {"evidence_refs": []}}, "insufficient_evidence", "no evidence_refs"), ({"message": "short?"}, "insufficient_evidence", "under"),
])
def test_model_output_validator(spark, change, status, reason):
    pages = json.dumps({"pages": [{"title": "Dress has no price"}]})
    df = spark.createDataFrame([("d", json.dumps(GOOD | change), pages)], "id string, raw string, evidence string")
    got = grounding.validate(df).first()
    assert got.status == status and (reason is None or reason in got.rejected_reason)
    assert (got.message is not None) == (status == "success") and got.fallback_verified is False
    if status == "success":
        assert got.opportunity_confidence == 1.0 and got.outreach_angle == "ask"


def test_output_that_is_no_object(spark):
    df = spark.createDataFrame([("a", "[]", "{}"), ("b", "x", "{}"), ("c", None, None)], "id string, raw string, evidence string")
    assert {r.status for r in grounding.validate(df).collect()} == {"failed"}


def test_analysis_plan(spark):
    leads = spark.createDataFrame([("d",), ("e",)], "domain string")
    pages = spark.createDataFrame([("d", 0, "https://d/", PAGE), ("e", 0, "https://e/", "")], "domain string, page_no int, url string, html string")
    out = spark.createDataFrame([("d", json.dumps(GOOD | {"website_opportunity": GOOD["website_opportunity"] | {"evidence": "Hat dress", "evidence_refs": ["products"]}}))], "domain string, raw string")
    got = {r.domain: r for r in analysis.judge(analysis.gather(leads, pages), out, "m", F.lit("2024-01-01")).collect()}
    assert got["d"].status == "success" and got["e"].status == "insufficient_evidence"
    view = {r.domain: r for r in reads.stored_view(spark.createDataFrame(list(got.values()), ANALYSES)).collect()}
    assert view["d"].message and view["e"].opportunity is None


def test_reads(spark):
    rows = spark.createDataFrame([(i, f"Shop {i}", f"d{i}.com", i // 2) for i in range(7)], "id long, business_name string, domain string, created_at int")
    page, total = reads.leads_page(rows, " SHOP ", 1, 3)
    assert total == 7 and [r.domain for r in page.collect()] == ["d4.com", "d5.com", "d2.com"]
    assert reads.since(rows, 4).count() == 2 and reads.has_more(3, 7)


def test_mirror_payload_keeps_null_flags(spark):
    lead = spark.createDataFrame([{"id": 1, "domain": "a", "business_name": "A", "website": "w", "has_email": None, "has_phone": True}], LEADS)
    got = reads.dry_run(reads.mirror_payload(lead)).first().payload
    data = json.loads(got)
    assert len(data) == 19 and data["has_email"] is None and data["has_phone"] is True and data["website_url"] == "w"


def test_run_cursor(spark):
    r = reads.run_cursor(L.RUNS.df(spark)).first()
    assert (r.already_running, r.after) == (True, 904)
    assert reads.newest_run(L.RUNS.df(spark), 1000).first().state == "queued" and reads.newest_run(L.RUNS.df(spark), 902).first().run_id == 905


def test_relative_time_of_every_event_by_brute_force(spark, tmp_path):
    from datetime import UTC, datetime, timedelta
    from math import floor

    now = datetime(2024, 1, 15, 12, tzinfo=UTC)
    gaps = [sign * x for x in (0, 29, 59, 60, 90, 3599, 3600, 5400, 86_399, 86_400, 129_600, 2_591_999, 2_592_000, 3_900_000, 31_535_999, 31_536_000, 50_000_000) for sign in (1, -1)]
    rows = [(i, now + timedelta(seconds=g)) for i, g in enumerate(gaps)] + [(99, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")

    def plain(s):
        if s is None:
            return "—"
        unit, by = next(((u, b) for u, below, b in (("second", 60, 1), ("minute", 3600, 60), ("hour", 86_400, 3600), ("day", 2_592_000, 86_400), ("month", 31_536_000, 2_592_000)) if abs(s) < below), ("year", 31_536_000))
        n = floor(s / by + 0.5)
        own = {("second", 0): "now", ("day", -1): "yesterday", ("day", 1): "tomorrow", ("month", -1): "last month", ("month", 1): "next month", ("year", -1): "last year", ("year", 1): "next year"}
        some = f"{abs(n)} {unit}{'' if abs(n) == 1 else 's'}"
        return own.get((unit, n)) or (f"{some} ago" if n < 0 else f"in {some}")

    got = Q.queries()["relative_time_all"](spark, str(tmp_path)).filter("k = 1").collect()
    assert {r.event_id: r.said for r in got} == {i: plain(g) for i, g in enumerate(gaps)} | {99: "—"} and len(got) == len(rows)


def test_every_document_meets_every_claim(spark, tmp_path):
    claims = [(1, "Blue shirts and blue shoes"), (2, "the of"), (3, "gold rings"), (4, None)]
    docs = [(i, ("blue shirt", "shoe of gold", "nothing here", "", None)[i % 5]) for i in range(15, 40)]
    spark.createDataFrame(claims, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.queries()["grounding_overlap_all"](spark, str(tmp_path)).collect()
    share = {1: (0.75, 0.25, 0, 0, 0), 2: (None,) * 5, 3: (0, 0.5, 0, 0, 0), 4: (None,) * 5}
    assert {(r.item_id, r.doc_id): r.share for r in got} == {(c, i): share[c][i % 5] for c, _ in claims for i, _ in docs} and len(got) == len(claims) * len(docs)


def test_a_write_that_is_cut_off_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = store.TableStore(spark, f"file://{tmp_path}/t")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    s.write("leads", rows(1, 2))
    note = s._note

    def stop(path, line):
        raise OSError("stopped before the pointer")

    monkeypatch.setattr(s, "_note", stop)
    with pytest.raises(OSError):
        s.write("leads", rows(1, 2, 3))
    assert s.read("leads", "id long").count() == 2
    monkeypatch.setattr(s, "_note", note)
    s.write("leads", rows(1, 2, 3, 4))
    assert s.read("leads", "id long").count() == 4


def test_lost_and_doubled_pointers_are_errors(spark, tmp_path):
    import shutil

    s = store.TableStore(spark, f"file://{tmp_path}/t")
    assert s.read("leads", "id long").count() == 0
    s.write("leads", spark.range(3))
    pointer = next((tmp_path / "t/leads").glob("pointer-*"))
    shutil.copytree(pointer, f"{pointer}x")
    with pytest.raises(store.LostPointer):
        s.read("leads", "id long")
    shutil.rmtree(f"{pointer}x")
    assert s.read("leads", "id long").count() == 3
    shutil.rmtree(pointer)
    with pytest.raises(store.LostPointer):
        s.read("leads", "id long")


def test_groups_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 103), (103, 101)], "a long, b long")
    assert {r.id: r.grp for r in identity.groups(pairs).collect()} == dict.fromkeys(range(61), 0) | {100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize("word", ["lacostee", "lacoste", "laxcoste", "acostes", "lacosteshop", "almonds"])
def test_near_spellings_are_found_by_shared_grams(spark, word):
    from difflib import SequenceMatcher

    b = brand_table(spark, '{"brands": [{"name": "Lacoste"}, {"name": "Almond"}]}')
    rows = spark.createDataFrame([(1, word)], "row_id long, n string")
    want = [x for x in ("Lacoste", "Almond") if SequenceMatcher(None, word, x.lower()).ratio() >= brands.SIMILARITY]
    assert [r.brand for r in brands.match_brands(rows, b, "n", None).collect()] == want[:1]


def test_exact_queries_have_rows_and_sql(spark):
    assert set(Q.oracle_sql()) <= set(Q.queries()) and len(Q.oracle_sql()) >= 65


@pytest.mark.parametrize("name", ["page_title", "page_labels"])
def test_page_queries_decode_what_their_sql_decodes(spark, tmp_path, name):
    """The two queries leave all entities but one, as their SQL does; the engine decodes them."""
    import duckdb

    html = '<title>a &quot;b&quot; &amp; c</title><title\u00e9>x</title><nav><a href="/x">&lt;New&gt; &#39;s</a></nav><h1>&amp;quot; &nbsp;</h1><a href="/collections/a">A &ndash; B</a><button>&quot;</button>'
    spark.createDataFrame([(7, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(Q.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, Q.queries()[name](spark, str(tmp_path)).collect())) == sorted(want) and "&quot;" in str(want)
    assert json.loads(Q.queries()["page_evidence"](spark, str(tmp_path)).filter("page_id = 7").first().ctas) == ['"']
