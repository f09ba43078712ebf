"""Tables in buckets: what a change writes, several tables in one commit, kills in between, repair, the identifier index."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leadloom.operators import identity
from leadloom.plans import analysis, lead_run
from leadloom.sources import store
from leadloom.sources.schemas import ANALYSES, IDENTIFIERS, LEADS, REJECTED, conform

ROWS = "key string, v long"


def size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


@pytest.fixture
def tables(spark, tmp_path):
    return store.TableStore(spark, f"file://{tmp_path}/t")


def rows(spark, a, b, v=0):
    return spark.range(a, b).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") * 0 + v).alias("v"))


def test_a_change_writes_what_it_touches(spark, tables, tmp_path):
    with tables.changes() as c:
        c.upsert("x", ROWS, rows(spark, 0, 20_000).withColumn("v", F.xxhash64("key")), "key", F.desc("v"))
    first = size(tmp_path / "t/x")
    for n in (1, 2, 3):
        before = size(tmp_path / "t/x")
        with tables.changes() as c:
            c.upsert("x", ROWS, rows(spark, n, n + 1, n), "key", F.desc("v"))
        assert size(tmp_path / "t/x") - before < 3 * first / store.BUCKETS
    got = {r.key: r.v for r in tables.read("x", ROWS).filter("key IN ('k0', 'k1', 'k2', 'k3')").collect()}
    assert (got["k1"], got["k2"], got["k3"]) == (1, 2, 3) and got["k0"] not in (0, 1, 2, 3) and tables.read("x", ROWS).count() == 20_000
    with tables.changes() as c:
        c.insert("x", ROWS, rows(spark, 19_999, 20_002, 7), "key", F.asc("v"))
    assert tables.read("x", ROWS).filter("v = 7").count() == 2


def test_buckets_read_what_is_asked_for(spark, tables):
    with tables.changes() as c:
        c.upsert("x", ROWS, rows(spark, 0, 2000), "key", F.desc("v"))
    some = rows(spark, 5, 8)
    part = tables.read("x", ROWS, tables.buckets_of(some, "key"))
    assert part.join(some, "key", "left_semi").count() == 3 and part.count() < 200
    assert len(part.inputFiles()) <= 3


def test_tables_change_together_or_not_at_all(spark, tables):
    with tables.changes() as c:
        c.upsert("a", ROWS, rows(spark, 0, 10), "key", F.desc("v"))
        c.upsert("b", ROWS, rows(spark, 0, 10), "key", F.desc("v"))
    with pytest.raises(OSError), tables.changes() as c:
        c.upsert("a", ROWS, rows(spark, 0, 5, 1), "key", F.desc("v"))
        raise OSError("stopped between two tables")
    assert tables.read("a", ROWS).filter("v = 1").count() == 0
    with tables.changes() as c:
        c.upsert("a", ROWS, rows(spark, 0, 5, 1), "key", F.desc("v"))
        c.upsert("b", ROWS, rows(spark, 8, 12, 1), "key", F.desc("v"))
    assert (tables.read("a", ROWS).filter("v = 1").count(), tables.read("b", ROWS).count()) == (5, 12)


def test_a_table_written_whole_goes_into_buckets(spark, tables):
    tables.write("x", rows(spark, 0, 100))
    with tables.changes() as c:
        c.upsert("x", ROWS, rows(spark, 99, 101, 5), "key", F.desc("v"))
    assert tables.read("x", ROWS).count() == 101 and tables.read("x", ROWS).filter("v = 5").count() == 2
    tables.write("x", rows(spark, 0, 3))
    assert tables.read("x", ROWS).count() == 3


def test_nothing_changes_nothing(spark, tables):
    with tables.changes() as c:
        c.upsert("x", ROWS, rows(spark, 0, 0), "key", F.desc("v"))
    assert tables.read("x", ROWS).count() == 0
    with tables.changes() as c:
        c.upsert("x", ROWS, rows(spark, 0, 4), "key", F.desc("v"))
    with tables.changes() as c:
        c.upsert("x", ROWS, rows(spark, 0, 0), "key", F.desc("v"))
    assert tables.read("x", ROWS).count() == 4


def test_two_writers_can_be_settled(spark, tables):
    tables.write("x", rows(spark, 0, 1))
    one, two = tables.changes(), tables.changes()
    for n, c in enumerate((one, two)):
        c.upsert("x", ROWS, rows(spark, 0, 3, n + 1), "key", F.desc("v"))
    for c in (one, two):
        c.__exit__(None)
    with pytest.raises(store.LostPointer):
        tables.read("x", ROWS)
    tables.settle("x", f"manifest-{two.tag}")
    assert {r.v for r in tables.read("x", ROWS).collect()} == {2}
    with pytest.raises(ValueError):
        tables.settle("x", "manifest-unknown")


def test_a_killed_run_leaves_leads_and_rejections_as_they_were(spark, tables, monkeypatch):
    from test_operators import BRANDS, HTML, _acquired

    from leadloom.sources.readers import brand_table

    def run():
        return lead_run.run_and_store(tables, *_acquired(spark, {"curlysquare.com": HTML, "plain.com": "<p>hi</p>"}), brand_table(spark, BRANDS), F.lit("2024-01-01"))

    upsert = store.Changes.upsert

    def stop(self, name, *rest):
        if name == "rejected_sites":
            raise OSError("stopped between leads and rejections")
        upsert(self, name, *rest)

    monkeypatch.setattr(store.Changes, "upsert", stop)
    with pytest.raises(OSError):
        run()
    assert tables.read("leads", LEADS).count() == tables.read("rejected_sites", REJECTED).count() == 0
    monkeypatch.setattr(store.Changes, "upsert", upsert)
    run()
    assert (tables.read("leads", LEADS).count(), tables.read("rejected_sites", REJECTED).count()) == (1, 1)
    assert {r.key for r in tables.read("lead_identifiers", IDENTIFIERS).collect()} == {"domain:curlysquare.com", "instagram:curlysquare"}


def test_the_index_finds_what_all_leads_would(spark):
    leads = spark.createDataFrame([(i, f"d{i % 40}.com", f"https://instagram.com/u{i % 33}") for i in range(1, 80)], "id long, domain string, instagram string")
    new = spark.createDataFrame([(1000 + i, f"d{i * 3}.com", f"u{i * 5}") for i in range(30)], "id long, domain string, instagram string")
    index = identity.identifier_index(identity.identifiers(leads))
    kept = leads.select("id").join(identity.kept_and_aliases(leads).filter("id = kept_id").select("id"), "id")
    known = identity.identifier_index(identity.identifiers(leads.join(kept, "id")))
    whole = identity.kept_and_aliases(leads.unionByName(new)).filter("id >= 1000").collect()
    assert {tuple(r) for r in identity.kept_and_aliases(new, known=known).collect()} == {tuple(r) for r in whole}
    assert index.count() == 40 + 33


def test_analyses_replace_whole_rows(spark, tables):
    one = conform(spark.createDataFrame([("a.com", "success", "hello", "2024-01-01"), ("b.com", "failed", None, "2024-01-01")], "domain string, status string, message string, analyzed_at string"), ANALYSES)
    analysis.store_analyses(tables, one)
    analysis.store_analyses(tables, conform(spark.createDataFrame([("a.com", "failed", "2024-01-02")], "domain string, status string, analyzed_at string"), ANALYSES))
    assert {(r.domain, r.status, r.message) for r in tables.read("lead_analyses", ANALYSES).collect()} == {("a.com", "failed", None), ("b.com", "failed", None)}
