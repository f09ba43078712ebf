"""From leads and their pages to stored analyses: evidence, model output, validators, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, grounding
from ..sources.schemas import ANALYSES, conform
from ..sources.store import TableStore


def gather(leads: DataFrame, pages: DataFrame) -> DataFrame:
    """(domain, pages, pages_fetched, evidence JSON, enough) of leads; pages: domain, page_no, url, html.

    The URL of a page and what it is for follow from its place and address.
    """
    kind = F.when(F.col("page_no") == 0, "homepage").when(F.col("url").contains("/products/"), "product").otherwise("collection")
    own = pages.join(leads.select("domain"), "domain", "left_semi").withColumn("kind", kind)
    got = evidence.collect(evidence.extract_pages(own))
    as_json = F.to_json(F.struct("domain", "pages", "pages_fetched"), {"ignoreNullFields": "false"})
    return got.withColumn("evidence", as_json).withColumn("enough", evidence.has_evidence(F.col("pages")))


def judge(gathered: DataFrame, outputs: DataFrame, model: str, now: Column) -> DataFrame:
    """Rows of analyses: model output (domain, raw) held against the evidence; without evidence no output is used."""
    both = gathered.join(outputs, "domain", "left")
    judged = grounding.validate(both.filter("enough AND raw IS NOT NULL").select(F.col("domain").alias("id"), "raw", "evidence")).withColumnRenamed("id", "domain")
    poor = both.filter("NOT enough OR raw IS NULL").select("domain", F.when(F.col("enough"), "failed").otherwise("insufficient_evidence").alias("status"), F.lit(False).alias("fallback_verified"))
    rows = judged.unionByName(poor, allowMissingColumns=True).join(gathered.select("domain", "pages_fetched"), "domain")
    return conform(rows.withColumns({"model": F.lit(model), "analyzed_at": now.cast("timestamp")}), ANALYSES)


def store_analyses(store: TableStore, analyses: DataFrame) -> None:
    """Rows of ``judge`` put in the place of those of their domains; every column is written, so none of an older analysis survives."""
    with store.changes() as change:
        change.upsert("lead_analyses", ANALYSES, analyses, "domain", F.desc("analyzed_at"))
