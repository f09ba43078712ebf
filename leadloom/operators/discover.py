"""Discovery results to candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.urls import clean_host, is_ignored_host

DISCOVERY_ORDER = ("query_no", "page", "position")


def until_exhausted(results: DataFrame) -> DataFrame:
    """Rows of each query's pages before the first page that was exhausted; pages without rows are no stop."""
    stop = F.min(F.when(F.col("exhausted"), F.col("page"))).over(W.partitionBy("query_no"))
    return results.withColumn("_stop", stop).filter((F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))) & F.col("url").isNotNull()).drop("_stop")


def first_by(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key in a total order; combined map-side, so a hot key costs no task."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*[F.col(key) if c == key else F.col("_row")[c].alias(c) for c in df.columns])


def candidates(results: DataFrame) -> DataFrame:
    """The first result of each clean host over all queries and pages; hosts that are never candidates are left out."""
    named = until_exhausted(results).withColumn("domain", clean_host(F.col("url")))
    named = named.filter(~is_ignored_host(F.col("url")) & (F.col("domain") != ""))
    return first_by(named, "domain", *DISCOVERY_ORDER, "url")


def unknown_only(cands: DataFrame, leads: DataFrame, rejected: DataFrame) -> DataFrame:
    """Candidates that are neither leads nor rejected; before anything costly is done for them."""
    return cands.join(leads.select("domain"), "domain", "left_anti").join(rejected.select("domain"), "domain", "left_anti")
