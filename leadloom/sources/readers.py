"""Readers of captured stores and of the brand list."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import _ascii
from .schemas import STORE


def read_stores(spark: SparkSession, path: str) -> DataFrame:
    """Captured stores, one JSON document a file; a store that does not say so is open."""
    df = spark.read.schema(STORE).option("multiLine", True).json(path)
    return df.withColumn("analysis", F.col("analysis").withField("is_available", F.coalesce("analysis.is_available", F.lit(True))))


def queries_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fixed.QUERIES)), "query_no int, query string")


def normal(text: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in _ascii(text).lower()).split())


class BrandListError(RuntimeError):
    """The brand list is unusable. A run without it would pass every brand, so it stops."""


def brand_table(spark: SparkSession, source: str) -> DataFrame:
    """(brand_pos, brand, scope, match, alias, joined, domain) from a JSON text: a row for each alias and each domain.

    A brand list is kept by hand and read whole by the driver; every defect is an error.
    """
    try:
        data = json.loads(source)
    except ValueError as e:
        raise BrandListError(f"not valid JSON: {e}") from e
    if not isinstance(data, dict) or not isinstance(data.get("brands"), list):
        raise BrandListError("must be an object with a list of brands")
    rows = []
    for i, b in enumerate(data["brands"]):
        if not isinstance(b, dict) or not b.get("name"):
            raise BrandListError(f"invalid entry: {b!r}")
        aliases = [a for a in map(normal, b.get("aliases") or [b["name"]]) if a]
        if not aliases:
            raise BrandListError(f"{b['name']!r} has no usable aliases")
        base = (i, b["name"], b.get("scope", "international"), b.get("match", "token"))
        rows += [(*base, a, a.replace(" ", ""), None) for a in aliases]
        rows += [(*base, None, None, d.lower().strip()) for d in b.get("domains", [])]
    return spark.createDataFrame(rows, "brand_pos int, brand string, scope string, match string, alias string, joined string, domain string")
