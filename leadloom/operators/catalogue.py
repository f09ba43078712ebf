"""What a store sells: vendors of its products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

PRODUCTS = "products array<struct<vendor: string>>"


def vendor_counts(products: DataFrame, site: str = "site", vendor: str = "vendor", pos: str = "pos") -> DataFrame:
    """site, vendor, n, first_pos: trimmed vendors, blanks skipped."""
    named = products.withColumn(vendor, strip(F.col(vendor))).filter(F.col(vendor) != "")
    return named.groupBy(site, vendor).agg(F.count("*").alias("n"), F.min(pos).alias("first_pos"))


def dominant_vendors(products: DataFrame, site: str = "site", vendor: str = "vendor", pos: str = "pos") -> DataFrame:
    """site, product_count, vendors, dominant_vendor, dominant_share.

    The most frequent vendor, the first seen on ties; the share is of products that name
    a vendor, the count of all. Sites without a vendor have no row. Two aggregates on
    nested keys; the second reads counts, so a large catalogue is combined map-side.
    """
    counts = vendor_counts(products, site, vendor, pos)
    order = F.struct(F.col("n"), -F.col("first_pos"))
    summary = counts.groupBy(site).agg(
        F.max_by(vendor, order).alias("dominant_vendor"), F.max("n").alias("most"), F.sum("n").alias("named"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(vendor, "n")))).alias("vendors"),
    )
    total = products.groupBy(site).agg(F.count("*").alias("product_count"))
    out = summary.join(total, site)
    return out.select(site, "product_count", "vendors", "dominant_vendor", (F.col("most") / F.col("named")).alias("dominant_share"))


def parse_products(pages: DataFrame, site: str, body: str) -> DataFrame:
    """site, pos, vendor of each product of a catalogue's JSON text; text of another shape has none."""
    parsed = F.from_json(F.col(body), PRODUCTS)
    return pages.select(site, F.posexplode(parsed["products"]).alias("pos", "product")).select(site, "pos", F.col("product.vendor").alias("vendor"))
