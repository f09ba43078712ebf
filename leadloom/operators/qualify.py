"""The rules: the first failure in a fixed order is the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.contacts import is_placeholder, passes_gate
from .brands import match_brands

REASONS = ("not_shopify", "store_closed", "outside_lebanon", "placeholder_store", "large_brand")


def first_failure(signals: DataFrame) -> tuple[Column, Column]:
    """(reason, detail) columns of rows with signals, ``brand`` and ``vendor_brand``; null where all rules pass."""
    name = F.trim(F.coalesce("business_name", F.lit("")))
    share = F.coalesce("dominant_share", F.lit(0.0))
    over = F.col("instagram_followers") > fixed.FOLLOWER_CEILING
    outlet = (F.col("dominant_vendor") != "") & (share >= fixed.OUTLET_SHARE) & F.col("vendor_brand").isNotNull()
    rules = [
        (~F.coalesce("is_shopify", F.lit(False)), "not_shopify", F.lit("not a Shopify store")),
        (~F.coalesce("is_available", F.lit(True)), "store_closed", F.lit("storefront is closed or suspended")),
        (~passes_gate(F.col("lebanon_signals")), "outside_lebanon", F.lit("no evidence the business is in Lebanon")),
        (is_placeholder(name), "placeholder_store", F.concat(F.lit("unconfigured store name '"), name, F.lit("'"))),
        (F.col("brand").isNotNull(), "large_brand", F.concat(F.lit("known brand: "), F.col("brand"))),
        (outlet, "large_brand", F.concat(F.lit("outlet for "), F.col("vendor_brand"), F.lit(" ("), F.bround(share * 100).cast("int").cast("string"), F.lit("% of catalogue)"))),
        (over, "large_brand", F.concat(F.format_number("instagram_followers", 0), F.lit(" Instagram followers"))),
    ]
    reason, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, why, text in reversed(rules):
        test = F.coalesce(test, F.lit(False))
        reason, detail = F.when(test, F.lit(why)).otherwise(reason), F.when(test, text).otherwise(detail)
    return reason, detail


def decide(signals: DataFrame, brands: DataFrame, key: str = "row_id") -> DataFrame:
    """signals with ``qualified``, ``reason`` and ``detail``."""
    own = match_brands(signals, brands, "business_name", "domain", key=key).select(key, "brand")
    sold = match_brands(signals, brands, "dominant_vendor", None, generic_words=True, scopes=("international",), key=key).select(key, F.col("brand").alias("vendor_brand"))
    both = signals.join(own, key, "left").join(sold, key, "left")
    reason, detail = first_failure(both)
    return both.withColumns({"reason": reason, "detail": detail}).withColumn("qualified", F.col("reason").isNull()).drop("brand", "vendor_brand")


def rejection_counts(decided: DataFrame) -> DataFrame:
    """How often each reason was given; reasons that were not are 0."""
    one = decided.agg(*[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    pairs = F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n")) for r in REASONS])
    return one.select(F.inline(pairs))
