"""Table schemas, and how a stored table is brought to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


SIGNALS = "struct<strong: array<string>, claim: array<string>, medium: array<string>, us_conflict: boolean>"
CANDIDATES = "query_no int, query string, page int, position int, url string, title string, exhausted boolean"
PAGES = "url string, html string, status int, final_url string"
LEADS = (
    "id long, business_name string, instagram_url string, website string, domain string, identity_key string, aka_domains array<string>, created_at timestamp, "
    "contact_priority_score int, contact_priority string, contact_priority_reasons string, instagram_followers long, has_email boolean, has_phone boolean, "
    "has_whatsapp boolean, dominant_share double, lebanon_signal_tier string, industry string, city string, hreflang_count long, has_sentry boolean, has_store_locator boolean"
)
#: The least id of a lead that has an identifier; key is its kind and value.
IDENTIFIERS = "key string, id long"
REJECTED = "domain string, result string, checked_at timestamp"
MIRRORED = (
    "domain", "business_name", "instagram_url", "website_url", "created_at", "contact_priority_score", "contact_priority", "contact_priority_reasons",
    "instagram_followers", "has_email", "has_phone", "has_whatsapp", "dominant_share", "lebanon_signal_tier", "industry", "city", "hreflang_count", "has_sentry", "has_store_locator",
)
ANALYSES = (
    "domain string, status string, opportunity_category string, opportunity_observation string, opportunity_evidence string, evidence_refs array<string>, "
    "opportunity_confidence double, outreach_angle string, message string, fallback_message string, fallback_category string, fallback_verified boolean, "
    "model string, pages_fetched int, analyzed_at timestamp"
)
STORE = (
    f"label string, url string, instagram_followers long, "
    "products struct<available: boolean, product_count: long, vendors: map<string, long>, dominant_vendor: string, dominant_share: double>, "
    "analysis struct<business_name: string, city: string, corporate_terms: array<string>, email: string, fetch_ok: boolean, has_sentry: boolean, "
    "has_store_locator: boolean, hreflang_count: long, industry: string, instagram: string, is_ecommerce: boolean, is_lebanon: boolean, is_shopify: boolean, "
    f"is_available: boolean, lebanon_signals: {SIGNALS}, phone: string, whatsapp: string>"
)


def conform(df: DataFrame, to: T.StructType | str) -> DataFrame:
    """df with exactly these columns: missing ones are null, unknown ones go. Nothing is filled in."""
    have, to = set(df.columns), T.StructType.fromDDL(to) if isinstance(to, str) else to
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in to])
