"""Contact, follower and location expressions; no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import any_of, first_of, has_any
from .urls import clean_host, host_in


def email(markup: Column) -> Column:
    """The first address that is not a vendor's and not an asset's name."""
    def good(m: Column) -> Column:
        domain = F.lower(F.element_at(F.split(m, "@"), -1))
        asset = F.lower(m).rlike("(" + "|".join(x.replace(".", r"\.") for x in fixed.IGNORED_EMAIL_SUFFIXES) + ")$")
        return ~host_in(domain, fixed.IGNORED_EMAIL_DOMAINS) & ~asset

    return F.get(F.filter(F.regexp_extract_all(markup, F.lit(f"({fixed.EMAIL})"), 1), good), 0)


def _first(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def phone(markup: Column) -> Column:
    return _first(markup, fixed.PHONE)


def whatsapp(markup: Column) -> Column:
    return F.concat(F.lit("+"), _first(markup, fixed.WHATSAPP, 1))


def normalize_phone(value: Column) -> Column:
    """Digits only, with the country code; local numbers of 7 or 8 digits get it."""
    digits = F.regexp_replace(F.regexp_replace(value, "[^0-9]", ""), "^00", "")
    local = F.regexp_replace(digits, "^0+", "")
    full = F.when(~digits.startswith("961") & F.length(local).between(7, 8), F.concat(F.lit("961"), local)).otherwise(digits)
    return F.nullif(full, F.lit(""))


def normalize_email(value: Column) -> Column:
    e = F.lower(F.trim(value))
    return F.when(e.contains("@"), e)


def normalize_instagram(value: Column) -> Column:
    """The comparable handle: URL unwrapped, lower case, without dots."""
    text = F.lower(F.trim(value))
    after = F.regexp_replace(text, r"^.*?instagram\.com/*", "")
    part = F.when(text.contains("instagram.com"), after).when(~text.contains("://"), text)
    part = F.regexp_replace(part, "^/+|/+$", "")
    handle = F.regexp_replace(F.regexp_extract(part, "^([^/?#]*)", 1), "^@+", "")
    plain = F.replace(F.regexp_replace(handle, "[^a-z0-9_.]", ""), F.lit("."), F.lit(""))
    return F.when(~handle.isin(*fixed.NON_PROFILE_PATHS), F.nullif(plain, F.lit("")))


def clean_handle(raw: Column) -> Column:
    """An account name from a link's path, unless it is no profile or a platform's own."""
    h = F.regexp_extract(F.regexp_replace(F.trim(raw), "^/+|/+$", ""), "^([^/?#]*)", 1)
    bad = F.lower(h).isin(*fixed.IGNORED_INSTAGRAM_PATHS, *fixed.PLATFORM_HANDLES)
    return F.when(h.rlike(fixed.INSTAGRAM_HANDLE) & ~bad, h)


def followers(text: Column) -> Column:
    """A follower count from profile markup; null where it is unknown, never 0 for unknown."""
    exact = F.try_to_number(_first(text, fixed.FOLLOWERS_JSON, 1), F.lit("9" * 18)).cast("long")
    number = F.replace(F.regexp_extract(text, fixed.FOLLOWERS_TEXT, 1), F.lit(","), F.lit(""))
    unit = F.lower(F.regexp_extract(text, fixed.FOLLOWERS_TEXT, 2))
    times = F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)
    shown = F.when(number.rlike(r"^\d+\.?\d*$"), F.floor(number.try_cast("double") * times).cast("long"))
    return F.coalesce(exact, shown)


def city(visible_text: Column) -> Column:
    """A city in location phrasing first, else the first known city anywhere."""
    chunks = F.regexp_extract_all(visible_text, F.lit(f"({fixed.CITY_CONTEXT})"), 1)
    named = F.filter(F.transform(chunks, lambda c: first_of(c, fixed.CITIES, lambda x, w: x.contains(w), str.title)), lambda c: c.isNotNull())
    anywhere = first_of(visible_text, fixed.CITIES, lambda x, w: x.rlike(rf"\b{w}\b"), str.title)
    return F.coalesce(F.get(named, 0), anywhere)


def lebanon_signals(url: Column, lower_html: Column, mail: Column, instagram: Column, wa: Column, contact_text: Column, name: Column) -> Column:
    """struct(strong, claim, medium: arrays of signal names; us_conflict)."""
    host = clean_host(url)
    some = lambda *pairs: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n) if isinstance(n, str) else n) for c, n in pairs]))
    local = F.get(F.split(F.lower(mail), "@"), 0)
    domain = F.element_at(F.split(F.lower(mail), "@"), -1)
    town = first_of(contact_text, fixed.CITIES, lambda x, w: x.rlike(rf"\b{w}\b"), lambda w: f"city_in_contact_block:{w}")
    token = "(lb|leb|lebanon|lebanese)"
    return F.struct(
        some(
            (host.endswith(".lb"), "lb_domain"),
            (lower_html.rlike(fixed.LEBANON_PHONE), "lebanese_phone"),
            (F.regexp_replace(wa, r"\D", "").startswith("961"), "lebanese_whatsapp"),
            (domain.endswith(".lb"), "lb_email_domain"),
        ).alias("strong"),
        some(
            (has_any(host, ("lebanon", "lebanese")) & ~host.contains("mt-lebanon"), "lebanon_in_domain"),
            (mail.contains("@") & (local.rlike(rf"(^|[^a-z]){token}([^a-z]|$)") | local.contains("lebanon")), "lb_in_email_local"),
            (F.lower(name).rlike(r"\b(lebanon|lebanese|beirut)\b"), "lebanon_in_business_name"),
        ).alias("claim"),
        some(
            (F.lower(instagram).rlike(rf"(^|[._]){token}([._]|$)"), "lebanese_instagram_handle"),
            (town.isNotNull(), town),
            (lower_html.rlike(r"\blbp\b|lebanese pound"), "lbp_currency"),
            (lower_html.rlike(fixed.SHIPPING_CONTEXT), "lebanon_shipping_context"),
        ).alias("medium"),
        F.coalesce(lower_html.rlike(fixed.US_CONTEXT), F.lit(False)).alias("us_conflict"),
    )


def passes_gate(s: Column) -> Column:
    """Strong evidence passes, a US mention vetoes the rest, one claim or two suggestive signals pass."""
    return F.when(F.size(s["strong"]) > 0, True).when(s["us_conflict"], False).when(F.size(s["claim"]) > 0, True).otherwise(F.size(s["medium"]) >= 2)


def structure_flags(markup: Column) -> Column:
    low = F.lower(markup)
    return F.struct(
        F.size(F.array_distinct(F.regexp_extract_all(markup, F.lit(fixed.HREFLANG), 1))).cast("long").alias("hreflang_count"),
        low.rlike(fixed.SENTRY).alias("has_sentry"),
        low.rlike(fixed.STORE_LOCATOR).alias("has_store_locator"),
        has_any(low, fixed.SHOPIFY_SIGNALS).alias("is_shopify"),
        (has_any(low, fixed.SHOPIFY_SIGNALS) | has_any(low, fixed.ECOMMERCE_SIGNALS)).alias("is_ecommerce"),
    )


def corporate_terms(contact_text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(contact_text), F.lit(fixed.CORPORATE_TERMS), 1)))


def store_is_open(status: Column, final_url: Column, markup: Column) -> Column:
    """Not by status, not behind a password page, and no closing words in the title."""
    title = F.lower(F.trim(F.regexp_extract(F.coalesce(markup, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)))
    locked = F.regexp_replace(F.lower(F.coalesce(final_url, F.lit(""))), "/+$", "").endswith("/password")
    return ~(F.coalesce(status.isin(*fixed.CLOSED_STATUS), F.lit(False)) | locked | has_any(title, fixed.CLOSED_TITLES))


def is_placeholder(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)).isin(*fixed.PLACEHOLDER_NAMES), F.lit(False))


def has_price_markup(markup: Column) -> Column:
    return markup.rlike(fixed.PRICE_SIGN_FIRST) | markup.rlike(fixed.PRICE_NUMBER_FIRST) | any_of(markup, fixed.PRICE_MARKUP)


def _any_word(words: list[str]) -> str:
    """A pattern for whole words, by their first letter, so that few alternatives are tried at a place."""
    rest = {c: "|".join(w[1:] for w in words if w[0] == c) for c in sorted({w[0] for w in words})}
    return rf"\b(?:{'|'.join(f'{c}(?:{more})' for c, more in rest.items())})\b"


#: Keywords of one token cannot overlap each other, nor can those of several; so each kind is found in one pass.
_KEYWORDS = sorted(w for _, words in fixed.INDUSTRIES for w in words)
_KEYWORD_PASSES = [_any_word([w for w in _KEYWORDS if w.isalnum() == single]) for single in (True, False)]


def keyword_hits(c: Column) -> Column:
    """All industry keywords in a text, as often as they occur; a keyword inside a longer one counts too."""
    return F.concat(*[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(0)) for p in _KEYWORD_PASSES])


def industry(visible: Column, path: Column | None = None, meta: Column | None = None) -> Column:
    """The industry of most keyword hits, the earlier on ties, ``general`` without hits; path and meta count double."""
    hits = F.concat(keyword_hits(visible), *[F.flatten(F.array_repeat(keyword_hits(F.lower(c)), 2)) for c in (path, meta) if c is not None])

    def best(found: Column) -> Column:
        count = lambda words: F.size(F.filter(found, lambda x: x.isin(*words)))
        counts = [F.struct(count(words).alias("score"), F.lit(-i).alias("place"), F.lit(n).alias("name")) for i, (n, words) in enumerate(fixed.INDUSTRIES)]
        return F.array_max(F.array(*counts))

    top = F.element_at(F.transform(F.array(hits), best), 1)  # inside a lambda, so that the hits are found once
    return F.when(top["score"] > 0, top["name"]).otherwise("general")
