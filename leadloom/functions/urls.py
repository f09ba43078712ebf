"""URL and domain expressions; no UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"


def _netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME + r"//([^/?#]*)", 1))


def _bare(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME + r"([^/?#]*)", 1))


def _no_port(host: Column) -> Column:
    return F.regexp_replace(host, ":.*$", "")


def clean_host(url: Column) -> Column:
    """Lower-case host without a leading ``www.`` and port; the first path segment where there is no scheme."""
    net = _netloc(url)
    return _no_port(F.regexp_replace(F.when(net != "", net).otherwise(_bare(url)), r"^www\.", ""))


def root_url(url: Column) -> Column:
    """scheme://host, with www., without port; https where there is no scheme."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = _no_port(_netloc(full))
    return F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), F.when(host != "", host).otherwise(clean_host(url)))


def host_in(host: Column, hosts: tuple[str, ...]) -> Column:
    """Is it one of these hosts or below one?"""
    return reduce(lambda a, b: a | b, [(host == h) | host.endswith("." + h) for h in hosts])


def is_ignored_host(url: Column) -> Column:
    """Hosts that are never candidates; a URL without scheme has no host and is never ignored."""
    return F.coalesce(host_in(F.regexp_replace(_netloc(url), r"www\.", ""), fixed.IGNORED_HOSTS), F.lit(False))


def is_platform_domain(domain: Column) -> Column:
    return F.coalesce(host_in(F.lower(domain), fixed.PLATFORM_DOMAINS), F.lit(False))


def registrable_domain(domain: Column) -> Column:
    """The last two labels, or three under a second-level suffix such as ``com.xx``; platform hosts whole."""
    host = F.regexp_replace(F.regexp_replace(F.trim(F.lower(domain)), r"\.+$", ""), r"^www\.", "")
    parts = F.split(host, r"\.")
    n = F.size(parts)
    three = F.element_at(parts, -2).isin(*fixed.SECOND_LEVEL) & (F.length(F.element_at(parts, -1)) == 2)
    last = lambda k: F.array_join(F.slice(parts, -k, k), ".")
    out = F.when(is_platform_domain(host) | (n <= 2), host).when(three, last(3)).otherwise(last(2))
    return F.when(F.length(domain) > 0, out)


def domain_labels(domain: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(domain, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def is_valid_domain(domain: Column) -> Column:
    d = F.lower(F.trim(domain))
    return F.coalesce((F.length(d) > 0) & (F.length(d) <= 253) & d.rlike("^[a-z0-9.-]+$"), F.lit(False))


def name_from_domain(url: Column) -> Column:
    """A readable name from a host: platform parts dropped, glued words split, capitalised."""
    host = clean_host(url)
    dropped = [*fixed.DOMAIN_DROP, *fixed.DOMAIN_PREFIX_DROP]
    tokens = F.flatten(F.transform(F.filter(F.split(host, r"\."), lambda p: ~p.isin(*dropped)), lambda p: F.split(p, "-")))

    def split_words(token: Column) -> Column:
        for word in sorted(fixed.DOMAIN_WORDS, key=len, reverse=True):
            token = F.replace(token, F.lit(word), F.lit(f" {word} "))
        return F.split(token, r"\s+")

    words = F.filter(F.flatten(F.transform(tokens, split_words)), lambda w: (w != "") & ~w.isin(*fixed.DOMAIN_DROP))
    words = F.when(F.size(words) == 0, F.array(host)).otherwise(words)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))), " ")


def instagram_url(value: Column) -> Column:
    """The canonical profile URL of a handle or URL, or null."""
    text = F.trim(value)
    full = F.when(text.contains("//"), text).otherwise(F.concat(F.lit("https://"), text))
    path = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    part = F.when(F.lower(text).contains("instagram.com"), path).otherwise(text)
    part = F.regexp_replace(part, "^/+|/+$", "")
    handle = F.lower(F.trim(F.regexp_replace(F.regexp_extract(part, "^([^/?#]*)", 1), "^@+", "")))
    good = handle.rlike(r"^[a-z0-9._]{1,30}$") & ~handle.rlike(r"^\.+$") & ~handle.isin(*fixed.IGNORED_INSTAGRAM_PATHS)
    return F.when(good, F.concat(F.lit("https://www.instagram.com/"), handle, F.lit("/")))


def display_handle(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?i)instagram\.com/([^/?#]+)", 1)
    return F.when(found != "", F.concat(F.lit("@"), found)).otherwise("Instagram")


def display_host(url: Column) -> Column:
    """The host of an absolute URL, else the text as it is."""
    host = _no_port(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), "^.*@", ""))
    return F.when(host != "", F.lower(host)).otherwise(url)
