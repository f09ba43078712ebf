"""Brand matching: exact parts as equi-joins, near spellings on what is left.

The order of the list decides: of all brands that match a row the first wins. Within a
brand a domain, a run of name tokens, a run or one glued label of the domain, and a
near spelling are alternatives, so only the least list position is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import could_reach, normalize_text, sequence_ratio, tokens
from ..functions.urls import domain_labels

SIMILARITY, MIN_FUZZY = 0.90, 5
LISTED = 10_000


def _runs(parts, longest: int):
    """All runs of up to ``longest`` consecutive tokens, joined by a space."""
    n = F.size(parts)
    at = lambda k: F.transform(F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(parts, i, F.lit(k)), " "))
    return F.array_distinct(F.flatten(F.array(*[at(k) for k in range(1, longest + 1)])))


def match_brands(rows: DataFrame, brands: DataFrame, name: str, domain: str | None, generic_words: bool = False, scopes: tuple[str, ...] | None = None, fuzzy: bool = True, key: str = "row_id") -> DataFrame:
    """key, brand_pos, brand of the first brand that each row matches; rows without a match have no row.

    ``generic_words`` lets brands that are ordinary words match names, as is right for vendors.
    The brand list is broadcast up to LISTED rows; a longer one is joined as Spark sees fit.
    """
    brands = brands if scopes is None else brands.filter(F.col("scope").isin(*scopes))
    longest, n = brands.agg(F.coalesce(F.max(F.size(F.split("alias", " "))), F.lit(1)), F.count("*")).first()
    listed = F.broadcast if n <= LISTED else (lambda t: t)
    info = ["brand_pos", "brand"]
    by_name = brands.filter("alias IS NOT NULL" + ("" if generic_words else " AND match != 'generic_word'"))
    base = rows.select(F.col(key), tokens(normalize_text(F.col(name))).alias("words"), (F.lower(F.col(domain)) if domain else F.lit(None).cast("string")).alias("host"))
    base = base.withColumn("labels", domain_labels(F.col("host")))
    found = [
        base.select(key, F.explode(_runs(F.col("words"), longest)).alias("alias")).join(listed(by_name), "alias").select(key, *info),
        base.select(key, F.explode(_runs(F.col("labels"), longest)).alias("alias")).join(listed(brands), "alias").select(key, *info),
        base.select(key, F.explode("labels").alias("joined")).join(listed(brands), "joined").select(key, *info),
    ]
    # a host and all its parents
    parts = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = base.filter("host IS NOT NULL AND host != ''").select(key, F.explode(parents).alias("domain"))
    found.append(hosts.join(listed(brands.filter("domain IS NOT NULL")), "domain").select(key, *info))
    if fuzzy:
        single = by_name.filter(f"match = 'token' AND NOT alias LIKE '% %' AND length(alias) >= {MIN_FUZZY}").select(*info, "alias")
        word = base.select(key, F.explode(F.array_distinct("words")).alias("word")).filter(F.length("word") >= MIN_FUZZY)
        # distinct words first: the same word of many rows is compared once. Words that are so similar have two
        # neighbouring characters in common, so candidates come from an equi-join on those
        grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))).alias("gram")
        near = word.select("word").distinct().select("word", grams(F.col("word"))).join(listed(single.select("*", grams(F.col("alias")))), "gram")
        near = near.filter(could_reach(F.col("word"), F.col("alias"), SIMILARITY)).select("word", *info, "alias").distinct()
        near = near.withColumn("ratio", sequence_ratio(F.col("word"), F.col("alias"))).filter(F.col("ratio") >= SIMILARITY)
        found.append(word.join(near.select("word", *info), "word").select(key, *info))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy(key).agg(F.min(F.struct(*info)).alias("_first")).select(key, "_first.brand_pos", "_first.brand")
