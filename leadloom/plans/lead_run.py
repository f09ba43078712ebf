"""From search results to saved leads, as one plan.

discover -> first per domain -> not yet known -> page signals -> rules -> same business ->
priority -> at most ``target`` new leads, in order of discovery. Acquired data (pages,
catalogues, profiles) are input tables keyed by domain; a candidate without a page is
unreachable and is not remembered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contacts, fixed, names, scoring, urls
from ..functions.markup import page_signals
from ..operators import catalogue, discover, identity, qualify
from ..sources.schemas import IDENTIFIERS, LEADS, REJECTED, conform
from ..sources.shared import cut
from ..sources.store import TableStore, add_aliases, insert_absent


@dataclass
class Run:
    decided: DataFrame  # every analysed candidate with its verdict
    saved: DataFrame  # new leads, in the schema of leads but for their id
    rejected: DataFrame  # (domain, result)
    aliases: DataFrame  # (id of a kept lead, alias)
    counts: DataFrame  # one row


def discovery_id() -> Column:
    """The place in order of discovery, as one number; no window over all rows is needed."""
    return F.col("query_no").cast("long") * 10**9 + F.col("page").cast("long") * 10**5 + F.col("position").cast("long")


def analyse(cands: DataFrame, pages: DataFrame, products: DataFrame, profiles: DataFrame) -> DataFrame:
    """Candidates that have a page, with the signals that rules and score need.

    pages: domain, html, status, final_url; products: domain, body; profiles: handle, body.
    The element tree of a page is built once.
    """
    fetched = cands.join(pages.filter("html IS NOT NULL").select("domain", "html", "status", "final_url"), "domain")
    df = cut(fetched.withColumns({"tree": page_signals(F.col("html")), "flags": contacts.structure_flags(F.col("html"))}))
    root = urls.root_url(F.col("url"))
    df = df.withColumns({
        "row_id": discovery_id(), "website": root, "low": F.lower("html"), "email": contacts.email(F.col("html")), "phone": contacts.phone(F.col("html")), "whatsapp": contacts.whatsapp(F.col("html")),
        "is_available": contacts.store_is_open(F.col("status"), F.col("final_url"), F.col("html")), "found_name": names.choose_name(F.col("tree.site_names"), F.col("tree.title"), F.col("tree.og_title"), urls.name_from_domain(root)),
    })
    df = df.withColumn("business_name", F.coalesce("found_name", urls.name_from_domain(F.col("url"))))
    seen = df.select(F.col("domain").alias("site"), "business_name", "domain", F.explode("tree.mentions").alias("m")).select("site", "business_name", "domain", "m.*")
    own = identity.own_handles(identity.rank_handles(seen)).select(F.col("site").alias("domain"), F.col("handle").alias("instagram"))
    sold = catalogue.dominant_vendors(catalogue.parse_products(products, "domain", "body"), "domain").select("domain", "dominant_vendor", "dominant_share")
    count = profiles.select(F.lower("handle").alias("_h"), contacts.followers(F.col("body")).alias("instagram_followers"))
    df = df.join(own, "domain", "left").join(sold, "domain", "left").join(count, F.lower("instagram") == F.col("_h"), "left").drop("_h")
    signals = contacts.lebanon_signals(F.col("url"), F.col("low"), F.col("email"), F.col("instagram"), F.col("whatsapp"), F.col("tree.contact_text"), F.col("business_name"))
    return df.select(
        "row_id", "domain", "url", "website", "business_name", "email", "phone", "whatsapp", "instagram", urls.instagram_url(F.col("instagram")).alias("instagram_url"), "instagram_followers",
        F.col("flags.is_shopify").alias("is_shopify"), "is_available", signals.alias("lebanon_signals"), "dominant_vendor", "dominant_share", contacts.city(F.col("tree.visible_text")).alias("city"),
        contacts.industry(F.col("tree.visible_text")).alias("industry"), F.col("flags.hreflang_count").alias("hreflang_count"), F.col("flags.has_sentry").alias("has_sentry"),
        F.col("flags.has_store_locator").alias("has_store_locator"), contacts.corporate_terms(F.col("tree.contact_text")).alias("corporate_terms"),
    )


def lead_keys(leads: DataFrame) -> DataFrame:
    """The columns of leads that records are compared by."""
    return leads.select("id", "domain", F.col("instagram_url").alias("instagram"))


def _until_enough(fresh: DataFrame, judge: Callable[[DataFrame], DataFrame], index: Callable[[DataFrame], DataFrame], target: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decided, qualified, kept) of candidates in order of discovery, as many as ``target`` new leads take.

    Candidates are judged in windows. All windows together double from round to round, from ``target``
    on, and no fewer than ``target`` are ever needed: at most twice as many pages are analysed as the stop needs.
    """
    at, size, parts = -1, target, []
    while True:
        some = cut(fresh.filter(F.col("row_id") > at).orderBy("row_id").limit(size))
        last, n = some.agg(F.max("row_id"), F.count("*")).first()
        parts.append(cut(judge(some)))
        decided = reduce(DataFrame.unionByName, parts)
        good = decided.filter("qualified")
        # only the keys that a lead row carries are compared; leads come before all candidates
        after = cut(good.select(F.col("row_id").alias("id"), "domain", F.col("instagram_url").alias("instagram")))
        if n < size or after.count() >= target:  # before that there cannot be enough
            before = index(identity.identifiers(after)).select("key", (F.col("id") - F.lit(1 << 40)).alias("id"))
            kept = cut(identity.kept_and_aliases(after, known=before))
            if n < size or kept.filter("id = kept_id").count() >= target:
                return decided, good, kept
        at, size = last, target << (len(parts) - 1)


def lead_run(results: DataFrame, pages: DataFrame, products: DataFrame, profiles: DataFrame, brands: DataFrame, leads: DataFrame, rejected: DataFrame, now: Column, target: int = fixed.MAX_NEW_LEADS, known: Callable[[DataFrame], DataFrame] | None = None) -> Run:
    """known finds the (key, id) of leads for new records with identifiers; without it all leads are looked through.

    ``decided`` holds the candidates that were analysed, which end soon after the stop.
    """
    found = cut(discover.candidates(results).withColumn("row_id", discovery_id()))
    fresh = cut(discover.unknown_only(found, leads, rejected))
    index = known or (lambda rows: identity.identifier_index(identity.identifiers(lead_keys(leads))))
    decided, good, kept = _until_enough(fresh, lambda some: qualify.decide(analyse(some, pages, products, profiles), brands), index, target)
    new = good.join(kept.filter("id = kept_id").select(F.col("id").alias("row_id")), "row_id")
    taken = cut(new.orderBy("row_id").limit(target))
    last = taken.agg(F.max("row_id"), F.count("*")).first()
    stop = last[0] if last[1] >= target else (1 << 62)
    present = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    score = scoring.priority(present("instagram_url"), present("whatsapp"), present("email"), present("phone"), scoring.lebanon_tier(F.col("lebanon_signals")), F.col("dominant_share"), F.col("instagram_followers"))
    keyed = identity.identifiers(taken.select("domain", "instagram_url", "business_name").withColumn("instagram", F.col("instagram_url")))
    saved = taken.withColumn("s", score).join(keyed.select("domain", identity.identity_key().alias("identity_key")), "domain").select(
        "row_id", "business_name", "instagram_url", "website", "domain", "identity_key", now.cast("timestamp").alias("created_at"), F.col("s.score").alias("contact_priority_score"), F.col("s.band").alias("contact_priority"),
        F.col("s.reasons").alias("contact_priority_reasons"), "instagram_followers", present("email").alias("has_email"), present("phone").alias("has_phone"), present("whatsapp").alias("has_whatsapp"), "dominant_share",
        scoring.lebanon_tier(F.col("lebanon_signals")).alias("lebanon_signal_tier"), "industry", "city", "hreflang_count", "has_sentry", "has_store_locator",
    )
    up_to = decided.filter(F.col("row_id") <= stop)
    no = up_to.filter("NOT qualified").select("domain", F.col("reason").alias("result"), now.cast("timestamp").alias("checked_at"))
    alias = kept.filter(f"id != kept_id AND id <= {stop}").join(good.select(F.col("row_id").alias("id"), F.col("domain").alias("alias")), "id").select("kept_id", "alias")
    counts = (
        found.filter(F.col("row_id") <= stop).agg(F.count("*").alias("discovered"))
        .join(up_to.agg(F.count("*").alias("analysed"), *[F.count_if(F.col("reason") == r).alias(r) for r in qualify.REASONS]))
        .join(fresh.filter(F.col("row_id") <= stop).agg(F.count("*").alias("fresh"))).join(alias.agg(F.count("*").alias("aliases"))).join(saved.agg(F.count("*").alias("saved")))
    )  # joins of single rows
    counts = counts.select("discovered", (F.col("discovered") - F.col("fresh") + F.col("aliases")).alias("already_known"), (F.col("fresh") - F.col("analysed")).alias("unreachable"), "analysed", *qualify.REASONS, "saved")
    return Run(decided, saved, no, alias, counts)


def run_and_store(store: TableStore, results: DataFrame, pages: DataFrame, products: DataFrame, profiles: DataFrame, brands: DataFrame, now: Column, target: int = fixed.MAX_NEW_LEADS) -> Run:
    """``lead_run`` on a store's tables; new leads get ids above the highest there is.

    New leads, aliases, rejections and the index of identifiers become visible together. Of the index only the buckets
    are read that the new records' identifiers fall into; a store without one gets it from its leads.
    """
    leads, rejected = store.read("leads", LEADS), store.read("rejected_sites", REJECTED)
    has_index = bool(store.versions("lead_identifiers"))

    def known(rows: DataFrame) -> DataFrame:
        if not has_index:
            return identity.identifier_index(identity.identifiers(lead_keys(leads)))
        keys = cut(identity.identifier_index(rows).select("key"))
        return store.read("lead_identifiers", IDENTIFIERS, store.buckets_of(keys, "key")).join(keys, "key", "left_semi")

    run = lead_run(results, pages, products, profiles, brands, leads, rejected, now, target, known)
    top = leads.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = insert_absent(leads, run.saved, "domain", F.col("row_id"))
    # ``target`` bounds the rows that are numbered here
    rows = new.orderBy("row_id").collect()
    numbered = leads.sparkSession.createDataFrame([(r.row_id, top + i + 1) for i, r in enumerate(rows)], "row_id long, id long")
    added = cut(conform(new.join(numbered, "row_id"), LEADS))
    alias = run.aliases.join(numbered.withColumnRenamed("row_id", "kept_id"), "kept_id", "left").select(F.coalesce("id", F.col("kept_id") + F.lit(1 << 40)).alias("id"), "alias")
    aliased = cut(alias)
    # the rows that change: new leads, and leads that got an alias
    changed = cut(add_aliases(leads.join(aliased.select("id").distinct(), "id", "left_semi").select(leads.columns).unionByName(added), aliased))
    with store.changes() as change:
        change.upsert("leads", LEADS, changed, "domain", F.asc("id"))
        change.upsert("rejected_sites", REJECTED, cut(run.rejected), "domain", F.desc("checked_at"))
        entries = identity.identifier_index(identity.identifiers(lead_keys(added if has_index else conform(leads, LEADS).unionByName(added))))
        change.insert("lead_identifiers", IDENTIFIERS, cut(entries), "key", F.asc("id"))
    return run
