"""Reads of stored leads and analyses, run states, and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.schemas import MIRRORED
from .order import numbered

PAGE_SIZE = 50
RUNS_LISTED = 20
FAILURES = fixed.FAILURES


def text_search(df: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows with the term in any column, in either case; % and _ of the term stay wildcards."""
    term = term.strip()
    if not term:
        return df
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
    return df.filter(test)


def page_of(df: DataFrame, order: list[Column], offset: int = 0, limit: int = PAGE_SIZE) -> DataFrame:
    """One page in a total order; a top-k, so nothing is sorted whole."""
    return df.orderBy(*order).offset(offset).limit(limit)


def leads_page(leads: DataFrame, search: str = "", offset: int = 0, limit: int = PAGE_SIZE) -> tuple[DataFrame, int]:
    """(rows newest first, count of all that match); the count is an aggregate of its own and reads no columns but those searched."""
    found = text_search(leads, search, "business_name", "domain")
    return page_of(found, [F.desc("created_at"), F.asc("domain")], offset, limit), found.count()


def refreshed(leads: DataFrame, loaded: int, search: str = "") -> tuple[DataFrame, int]:
    return leads_page(leads, search, 0, max(loaded, PAGE_SIZE))


def has_more(loaded: int, total: int) -> bool:
    return loaded < total


def since(df: DataFrame, last_id: int, key: str = "id") -> DataFrame:
    """Rows above a high-water mark, in order; the filter reaches the scan."""
    return df.filter(F.col(key) > last_id).orderBy(key)


def mirror_payload(leads: DataFrame) -> DataFrame:
    """The mirrored columns, always all of them; flags stored as numbers become booleans, null stays null."""
    flags = {"has_email", "has_phone", "has_whatsapp", "has_sentry", "has_store_locator"}
    source = {"website_url": "website"}
    return leads.select(*[F.col(source.get(c, c)).cast("boolean").alias(c) if c in flags else F.col(source.get(c, c)).alias(c) for c in MIRRORED])


def dry_run(payload: DataFrame) -> DataFrame:
    return payload.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload"))


def lead_by_domain(leads: DataFrame, domain: str) -> DataFrame:
    return leads.filter(F.col("domain") == domain.strip().lower()).limit(1)


def with_analysis(leads: DataFrame, analyses: DataFrame) -> DataFrame:
    """leads with their analysis, if it did not fail."""
    usable = analyses.filter("status != 'failed'")
    return leads.join(usable.select("domain", F.struct(*[c for c in usable.columns if c != "domain"]).alias("analysis")), "domain", "left")


def stored_view(analyses: DataFrame) -> DataFrame:
    """What a reader may see: a message only on success, a fallback only without, which is never verified."""
    ok = F.col("status") == "success"
    return analyses.select(
        "domain", "status", F.when(ok, F.struct(F.col("opportunity_category").alias("category"), F.col("opportunity_observation").alias("observation"), F.col("opportunity_evidence").alias("evidence"), F.col("opportunity_confidence").alias("confidence"))).alias("opportunity"),
        "outreach_angle", F.when(ok, F.col("message")).alias("message"), F.when(~ok, F.col("fallback_message")).alias("fallback_message"),
        F.when(~ok, F.col("fallback_category")).alias("fallback_category"), F.lit(False).alias("fallback_verified"), "pages_fetched",
    )


def failure_text(code: Column) -> Column:
    out = F.lit("Could not analyze this lead right now.")
    for k, text in FAILURES.items():
        out = F.when(code == k, text).otherwise(out)
    return out


def run_state(status: Column, conclusion: Column) -> Column:
    done = F.when(conclusion == "success", "completed_success").otherwise("completed_failure")
    return F.when(status == "completed", done).when(status == "in_progress", "in_progress").otherwise("queued")


def is_active(status: Column) -> Column:
    return F.coalesce(status.isin(*fixed.ACTIVE_RUN_STATES), F.lit(False))


def listed_runs(runs: DataFrame, branch: str, limit: int = RUNS_LISTED) -> DataFrame:
    """(id, status, conclusion, list_pos) of the newest runs of a branch; a top-k, numbered afterwards."""
    newest = runs.filter(F.col("branch") == branch).orderBy(F.desc("id")).limit(limit)
    return newest.select("id", "status", "conclusion", F.row_number().over(W.orderBy(F.desc("id"))).alias("list_pos"))


def run_cursor(runs: DataFrame) -> DataFrame:
    """(already_running, after) of runs (list_pos, id, status): below the first active one, else at the highest id."""
    one = runs.agg(F.min_by("id", F.when(is_active(F.col("status")), F.col("list_pos"))).alias("active"), F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return one.select(F.col("active").isNotNull().alias("already_running"), F.coalesce(F.col("active") - 1, F.col("top")).alias("after"))


def newest_run(runs: DataFrame, after: int) -> DataFrame:
    """(state, run_id) of the highest run above a cursor; queued where there is none yet."""
    one = runs.filter(F.col("id") > after).agg(F.max("id").alias("run_id"), F.max_by(F.struct("status", "conclusion"), "id").alias("r"))
    return one.select(F.when(F.col("run_id").isNull(), "queued").otherwise(run_state(F.col("r.status"), F.col("r.conclusion"))).alias("state"), "run_id")


def delta(before: Column, after: Column) -> Column:
    return after - before


def shown_score(score: Column) -> Column:
    """'not scored' for an unknown score, never 0."""
    return F.when(score.isNull(), "not scored").otherwise(F.concat(score.cast("string"), F.lit("/10")))


def confusion(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    """tp, fp, fn, tn, excluded, precision, recall, accuracy; rows without a truth or a verdict are excluded."""
    known = truth.isNotNull() & said.isNotNull()
    n = lambda t, s: F.count_if(known & (truth == t) & (said == s))
    c = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"), F.count_if(~known).alias("excluded"))
    share = lambda a, b: F.try_divide(a, b)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "accuracy": share(tp + tn, tp + fp + fn + tn)})


def novelty(df: DataFrame, batch: str, key: str) -> DataFrame:
    """For each batch: rows, keys not seen in any earlier batch, and their percentage."""
    first = df.groupBy(key).agg(F.min(batch).alias("_first"))
    per = df.groupBy(batch).agg(F.count("*").alias("seen"), F.count_distinct(key).alias("distinct_keys"))
    new = first.groupBy(F.col("_first").alias(batch)).agg(F.count("*").alias("new_keys"))
    return per.join(new, batch, "left").select(batch, "seen", "distinct_keys", F.coalesce("new_keys", F.lit(0)).alias("new_keys"), F.round(F.lit(100.0) * F.coalesce("new_keys", F.lit(0)) / F.col("distinct_keys"), 2).alias("new_pct"))


def review_queue(df: DataFrame, tier: str, group: str, order: str) -> DataFrame:
    """Round robin: the first of every group of a tier, then the second, and so on.

    Places are counted by ranges of the order, so neither a tier nor a group is one task.
    """
    turned = numbered(df, [tier, group], [F.asc(order)], "turn")
    return numbered(turned, [tier], [F.asc("turn"), F.asc(group), F.asc(order)])
