"""Contact priority: capped sums of what is known; unknown is neutral, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import general_number

#: Points, caps and bands.
REACH = (("ig", 2.0), ("wa", 2.0), ("email", 1.5), ("phone", 0.5))
TIERS = (("strong", 2.0), ("claim", 1.0), ("medium", 0.5), ("none", 0.0))
REACH_CAP, RELEVANCE_CAP, AUDIENCE_CAP = 6.0, 3.0, 1.0
OWN_BRAND, OWN_BRAND_SHARE = 1.0, 0.80
ESTABLISHED, SMALL, UNKNOWN, ESTABLISHED_AT = 1.0, 0.5, 0.5, 1000
BANDS = ((8, "high"), (5, "medium"), (1, "low"))


def lebanon_tier(signals: Column) -> Column:
    some = lambda k: F.coalesce(F.size(signals[k]), F.lit(0)) > 0
    return F.when(some("strong"), "strong").when(some("claim"), "claim").when(some("medium"), "medium").otherwise("none")


def band(score: Column) -> Column:
    out = F.lit("low")
    for floor, name in reversed(BANDS):
        out = F.when(score >= floor, name).otherwise(out)
    return out


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("int")


def _named(flags: list[tuple[str, Column]]) -> Column:
    found = F.array_join(F.array_compact(F.array(*[F.when(c, n if isinstance(n, Column) else F.lit(n)) for n, c in flags])), ",")
    return F.when(found == "", "none").otherwise(found)


def priority(has_ig: Column, has_wa: Column, has_email: Column, has_phone: Column, tier: Column, share: Column, followers: Column) -> Column:
    """struct(score 1 to 10, band, reasons)."""
    flags = list(zip([n for n, _ in REACH], (has_ig, has_wa, has_email, has_phone), strict=True))
    reach = F.least(sum((F.when(c, w).otherwise(0.0) for (_, w), (_, c) in zip(REACH, flags, strict=True)), F.lit(0.0)), F.lit(REACH_CAP))
    own = F.coalesce(share >= OWN_BRAND_SHARE, F.lit(False))
    points = F.lit(0.0)
    for name, w in TIERS:
        points = F.when(tier == name, w).otherwise(points)
    relevance = F.least(points + F.when(own, OWN_BRAND).otherwise(0.0), F.lit(RELEVANCE_CAP))
    audience = F.least(F.when(followers.isNull(), UNKNOWN).when(followers >= ESTABLISHED_AT, ESTABLISHED).otherwise(SMALL), F.lit(AUDIENCE_CAP))
    score = F.greatest(F.lit(1), F.least(F.lit(10), half_up(reach + relevance + audience)))
    reasons = F.concat(
        F.lit("reach="), general_number(reach), F.lit("("), _named(flags), F.lit(") relevance="), general_number(relevance), F.lit("("),
        _named([(tier, tier != "none"), ("own-brand", own)]), F.lit(") audience="), general_number(audience), F.lit("("),
        F.coalesce(followers.cast("string"), F.lit("unknown")), F.lit(")"),
    )
    return F.struct(score.alias("score"), band(score).alias("band"), reasons.alias("reasons"))


def relative_time(at: Column, now: Column) -> Column:
    """'3 days ago', 'yesterday', 'in 2 hours', against a given now; a dash where there is no time."""
    seconds = F.unix_timestamp(at) - F.unix_timestamp(now)
    size = F.abs(seconds)
    steps = ((60, 1, "second"), (3600, 60, "minute"), (86_400, 3600, "hour"), (2_592_000, 86_400, "day"), (31_536_000, 2_592_000, "month"))
    n, unit = F.floor(seconds / F.lit(31_536_000.0) + 0.5), F.lit("year")
    for below, by, name in reversed(steps):
        n, unit = F.when(size < below, F.floor(seconds / F.lit(float(by)) + 0.5)).otherwise(n), F.when(size < below, name).otherwise(unit)
    plural = F.when(F.abs(n) == 1, unit).otherwise(F.concat(unit, F.lit("s")))
    text = F.when(n < 0, F.concat((-n).cast("string"), F.lit(" "), plural, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), n.cast("string"), F.lit(" "), plural))
    words = F.when((unit == "second") & (n == 0), "now")
    for name, before, same, after in (("day", "yesterday", "today", "tomorrow"), ("month", "last month", "this month", "next month"), ("year", "last year", "this year", "next year"), ("hour", None, "this hour", None), ("minute", None, "this minute", None)):
        for k, w in ((-1, before), (0, same), (1, after)):
            words = words.when((unit == name) & (n == k), w) if w else words
    return F.when(seconds.isNull(), "—").otherwise(F.coalesce(words, text))


def exact_time(at: Column) -> Column:
    """A time as 1/5/2024, 9:07:03 AM; text that is no time as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(at), "M/d/yyyy, h:mm:ss a"), at)
