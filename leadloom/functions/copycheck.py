"""Validators of written messages and observations; ordered CASE expressions, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import any_of, ascii_words, first_of, word_count

_DEFICIENCIES = tuple(map(ascii_words, fixed.DEFICIENCIES))


def _pattern(c: Column, patterns: tuple[str, ...], prefix: str = "") -> Column:
    """The first pattern found, as text, or null."""
    return first_of(c, patterns, lambda x, p: x.rlike(prefix + ascii_words(p)))


def leak(text: Column, field: str) -> Column:
    """Why a text shows internal names, or null."""
    found = _pattern(text, fixed.LEAKS, "(?i)")
    return F.when(found.isNotNull(), F.concat(F.lit(f"{field} exposes internal evidence representation ("), found, F.lit(")")))


def not_a_problem(observation: Column) -> Column:
    """Why an observation is no deficiency, or null."""
    text = F.lower(observation)
    praise = _pattern(text, fixed.PRAISES)
    return (
        F.when(~any_of(text, _DEFICIENCIES), "observation describes something that exists and works rather than something missing, hidden, unclear or broken - the presence of a good feature is not an opportunity")
        .when(praise.isNotNull(), F.concat(F.lit("observation reads as a compliment ("), praise, F.lit(") rather than a problem")))
    )


def message_fault(message: Column) -> Column:
    """The first rule that a message breaks, or null."""
    n = word_count(message)
    low = F.lower(message)
    phrase = first_of(low, fixed.BANNED_PHRASES, lambda x, p: x.contains(p))
    praise = _pattern(low, fixed.PRAISES)
    count = F.concat(F.lit("message is "), n.cast("string"), F.lit(" words, "))
    return (
        F.when(n < fixed.WORDS_MIN, F.concat(count, F.lit(f"under the {fixed.WORDS_MIN}-word minimum")))
        .when(n > fixed.WORDS_MAX, F.concat(count, F.lit(f"over the {fixed.WORDS_MAX}-word maximum")))
        .when(phrase.isNotNull(), F.concat(F.lit('message contains a banned phrase: "'), phrase, F.lit('"')))
        .when(~message.contains("?"), "message has no question to reply to")
        .when(praise.isNotNull(), F.concat(F.lit("message compliments rather than raises a problem ("), praise, F.lit(")")))
        .otherwise(leak(message, "message"))
    )


def fallback_fault(message: Column) -> Column:
    """As ``message_fault``; a fallback may also claim nothing about the site."""
    low = F.lower(message)
    return F.coalesce(
        message_fault(message),
        F.when(low.rlike(ascii_words(fixed.NOTICING)) & any_of(low, _DEFICIENCIES), "fallback asserts a specific website problem; a fallback must claim nothing about the site it has not verified")
        .when(low.rlike(ascii_words(fixed.WEAKNESS)), "fallback describes a specific weakness it has not verified"),
    )


def confidence(x: Column) -> Column:
    """A finite number held to [0, 1], else null."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
