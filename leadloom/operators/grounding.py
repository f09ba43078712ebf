"""Is a claim about a site borne out by the evidence that it cites? And the validator of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import copycheck, fixed
from ..functions.text import content_tokens, stem, strip

REF = r"^(pages(\[\d+\])?(\.[A-Za-z_]\w*(\[\d+\])*)*|[A-Za-z_]\w*(\[\d+\])*(\.[A-Za-z_]\w*(\[\d+\])*)*)$"
OUTPUT = (
    "status string, website_opportunity struct<category: string, observation: string, evidence: string, problem_type: string, confidence: double, evidence_refs: array<string>>, "
    "outreach_angle string, message string, fallback_message string"
)


def ref_path(ref: Column) -> Column:
    """A reference as a path into the evidence; a bare one is of the first page. Null where it is malformed."""
    r = F.trim(ref)
    full = F.when(r.rlike(r"^pages\b"), r).otherwise(F.concat(F.lit("pages[0]."), r))
    return F.when(r.rlike(REF), F.concat(F.lit("$."), full))


def resolve(evidence: Column, ref: Column) -> Column:
    """The variant that a reference names: SQL null if there is none, a variant null for JSON null."""
    return F.try_variant_get(evidence, ref_path(ref), "variant")


def overlap(claim: Column, support: Column) -> Column:
    """Share of a claim's content tokens, stemmed, that occur in the support; null for a claim without any."""
    have = F.array_distinct(F.transform(content_tokens(support), stem))
    told = F.transform(content_tokens(claim), stem)
    return F.size(F.filter(told, lambda t: F.array_contains(have, t))) / F.nullif(F.size(told), F.lit(0)).cast("double")


def overlaps(claims: DataFrame, supports: DataFrame) -> DataFrame:
    """item_id, doc_id, share of every claim (item_id, claim) with every support (doc_id, support), as ``overlap`` has it.

    The texts meet through the tokens that they share; a pair without any has 0. Ids are keys.
    """
    told = claims.select("item_id", F.transform(content_tokens(F.col("claim")), stem).alias("told"))
    have = supports.select("doc_id", F.explode(F.array_distinct(F.transform(content_tokens(F.col("support")), stem))).alias("token"))
    times = told.select("item_id", F.explode("told").alias("token")).groupBy("item_id", "token").agg(F.count("*").alias("times"))
    hits = have.join(times, "token").groupBy("item_id", "doc_id").agg(F.sum("times").alias("found"))
    pairs = told.select("item_id", F.size("told").alias("n")).crossJoin(supports.select("doc_id")).join(hits, ["item_id", "doc_id"], "left")
    return pairs.select("item_id", "doc_id", (F.coalesce("found", F.lit(0)) / F.nullif(F.col("n"), F.lit(0)).cast("double")).alias("share"))


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")


def ground(claims: DataFrame) -> DataFrame:
    """claims (id, evidence: JSON text, refs, stated) with ``ungrounded``: why, or null.

    References are exploded, resolved as variants and folded back; the support is the
    text of the cited pages, with field names, and the words of the references.
    """
    parsed = claims.select("id", F.try_parse_json("evidence").alias("_e"), F.posexplode_outer("refs").alias("_i", "_ref"))
    v = resolve(F.col("_e"), F.col("_ref"))
    page = F.coalesce(F.regexp_extract(F.trim("_ref"), r"^pages\[(\d+)\]", 1).try_cast("int"), F.lit(0))
    detection = F.try_variant_get("_e", F.concat(F.lit("$.pages["), page.cast("string"), F.lit("].price_detection")), "string")
    text = F.try_variant_get("_e", F.concat(F.lit("$.pages["), page.cast("string"), F.lit("]")), "string")
    named = F.concat(F.lit("evidence_ref "), F.col("_ref"))
    why = (
        F.when(F.col("_ref").isNull(), None)
        .when(v.isNull(), F.concat(F.lit("evidence_ref did not resolve: "), F.col("_ref")))
        .when(F.coalesce(F.to_json(v) == '"unknown"', F.lit(False)), F.concat(named, F.lit(" is 'unknown' - the extractor could not establish this, so it cannot support a finding")))
        .when(F.is_variant_null(v) & F.trim("_ref").rlike(r"\.price$") & (F.coalesce(detection, F.lit("")) != "absent"),
              F.concat(named, F.lit(" is a price we did not extract, and price_detection is not 'absent' - a missing extraction is not a missing price")))
    )
    folded = parsed.select("id", "_i", "_ref", why.alias("_why"), F.concat_ws(" ", _plain(F.col("_ref")), _plain(text)).alias("_support"))
    folded = folded.groupBy("id").agg(
        F.min_by("_why", F.when(F.col("_why").isNotNull(), F.col("_i"))).alias("_why"), F.count("_ref").alias("_n"),
        F.array_join(F.sort_array(F.collect_set("_support")), " ").alias("_support"),
    )
    both = claims.join(folded, "id", "left")
    share = overlap(F.col("stated"), F.col("_support"))
    ungrounded = (
        F.when(F.coalesce("_n", F.lit(0)) == 0, "no evidence_refs supplied").when(F.col("_why").isNotNull(), F.col("_why"))
        .when(share.isNull(), "stated evidence has no content")
        .when(share < fixed.MIN_OVERLAP, F.concat(F.lit("stated evidence overlaps the referenced content by "), F.floor(share * 100 + 0.5).cast("string"), F.lit(f"%, below the {fixed.MIN_OVERLAP * 100:.0f}% floor")))
    )
    return both.withColumn("ungrounded", ungrounded).drop("_why", "_n", "_support")


def validate(outputs: DataFrame) -> DataFrame:
    """One analysis for each row of outputs (id, raw: JSON text of the model, evidence: JSON text)."""
    df = outputs.withColumn("_o", F.from_json("raw", OUTPUT)).withColumn("_is", F.coalesce(F.trim("raw").startswith("{"), F.lit(False)))
    op = F.col("_o.website_opportunity")
    text = lambda c: F.coalesce(strip(c), F.lit(""))
    df = df.withColumns({
        "_category": text(op["category"]), "_seen": text(op["observation"]), "stated": text(op["evidence"]), "_message": text(F.col("_o.message")), "_angle": text(F.col("_o.outreach_angle")),
        "_type": F.lower(text(op["problem_type"])), "refs": op["evidence_refs"], "_back": text(F.col("_o.fallback_message")),
    })
    df = ground(df)
    status = F.col("_o.status")
    declined = status.isin("no_strong_opportunity", "insufficient_evidence")
    leaked = F.coalesce(copycheck.leak(F.col("_seen"), "observation"), copycheck.leak(F.col("stated"), "evidence"), copycheck.leak(F.col("_angle"), "outreach_angle"))
    # (test, status, reason, whether a usable fallback stays)
    none = F.lit(None).cast("string")
    steps = [
        (~F.col("_is") | F.col("_o").isNull(), F.lit("failed"), F.lit("model output was not an object"), False),
        (declined, status, none, True),
        (F.coalesce(status, F.lit("")) != "success", F.lit("failed"), F.concat(F.lit("unrecognised status: "), F.coalesce(status, F.lit("undefined"))), False),
        (op.isNull(), F.lit("failed"), F.lit("status was success with no website_opportunity"), False),
        ((F.col("_category") == "") | (F.col("_seen") == "") | (F.col("stated") == ""), F.lit("failed"), F.lit("website_opportunity was incomplete"), False),
        (F.col("_message") == "", F.lit("failed"), F.lit("status was success with no message"), False),
        (~F.col("_type").isin(*fixed.PROBLEM_TYPES), F.lit("no_strong_opportunity"), F.concat(F.lit("problem_type was "), F.coalesce(op["problem_type"], F.lit("undefined")), F.lit(", not one of " + "/".join(fixed.PROBLEM_TYPES))), False),
        (copycheck.not_a_problem(F.col("_seen")).isNotNull(), F.lit("no_strong_opportunity"), copycheck.not_a_problem(F.col("_seen")), True),
        (leaked.isNotNull(), F.lit("insufficient_evidence"), leaked, True),
        (F.col("ungrounded").isNotNull(), F.lit("insufficient_evidence"), F.col("ungrounded"), True),
        (copycheck.message_fault(F.col("_message")).isNotNull(), F.lit("insufficient_evidence"), copycheck.message_fault(F.col("_message")), True),
    ]
    out, reason, keep = F.lit("success"), none, F.lit(False)
    for test, s, why, stays in reversed(steps):
        test = F.coalesce(test, F.lit(False))
        out, reason, keep = F.when(test, s).otherwise(out), F.when(test, why).otherwise(reason), F.when(test, F.lit(stays)).otherwise(keep)
    df = df.withColumns({"_status": out, "_reason": reason, "_keep": keep})
    df = df.withColumn("_fallback", F.when(F.col("_keep") & (F.col("_back") != "") & copycheck.fallback_fault(F.col("_back")).isNull(), F.col("_back")))
    ok = F.col("_status") == "success"
    return df.select(
        "id", F.col("_status").alias("status"), F.when(ok, F.col("_category")).alias("opportunity_category"), F.when(ok, F.col("_seen")).alias("opportunity_observation"),
        F.when(ok, F.col("stated")).alias("opportunity_evidence"), F.when(ok, F.col("refs")).alias("evidence_refs"), F.when(ok, copycheck.confidence(op["confidence"])).alias("opportunity_confidence"),
        F.when(ok & (F.col("_angle") != ""), F.col("_angle")).alias("outreach_angle"), F.when(ok, F.col("_message")).alias("message"), F.col("_fallback").alias("fallback_message"),
        F.when(F.col("_fallback").isNotNull(), fixed.FALLBACK_CATEGORY).alias("fallback_category"), F.lit(False).alias("fallback_verified"), F.col("_reason").alias("rejected_reason"),
    )
