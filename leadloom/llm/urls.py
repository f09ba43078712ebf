"""URL filters by a path-template tree.

Urls are reduced to (host, path segments) and counted; the tree of each host is then
grown level by level on those counts. A node's segment is variable, and all its branches
become the wildcard ``*``, where the Good-Turing share of rows whose segment would be a
new one is at least UNSEEN (and it has LEAST_KIDS branches). Else a branch of TESTED rows
or more is generalised where it is statistically like its node's branches together, by
two chi-square tests: of the shapes of what follows it (runs of letters and of digits,
in SUFFIX_BUCKETS buckets), and of its labels, over labelled rows alone, so that a branch
without labels joins by its shapes. Generalised branches of one node are one branch from
there on, and a template's labels speak for all its rows. A template is rejected if its
labelled purity, smoothed by PRIOR_ROWS rows of the overall rate, is at least
LEAST_PURITY; one without a labelled row is allowed.

Levels are DataFrame aggregates, so a hot host is counted map-side first; each level is
written to the shared folder. A node with one distinct path left is finished as it is, so
there are as many levels as templates have that several paths share, and no limit.

Null urls and urls without ``://`` have an empty host and path; no rule reaches them and
their template, the empty path, is allowed unless labelled rows of an empty host say
otherwise. Long urls are like others. Repeated rows count as often as they occur and get
equal results; null ids keep theirs; an empty table gives no rows. Columns other than
``page_id`` and ``url`` are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable

#: (rule, verdict) of the query; a rule is a host, then a path that starts with /.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SUFFIX_BUCKETS = 8
#: Chi-square at 0.001 for SUFFIX_BUCKETS - 1 and for 1 degree of freedom.
CHI_SUFFIX, CHI_LABEL = 24.32, 10.83
TESTED = 5
UNSEEN, LEAST_KIDS = 0.5, 5
PRIOR_ROWS, LEAST_PURITY = 4.0, 0.8


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        of_host, of_path = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _chi(parts: list[str], n: str, pool_n: str) -> Column:
    """Chi-square of a branch's counts against its node's shares; empty cells count nothing."""
    total = F.lit(0.0)
    for c in parts:
        want = F.try_divide(F.col(n) * F.col(f"pool_{c}"), F.col(pool_n))
        total = total + F.when(want > 0, (F.col(c) - want) * (F.col(c) - want) / want).otherwise(0.0)
    return total


def path_templates(urls: DataFrame) -> DataFrame:
    """host, shape (the path's segments), template, with the template's rows, labelled and blocked rows.

    urls: host, path and label (1 reject, 0 keep, null unknown), one row per url.
    """
    counted = urls.select("host", segments(F.col("path")).alias("segs"), "label").groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count("label").alias("lab"), F.coalesce(F.sum("label"), F.lit(0)).alias("blk")
    )
    names = ["host", "segs", "n", "lab", "blk", "tmpl"]
    open_ = durable(counted.withColumn("tmpl", F.lit("")), "url-shapes")
    done, d = open_.filter(F.size("segs") == 0), 0
    open_ = open_.filter(F.size("segs") > 0)
    sums = ["n", "lab", "keep", "blk", *[f"b{i}" for i in range(SUFFIX_BUCKETS)]]
    while not open_.isEmpty():
        rest = open_.withColumn("seg", F.element_at("segs", d + 1))
        shape = F.regexp_replace(F.regexp_replace(F.array_join(F.slice("segs", d + 2, F.size("segs")), "/"), "\\p{L}+", "a"), "[0-9]+", "0")
        bucket = F.pmod(F.xxhash64(shape), F.lit(SUFFIX_BUCKETS))
        branch = rest.withColumn("bucket", bucket).groupBy("host", "tmpl", "seg").agg(
            F.count("*").alias("paths"), F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum(F.col("lab") - F.col("blk")).alias("keep"), F.sum("blk").alias("blk"),
            *[F.sum(F.when(F.col("bucket") == i, F.col("n")).otherwise(0)).alias(f"b{i}") for i in range(SUFFIX_BUCKETS)],
        )
        branch = durable(branch, "url-branches")
        node = branch.groupBy("host", "tmpl").agg(
            F.count("*").alias("kids"), F.sum("paths").alias("all_paths"), F.sum((F.col("n") == 1).cast("int")).alias("singles"), *[F.sum(c).alias(f"pool_{c}") for c in sums]
        )
        node = durable(node, "url-nodes")  # so that the join reads plain tables, whose hot keys Spark can split
        variable = (F.col("kids") >= LEAST_KIDS) & (F.col("singles") >= UNSEEN * F.col("pool_n"))
        alike = (F.col("n") >= TESTED) & (_chi(sums[4:], "n", "pool_n") < CHI_SUFFIX) & (_chi(sums[2:4], "lab", "pool_lab") < CHI_LABEL)
        goes = F.when((F.col("kids") > 1) & (variable | alike), "*").otherwise(F.col("seg"))
        to = branch.join(node, ["host", "tmpl"]).select("host", "tmpl", "seg", goes.alias("to"), (F.col("all_paths") == 1).alias("alone"))
        grown = rest.join(to, ["host", "tmpl", "seg"])
        whole = F.concat("tmpl", F.lit("/"), F.array_join(F.slice("segs", d + 1, F.size("segs")), "/"))
        tmpl = F.when(F.col("alone"), whole).otherwise(F.concat("tmpl", F.lit("/"), "to"))
        grown = durable(grown.select(*names[:-1], tmpl.alias("tmpl"), (F.col("alone") | (F.size("segs") == d + 1)).alias("ends")), "url-level")
        done = done.unionByName(grown.filter("ends").select(names))
        open_, d = grown.filter("NOT ends").select(names), d + 1
    stats = done.groupBy("host", "tmpl").agg(F.sum("n").alias("t_rows"), F.sum("lab").alias("t_labelled"), F.sum("blk").alias("t_blocked"))
    stats = durable(stats, "url-stats")  # as for nodes: a hot template is split only if both sides are plain tables
    return done.join(stats, ["host", "tmpl"]).select("host", F.array_join("segs", "/").alias("shape"), F.col("tmpl").alias("template"), "t_rows", "t_labelled", "t_blocked")


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of pages.

    Urls with a rule are the labelled rows from which templates are judged.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict}).withColumn("label", (F.col("said") == "block").cast("int"))
    templates = durable(path_templates(rows), "url-templates")
    blocked, labelled = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("label")).first()
    prior = blocked / labelled if labelled else 0.0
    purity = (F.col("t_blocked") + F.lit(PRIOR_ROWS * prior)) / (F.col("t_labelled") + F.lit(PRIOR_ROWS))
    judged = templates.withColumn("purity", purity)
    out = rows.withColumn("shape", F.array_join(segments(F.col("path")), "/")).join(judged, ["host", "shape"], "left")
    mine = F.when((F.col("t_labelled") > 0) & (F.col("purity") >= LEAST_PURITY), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", mine).alias("verdict"), "template", "purity")
