"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Every source has a target number of words, and every document of it an expected number of
copies, proportional to a measure of its size: 2 to the power of half its binary digits,
which grows as the square root does. It is held to ``most``, and what is above goes to the
other documents, so that expected words add up to the target. A document first gets the
whole copies that are certain (the floor of that number); what is over is its inclusion
probability for one copy more. That is drawn by a Pareto order sample: documents are ranked
by the odds of a seeded uniform number divided by the odds of their inclusion probability,
and taken in that order until the rest of the target is reached, to half a document.

The ranking is never gathered. Documents are summed for each source and measure (there are
some thirty of them), and rank keys for each source and bin: DIGITS bins, then as many
inside the bin in which a source crosses its target, LEVELS times; only the last bin is
ordered row by row, rows of one id as one. A decision is then a comparison with one row
per source and measure, so repeated rows behave alike and a hot source needs no shuffle of
its texts. Sources are ordered in ranges, with sums of the ranges before, so no task holds
all of them.

Null or empty texts have size 0, are taken 0 times their size and stay in the mix once.
Null sources form one source, ordered last. Null ids draw the number of the text 'null'.
Repeated rows share their number and, if equally long, are in or out together. Very long
texts are like others. An empty table gives no rows. Columns other than doc_id, source and
text are ignored by ``mixed_sizes`` and kept by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, durable

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
DIGITS, LEVELS = 256, 3
SEED = 20
KEYS = ("mix_null", "mix_source")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """52 bits of MD5 of the id and the seed, in (0, 1)."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def _key(source: Column) -> list[Column]:
    return [source.isNull().alias("mix_null"), F.coalesce(source, F.lit("")).alias("mix_source")]


def measure_class(size: Column) -> Column:
    """Half the binary digits of a size; its measure is 2 to that power."""
    return F.floor(F.length(F.bin(size)) / 2).cast("int")


def _before(df: DataFrame, order: list[Column], sums: dict[str, Column], what: str) -> DataFrame:
    """df with the sums of columns over all rows that come before in this order; in ranges of the order."""
    ranged = durable(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), what)
    totals = ranged.groupBy("part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"all_{n}") for n in sums])  # a row for each range
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"own_{n}") for n, c in sums.items()])
    out = own.join(totals, "part").withColumns({n: F.col(f"all_{n}") + F.col(f"own_{n}") for n in sums})
    return out.drop("part", *[f"{x}_{n}" for n in sums for x in ("all", "own")])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """mix_null, mix_source, source_size, target of each source in rows of mix_null, mix_source, size.

    The targets share all words by weight; none is above ``most`` times its source,
    and what is above goes to the others by weight. Sources saturate in the order of
    cap / weight, so the fixed point is found with running sums over that order.
    """
    s = sizes.groupBy(*KEYS).agg(F.sum("size").alias("source_size"))
    s = _before(s, [F.col(k) for k in KEYS], {"place": F.lit(1)}, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = _before(s, [F.col("cap") / F.col("w"), *[F.col(k) for k in KEYS]], {"cap_before": F.col("cap"), "w_before": F.col("w")}, "saturation")
    total, all_w = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    s = durable(s.withColumn("full", (F.lit(total) - F.col("cap_before")) * F.col("w") >= F.col("cap") * (F.lit(all_w) - F.col("w_before"))), "full")
    taken, free_w = s.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))), F.lit(0.0))).first()
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.try_divide(F.col("w") * F.lit(total - taken), F.lit(free_w))))
    return s.select(*KEYS, "source_size", target.alias("target"))


def expected_copies(sizes: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """For each source and measure the whole copies, the probability p of one more, and the source's words that are left to draw.

    Copies are ``rate * measure`` up to ``most``; the largest measures reach it first.
    """
    c = sizes.filter("size > 0").groupBy(*KEYS, measure_class(F.col("size")).alias("k")).agg(F.sum("size").alias("words")).join(targets, list(KEYS))
    c = c.withColumn("m", F.expr("shiftleft(1L, k)")).withColumn("mw", F.col("m") * F.col("words"))
    down, every = W.partitionBy(*KEYS).orderBy(F.desc("k")), W.partitionBy(*KEYS)  # some thirty rows for each source
    c = c.withColumn("above", F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("mw_from", F.sum("mw").over(down.rowsBetween(0, W.unboundedFollowing)))
    c = c.withColumn("full", (F.col("target") - F.lit(float(most)) * F.col("above")) * F.col("m") >= F.lit(float(most)) * F.col("mw_from"))
    c = c.withColumn("left", F.col("target") - F.lit(float(most)) * F.coalesce(F.sum(F.when(F.col("full"), F.col("words"))).over(every), F.lit(0)))
    c = c.withColumn("free", F.sum(F.when(~F.col("full"), F.col("mw"))).over(every))
    copies = F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.try_divide(F.col("left") * F.col("m"), F.col("free").cast("double"))))
    c = c.withColumn("copies", copies).withColumn("whole", F.floor("copies").cast("long")).withColumn("p", F.col("copies") - F.col("whole"))
    c = c.withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(every))
    return c.select(*KEYS, "k", "source_size", "target", "whole", "p", "rest")


def _rank(u: Column, p: Column) -> Column:
    """Pareto rank odds(u) / odds(p), mapped to (0, 1) in the same order."""
    q = (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))
    return F.when((p > 0) & (p < 1), q / (F.lit(1.0) + q))


def _number(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(-(2**63)))


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of mix_null, mix_source, doc_id, size, k, u; the plan of each source and measure, with the source's cut; targets)."""
    size = word_count(F.col("text"))
    rows = docs.select(*_key(F.col("source")), "doc_id", size.alias("size"), uniform(F.col("doc_id"), seed).alias("u"))
    rows = durable(rows.withColumn("k", measure_class(F.col("size"))), "sizes")
    targets = durable(source_targets(rows, weights, most), "targets")
    plan = durable(expected_copies(rows, targets, most), "copies")
    ranked = rows.filter("size > 0").join(plan.select(*KEYS, "k", "p", "rest"), [*KEYS, "k"]).withColumn("v", _rank(F.col("u"), F.col("p"))).filter(F.col("v").isNotNull())
    ranked, cross = ranked.withColumn("did", _number(F.col("doc_id"))).select(*KEYS, "v", "did", "size", "rest"), None
    for level in range(1, LEVELS + 1):  # the bin of this width in which a source crosses what is left to draw
        inside = ranked.withColumn("bin", F.floor(F.col("v") * DIGITS**level))
        if cross is None:
            inside = inside.withColumn("before", F.lit(0))
        else:
            inside = inside.withColumn("at", F.floor(F.col("v") * DIGITS ** (level - 1))).join(cross.withColumnRenamed("bin", "at"), [*KEYS, "at"])
        bins = inside.groupBy(*KEYS, "bin").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        up_to = F.col("before") + F.sum("n").over(W.partitionBy(*KEYS).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        first = bins.withColumn("up_to", up_to).filter(F.col("up_to") > F.col("rest")).groupBy(*KEYS).agg(F.min(F.struct("bin", (F.col("up_to") - F.col("n")).alias("before"))).alias("x"))
        cross = durable(first.select(*KEYS, "x.bin", "x.before"), "crossing")
    last = ranked.withColumn("bin", F.floor(F.col("v") * DIGITS**LEVELS)).join(cross, [*KEYS, "bin"]).groupBy(*KEYS, "v", "did").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    up_to = F.col("before") + F.coalesce(F.sum("n").over(W.partitionBy(*KEYS).orderBy("v", "did").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = last.withColumn("up_to", up_to).filter(F.col("up_to") + F.col("n") / F.lit(2.0) > F.col("rest")).groupBy(*KEYS).agg(F.min(F.struct("v", "did")).alias("cut"))
    end = F.struct(((F.col("bin") + 1) / F.lit(float(DIGITS**LEVELS))).alias("v"), F.lit(-(2**63)).alias("did"))
    cuts = durable(cross.join(cut, list(KEYS), "left").select(*KEYS, F.coalesce("cut", end).alias("cut")), "cuts")
    return rows, durable(plan.join(cuts, list(KEYS), "left"), "plan"), targets


def copies(u: Column, doc_id: Column) -> Column:
    """Copies of a document, beside the columns of its plan row; an empty one, without a plan, is there once."""
    here = F.struct(_rank(u, F.col("p")).alias("v"), _number(doc_id).alias("did"))
    more = here["v"].isNotNull() & (F.col("cut").isNull() | (here < F.col("cut")))
    return F.coalesce(F.col("whole") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0), F.lit(1))


def mixed_sizes(docs: DataFrame, **params) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    rows, plan, targets = mixing_plan(docs, **params)
    out = rows.join(targets, list(KEYS)).join(plan.select(*KEYS, "k", "whole", "p", "cut"), [*KEYS, "k"], "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("u"), F.col("doc_id"))).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED, **params) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    _, plan, _ = mixing_plan(docs, seed=seed, **params)
    names = docs.columns
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), *_key(docs["source"]), uniform(docs["doc_id"], seed).alias("u"), word_count(docs["text"]).alias("size"))
    keyed = keyed.withColumn("k", F.when(F.col("size") > 0, measure_class(F.col("size"))))
    out = keyed.join(plan.select(*KEYS, "k", "whole", "p", "cut"), [*KEYS, "k"], "left").withColumn("copies", copies(F.col("u"), F.col("row.doc_id")))
    return out.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col("row")[c].alias(c) for c in names])
