"""Evaluation of scores under a review budget, audit samples, and what they say about recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.quantiles import at_places, ranked
from hindcast.functions.stats import share, wilson


def at_budget(scored: DataFrame, budget: int) -> DataFrame:
    """One row: precision, recall and lift of the ``budget`` highest scores.

    Lift compares unflagged confirmed rows in the queue with confirmed rows among the first ``budget``
    rule-flagged rows in input order (occurred_at, donation_id).
    """
    n = lambda c: F.count(F.when(c, 1))
    top = scored.orderBy(F.col("score").desc(), "occurred_at", "donation_id").limit(budget).agg(F.count(F.lit(1)).alias("reviewed"), n(F.col("confirmed")).alias("hits"), n(F.col("confirmed") & ~F.col("rule_flagged")).alias("novel"))
    base = scored.where("rule_flagged").orderBy("occurred_at", "donation_id").limit(budget).agg(n(F.col("confirmed")).alias("base"))
    total = scored.agg(n(F.col("confirmed")).alias("positives"))
    out = top.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(total))
    return out.withColumns({"precision": share(F.col("hits"), F.col("reviewed")), "recall": share(F.col("hits"), F.col("positives")), "lift": F.when(F.col("base") > 0, F.col("novel") / F.col("base")).otherwise(F.col("novel").cast("double"))})


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: the mean precision at each confirmed row, ranked by score and then input order."""
    hits = ranked(ranked(scored.select("donation_id", "score", "occurred_at", "confirmed"), F.col("score").desc(), F.col("occurred_at"), F.col("donation_id")).where("confirmed"), F.col("rank"), name="hit")
    return hits.agg(F.count(F.lit(1)).alias("positives"), F.coalesce(F.avg(F.col("hit") / F.col("rank")), F.lit(0.0)).alias("average_precision"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Per score bin: rows, mean score and confirmed rate; the error is the row-weighted mean distance of the two."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("long")
    return scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.avg("score").alias("mean_score"), F.avg(F.col("confirmed").cast("double")).alias("rate"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """One row: the row-weighted mean distance of mean score and confirmed rate; null without rows."""
    return bins.agg((F.sum(F.col("rows") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("rows")).alias("error"))


def threshold_choice(scored: DataFrame, clean_recall: float = 0.70) -> DataFrame:
    """One row: the threshold with most recall on risky rows among those that keep enough clean rows below it.

    Distinct scores are cut into ranges of 1/1024: totals of the ranges run over few rows, and scores run inside their
    range, so no task holds them all. 0.5 without both classes, 1.0 if none qualifies.
    """
    by = scored.groupBy("score").agg(F.count(F.when(F.col("confirmed"), 1)).alias("pos"), F.count(F.when(~F.col("confirmed"), 1)).alias("neg")).withColumn("range", F.floor(F.col("score") * 1024))
    ranges = by.groupBy("range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    above = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = ranges.select("range", zero(F.sum("pos").over(above)).alias("above"), zero(F.sum("neg").over(below)).alias("below"))
    up = Window.partitionBy("range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    totals = by.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    steps = by.join(offsets, "range").select("score", (F.col("above") + F.sum("pos").over(up)).alias("tp"), (F.col("below") + zero(F.sum("neg").over(down))).alias("tn")).crossJoin(F.broadcast(totals))
    best = steps.where((F.col("P") > 0) & (F.col("N") > 0) & (F.col("tn") >= F.lit(clean_recall) * F.col("N"))).orderBy(F.col("tp").desc(), "score").limit(1).select("score")
    return totals.crossJoin(best.agg(F.max("score").alias("best"))).select(F.when((F.coalesce("P", F.lit(0)) == 0) | (F.coalesce("N", F.lit(0)) == 0), F.lit(0.5)).otherwise(F.coalesce("best", F.lit(1.0))).alias("threshold"))


def nearest_rank(rows: DataFrame, column: str, fractions: tuple[float, ...]) -> DataFrame:
    """One row: nearest-rank percentiles, by narrowing ranges."""
    values = rows.select(F.lit("all").alias("feature"), F.col(column).alias("value"))
    names = {f"p{round(f * 100)}": (lambda n, f=f: F.greatest(F.ceil(F.lit(f) * n), F.lit(1))) for f in fractions}
    return at_places(values, names).agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in names])


def cohort_split(ledger: DataFrame, shares: tuple[float, float] = (0.60, 0.15)) -> DataFrame:
    """(donation_id, split): donors in order of first seen go whole to train, calibration or test; unresolved donors train."""
    donors = ledger.where("sender_id is not null").groupBy("sender_id").agg(F.min("occurred_at").alias("first"))
    total = donors.count()
    a, b = int(total * shares[0]), int(total * (shares[0] + shares[1]))
    split = F.when(F.col("rank") <= a, "train").when(F.col("rank") <= b, "calibration").otherwise("test")
    placed = ranked(donors, F.col("first"), F.col("sender_id")).select("sender_id", split.alias("split"))
    return ledger.join(placed, "sender_id", "left").select("donation_id", "sender_id", "occurred_at", F.coalesce("split", F.lit("train")).alias("split"))


def leaks(split: DataFrame) -> DataFrame:
    """Donors in more than one split: must be empty."""
    return split.where("sender_id is not null").groupBy("sender_id").agg(F.count_distinct("split").alias("n")).where("n > 1")


def split_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sender_id").alias("donors"), F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last"))


def audit_sample(unflagged: DataFrame, period: str, least: int = 50, rate: float = 0.02) -> DataFrame:
    """A repeatable sample of unflagged rows: the first n by a hash of period and id; a period gives one sample."""
    n = unflagged.count()
    take = min(n, max(least, round(rate * n)))
    key = F.sha2(F.concat_ws("|", F.lit(period), F.col("donation_id").cast("string")), 256)
    return unflagged.withColumn("_k", key).orderBy("_k").limit(take).drop("_k")


def estimated_recall(population: DataFrame, sample: DataFrame, least: int = 50) -> DataFrame:
    """One row: recall of flagging, with the missed share projected from the audit sample; null with a reason if it is too small."""
    n = lambda c: F.count(F.when(c, 1))
    flagged = population.agg(n(F.col("rule_flagged") & F.col("confirmed")).alias("found"), n(~F.col("rule_flagged")).alias("unflagged"))
    audit = sample.agg(F.count(F.lit(1)).alias("audited"), n(F.col("confirmed")).alias("missed"))
    low, high = wilson(F.col("missed"), F.col("audited"))
    at = lambda rate: share(F.col("found"), F.col("found") + rate * F.col("unflagged"))
    enough = F.col("audited") >= least
    return flagged.crossJoin(F.broadcast(audit)).select(
        "found", "unflagged", "audited", "missed", F.when(enough, at(share(F.col("missed"), F.col("audited")))).alias("recall"), F.when(enough, at(high)).alias("low"), F.when(enough, at(low)).alias("high"), F.when(~enough, "too few audited").alias("reason")
    )


def review_bias(rows: DataFrame) -> DataFrame:
    """One row: how often flagged and unflagged rows are reviewed, and the ratio."""
    rate = lambda c: share(F.count(F.when(c & F.col("reviewed"), 1)), F.count(F.when(c, 1)))
    return rows.agg(rate(F.col("rule_flagged")).alias("flagged_rate"), rate(~F.col("rule_flagged")).alias("unflagged_rate")).withColumn("ratio", F.try_divide("flagged_rate", "unflagged_rate"))


def propensity_weights(rows: DataFrame) -> DataFrame:
    """Inverse review probabilities; rows with probability 0 get null and are for ``where weight is null``."""
    return rows.withColumn("weight", F.when(F.col("probability") > 0, 1 / F.col("probability")))
