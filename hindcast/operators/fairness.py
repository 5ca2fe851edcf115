"""Group performance, disparity and association, in three-valued logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.stats import share, wilson

FLOOR = 30


def size_band(amount: Column) -> Column:
    return F.when(amount < 0, F.raise_error(F.lit("negative amount"))).when(amount < 10_000_000, "small").when(amount < 200_000_000, "medium").when(amount < 2_500_000_000, "large").otherwise("very-large")


def groups(cohorts: DataFrame, attributes: tuple[str, ...], floor: int = FLOOR) -> DataFrame:
    """One pass over all attributes (grouping sets): totals, precision, detection, false-flag rate with its interval.

    The rate is over reviewed clean rows and null where there are fewer than ``floor``.
    """
    rows = cohorts.select(*[F.coalesce(F.col(a).cast("string"), F.lit("unknown")).alias(a) for a in attributes], "flagged", "reviewed", "confirmed")
    n = lambda c: F.count(F.when(c, 1))
    flagged, reviewed, risky = F.col("flagged"), F.col("reviewed"), F.col("confirmed")
    sets = rows.groupingSets([[F.col(a)] for a in attributes], *attributes).agg(
        F.grouping_id(*attributes).alias("_g"), F.count(F.lit(1)).alias("total"), n(flagged).alias("n_flagged"), n(reviewed & risky).alias("risky"), n(reviewed & risky & flagged).alias("caught"),
        n(reviewed & ~risky).alias("clean"), n(reviewed & ~risky & flagged).alias("false_flags"), n(reviewed & flagged).alias("judged"),
    )
    bits = len(attributes)
    name = value = None
    for i, a in enumerate(attributes):
        own = F.col("_g") == (2**bits - 1) - 2 ** (bits - 1 - i)
        name = F.when(own, F.lit(a)) if name is None else name.when(own, F.lit(a))
        value = F.when(own, F.col(a)) if value is None else value.when(own, F.col(a))
    low, high = wilson(F.col("false_flags"), F.col("clean"))
    enough = F.col("clean") >= floor
    return sets.select(
        name.alias("attribute"), value.alias("value"), "total", "n_flagged", "clean", "false_flags", share(F.col("caught"), F.col("judged")).alias("precision"), share(F.col("caught"), F.col("risky")).alias("detection"),
        F.when(enough, share(F.col("false_flags"), F.col("clean"))).alias("rate"), F.when(enough, low).alias("low"), F.when(enough, high).alias("high"), share(F.col("n_flagged"), F.col("total")).alias("selection"),
    )


def disparity(table: DataFrame, tolerance: float = 1.25) -> DataFrame:
    """Per attribute: the highest rate over the lowest, who has them, whether their intervals part, and a verdict that may be null."""
    known = table.where("value <> 'unknown'")
    out = known.groupBy("attribute").agg(
        F.max_by(F.struct("value", "rate", "low"), "rate").alias("hi"), F.min_by(F.struct("value", "rate", "high"), "rate").alias("lo"), F.count("rate").alias("measured"),
    )
    ratio = F.try_divide(F.col("hi.rate"), F.col("lo.rate"))
    return out.select("attribute", F.col("hi.value").alias("highest"), F.col("lo.value").alias("lowest"), F.when(F.col("measured") >= 2, ratio).alias("ratio"), F.when(F.col("measured") >= 2, F.col("hi.low") > F.col("lo.high")).alias("separated"), F.when(F.col("measured") >= 2, ratio <= tolerance).alias("within"))


def cramers_v(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the association of two categorical columns; null where either has one value only. Blank counts as unknown."""
    x, y = F.coalesce(F.nullif(F.trim(F.col(a).cast("string")), F.lit("")), F.lit("unknown")), F.col(b).cast("string")
    cells = rows.groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rx = cells.groupBy("x").agg(F.sum("n").alias("nx"))
    ry = cells.groupBy("y").agg(F.sum("n").alias("ny"))
    total = cells.agg(F.sum("n").alias("all"))
    # chi squared over all pairs of categories is all * (sum of n * n / (nx * ny) - 1), in which empty cells add nothing
    full = cells.join(rx, "x").join(ry, "y").agg(F.sum(F.col("n").cast("double") * F.col("n") / (F.col("nx").cast("double") * F.col("ny"))).alias("s"), F.least(F.count_distinct("x"), F.count_distinct("y")).alias("k"))
    out = full.crossJoin(total).select((F.col("all") * F.greatest(F.col("s") - 1, F.lit(0.0))).alias("chi2"), "all", "k")  # one row each
    return out.select(F.when(F.col("k") >= 2, F.sqrt(F.col("chi2") / (F.col("all") * (F.col("k") - 1)))).alias("v"))


def overall(*verdicts: Column) -> Column:
    """False if any is false, else null if any is null, else true."""
    out = F.lit(True)
    for v in verdicts:
        out = out & v
    return out
