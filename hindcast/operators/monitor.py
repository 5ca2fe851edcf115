"""Drift, coverage of rules, health of lanes, label mix, and redundant columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.quantiles import at_places
from hindcast.functions.stats import share

from .dims import small

LEAST = 10


def edges(baseline: DataFrame, bins: int = 10) -> DataFrame:
    """Per feature: the value at place min(int(n * i / bins), n - 1) of its sorted baseline, i = 1..bins-1; null if under LEAST rows.

    ``baseline``: feature, value. The places are found by narrowing ranges, so no task holds a feature's values.
    """
    places = {f"{i:04d}": (lambda n, i=i: F.least(F.floor(n * i / bins), n - 1) + 1) for i in range(1, bins)}
    found = at_places(baseline, places).groupBy("feature", "n").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("e"))
    return found.select("feature", "n", F.when(F.col("n") >= LEAST, F.col("e.value")).alias("edges"))


def psi(baseline: DataFrame, current: DataFrame, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Per feature: population stability index of ``current`` against ``baseline`` (feature, value); 0 where one has under LEAST rows."""
    cut = edges(baseline, bins)

    def shares(rows: DataFrame, name: str) -> DataFrame:
        placed = rows.where("value is not null").join(small(cut), "feature").select("feature", F.size(F.filter("edges", lambda e: F.col("value") > e)).alias("bin"))
        n = placed.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("c"))
        total = n.groupBy("feature").agg(F.sum("c").alias("t"))
        return n.join(total, "feature").select("feature", "bin", (F.col("c") / F.col("t")).alias(name), F.col("t").alias(f"{name}_n"))

    grid = cut.where("edges is not null").select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    both = grid.join(shares(baseline, "b"), ["feature", "bin"], "left").join(shares(current, "c"), ["feature", "bin"], "left")
    b, c = F.greatest(F.coalesce("b", F.lit(0.0)), F.lit(floor)), F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(floor))
    out = both.groupBy("feature").agg(F.sum((c - b) * F.log(c / b)).alias("raw"), F.max("c_n").alias("n"))
    out = out.select("feature", F.when(F.coalesce("n", F.lit(0)) >= LEAST, F.col("raw")).otherwise(F.lit(0.0)).alias("psi"))
    names = baseline.select("feature").distinct()
    return names.join(out, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def long(df: DataFrame, columns: list[str]) -> DataFrame:
    """Wide numeric columns as (feature, value)."""
    return df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")


def feature_drift(baseline: DataFrame, current: DataFrame, jump: float = 0.10, drift: float = 0.25) -> DataFrame:
    """Per feature: PSI, null rates, and a finding: pipeline fault where nulls jump, else drift where PSI is over the line."""
    nulls = lambda d, n: d.groupBy("feature").agg(F.avg(F.col("value").isNull().cast("double")).alias(n))
    out = psi(baseline, current).join(nulls(baseline, "null_before"), "feature", "left").join(nulls(current, "null_now"), "feature", "left")
    return out.withColumn("finding", F.when(F.abs(F.col("null_now") - F.col("null_before")) > jump, "pipeline fault").when(F.col("psi") > drift, "drift"))


def rule_coverage(verdicts: DataFrame) -> DataFrame:
    """Per rule: evaluated against indeterminate; rows it does not apply to are left out."""
    n = lambda *o: F.count(F.when(F.col("outcome").isin(*o), 1))
    out = verdicts.groupBy("rule_id").agg(n("PASS", "LEGAL_FINDING", "BEHAVIOURAL_SIGNAL").alias("evaluated"), n("INDETERMINATE").alias("indeterminate"))
    return out.withColumn("indeterminate_rate", share(F.col("indeterminate"), F.col("evaluated") + F.col("indeterminate")))


def findings(score_psi: DataFrame, coverage: DataFrame, drift: float = 0.25, blind: float = 0.5) -> DataFrame:
    a = score_psi.where(F.col("psi") > drift).select(F.lit("score drift").alias("kind"), F.col("feature").alias("subject"))
    return a.unionByName(coverage.where(F.col("indeterminate_rate") > blind).select(F.lit("rule cannot be evaluated").alias("kind"), F.col("rule_id").alias("subject")))


def lane_health(lane_results: DataFrame) -> DataFrame:
    """Per lane: rows it ran on and was absent from, and what it adds on average."""
    return lane_results.groupBy("lane").agg(F.count("intensity").alias("ran"), F.count(F.when(F.col("intensity").isNull(), 1)).alias("absent"), F.avg("contribution").alias("mean_contribution"))


def score_health(scores: DataFrame, budget: int) -> DataFrame:
    """One row: rows per band, the degraded share, and the flagged rows against the budget."""
    n = lambda b: F.count(F.when(F.col("band") == b, 1)).alias(b)
    return scores.agg(n("low"), n("moderate"), n("high"), n("critical"), F.avg(F.col("degraded").cast("double")).alias("degraded_share"), (F.count(F.when(F.col("score") >= 50, 1)) / F.lit(budget)).alias("budget_use"))


def label_mix(labels: DataFrame) -> DataFrame:
    """Per source: labels, and those whose notes say they come from an audit sample."""
    return labels.groupBy("source").agg(F.count(F.lit(1)).alias("labels"), F.count(F.when(F.coalesce(F.col("note").startswith("audit-sample"), F.lit(False)), 1)).alias("audited"))


def latest_labels(labels: DataFrame) -> DataFrame:
    """The latest label of each transfer; ties by label_id."""
    w = Window.partitionBy("donation_id").orderBy(F.col("created_at").desc(), F.col("label_id").desc())
    return labels.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Names of columns with one value; null counts as a value."""
    one = lambda c: ((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))) <= 1)
    row = df.agg(*[one(c).alias(c) for c in columns])
    return row.unpivot([], columns, "column", "constant").where("constant").select("column")


def identical_columns(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(a, b): columns equal in every row. Sums of row hashes group the candidates; each is then compared in full."""
    sums = df.agg(*[F.sum(F.xxhash64(F.col(id_col), F.col(c)).cast("decimal(20,0)")).alias(c) for c in columns]).first()
    same = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :] if sums[a] == sums[b] and df.schema[a].dataType == df.schema[b].dataType]
    spark = df.sparkSession
    if not same:
        return spark.createDataFrame([], "a string, b string")
    checks = df.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"c{i}") for i, (a, b) in enumerate(same)]).first()
    return spark.createDataFrame([p for i, p in enumerate(same) if checks[f"c{i}"]], "a string, b string")


def affine_copies(df: DataFrame, columns: list[str], least: int = 20, eps: float = 1e-9) -> DataFrame:
    """(a, b, slope, intercept): numeric columns with b = slope * a + intercept in every row, nulls aligned, ``least`` pairs or more."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    spark, schema = df.sparkSession, "a string, b string, slope double, intercept double"
    d = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    row = d.agg(*[x for i, (a, b) in enumerate(pairs) for x in (F.min(a).alias(f"x0_{i}"), F.max(a).alias(f"x1_{i}"), F.min_by(b, a).alias(f"y0_{i}"), F.max_by(b, a).alias(f"y1_{i}"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n_{i}"), F.bool_and(F.col(a).isNull() == F.col(b).isNull()).alias(f"al_{i}"))]).first()
    lines = []
    for i, (a, b) in enumerate(pairs):
        x0, x1, y0, y1 = (row[f"{k}_{i}"] for k in ("x0", "x1", "y0", "y1"))
        if row[f"al_{i}"] and row[f"n_{i}"] >= least and None not in (x0, x1, y0, y1) and x1 != x0 and y1 != y0:
            slope = (y1 - y0) / (x1 - x0)
            lines.append((a, b, slope, y0 - slope * x0))
    if not lines:
        return spark.createDataFrame([], schema)
    worst = d.agg(*[F.max(F.abs(F.col(b) - (F.col(a) * s + k)) / F.greatest(F.abs(F.col(b)), F.lit(1.0))).alias(f"w{i}") for i, (a, b, s, k) in enumerate(lines)]).first()
    return spark.createDataFrame([x for i, x in enumerate(lines) if worst[f"w{i}"] <= eps], schema)
