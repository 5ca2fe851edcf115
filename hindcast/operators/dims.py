"""Regimes, limits and periods: conditional joins with small reference tables.

Calendars, limits and rules are configuration; their tables are broadcast after a check of their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statutory limits by regime and kind of donor.
LIMITS = (("party_annual", True, 200_000_000), ("party_annual", False, 800_000_000), ("campaign", True, 2_500_000_000), ("campaign", False, 25_000_000_000))
ORGANISATIONS = ("corporation", "organization", "foreign-entity")
SMALL_ROWS = 10_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A broadcast hint for a configuration table of at most ``most`` rows; larger ones join by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def calendar(spark: SparkSession) -> DataFrame:
    """The fixture calendar: one campaign period."""
    return spark.sql(
        "SELECT 0 AS ordinal, 'ctx-1998' AS electoral_context, DATE'1998-09-01' AS start, DATE'1998-11-24' AS end, array(DATE'1998-10-15') AS reporting_deadlines"
    )


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIMITS, "regime string, is_individual boolean, limit_idr long")


def limits_from_rules(rules: DataFrame) -> DataFrame:
    """The first rule (by ordinal) with a threshold for each regime and kind of donor."""
    rows = rules.where("threshold_idr is not null and regime is not null").select(
        "ordinal", "regime", "threshold_idr", F.explode(F.when(F.size("sender_types") > 0, F.col("sender_types")).otherwise(F.array(F.lit("unknown")))).alias("t")
    )
    first = rows.groupBy("regime", (F.col("t") == "individual").alias("is_individual")).agg(F.min_by("threshold_idr", "ordinal").alias("limit_idr"))
    return first


def with_period(ledger: DataFrame, periods: DataFrame) -> DataFrame:
    """Left join with the first configured period of the row's context that covers its day (both ends included)."""
    day = F.to_date("occurred_at")
    p = small(periods.select(F.col("electoral_context").alias("_ctx"), "ordinal", F.col("start").alias("period_start"), F.col("end").alias("period_end"), "reporting_deadlines"))
    hits = ledger.select("donation_id", "electoral_context", "occurred_at").join(p, (F.col("electoral_context") == F.col("_ctx")) & day.between(F.col("period_start"), F.col("period_end")))
    first = hits.groupBy("donation_id").agg(F.min_by(F.struct("period_start", "period_end", "reporting_deadlines"), "ordinal").alias("p"))
    return ledger.join(first, "donation_id", "left").select(*ledger.columns, F.col("p.period_start"), F.col("p.period_end"), F.col("p.reporting_deadlines"))


def regime(known_context: Column) -> Column:
    """campaign inside a period; else annual for parties whose context is known; else indeterminate."""
    return F.when(F.col("period_start").isNotNull(), "campaign").when((F.col("receiver_type") == "political-party") & known_context, "party_annual").otherwise("indeterminate")


def is_individual(sender_type: Column) -> Column:
    """True, false, or null where the kind of donor settles no limit."""
    return F.when(sender_type == "individual", F.lit(True)).when(sender_type.isin(*ORGANISATIONS), F.lit(False))


def year_start(at: Column, month: int = 1) -> Column:
    """The start of the year (beginning with ``month``) that holds ``at``."""
    day = F.to_date(at)
    this = F.make_date(F.year(day), F.lit(month), F.lit(1))
    return F.when(day >= this, this).otherwise(F.add_months(this, -12))


def contexts(ledger: DataFrame, periods: DataFrame, limit_table: DataFrame, year_month: int = 1) -> DataFrame:
    """``ledger`` with period, regime, limit_idr, window_start and window_end, next_deadline (all null where unknown)."""
    known = small(periods.select(F.col("electoral_context").alias("_known")).distinct())
    rows = with_period(ledger, periods).join(known, F.col("electoral_context") == F.col("_known"), "left")
    rows = rows.withColumn("regime", regime(F.col("_known").isNotNull())).drop("_known").withColumn("is_individual", is_individual(F.col("sender_type")))
    rows = rows.join(small(limit_table), ["regime", "is_individual"], "left")
    annual = year_start(F.col("occurred_at"), year_month)
    end_of = lambda d: F.timestamp_micros(F.unix_micros(F.date_add(d, 1).cast("timestamp")) - 1)
    start = F.when(F.col("regime") == "campaign", F.col("period_start")).when(F.col("regime") == "party_annual", annual)
    end = F.when(F.col("regime") == "campaign", end_of(F.col("period_end"))).when(F.col("regime") == "party_annual", end_of(F.date_sub(F.add_months(annual, 12), 1)))
    day = F.to_date("occurred_at")
    deadline = F.array_min(F.filter("reporting_deadlines", lambda d: d >= day))
    return rows.withColumns({"window_start": start.cast("timestamp"), "window_end": end, "next_deadline": deadline}).select(
        *ledger.columns, "period_start", "period_end", "regime", "is_individual", "limit_idr", "window_start", "window_end", "next_deadline"
    )


CONTEXTS = """ctx AS (SELECT l.*, period_start, period_end, l2.limit_idr,
    CASE WHEN regime = 'campaign' THEN period_start::TIMESTAMP WHEN regime = 'party_annual' THEN date_trunc('year', occurred_at)::TIMESTAMP END AS window_start,
    CASE WHEN regime = 'campaign' THEN period_end::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND WHEN regime = 'party_annual' THEN date_trunc('year', occurred_at)::TIMESTAMP + INTERVAL 1 YEAR - INTERVAL 1 MICROSECOND END AS window_end,
    CASE WHEN period_start IS NOT NULL AND occurred_at::DATE <= DATE '1998-10-15' THEN DATE '1998-10-15' END AS next_deadline
  FROM (SELECT *, CASE WHEN electoral_context = 'ctx-1998' AND occurred_at::DATE BETWEEN DATE '1998-09-01' AND DATE '1998-11-24' THEN DATE '1998-09-01' END AS period_start,
      CASE WHEN electoral_context = 'ctx-1998' AND occurred_at::DATE BETWEEN DATE '1998-09-01' AND DATE '1998-11-24' THEN DATE '1998-11-24' END AS period_end,
      CASE WHEN period_start IS NOT NULL THEN 'campaign' WHEN receiver_type = 'political-party' AND electoral_context = 'ctx-1998' THEN 'party_annual' ELSE 'indeterminate' END AS regime,
      CASE WHEN sender_type = 'individual' THEN true WHEN sender_type IN ('corporation', 'organization', 'foreign-entity') THEN false END AS is_individual FROM ledger) l
  LEFT JOIN (VALUES ('party_annual', true, 200000000), ('party_annual', false, 800000000), ('campaign', true, 2500000000), ('campaign', false, 25000000000)) l2(regime, is_individual, limit_idr) USING (regime, is_individual))"""


def in_force(ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """Each row with the rules effective on its day."""
    day = F.to_date("occurred_at")
    return ledger.join(small(rules), (day >= F.col("effective_from")) & (F.col("effective_to").isNull() | (day <= F.col("effective_to"))))


def applies(types: Column, value: Column) -> Column:
    """An empty list means any value."""
    return (F.size(types) == 0) | F.array_contains(types, value)
