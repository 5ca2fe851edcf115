"""Fixture reference tables derived from the star tables: registers, filings, coverage, scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import _table, ledger


def register_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").where(k % 41 == 0).select(
        F.lit("prohibited_source").alias("register"),
        F.when(k % 2 == 0, k).alias("entity_id"),
        F.col("c_name").alias("canonical_name"),
        F.array(F.concat(F.lit("The  "), F.col("c_name"))).alias("aliases"),
        F.lit("1996-01-01").cast("date").alias("effective_from"),
        F.when(k % 3 == 0, F.lit("1998-01-01").cast("date")).alias("effective_to"),
    )


def registers(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """SELECT * FROM VALUES ('prohibited_source', true, true, TIMESTAMP'1997-06-01 00:00:00', 700),
        ('final_convictions', false, true, CAST(NULL AS TIMESTAMP), CAST(NULL AS INT)), ('watch', true, false, CAST(NULL AS TIMESTAMP), 30)
        AS t(name, available, authoritative, refreshed_at, max_age_days)"""
    )


ENTRIES = """entries AS (SELECT 'prohibited_source' AS register, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS entity_id, lower(c_name) AS folded, DATE '1996-01-01' AS effective_from,
  CASE WHEN c_custkey % 3 = 0 THEN DATE '1998-01-01' END AS effective_to FROM customer WHERE c_custkey % 41 = 0)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("donation_id")
    return ledger(spark, sf_dir).where(k % 25 != 0).select(
        "electoral_context",
        F.when(k % 40 != 0, F.col("sender_id")).alias("donor_ref"),
        F.when(k % 30 != 0, F.col("receiver_id")).alias("recipient_ref"),
        F.when(k % 60 != 1, F.col("amount_idr") + F.floor(F.col("amount_idr") * ((k % 3) - 1) / 200)).cast("long").alias("amount_idr"),
        F.when(k % 70 != 2, F.date_add(F.to_date("occurred_at"), (k % 3 - 1).cast("int"))).alias("occurred_on"),
    )


FILINGS = """filings AS (SELECT electoral_context, CASE WHEN donation_id % 40 <> 0 THEN sender_id END AS donor_ref, CASE WHEN donation_id % 30 <> 0 THEN receiver_id END AS recipient_ref,
  CASE WHEN donation_id % 60 <> 1 THEN amount_idr + floor(amount_idr * ((donation_id % 3) - 1) / 200)::BIGINT END AS amount_idr,
  CASE WHEN donation_id % 70 <> 2 THEN occurred_at::DATE + (donation_id % 3 - 1)::INTEGER END AS occurred_on FROM ledger WHERE donation_id % 25 <> 0)"""


def filing_periods(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 'ctx-1998' AS electoral_context, DATE'1997-01-01' AS start, DATE'1998-12-31' AS end")
