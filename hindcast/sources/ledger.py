"""Ledger of transfers: reading, validation, versions, dedup, and the fixture views over the star tables.

A ledger has donation_id, sender_id, receiver_id (null: unresolved), sender_type, receiver_type,
amount_idr, occurred_at, recorded_at, precision, electoral_context, is_self_funded_declared, channel,
transaction_kind. ``recorded_at >= occurred_at`` holds for valid rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.functions.text import fold

#: Fixed values.
ENTITY_TYPES = ("individual", "corporation", "organization", "foreign-entity", "political-party", "candidate", "campaign-team", "government", "unknown")
TRANSACTION_KINDS = ("cash", "transfer", "in_kind", "unknown")
CHANNELS = ("digital-form", "paper-form", "web-scrape", "import")
PRECISIONS = ("day", "hour", "minute", "second")


def read_ledger(spark: SparkSession, path: str, schema=None, form: str = "parquet") -> DataFrame:
    """A ledger from Parquet or JSON; columns that are not used are never read."""
    reader = spark.read.format(form)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_by_day(df: DataFrame, path: str, at: str = "occurred_at") -> None:
    """Append rows as Parquet, one folder per day."""
    df.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def validate(records: DataFrame) -> DataFrame:
    """``records`` with ``errors``: the names of the checks each row fails (empty: valid)."""
    c = F.col
    bad = {
        "amount_not_positive": ~F.coalesce(c("amount_idr") > 0, F.lit(False)),
        "time_missing": c("occurred_at").isNull() | c("recorded_at").isNull(),
        "recorded_before_occurred": c("recorded_at") < c("occurred_at"),
        "sender_without_id_or_text": c("sender_id").isNull() & c("sender_text").isNull(),
        "receiver_without_id_or_text": c("receiver_id").isNull() & c("receiver_text").isNull(),
        "confidence_out_of_range": ~c("confidence").between(0.0, 1.0),
        "version_below_one": ~F.coalesce(c("donation_version") >= 1, F.lit(False)),
        "correction_without_actor": (c("donation_version") > 1) & c("corrected_by").isNull(),
        "unknown_channel": ~c("channel").isin(*CHANNELS),
    }
    return records.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(k, F.lit(False)), F.lit(n)) for n, k in bad.items()])))


def party_key(entity: Column, text: Column) -> Column:
    return F.coalesce(entity.cast("string"), F.concat(F.lit("raw:"), text))


def truncated(at: Column, precision: Column) -> Column:
    """A timestamp at the precision it was stated with."""
    out = at
    for p in ("minute", "hour", "day"):
        out = F.when(precision == p, F.date_trunc(p, at)).otherwise(out)
    return F.when(precision == "second", F.date_trunc("second", at)).otherwise(out)


def dedup_key(records: DataFrame) -> DataFrame:
    """``records`` with the columns that identify one real transfer."""
    return records.withColumns(
        {
            "key_sender": party_key(F.col("sender_id"), F.col("sender_text")),
            "key_receiver": party_key(F.col("receiver_id"), F.col("receiver_text")),
            "key_at": truncated(F.col("occurred_at"), F.col("precision")),
        }
    )


KEY = ("key_sender", "key_receiver", "amount_idr", "key_at", "electoral_context")


def first_of_each(records: DataFrame) -> DataFrame:
    """The first recorded row of each dedup key; minima are combined before the shuffle."""
    keyed = dedup_key(records)
    first = keyed.groupBy(*KEY).agg(F.min(F.struct("recorded_at", "donation_id")).alias("first"))
    same = None
    for k in KEY:
        eq = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        same = eq if same is None else same & eq
    return keyed.alias("l").join(first.alias("r"), same & (F.struct("l.recorded_at", "l.donation_id") == F.col("r.first"))).select("l.*")


def latest_version(records: DataFrame) -> DataFrame:
    w = Window.partitionBy("donation_id").orderBy(F.col("donation_version").desc(), F.col("recorded_at").desc())
    return records.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def with_entities(ledger: DataFrame, entities: DataFrame, key: str = "sender_id") -> DataFrame:
    """Left lookup of jurisdiction and validated identifiers by entity id, never by name."""
    side = entities.select(
        F.col("entity_id").alias(key), "jurisdiction", F.exists("identifiers", lambda i: i["validated"]).alias("has_validated_identifier")
    )
    return ledger.join(side, key, "left")


# ---- fixture views over the star tables, written alike for DuckDB --------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transfer per order: the customer gives to the order's least supplier."""
    recv = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("recv"))
    key, cust, r = F.col("o_orderkey"), F.col("o_custkey"), F.col("recv")
    day = F.col("o_orderdate").cast("timestamp")
    lag = F.when(key % 20 < 12, F.lit(0)).when(key % 20 < 17, 1 + key % 14).otherwise(7 + key % 84)
    return (
        _table(spark, sf_dir, "orders")
        .join(recv, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            key.alias("donation_id"),
            cust.alias("sender_id"),
            r.alias("receiver_id"),
            F.when(cust % 5 == 0, "corporation").when(cust % 97 == 0, "unknown").otherwise("individual").alias("sender_type"),
            F.when(r.isNull(), "unknown").when(r % 3 == 0, "individual").otherwise("political-party").alias("receiver_type"),
            (F.round(F.col("o_totalprice") * 100).cast("long") * 5).alias("amount_idr"),
            day.alias("occurred_at"),
            F.timestamp_add("DAY", lag.cast("int"), day).alias("recorded_at"),
            F.lit("day").alias("precision"),
            F.when(key % 50 != 0, F.lit("ctx-1998")).alias("electoral_context"),
            F.when(key % 7 == 0, F.lit(True)).when(key % 7 != 1, F.lit(False)).alias("is_self_funded_declared"),
            F.when(key % 20 < 12, "digital-form").when(key % 20 < 17, "paper-form").otherwise("web-scrape").alias("channel"),
            F.element_at(F.array(*map(F.lit, TRANSACTION_KINDS)), (key % 4 + 1).cast("int")).alias("transaction_kind"),
        )
    )


LEDGER = """ledger AS (SELECT o_orderkey AS donation_id, o_custkey AS sender_id, recv AS receiver_id,
  CASE WHEN o_custkey % 5 = 0 THEN 'corporation' WHEN o_custkey % 97 = 0 THEN 'unknown' ELSE 'individual' END AS sender_type,
  CASE WHEN recv IS NULL THEN 'unknown' WHEN recv % 3 = 0 THEN 'individual' ELSE 'political-party' END AS receiver_type,
  cast(round(o_totalprice * 100) AS BIGINT) * 5 AS amount_idr, o_orderdate AS occurred_at,
  o_orderdate + to_days(cast(CASE WHEN o_orderkey % 20 < 12 THEN 0 WHEN o_orderkey % 20 < 17 THEN 1 + o_orderkey % 14 ELSE 7 + o_orderkey % 84 END AS INTEGER)) AS recorded_at,
  'day' AS precision, CASE WHEN o_orderkey % 50 <> 0 THEN 'ctx-1998' END AS electoral_context,
  CASE WHEN o_orderkey % 7 = 0 THEN true WHEN o_orderkey % 7 <> 1 THEN false END AS is_self_funded_declared,
  CASE WHEN o_orderkey % 20 < 12 THEN 'digital-form' WHEN o_orderkey % 20 < 17 THEN 'paper-form' ELSE 'web-scrape' END AS channel,
  (['cash', 'transfer', 'in_kind', 'unknown'])[o_orderkey % 4 + 1] AS transaction_kind
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS recv FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def graph_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One id space, so money can pass through: the events, without gifts to oneself."""
    to = (F.col("user_id") * 7 + F.col("event_id")) % 150
    return (
        _table(spark, sf_dir, "events")
        .where(to != F.col("user_id"))
        .select(
            F.col("event_id").alias("donation_id"),
            F.concat(F.lit("n"), F.col("user_id")).alias("sender_id"),
            F.concat(F.lit("n"), to).alias("receiver_id"),
            F.round(F.col("value") * 100).cast("long").alias("amount_idr"),
            F.col("ts").cast("timestamp").alias("occurred_at"),
            F.col("ts").cast("timestamp").alias("recorded_at"),
        )
    )


GRAPH = """graph_ledger AS (SELECT event_id AS donation_id, 'n' || user_id AS sender_id, 'n' || ((user_id * 7 + event_id) % 150) AS receiver_id,
  cast(round(value * 100) AS BIGINT) AS amount_idr, ts AS occurred_at, ts AS recorded_at
  FROM events WHERE (user_id * 7 + event_id) % 150 <> user_id)"""


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as it might arrive: with versions, free-text parties, and faults to find."""
    led = ledger(spark, sf_dir)
    k = F.col("donation_id")
    rows = led.withColumns(
        {
            "sender_text": F.when(k % 3 == 0, F.concat(F.lit(" Donor  "), F.col("sender_id"))),
            "receiver_text": F.lit(None).cast("string"),
            "confidence": F.when(k % 41 == 0, F.lit(1.5)).when(k % 2 == 0, F.lit(0.75)),
            "donation_version": F.when(k % 43 == 0, F.lit(0)).otherwise(F.lit(1)),
            "corrected_by": F.lit(None).cast("string"),
            "amount_idr": F.when(k % 37 == 0, F.lit(0)).otherwise(F.col("amount_idr")).cast("long"),
            "recorded_at": F.when(k % 47 == 0, F.timestamp_add("DAY", F.lit(-1), F.col("occurred_at"))).otherwise(F.col("recorded_at")),
        }
    )
    again = rows.where(k % 9 == 0).withColumns({"donation_version": F.lit(2), "corrected_by": F.when(k % 2 == 0, F.lit("clerk")), "recorded_at": F.timestamp_add("DAY", F.lit(3), F.col("recorded_at"))})
    return rows.unionByName(again)


RAW = f"""{LEDGER}, raw0 AS (SELECT * REPLACE (CASE WHEN donation_id % 37 = 0 THEN 0 ELSE amount_idr END AS amount_idr,
    CASE WHEN donation_id % 47 = 0 THEN occurred_at - to_days(1) ELSE recorded_at END AS recorded_at),
  CASE WHEN donation_id % 3 = 0 THEN ' Donor  ' || sender_id END AS sender_text, NULL::VARCHAR AS receiver_text,
  CASE WHEN donation_id % 41 = 0 THEN 1.5 WHEN donation_id % 2 = 0 THEN 0.75 END AS confidence,
  CASE WHEN donation_id % 43 = 0 THEN 0 ELSE 1 END AS donation_version, NULL::VARCHAR AS corrected_by FROM ledger),
raw AS (SELECT * FROM raw0 UNION ALL BY NAME SELECT * REPLACE (2 AS donation_version, CASE WHEN donation_id % 2 = 0 THEN 'clerk' END AS corrected_by,
  recorded_at + to_days(3) AS recorded_at) FROM raw0 WHERE donation_id % 9 = 0)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an entity dimension."""
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        k.alias("entity_id"),
        F.col("c_name").alias("canonical_name"),
        F.array(F.concat(F.lit(" the "), F.upper("c_name"))).alias("aliases"),
        F.when(F.col("c_nationkey") % 11 != 0, F.when(F.col("c_nationkey") % 4 == 0, F.lit("SG")).otherwise(F.lit("ID"))).alias("jurisdiction"),
        F.array(F.struct(F.concat(F.lit("id"), k).alias("value"), (k % 3 == 0).alias("validated"))).alias("identifiers"),
        fold(F.col("c_name")).alias("folded"),
    )


ENTITIES = """entities AS (SELECT c_custkey AS entity_id, c_name AS canonical_name, CASE WHEN c_nationkey % 11 <> 0 THEN CASE WHEN c_nationkey % 4 = 0 THEN 'SG' ELSE 'ID' END END AS jurisdiction,
  c_custkey % 3 = 0 AS has_validated_identifier, lower(c_name) AS folded FROM customer)"""
