"""Queries over sources, point-in-time history, dimensions and reference data."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import dims, pit, refdata
from hindcast.sources import ledger as src
from hindcast.sources import reference as ref
from hindcast.sources import scratch
from hindcast.sources.ledger import ENTITIES, LEDGER, RAW, ledger

from .registry import query

RAW_CHECKS = {
    "amount_not_positive": "NOT coalesce(amount_idr > 0, false)",
    "time_missing": "occurred_at IS NULL OR recorded_at IS NULL",
    "recorded_before_occurred": "recorded_at < occurred_at",
    "sender_without_id_or_text": "sender_id IS NULL AND sender_text IS NULL",
    "receiver_without_id_or_text": "receiver_id IS NULL AND receiver_text IS NULL",
    "confidence_out_of_range": "confidence NOT BETWEEN 0.0 AND 1.0",
    "version_below_one": "NOT coalesce(donation_version >= 1, false)",
    "correction_without_actor": "donation_version > 1 AND corrected_by IS NULL",
}


@query(f"""WITH {RAW} SELECT donation_id, donation_version, concat_ws(',', {', '.join(f"CASE WHEN {v} THEN '{k}' END" for k, v in RAW_CHECKS.items())}) AS errors FROM raw""")
def validate_ledger(spark, sf_dir):
    return src.validate(src.raw_records(spark, sf_dir)).select("donation_id", "donation_version", F.array_join("errors", ",").alias("errors"))


_DEDUP = """coalesce(sender_id::VARCHAR, 'raw:' || sender_text), coalesce(receiver_id::VARCHAR, 'raw:' || receiver_text), amount_idr, date_trunc('day', occurred_at), electoral_context"""


@query(f"WITH {RAW} SELECT donation_id, donation_version FROM (SELECT *, row_number() OVER (PARTITION BY {_DEDUP} ORDER BY recorded_at, donation_id) AS r FROM raw) WHERE r = 1")
def dedup_ledger(spark, sf_dir):
    return src.first_of_each(src.raw_records(spark, sf_dir)).select("donation_id", "donation_version")


@query(f"WITH {RAW} SELECT donation_id, max(donation_version) AS donation_version FROM raw GROUP BY 1")
def latest_version(spark, sf_dir):
    return src.latest_version(src.raw_records(spark, sf_dir)).select("donation_id", "donation_version")


@query(f"WITH {LEDGER}, {ENTITIES} SELECT donation_id, jurisdiction, has_validated_identifier FROM ledger LEFT JOIN entities ON entity_id = sender_id")
def entity_lookup(spark, sf_dir):
    return src.with_entities(ledger(spark, sf_dir), src.entities(spark, sf_dir)).select("donation_id", "jurisdiction", "has_validated_identifier")


@query(f"WITH {LEDGER} SELECT donation_id FROM ledger WHERE occurred_at <= TIMESTAMP '1998-06-30' AND recorded_at <= TIMESTAMP '1998-06-30'")
def pit_snapshot(spark, sf_dir):
    return pit.snapshot(ledger(spark, sf_dir), F.lit("1998-06-30").cast("timestamp")).select("donation_id")


@query(f"WITH {LEDGER} SELECT max(recorded_at)::DATE AS as_of, count(*) AS donations FROM ledger")
def pit_population_now(spark, sf_dir):
    return ledger(spark, sf_dir).agg(F.to_date(F.max("recorded_at")).alias("as_of"), F.count(F.lit(1)).alias("donations"))


def _totals_sql(on: str, null: str) -> str:
    return f"""WITH {LEDGER} SELECT p.donation_id, count(h.donation_id) AS prior_count, coalesce(sum(h.amount_idr), 0)::BIGINT AS prior_total FROM ledger p
      LEFT JOIN ledger h ON {on} AND h.recorded_at <= p.occurred_at AND h.donation_id <> p.donation_id WHERE {null} GROUP BY 1"""


@query(_totals_sql("h.sender_id = p.sender_id", "p.sender_id IS NOT NULL"))
def pit_sender_totals(spark, sf_dir):
    return pit.prior_totals(ledger(spark, sf_dir), ["sender_id"], "prior")


@query(_totals_sql("h.receiver_id = p.receiver_id", "p.receiver_id IS NOT NULL"))
def pit_receiver_totals(spark, sf_dir):
    return pit.prior_totals(ledger(spark, sf_dir), ["receiver_id"], "prior")


@query(_totals_sql("h.sender_id = p.sender_id AND h.receiver_id = p.receiver_id", "p.sender_id IS NOT NULL AND p.receiver_id IS NOT NULL"))
def pit_pair_totals(spark, sf_dir):
    return pit.prior_totals(ledger(spark, sf_dir), ["sender_id", "receiver_id"], "prior")


_LOOK = "h.occurred_at BETWEEN p.occurred_at - INTERVAL {d} DAY AND p.occurred_at AND h.recorded_at <= p.occurred_at"


@query(f"""WITH {LEDGER} SELECT p.donation_id, count(*) FILTER (h.occurred_at >= p.occurred_at - INTERVAL 30 DAY) AS n30, count(h.donation_id) AS n90 FROM ledger p
  LEFT JOIN ledger h ON h.sender_id = p.sender_id AND {_LOOK.format(d=90)} GROUP BY 1""")
def pit_window_counts(spark, sf_dir):
    led = ledger(spark, sf_dir)
    n30, n90 = (pit.sliding(led, led, {"sender_id": "sender_id"}, d, {f"n{d}": F.lit(1)}) for d in (30, 90))
    return led.select("donation_id").join(n30, "donation_id", "left").join(n90, "donation_id", "left").select("donation_id", F.coalesce("n30", F.lit(0)).alias("n30"), F.coalesce("n90", F.lit(0)).alias("n90"))


@query(f"""WITH {LEDGER} SELECT p.donation_id, count(DISTINCT h.sender_id) AS senders FROM ledger p LEFT JOIN ledger h ON h.receiver_id = p.receiver_id AND {_LOOK.format(d=14)}
  WHERE p.receiver_id IS NOT NULL GROUP BY 1""")
def pit_window_senders(spark, sf_dir):
    led = ledger(spark, sf_dir)
    found = pit.sliding_distinct(led, led, "receiver_id", "sender_id", 14, "senders")
    return led.where("receiver_id is not null").select("donation_id").join(found, "donation_id", "left").select("donation_id", F.coalesce("senders", F.lit(0)).alias("senders"))


@query(f"""WITH {LEDGER} SELECT p.donation_id, count(DISTINCT h.sender_id) AS senders FROM ledger p LEFT JOIN ledger h ON h.receiver_id = p.receiver_id AND h.recorded_at <= p.occurred_at
  WHERE p.receiver_id IS NOT NULL GROUP BY 1""")
def pit_distinct_counterparties(spark, sf_dir):
    return pit.distinct_known(ledger(spark, sf_dir), "receiver_id", "sender_id", "senders")


@query(f"""WITH {LEDGER} SELECT p.donation_id, min(h.occurred_at)::DATE AS first_seen FROM ledger p LEFT JOIN ledger h ON h.sender_id = p.sender_id AND h.recorded_at <= p.occurred_at GROUP BY 1""")
def pit_first_seen(spark, sf_dir):
    return pit.first_seen(ledger(spark, sf_dir)).select("donation_id", F.to_date("first_seen").alias("first_seen"))


@query(f"""WITH {LEDGER} SELECT p.donation_id, count(DISTINCT h.sender_id) AS donors, count(DISTINCT h.sender_id) FILTER (NOT EXISTS (SELECT 1 FROM ledger o
  WHERE o.sender_id = h.sender_id AND o.recorded_at <= p.occurred_at AND o.occurred_at < p.occurred_at - INTERVAL 14 DAY)) AS fresh
  FROM ledger p JOIN ledger h ON h.receiver_id = p.receiver_id AND {_LOOK.format(d=14)} GROUP BY 1""")
def pit_prior_history(spark, sf_dir):
    led = ledger(spark, sf_dir)
    found = pit.sliding_distinct(led, led, "receiver_id", "sender_id", 14, "donors", "fresh")
    rows = pit.sliding(led, led, {"receiver_id": "receiver_id"}, 14, {"rows": F.lit(1)}).where("rows > 0")
    return rows.join(found, "donation_id", "left").select("donation_id", F.coalesce("donors", F.lit(0)).alias("donors"), F.coalesce("fresh", F.lit(0)).alias("fresh"))


@query(f"""WITH {src.GRAPH} SELECT p.donation_id, count(h.donation_id) AS inflows, coalesce(sum(h.amount_idr), 0)::BIGINT AS inflow FROM graph_ledger p
  LEFT JOIN graph_ledger h ON h.receiver_id = p.sender_id AND {_LOOK.format(d=7)} GROUP BY 1""")
def pit_inflows(spark, sf_dir):
    led = src.graph_ledger(spark, sf_dir)
    found = pit.sliding(led, led, {"sender_id": "receiver_id"}, 7, {"inflows": F.lit(1), "inflow": F.col("amount_idr")})
    return led.select("donation_id").join(found, "donation_id", "left").select("donation_id", F.coalesce("inflows", F.lit(0)).alias("inflows"), F.coalesce("inflow", F.lit(0)).alias("inflow"))


@query(f"""WITH {LEDGER} SELECT p.donation_id, p.recorded_at::DATE AS recorded_on, count(h.donation_id) AS sender_count FROM ledger p
  LEFT JOIN ledger h ON h.sender_id = p.sender_id AND h.recorded_at <= p.occurred_at AND h.donation_id <> p.donation_id GROUP BY 1, 2""")
def pit_replay(spark, sf_dir):
    return pit.replay(ledger(spark, sf_dir)).select("donation_id", F.to_date("recorded_at").alias("recorded_on"), "sender_count")


def contexts(spark, sf_dir, keep: bool = False):
    """The ledger with its contexts; ``keep``: written once, for queries that read it in many blocks."""
    out = dims.contexts(ledger(spark, sf_dir), dims.calendar(spark), dims.limits(spark))
    return scratch.written(out, "contexts") if keep else out


@query(f"WITH {LEDGER}, {dims.CONTEXTS} SELECT donation_id, regime, limit_idr::BIGINT AS limit_idr FROM (SELECT *, CASE WHEN period_start IS NOT NULL THEN 'campaign' WHEN window_start IS NOT NULL THEN 'party_annual' ELSE 'indeterminate' END AS regime FROM ctx)")
def regime_limits(spark, sf_dir):
    return contexts(spark, sf_dir).select("donation_id", "regime", "limit_idr")


@query(f"WITH {LEDGER}, {dims.CONTEXTS} SELECT donation_id, window_start::DATE AS window_from, window_end::DATE AS window_to FROM ctx")
def accumulation_windows(spark, sf_dir):
    return contexts(spark, sf_dir).select("donation_id", F.to_date("window_start").alias("window_from"), F.to_date("window_end").alias("window_to"))


@query(f"WITH {LEDGER}, {dims.CONTEXTS} SELECT donation_id, next_deadline, next_deadline - occurred_at::DATE AS days_left FROM ctx")
def next_deadline(spark, sf_dir):
    return contexts(spark, sf_dir).select("donation_id", "next_deadline", F.datediff("next_deadline", F.to_date("occurred_at")).cast("long").alias("days_left"))


@query(f"""WITH {LEDGER}, {ref.ENTRIES}, c AS (SELECT c_custkey, lower(c_name) AS folded FROM customer)
SELECT donation_id, CASE WHEN occurred_at::DATE - DATE '1997-06-01' <= 700 THEN
  CASE WHEN EXISTS (SELECT 1 FROM entries e WHERE e.entity_id = sender_id) THEN EXISTS (SELECT 1 FROM entries e WHERE e.entity_id = sender_id AND effective_from <= occurred_at::DATE AND coalesce(effective_to >= occurred_at::DATE, true))
  ELSE EXISTS (SELECT 1 FROM entries e WHERE e.folded = c.folded AND effective_from <= occurred_at::DATE AND coalesce(effective_to >= occurred_at::DATE, true)) END END AS listed
FROM ledger LEFT JOIN c ON c_custkey = sender_id""")
def register_lookup(spark, sf_dir):
    names = src.entities(spark, sf_dir).select(F.col("entity_id").alias("sender_id"), F.upper("canonical_name").alias("sender_name"))
    rows = ledger(spark, sf_dir).join(names, "sender_id", "left")
    return refdata.register_lookup(rows, ref.registers(spark), ref.register_entries(spark, sf_dir), "prohibited_source", "sender_id", "sender_name", F.to_date("occurred_at")).select("donation_id", "listed")


@query(f"""WITH {ref.ENTRIES} SELECT 'prohibited_source' AS name, true AS usable, count(*) AS entries FROM entries UNION ALL SELECT 'final_convictions', false, 0 UNION ALL SELECT 'watch', false, 0""")
def register_status(spark, sf_dir):
    return refdata.register_status(ref.registers(spark), ref.register_entries(spark, sf_dir), F.lit("1998-01-01").cast("timestamp"))


MATCH = """f.electoral_context = p.electoral_context AND (f.donor_ref IS NULL OR p.sender_id IS NULL OR f.donor_ref = p.sender_id)
  AND (f.recipient_ref IS NULL OR p.receiver_id IS NULL OR f.recipient_ref = p.receiver_id)
  AND (f.amount_idr IS NULL OR abs(f.amount_idr - p.amount_idr) * 100 <= p.amount_idr * 2) AND (f.occurred_on IS NULL OR abs(f.occurred_on - p.occurred_at::DATE) <= 3)"""


@query(f"""WITH {LEDGER}, {ref.FILINGS} SELECT donation_id, CASE WHEN electoral_context = 'ctx-1998' AND occurred_at::DATE BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'
  THEN EXISTS (SELECT 1 FROM filings f WHERE {MATCH}) END AS declared FROM ledger p""")
def reconcile_filings(spark, sf_dir):
    return refdata.reconcile(ledger(spark, sf_dir), ref.filings(spark, sf_dir), ref.filing_periods(spark))
