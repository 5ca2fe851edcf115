"""Queries over the feature families; the SQL is the naive range self-join."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.stats import micro
from hindcast.operators import dims, features
from hindcast.sources.ledger import LEDGER

from .point_in_time import contexts
from .registry import query

_CTX = f"WITH {LEDGER}, {dims.CONTEXTS}"
_PRIOR = "h.recorded_at <= p.occurred_at AND h.donation_id <> p.donation_id"


def _x(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5)::BIGINT"


def quality_rows(spark, sf_dir):
    """The ledger with made-up provenance of its fields and confidence of its parties."""
    from hindcast.sources.ledger import ledger

    k = F.col("donation_id")
    entry = lambda p, c: F.struct(p.alias("provenance"), c.cast("double").alias("confidence"))
    fields = F.create_map(F.lit("amount"), entry(F.when(k % 2 == 0, "extracted").otherwise("native"), F.when(k % 10 < 5, 0.5).otherwise(0.75)), F.lit("date"), entry(F.lit("native"), F.lit(None)))
    empty = F.map_filter(fields, lambda a, b: F.lit(False))
    return ledger(spark, sf_dir).withColumns({"provenance": F.when(k % 5 == 0, empty).otherwise(fields), "sender_confidence": F.when(k % 3 == 0, F.lit(0.5)), "receiver_confidence": F.when(k % 4 == 0, F.lit(0.25))})


def _m(x: str, name: str) -> str:
    return f"{_x(x)} AS {name}"


@query(f"{_CTX} SELECT donation_id, amount_idr AS amount, {_m('ln(1 + amount_idr)', 'amount_log')}, sender_type, receiver_type, transaction_kind, channel, amount_idr % 1000000 = 0 AS is_round_amount, length(regexp_extract(amount_idr::VARCHAR, '(0*)$', 1))::BIGINT AS amount_trailing_zeros FROM ctx")
def features_transaction(spark, sf_dir):
    return features.transaction(contexts(spark, sf_dir)).withColumn("amount_log", micro(F.col("amount_log")))


@query(
    f"""{_CTX}, h AS (SELECT p.donation_id AS id, p.occurred_at AS t, h.* FROM ctx p JOIN ctx h ON h.sender_id = p.sender_id AND {_PRIOR}),
    a AS (SELECT id, count(*) AS n, sum(amount_idr) AS s, sum(amount_idr::HUGEINT * amount_idr) AS q, count(*) FILTER (occurred_at >= t - INTERVAL 30 DAY) AS n30, count(*) FILTER (occurred_at >= t - INTERVAL 90 DAY) AS n90,
      max(occurred_at)::DATE - min(occurred_at)::DATE AS span, count(DISTINCT receiver_id) AS r, max(amount_idr) AS top FROM h GROUP BY id),
    b AS (SELECT id, max(s) AS top_pair FROM (SELECT id, receiver_id, sum(amount_idr) AS s FROM h WHERE receiver_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    f AS (SELECT p.donation_id AS id, p.occurred_at::DATE - min(h.occurred_at)::DATE AS seen FROM ctx p JOIN ctx h ON h.sender_id = p.sender_id AND h.recorded_at <= p.occurred_at GROUP BY p.donation_id, p.occurred_at)
    SELECT donation_id, coalesce(s, 0)::BIGINT AS total_donasi_sender, coalesce(n, 0) AS jumlah_transaksi_sender, {_m('s::DOUBLE / n', 'rata_rata_donasi_sender')}, CASE WHEN n >= 2 THEN floor(sqrt(greatest((q::DOUBLE - s::DOUBLE * (s::DOUBLE / n)) / (n - 1), 0)))::BIGINT END AS std_donasi_sender,
      coalesce(n30, 0) AS jumlah_donasi_30hari_sender, CASE WHEN n >= 2 THEN {_x('span::DOUBLE / (n - 1)')} END AS selang_waktu_rata2_sender, coalesce(r, 0) AS receiver_unik_per_sender, top_pair::BIGINT AS max_donasi_satu_receiver,
      {_m('top::DOUBLE / s', 'proporsi_donasi_terbesar_per_sender')}, seen::BIGINT AS sender_days_since_first_seen, coalesce(n, 0) = 0 AS sender_is_first_donation, CASE WHEN n90 >= 2 THEN {_x('(n30 / 30.0::DOUBLE) / (n90 / 90.0::DOUBLE)')} END AS sender_velocity_ratio
    FROM ctx LEFT JOIN a ON a.id = donation_id LEFT JOIN b ON b.id = donation_id LEFT JOIN f ON f.id = donation_id"""
)
def features_donor(spark, sf_dir):
    out = features.donor(contexts(spark, sf_dir, keep=True))
    exact = {c: micro(F.col(c)) for c in ("rata_rata_donasi_sender", "selang_waktu_rata2_sender", "proporsi_donasi_terbesar_per_sender", "sender_velocity_ratio")}
    return out.withColumns({**exact, "std_donasi_sender": F.floor("std_donasi_sender").cast("long"), "sender_days_since_first_seen": F.col("sender_days_since_first_seen").cast("long")})


@query(
    f"""{_CTX}, h AS (SELECT p.donation_id AS id, p.occurred_at AS t, h.* FROM ctx p JOIN ctx h ON h.receiver_id = p.receiver_id AND {_PRIOR}),
    a AS (SELECT id, count(*) AS n, sum(amount_idr) AS s, count(DISTINCT sender_id) AS d, count(*) FILTER (occurred_at >= t - INTERVAL 30 DAY) AS n30, sum(amount_idr) FILTER (occurred_at >= t - INTERVAL 30 DAY) AS s30,
      sum(amount_idr::HUGEINT * amount_idr) FILTER (occurred_at >= t - INTERVAL 30 DAY) AS q30 FROM h GROUP BY id),
    b AS (SELECT id, max(s) AS top, sum(s) AS res FROM (SELECT id, sender_id, sum(amount_idr) AS s FROM h WHERE sender_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    w AS (SELECT DISTINCT id, t, sender_id AS s FROM h WHERE occurred_at >= t - INTERVAL 30 DAY AND sender_id IS NOT NULL),
    e AS (SELECT id, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ctx o WHERE o.sender_id = s AND o.recorded_at <= t AND o.occurred_at < t - INTERVAL 30 DAY)) AS fresh FROM w GROUP BY id)
    SELECT donation_id, CASE WHEN receiver_id IS NOT NULL THEN coalesce(d, 0) END AS sender_unik_per_receiver, CASE WHEN receiver_id IS NOT NULL THEN coalesce(s, 0)::BIGINT END AS total_diterima_receiver, CASE WHEN receiver_id IS NOT NULL THEN coalesce(a.n, 0) END AS jumlah_transaksi_receiver,
      {_m('top::DOUBLE / res', 'receiver_donor_concentration')}, {_m('fresh::DOUBLE / e.n', 'receiver_new_donor_ratio_30d')},
      CASE WHEN n30 >= 2 THEN floor(sqrt(greatest(q30::DOUBLE / n30 - (s30::DOUBLE / n30) * (s30::DOUBLE / n30), 0)) / (s30::DOUBLE / n30) * 1e4 + 0.5)::BIGINT END AS receiver_amount_cv_30d
    FROM ctx LEFT JOIN a ON a.id = donation_id LEFT JOIN b ON b.id = donation_id LEFT JOIN e ON e.id = donation_id"""
)
def features_recipient(spark, sf_dir):
    out = features.recipient(contexts(spark, sf_dir, keep=True))
    return out.withColumns({"receiver_donor_concentration": micro(F.col("receiver_donor_concentration")), "receiver_new_donor_ratio_30d": micro(F.col("receiver_new_donor_ratio_30d")), "receiver_amount_cv_30d": F.floor(F.col("receiver_amount_cv_30d") * F.lit(1e4) + F.lit(0.5)).cast("long")})


@query(
    f"""{_CTX} SELECT p.donation_id, CASE WHEN p.receiver_id IS NOT NULL THEN count(h.donation_id) END AS pair_prior_count, CASE WHEN p.receiver_id IS NOT NULL THEN coalesce(sum(h.amount_idr), 0)::BIGINT END AS pair_prior_total,
    CASE WHEN p.receiver_id IS NOT NULL THEN count(h.donation_id) = 0 END AS pair_is_first, (p.occurred_at::DATE - max(h.occurred_at)::DATE)::BIGINT AS pair_days_since_last
    FROM ctx p LEFT JOIN ctx h ON h.sender_id = p.sender_id AND h.receiver_id = p.receiver_id AND {_PRIOR} GROUP BY p.donation_id, p.receiver_id, p.occurred_at"""
)
def features_pair(spark, sf_dir):
    return features.pair(contexts(spark, sf_dir, keep=True)).withColumn("pair_days_since_last", F.col("pair_days_since_last").cast("long"))


@query(f"{_CTX} SELECT donation_id, CASE WHEN electoral_context IS NOT NULL THEN period_start IS NOT NULL END AS is_within_campaign_period, {_m('(occurred_at::DATE - period_start)::DOUBLE / (period_end - period_start)', 'campaign_period_phase')}, (next_deadline - occurred_at::DATE)::BIGINT AS days_to_reporting_deadline, (isodow(occurred_at) - 1)::BIGINT AS day_of_week, NULL::BIGINT AS hour_of_day FROM ctx")
def features_temporal(spark, sf_dir):
    return features.temporal(contexts(spark, sf_dir)).withColumn("campaign_period_phase", micro(F.col("campaign_period_phase")))


@query(
    f"""{_CTX} SELECT p.donation_id, {_m('p.amount_idr::DOUBLE / p.limit_idr', 'amount_to_limit_ratio')}, CASE WHEN p.receiver_id IS NOT NULL THEN {_x('(coalesce(sum(h.amount_idr), 0) + p.amount_idr)::DOUBLE / p.limit_idr')} END AS cumulative_to_limit_ratio,
    p.amount_idr::DOUBLE / p.limit_idr >= 0.9 AND p.amount_idr::DOUBLE / p.limit_idr < 1.0 AS in_structuring_band
    FROM ctx p LEFT JOIN ctx h ON h.sender_id = p.sender_id AND h.receiver_id = p.receiver_id AND {_PRIOR} AND (p.window_start IS NULL OR h.occurred_at >= p.window_start) GROUP BY p.donation_id, p.receiver_id, p.amount_idr, p.limit_idr"""
)
def features_threshold(spark, sf_dir):
    return features.threshold(contexts(spark, sf_dir), dims.calendar(spark)).withColumns({c: micro(F.col(c)) for c in ("amount_to_limit_ratio", "cumulative_to_limit_ratio")})


@query(
    f"""WITH {LEDGER} SELECT donation_id, CASE WHEN donation_id % 5 <> 0 THEN CASE WHEN donation_id % 10 < 5 THEN 0.5 ELSE 0.75 END END AS extraction_confidence_min, CASE WHEN donation_id % 3 = 0 THEN CASE WHEN donation_id % 4 = 0 THEN 0.25 ELSE 0.5 END WHEN donation_id % 4 = 0 THEN 0.25 END AS entity_resolution_confidence,
    sender_id IS NULL OR receiver_id IS NULL AS has_unresolved_entity, CASE WHEN donation_id % 5 <> 0 THEN CASE WHEN donation_id % 2 = 0 THEN 0.5 ELSE 0.0 END END AS field_provenance_mix FROM ledger"""
)
def features_quality(spark, sf_dir):
    return features.quality(quality_rows(spark, sf_dir))


@query(
    f"""{_CTX}, i AS (SELECT p.donation_id AS id, count(DISTINCT h.sender_id) AS n, count(DISTINCT h.sender_id) FILTER (h.occurred_at >= p.occurred_at - INTERVAL 14 DAY) AS n14, bool_or(h.sender_id = p.sender_id) AS mine FROM ctx p JOIN ctx h ON h.receiver_id = p.receiver_id AND h.recorded_at <= p.occurred_at GROUP BY 1),
    o AS (SELECT p.donation_id AS id, count(DISTINCT h.receiver_id) AS n FROM ctx p JOIN ctx h ON h.sender_id = p.sender_id AND h.recorded_at <= p.occurred_at GROUP BY 1),
    f AS (SELECT p.donation_id AS id, sum(h.amount_idr) AS s, max(h.occurred_at) AS last FROM ctx p JOIN ctx h ON h.receiver_id = p.sender_id AND h.recorded_at <= p.occurred_at AND h.occurred_at >= p.occurred_at - INTERVAL 7 DAY GROUP BY 1)
    SELECT donation_id, coalesce(o.n, 0) AS sender_out_degree, CASE WHEN receiver_id IS NOT NULL THEN coalesce(i.n, 0) END AS receiver_in_degree, CASE WHEN i.n > 0 THEN {_x('i.n14::DOUBLE / i.n')} END AS receiver_in_degree_velocity_14d,
      {_m('amount_idr::DOUBLE / s::DOUBLE', 'pass_through_ratio')}, (occurred_at::DATE - last::DATE)::BIGINT AS pass_through_lag_days, CASE WHEN receiver_id IS NOT NULL THEN coalesce(i.n, 0) - coalesce(mine, false)::BIGINT END AS shared_counterparty_count
    FROM ctx LEFT JOIN i ON i.id = donation_id LEFT JOIN o ON o.id = donation_id LEFT JOIN f ON f.id = donation_id"""
)
def features_graph(spark, sf_dir):
    out = features.graph(contexts(spark, sf_dir, keep=True))
    return out.withColumns({"receiver_in_degree_velocity_14d": micro(F.col("receiver_in_degree_velocity_14d")), "pass_through_ratio": micro(F.col("pass_through_ratio")), "pass_through_lag_days": F.col("pass_through_lag_days").cast("long")})
