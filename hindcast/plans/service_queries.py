"""Queries over what a scoring service does: batches, alert versions, rescoring, labels, health, retraining, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.stats import micro
from hindcast.operators import dims, fairness, features, graph, learn, monitor, pit, rules, scoring, service
from hindcast.sources import ledger as src
from hindcast.sources import scratch
from hindcast.sources.ledger import LEDGER, RAW, ledger
from hindcast.streaming import arrivals

from . import feature_queries as fq
from .late_queries import _ITEMS, items
from .measure_queries import _LANES, _PSI, COHORTS, SCORED, _halves, _m, cohorts, lanes, scored
from .point_in_time import RAW_CHECKS, contexts
from .registry import ORACLES, query
from .ruling import VERDICTS, long_table

_ERRORS = f"concat_ws(',', {', '.join(f'''CASE WHEN {v} THEN '{k}' END''' for k, v in RAW_CHECKS.items())})"


def _total_score(rows):
    """A stand-in score: what the sender had given, in hundredths of ten billion, 100 at most."""
    total = pit.prior_totals(rows, ["sender_id"], "s")
    return total.select("donation_id", F.least(F.floor(F.coalesce("s_total", F.lit(0)) / F.lit(100_000_000)), F.lit(100)).cast("long").alias("score"))


@query(
    f"""WITH {RAW}, e AS (SELECT *, {_ERRORS} AS errors FROM raw), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY donation_id ORDER BY donation_version DESC) AS r FROM e WHERE errors = '') WHERE r = 1),
    s AS (SELECT p.donation_id, p.donation_version, least(floor(coalesce(sum(h.amount_idr), 0) / 100000000.0::DOUBLE), 100)::BIGINT AS score FROM v p LEFT JOIN v h ON h.sender_id = p.sender_id AND h.recorded_at <= p.occurred_at AND h.donation_id <> p.donation_id GROUP BY 1, 2)
    SELECT e.donation_id, e.donation_version, CASE WHEN errors <> '' THEN 'error' WHEN score IS NULL THEN 'superseded' ELSE 'scored' END AS status, score, errors FROM e LEFT JOIN s USING (donation_id, donation_version)"""
)
def score_batch(spark, sf_dir):
    """Every arriving record scored or refused on its own."""
    out = service.score_batch(src.raw_records(spark, sf_dir), src.validate, _total_score)
    return out.withColumn("errors", F.array_join("errors", ","))


_FAMILIES = ("transaction", "donor", "recipient", "pair", "temporal", "threshold", "quality", "graph")


def _all_features_sql() -> str:
    parts = [ORACLES[f"features_{f}"] for f in _FAMILIES]
    joined = f"({parts[0]}) f0" + "".join(f" JOIN ({p}) f{i} USING (donation_id)" for i, p in enumerate(parts) if i)
    names = ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in FEATURES)
    doubles = ", ".join(f"{c}::DOUBLE AS {c}" for c in ("extraction_confidence_min", "entity_resolution_confidence", "field_provenance_mix"))
    return f"SELECT * REPLACE ({doubles}), array_to_string(list_sort(list_filter([{names}], lambda x: x IS NOT NULL)), ',') AS missing FROM {joined}"


#: The features, in the order of their families.
FEATURES = (
    "amount", "amount_log", "sender_type", "receiver_type", "transaction_kind", "channel", "is_round_amount", "amount_trailing_zeros",
    "total_donasi_sender", "jumlah_transaksi_sender", "rata_rata_donasi_sender", "std_donasi_sender", "jumlah_donasi_30hari_sender", "selang_waktu_rata2_sender", "receiver_unik_per_sender",
    "max_donasi_satu_receiver", "proporsi_donasi_terbesar_per_sender", "sender_days_since_first_seen", "sender_is_first_donation", "sender_velocity_ratio",
    "sender_unik_per_receiver", "total_diterima_receiver", "jumlah_transaksi_receiver", "receiver_donor_concentration", "receiver_new_donor_ratio_30d", "receiver_amount_cv_30d",
    "pair_prior_count", "pair_prior_total", "pair_is_first", "pair_days_since_last",
    "is_within_campaign_period", "campaign_period_phase", "days_to_reporting_deadline", "day_of_week", "hour_of_day",
    "amount_to_limit_ratio", "cumulative_to_limit_ratio", "in_structuring_band",
    "extraction_confidence_min", "entity_resolution_confidence", "has_unresolved_entity", "field_provenance_mix",
    "sender_out_degree", "receiver_in_degree", "receiver_in_degree_velocity_14d", "pass_through_ratio", "pass_through_lag_days", "shared_counterparty_count",
)


@query(_all_features_sql())
def features_backfill(spark, sf_dir):
    """Every feature of every transfer with the names of those that are unknown; rounded as in the queries of the families."""
    ctx = contexts(spark, sf_dir, keep=True)
    out = features.backfill(ctx, dims.calendar(spark), [features.quality(fq.quality_rows(spark, sf_dir))])
    whole = lambda c, k: F.floor(F.col(c) * F.lit(k) + F.lit(0.5)).cast("long")
    exact = ("amount_log", "rata_rata_donasi_sender", "selang_waktu_rata2_sender", "proporsi_donasi_terbesar_per_sender", "sender_velocity_ratio", "receiver_donor_concentration", "receiver_new_donor_ratio_30d", "campaign_period_phase", "amount_to_limit_ratio", "cumulative_to_limit_ratio", "receiver_in_degree_velocity_14d", "pass_through_ratio")
    longs = ("sender_days_since_first_seen", "pair_days_since_last", "pass_through_lag_days")
    rounded = {**{c: micro(F.col(c)) for c in exact}, **{c: F.col(c).cast("long") for c in longs}, "std_donasi_sender": F.floor("std_donasi_sender").cast("long"), "receiver_amount_cv_30d": whole("receiver_amount_cv_30d", 1e4)}
    return out.withColumns({**rounded, "missing": F.array_join(F.array_sort("missing"), ",")}).select("donation_id", *FEATURES, "missing")


RUNS = ("1997-12-31", "1998-06-30")


def _run_sql(at: str) -> str:
    return f"""SELECT TIMESTAMP '{at}' AS detected_at, receiver_id, count(DISTINCT sender_id) AS donors FROM ledger WHERE recorded_at <= TIMESTAMP '{at}' AND occurred_at <= TIMESTAMP '{at}' AND occurred_at >= TIMESTAMP '{at}' - INTERVAL 14 DAY
      AND receiver_id IS NOT NULL GROUP BY 2 HAVING count(DISTINCT sender_id) >= 3"""


@query(
    f"""WITH {LEDGER}, a AS ({_run_sql(RUNS[0])} UNION ALL {_run_sql(RUNS[1])}), s AS (SELECT donation_id, receiver_id, CASE WHEN occurred_at >= TIMESTAMP '{RUNS[1]}' THEN TIMESTAMP '{RUNS[1]}' WHEN occurred_at >= TIMESTAMP '{RUNS[0]}' THEN TIMESTAMP '{RUNS[0]}' END AS run FROM ledger)
    SELECT donation_id, run::DATE AS detected_on, count(donors) AS alerts FROM s LEFT JOIN a ON a.receiver_id = s.receiver_id AND a.detected_at = run GROUP BY 1, 2"""
)
def alert_versions(spark, sf_dir):
    """Alerts detected twice; each transfer is scored with the run before it."""
    led = ledger(spark, sf_dir)
    alerts = scratch.written(service.versioned(lambda at: graph.fan_in(led, at, min_donors=3), RUNS), "alerts")
    return service.adopted(led, alerts, RUNS, "receiver_id").select("donation_id", F.to_date("detected_at").alias("detected_on"), "alerts")


@query(
    f"""WITH {LEDGER}, e AS (SELECT donation_id, recorded_at::DATE AS scored_on, amount_idr % 101 AS score, NULL::VARCHAR AS reason, NULL::BIGINT AS previous FROM ledger)
    SELECT * FROM e UNION ALL SELECT donation_id, DATE '2000-01-01', (score * 2) % 101, 'rule_set_change', score FROM e WHERE donation_id % 10 = 0"""
)
def rescore_history(spark, sf_dir):
    """A tenth of the transfers scored again after a change of rules: the old events stay."""
    led = ledger(spark, sf_dir)
    events = led.select("donation_id", F.col("recorded_at").alias("scored_at"), (F.col("amount_idr") % 101).alias("score"))
    new = events.select("donation_id", ((F.col("score") * 2) % 101).alias("score"))
    again = arrivals.rescored(events, new, led.where("donation_id % 10 = 0").select("donation_id"), "rule_set_change", F.lit("2000-01-01").cast("timestamp"))
    return events.unionByName(again, allowMissingColumns=True).select("donation_id", F.to_date("scored_at").alias("scored_on"), "score", "reason", "previous")


def _labels(spark, sf_dir):
    k, sources = F.col("doc_id"), [n for n, _ in service.LABEL_WEIGHTS]
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        k.alias("label_id"), (k % 40).alias("donation_id"), (k % 23).alias("donation_version"), F.when(F.col("quality") == 1, "not_risky").when(F.col("toxic") == 1, "risky").otherwise("indeterminate").alias("value"),
        F.element_at(F.array(*map(F.lit, sources)), (k % 5 + 1).cast("int")).alias("source"), F.when(k % 4 == 0, (k % 8) / F.lit(4.0)).alias("weight"), F.when(k % 10 == 0, "audit-sample 1").alias("note"), F.timestamp_seconds(k % 7).alias("created_at"),
    )


_LABELS = """labs AS (SELECT doc_id AS label_id, doc_id % 40 AS donation_id, doc_id % 23 AS donation_version, CASE WHEN quality = 1 THEN 'not_risky' WHEN toxic = 1 THEN 'risky' ELSE 'indeterminate' END AS value,
  (['dispute_outcome', 'analyst_disposition', 'recipient_confirmation', 'rule_tier2', 'synthetic'])[doc_id % 5 + 1] AS source, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 8) / 4.0::DOUBLE END AS w, CASE WHEN doc_id % 10 = 0 THEN 'audit-sample 1' END AS note, doc_id % 7 AS made FROM labels),
  checked AS (SELECT *, coalesce(w, (['1.0', '0.9', '0.7', '0.5', '0.3'])[label_id % 5 + 1]::DOUBLE) AS weight, source IN ('analyst_disposition', 'dispute_outcome') AS is_human FROM labs),
  marked AS (SELECT *, concat_ws(',', CASE WHEN NOT donation_version >= 1 THEN 'version_below_one' END, CASE WHEN weight NOT BETWEEN 0 AND 1 THEN 'weight_out_of_range' END, CASE WHEN source = 'recipient_confirmation' AND value <> 'indeterminate' THEN 'confirmation_is_no_verdict' END) AS errors FROM checked)"""


@query(f"WITH {_LABELS} SELECT label_id, is_human, {_m('weight', 'weight')}, errors FROM marked")
def label_checks(spark, sf_dir):
    return service.checked_labels(_labels(spark, sf_dir)).select("label_id", "is_human", micro(F.col("weight")).alias("weight"), F.array_join("errors", ",").alias("errors"))


@query(f"WITH {_LABELS} SELECT donation_id, label_id, value FROM (SELECT *, row_number() OVER (PARTITION BY donation_id ORDER BY made DESC, label_id DESC) AS r FROM marked WHERE errors = '') WHERE r = 1")
def latest_labels(spark, sf_dir):
    good = service.checked_labels(_labels(spark, sf_dir)).where(F.size("errors") == 0)
    return monitor.latest_labels(good).select("donation_id", "label_id", "value")


@query(
    f"""WITH {_LABELS}, n AS (SELECT count(*) FILTER (is_human) AS human, count(*) FILTER (is_human AND note LIKE 'audit-sample%') AS audited, count(*) FILTER (source = 'dispute_outcome') AS disputes FROM checked),
    f AS (SELECT human >= 200 AS enough, CASE WHEN human = 0 THEN true ELSE audited::DOUBLE / human < 0.15 END AS thin, human >= 200 AND disputes = 0 AS noted FROM n)
    SELECT unnest(['trigger', 'trigger', 'trigger', 'trigger', 'blocker', 'blocker', 'blocker', 'note', 'decision']) AS kind, unnest(['new human judgements', 'input or score drift', 'rule set changed', 'model age', 'too few human labels', 'too few audited labels', 'pipeline faults', 'no dispute outcomes', 'retrain']) AS name,
      unnest([enough, true, false, true, NOT enough, thin, false, noted, enough AND NOT thin]) AS fired FROM f"""
)
def retraining(spark, sf_dir):
    """Triggers, blockers and the decision, with drift and a model of a hundred days."""
    at = lambda d: F.lit(d).cast("timestamp")
    return service.retraining(_labels(spark, sf_dir), at("2026-04-11"), at("2026-01-01"), drift=True, faults=(), rules_changed=False)


@query(
    f"""{_LANES}, sc AS (SELECT donation_id, least(coalesce(sum(contribution), 0), 100) AS score FROM lanes GROUP BY 1), last AS (SELECT max(recorded_at) AS m FROM ledger), rec AS (SELECT donation_id, recorded_at FROM ledger, last WHERE recorded_at >= m - INTERVAL 30 DAY),
    fl2 AS (SELECT count(*) AS n FROM rec JOIN sc USING (donation_id) WHERE score >= 50 OR donation_id IN (SELECT donation_id FROM verdicts WHERE outcome = 'LEGAL_FINDING')),
    r AS (SELECT rule_id, count(*) FILTER (outcome = 'LEGAL_FINDING') AS f, count(*) FILTER (outcome = 'INDETERMINATE') AS i FROM verdicts JOIN rec USING (donation_id) GROUP BY 1)
    SELECT 1 AS place, 'lane did not run' AS concern, lane AS subject, (count(*) * 1000000)::BIGINT AS value FROM lanes JOIN rec USING (donation_id) GROUP BY lane HAVING count(contribution) = 0
    UNION ALL SELECT 2, 'rule could not be evaluated', rule_id, floor(i::DOUBLE / nullif(f + i, 0) * 1e6 + 0.5)::BIGINT FROM r WHERE i::DOUBLE / nullif(f + i, 0) > 0.5 UNION ALL SELECT 3, 'over budget', 'flagged', (n * 1000000)::BIGINT FROM fl2 WHERE n > 10 UNION ALL SELECT 4, 'degraded scores', 'degraded', 1000000 WHERE (SELECT count(*) FROM rec) > 0"""
)
def health_concerns(spark, sf_dir):
    """Concerns over the last 30 days of scoring, with a budget of ten."""
    long = scratch.written(long_table(spark, sf_dir).select("donation_id", "rule_id", "outcome", "label_weight"), "outcomes")
    results = scratch.written(lanes(spark, sf_dir, long), "lanes")
    scores = scoring.composed(results).join(ledger(spark, sf_dir).select("donation_id", F.col("recorded_at").alias("scored_at")), "donation_id")
    return service.window_health(scores, results, long, 30, 10).withColumn("value", micro(F.col("value")))


def _short_lanes(spark, sf_dir):
    rows = scored(spark, sf_dir)
    model = rows.select("donation_id", F.when(F.col("donation_id") % 11 != 0, F.col("score")).alias("intensity"))
    anomaly = scoring.anomaly_lane(rows.select("donation_id", F.col("score").alias("anomaly")), rows.where("rule_flagged"), F.lit(0.5))
    return scoring.lane_results(rows, {"classifier": model, "anomaly": anomaly})


@query(
    f"""WITH {SCORED}, i AS (SELECT donation_id, CASE WHEN donation_id % 11 <> 0 THEN round_even(least(score, 1) * 30, 0) END AS classifier, CASE WHEN NOT rule_flagged THEN round_even(CASE WHEN score < 0.5 THEN 0.0 ELSE least((score - 0.5) / 0.5, 1.0) END * 15, 0) END AS anomaly FROM scored),
    l AS (SELECT donation_id, unnest(['graph', 'classifier', 'anomaly', 'reputation']) AS lane, unnest([NULL, classifier, anomaly, NULL])::BIGINT AS c FROM i)
    SELECT donation_id, (row_number() OVER (PARTITION BY donation_id ORDER BY coalesce(c, 0) DESC, lane) - 1)::INTEGER AS place, lane, coalesce(c, 0) AS weight, c IS NULL AS absent FROM l WHERE c IS NULL OR c > 0"""
)
def score_reasons(spark, sf_dir):
    """Reasons in the order of what they add, absent lanes last with weight 0."""
    return service.lane_reasons(scoring.composed(_short_lanes(spark, sf_dir)))


_KEYS = "['amount', 'sender', 'receiver', 'lag']"


@query(
    f"""WITH {LEDGER}, f AS (SELECT donation_id, unnest({_KEYS}) AS feature, unnest([4, 3, 2, 1]) AS importance, unnest([amount_idr > 0, donation_id % 5 <> 0, receiver_id IS NOT NULL, recorded_at > occurred_at]) AS stated FROM ledger)
    SELECT l.donation_id, coalesce((SELECT string_agg(feature, ',' ORDER BY importance DESC) FROM (SELECT * FROM f WHERE f.donation_id = l.donation_id AND stated ORDER BY importance DESC LIMIT 3)), '') AS reasons FROM ledger l"""
)
def classifier_reasons(spark, sf_dir):
    """The three most important features of a transfer that can be stated."""
    led = ledger(spark, sf_dir)
    late = F.datediff("recorded_at", "occurred_at")
    rows = led.select("donation_id", F.col("amount_idr").alias("amount"), F.when(F.col("donation_id") % 5 != 0, F.col("sender_id")).alias("sender"), F.col("receiver_id").alias("receiver"), F.when(late > 0, late).alias("lag"))
    return service.top_reasons(rows, {"amount": 0.4, "sender": 0.3, "receiver": 0.2, "lag": 0.1}).withColumn("reasons", F.array_join("reasons", ","))


@query(
    f"""WITH {LEDGER}, {_ITEMS}, c AS (SELECT entity_id, source, published_at - INTERVAL 27 YEAR AS pub, CASE stage WHEN 'adjudicated' THEN 1.0 WHEN 'charged' THEN 0.6 ELSE 0.3 END AS w FROM items WHERE page_id % 13 <> 0 AND page_id % 3 <> 0)
    SELECT donation_id, floor(max(w)::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * least(count(DISTINCT source) / 4.0::DOUBLE, 1.0)) * 1e6 + 0.5)::BIGINT AS intensity FROM ledger JOIN c ON entity_id = sender_id AND pub <= occurred_at AND occurred_at::DATE - pub::DATE <= 1095 GROUP BY 1 HAVING count(DISTINCT source) >= 2"""
)
def reputation_scores(spark, sf_dir):
    """The reputation lane over press items of the senders, 27 years back so that they meet the ledger."""
    k = F.col("page_id")
    cover = items(spark, sf_dir).select("entity_id", "source", F.add_months("published_at", -27 * 12).cast("timestamp").alias("published_at"), "stage", (k % 13 == 0).alias("retracted"), F.when(k % 3 == 0, 0.5).otherwise(0.99).alias("match_confidence"))
    return scoring.reputation_lane(ledger(spark, sf_dir), cover, True).select("donation_id", micro(F.col("intensity")).alias("intensity"))


@query(
    """WITH r AS (SELECT event_id, event_type AS code, event_type || (event_id % 3) AS wording FROM events), d AS (SELECT event_type AS code, arg_max(CASE WHEN event_id % 2 = 0 THEN 'accepted' ELSE 'rejected' END, event_id) AS decision, arg_max(event_type || (event_id % 3), event_id) AS wording FROM events GROUP BY 1)
    SELECT event_id, CASE WHEN r.wording = d.wording THEN decision ELSE 'unreviewed' END AS state FROM r JOIN d USING (code)"""
)
def review_states(spark, sf_dir):
    """Each reason with the last decision on its code, unless its wording has changed since."""
    k = F.col("event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_type").alias("code"), F.concat("event_type", k % 3).alias("wording"))
    reviews = e.select("code", F.when(k % 2 == 0, "accepted").otherwise("rejected").alias("decision"), "wording", k.alias("decided_at"))
    return scoring.review_state(e, reviews).select("event_id", "state")


@query(
    f"""{_PSI}, cov AS (SELECT channel AS rule_id, count(*) FILTER (electoral_context IS NULL)::DOUBLE / count(*) AS rate FROM ledger GROUP BY 1)
    SELECT 'score drift' AS kind, feature AS subject FROM psi WHERE psi > 0.0005 UNION ALL SELECT 'rule cannot be evaluated', rule_id FROM cov WHERE rate > 0.02"""
)
def drift_findings(spark, sf_dir):
    rate = F.avg(F.col("electoral_context").isNull().cast("double"))
    cover = ledger(spark, sf_dir).groupBy(F.col("channel").alias("rule_id")).agg(rate.alias("indeterminate_rate"))
    return monitor.findings(monitor.psi(*_halves(spark, sf_dir)), cover, drift=0.0005, blind=0.02)


@query(f"WITH {SCORED} SELECT count(*) AS rows, count(*) FILTER (confirmed) AS positives, {_m('avg(confirmed::INT::DOUBLE)', 'base_rate')}, {_m('count(*) FILTER (NOT confirmed)::DOUBLE / count(*) FILTER (confirmed)', 'factor')} FROM scored")
def label_balance(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("label", F.col("confirmed").cast("double"))
    return learn.balance(rows).withColumns({c: micro(F.col(c)) for c in ("base_rate", "factor")})


@query(f"{COHORTS} SELECT affiliation, {_m('avg(flagged::INT::DOUBLE)', 'rate')} FROM cohorts WHERE affiliation IS NOT NULL GROUP BY 1")
def selection_rates(spark, sf_dir):
    return service.selection_rates(cohorts(spark, sf_dir)).withColumn("rate", micro(F.col("rate")))


_FAIR = f"""{COHORTS}, rt AS (SELECT attribute, CASE WHEN clean >= 30 THEN false_flags::DOUBLE / clean END AS rate FROM g WHERE value <> 'unknown'), dis AS (SELECT attribute, CASE WHEN count(rate) >= 2 AND min(rate) > 0 THEN max(rate) / min(rate) <= 1.25 END AS within FROM rt GROUP BY 1),
  n AS (SELECT coalesce(affiliation, 'unknown') AS x, flagged AS y, count(*) AS n FROM cohorts GROUP BY 1, 2), a AS (SELECT x, sum(n) AS nx FROM n GROUP BY 1), b AS (SELECT y, sum(n) AS ny FROM n GROUP BY 1), t AS (SELECT sum(n) AS t FROM n),
  e AS (SELECT coalesce(n, 0) AS o, nx::DOUBLE * ny / t AS e, t FROM a CROSS JOIN b CROSS JOIN t LEFT JOIN n USING (x, y)), v AS (SELECT sqrt(sum((o - e) * (o - e) / e) / (max(t) * (least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) - 1))) AS v FROM e),
  aff AS (SELECT (SELECT avg((affiliation IS NULL)::INT::DOUBLE) FROM cohorts) AS unknown_share, v, (SELECT within FROM dis WHERE attribute = 'affiliation') AS within FROM v),
  verdict AS (SELECT unknown_share, v, CASE WHEN NOT within THEN false WHEN unknown_share > 0.2 OR v >= 0.2 THEN NULL ELSE within END AS acceptable FROM aff)"""


def _fairness(spark, sf_dir):
    rows = cohorts(spark, sf_dir)
    disparity = fairness.disparity(fairness.groups(rows, ("district", "recipient_type", "size_band", "affiliation")))
    return service.affiliation_verdict(rows, disparity, fairness.cramers_v(rows, "affiliation", "flagged")), disparity


@query(f"{_FAIR} SELECT {_m('unknown_share', 'unknown_share')}, floor(v * 1e4 + 0.5)::BIGINT AS association, acceptable FROM verdict")
def affiliation_verdict(spark, sf_dir):
    out, _ = _fairness(spark, sf_dir)
    return out.select(micro(F.col("unknown_share")).alias("unknown_share"), F.floor(F.col("association") * F.lit(1e4) + F.lit(0.5)).cast("long").alias("association"), "acceptable")


@query(f"{_FAIR}, all_of AS (SELECT within FROM dis WHERE attribute <> 'affiliation' UNION ALL SELECT acceptable FROM verdict) SELECT CASE WHEN count(*) FILTER (NOT within) > 0 THEN false WHEN count(within) = 4 THEN true END AS passed FROM all_of")
def fairness_verdict(spark, sf_dir):
    return service.fairness_passed(*_fairness(spark, sf_dir))


@query(f"WITH {LEDGER}, {dims.CONTEXTS} SELECT donation_id, limit_idr::BIGINT AS limit_idr FROM ctx")
def limits_by_rules(spark, sf_dir):
    """The limit of each transfer, read from the rule catalogue and not from a table of limits."""
    table = dims.limits_from_rules(rules.catalogue(spark))
    return dims.contexts(ledger(spark, sf_dir), dims.calendar(spark), table).select("donation_id", "limit_idr")


@query(f"""WITH {LEDGER}, moved AS (SELECT donation_id, occurred_at + to_days(7300) AS later FROM ledger) SELECT donation_id, CASE WHEN later::DATE >= DATE '2017-08-16' THEN {len(rules.RULES)} WHEN later::DATE >= DATE '2011-01-01' THEN {sum(r.since == '2011-01-01' for r in rules.RULES)} END::BIGINT AS rules
  FROM moved WHERE later::DATE >= DATE '2011-01-01'""")
def rules_in_force(spark, sf_dir):
    """How many rules were effective on the day of each transfer, twenty years on."""
    later = ledger(spark, sf_dir).select("donation_id", F.timestamp_add("DAY", F.lit(7300), F.col("occurred_at")).alias("occurred_at"))
    return dims.in_force(later, rules.catalogue(spark)).groupBy("donation_id").agg(F.count(F.lit(1)).alias("rules"))


@query(f"{VERDICTS} SELECT donation_id, rule_id, CASE WHEN outcome = 'INDETERMINATE' THEN rule_id || ' <amount?> could not be evaluated' ELSE rule_id || ' saw Rp' || replace(format('{{:,}}', amount_idr), ',', '.') || ' (' || outcome || ')' END AS statement FROM verdicts JOIN ledger USING (donation_id)")
def rule_statements(spark, sf_dir):
    """A statement of each verdict from its template; what is not known stays visible."""
    from hindcast.functions.text import rupiah, template

    long = long_table(spark, sf_dir).select("donation_id", "rule_id", "outcome").join(ledger(spark, sf_dir).select("donation_id", "amount_idr"), "donation_id")
    known = template("{rule} saw {amount} ({outcome})", {"rule": F.col("rule_id"), "amount": rupiah(F.col("amount_idr")), "outcome": F.col("outcome")})
    unknown = template("{rule} {amount} could not be evaluated", {"rule": F.col("rule_id"), "amount": F.lit(None).cast("string")})
    return long.select("donation_id", "rule_id", F.when(F.col("outcome") == "INDETERMINATE", unknown).otherwise(known).alias("statement"))
