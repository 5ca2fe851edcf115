"""Queries over scores, evaluation, fairness and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.stats import micro
from hindcast.operators import evaluate, fairness, monitor, scoring
from hindcast.sources import scratch
from hindcast.sources.ledger import LEDGER, ledger

from .registry import query
from .ruling import VERDICTS, long_table


def _m(x: str, name: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5)::BIGINT AS {name}"


def scored(spark, sf_dir):
    """The ledger with a stand-in score, truth and flag."""
    price = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("donation_id"), (F.col("o_totalprice") / F.lit(500000.0)).alias("score"))
    k = F.col("donation_id")
    return ledger(spark, sf_dir).join(price, "donation_id").select("*", (k % 37 == 0).alias("confirmed"), (F.col("amount_idr") > 200_000_000).alias("rule_flagged"), (k % 3 == 0).alias("reviewed"))


SCORED = f"{LEDGER}, scored AS (SELECT l.*, o_totalprice / 500000.0::DOUBLE AS score, donation_id % 37 = 0 AS confirmed, amount_idr > 200000000 AS rule_flagged, donation_id % 3 = 0 AS reviewed FROM ledger l JOIN orders ON o_orderkey = donation_id)"


@query(
    f"""WITH {SCORED}, t AS (SELECT * FROM scored ORDER BY score DESC, occurred_at, donation_id LIMIT 100), b AS (SELECT * FROM scored WHERE rule_flagged ORDER BY occurred_at, donation_id LIMIT 100)
    SELECT (SELECT count(*) FROM t WHERE confirmed) AS hits, (SELECT count(*) FROM t WHERE confirmed AND NOT rule_flagged) AS novel, (SELECT count(*) FROM b WHERE confirmed) AS base, (SELECT count(*) FROM scored WHERE confirmed) AS positives,
    {_m("(SELECT count(*) FROM t WHERE confirmed)::DOUBLE / (SELECT count(*) FROM t)", "precision")}, {_m("(SELECT count(*) FROM t WHERE confirmed)::DOUBLE / (SELECT count(*) FROM scored WHERE confirmed)", "recall")}"""
)
def precision_recall_lift(spark, sf_dir):
    return evaluate.at_budget(scored(spark, sf_dir), 100).select("hits", "novel", "base", "positives", micro(F.col("precision")).alias("precision"), micro(F.col("recall")).alias("recall"))


@query(f"WITH {SCORED}, r AS (SELECT confirmed, row_number() OVER (ORDER BY score DESC, occurred_at, donation_id) AS k FROM scored), h AS (SELECT k, row_number() OVER (ORDER BY k) AS n FROM r WHERE confirmed) SELECT count(*) AS positives, {_m('avg(n::DOUBLE / k)', 'average_precision')} FROM h")
def average_precision(spark, sf_dir):
    return evaluate.average_precision(scored(spark, sf_dir)).select("positives", micro(F.col("average_precision")).alias("average_precision"))


@query(f"WITH {SCORED} SELECT least(floor(score * 10), 9)::BIGINT AS bin, count(*) AS rows, {_m('avg(confirmed::INT::DOUBLE)', 'rate')} FROM scored GROUP BY 1")
def calibration(spark, sf_dir):
    return evaluate.calibration(scored(spark, sf_dir)).select("bin", "rows", micro(F.col("rate")).alias("rate"))


@query(
    f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (confirmed) AS p, count(*) FILTER (NOT confirmed) AS n FROM scored), s AS (SELECT score, count(*) FILTER (confirmed) AS pos, count(*) FILTER (NOT confirmed) AS neg FROM scored GROUP BY 1),
    q AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tn FROM s)
    SELECT {_m("CASE WHEN p = 0 OR n = 0 THEN 0.5 ELSE coalesce((SELECT score FROM q WHERE tn >= 0.7::DOUBLE * n ORDER BY tp DESC, score LIMIT 1), 1.0) END", "threshold")} FROM c"""
)
def threshold_choice(spark, sf_dir):
    return evaluate.threshold_choice(scored(spark, sf_dir)).select(micro(F.col("threshold")).alias("threshold"))


@query(f"WITH {LEDGER} SELECT quantile_disc(amount_idr, 0.5) AS p50, quantile_disc(amount_idr, 0.95) AS p95, quantile_disc(amount_idr, 0.99) AS p99 FROM ledger")
def nearest_rank(spark, sf_dir):
    return evaluate.nearest_rank(ledger(spark, sf_dir), "amount_idr", (0.5, 0.95, 0.99))


_SPLIT = f"""WITH {LEDGER}, d AS (SELECT sender_id, row_number() OVER (ORDER BY min(occurred_at), sender_id) AS k, count(*) OVER () AS n FROM ledger GROUP BY sender_id),
  split AS (SELECT donation_id, l.sender_id, occurred_at, CASE WHEN k <= floor(n * 0.6) THEN 'train' WHEN k <= floor(n * 0.75) THEN 'calibration' ELSE 'test' END AS split FROM ledger l JOIN d USING (sender_id))"""


@query(f"{_SPLIT} SELECT donation_id, split FROM split")
def cohort_split(spark, sf_dir):
    return evaluate.cohort_split(ledger(spark, sf_dir)).select("donation_id", "split")


@query(f"{_SPLIT} SELECT split, count(*) AS rows, count(DISTINCT sender_id) AS donors, min(occurred_at)::DATE AS first, max(occurred_at)::DATE AS last FROM split GROUP BY 1")
def split_summary(spark, sf_dir):
    return evaluate.split_summary(evaluate.cohort_split(ledger(spark, sf_dir))).withColumns({c: F.to_date(c) for c in ("first", "last")})


@query(f"{_SPLIT} SELECT sender_id, count(DISTINCT split) AS n FROM split GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leakage_check(spark, sf_dir):
    return evaluate.leaks(evaluate.cohort_split(ledger(spark, sf_dir)))


_AUDIT = f"""WITH {SCORED}, u AS (SELECT *, row_number() OVER (ORDER BY sha256('2026-07|' || donation_id)) AS k, count(*) OVER () AS n FROM scored WHERE NOT rule_flagged), a AS (SELECT * FROM u WHERE k <= least(n, greatest(50, round_even(0.02 * n, 0))))"""


@query(f"{_AUDIT} SELECT donation_id FROM a")
def audit_sample(spark, sf_dir):
    return evaluate.audit_sample(scored(spark, sf_dir).where("not rule_flagged"), "2026-07").select("donation_id")


@query(f"{_AUDIT}, f AS (SELECT count(*) FILTER (rule_flagged AND confirmed) AS found, count(*) FILTER (NOT rule_flagged) AS unflagged FROM scored), s AS (SELECT count(*) AS audited, count(*) FILTER (confirmed) AS missed FROM a) SELECT found, unflagged, audited, missed, {_m('CASE WHEN audited >= 50 THEN found / (found + missed::DOUBLE / audited * unflagged) END', 'recall')} FROM f, s")
def recall_estimate(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return evaluate.estimated_recall(rows, evaluate.audit_sample(rows.where("not rule_flagged"), "2026-07")).select("found", "unflagged", "audited", "missed", micro(F.col("recall")).alias("recall"))


@query(f"WITH {SCORED} SELECT {_m('count(*) FILTER (rule_flagged AND reviewed)::DOUBLE / count(*) FILTER (rule_flagged)', 'flagged_rate')}, {_m('count(*) FILTER (NOT rule_flagged AND reviewed)::DOUBLE / count(*) FILTER (NOT rule_flagged)', 'unflagged_rate')} FROM scored")
def sampling_bias(spark, sf_dir):
    return evaluate.review_bias(scored(spark, sf_dir)).select(micro(F.col("flagged_rate")).alias("flagged_rate"), micro(F.col("unflagged_rate")).alias("unflagged_rate"))


@query(f"WITH {SCORED} SELECT donation_id, CASE WHEN donation_id % 4 > 0 THEN 4.0::DOUBLE / (donation_id % 4) END AS weight FROM scored WHERE reviewed")
def propensity(spark, sf_dir):
    return evaluate.propensity_weights(scored(spark, sf_dir).where("reviewed").withColumn("probability", (F.col("donation_id") % 4) / F.lit(4.0))).select("donation_id", "weight")


ATTRIBUTES = ("district", "recipient_type", "size_band", "affiliation")


def cohorts(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("sender_id"), F.col("c_nationkey").alias("district"))
    return scored(spark, sf_dir).join(nation, "sender_id", "left").select(
        "donation_id", F.col("rule_flagged").alias("flagged"), "reviewed", "confirmed", F.concat(F.lit("p"), F.col("receiver_id") % 4).alias("affiliation"), "district", F.col("receiver_type").alias("recipient_type"), fairness.size_band(F.col("amount_idr")).alias("size_band")
    )


COHORTS = f"""WITH {SCORED}, cohorts AS (SELECT donation_id, rule_flagged AS flagged, reviewed, confirmed, 'p' || (receiver_id % 4) AS affiliation, c_nationkey AS district, receiver_type AS recipient_type,
  CASE WHEN amount_idr < 10000000 THEN 'small' WHEN amount_idr < 200000000 THEN 'medium' WHEN amount_idr < 2500000000 THEN 'large' ELSE 'very-large' END AS size_band FROM scored LEFT JOIN customer ON c_custkey = sender_id),
  long AS (SELECT donation_id, flagged, reviewed, confirmed, unnest(['district', 'recipient_type', 'size_band', 'affiliation']) AS attribute, unnest([coalesce(district::VARCHAR, 'unknown'), coalesce(recipient_type, 'unknown'), size_band, coalesce(affiliation, 'unknown')]) AS value FROM cohorts),
  g AS (SELECT attribute, value, count(*) AS total, count(*) FILTER (flagged) AS n_flagged, count(*) FILTER (reviewed AND NOT confirmed) AS clean, count(*) FILTER (reviewed AND NOT confirmed AND flagged) AS false_flags FROM long GROUP BY 1, 2)"""


@query(f"{COHORTS} SELECT attribute, value, total, n_flagged, clean, false_flags, {_m('CASE WHEN clean >= 30 THEN false_flags::DOUBLE / clean END', 'rate')} FROM g")
def fairness_groups(spark, sf_dir):
    return fairness.groups(cohorts(spark, sf_dir), ATTRIBUTES).select("attribute", "value", "total", "n_flagged", "clean", "false_flags", micro(F.col("rate")).alias("rate"))


@query(f"{COHORTS}, r AS (SELECT attribute, value, CASE WHEN clean >= 30 THEN false_flags::DOUBLE / clean END AS rate FROM g WHERE value <> 'unknown') SELECT attribute, {_m('CASE WHEN count(rate) >= 2 AND min(rate) > 0 THEN max(rate) / min(rate) END', 'ratio')} FROM r GROUP BY 1")
def fairness_disparity(spark, sf_dir):
    return fairness.disparity(fairness.groups(cohorts(spark, sf_dir), ATTRIBUTES)).select("attribute", micro(F.col("ratio")).alias("ratio"))


@query(
    f"""{COHORTS}, n AS (SELECT coalesce(affiliation, 'unknown') AS x, flagged AS y, count(*) AS n FROM cohorts GROUP BY 1, 2), a AS (SELECT x, sum(n) AS nx FROM n GROUP BY 1), b AS (SELECT y, sum(n) AS ny FROM n GROUP BY 1), t AS (SELECT sum(n) AS t FROM n),
    e AS (SELECT coalesce(n, 0) AS o, nx::DOUBLE * ny / t AS e, t FROM a CROSS JOIN b CROSS JOIN t LEFT JOIN n USING (x, y)) SELECT floor(sqrt(sum((o - e) * (o - e) / e) / (max(t) * (least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) - 1))) * 1e4 + 0.5)::BIGINT AS v FROM e"""
)
def cramers_v(spark, sf_dir):
    return fairness.cramers_v(cohorts(spark, sf_dir), "affiliation", "flagged").select(F.floor(F.col("v") * F.lit(1e4) + F.lit(0.5)).cast("long").alias("v"))


def _halves(spark, sf_dir):
    led = ledger(spark, sf_dir)
    numbers = led.select("occurred_at", "amount_idr", "sender_id", "receiver_id", F.datediff("recorded_at", "occurred_at").alias("lag"))
    cols = ["amount_idr", "sender_id", "receiver_id", "lag"]
    cut = F.lit("1998-07-01").cast("timestamp")
    return monitor.long(numbers.where(F.col("occurred_at") < cut), cols), monitor.long(numbers.where(F.col("occurred_at") >= cut), cols)


_PSI = f"""WITH {LEDGER}, n AS (SELECT occurred_at < TIMESTAMP '1998-07-01' AS old, unnest(['amount_idr', 'sender_id', 'receiver_id', 'lag']) AS feature, unnest([amount_idr::DOUBLE, sender_id::DOUBLE, receiver_id::DOUBLE, (recorded_at::DATE - occurred_at::DATE)::DOUBLE]) AS value FROM ledger),
  b AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY feature) AS n FROM n WHERE old AND value IS NOT NULL),
  e AS (SELECT feature, i, value FROM b, range(1, 10) r(i) WHERE k = least((n * i // 10), n - 1)),
  p AS (SELECT old, n.feature, (SELECT count(*) FROM e WHERE e.feature = n.feature AND n.value > e.value) AS bin FROM n WHERE value IS NOT NULL),
  c AS (SELECT feature, bin, greatest(count(*) FILTER (old)::DOUBLE / (SELECT count(*) FROM p q WHERE q.old AND q.feature = p.feature), 1e-6) AS b, greatest(count(*) FILTER (NOT old)::DOUBLE / (SELECT count(*) FROM p q WHERE NOT q.old AND q.feature = p.feature), 1e-6) AS c FROM p GROUP BY feature, bin),
  z AS (SELECT feature, coalesce(b, 1e-6) AS b, coalesce(c, 1e-6) AS c FROM (SELECT DISTINCT feature, bin FROM (SELECT feature FROM (SELECT DISTINCT feature FROM n)) f, range(0, 10) r(bin)) LEFT JOIN c USING (feature, bin)),
  psi AS (SELECT feature, sum((c - b) * ln(c / b)) AS psi FROM z GROUP BY 1)"""


@query(f"{_PSI} SELECT feature, floor(psi * 1e4 + 0.5)::BIGINT AS psi FROM psi")
def psi(spark, sf_dir):
    return monitor.psi(*_halves(spark, sf_dir)).select("feature", F.floor(F.col("psi") * F.lit(1e4) + F.lit(0.5)).cast("long").alias("psi"))


@query(f"{_PSI}, u AS (SELECT feature, avg((value IS NULL)::INT::DOUBLE) FILTER (old) AS was, avg((value IS NULL)::INT::DOUBLE) FILTER (NOT old) AS now FROM n GROUP BY 1) SELECT feature, {_m('was', 'null_before')}, {_m('now', 'null_now')}, CASE WHEN abs(now - was) > 0.1 THEN 'pipeline fault' WHEN psi > 0.25 THEN 'drift' END AS finding FROM u JOIN psi USING (feature)")
def feature_drift(spark, sf_dir):
    return monitor.feature_drift(*_halves(spark, sf_dir)).select("feature", micro(F.col("null_before")).alias("null_before"), micro(F.col("null_now")).alias("null_now"), "finding")


@query(f"{VERDICTS} SELECT rule_id, count(*) FILTER (outcome IN ('PASS', 'LEGAL_FINDING', 'BEHAVIOURAL_SIGNAL')) AS evaluated, count(*) FILTER (outcome = 'INDETERMINATE') AS indeterminate FROM verdicts GROUP BY 1")
def rule_coverage(spark, sf_dir):
    return monitor.rule_coverage(long_table(spark, sf_dir)).select("rule_id", "evaluated", "indeterminate")


@query("""SELECT CASE WHEN doc_id % 5 = 0 THEN 'audit' WHEN doc_id % 5 = 1 THEN 'review' ELSE 'rule' END AS source, count(*) AS labels, count(*) FILTER (doc_id % 10 = 0) AS audited FROM labels GROUP BY 1""")
def label_mix(spark, sf_dir):
    k = F.col("doc_id")
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.when(k % 5 == 0, "audit").when(k % 5 == 1, "review").otherwise("rule").alias("source"), F.when(k % 10 == 0, F.concat(F.lit("audit-sample "), k)).when(k % 3 == 0, "seen").alias("note"))
    return monitor.label_mix(rows)


def _table(spark, sf_dir):
    led = ledger(spark, sf_dir)
    return led.select("donation_id", "amount_idr", (F.col("amount_idr") * 3 + 7).alias("scaled"), F.col("amount_idr").alias("copy"), F.col("sender_id").alias("sender"), F.lit(5).cast("long").alias("fixed"))


@query("SELECT 'fixed' AS \"column\"")
def redundancy_constant(spark, sf_dir):
    return monitor.constant_columns(_table(spark, sf_dir), ["amount_idr", "scaled", "copy", "sender", "fixed"])


@query("SELECT 'amount_idr' AS a, 'copy' AS b")
def redundancy_identical(spark, sf_dir):
    return monitor.identical_columns(_table(spark, sf_dir), "donation_id", ["amount_idr", "scaled", "copy", "sender"])


@query("SELECT * FROM (VALUES ('amount_idr', 'scaled'), ('amount_idr', 'copy'), ('scaled', 'copy')) t(a, b)")
def redundancy_affine(spark, sf_dir):
    return monitor.affine_copies(_table(spark, sf_dir), ["amount_idr", "scaled", "copy", "sender"]).select("a", "b")


def lanes(spark, sf_dir, long=None):
    """The lanes of every transfer from its verdicts (``long``: written before)."""
    if long is None:  # read twice: written once, the rows that the lanes read (each transfer has one of every graph rule)
        long = long_table(spark, sf_dir).where((F.col("outcome") == "LEGAL_FINDING") | F.col("rule_id").isin(*scoring.GRAPH_RULES))
        long = scratch.written(long.select("donation_id", "rule_id", "outcome", "label_weight"), "outcomes")
    rows = scored(spark, sf_dir)
    findings = long.where("outcome = 'LEGAL_FINDING'")
    anomaly = scoring.anomaly_lane(rows.select("donation_id", F.col("score").alias("anomaly")), findings, F.lit(0.5))
    classifier = rows.select("donation_id", F.when(F.col("donation_id") % 11 != 0, F.col("score")).alias("intensity"))
    return scoring.lane_results(rows, {"graph": scoring.graph_lane(long), "classifier": classifier, "anomaly": anomaly})


_LANES = f"""{VERDICTS}, s AS (SELECT donation_id, o_totalprice / 500000.0::DOUBLE AS score FROM ledger JOIN orders ON o_orderkey = donation_id),
  gl AS (SELECT donation_id, least(count(*) FILTER (f) / 3.0::DOUBLE, 1.0) * coalesce(max(weight) FILTER (f), 0.0) / 0.6::DOUBLE AS graph FROM (SELECT *, outcome = 'BEHAVIOURAL_SIGNAL' AND rule_id IN ('RULE-T2-01', 'RULE-T2-03', 'RULE-T2-04', 'RULE-T2-09') AS f FROM verdicts) GROUP BY 1),
  fl AS (SELECT DISTINCT donation_id FROM verdicts WHERE outcome = 'LEGAL_FINDING'),
  i AS (SELECT donation_id, graph, CASE WHEN donation_id % 11 <> 0 THEN score END AS classifier, CASE WHEN fl.donation_id IS NULL THEN CASE WHEN score < 0.5 THEN 0.0 ELSE least((score - 0.5) / 0.5, 1.0) END END AS anomaly FROM s JOIN gl USING (donation_id) LEFT JOIN fl USING (donation_id)),
  lanes AS (SELECT donation_id, unnest(['graph', 'classifier', 'anomaly', 'reputation']) AS lane, unnest([CASE WHEN graph IS NOT NULL THEN round_even(least(greatest(graph, 0), 1) * 50, 0) END, CASE WHEN classifier IS NOT NULL THEN round_even(least(greatest(classifier, 0), 1) * 30, 0) END, CASE WHEN anomaly IS NOT NULL THEN round_even(least(greatest(anomaly, 0), 1) * 15, 0) END, NULL])::BIGINT AS contribution, unnest([50, 30, 15, 5]) AS ceiling FROM i)"""


@query(f"{_LANES} SELECT donation_id, lane, contribution FROM lanes")
def lane_contributions(spark, sf_dir):
    return lanes(spark, sf_dir).select("donation_id", "lane", "contribution")


_SCORES = f"{_LANES}, scores AS (SELECT donation_id, least(coalesce(sum(contribution), 0), 100)::BIGINT AS score, coalesce(sum(ceiling) FILTER (contribution IS NOT NULL), 0)::BIGINT AS attainable FROM lanes GROUP BY 1)"


@query(f"{_SCORES} SELECT *, true AS degraded, CASE WHEN score < 25 THEN 'low' WHEN score < 50 THEN 'moderate' WHEN score < 75 THEN 'high' ELSE 'critical' END AS band FROM scores")
def composed_scores(spark, sf_dir):
    return scoring.composed(lanes(spark, sf_dir)).select("donation_id", "score", "attainable", "degraded", "band")


@query(f"{_SCORES} SELECT donation_id, score FROM scores ORDER BY score DESC, donation_id LIMIT 100")
def review_queue(spark, sf_dir):
    return scoring.queue(scoring.composed(lanes(spark, sf_dir)), 100).select("donation_id", "score")


@query(f"{_SCORES} SELECT donation_id, score FROM scores WHERE score > 0 AND donation_id NOT IN (SELECT donation_id FROM lanes WHERE contribution > 0)")
def unexplained_scores(spark, sf_dir):
    return scoring.unexplained(scoring.composed(lanes(spark, sf_dir))).select("donation_id", "score")


@query(f"{_LANES} SELECT lane, count(contribution) AS ran, count(*) FILTER (contribution IS NULL) AS absent, floor(avg(contribution) * 1e4 + 0.5)::BIGINT AS mean_contribution FROM lanes GROUP BY 1")
def health(spark, sf_dir):
    return monitor.lane_health(lanes(spark, sf_dir)).select("lane", "ran", "absent", F.floor(F.col("mean_contribution") * F.lit(1e4) + F.lit(0.5)).cast("long").alias("mean_contribution"))


def _events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select((F.col("user_id")).alias("donation_id"), F.col("ts").cast("timestamp").alias("scored_at"), F.floor("value").cast("long").alias("score"))


@query("SELECT donation_id, scored_at, score, lag(score) OVER (PARTITION BY donation_id ORDER BY scored_at) AS previous FROM (SELECT user_id AS donation_id, ts AS scored_at, floor(value)::BIGINT AS score FROM events)")
def score_history(spark, sf_dir):
    return scoring.event_history(_events(spark, sf_dir)).withColumn("scored_at", F.col("scored_at").cast("timestamp_ntz"))


@query("SELECT user_id AS donation_id, arg_max(floor(value)::BIGINT, ts) AS score FROM events GROUP BY 1")
def latest_scores(spark, sf_dir):
    return scoring.latest_events(_events(spark, sf_dir)).select("donation_id", "score")
