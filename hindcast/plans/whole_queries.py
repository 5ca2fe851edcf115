"""Queries that put whole parts together: explanations, alert runs of all kinds, recall of every typology, cut-offs, calibration, round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hindcast.functions.stats import micro
from hindcast.operators import evaluate, explain, graph, learn, monitor, rules, scoring, service, typology
from hindcast.sources import ledger as src
from hindcast.sources import scratch
from hindcast.sources.ledger import GRAPH, LEDGER, graph_ledger, ledger

from .group_queries import _CHAINS, _FAN_OUT, GNOW, _fan_in_sql
from .measure_queries import _SCORES, SCORED, _m, lanes, scored
from .registry import ORACLES, QUERIES, query
from .ruling import VERDICTS, long_table


def _said(r: rules.Rule) -> str:
    """A rule's sentence as SQL."""
    money = lambda x: f"'Rp' || replace(format('{{:,}}', {x}), ',', '.')"
    values = {
        "amount": money("amount_idr"), "date": "strftime(occurred_at, '%Y-%m-%d')", "sender": "coalesce(sender_id::VARCHAR, '<sender?>')", "receiver": "coalesce(receiver_id::VARCHAR, '<receiver?>')",
        "threshold": "'<threshold?>'" if r.threshold is None else money(f"{r.threshold}::BIGINT"),
    }
    text = f"'{r.id}: {explain.SENTENCES[r.kind]}'"
    for k, v in values.items():
        text = text.replace(f"{{{k}}}", f"' || {v} || '")
    return f"'{explain.DEMONSTRATION}' || {text}" if r.kind in explain.REFERENCE_KINDS else text


@query(
    f"""{VERDICTS} SELECT donation_id, rule_id, CASE {' '.join(f"WHEN rule_id = '{r.id}' THEN {_said(r)}" for r in rules.RULES)} END AS statement
    FROM verdicts JOIN ledger USING (donation_id) WHERE outcome IN ('LEGAL_FINDING', 'BEHAVIOURAL_SIGNAL')"""
)
def rule_explanations(spark, sf_dir):
    """What every fired rule says about its transfer."""
    return explain.explained(long_table(spark, sf_dir), ledger(spark, sf_dir))


ALERT_RUNS = ("2024-01-15", GNOW)


def _runs_sql() -> str:
    runs = []
    for at in ALERT_RUNS:
        chains = _CHAINS.replace(GNOW, at)
        runs.append(
            f"""SELECT TIMESTAMP '{at}' AS detected_at, 'in' AS side, focus, 1 AS n, score FROM (WITH {_fan_in_sql('graph_ledger', at, 8, None)} SELECT focus, score FROM fi) UNION ALL
            SELECT TIMESTAMP '{at}', 'out', focus, 1, score FROM (WITH {_FAN_OUT.replace(GNOW, at)} SELECT focus, score FROM fo) UNION ALL SELECT TIMESTAMP '{at}', 'out', focus, count(*), max(score) FROM ({chains}) GROUP BY focus"""
        )
    return " UNION ALL ".join(runs)


@query(
    f"""WITH {GRAPH}, a AS (SELECT detected_at, side, focus, sum(n) AS n, max(score) AS score FROM ({_runs_sql()}) GROUP BY ALL),
    s AS (SELECT donation_id, sender_id, receiver_id, CASE WHEN occurred_at >= TIMESTAMP '{ALERT_RUNS[1]}' THEN TIMESTAMP '{ALERT_RUNS[1]}' WHEN occurred_at >= TIMESTAMP '{ALERT_RUNS[0]}' THEN TIMESTAMP '{ALERT_RUNS[0]}' END AS run FROM graph_ledger)
    SELECT donation_id, run::DATE AS detected_on, coalesce(sum(n), 0)::BIGINT AS alerts, max(score) AS score FROM s LEFT JOIN a ON detected_at = run AND focus = CASE WHEN side = 'in' THEN receiver_id ELSE sender_id END GROUP BY 1, 2"""
)
def alert_runs(spark, sf_dir):
    """Fan-in, fan-out and chains detected twice; each transfer adopts those about its receiver or sender of the run before it, with the best score."""
    led = graph_ledger(spark, sf_dir)
    slim = lambda df: df.select("kind", "focus", "score")
    every = service.versioned(lambda at: slim(graph.fan_in(led, at)).unionByName(slim(graph.fan_out(led, at))).unionByName(slim(graph.chains(led, at))), ALERT_RUNS)
    # chains outnumber transfers by far: what is written is their number and best score by focus and run
    found = scratch.written(every.groupBy("kind", "focus", "detected_at").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score")), "alerts")
    into = service.adopted(led, found.where("kind = 'fan_in_burst'"), ALERT_RUNS, "receiver_id")
    out = service.adopted(led, found.where("kind <> 'fan_in_burst'"), ALERT_RUNS, "sender_id").select("donation_id", F.col("alerts").alias("more"), F.col("score").alias("other"))
    return into.join(out, "donation_id").select("donation_id", F.to_date("detected_at").alias("detected_on"), (F.col("alerts") + F.col("more")).alias("alerts"), F.greatest("score", "other").alias("score"))


#: Each typology, the query of its detector and the ledger it reads.
TYPOLOGIES = {
    "smurfing": "typ_smurfing", "proxies": "typ_proxies", "structuring": "typ_structuring", "cumulative": "typ_cumulative", "prohibited source": "typ_prohibited_source",
    "foreign": "typ_foreign", "self-funded": "typ_self_funded", "unreported": "typ_unreported",
}


def _recalls_sql() -> str:
    found = " UNION ALL ".join(f"SELECT '{t}' AS typology, donation_id FROM ({ORACLES[q]}) q" for t, q in TYPOLOGIES.items())
    names = ", ".join(f"'{t}'" for t in TYPOLOGIES)
    return f"""WITH {LEDGER}, f AS (SELECT DISTINCT * FROM ({found})), truth AS (SELECT typology, donation_id FROM f WHERE donation_id % 2 = 0 UNION SELECT typology, donation_id FROM ledger, (SELECT unnest([{names}]) AS typology) WHERE donation_id % 997 = 0)
      SELECT typology, count(*) AS planted, count(f.donation_id) AS found, count(f.donation_id) >= 0.8::DOUBLE * count(*) AS passes FROM truth LEFT JOIN f USING (typology, donation_id) GROUP BY 1"""


@query(_recalls_sql())
def typology_recalls(spark, sf_dir):
    """Recall of all eight detectors against a truth table: half of what each finds, and rows that none was made to find."""
    every = None
    for t, q in TYPOLOGIES.items():
        rows = QUERIES[q](spark, sf_dir).select(F.lit(t).alias("typology"), "donation_id")
        every = rows if every is None else every.unionByName(rows)
    found = scratch.written(every.distinct(), "found")
    others = ledger(spark, sf_dir).where("donation_id % 997 = 0").select(F.explode(F.array(*map(F.lit, TYPOLOGIES))).alias("typology"), "donation_id")
    truth = found.where("donation_id % 2 = 0").unionByName(others).distinct()
    return typology.recall(truth, found)


@query(f"WITH {SCORED}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS s, avg(confirmed::INT::DOUBLE) AS r FROM scored GROUP BY 1) SELECT floor(sum(n * abs(s - r)) / sum(n) * 1e4 + 0.5)::BIGINT AS error FROM b")
def calibration_error(spark, sf_dir):
    return evaluate.calibration_error(evaluate.calibration(scored(spark, sf_dir))).select(F.floor(F.col("error") * F.lit(1e4) + F.lit(0.5)).cast("long").alias("error"))


@query(f"WITH {SCORED} SELECT {_m('quantile_cont(score, 0.97)', 'cutoff')} FROM scored")
def anomaly_cutoff(spark, sf_dir):
    """The score that 97 of 100 rows stay below."""
    return learn.anomaly_cutoff(scored(spark, sf_dir).select(F.col("score").alias("anomaly"))).select(micro(F.col("cutoff")).alias("cutoff"))


@query(
    f"""{_SCORES} SELECT count(*) FILTER (score < 25) AS low, count(*) FILTER (score >= 25 AND score < 50) AS moderate, count(*) FILTER (score >= 50 AND score < 75) AS high, count(*) FILTER (score >= 75) AS critical,
    1000000::BIGINT AS degraded_share, {_m('count(*) FILTER (score >= 50) / 100.0::DOUBLE', 'budget_use')} FROM scores"""
)
def score_bands(spark, sf_dir):
    """Rows per band, the degraded share and the use of a budget of a hundred."""
    out = monitor.score_health(scoring.composed(lanes(spark, sf_dir)), 100)
    return out.withColumns({c: micro(F.col(c)) for c in ("degraded_share", "budget_use")})


@query(f"WITH {LEDGER} SELECT occurred_at::DATE AS day, count(*) AS transfers, sum(amount_idr)::BIGINT AS total_idr FROM ledger GROUP BY 1")
def ledger_round_trip(spark, sf_dir):
    """The ledger written by day and read back: what each day's folder holds."""
    led = ledger(spark, sf_dir)
    path = f"{scratch.shared_dir(spark)}/by-day-{uuid.uuid4().hex}"
    src.write_by_day(led.repartition(F.to_date("occurred_at")), path)
    back = src.read_ledger(spark, path)
    return back.groupBy("day").agg(F.count(F.lit(1)).alias("transfers"), F.sum("amount_idr").alias("total_idr"))
