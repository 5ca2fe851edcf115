"""Queries over group alerts, degrees and typologies."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions.stats import micro
from hindcast.operators import dims, graph, refdata, typology
from hindcast.sources import ledger as src
from hindcast.sources import reference as ref
from hindcast.sources import scratch
from hindcast.sources.ledger import ENTITIES, GRAPH, LEDGER, graph_ledger, ledger

from .point_in_time import MATCH, contexts
from .registry import query

NOW, GNOW = "1998-06-30", "2024-01-31"
_CTX = f"WITH {LEDGER}, {dims.CONTEXTS}"


def _id(kind: str, focus: str, ids: str) -> str:
    return f"'cluster:' || substr(sha256('{kind}|' || {focus} || '|' || string_agg({ids}::VARCHAR, '|' ORDER BY {ids}::VARCHAR)), 1, 16)"


def _at(day: str):
    return F.lit(day).cast("timestamp")


_MEAN = "(total_idr::DOUBLE / donations)"
_CV = f"CASE WHEN donations >= 2 THEN sqrt(greatest(sq::DOUBLE / donations - {_MEAN} * {_MEAN}, 0.0)) / {_MEAN} END"


def _fan_in_sql(table: str, now: str, least: int, limit: int | None) -> str:
    """Groups of the window with everything their score reads."""
    near = "0.0::DOUBLE" if limit is None else f"avg((amount_idr >= {0.85 * limit} AND amount_idr < {limit})::INT::DOUBLE)"
    return f"""known AS (SELECT * FROM {table} WHERE occurred_at <= TIMESTAMP '{now}' AND recorded_at <= TIMESTAMP '{now}'), r AS (SELECT * FROM known WHERE occurred_at >= TIMESTAMP '{now}' - INTERVAL 14 DAY AND receiver_id IS NOT NULL),
  old AS (SELECT DISTINCT sender_id FROM known WHERE occurred_at < TIMESTAMP '{now}' - INTERVAL 14 DAY),
  g0 AS (SELECT receiver_id::VARCHAR AS focus, {_id('fan_in_burst', 'receiver_id', 'donation_id')} AS alert_id, count(DISTINCT r.sender_id) AS distinct_donors, count(*) AS donations, sum(amount_idr)::BIGINT AS total_idr, sum(amount_idr::HUGEINT * amount_idr) AS sq,
    count(DISTINCT r.sender_id) FILTER (old.sender_id IS NULL)::DOUBLE AS thin, {near} AS near FROM r LEFT JOIN old ON old.sender_id = r.sender_id GROUP BY receiver_id),
  g1 AS (SELECT *, (SELECT floor(median(distinct_donors)) FROM g0)::BIGINT AS baseline, {_CV} AS cv FROM g0),
  fi AS (SELECT *, round_even(100 * (0.20::DOUBLE * least(distinct_donors::DOUBLE / greatest(4 * baseline, 8), 1.0) + 0.30::DOUBLE * (thin / distinct_donors) + 0.30::DOUBLE * coalesce(greatest(0.0, 1 - least(cv / 0.5::DOUBLE, 1.0)), 0.0) + 0.20::DOUBLE * near), 0)::BIGINT AS score FROM g1 WHERE distinct_donors >= {least})"""


@query(f"WITH {LEDGER}, {_fan_in_sql('ledger', NOW, 4, 200_000_000)} SELECT alert_id, focus, distinct_donors, donations, floor(thin / distinct_donors * 1e6 + 0.5)::BIGINT AS thinness, total_idr, baseline, score FROM fi")
def alerts_fan_in(spark, sf_dir):
    out = graph.fan_in(ledger(spark, sf_dir), _at(NOW), min_donors=4, limit=200_000_000)
    return out.select("alert_id", "focus", "distinct_donors", "donations", micro(F.col("thinness")).alias("thinness"), "total_idr", "baseline", "score")


_FAN_OUT = f"""fo0 AS (SELECT sender_id AS focus, {_id('fan_out', 'sender_id', 'donation_id')} AS alert_id, count(DISTINCT receiver_id) AS distinct_recipients, count(*) AS donations, sum(amount_idr)::BIGINT AS total_idr, sum(amount_idr::HUGEINT * amount_idr) AS sq
    FROM graph_ledger WHERE occurred_at <= TIMESTAMP '{GNOW}' AND occurred_at >= TIMESTAMP '{GNOW}' - INTERVAL 14 DAY GROUP BY sender_id HAVING count(DISTINCT receiver_id) >= 6),
  fo1 AS (SELECT *, round_even(greatest(0.0, 1 - least(({_CV}) / 0.5::DOUBLE, 1.0)), 4) AS regularity FROM fo0),
  fo AS (SELECT *, round_even(100 * (0.5::DOUBLE * least(distinct_recipients / 12.0::DOUBLE, 1.0) + 0.5::DOUBLE * coalesce(regularity, 0.0)), 0)::BIGINT AS score FROM fo1)"""


@query(f"WITH {GRAPH}, {_FAN_OUT} SELECT alert_id, focus, distinct_recipients, donations, total_idr, floor(regularity * 1e4 + 0.5)::BIGINT AS regularity, score FROM fo")
def alerts_fan_out(spark, sf_dir):
    out = graph.fan_out(graph_ledger(spark, sf_dir), _at(GNOW))
    return out.select("alert_id", "focus", "distinct_recipients", "donations", "total_idr", F.floor(F.col("regularity") * F.lit(1e4) + F.lit(0.5)).cast("long").alias("regularity"), "score")


_HOP = "{b}.sender_id = {a}.receiver_id AND {b}.occurred_at >= {a}.occurred_at AND {b}.occurred_at <= {a}.occurred_at + INTERVAL 14 DAY AND {b}.amount_idr >= {a}.amount_idr * 0.6::DOUBLE"
_CHAINS = f"""WITH {GRAPH}, r AS (SELECT * FROM graph_ledger WHERE occurred_at <= TIMESTAMP '{GNOW}' AND occurred_at >= TIMESTAMP '{GNOW}' - INTERVAL 14 DAY),
  c3 AS (SELECT a.sender_id AS focus, a.receiver_id AS n1, b.receiver_id AS n2, c.receiver_id AS head, a.donation_id AS i1, b.donation_id AS i2, c.donation_id AS i3, c.occurred_at AS at, c.amount_idr AS amount, a.amount_idr AS origin FROM r a JOIN r b ON {_HOP.format(a='a', b='b')} AND b.receiver_id NOT IN (a.sender_id, a.receiver_id)
    JOIN r c ON {_HOP.format(a='b', b='c')} AND c.receiver_id NOT IN (a.sender_id, a.receiver_id, b.receiver_id)),
  c4 AS (SELECT c3.*, d.donation_id AS i4, d.amount_idr AS last FROM c3 JOIN r d ON d.sender_id = c3.head AND d.occurred_at >= c3.at AND d.occurred_at <= c3.at + INTERVAL 14 DAY AND d.amount_idr >= c3.amount * 0.6::DOUBLE AND d.receiver_id NOT IN (focus, n1, n2, head)),
  p AS (SELECT focus, [i1, i2, i3] AS ids, origin, amount AS last FROM c3 UNION ALL SELECT focus, [i1, i2, i3, i4], origin, last FROM c4)
  SELECT 'cluster:' || substr(sha256('layering_chain|' || focus || '|' || array_to_string(list_sort(list_transform(ids, lambda x: x::VARCHAR)), '|')), 1, 16) AS alert_id, focus, len(ids)::INTEGER AS hops, origin AS origin_idr, last AS terminal_idr,
    round_even(100 * (0.6::DOUBLE * least((len(ids) - 2) / 2.0::DOUBLE, 1.0) + 0.4::DOUBLE * coalesce(least(last::DOUBLE / nullif(origin, 0), 1.0), 0.0)) * 0.7::DOUBLE, 0)::BIGINT AS score FROM p"""


@query(_CHAINS)
def alerts_chains(spark, sf_dir):
    return graph.chains(graph_ledger(spark, sf_dir), _at(GNOW)).select("alert_id", "focus", "hops", "origin_idr", "terminal_idr", "score")


@query(f"{_CHAINS.rsplit('SELECT', 1)[0]} SELECT id::VARCHAR AS donation_id, count(*) AS chains FROM (SELECT unnest(ids) AS id FROM p) GROUP BY 1")
def alert_membership(spark, sf_dir):
    """In how many chains a transfer lies, counted without listing them."""
    return graph.chain_counts(graph_ledger(spark, sf_dir), _at(GNOW)).withColumn("donation_id", F.col("donation_id").cast("string"))


@query(
    f"""WITH {GRAPH}, {_fan_in_sql('graph_ledger', GNOW, 8, None)}, {_FAN_OUT}, ch AS ({_CHAINS}) SELECT alert_id, 'fan_in_burst' AS kind, focus, score, donations AS transfers FROM fi
    UNION ALL SELECT alert_id, 'fan_out', focus, score, donations FROM fo UNION ALL SELECT alert_id, 'layering_chain', focus, score, hops FROM ch"""
)
def alerts_all(spark, sf_dir):
    led = graph_ledger(spark, sf_dir)
    every = graph.all_alerts(graph.fan_in(led, _at(GNOW)), graph.fan_out(led, _at(GNOW)), graph.chains(led, _at(GNOW)))
    return every.select("alert_id", "kind", "focus", "score", F.size("members").cast("long").alias("transfers"))


@query(
    f"""WITH {LEDGER}, e AS (SELECT sender_id AS node, receiver_id AS other, amount_idr AS gave, 0 AS got FROM ledger WHERE receiver_id IS NOT NULL UNION ALL SELECT receiver_id, sender_id, 0, amount_idr FROM ledger WHERE receiver_id IS NOT NULL)
    SELECT node, count(DISTINCT other) AS neighbours, count(*) AS transfers, sum(gave)::BIGINT AS gave, sum(got)::BIGINT AS got FROM e GROUP BY 1"""
)
def node_degrees(spark, sf_dir):
    return graph.degrees(ledger(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {GRAPH}, e AS (SELECT u, v, min(known) AS since FROM (SELECT sender_id AS u, receiver_id AS v, recorded_at AS known FROM graph_ledger UNION ALL SELECT receiver_id, sender_id, recorded_at FROM graph_ledger) WHERE u <> v GROUP BY 1, 2),
    c AS (SELECT u, min(since) FILTER (k = 26) AS closes FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY since) AS k FROM e) GROUP BY 1),
    r(id, t, node) AS (SELECT donation_id, occurred_at, unnest([sender_id, receiver_id]) FROM graph_ledger UNION SELECT r.id, r.t, e.v FROM r JOIN c ON c.u = r.node AND (closes IS NULL OR r.t < closes) JOIN e ON e.u = r.node AND since <= r.t)
    SELECT id AS donation_id, least(count(*), 200)::BIGINT AS size FROM r GROUP BY 1"""
)
def local_cluster(spark, sf_dir):
    """Cluster sizes of every transfer of the graph ledger."""
    led = graph_ledger(spark, sf_dir)
    return graph.local_clusters(led, led, cut=lambda df: scratch.written(df, "clusters"))


@query(
    f"""WITH {LEDGER}, f AS (SELECT * FROM (SELECT *, min(occurred_at) OVER (PARTITION BY sender_id, receiver_id) AS m FROM ledger WHERE receiver_id IS NOT NULL) WHERE occurred_at = m AND amount_idr < 150000000),
    w AS (SELECT a.donation_id AS anchor, h.sender_id, h.amount_idr FROM f a JOIN f h ON h.receiver_id = a.receiver_id AND h.occurred_at BETWEEN a.occurred_at AND a.occurred_at + INTERVAL 7 DAY),
    g AS (SELECT x.anchor, x.amount_idr, count(DISTINCT y.sender_id) AS n FROM w x JOIN w y ON y.anchor = x.anchor AND y.amount_idr BETWEEN x.amount_idr AND x.amount_idr * 1.15::DOUBLE GROUP BY x.anchor, x.amount_idr)
    SELECT anchor AS donation_id, max(n)::INTEGER AS donors FROM g GROUP BY 1 HAVING max(n) >= 2"""
)
def typ_smurfing(spark, sf_dir):
    return typology.smurfing(ledger(spark, sf_dir), 150_000_000, min_donors=2)


@query(f"""WITH {GRAPH}, p AS (SELECT a.donation_id AS x, b.donation_id AS y FROM graph_ledger a JOIN graph_ledger b ON b.receiver_id = a.sender_id AND b.donation_id <> a.donation_id AND b.occurred_at <= a.occurred_at
  AND b.occurred_at >= a.occurred_at - INTERVAL 7 DAY AND a.amount_idr::DOUBLE / b.amount_idr BETWEEN 0.85 AND 1.15) SELECT x AS donation_id FROM p UNION SELECT y FROM p""")
def typ_proxies(spark, sf_dir):
    return typology.proxies(graph_ledger(spark, sf_dir))


@query(f"{_CTX} SELECT donation_id FROM ctx WHERE amount_idr::DOUBLE / limit_idr BETWEEN 0.9 AND 0.999")
def typ_structuring(spark, sf_dir):
    return typology.structuring(contexts(spark, sf_dir))


@query(f"{_CTX} SELECT donation_id FROM (SELECT *, sum(amount_idr) OVER (PARTITION BY sender_id, receiver_id) AS t FROM ctx WHERE receiver_id IS NOT NULL AND limit_idr IS NOT NULL) WHERE t > limit_idr")
def typ_cumulative(spark, sf_dir):
    return typology.cumulative(contexts(spark, sf_dir))


@query(f"WITH {LEDGER}, {ref.ENTRIES} SELECT donation_id FROM ledger WHERE sender_id IN (SELECT entity_id FROM entries WHERE entity_id IS NOT NULL)")
def typ_prohibited_source(spark, sf_dir):
    return typology.listed(ledger(spark, sf_dir), ref.register_entries(spark, sf_dir), "prohibited_source")


@query(f"WITH {LEDGER}, {ENTITIES} SELECT donation_id FROM ledger WHERE sender_id IN (SELECT entity_id FROM entities WHERE jurisdiction <> 'ID')")
def typ_foreign(spark, sf_dir):
    return typology.foreign(ledger(spark, sf_dir), src.entities(spark, sf_dir))


@query(f"""WITH {LEDGER} SELECT p.donation_id FROM ledger p JOIN ledger h ON h.receiver_id = p.sender_id AND h.donation_id <> p.donation_id AND h.occurred_at BETWEEN p.occurred_at - INTERVAL 30 DAY AND p.occurred_at
  WHERE p.is_self_funded_declared GROUP BY p.donation_id, p.amount_idr HAVING sum(h.amount_idr) >= p.amount_idr * 0.5::DOUBLE""")
def typ_self_funded(spark, sf_dir):
    return typology.self_funded(ledger(spark, sf_dir))


@query(f"WITH {LEDGER}, {ref.FILINGS} SELECT donation_id FROM ledger p WHERE electoral_context = 'ctx-1998' AND occurred_at::DATE BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND NOT EXISTS (SELECT 1 FROM filings f WHERE {MATCH})")
def typ_unreported(spark, sf_dir):
    return refdata.reconcile(ledger(spark, sf_dir), ref.filings(spark, sf_dir), ref.filing_periods(spark)).where("not declared").select("donation_id")


@query(f"""{_CTX}, t AS (SELECT donation_id FROM ctx WHERE amount_idr::DOUBLE / limit_idr >= 0.85 AND amount_idr <= limit_idr) SELECT 'structuring' AS typology, count(*) AS planted, count(*) FILTER (f) AS found, count(*) FILTER (f) >= 0.8::DOUBLE * count(*) AS passes
  FROM (SELECT donation_id, amount_idr::DOUBLE / limit_idr BETWEEN 0.9 AND 0.999 AS f FROM ctx JOIN t USING (donation_id)) HAVING count(*) > 0""")
def typology_recall(spark, sf_dir):
    ctx = contexts(spark, sf_dir)
    tag = lambda df: df.select(F.lit("structuring").alias("typology"), "donation_id")
    truth = tag(ctx.where((F.col("amount_idr").cast("double") / F.col("limit_idr") >= 0.85) & (F.col("amount_idr") <= F.col("limit_idr"))))
    return typology.recall(truth, tag(typology.structuring(ctx)))
