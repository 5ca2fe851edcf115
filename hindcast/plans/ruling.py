"""Queries over rules: one per kind of test, the verdict table and its roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.operators import dims, facts, refdata, rules
from hindcast.sources import ledger as src
from hindcast.sources import reference as ref
from hindcast.sources.ledger import LEDGER

from .point_in_time import MATCH, contexts
from .registry import query

#: The fixtures are smaller than the populations that the shipped thresholds suit; only the queries use these.
SCALED = {"fan_in_burst": {"min_senders": 5}, "fan_out": {"min_receivers": 3}, "velocity_spike": {"multiple": 2.0}, "amount_homogeneity": {"min_count": 5, "max_cv": 0.5}, "deadline_clustering": {"multiple": 1.5}}
QUERY_RULES = tuple(
    rules.Rule(**{**{f: getattr(r, f) for f in r.__dataclass_fields__}, "params": {**r.params, **SCALED.get(r.kind, {})}, "since": "1990-01-01", "active": True}) for r in rules.RULES
)


def rule_facts(spark, sf_dir, kinds=None) -> DataFrame:
    """Facts of the fixture ledger with the lookups that rules of these kinds read (None: all)."""
    ctx = contexts(spark, sf_dir, keep=True).withColumn("sender_text", F.when(F.col("donation_id") % 13 == 0, "Anonim").when(F.col("donation_id") % 3 == 0, "Donor"))
    ctx = ctx.withColumn("sender_quality", F.when(F.col("donation_id") % 26 == 0, "declared_anonymous").when(F.col("donation_id") % 39 == 0, "extraction_failed"))
    lookups = []
    if kinds is None or "register_membership" in kinds:
        names = src.entities(spark, sf_dir).select(F.col("entity_id").alias("sender_id"), F.upper("canonical_name").alias("sender_name"))
        rows = ctx.select("donation_id", "sender_id", "occurred_at").join(names, "sender_id", "left")
        # the register of final convictions is not available, so its rule cannot be evaluated
        for name in ("prohibited_source", "final_convictions"):
            found = refdata.register_lookup(rows, ref.registers(spark), ref.register_entries(spark, sf_dir), name, "sender_id", "sender_name", F.to_date("occurred_at"))
            lookups.append(found.select("donation_id", F.col("listed").alias(f"listed_{name}")))
    if kinds is None or "report_reconciliation" in kinds:
        lookups.append(refdata.reconcile(ctx, ref.filings(spark, sf_dir), ref.filing_periods(spark)))
    if kinds is None or "foreign_jurisdiction" in kinds:
        ctx = rules.with_lookups(ctx, src.entities(spark, sf_dir))
    return facts.rule_facts(ctx, dims.calendar(spark), kinds, lookups)


def _one(kind: str, spark, sf_dir) -> DataFrame:
    rule = next(r for r in QUERY_RULES if r.kind == kind)
    fired, _ = rules.predicates(rule)
    return rule_facts(spark, sf_dir, [kind]).select("donation_id", fired.alias("fired"))


_VIS = "h.recorded_at <= p.occurred_at"
_WIN = "h.occurred_at BETWEEN p.occurred_at - INTERVAL {d} DAY AND p.occurred_at AND " + _VIS
_CTX = f"WITH {LEDGER}, {dims.CONTEXTS}"
_TEXT = "CASE WHEN donation_id % 13 = 0 THEN 'Anonim' WHEN donation_id % 3 = 0 THEN 'Donor' END"


def _own(alias: str = "h") -> str:
    return f"{alias}.donation_id <> p.donation_id"


#: kind: SQL of (donation_id, fired) over ctx, the naive way.
KIND_SQL = {
    "threshold": "SELECT donation_id, CASE WHEN limit_idr IS NOT NULL THEN amount_idr > limit_idr END AS fired FROM ctx",
    "amount_band": "SELECT donation_id, CASE WHEN limit_idr IS NOT NULL THEN amount_idr::DOUBLE / limit_idr BETWEEN 0.9 AND 0.999 END AS fired FROM ctx",
    "aggregate_threshold": f"""SELECT p.donation_id, CASE WHEN p.receiver_id IS NOT NULL AND p.limit_idr IS NOT NULL AND p.window_start IS NOT NULL THEN coalesce(sum(h.amount_idr), 0) + p.amount_idr > p.limit_idr END AS fired
      FROM ctx p LEFT JOIN ctx h ON h.sender_id = p.sender_id AND h.receiver_id = p.receiver_id AND h.occurred_at >= p.window_start AND {_VIS} AND {_own()} GROUP BY p.donation_id, p.receiver_id, p.limit_idr, p.window_start, p.amount_idr""",
    "fan_in_burst": f"""SELECT p.donation_id, CASE WHEN any_value(p.receiver_id) IS NOT NULL THEN count(DISTINCT s.s) >= 5 AND count(DISTINCT s.s) FILTER (NOT EXISTS (SELECT 1 FROM ctx o WHERE o.sender_id = s.s AND o.recorded_at <= p.occurred_at AND o.occurred_at < p.occurred_at - INTERVAL 14 DAY))::DOUBLE / count(DISTINCT s.s) >= 0.5
      AND coalesce(greatest(max(s.amount_idr), any_value(p.amount_idr)) < 0.25::DOUBLE * any_value(p.limit_idr), true) END AS fired
      FROM ctx p LEFT JOIN (SELECT p.donation_id AS id, h.sender_id AS s, h.amount_idr FROM ctx p JOIN ctx h ON h.receiver_id = p.receiver_id AND {_WIN.format(d=14)} UNION ALL SELECT donation_id, sender_id, amount_idr FROM ctx) s ON s.id = p.donation_id GROUP BY p.donation_id, p.occurred_at""",
    "fan_out": f"SELECT p.donation_id, count(DISTINCT s.r) >= 3 AS fired FROM ctx p LEFT JOIN (SELECT p.donation_id AS id, h.receiver_id AS r FROM ctx p JOIN ctx h ON h.sender_id = p.sender_id AND {_WIN.format(d=14)} UNION ALL SELECT donation_id, receiver_id FROM ctx) s ON s.id = p.donation_id GROUP BY 1",
    "pass_through": f"SELECT p.donation_id, coalesce(p.amount_idr::DOUBLE / sum(h.amount_idr)::DOUBLE BETWEEN 0.85 AND 1.15, false) AS fired FROM ctx p LEFT JOIN ctx h ON h.receiver_id = p.sender_id AND {_WIN.format(d=7)} GROUP BY p.donation_id, p.amount_idr",
    "self_funded_inflow": f"SELECT p.donation_id, CASE WHEN NOT p.is_self_funded_declared THEN false WHEN p.is_self_funded_declared THEN coalesce(sum(h.amount_idr), 0)::DOUBLE / p.amount_idr >= 0.5 END AS fired FROM ctx p LEFT JOIN ctx h ON h.receiver_id = p.sender_id AND {_WIN.format(d=30)} GROUP BY p.donation_id, p.amount_idr, p.is_self_funded_declared",
    "velocity_spike": f"SELECT p.donation_id, CASE WHEN count(h.donation_id) < 2 THEN false ELSE (count(*) FILTER (h.occurred_at >= p.occurred_at - INTERVAL 30 DAY) / 30.0::DOUBLE) / (count(h.donation_id) / 90.0::DOUBLE) >= 2.0 END AS fired FROM ctx p LEFT JOIN ctx h ON h.sender_id = p.sender_id AND {_WIN.format(d=90)} GROUP BY p.donation_id",
    "amount_homogeneity": f"""SELECT donation_id, CASE WHEN receiver_id IS NOT NULL THEN n >= 5 AND sqrt(greatest(sq::DOUBLE / n::DOUBLE - (s::DOUBLE / n::DOUBLE) * (s::DOUBLE / n::DOUBLE), 0)) / (s::DOUBLE / n::DOUBLE) < 0.5 END AS fired FROM
      (SELECT p.donation_id, p.receiver_id, count(h.donation_id) + 1 AS n, coalesce(sum(h.amount_idr), 0) + p.amount_idr AS s, coalesce(sum(h.amount_idr::HUGEINT * h.amount_idr), 0) + p.amount_idr::HUGEINT * p.amount_idr AS sq
       FROM ctx p LEFT JOIN ctx h ON h.receiver_id = p.receiver_id AND {_WIN.format(d=30)} GROUP BY p.donation_id, p.receiver_id, p.amount_idr)""",
    "thin_donor": f"SELECT p.donation_id, count(h.donation_id) = 0 AND coalesce(p.amount_idr::DOUBLE / p.limit_idr > 0.5, false) AS fired FROM ctx p LEFT JOIN ctx h ON h.sender_id = p.sender_id AND {_VIS} AND {_own()} GROUP BY p.donation_id, p.amount_idr, p.limit_idr",
    "donor_concentration": f"""SELECT p.donation_id, CASE WHEN p.receiver_id IS NOT NULL THEN (coalesce(sum(h.amount_idr) FILTER (h.sender_id = p.sender_id), 0) + p.amount_idr)::DOUBLE / (coalesce(sum(h.amount_idr), 0) + p.amount_idr)::DOUBLE > 0.6 END AS fired
      FROM ctx p LEFT JOIN ctx h ON h.receiver_id = p.receiver_id AND {_VIS} AND {_own()} AND (p.window_start IS NULL OR h.occurred_at >= p.window_start) GROUP BY p.donation_id, p.receiver_id, p.sender_id, p.amount_idr""",
    "deadline_clustering": f"""SELECT p.donation_id, CASE WHEN p.receiver_id IS NOT NULL AND p.period_start IS NOT NULL THEN coalesce(p.occurred_at BETWEEN o AND e AND count(*) FILTER (h.occurred_at BETWEEN e - INTERVAL 30 DAY AND o) > 0
      AND ((count(*) FILTER (h.occurred_at >= o) + 1) / 3.0::DOUBLE) / (count(*) FILTER (h.occurred_at BETWEEN e - INTERVAL 30 DAY AND o) / 27.0::DOUBLE) >= 1.5, false) END AS fired
      FROM (SELECT *, next_deadline::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS e, e - INTERVAL 72 HOUR AS o FROM ctx) p LEFT JOIN ctx h ON h.receiver_id = p.receiver_id AND {_VIS} AND h.occurred_at >= e - INTERVAL 30 DAY GROUP BY p.donation_id, p.receiver_id, p.period_start, p.occurred_at, o, e""",
    "identity_absent": f"SELECT donation_id, CASE WHEN {_TEXT} = 'Anonim' THEN CASE WHEN donation_id % 26 = 0 THEN true WHEN donation_id % 39 = 0 THEN false END ELSE false END AS fired FROM ctx",
    "foreign_jurisdiction": "SELECT donation_id, j <> 'ID' AS fired FROM ctx LEFT JOIN (SELECT c_custkey, CASE WHEN c_nationkey % 11 <> 0 THEN CASE WHEN c_nationkey % 4 = 0 THEN 'SG' ELSE 'ID' END END AS j FROM customer) ON c_custkey = sender_id",
    "register_membership": """SELECT donation_id, CASE WHEN occurred_at::DATE - DATE '1997-06-01' <= 700 THEN CASE WHEN EXISTS (SELECT 1 FROM entries e WHERE e.entity_id = sender_id)
      THEN EXISTS (SELECT 1 FROM entries e WHERE e.entity_id = sender_id AND effective_from <= occurred_at::DATE AND coalesce(effective_to >= occurred_at::DATE, true))
      ELSE EXISTS (SELECT 1 FROM entries e WHERE e.folded = (SELECT lower(c_name) FROM customer WHERE c_custkey = sender_id) AND effective_from <= occurred_at::DATE AND coalesce(effective_to >= occurred_at::DATE, true)) END END AS fired FROM ctx""",
    "report_reconciliation": f"SELECT donation_id, CASE WHEN electoral_context = 'ctx-1998' AND occurred_at::DATE BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' THEN NOT EXISTS (SELECT 1 FROM filings f WHERE {MATCH}) END AS fired FROM ctx p",
}
_EXTRA = {"register_membership": f", {ref.ENTRIES}", "report_reconciliation": f", {ref.FILINGS}"}


def _register(kind: str) -> None:
    def run(spark, sf_dir):
        return _one(kind, spark, sf_dir)

    run.__name__ = f"rule_{kind}"
    query(f"{_CTX}{_EXTRA.get(kind, '')} {KIND_SQL[kind]}")(run)


for _kind in KIND_SQL:
    _register(_kind)


@query(
    f"""{_CTX} SELECT p.donation_id, coalesce(sum(h.amount_idr), 0)::BIGINT AS prior_total, (coalesce(sum(h.amount_idr), 0) + p.amount_idr)::BIGINT AS total, p.limit_idr::BIGINT AS limit_idr,
    coalesce(sum(h.amount_idr), 0) <= p.limit_idr AND coalesce(sum(h.amount_idr), 0) + p.amount_idr > p.limit_idr AS is_crossing, coalesce(sum(h.amount_idr), 0) + p.amount_idr > p.limit_idr AS fired
    FROM ctx p LEFT JOIN ctx h ON h.sender_id = p.sender_id AND h.receiver_id = p.receiver_id AND h.occurred_at >= p.window_start AND {_VIS} AND {_own()}
    WHERE p.receiver_id IS NOT NULL AND p.limit_idr IS NOT NULL GROUP BY p.donation_id, p.amount_idr, p.limit_idr"""
)
def cumulative_limit(spark, sf_dir):
    """The flagship: donations that together pass the limit of their period."""
    ctx = contexts(spark, sf_dir).where("receiver_id is not null")
    out = ctx.join(facts.window_totals(ctx, dims.calendar(spark), ["sender_id", "receiver_id"], "w"), "donation_id", "left").where("limit_idr is not null")
    prior, limit = F.coalesce("w_total", F.lit(0)), F.col("limit_idr")
    total = prior + F.col("amount_idr")
    return out.select("donation_id", prior.alias("prior_total"), total.alias("total"), "limit_idr", ((prior <= limit) & (total > limit)).alias("is_crossing"), (total > limit).alias("fired"))


def long_table(spark, sf_dir) -> DataFrame:
    return rules.verdicts(rule_facts(spark, sf_dir), QUERY_RULES)


def _verdict_sql() -> str:
    """The cascade over the naive predicates, one row per donation and rule."""
    lacks = {
        "sender_type": "sender_type = 'unknown'", "receiver_type": "receiver_type = 'unknown'", "amount": "NOT amount_idr > 0", "date": "occurred_at IS NULL", "resolved_sender_id": "sender_id IS NULL",
        "resolved_receiver_id": "receiver_id IS NULL", "electoral_context": "electoral_context IS NULL",
    }
    parts, tests = [], []
    for r in QUERY_RULES:
        kind = "sender_total" if r.params.get("group_by") == "sender" else "no_register" if r.params.get("register") == "final_convictions" else r.kind
        if kind not in tests:
            tests.append(kind)
        listed = lambda v: "(" + ", ".join(f"'{x}'" for x in v) + ")"
        fits = " AND ".join([*([f"sender_type IN {listed(r.sender_types)}"] if r.sender_types else []), *([f"receiver_type IN {listed(r.receiver_types)}"] if r.receiver_types else []), *([f"regime = '{r.regime}'"] if r.regime else [])]) or "true"
        gap = " OR ".join(f"({lacks[n]})" for n in r.needs)
        hit = "LEGAL_FINDING" if r.tier == 1 else "BEHAVIOURAL_SIGNAL"
        open_regime = "regime = 'indeterminate'" if r.regime else "false"
        parts.append(f"SELECT donation_id, '{r.id}' AS rule_id, CASE WHEN {open_regime} THEN 'INDETERMINATE' WHEN NOT ({fits}) THEN 'NOT_APPLICABLE' WHEN {gap} THEN 'INDETERMINATE' WHEN fired IS NULL THEN 'INDETERMINATE' WHEN fired THEN '{hit}' ELSE 'PASS' END AS outcome, {r.weight or 'NULL'}::DOUBLE AS weight FROM base JOIN t_{kind} USING (donation_id)")
    sender = KIND_SQL["aggregate_threshold"].replace("p.receiver_id IS NOT NULL AND ", "").replace(" AND h.receiver_id = p.receiver_id", "")
    special = {"sender_total": sender, "no_register": "SELECT donation_id, NULL::BOOLEAN AS fired FROM ctx"}
    ctes = [f"t_{k} AS ({special.get(k) or KIND_SQL[k]})" for k in tests]
    base = "base AS (SELECT *, CASE WHEN period_start IS NOT NULL THEN 'campaign' WHEN window_start IS NOT NULL THEN 'party_annual' ELSE 'indeterminate' END AS regime FROM ctx)"
    return f"{_CTX}, {ref.ENTRIES}, {ref.FILINGS}, {base}, {', '.join(ctes)}, verdicts AS ({' UNION ALL '.join(parts)})"


VERDICTS = _verdict_sql()


@query(f"{VERDICTS} SELECT donation_id, rule_id, outcome FROM verdicts")
def rule_verdicts(spark, sf_dir):
    return long_table(spark, sf_dir).select("donation_id", "rule_id", "outcome")


_LIST = "coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (outcome = '{o}'), '') AS {n}"


@query(
    f"""{VERDICTS} SELECT donation_id, {_LIST.format(o='LEGAL_FINDING', n='findings')}, {_LIST.format(o='BEHAVIOURAL_SIGNAL', n='signals')}, {_LIST.format(o='INDETERMINATE', n='indeterminate')},
    bool_and(outcome <> 'INDETERMINATE') AS is_fully_evaluated, max(weight) FILTER (outcome = 'BEHAVIOURAL_SIGNAL') AS label_weight FROM verdicts GROUP BY 1"""
)
def rule_rollup(spark, sf_dir):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return rules.rollup(long_table(spark, sf_dir)).select("donation_id", joined("findings"), joined("signals"), joined("indeterminate"), "is_fully_evaluated", "label_weight")


@query(
    f"""{VERDICTS} SELECT rule_id, count(*) FILTER (outcome IN ('LEGAL_FINDING', 'BEHAVIOURAL_SIGNAL')) AS hits, count(*) FILTER (outcome = 'PASS') AS passes,
    count(*) FILTER (outcome = 'NOT_APPLICABLE') AS not_applicable, count(*) FILTER (outcome = 'INDETERMINATE') AS indeterminate FROM verdicts GROUP BY 1"""
)
def rule_hits(spark, sf_dir):
    return rules.hit_report(long_table(spark, sf_dir))
