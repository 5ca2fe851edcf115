"""Rules: a static catalogue, sixteen predicates over shared facts, the verdict cascade and its roll-ups.

A predicate gives fired (null: could not be evaluated) and what it observed. "Could not be evaluated" is
never turned into "clean".
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .facts import rule_facts

#: Names that stand for no donor.
PLACEHOLDERS = ("nn", "n.n.", "anonim", "anonymous", "hamba allah", "hamba tuhan", "tidak diketahui", "tanpa nama", "-", "?")


@dataclass(frozen=True)
class Rule:
    """One rule: who it applies to (empty: anyone), what it needs, its test and its weight."""

    id: str
    kind: str
    typology: str
    sender_types: tuple[str, ...] = ()
    receiver_types: tuple[str, ...] = ()
    regime: str | None = None
    threshold: int | None = None
    needs: tuple[str, ...] = ("amount", "date")
    weight: float | None = None
    active: bool = True
    since: str = "2011-01-01"
    params: dict = field(default_factory=dict)

    @property
    def tier(self) -> int:
        return 1 if self.weight is None else 2


_ORGS = ("corporation", "organization")
_PAIR = ("resolved_sender_id", "resolved_receiver_id", "amount", "date")
#: The catalogue in force.
RULES = (
    Rule("RULE-T1-01", "threshold", "T-01", ("individual",), ("political-party",), "party_annual", 200_000_000, ("sender_type", "receiver_type", "amount", "date")),
    Rule("RULE-T1-02", "threshold", "T-01", _ORGS, ("political-party",), "party_annual", 800_000_000, ("sender_type", "receiver_type", "amount", "date")),
    Rule("RULE-T1-03", "threshold", "T-01", ("individual",), (), "campaign", 2_500_000_000, ("sender_type", "amount", "date", "electoral_context"), since="2017-08-16"),
    Rule("RULE-T1-04", "threshold", "T-01", _ORGS, (), "campaign", 25_000_000_000, ("sender_type", "amount", "date", "electoral_context"), since="2017-08-16"),
    Rule("RULE-T1-05", "aggregate_threshold", "T-02", needs=_PAIR, params={"group_by": "pair"}),
    Rule("RULE-T1-06", "aggregate_threshold", "T-02", needs=("resolved_sender_id", "amount", "date"), active=False, params={"group_by": "sender"}),
    Rule("RULE-T1-07", "foreign_jurisdiction", "T-03", needs=("date",), since="2017-08-16", params={"domestic": "ID"}),
    Rule("RULE-T1-08", "identity_absent", "T-04", since="2017-08-16"),
    Rule("RULE-T1-09", "register_membership", "T-05", since="2017-08-16", params={"register": "prohibited_source"}),
    Rule("RULE-T1-10", "register_membership", "T-06", since="2017-08-16", active=False, params={"register": "final_convictions"}),
    Rule("RULE-T1-11", "report_reconciliation", "T-07", needs=("amount", "date", "electoral_context"), since="2017-08-16", active=False),
    Rule("RULE-T2-01", "fan_in_burst", "T-09", weight=0.6, params={"min_senders": 15, "max_amount_ratio": 0.25, "min_thin_ratio": 0.5}),
    Rule("RULE-T2-02", "amount_band", "T-12", weight=0.5, params={"low": 0.90, "high": 0.999}),
    Rule("RULE-T2-03", "fan_out", "T-10", weight=0.5, params={"min_receivers": 10}),
    Rule("RULE-T2-04", "pass_through", "T-10", weight=0.6, params={"low": 0.85, "high": 1.15}),
    Rule("RULE-T2-05", "self_funded_inflow", "T-11", weight=0.5, active=False, params={"min_ratio": 0.5}),
    Rule("RULE-T2-06", "velocity_spike", "T-09", weight=0.4, params={"multiple": 5.0}),
    Rule("RULE-T2-07", "amount_homogeneity", "T-09", weight=0.5, params={"min_count": 10, "max_cv": 0.1}),
    Rule("RULE-T2-08", "thin_donor", "T-09", weight=0.4, params={"min_ratio": 0.5}),
    Rule("RULE-T2-09", "donor_concentration", "T-10", weight=0.4, params={"min_share": 0.6, "min_total": 0}),
    Rule("RULE-T2-10", "deadline_clustering", "T-09", weight=0.4, params={"hours": 72, "days": 30, "multiple": 3.0}),
)


def catalogue(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rules as a table."""
    rows = [(i, r.id, r.kind, r.tier, r.typology, list(r.sender_types), list(r.receiver_types), r.regime, r.threshold, r.weight, r.active, r.since, None) for i, r in enumerate(rules)]
    schema = "ordinal int, rule_id string, kind string, tier int, typology string, sender_types array<string>, receiver_types array<string>, regime string, threshold_idr long, label_weight double, active boolean, since string, until string"
    return spark.createDataFrame(rows, schema).select("*", F.to_date("since").alias("effective_from"), F.to_date("until").alias("effective_to")).drop("since", "until")


Test = tuple[Column, Column]


def _fired(known: Column, fires: Column) -> Column:
    """Null where the test cannot be made."""
    return F.when(known, F.coalesce(fires, F.lit(False)))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def cv(n: Column, total: Column, squares: Column) -> Column:
    """Population standard deviation over mean, from sums."""
    mean = _ratio(total, n)
    return F.try_divide(F.sqrt(F.greatest(F.try_divide(squares.cast("double"), n.cast("double")) - mean * mean, F.lit(0.0))), mean)


def predicates(r: Rule) -> Test:
    """(fired, observed) of a rule over ``rule_facts`` columns and those of the reference lookups."""
    c, p = F.col, r.params
    amount, limit = c("amount_idr"), c("limit_idr")
    to_limit = _ratio(amount, limit)
    if r.kind == "threshold":
        return _fired(limit.isNotNull(), amount > limit), amount.cast("double")
    if r.kind == "aggregate_threshold":
        pair = p["group_by"] == "pair"
        total = _zero("pair_win_total" if pair else "sender_win_total") + amount
        known = c("sender_id").isNotNull() & limit.isNotNull() & c("window_start").isNotNull()
        if pair:
            known &= c("receiver_id").isNotNull()
        return _fired(known, total > limit), total.cast("double")
    if r.kind == "identity_absent":
        raw = F.trim(F.coalesce("sender_text", F.lit("")))
        absent = (c("sender_id").isNull() & (raw == "")) | F.lower(raw).isin(*PLACEHOLDERS) | ((c("sender_type") == "unknown") & c("sender_id").isNull())
        return F.when(~absent, F.lit(False)).otherwise(c("sender_quality") == "declared_anonymous"), F.lit(None).cast("double")
    if r.kind == "register_membership":
        return c(f"listed_{p['register']}"), F.lit(None).cast("double")
    if r.kind == "foreign_jurisdiction":
        return _fired(c("jurisdiction").isNotNull(), c("jurisdiction") != p["domestic"]), F.lit(None).cast("double")
    if r.kind == "report_reconciliation":
        return ~c("declared"), F.lit(None).cast("double")
    if r.kind == "fan_in_burst":
        n = _zero("d14_senders")
        thin = F.coalesce(_ratio(_zero("d14_fresh"), F.nullif(n, F.lit(0))), F.lit(0.0))
        ceiling = F.lit(p["max_amount_ratio"]) * limit
        below = F.coalesce(F.greatest(_zero("r14_max"), amount) < ceiling, F.lit(True))
        return _fired(c("receiver_id").isNotNull(), (n >= p["min_senders"]) & (thin >= p["min_thin_ratio"]) & below), n.cast("double")
    if r.kind == "amount_band":
        return _fired(limit.isNotNull(), to_limit.between(p["low"], p["high"])), to_limit
    if r.kind == "fan_out":
        n = _zero("s14_receivers")
        return _fired(c("sender_id").isNotNull(), n >= p["min_receivers"]), n.cast("double")
    if r.kind == "pass_through":
        ratio = _ratio(amount, c("in7_total"))
        return _fired(c("sender_id").isNotNull(), ratio.between(p["low"], p["high"])), ratio
    if r.kind == "self_funded_inflow":
        ratio = _ratio(_zero("in30_total"), amount)
        declared = c("is_self_funded_declared")
        return F.when(~declared, F.lit(False)).when(declared & c("sender_id").isNotNull(), ratio >= p["min_ratio"]), ratio
    if r.kind == "velocity_spike":
        ratio = F.when(_zero("s90") >= 2, (_zero("s30") / F.lit(30.0)) / (_zero("s90") / F.lit(90.0)))
        return _fired(c("sender_id").isNotNull(), ratio >= p["multiple"]), ratio
    if r.kind == "amount_homogeneity":
        n = _zero("r30_n") + 1
        own = amount.cast("decimal(19,0)") * amount.cast("decimal(18,0)")
        value = cv(n, _zero("r30_sum") + amount, F.coalesce(c("r30_squares"), F.lit(0)) + own)
        return _fired(c("receiver_id").isNotNull(), (n >= p["min_count"]) & (value < p["max_cv"])), F.when(n >= p["min_count"], value)
    if r.kind == "thin_donor":
        return _fired(c("sender_id").isNotNull(), (_zero("sender_count") == 0) & (to_limit > p["min_ratio"])), to_limit
    if r.kind == "donor_concentration":
        bounded = c("window_start").isNotNull()
        got = F.when(bounded, _zero("receiver_win_total")).otherwise(_zero("receiver_total")) + amount
        mine = F.when(bounded, _zero("pair_win_total")).otherwise(_zero("pair_total")) + amount
        share = _ratio(mine, got)
        return _fired(c("receiver_id").isNotNull() & c("sender_id").isNotNull(), (got >= p["min_total"]) & (share > p["min_share"])), share
    if r.kind == "deadline_clustering":
        days = p["hours"] / 24
        base = c("dl_base") / F.lit(max(p["days"] - days, 1.0))
        ratio = F.try_divide((c("dl_in") + 1) / F.lit(days), F.when(c("dl_base") > 0, base))
        return _fired(c("receiver_id").isNotNull() & c("period_start").isNotNull(), ratio >= p["multiple"]), ratio
    raise ValueError(r.kind)


def missing_fields(needs: tuple[str, ...]) -> Column:
    """Names of the required fields that a row lacks."""
    c = F.col
    lacking = {
        "amount": ~F.coalesce(c("amount_idr") > 0, F.lit(False)),
        "date": c("occurred_at").isNull(),
        "sender_type": c("sender_type") == "unknown",
        "receiver_type": c("receiver_type") == "unknown",
        "resolved_sender_id": c("sender_id").isNull(),
        "resolved_receiver_id": c("receiver_id").isNull(),
        "sender_jurisdiction": F.lit(True),
        "electoral_context": c("electoral_context").isNull(),
        "is_self_funded_declared": c("is_self_funded_declared").isNull(),
        "transaction_kind": c("transaction_kind").isNull(),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(lacking.get(n, c(n).isNull() if n not in lacking else F.lit(True)), F.lit(True)), F.lit(n)) for n in needs]))


def _result(r: Rule, require_verified: bool, fired: Column, missing: Column) -> tuple[Column, Column]:
    """The verdict cascade of one rule, and why it could not be evaluated."""
    c = F.col
    fits = F.lit(True)
    if r.sender_types:
        fits &= c("sender_type").isin(*r.sender_types)
    if r.receiver_types:
        fits &= c("receiver_type").isin(*r.receiver_types)
    if r.regime:
        fits &= c("regime") == r.regime
    hit = "LEGAL_FINDING" if r.tier == 1 else "BEHAVIOURAL_SIGNAL"
    undetermined = F.lit(not r.active) | (F.lit(r.tier == 1) & F.lit(require_verified)) | (F.lit(r.regime is not None) & (c("regime") == "indeterminate"))
    result = F.when(undetermined, "INDETERMINATE").when(~fits, "NOT_APPLICABLE").when(F.size(missing) > 0, "INDETERMINATE").when(fired.isNull(), "INDETERMINATE").when(fired, hit).otherwise("PASS")
    reason = (
        F.when(F.lit(not r.active), "rule is not in operation")
        .when(F.lit(r.tier == 1 and require_verified), "citation is not verified")
        .when(F.lit(r.regime is not None) & (c("regime") == "indeterminate"), "regime is not determined")
        .when(~fits, F.lit(None).cast("string"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .when(fired.isNull(), "not evaluable")
    )
    return result, reason


def outcome(r: Rule, observed: Column, result: Column, reason: Column) -> Column:
    """The verdict of one rule, as a struct (rule_id, tier, outcome, reason, observed, label_weight)."""
    hit = "LEGAL_FINDING" if r.tier == 1 else "BEHAVIOURAL_SIGNAL"
    judged = result.isin("PASS", hit)
    return F.struct(
        F.lit(r.id).alias("rule_id"), F.lit(r.kind).alias("kind"), F.lit(r.tier).alias("tier"), result.alias("outcome"), reason.alias("reason"),
        F.when(judged, observed).alias("observed"), F.when(result == "BEHAVIOURAL_SIGNAL", F.lit(r.weight).cast("double")).alias("label_weight"),
    )


def verdicts(facts: DataFrame, rules: tuple[Rule, ...] = RULES, require_verified: bool = False, in_force_only: bool = False) -> DataFrame:
    """One row per (donation_id, rule): the long table of outcomes.

    Tests, then results are columns of their own, as several expressions read each.
    """
    tests = {}
    for i, r in enumerate(rules):
        fired, observed = predicates(r)
        tests |= {f"_f{i}": fired, f"_o{i}": observed, f"_x{i}": missing_fields(r.needs)}
    facts = facts.withColumns(tests)
    results = [_result(r, require_verified, F.col(f"_f{i}"), F.col(f"_x{i}")) for i, r in enumerate(rules)]
    facts = facts.withColumns({f"_r{i}": result for i, (result, _) in enumerate(results)})
    each = [outcome(r, F.col(f"_o{i}"), F.col(f"_r{i}"), reason) for i, (r, (_, reason)) in enumerate(zip(rules, results, strict=True))]
    if in_force_only:
        day = F.to_date("occurred_at")
        each = [F.when(day >= F.lit(r.since).cast("date"), e) for r, e in zip(rules, each, strict=True)]
    return facts.select("donation_id", F.explode(F.array_compact(F.array(*each))).alias("v")).select("donation_id", "v.*")


def rollup(long: DataFrame) -> DataFrame:
    """Per donation: findings, signals, indeterminate rules, whether all could be evaluated, and the greatest label weight."""
    ids = lambda outcome: F.array_sort(F.collect_list(F.when(F.col("outcome") == outcome, F.col("rule_id"))))
    return long.groupBy("donation_id").agg(
        ids("LEGAL_FINDING").alias("findings"), ids("BEHAVIOURAL_SIGNAL").alias("signals"), ids("INDETERMINATE").alias("indeterminate"),
        F.bool_and(F.col("outcome") != "INDETERMINATE").alias("is_fully_evaluated"), F.max("label_weight").alias("label_weight"),
    )


def hit_report(long: DataFrame) -> DataFrame:
    """Per rule: how often it fired, passed, did not apply or could not be evaluated."""
    n = lambda *o: F.count(F.when(F.col("outcome").isin(*o), 1))
    return long.groupBy("rule_id").agg(n("LEGAL_FINDING", "BEHAVIOURAL_SIGNAL").alias("hits"), n("PASS").alias("passes"), n("NOT_APPLICABLE").alias("not_applicable"), n("INDETERMINATE").alias("indeterminate"))


def with_lookups(facts: DataFrame, entities: DataFrame | None = None, listed: dict[str, DataFrame] | None = None, declared: DataFrame | None = None) -> DataFrame:
    """``rule_facts`` with the reference lookups that predicates read; the last two are keyed by donation_id."""
    out = facts
    if entities is not None:
        out = out.join(entities.select(F.col("entity_id").alias("sender_id"), "jurisdiction"), "sender_id", "left")
    for name, t in (listed or {}).items():
        out = out.join(t.select("donation_id", F.col("listed").alias(f"listed_{name}")), "donation_id", "left")
    return out if declared is None else out.join(declared, "donation_id", "left")


__all__ = ["RULES", "Rule", "catalogue", "hit_report", "outcome", "predicates", "rollup", "rule_facts", "verdicts", "with_lookups"]
