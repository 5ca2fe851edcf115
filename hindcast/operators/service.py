"""What a scoring service does over a population: batches with an outcome per row, versioned alerts, labels, health and retraining."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.stats import share

#: Sources of labels with their default weights, and those in which a person judged.
LABEL_WEIGHTS = (("dispute_outcome", 1.0), ("analyst_disposition", 0.9), ("recipient_confirmation", 0.7), ("rule_tier2", 0.5), ("synthetic", 0.3))
HUMAN_SOURCES = ("analyst_disposition", "dispute_outcome")
LABEL_VALUES = ("risky", "not_risky", "indeterminate")
#: Limits of retraining, of health and of the fairness verdict.
MIN_HUMAN_LABELS, MIN_AUDIT_SHARE, MODEL_DAYS = 200, 0.15, 90
MAX_INDETERMINATE, MAX_DEGRADED = 0.5, 0.25
MAX_UNKNOWN, MAX_ASSOCIATION = 0.20, 0.20


def score_batch(records: DataFrame, validate: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(donation_id, donation_version, status, score, errors): each record's own outcome; one bad record fails no other.

    ``validate`` adds ``errors``; the latest valid version of each transfer is scored by ``score`` (donation_id, score),
    older valid ones are ``superseded``.
    """
    rows = validate(records)
    bad = F.size("errors") > 0
    latest = rows.where(~bad).groupBy("donation_id").agg(F.max("donation_version").alias("donation_version"))
    chosen = rows.where(~bad).join(latest, ["donation_id", "donation_version"]).drop("errors")
    scores = score(chosen).join(latest, "donation_id").select("donation_id", "donation_version", "score")
    out = rows.select("donation_id", "donation_version", "errors").join(scores, ["donation_id", "donation_version"], "left")
    status = F.when(bad, "error").when(F.col("score").isNull(), "superseded").otherwise("scored")
    return out.select("donation_id", "donation_version", status.alias("status"), F.when(~bad, F.col("score")).alias("score"), "errors")


def versioned(detect: Callable[[Column], DataFrame], instants: Sequence[str]) -> DataFrame:
    """The alerts of each detection run in one table, with the instant they were detected at."""
    out = None
    for at in instants:
        run = detect(F.lit(at).cast("timestamp")).withColumn("detected_at", F.lit(at).cast("timestamp"))
        out = run if out is None else out.unionByName(run)
    return out


def adopted(rows: DataFrame, alerts: DataFrame, instants: Sequence[str], party: str) -> DataFrame:
    """(donation_id, detected_at, alerts, score): the alerts about ``party`` of the last run before each transfer.

    A new run is read by later transfers only; the ones before keep what they were scored with. Alerts may come summed up, with
    their number ``n`` and greatest ``score`` by focus and run (and kind).
    """
    # no lambda: as a join key over a shuffle, Spark 4.1 looks for the row's time among the columns of the alerts
    runs = [F.when(F.lit(i).cast("timestamp") <= F.col("occurred_at"), F.lit(i).cast("timestamp")) for i in instants]
    run = F.greatest(*runs) if len(runs) > 1 else runs[0]
    seen = rows.select("donation_id", F.col(party).cast("string").alias("focus"), run.alias("detected_at"))
    number = F.sum("n") if "n" in alerts.columns else F.count(F.lit(1))
    about = alerts.groupBy("focus", "detected_at").agg(number.alias("n"), F.max("score").alias("score"))
    return seen.join(about, ["focus", "detected_at"], "left").select("donation_id", "detected_at", F.coalesce("n", F.lit(0)).alias("alerts"), "score")


def label_weight(source: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, weight in LABEL_WEIGHTS:
        out = F.when(source == name, F.lit(weight)).otherwise(out)
    return out


def checked_labels(labels: DataFrame) -> DataFrame:
    """``labels`` with ``errors``, the default weight where none is given, and whether a person judged.

    A recipient confirms that a transfer happened and not that it is clean, so such a label must be indeterminate.
    """
    c = F.col
    weight = F.coalesce("weight", label_weight(c("source")))
    bad = {
        "unknown_source": ~F.coalesce(c("source").isin(*[n for n, _ in LABEL_WEIGHTS]), F.lit(False)),
        "unknown_value": ~F.coalesce(c("value").isin(*LABEL_VALUES), F.lit(False)),
        "version_below_one": ~F.coalesce(c("donation_version") >= 1, F.lit(False)),
        "weight_out_of_range": ~F.coalesce(weight.between(0.0, 1.0), F.lit(True)),
        "confirmation_is_no_verdict": F.coalesce((c("source") == "recipient_confirmation") & (c("value") != "indeterminate"), F.lit(False)),
    }
    errors = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in bad.items()]))
    return labels.withColumns({"errors": errors, "weight": weight, "is_human": F.coalesce(c("source").isin(*HUMAN_SOURCES), F.lit(False))})


def retraining(labels: DataFrame, now: Column, trained_at: Column, drift: bool, faults: Sequence[str], rules_changed: bool) -> DataFrame:
    """(kind, name, fired): triggers and blockers of a retraining, a note, and the decision: any trigger and no blocker."""
    human = F.col("source").isin(*HUMAN_SOURCES)
    n = labels.agg(
        F.count(F.when(human, 1)).alias("human"),
        F.count(F.when(human & F.coalesce(F.col("note").startswith("audit-sample"), F.lit(False)), 1)).alias("audited"),
        F.count(F.when(F.col("source") == "dispute_outcome", 1)).alias("disputes"),
    )
    few = F.col("human") < MIN_HUMAN_LABELS
    age = F.coalesce(F.unix_micros(now) - F.unix_micros(trained_at) > MODEL_DAYS * 86_400_000_000, F.lit(False))
    triggers = {"new human judgements": ~few, "input or score drift": F.lit(drift), "rule set changed": F.lit(rules_changed), "model age": age}
    thin = F.when(F.col("human") == 0, F.lit(0.0)).otherwise(F.col("audited") / F.nullif(F.col("human"), F.lit(0))) < MIN_AUDIT_SHARE
    blockers = {"too few human labels": few, "too few audited labels": thin, "pipeline faults": F.lit(bool(faults))}
    notes = {"no dispute outcomes": ~few & (F.col("disputes") == 0)}
    any_of = lambda d: F.greatest(*[v.cast("int") for v in d.values()]) == 1
    rows = [("trigger", k, v) for k, v in triggers.items()] + [("blocker", k, v) for k, v in blockers.items()] + [("note", k, v) for k, v in notes.items()] + [("decision", "retrain", any_of(triggers) & ~any_of(blockers))]
    return n.select(F.explode(F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(b).alias("name"), v.alias("fired")) for a, b, v in rows])).alias("r")).select("r.*")


def window_health(scores: DataFrame, lanes: DataFrame, outcomes: DataFrame, days: int = 30, budget: int | None = None) -> DataFrame:
    """(place, concern, subject, value): what a person should look at over the last ``days`` days of scoring, in order.

    ``scores``: donation_id, scored_at, band, degraded; ``lanes``: donation_id, lane, intensity; ``outcomes``: donation_id,
    rule_id, outcome. Here a rule counts as evaluated where it found something. Concerns: lanes that never ran, rules that
    were mostly indeterminate, more flags than the budget, more degraded scores than a quarter.
    """
    last = scores.agg(F.max("scored_at").alias("_last"))
    recent = scores.join(F.broadcast(last), F.unix_micros("scored_at") >= F.unix_micros("_last") - days * 86_400_000_000).drop("_last")
    ids = recent.select("donation_id")
    idle = lanes.join(ids, "donation_id", "left_semi").groupBy("lane").agg(F.count("intensity").alias("ran"), F.count(F.lit(1)).alias("n")).where("ran = 0")
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    mine = outcomes.join(ids, "donation_id", "left_semi")
    rules = mine.groupBy("rule_id").agg(n("LEGAL_FINDING").alias("found"), n("INDETERMINATE").alias("unknown"))
    blind = rules.withColumn("value", share(F.col("unknown"), F.col("found") + F.col("unknown"))).where(F.col("value") > MAX_INDETERMINATE)
    legal = mine.where("outcome = 'LEGAL_FINDING'").select("donation_id").distinct().withColumn("_legal", F.lit(True))
    flagged = F.coalesce("_legal", F.lit(False)) | F.col("band").isin("high", "critical")
    total = recent.join(legal, "donation_id", "left").agg(F.count(F.when(flagged, 1)).alias("flagged"), F.avg(F.col("degraded").cast("double")).alias("degraded"))
    parts = [
        idle.select(F.lit(1).alias("place"), F.lit("lane did not run").alias("concern"), F.col("lane").alias("subject"), F.col("n").cast("double").alias("value")),
        blind.select(F.lit(2), F.lit("rule could not be evaluated"), "rule_id", "value"),
        total.where(F.lit(budget is not None) & (F.col("flagged") > F.lit(budget or 0))).select(F.lit(3), F.lit("over budget"), F.lit("flagged"), F.col("flagged").cast("double")),
        total.where(F.col("degraded") > MAX_DEGRADED).select(F.lit(4), F.lit("degraded scores"), F.lit("degraded"), "degraded"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def affiliation_verdict(cohorts: DataFrame, disparity: DataFrame, association: DataFrame) -> DataFrame:
    """One row: unknown share, association, and whether the errors by affiliation are acceptable (null: cannot be told).

    A measured disparity outranks the guards; a large unknown share or a strong association leave the verdict open.
    ``disparity``: attribute, within; ``association``: v.
    """
    blank = F.coalesce(F.trim(F.col("affiliation").cast("string")), F.lit("")) == ""
    known = cohorts.agg(F.avg(blank.cast("double")).alias("unknown_share"))
    within = disparity.where("attribute = 'affiliation'").agg(F.first("within").alias("within"))
    row = known.crossJoin(within).crossJoin(association)  # one row each
    open_ = (F.col("unknown_share") > MAX_UNKNOWN) | (F.coalesce("v", F.lit(0.0)) >= MAX_ASSOCIATION)
    verdict = F.when(F.col("within") == False, F.lit(False)).when(~open_, F.col("within"))  # noqa: E712
    return row.select("unknown_share", F.col("v").alias("association"), verdict.alias("acceptable"))


def fairness_passed(affiliation: DataFrame, disparity: DataFrame, required: Sequence[str] = ("district", "recipient_type", "size_band")) -> DataFrame:
    """One row: false if a dimension is out of tolerance, else null if one could not be measured, else true."""
    verdicts = disparity.where(F.col("attribute").isin(*required)).select("within").unionByName(affiliation.select(F.col("acceptable").alias("within")))
    n = verdicts.agg(F.count(F.when(F.col("within") == False, 1)).alias("no"), F.count("within").alias("told"))  # noqa: E712
    return n.select(F.when(F.col("no") > 0, F.lit(False)).when(F.col("told") == len(required) + 1, F.lit(True)).alias("passed"))


def selection_rates(cohorts: DataFrame) -> DataFrame:
    """(affiliation, rate): the flagged share of each known affiliation."""
    known = cohorts.where(F.trim(F.col("affiliation").cast("string")) != "")
    return known.groupBy("affiliation").agg(F.avg(F.col("flagged").cast("double")).alias("rate"))


def lane_reasons(scores: DataFrame) -> DataFrame:
    """(donation_id, place, lane, weight, absent): a composed score's reasons in their order."""
    return scores.select("donation_id", F.posexplode("reasons").alias("place", "r")).select("donation_id", "place", "r.lane", "r.weight", "r.absent")


def top_reasons(rows: DataFrame, importance: dict[str, float], most: int = 3) -> DataFrame:
    """(donation_id, reasons): of the features that have a value, the ``most`` with the greatest importance that say something.

    A feature can be stated if it is not null; ties by name.
    """
    each = F.array(*[F.struct((-F.lit(float(v))).alias("order"), F.lit(k).alias("feature"), F.col(k).cast("double").alias("value")) for k, v in importance.items()])
    stated = F.slice(F.array_sort(F.filter(each, lambda x: x["value"].isNotNull())), 1, most)
    return rows.select("donation_id", F.transform(stated, lambda x: x["feature"]).alias("reasons"))

