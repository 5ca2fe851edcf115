"""Lanes, their composition into one score, reasons, and the history of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pit

#: The most each lane can add, and the rules that the graph lane reads.
CEILINGS = (("graph", 50), ("classifier", 30), ("anomaly", 15), ("reputation", 5))
GRAPH_RULES = ("RULE-T2-01", "RULE-T2-03", "RULE-T2-04", "RULE-T2-09")
#: Legal standing and what each is worth; another standing counts as the third where coverage has been admitted.
STAGES = (("adjudicated", 1.0), ("charged", 0.6), ("allegation", 0.3), ("mentioned", 0.0))


def contribution(intensity: Column, ceiling: Column) -> Column:
    """Half-to-even, within 0..ceiling."""
    return F.bround(F.least(F.greatest(intensity, F.lit(0.0)), F.lit(1.0)) * ceiling).cast("long")


def band(score: Column) -> Column:
    return F.when(score < 25, "low").when(score < 50, "moderate").when(score < 75, "high").otherwise("critical")


def graph_lane(verdicts: DataFrame, membership: DataFrame | None = None) -> DataFrame:
    """(donation_id, intensity): signals of the graph rules, or the strongest alert that covers the transfer."""
    fired = (F.col("outcome") == "BEHAVIOURAL_SIGNAL") & F.col("rule_id").isin(*GRAPH_RULES)
    out = verdicts.groupBy("donation_id").agg(F.count(F.when(fired, 1)).alias("n"), F.max(F.when(fired, F.col("label_weight"))).alias("w"))
    rules = F.least(F.col("n") / 3, F.lit(1.0)) * F.coalesce("w", F.lit(0.0)) / 0.6
    if membership is None:
        return out.select("donation_id", rules.alias("intensity"))
    top = membership.groupBy("donation_id").agg((F.max("score") / 100).alias("a"))
    return out.join(top, "donation_id", "left").select("donation_id", F.greatest(rules, F.coalesce("a", F.lit(0.0))).alias("intensity"))


def anomaly_lane(scores: DataFrame, findings: DataFrame, cutoff: Column) -> DataFrame:
    """(donation_id, intensity): null (unavailable) for rows with a legal finding; how far a score lies over the cutoff."""
    over = F.when(F.col("anomaly") < cutoff, F.lit(0.0)).otherwise(F.least((F.col("anomaly") - cutoff) / F.greatest(cutoff, F.lit(1e-9)), F.lit(1.0)))
    legal = findings.select("donation_id").distinct().withColumn("_legal", F.lit(True))
    return scores.join(legal, "donation_id", "left").select("donation_id", F.when(F.col("_legal").isNull(), over).alias("intensity"))


def reputation_lane(ledger: DataFrame, coverage: DataFrame, enabled: bool, days: int = 1095) -> DataFrame:
    """(donation_id, intensity): the strongest stage of coverage from two sources or more; null where the lane is off or silent.

    An item counts from its publication until the end of the ``days``-th day after it: sources are counted by the unions of
    their items' intervals, and the strongest stage is a greatest value over intervals, so no transfer meets an item.
    """
    stage = F.lit(STAGES[2][1])
    for name, weight in STAGES[:3]:
        stage = F.when(F.col("stage") == name, F.lit(weight)).otherwise(stage)
    until = F.unix_micros(F.date_add(F.to_date("published_at"), days + 1).cast("timestamp"))
    items = coverage.where("not retracted and match_confidence >= 0.95").select("entity_id", "source", F.unix_micros("published_at").alias("_from"), until.alias("_until"), stage.alias("_v"))
    probes = ledger.select("donation_id", "sender_id", "occurred_at")
    n = pit.distinct_at(probes, items, ("sender_id", "entity_id"), "source", "n").where("n >= 2")
    w = pit.interval_max(probes, items, {"sender_id": "entity_id"}, "w", ((days + 1) * pit.DAY).bit_length())
    return n.join(w, "donation_id").select("donation_id", F.when(F.lit(enabled), F.col("w") * (0.6 + 0.4 * F.least(F.col("n") / 4, F.lit(1.0)))).alias("intensity"))


def lane_results(rows: DataFrame, lanes: dict[str, DataFrame]) -> DataFrame:
    """Long: one row per (donation_id, lane) with intensity (null: absent), ceiling and contribution."""
    out = rows.select("donation_id")
    for name, lane in lanes.items():
        out = out.join(lane.select("donation_id", F.col("intensity").alias(name)), "donation_id", "left")
    each = [F.struct(F.lit(n).alias("lane"), (F.col(n) if n in lanes else F.lit(None)).cast("double").alias("intensity"), F.lit(c).alias("ceiling")) for n, c in CEILINGS]
    return out.select("donation_id", F.explode(F.array(*each)).alias("l")).select("donation_id", "l.*", F.when(F.col("l.intensity").isNotNull(), contribution(F.col("l.intensity"), F.col("l.ceiling"))).alias("contribution"))


def composed(results: DataFrame) -> DataFrame:
    """Per transfer: the sum of what lanes add (100 at most), what they could add, whether any is absent, the band, and the reasons.

    Absent lanes are not made up for; each is listed as a reason of weight 0.
    """
    reason = F.struct((-F.coalesce("contribution", F.lit(0))).alias("order"), "lane", F.coalesce("contribution", F.lit(0)).alias("weight"), F.col("intensity").isNull().alias("absent"))
    out = results.groupBy("donation_id").agg(
        F.least(F.coalesce(F.sum("contribution"), F.lit(0)), F.lit(100)).alias("score"), F.coalesce(F.sum(F.when(F.col("intensity").isNotNull(), F.col("ceiling"))), F.lit(0)).alias("attainable"),
        F.bool_or(F.col("intensity").isNull()).alias("degraded"), F.array_sort(F.collect_list(F.when((F.col("contribution") > 0) | F.col("intensity").isNull(), reason))).alias("_r"),
    )
    return out.select("donation_id", "score", "attainable", "degraded", band(F.col("score")).alias("band"), F.transform("_r", lambda r: F.struct(r["lane"].alias("lane"), r["weight"].alias("weight"), r["absent"].alias("absent"))).alias("reasons"))


def unexplained(scores: DataFrame) -> DataFrame:
    """Scores over 0 without a reason that adds to them: must be empty."""
    return scores.where((F.col("score") > 0) & ~F.exists("reasons", lambda r: r["weight"] > 0))


def review_state(reasons: DataFrame, reviews: DataFrame) -> DataFrame:
    """``reasons`` (code, wording, ...) with ``state``: the latest decision on the code, unless the wording changed since."""
    latest = reviews.groupBy("code").agg(F.max_by(F.struct("decision", "wording"), "decided_at").alias("last"))
    same = F.col("last.wording") == F.col("wording")
    return reasons.join(latest, "code", "left").select(*reasons.columns, F.when(same, F.col("last.decision")).otherwise("unreviewed").alias("state"))


def latest_events(events: DataFrame) -> DataFrame:
    """The last scoring event of each transfer; combined before the shuffle."""
    rest = [c for c in events.columns if c not in ("donation_id", "scored_at")]
    return events.groupBy("donation_id").agg(F.max("scored_at").alias("scored_at"), F.max_by(F.struct(*rest), "scored_at").alias("e")).select("donation_id", "scored_at", "e.*")


def event_history(events: DataFrame) -> DataFrame:
    """Every event with the score before it."""
    w = Window.partitionBy("donation_id").orderBy("scored_at")
    return events.withColumn("previous", F.lag("score").over(w))


def queue(scores: DataFrame, budget: int) -> DataFrame:
    """The ``budget`` highest scores; ties by donation_id."""
    return scores.orderBy(F.col("score").desc(), "donation_id").limit(budget)
