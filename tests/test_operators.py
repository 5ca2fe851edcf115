"""Single operators on hand-built rows: late arrivals, inclusive windows, ties, refusals, and unknown kept apart from clean."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hindcast.functions.stats import wilson
from hindcast.functions.text import fold, rupiah, template
from hindcast.operators import coverage, evaluate, fairness, graph, monitor, pit, scoring, service

SCHEMA = "donation_id long, sender_id long, receiver_id long, amount_idr long, occurred_at timestamp, recorded_at timestamp"


def day(text):
    return datetime.strptime(text, "%Y-%m-%d")


def ledger(spark, *rows):
    return spark.createDataFrame([(i, s, r, a, day(o), day(k)) for i, s, r, a, o, k in rows], SCHEMA)


def test_late_arrival_is_invisible_before_it_was_recorded(spark):
    led = ledger(spark, (1, 1, 9, 10, "2026-01-15", "2026-06-01"))
    assert pit.snapshot(led, F.lit("2026-02-01").cast("timestamp")).count() == 0
    assert pit.snapshot(led, F.lit("2026-07-01").cast("timestamp")).count() == 1


def test_later_recordings_never_change_earlier_rows(spark):
    rows = [(i, 1, 9, 10 * i, f"2026-01-{i:02d}", f"2026-01-{i:02d}") for i in range(1, 6)]
    before = {r.donation_id: r for r in pit.prior_totals(ledger(spark, *rows), ["sender_id"], "s").collect()}
    after = {r.donation_id: r for r in pit.prior_totals(ledger(spark, *rows, (9, 1, 9, 999, "2026-01-01", "2026-02-01")), ["sender_id"], "s").collect()}
    assert all(after[i] == before[i] for i in before) and before[4].s_total == 60 and before[4].s_count == 3


def test_running_totals_across_buckets_and_ties(spark):
    rows = [(i, 1, 9, 1, f"20{20 + i // 12:02d}-{i % 12 + 1:02d}-01", f"20{20 + i // 12:02d}-{i % 12 + 1:02d}-01") for i in range(30)] + [(99, 1, 9, 5, "2021-01-01", "2021-01-01")]
    got = {r.donation_id: r.s_total for r in pit.prior_totals(ledger(spark, *rows), ["sender_id"], "s").collect()}
    assert got[12] == 12 + 5 and got[99] == 13 and got[29] == 29 + 5


def test_window_bounds_are_inclusive(spark):
    led = ledger(spark, *[(i, 1, 9, 1, f"2026-01-0{i}", f"2026-01-0{i}") for i in range(1, 6)])
    got = pit.lookback(led, led, {"sender_id": "sender_id"}, 2).where("donation_id = 4").select("h_donation_id").collect()
    assert sorted(r[0] for r in got) == [2, 3, 4]


def test_three_leg_chain_and_an_unrelated_leg(spark):
    led = ledger(spark, (1, 1, 2, 100, "2026-01-01", "2026-01-01"), (2, 2, 3, 80, "2026-01-03", "2026-01-03"), (3, 3, 4, 70, "2026-01-05", "2026-01-05"), (4, 4, 5, 10, "2026-01-06", "2026-01-06"), (5, 3, 1, 70, "2026-01-05", "2026-01-05"))
    out = graph.chains(led, F.lit("2026-01-10").cast("timestamp")).collect()
    assert [list(r.members) for r in out] == [[1, 2, 3]] and out[0].hops == 3
    again = graph.chains(led.orderBy(F.col("donation_id").desc()), F.lit("2026-01-10").cast("timestamp")).first()
    assert again.alert_id == out[0].alert_id


def test_local_cluster_grows_as_edges_become_known(spark):
    led = ledger(spark, (1, 1, 2, 1, "2026-01-01", "2026-01-01"), (2, 2, 3, 1, "2026-01-02", "2026-01-02"), (3, 3, 4, 1, "2026-01-03", "2026-03-01"))
    got = {r.donation_id: r["size"] for r in graph.local_clusters(led, led).collect()}
    assert got == {1: 2, 2: 3, 3: 4}


def test_names_messages_and_intervals(spark):
    row = spark.range(1).select(fold(F.lit("  A  b\tC ")).alias("n"), rupiah(F.lit(1234567)).alias("m"), template("{who} gave {what}  {x}", {"who": F.lit("d"), "what": F.lit(None)}).alias("t"), *[w.alias(f"w{i}") for i, w in enumerate(wilson(F.lit(0), F.lit(0)))]).first()
    assert (row.n, row.m, row.t, row.w0, row.w1) == ("a b c", "Rp1.234.567", "d gave <what?> <x?>", 0.0, 1.0)


def test_scores_do_not_make_up_for_absent_lanes(spark):
    rows = spark.createDataFrame([(1,), (2,)], "donation_id long")
    lane = spark.createDataFrame([(1, 0.5)], "donation_id long, intensity double")
    out = {r.donation_id: r for r in scoring.composed(scoring.lane_results(rows, {"graph": lane})).collect()}
    assert (out[1].score, out[1].attainable, out[1].degraded, out[1].band) == (25, 50, True, "moderate") and out[2].score == 0
    assert [r.lane for r in out[1].reasons if not r.absent] == ["graph"] and len([r for r in out[2].reasons if r.absent]) == 4
    assert scoring.unexplained(scoring.composed(scoring.lane_results(rows, {"graph": lane}))).count() == 0


def test_rates_under_the_floor_stay_unknown(spark):
    rows = [(i, i % 2 == 0, True, False, "a" if i < 40 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "donation_id long, flagged boolean, reviewed boolean, confirmed boolean, group string")
    out = {r.value: r for r in fairness.groups(df, ("group",)).collect()}
    assert out["a"].rate == 0.5 and out["b"].rate is None
    d = fairness.disparity(fairness.groups(df, ("group",))).first()
    assert d.ratio is None and d.within is None


def test_drift_needs_ten_rows_and_survives_empty_bins(spark):
    rows = lambda v: spark.createDataFrame([("x", float(x)) for x in v], "feature string, value double")
    assert monitor.psi(rows(range(100)), rows(range(100))).first().psi < 1e-6
    assert monitor.psi(rows(range(100)), rows([500] * 50)).first().psi > 1
    assert monitor.psi(rows(range(5)), rows(range(100))).first().psi == 0.0


def test_audit_samples_repeat(spark):
    rows = spark.range(200).withColumnRenamed("id", "donation_id")
    draw = lambda p: sorted(r[0] for r in evaluate.audit_sample(rows, p).collect())
    assert draw("a") == draw("a") != draw("b") and len(draw("a")) == 50 and evaluate.audit_sample(rows.limit(9), "a").count() == 9


def test_coverage_repeats_count_once(spark):
    rows = [(1, "s1", day("2026-01-05"), "Minister charged with bribery today", "", "http://www.a.com/1", "charged"), (1, "s1", day("2026-01-06"), "Minister charged with bribery today", "", "http://a.com/2", "charged"), (1, "s2", day("2026-01-06"), "bribery Minister charged today with", "", "http://b.com/3", "charged"), (1, "s2", day("2026-01-06"), "x", "", "http://c.org/4", "charged"), (1, "s1", day("2026-01-06"), "y", "", "http://a.com/5", "mentioned")]
    items = spark.createDataFrame(rows, "entity_id long, source string, published_at timestamp, headline string, body string, url string, stage string")
    out = coverage.admitted(items, spark.createDataFrame([("a.com",), ("b.com",)], "host string"))
    assert {r.url[-1]: r.refusal is None for r in out.collect()} == {"1": True, "2": False, "3": True, "4": False, "5": False}
    assert coverage.independent_sources(out).first().sources == 2


def test_unknown_reason_is_refused(spark):
    from hindcast.streaming.arrivals import rescored

    with pytest.raises(ValueError):
        rescored(None, None, None, "because", None)


def test_sliding_windows_of_a_hub(spark):
    """Sums, distinct parties and the greatest amount of the last days against all pairs, with late rows and ties."""
    import random
    from datetime import timedelta

    r, start = random.Random(3), day("2026-01-01")
    rows = []
    for i in range(400):
        at = start + timedelta(days=r.randrange(60), hours=r.choice((0, 0, 7)))
        rows.append((i, r.choice((1, 2, 3, 4, 5, None)), r.choice((9, 9, 9, 8)), at, at + timedelta(days=r.choice((0, 0, 1, 20))), r.randrange(1, 50)))
    led = spark.createDataFrame(rows, "donation_id long, sender_id long, receiver_id long, occurred_at timestamp, recorded_at timestamp, amount_idr long")
    key, k = {"receiver_id": "receiver_id"}, 14
    seen = {x[0]: [h for h in rows if h[2] == x[2] and h[3] >= x[3] - timedelta(days=k) and h[4] <= x[3]] for x in rows}
    old = lambda x, s: any(h[1] == s and h[4] <= x[3] and h[3] < x[3] - timedelta(days=k) for h in rows)
    got = {x.donation_id: x for x in pit.sliding(led, led, key, k, {"n": F.lit(1), "s": F.col("amount_idr")}).collect()}
    assert all((got[x[0]].n or 0, got[x[0]].s or 0) == (len(seen[x[0]]), sum(h[5] for h in seen[x[0]])) for x in rows)
    got = {x.donation_id: (x.d or 0, x.f or 0) for x in pit.sliding_distinct(led, led, "receiver_id", "sender_id", k, "d", "f").collect()}
    for x in rows:
        senders = {h[1] for h in seen[x[0]]} - {None}
        assert got[x[0]] == (len(senders), sum(not old(x, s) for s in senders))
    got = {x.donation_id: x.m for x in pit.sliding_max(led, led, key, k, F.col("amount_idr"), "m").collect()}
    assert all(got.get(x[0]) == max((h[5] for h in seen[x[0]]), default=None) for x in rows)
    got = {x.donation_id: x.t for x in pit.latest(led, led, key, k, "t").collect()}
    assert all(got.get(x[0]) == max((h[3] for h in seen[x[0]]), default=None) for x in rows)


def test_labels_that_claim_too_much_are_refused(spark):
    rows = [(1, "recipient_confirmation", "not_risky", 1, None), (2, "recipient_confirmation", "indeterminate", 1, None), (3, "analyst_disposition", "risky", 0, 2.0), (4, "gossip", "maybe", 1, None)]
    out = {r.label_id: r for r in service.checked_labels(spark.createDataFrame(rows, "label_id long, source string, value string, donation_version long, weight double")).collect()}
    assert out[1].errors == ["confirmation_is_no_verdict"] and out[2].errors == [] and out[2].weight == 0.7
    assert out[3].errors == ["version_below_one", "weight_out_of_range"] and out[3].is_human and out[4].errors == ["unknown_source", "unknown_value"]


def test_an_unmeasured_dimension_leaves_the_verdict_open(spark):
    table = lambda rows: spark.createDataFrame(rows, "attribute string, within boolean")
    ok = spark.createDataFrame([(True,)], "acceptable boolean")
    three = [("district", True), ("recipient_type", True), ("size_band", True)]
    assert service.fairness_passed(ok, table(three)).first().passed is True
    assert service.fairness_passed(ok, table([*three[:2], ("size_band", None)])).first().passed is None
    assert service.fairness_passed(ok, table([*three[:2], ("size_band", False)])).first().passed is False
