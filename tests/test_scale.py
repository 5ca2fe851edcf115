"""Hubs, busy weeks and global ranks: the rewrites without pairs against plain Python."""

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hindcast.functions import quantiles
from hindcast.operators import graph, pit, typology
from hindcast.sources import scratch

START = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


@pytest.mark.parametrize("strict", [False, True])
def test_hubs_are_cut_into_stretches(spark, strict):
    r = random.Random(1)
    rows = [(1 if i % 3 else i, r.randrange(30) * 1_800_000_000 - 10**10, r.choice([None, i])) for i in range(400)] + [(None, 5, 1)]
    df = spark.createDataFrame(rows, "k long, at long, v long")
    got = pit.running(df, ["k"], [("s", "sum", F.col("v")), ("n", "count", F.col("v")), ("lo", "min", F.col("v")), ("hi", "max", F.col("v"))], strict, hub_rows=7)
    want = []
    for k, at, v in rows:
        if k is not None:
            seen = [x for q, t, x in rows if q == k and x is not None and (t < at if strict else t <= at)]
            want.append((k, at, v, sum(seen), len(seen), min(seen, default=None), max(seen, default=None)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def _ledger(spark, rows):
    return spark.createDataFrame(rows, "donation_id long, sender_id long, receiver_id long, occurred_at timestamp, recorded_at timestamp, amount_idr long")


def test_sliding_max_has_no_pairs(spark):
    """All rows in one hub, among them rows recorded just before they leave the window, and before 1970."""
    r, rows = random.Random(2), []
    for i in range(500):
        at = dt.datetime(1969, 12, 20) + dt.timedelta(seconds=r.randrange(40 * 86400))
        rows.append((i, i % 5, None if i % 50 == 0 else 7, at, at + r.choice([dt.timedelta(0), 13 * DAY, 14 * DAY, 14 * DAY + dt.timedelta(microseconds=1), dt.timedelta(seconds=5)]), r.randrange(1000)))
    df = _ledger(spark, rows)
    got = dict(map(tuple, pit.sliding_max(df, df, {"receiver_id": "receiver_id"}, 14, F.col("amount_idr"), "m").collect()))
    want = {}
    for i, _, k, at, *_ in rows:
        seen = [a for _, _, q, t, rec, a in rows if k is not None and q == k and rec <= at and t >= at - 14 * DAY]
        if seen:
            want[i] = max(seen)
    assert got == want


def test_a_hub_costs_few_rows(spark):
    """A node with 5,000 neighbours sends 25 edges, and clusters are those of plain search."""
    star = [(i, 0, i, START + dt.timedelta(minutes=i), START + dt.timedelta(minutes=i), 1) for i in range(1, 5_001)]
    tail = [(30_000 + i, 50_000 + i, 50_001 + i, START, START, 1) for i in range(30)] + [(40_000, 50_000, 0, START + 30 * DAY, START + 30 * DAY, 1), (40_001, 5, 5, START, START, 1)]
    edges = graph.open_edges(_ledger(spark, star + tail))
    assert edges.groupBy("u").count().agg(F.max("count")).first()[0] == 25
    assert edges.where("u = 0").agg(F.min("closes"), F.max("closes")).first() == (star[25][3], star[25][3])
    probes = [star[3], star[24], star[25], tail[29], tail[30]]
    got = dict(map(tuple, graph.local_clusters(_ledger(spark, star + tail), _ledger(spark, probes), cut=lambda d: scratch.written(d, "clusters")).collect()))

    def reach(p):
        near = {}
        for _, u, v, _, rec, _ in star + tail:
            if rec <= p[3] and u != v:
                near.setdefault(u, set()).add(v)
                near.setdefault(v, set()).add(u)
        seen, todo = {p[1], p[2]}, [p[1], p[2]]
        while todo:
            x = todo.pop()
            if len(near.get(x, ())) <= 25:
                todo += [y for y in near.get(x, ()) if y not in seen]
                seen |= near.get(x, set())
        return min(len(seen), 200)

    assert got == {p[0]: reach(p) for p in probes}


def test_order_statistics_are_exact(spark):
    r = random.Random(3)
    sets = {"wide": [r.choice([-1, 1]) * 10.0 ** r.randrange(-300, 300) for _ in range(500)], "one": [4.0] * 9, "near": [1.0, 1.0 + 2**-52] * 7, "ties": [float(r.randrange(5)) for _ in range(300)], "none": [None], "odd": [float("nan"), 2.0, 1.0]}
    df = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "feature string, value double")
    names = {"p10": lambda n: F.greatest(F.ceil(n * 0.1), F.lit(1)), "last": lambda n: n}
    got = {(x["feature"], x["name"]): x["value"] for x in quantiles.at_places(df, names, cells=8).collect()}
    for k, vs in sets.items():
        s = sorted(v for v in vs if v is not None and v == v)
        if s:
            assert (got[k, "p10"], got[k, "last"]) == (s[max(-(-len(s) // 10), 1) - 1], s[-1])
    assert len(got) == 10
    big = spark.createDataFrame([("x", v) for v in (2**62, 2**62 + 1, -(2**62), 5)], "feature string, value long")
    assert sorted(x["value"] for x in quantiles.at_places(big, {str(i): (lambda n, i=i: F.lit(i)) for i in (1, 2, 3, 4)}, cells=8).collect()) == [-(2**62), 5, 2**62, 2**62 + 1]
    assert quantiles.interpolated(df.where("feature = 'ties'"), 0.5).first()["value"] == sorted(sets["ties"])[149] / 2 + sorted(sets["ties"])[150] / 2


def test_ranks_are_global_and_stay_in_the_jvm(spark):
    rows = [(i, (i * 7919) % 1000) for i in range(2000)]
    df = quantiles.ranked(spark.createDataFrame(rows, "i long, v long").repartition(7), F.col("v").desc(), F.col("i"))
    order = sorted((-v, i) for i, v in rows)
    assert all(bisect.bisect_left(order, (-r["v"], r["i"])) + 1 == r["rank"] for r in df.collect())
    assert "Python" not in df._jdf.queryExecution().toString()


def _gifts(seed, n, nodes, amounts, days=30):
    r = random.Random(seed)
    out = []
    for i in range(n):
        at = START + dt.timedelta(seconds=r.randrange(days * 86400)) if i % 3 else START + r.randrange(days) * DAY
        out.append((i, r.choice([None, *range(nodes)]), r.choice([None, *range(nodes)]), at, at, r.choice(amounts)))
    return out


@pytest.mark.parametrize("amounts", [[1, 2, 3, 5, 7, 20, 63, 64, 65, 70, 80], [10_000 + 37 * k for k in range(300)], [0, 9, 10**9, 10**9 + 1, 1_150_000_000, 850_000_000]])
def test_proxies_are_those_of_all_pairs(spark, amounts):
    rows = _gifts(5, 250, 6, amounts)
    got = {r[0] for r in typology.proxies(_ledger(spark, rows)).collect()}
    want = set()
    for i, s, _, t, _, y in rows:
        for j, _, k, u, _, x in rows:
            if i != j and s is not None and s == k and t - 7 * DAY <= u <= t and x and y and 0.85 <= y / x <= 1.15:
                want |= {i, j}
    assert got == want


@pytest.mark.parametrize("least", [2, 4])
def test_smurfing_is_that_of_all_groups(spark, least):
    rows = [(*x[:2], x[2] and x[2] % 2, *x[3:]) for x in _gifts(6, 260, 40, [100, 101, 110, 114, 115, 116, 130, 131, 160, 0, 999], 40)]
    rows += [(1000 + k, 77, 1, START, START, a) for k, a in enumerate([100, 108, 115, 120, 140, 100])]  # one donor, many amounts at one instant
    got = dict(map(tuple, typology.smurfing(_ledger(spark, rows), 500, min_donors=least).collect()))
    first = {}
    for _, s, k, t, *_ in rows:
        if s is not None and k is not None:
            first[s, k] = min(first.get((s, k), t), t)
    small = [x for x in rows if (x[1], x[2]) in first and x[3] == first[x[1], x[2]] and x[5] < 500]
    want = {}
    for i, _, k, t, *_ in small:
        near = [x for x in small if x[2] == k and t <= x[3] <= t + 7 * DAY]
        most = max(len({z[1] for z in near if x[5] <= z[5] <= x[5] * 1.15}) for x in near)
        if most >= least:
            want[i] = most
    assert got == want


def test_a_busy_hub_is_swept_in_linear_work(spark):
    """60,000 first gifts to one receiver in a week: pairs would be 10^9."""
    r = random.Random(7)
    rows = [(i, i, 0, START + dt.timedelta(seconds=r.randrange(7 * 86400)), START, 1000 + r.randrange(4000)) for i in range(60_000)]
    got = typology.smurfing(_ledger(spark, rows), 10_000, min_donors=15)
    assert got.count() > 59_000
    assert typology.proxies(_ledger(spark, [(i, 0 if i % 2 else i, i if i % 2 else 0, *x[3:]) for i, x in enumerate(rows)])).count() > 59_000


def test_chains_are_counted_without_listing_them(spark):
    r = random.Random(9)
    rows = [(i, r.randrange(6), r.randrange(6), START + dt.timedelta(hours=r.randrange(300)), START, r.choice([50, 70, 100, 130])) for i in range(45)]
    rows = [(*x[:3], x[3], x[3], x[5]) for x in rows]
    df, now = _ledger(spark, rows), F.lit(START + 13 * DAY)
    listed = graph.membership(graph.all_alerts(graph.chains(df, now))).groupBy("donation_id").count()
    want = {int(k): n for k, n in map(tuple, listed.collect())}
    assert dict(map(tuple, graph.chain_counts(df, now).collect())) == want and max(want.values()) > 20


def test_blocks_meet_in_one_aggregate(spark):
    """However many blocks there are, a task of the facts reads one exchange for all of them: joined one by one, each took memory of its own."""
    from hindcast.operators import dims, facts

    rows = [(i, x[1], x[2], x[3], x[3] + (i % 3) * DAY, x[5]) for i, x in enumerate(_gifts(11, 120, 6, [10, 40, 90], 60))]
    extra = F.lit("ctx-1998").alias("electoral_context"), F.lit("individual").alias("sender_type"), F.lit("political-party").alias("receiver_type")
    ctx = scratch.written(dims.contexts(_ledger(spark, rows).select("*", *extra), dims.calendar(spark), dims.limits(spark)), "contexts")
    out = facts.rule_facts(ctx, dims.calendar(spark))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Join ") <= 1
    got = {r.donation_id: r for r in out.collect()}
    for i, s, k, at, rec, a in rows:
        mine = [x for x in rows if s is not None and x[1] == s and x[0] != i and x[4] <= at]
        assert ((got[i].sender_count or 0), (got[i].sender_total or 0)) == (len(mine), sum(x[5] for x in mine))
        both = [x for x in mine if k is not None and x[2] == k]
        assert (got[i].pair_count or 0) == len(both)


def test_parts_side_by_side(spark):
    a = spark.createDataFrame([(1, 2), (2, None)], "donation_id long, a long")
    b = spark.createDataFrame([(2, True), (3, False)], "donation_id long, b boolean")
    assert sorted(map(tuple, pit.together(a, b).collect())) == [(1, 2, None), (2, None, True), (3, None, False)]


def test_runs_are_adopted_over_a_shuffle(spark):
    """A lambda as a join key over a shuffle made Spark look for the row's time among the alerts; summed alerts count like single ones."""
    from hindcast.operators import service

    rows = _ledger(spark, [(i, 1, i % 3, START + i * DAY, START + i * DAY, 1) for i in range(9)])
    at = [f"{START + 3 * DAY:%Y-%m-%d}", f"{START + 6 * DAY:%Y-%m-%d}"]
    single = spark.createDataFrame([("0", START + 3 * DAY, 5), ("0", START + 3 * DAY, 7), ("1", START + 6 * DAY, 2)], "focus string, detected_at timestamp, score long")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        summed = single.groupBy("focus", "detected_at").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
        got = [sorted(map(tuple, service.adopted(rows, a, at, "receiver_id").collect())) for a in (single, summed)]
        plans = [service.adopted(rows, a, at, "receiver_id")._jdf.queryExecution().optimizedPlan().toString() for a in (single, summed)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    want = [(i, None if i < 3 else START + (3 if i < 6 else 6) * DAY, 2 if i == 3 else 1 if i == 7 else 0, 7 if i == 3 else 2 if i == 7 else None) for i in range(9)]
    assert got == [want, want] and not any("lambda" in p for p in plans)


def test_chains_shuffle_no_path(spark):
    """Legs and pairs are shuffled and written; three or four legs are put together behind the last join only."""
    r = random.Random(13)
    rows = [(i, r.randrange(7), r.randrange(7), START + dt.timedelta(hours=r.randrange(300)), r.choice([50, 70, 100, 130])) for i in range(40)]
    df, now = _ledger(spark, [(*x[:4], x[3], x[4]) for x in rows]), F.lit(START + 13 * DAY)
    out = graph.chains(df, now)
    want, paths = set(), [((x,), (x[1], x[2])) for x in rows]
    for hops in (2, 3, 4):
        paths = [((*p, x), (*n, x[2])) for p, n in paths for x in rows if x[1] == n[-1] and x[3] >= p[-1][3] and x[3] - p[-1][3] <= 14 * DAY and x[4] >= p[-1][4] * 0.6 and x[2] not in n]
        want |= {tuple(y[0] for y in p) for p, _ in paths} if hops > 2 else set()
    assert {tuple(x.members) for x in out.collect()} == want and len(want) == out.count() > 50
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = spark._jvm.PythonSQLUtils.explainString(graph.chains(df, now)._jdf.queryExecution(), "formatted").split("\n\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    sent = [p for p in parts if ") Exchange" in p.split("\n")[0]]
    assert sent and not any("members" in p for p in sent)


def test_features_meet_in_one_aggregate(spark):
    from hindcast.operators import dims, features

    rows = [(i, x[1], x[2], x[3], x[3] + (i % 3) * DAY, x[5]) for i, x in enumerate(_gifts(12, 60, 5, [10, 40, 90], 60))]
    extra = [F.lit(v).alias(n) for n, v in (("electoral_context", "ctx-1998"), ("sender_type", "individual"), ("receiver_type", "political-party"), ("transaction_kind", "cash"), ("channel", "import"), ("precision", "day"))]
    ctx = scratch.written(dims.contexts(_ledger(spark, rows).select("*", *extra), dims.calendar(spark), dims.limits(spark)), "contexts")
    out = features.backfill(ctx, dims.calendar(spark))
    assert out.count() == len(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") <= 1 and plan.count("Exchange hashpartitioning") <= 2
