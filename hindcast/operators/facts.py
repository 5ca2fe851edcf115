"""What each transfer's history held when it happened: the shared blocks under rules and features.

Every block is keyed by donation_id and computed once for all rows; ``pit.together`` puts them side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.sources import scratch

from . import pit
from .dims import small


def top_two(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, _top, _who, _second): the greatest ``value`` with its ``name``, and the greatest among other names. Two passes, no lists."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(value).alias("v"), F.col(name).alias("k"))).alias("_best"))
    rest = rows.join(best, list(keys)).where(F.col(name) != F.col("_best.k")).groupBy(*keys).agg(F.max(value).alias("_second"))
    return best.join(rest, list(keys), "left").select(*keys, F.col("_best.v").alias("_top"), F.col("_best.k").alias("_who"), "_second")


def same_instant(ledger: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """(donation_id, name): the greatest value among other rows of the keys recorded at the very time this one occurred."""
    rows = ledger.select(*keys, "donation_id", "recorded_at", "occurred_at", value.alias("_v"))
    known = rows.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys, F.col("recorded_at").alias("occurred_at"), "donation_id", "_v")
    joined = rows.join(top_two(known, [*keys, "occurred_at"], "_v", "donation_id"), [*keys, "occurred_at"])
    return joined.select("donation_id", F.when(F.col("_who") != F.col("donation_id"), F.col("_top")).otherwise(F.col("_second")).alias(name))


def prior_maxima(ledger: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """(donation_id, names): the greatest of each value over other rows of the keys known at the time, in one pass."""
    out = pit.as_of(ledger, keys, [(f"_m_{n}", "max", v) for n, v in values.items()], strict=True)
    out = pit.together(out, *[same_instant(ledger, keys, v, f"_s_{n}") for n, v in values.items()])
    return out.select("donation_id", *[F.greatest(f"_m_{n}", f"_s_{n}").alias(n) for n in values])


def prior_max(ledger: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """(donation_id, name): the greatest value of other rows of the keys known at the time."""
    return prior_maxima(ledger, keys, {name: value})


def prior_top_pair(ledger: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """(donation_id, name): the greatest total of one counterparty among other rows known at the time.

    Pair totals only grow, so the maximum over pairs is a running maximum of running totals. A row that
    sees itself takes its amount off its own pair; the other pairs of that instant are looked up.
    """
    full = ledger.where(F.col(key).isNotNull() & F.col(other).isNotNull())
    steps = pit.running(full.select(key, other, F.unix_micros("recorded_at").alias("at"), "recorded_at", "amount_idr"), [key, other], [("total", "sum", F.col("amount_idr"))])
    steps = steps.groupBy(key, other, "recorded_at").agg(F.max("total").alias("total"))
    before = pit.as_of(ledger.where(F.col(key).isNotNull()), [key], [("_m", "max", F.col("total"))], history=steps, strict=True)
    tops = top_two(steps.select(key, F.col("recorded_at").alias("occurred_at"), "total", F.col(other).alias("_o")), [key, "occurred_at"], "total", "_o")
    rows = ledger.select("donation_id", key, other, "occurred_at", "recorded_at", "amount_idr").join(tops, [key, "occurred_at"], "left")
    others = F.when(F.col(other).isNull() | (F.col("_who") != F.col(other)), F.col("_top")).otherwise(F.col("_second"))
    rows = rows.where(F.col(key).isNotNull()).select("donation_id", others.alias("_s"), F.when(pit.sees_itself(), F.col("amount_idr")).otherwise(0).alias("_own"))
    pair = pit.as_of(ledger, [key, other], [("_p", "sum", F.col("amount_idr"))])
    out = pit.together(before, rows, pair)
    mine = F.when(F.col("_p") > F.col("_own"), F.col("_p") - F.col("_own"))
    return out.select("donation_id", F.greatest("_m", "_s", mine).cast("long").alias(name))


def window_ids(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Each row once for every accumulation window that holds its day: its year, and each campaign period."""
    day = F.to_date("occurred_at")
    year = rows.withColumn("win", F.concat(F.lit("y"), F.year(day)))
    p = small(periods.select(F.concat(F.lit("c"), "start", F.lit(":"), "end").alias("win"), F.col("start").alias("_from"), F.col("end").alias("_to")).distinct())
    return year.unionByName(rows.join(p, day.between(F.col("_from"), F.col("_to"))).drop("_from", "_to"))


def window_of() -> Column:
    """The accumulation window of a row with contexts: its period, its year, or null."""
    return F.when(F.col("regime") == "campaign", F.concat(F.lit("c"), "period_start", F.lit(":"), "period_end")).when(F.col("regime") == "party_annual", F.concat(F.lit("y"), F.year("occurred_at")))


def window_totals(ctx: DataFrame, periods: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(donation_id, <name>_n, <name>_total): other rows of the keys in the row's accumulation window known at the time."""
    history = window_ids(ctx.select(*keys, "occurred_at", "recorded_at", "amount_idr"), periods)
    probes = pit.with_own(ctx.withColumn("win", window_of()))
    found = pit.as_of(probes, [*keys, "win"], [("n", "count", F.col("amount_idr")), ("s", "sum", F.col("amount_idr"))], history=history, carry=["_self", "_own"])
    return found.select("donation_id", (F.col("n") - F.col("_self")).cast("long").alias(f"{name}_n"), (F.col("s") - F.col("_own")).cast("long").alias(f"{name}_total"))


def _square(x: str) -> Column:
    return F.col(x).cast("decimal(19,0)") * F.col(x).cast("decimal(18,0)")


def receiver_windows(ctx: DataFrame) -> DataFrame:
    """Amounts over 30 days before each row, with the row itself as history has it and without it, and the greatest of 14 days."""
    slim = ctx.select("donation_id", "receiver_id", "occurred_at", "recorded_at", "amount_idr")
    key, a = {"receiver_id": "receiver_id"}, F.col("amount_idr")
    probes = slim.withColumn("_me", F.when(pit.sees_itself(), 1).otherwise(0))
    found = pit.sliding(probes, slim, key, 30, {"n": F.lit(1), "s": a, "q": _square("amount_idr")}, carry=["amount_idr", "_me"])
    me = F.col("_me")
    others = F.col("n") - me
    some = lambda x: F.when(others > 0, x)
    out = found.where("n > 0").select(
        "donation_id", F.col("n").alias("r30_n"), F.col("s").alias("r30_sum"), F.col("q").alias("r30_squares"), others.alias("r30_other_n"),
        some(F.col("s") - me * a).alias("r30_other_sum"), some(F.col("q") - F.when(me == 1, _square("amount_idr")).otherwise(0)).alias("r30_other_squares"),
    )
    return pit.together(out, pit.sliding_max(slim, slim, key, 14, a, "r14_max"))


def fresh_senders(ctx: DataFrame, days: int, own: bool) -> DataFrame:
    """(donation_id, d<days>_senders, d<days>_fresh): distinct senders to the receiver, and those without history before the window.

    ``own`` adds the row's own sender; without it the row itself is not part of its history.
    """
    slim = ctx.select("donation_id", "sender_id", "receiver_id", "occurred_at", "recorded_at").where("receiver_id is not null")
    probes = slim.withColumns({"_at": F.unix_micros("occurred_at"), "_me": pit.sees_itself(), "_named": F.col("sender_id").isNotNull()})
    seen = pit.sliding_distinct(probes, ctx, "receiver_id", "sender_id", days, "n", "f", carry=["_at", "_me", "_named"])
    pair = pit.sliding(slim, ctx, {"sender_id": "sender_id", "receiver_id": "receiver_id"}, days, {"p": F.lit(1)})
    old = slim.join(pit.old_from(ctx, "sender_id", days).withColumnRenamed("party", "sender_id"), "sender_id").select("donation_id", "_old")
    rows = pit.together(seen, pair, old)
    new = F.col("_at") < F.col("_old")
    p = F.coalesce("p", F.lit(0))
    if own:  # one more, unless history holds the row's own sender already
        change = F.when(F.col("_named") & (p == 0), 1).otherwise(0)
    else:  # one less, if only the row itself brings its sender in
        change = F.when(F.col("_named") & F.col("_me") & (p == 1), -1).otherwise(0)
    n, f = F.coalesce("n", F.lit(0)) + change, F.coalesce("f", F.lit(0)) + F.when(new, change).otherwise(0)
    return rows.select("donation_id", n.cast("long").alias(f"d{days}_senders"), f.cast("long").alias(f"d{days}_fresh")).where(F.col(f"d{days}_senders") > 0)


def sender_windows(ctx: DataFrame) -> DataFrame:
    """Counts of 30 and 90 days, with and without the row, and distinct receivers of 14 days with the row's own."""
    slim = ctx.select("donation_id", "sender_id", "receiver_id", "occurred_at", "recorded_at")
    key = {"sender_id": "sender_id"}
    probes = slim.withColumns({"_me": F.when(pit.sees_itself(), 1).otherwise(0), "_named": F.col("receiver_id").isNotNull()})
    counts = pit.sliding_each(probes, slim, key, {d: {f"s{d}": F.lit(1)} for d in (30, 90)}, carry=["_me", "_named"])
    near = pit.sliding_distinct(slim, slim, "sender_id", "receiver_id", 14, "_near")
    pair = pit.sliding(slim, slim, {"sender_id": "sender_id", "receiver_id": "receiver_id"}, 14, {"_pair": F.lit(1)})
    rows = pit.together(counts, near, pair)
    zero = lambda c: F.coalesce(c, F.lit(0))
    me = F.col("_me")
    more = F.when(F.col("_named") & (zero("_pair") == 0), 1).otherwise(0)
    return rows.select(
        "donation_id", zero("s30").alias("s30"), zero("s90").alias("s90"), (zero("s30") - me).alias("s30_other"), (zero("s90") - me).alias("s90_other"), (zero("_near") + more).cast("long").alias("s14_receivers")
    )


def inflows(ctx: DataFrame, latest: bool = True) -> DataFrame:
    """What reached the sender in 7 and 30 days, and when the last of 7 days did; null where nothing did."""
    slim = ctx.select("donation_id", "sender_id", "receiver_id", "occurred_at", "recorded_at", "amount_idr")
    key = {"sender_id": "receiver_id"}
    found = pit.sliding_each(slim, slim, key, {d: {f"n{d}": F.lit(1), f"s{d}": F.col("amount_idr")} for d in (7, 30)})
    found = found.select("donation_id", *[F.when(F.col(f"n{d}") > 0, F.col(f"s{d}")).alias(f"in{d}_total") for d in (7, 30)])
    return pit.together(found, *([pit.latest(slim, slim, key, 7, "in7_latest")] if latest else []))


def deadline_counts(ctx: DataFrame, hours: int = 72, days: int = 30) -> DataFrame:
    """Rows inside the window before a deadline: the receiver's rows in the window so far, and in the baseline before it."""
    end = F.timestamp_micros(F.unix_micros(F.date_add("next_deadline", 1).cast("timestamp")) - 1)
    opens = F.timestamp_micros(F.unix_micros(end) - hours * 3_600_000_000)
    rows = ctx.where("next_deadline is not null and receiver_id is not null").withColumns({"_end": end, "_open": opens}).where("occurred_at between _open and _end")
    # a row of history once for each deadline whose window or baseline holds it: deadlines are few
    ends = small(rows.select(F.col("_end").alias("_e"), F.col("_open").alias("_o"), F.timestamp_micros(F.unix_micros("_end") - days * pit.DAY).alias("_b")).distinct())
    held = ctx.where("receiver_id is not null").select("receiver_id", "occurred_at", "recorded_at").join(ends, F.col("occurred_at").between(F.col("_b"), F.col("_e")))
    held = held.select("receiver_id", F.col("_e").alias("_end"), "recorded_at", F.when(F.col("occurred_at") >= F.col("_o"), 1).alias("_in"), F.when(F.col("occurred_at") <= F.col("_o"), 1).alias("_before"))
    n = pit.as_of(rows, ["receiver_id", "_end"], [("dl_in", "count", F.col("_in")), ("dl_base", "count", F.col("_before"))], history=held)
    return n.select("donation_id", F.coalesce("dl_in", F.lit(0)).alias("dl_in"), F.coalesce("dl_base", F.lit(0)).alias("dl_base"))


def _blocks(periods: DataFrame) -> dict:
    return {
        "sender": lambda c: pit.prior_totals(c, ["sender_id"], "sender"),
        "receiver": lambda c: pit.prior_totals(c, ["receiver_id"], "receiver"),
        "pair": lambda c: pit.prior_totals(c, ["sender_id", "receiver_id"], "pair"),
        "pair_win": lambda c: window_totals(c, periods, ["sender_id", "receiver_id"], "pair_win"),
        "sender_win": lambda c: window_totals(c, periods, ["sender_id"], "sender_win"),
        "receiver_win": lambda c: window_totals(c, periods, ["receiver_id"], "receiver_win"),
        "receiver_windows": receiver_windows,
        "fresh": lambda c: fresh_senders(c, 14, True),
        "sender_windows": sender_windows,
        "inflows": lambda c: inflows(c, latest=False),
        "deadlines": deadline_counts,
    }


#: The blocks that each kind of test reads.
NEEDS = {
    "aggregate_threshold": ("pair_win", "sender_win"),
    "fan_in_burst": ("fresh", "receiver_windows"),
    "fan_out": ("sender_windows",),
    "pass_through": ("inflows",),
    "self_funded_inflow": ("inflows",),
    "velocity_spike": ("sender_windows",),
    "amount_homogeneity": ("receiver_windows",),
    "thin_donor": ("sender",),
    "donor_concentration": ("receiver", "pair", "receiver_win", "pair_win"),
    "deadline_clustering": ("deadlines",),
}


def rule_facts(ctx: DataFrame, periods: DataFrame, kinds: Sequence[str] | None = None, more: Sequence[DataFrame] = ()) -> DataFrame:
    """``ctx`` with the measures that rules of these kinds read (None: all), and the columns of ``more`` (by donation_id).

    Blocks are written one by one, so that no plan holds the shuffles of all.
    """
    made = _blocks(periods)
    wanted = list(made) if kinds is None else dict.fromkeys(b for k in kinds for b in NEEDS.get(k, ()))
    parts = [*[made[name](ctx) for name in wanted], *more]
    if len(parts) > 1:
        parts = [scratch.written(p, "block") for p in parts]
    return ctx.join(pit.together(*parts), "donation_id", "left") if parts else ctx
