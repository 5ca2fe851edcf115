"""Point-in-time aggregates: what was knowable about a party when a transfer happened.

Two forms carry everything. *Running* aggregates answer "all history up to t" with windows and no
self-join: recorded_at >= occurred_at makes visibility one-dimensional, so knowledge events (at
recorded_at) and probe events (at occurred_at) are one stream per key. A key with more than HUB_ROWS events
is cut into stretches of about that many, from a count of its events by hour: totals of the stretches run over few rows,
rows run inside their stretch, so a hub's history is spread over tasks. *Sliding* aggregates answer "the last k
days" in the same way: a row of history is visible from its recording until k days after its occurrence, so it is added
at the one and taken off after the other; distinct counterparties are counted by the unions of their rows' intervals. A
greatest value cannot be taken off again: its interval is cut at one dyadic boundary of time, into the end of one slot and
the start of the next, and there it is a running maximum from the left or from the right (``interval_max``). Both bounds
are inclusive, and ties are visible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.sources import scratch

DAY = 86_400_000_000
#: Events of one key that a task orders at once; a key with more is cut.
HUB_ROWS = 1_000_000
_COMBINE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
Measure = tuple[str, str, Column]


def snapshot(ledger: DataFrame, at: Column) -> DataFrame:
    """Rows that happened and were recorded by one instant."""
    return ledger.where((F.col("occurred_at") <= at) & (F.col("recorded_at") <= at))


def running(events: DataFrame, keys: Sequence[str], measures: Sequence[Measure], strict: bool = False, hub_rows: int | None = None) -> DataFrame:
    """``events`` (keys, at in microseconds, values) with each measure over the key's events up to and including ``at``.

    ``strict`` leaves out events at the same instant. Measures are (name, sum | count | min | max, value);
    values that are null (as on probe events) do not count. Events without all keys are left out. A key's events of one
    hour are not cut. Whether a key has more than HUB_ROWS is counted when this is called. Whether there are such keys is counted when this is called.
    """
    most = HUB_ROWS if hub_rows is None else hub_rows
    rows = events.where(" and ".join(f"{k} is not null" for k in keys)).withColumns({f"_v{i}": value for i, (_, _, value) in enumerate(measures)})
    hubs = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*keys)
    upto = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    whole = lambda how, c: F.coalesce(c, F.lit(0)) if how in ("sum", "count") else c
    shown = [*events.columns, *[whole(how, _AGG[how](f"_v{i}").over(upto)).alias(name) for i, (name, how, _) in enumerate(measures)]]
    if not hubs.limit(1).count():
        return rows.select(*shown)
    hubs = scratch.written(hubs, "hubs")
    plain = rows.join(hubs, list(keys), "left_anti").select(*shown)

    # hubs: stretches of about ``most`` events, whose totals are carried into the next
    hour, b = "_hour", "_bucket"
    large = rows.join(hubs, list(keys), "left_semi").withColumn(hour, F.floor(F.col("at") / F.lit(3_600_000_000)))
    before = Window.partitionBy(*keys).orderBy(hour).rowsBetween(Window.unboundedPreceding, -1)
    each = large.groupBy(*keys, hour).agg(F.count(F.lit(1)).alias("_n"))
    stretch = each.select(*keys, hour, F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / F.lit(most)).alias(b))
    large = large.join(stretch, [*keys, hour])
    totals = large.groupBy(*keys, b).agg(*[_AGG[how](f"_v{i}").alias(f"_t{i}") for i, (_, how, _) in enumerate(measures)])
    earlier = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    again = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    offsets = totals.select(*keys, b, *[again[how](f"_t{i}").over(earlier).alias(f"_o{i}") for i, (_, how, _) in enumerate(measures)])
    inside = Window.partitionBy(*keys, b).orderBy("at").rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    cut = large.join(offsets, [*keys, b]).select(
        *events.columns, *[_COMBINE[how](F.col(f"_o{i}"), _AGG[how](f"_v{i}").over(inside)).alias(name) for i, (name, how, _) in enumerate(measures)]
    )
    return plain.unionByName(cut)


def together(*parts: DataFrame) -> DataFrame:
    """The columns of all parts (donation_id and columns of their own, a row per transfer at most) side by side, null where a part has no row.

    One exchange and one aggregate for any number of parts: joined one by one, each would bring a sort and a shuffle read of its own
    into the same task, whose memory then grows with their number.
    """
    if len(parts) == 1:
        return parts[0]
    kinds = {f.name: f.dataType for p in parts for f in p.schema if f.name != "donation_id"}
    out = None
    for p in parts:
        wide = p.select("donation_id", *[F.col(c) if c in p.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
        out = wide if out is None else out.union(wide)
    return out.groupBy("donation_id").agg(*[F.max(c).alias(c) for c in kinds])


def _carried(probes: DataFrame, carry: Sequence[str], of: bool) -> list[Column]:
    """The columns that probes keep; typed nulls on facts."""
    return [F.col(c) if of else F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in carry]


def as_of(ledger: DataFrame, keys: Sequence[str], measures: Sequence[Measure], history: DataFrame | None = None, strict: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(donation_id, measures, carry) for each row of ``ledger`` whose keys are known, over what was recorded when it occurred.

    A row sees itself if it was recorded when it occurred; callers that exclude it subtract it. ``history``
    (keys, recorded_at, and the values that the measures read) replaces the ledger as what is known. ``carry`` names columns of
    the rows that come back with them, which saves a join.
    """
    known = None
    for k in keys:
        known = F.col(k).isNotNull() if known is None else known & F.col(k).isNotNull()
    names = [m[0] for m in measures]
    source = (ledger if history is None else history).where(known)
    facts = source.select(*keys, F.unix_micros("recorded_at").alias("at"), F.lit(None).cast(ledger.schema["donation_id"].dataType).alias("donation_id"), *[v.alias(f"_x{i}") for i, (_, _, v) in enumerate(measures)], *_carried(ledger, carry, False))
    probes = ledger.where(known).select(*keys, F.unix_micros("occurred_at").alias("at"), "donation_id", *[F.lit(None).cast(facts.schema[f"_x{i}"].dataType).alias(f"_x{i}") for i in range(len(measures))], *_carried(ledger, carry, True))
    events = facts.unionByName(probes)
    found = running(events, keys, [(n, how, F.col(f"_x{i}")) for i, (n, how, _) in enumerate(measures)], strict)
    return found.where(F.col("donation_id").isNotNull()).select("donation_id", *names, *carry)


def sees_itself() -> Column:
    return F.col("recorded_at") == F.col("occurred_at")


def with_own(ledger: DataFrame) -> DataFrame:
    """``ledger`` with what a row adds to a history in which it sees itself: _self (0 or 1) and _own (its amount or 0)."""
    me = F.when(sees_itself(), 1).otherwise(0)
    return ledger.withColumns({"_self": me, "_own": me * F.col("amount_idr")})


def prior_totals(ledger: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """(donation_id, <prefix>_count, <prefix>_total): other rows of the same keys known at the time."""
    found = as_of(with_own(ledger), keys, [("n", "count", F.col("amount_idr")), ("s", "sum", F.col("amount_idr"))], carry=["_self", "_own"])
    return found.select("donation_id", (F.col("n") - F.col("_self")).cast("long").alias(f"{prefix}_count"), (F.col("s") - F.col("_own")).cast("long").alias(f"{prefix}_total"))


def first_pairs(ledger: DataFrame, key: str, other: str) -> DataFrame:
    """When each pair was first recorded: one knowledge event per pair."""
    return ledger.where(F.col(key).isNotNull() & F.col(other).isNotNull()).groupBy(key, other).agg(F.min("recorded_at").alias("recorded_at"))


def distinct_known(ledger: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """(donation_id, name): distinct counterparties of ``key`` known at the time, the row's own included if it sees itself."""
    return as_of(ledger, [key], [(name, "count", F.col(other))], history=first_pairs(ledger, key, other))


def first_seen(ledger: DataFrame, key: str = "sender_id") -> DataFrame:
    """(donation_id, first_seen): the earliest occurrence of the party known at the time."""
    return as_of(ledger, [key], [("first_seen", "min", F.col("occurred_at"))])


def _probed(probes: DataFrame, facts: DataFrame, on: dict[str, str], measures: Sequence[tuple[str, str]], carry: Sequence[str] = ()) -> DataFrame:
    """(donation_id, measures, carry) at each probe's occurrence over ``facts`` (history keys, at, and a column per measure)."""
    names = [n for n, _ in measures]
    kind = probes.schema["donation_id"].dataType
    known = facts.select(*[F.col(h).alias(f"_k{i}") for i, h in enumerate(on.values())], "at", F.lit(None).cast(kind).alias("donation_id"), *[F.col(n).alias(f"_x{n}") for n in names], *_carried(probes, carry, False))
    asks = probes.select(*[F.col(p).alias(f"_k{i}") for i, p in enumerate(on)], F.unix_micros("occurred_at").alias("at"), "donation_id", *[F.lit(None).cast(facts.schema[n].dataType).alias(f"_x{n}") for n in names], *_carried(probes, carry, True))
    keys = [f"_k{i}" for i in range(len(on))]
    events = known.unionByName(asks).where(" and ".join(f"{k} is not null" for k in keys))
    found = running(events, keys, [(n, how, F.col(f"_x{n}")) for n, how in measures])
    return found.where("donation_id is not null").select("donation_id", *names, *carry)


def _visible(history: DataFrame, days: int) -> DataFrame:
    """``history`` with the microseconds in which a look-back of ``days`` sees a row: from ``_from`` until before ``_until``."""
    rows = history.withColumns({"_from": F.unix_micros("recorded_at"), "_until": F.unix_micros("occurred_at") + days * DAY + 1})
    return rows.where("_from < _until")


def _edges(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Each interval as two facts: its values at its start, and taken off at its end."""
    both = rows.withColumns({f"_{n}": v for n, v in values.items()}).withColumn("_e", F.explode(F.array(F.struct(F.col("_from").alias("at"), F.lit(True).alias("on")), F.struct(F.col("_until").alias("at"), F.lit(False).alias("on")))))
    return both.withColumns({"at": F.col("_e.at"), **{n: F.when(F.col("_e.on"), F.col(f"_{n}")).otherwise(-F.col(f"_{n}")) for n in values}})


def sliding(probes: DataFrame, history: DataFrame, on: dict[str, str], days: int, values: dict[str, Column], carry: Sequence[str] = ()) -> DataFrame:
    """(donation_id, values, carry): sums over the history rows of the last ``days`` days, known at the time; no pairs.

    ``on`` maps probe columns to history columns; a count is the sum of ``lit(1)``. A probe sees itself where it was
    recorded when it occurred. Probes with a null key are left out.
    """
    return _probed(probes, _edges(_visible(history, days), values), on, [(n, "sum") for n in values], carry)


def sliding_each(probes: DataFrame, history: DataFrame, on: dict[str, str], windows: dict[int, dict[str, Column]], carry: Sequence[str] = ()) -> DataFrame:
    """``sliding`` for several windows (days: values) of the same keys, in one pass."""
    names = [n for values in windows.values() for n in values]
    facts = None
    for days, values in windows.items():
        edges = _edges(_visible(history, days), values)
        edges = edges.select(*on.values(), "at", *[F.col(n).cast("decimal(38,0)").alias(n) if n in values else F.lit(None).cast("decimal(38,0)").alias(n) for n in names])
        facts = edges if facts is None else facts.unionByName(edges)
    found = _probed(probes, facts, on, [(n, "sum") for n in names], carry)
    return found.select("donation_id", *[F.col(n).cast("long").alias(n) for n in names], *carry)


def latest(probes: DataFrame, history: DataFrame, on: dict[str, str], days: int, name: str) -> DataFrame:
    """(donation_id, name): the last occurrence among the history rows of the last ``days`` days, known at the time."""
    facts = history.withColumns({"at": F.unix_micros("recorded_at"), name: F.col("occurred_at")})
    found = _probed(probes, facts, on, [(name, "max")], ["occurred_at"])
    return found.select("donation_id", F.when(F.unix_micros(name) >= F.unix_micros("occurred_at") - days * DAY, F.col(name)).alias(name))


def unions(rows: DataFrame, key: str, other: str) -> DataFrame:
    """(key, other, _from, _until): the unions of the intervals (_from until before _until) of each pair; they do not touch.

    Equal intervals are one; a pair's intervals are run through in order by ``running``, which cuts hubs.
    """
    spans = rows.where(F.col(key).isNotNull() & F.col(other).isNotNull()).select(key, other, "_from", "_until").where("_from < _until").groupBy(key, other, "_from").agg(F.max("_until").alias("_until"))
    events = spans.withColumn("at", F.col("_from"))
    seen = running(scratch.written(events, "spans"), [key, other], [("_before", "max", F.col("_until"))], strict=True)
    new = seen.withColumn("_new", F.coalesce(F.col("_from") > F.col("_before"), F.lit(True)).cast("int"))
    numbered = running(scratch.written(new, "stays"), [key, other], [("_stay", "sum", F.col("_new"))])
    return numbered.groupBy(key, other, "_stay").agg(F.min("_from").alias("_from"), F.max("_until").alias("_until")).drop("_stay")


def stays(history: DataFrame, key: str, other: str, days: int) -> DataFrame:
    """(key, other, _from, _until): the unions of the intervals in which a look-back sees rows of a pair."""
    return unions(_visible(history, days), key, other)


def distinct_at(probes: DataFrame, spans: DataFrame, on: tuple[str, str], other: str, name: str) -> DataFrame:
    """(donation_id, name): the distinct ``other`` of the spans (_from, _until) that hold a probe's instant, by (probe key, span key)."""
    return _probed(probes, _edges(unions(spans, on[1], other), {name: F.lit(1)}), {on[0]: on[1]}, [(name, "sum")])


def old_from(history: DataFrame, key: str, days: int) -> DataFrame:
    """(party, _old): the microsecond from which a party is known to have given before the last ``days`` days."""
    at = F.greatest(F.unix_micros("recorded_at"), F.unix_micros("occurred_at") + days * DAY + 1)
    return history.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("party")).agg(F.min(at).alias("_old"))


def sliding_distinct(probes: DataFrame, history: DataFrame, key: str, other: str, days: int, name: str, fresh: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(donation_id, name, fresh, carry): distinct ``other`` of ``key`` in the last ``days`` days, and those not known to have given before."""
    spans = stays(history, key, other, days)
    if fresh is None:
        return _probed(probes, _edges(spans, {name: F.lit(1)}), {key: key}, [(name, "sum")], carry)
    old = spans.join(old_from(history, other, days), F.col(other) == F.col("party"))
    new = old.select(key, "_from", F.least("_until", "_old").alias("_until"), F.lit(0).alias("_all"), F.lit(1).alias("_fresh")).where("_from < _until")
    both = spans.select(key, "_from", "_until", F.lit(1).alias("_all"), F.lit(0).alias("_fresh")).unionByName(new)
    return _probed(probes, _edges(both, {name: F.col("_all"), fresh: F.col("_fresh")}), {key: key}, [(name, "sum"), (fresh, "sum")], carry)


def interval_max(probes: DataFrame, spans: DataFrame, on: dict[str, str], name: str, bits: int) -> DataFrame:
    """(donation_id, name): the greatest ``_v`` of the spans (_from, until before _until) that hold a probe's instant; no pairs.

    Spans last 2^``bits`` microseconds at most. One that crosses a boundary between two dyadic slots of time (the coarsest
    that it crosses, or the one of 2^bits) is seen at the end of the left slot from its start on, and at the start of the right slot until
    its end: running maxima in either direction. A probe looks into one slot of each size that its key's spans need.
    """
    keys, parts = list(on), list(on.values())
    spans = spans.where("_from < _until").where(" and ".join(f"{h} is not null" for h in parts))
    both = F.col("_from").bitwiseXOR(F.col("_until") - 1)
    size = F.when(both < 0, bits).when(both == 0, 0).otherwise(F.least(F.length(F.bin(both)) - 1, F.lit(bits)))
    cut = spans.withColumn("_size", size)
    piece = lambda side, at, edge: F.struct(F.lit(side).alias("_side"), F.expr(f"shiftright({edge}, _size)").alias("_slot"), at.alias("at"))
    facts = cut.select(
        *[F.col(h).alias(f"_k{i}") for i, h in enumerate(parts)], "_size", "_v", F.inline(F.array(piece(0, F.col("_from"), "_from"), piece(1, -F.col("_until"), "_until - 1")))
    )
    ids = [f"_k{i}" for i in range(len(keys))]
    used = facts.groupBy(*ids).agg(F.collect_set("_size").alias("_sizes"))  # as many as there are sizes: 64 at most
    t = F.unix_micros("occurred_at")
    asks = probes.select(*[F.col(p).alias(f"_k{i}") for i, p in enumerate(keys)], t.alias("_t"), "donation_id").join(used, ids)
    asks = asks.select("*", F.explode("_sizes").alias("_size")).withColumn("_slot", F.expr("shiftright(_t, _size)"))
    sides = F.when(F.col("_size").isin(0, bits), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("_slot").bitwiseAND(F.lit(1)).cast("int")))
    asks = asks.select(*ids, "_size", "_slot", F.explode(sides).alias("_side"), "_t", "donation_id").withColumn("at", F.when(F.col("_side") == 0, F.col("_t")).otherwise(-F.col("_t") - 1))
    kind = probes.schema["donation_id"].dataType
    columns = [*ids, "_size", "_slot", "_side", "at"]
    events = facts.select(*columns, "_v", F.lit(None).cast(kind).alias("donation_id")).unionByName(asks.select(*columns, F.lit(None).cast(facts.schema["_v"].dataType).alias("_v"), "donation_id"))
    found = running(events, columns[:-1], [("_m", "max", F.col("_v"))])
    return found.where("donation_id is not null and _m is not null").groupBy("donation_id").agg(F.max("_m").alias(name))


def sliding_max(probes: DataFrame, history: DataFrame, on: dict[str, str], days: int, value: Column, name: str) -> DataFrame:
    """(donation_id, name): the greatest value in the last ``days`` days, known at the time; rows without any are left out."""
    spans = _visible(history, days).select(*on.values(), "_from", "_until", value.alias("_v")).where("_v is not null")
    return interval_max(probes, spans, on, name, (days * DAY + 1).bit_length())


def lookback(probes: DataFrame, history: DataFrame, on: dict[str, str], days: int, include_self: bool = True) -> DataFrame:
    """Pairs of a probe and a history row (columns prefixed ``h_``) of the last ``days`` days, both ends included.

    ``on`` maps probe columns to history columns. Time buckets of days + 1 make it an equi-join; a probe
    looks into its own bucket and the one before, so candidates are bounded by two windows.
    """
    width = F.lit((days + 1) * DAY)
    bucket = lambda c: F.floor(F.unix_micros(c) / width)
    left = probes.withColumn("_b", F.explode(F.array(bucket(F.col("occurred_at")), bucket(F.col("occurred_at")) - 1)))
    right = history.select(*[F.col(c).alias(f"h_{c}") for c in history.columns]).withColumn("h__b", bucket(F.col("h_occurred_at")))
    near = (F.col("_b") == F.col("h__b"))
    for p, h in on.items():
        near &= F.col(p) == F.col(f"h_{h}")
    near &= (F.col("h_occurred_at") <= F.col("occurred_at")) & (F.col("h_recorded_at") <= F.col("occurred_at"))
    near &= F.unix_micros("h_occurred_at") >= F.unix_micros("occurred_at") - days * DAY
    if not include_self:
        near &= F.col("h_donation_id") != F.col("donation_id")
    return left.join(right, near).drop("_b", "h__b")


def replay(ledger: DataFrame) -> DataFrame:
    """Every row with what its sender's history held when it happened; order by (recorded_at, donation_id)."""
    return ledger.select("donation_id", "recorded_at", "occurred_at").join(prior_totals(ledger, ["sender_id"], "sender"), "donation_id", "left")
