"""Boxes of time and amount: whether one holds a row, and how many parties the fullest box of a moment holds. No pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.sources import scratch

from . import pit

#: Amounts below are cells of their own; above, a cell is a step of the logarithm.
SINGLE = 64
STEP = 0.13
#: Rows that a call of the sweep gets; a larger part of a key has a call of its own.
BUNDLE = 50_000


def amount_cell(a: Column, step: float = STEP) -> Column:
    return F.when(a < SINGLE, a).otherwise(F.lit(SINGLE) + F.floor((F.ln(a) - F.lit(math.log(SINGLE))) / F.lit(step)))


def hit(asks: DataFrame, points: DataFrame, days: int) -> DataFrame:
    """The ids of the asks (id, key, t1, lo, hi) whose box t1 <= at <= t1 + ``days`` days, lo <= amount <= hi holds one of ``points`` (key, at, amount).

    Times are in microseconds; a box of amounts over SINGLE spans two steps or more. Time is cut into slots of half
    the box, so a box is the end of one slot, a whole one and the start of a third, and likewise a few cells of amounts of which the
    first and the last are cut. In a cut slot the greatest and the least amount so far (from the left or from the right) tell
    whether a row lies inside; in the whole one those of the cell do. Work is linear in asks and points.
    """
    slot = days * pit.DAY // 2
    of = lambda t: F.floor(t / F.lit(slot))
    rows = points.where("key is not null and amount > 0").select("key", "at", "amount", of(F.col("at")).alias("_slot"), amount_cell(F.col("amount")).alias("_cell"))
    first, last = amount_cell(F.col("lo")), amount_cell(F.col("hi"))
    wide = asks.where("key is not null and hi >= lo and lo > 0").withColumns({"_first": first, "_last": last, "_slot": of(F.col("t1"))}).withColumn("_cell", F.explode(F.sequence("_first", "_last")))
    inside = F.col("_top").isNotNull() & ((F.col("_cell") > F.col("_first")) | (F.col("_top") >= F.col("lo"))) & ((F.col("_cell") < F.col("_last")) | (F.col("_low") <= F.col("hi")))
    cells = ["key", "_slot", "_cell"]
    whole = rows.groupBy(*cells).agg(F.max("amount").alias("_top"), F.min("amount").alias("_low"))
    middle = wide.withColumn("_slot", F.col("_slot") + 1).join(whole, cells).where(inside).select("id")

    back = lambda flag, at, slot: F.struct(F.lit(flag).alias("_back"), at.alias("at"), slot.alias("_slot"))
    t1, s = F.col("t1"), F.col("_slot")
    facts = rows.select("key", "_cell", "amount", F.inline(F.array(back(False, F.col("at"), s), back(True, -F.col("at"), s))))
    ends = wide.select("id", "key", "_cell", "_first", "_last", "lo", "hi", F.inline(F.array(back(True, -t1, s), back(False, t1 + days * pit.DAY, s + 2))))
    extra = ["id", "_first", "_last", "lo", "hi"]
    none = lambda df, c, like: F.lit(None).cast(like.schema[c].dataType).alias(c)
    both = facts.select("key", "_slot", "_cell", "_back", "at", "amount", *[none(facts, c, ends) for c in extra]).unionByName(ends.select("key", "_slot", "_cell", "_back", "at", none(ends, "amount", facts), *extra))
    met = pit.running(both, ["key", "_slot", "_cell", "_back"], [("_top", "max", F.col("amount")), ("_low", "min", F.col("amount"))])
    return middle.unionByName(met.where(F.col("id").isNotNull() & inside).select("id")).distinct()


def divisors(y: Column, low: float, high: float) -> tuple[Column, Column]:
    """The least and the greatest whole number x with y / x in [low, high], as doubles divide (y under 2^53)."""
    a, b = F.ceil(y / F.lit(high)), F.floor(y / F.lit(low))
    least = F.when((a > 1) & (F.try_divide(y, a - 1) <= high), a - 1).when(F.try_divide(y, a) <= high, a).otherwise(a + 1)
    most = F.when(y / (b + 1) >= low, b + 1).when(F.try_divide(y, b) >= low, b).otherwise(b - 1)
    return least, most


def dividends(x: Column, low: float, high: float) -> tuple[Column, Column]:
    """The least and the greatest whole number y with y / x in [low, high], as doubles divide (x under 2^53)."""
    a, b = F.ceil(x * F.lit(low)), F.floor(x * F.lit(high))
    least = F.when(F.try_divide(a - 1, x) >= low, a - 1).when(F.try_divide(a, x) >= low, a).otherwise(a + 1)
    most = F.when(F.try_divide(b + 1, x) <= high, b + 1).when(F.try_divide(b, x) <= high, b).otherwise(b - 1)
    return least, most


class Counts:
    """Counts over places 0..n-1: add to a range, read the greatest, each in about the root of n."""

    def __init__(self, n: int) -> None:
        self.b = math.isqrt(n) + 1
        blocks = -(-n // self.b)
        self.each = np.zeros(blocks * self.b, np.int64).reshape(blocks, self.b)
        self.top, self.all = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)

    def add(self, lo: int, hi: int, by: int) -> None:
        if lo >= hi:
            return
        (i, a), (j, z) = divmod(lo, self.b), divmod(hi - 1, self.b)
        if i == j:
            self.each[i, a : z + 1] += by
        else:
            self.each[i, a:] += by
            self.each[j, : z + 1] += by
            self.all[i + 1 : j] += by
            self.top[j] = self.each[j].max()
        self.top[i] = self.each[i].max()

    def greatest(self) -> int:
        return int((self.top + self.all).max())


def fullest(gifts: DataFrame, days: int, spread: float, least: int) -> DataFrame:
    """(key, _from, _until, _v): when the fullest box that starts at a moment holds ``least`` parties or more, and how many.

    ``gifts``: key, party, at (microseconds, one for each key and party), amount. A box holds ``days`` days from its moment and amounts
    from x to ``spread`` * x; a party counts once in it. A sweep over the moments keeps for each x the number of parties: a gift counts for moments
    up to ``days`` before it and for x from its amount / ``spread`` up to it, but over the party's next smaller amount (which counts instead). Keys are
    cut by time and amount, and parts with too few gifts are dropped before; a sweep takes n * sqrt(n) for the gifts of a key in
    two windows and two steps of amount.
    """
    width, step = days * pit.DAY, math.log(spread) * 1.2
    before = F.lag("amount").over(Window.partitionBy("key", "party").orderBy("amount"))
    rows = gifts.where("key is not null and amount >= 0").distinct().withColumn("before", before)
    cell = F.when(F.col("amount") == 0, F.lit(-10)).otherwise(F.floor(F.ln("amount") / F.lit(step)))
    slot = lambda t: F.floor(t / F.lit(width))
    parts = rows.withColumn("own", cell).withColumn("slot", F.explode(F.array_distinct(F.array(slot(F.col("at")), slot(F.col("at") - width))))).withColumn("cell", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    ids = ["key", "slot", "cell"]
    full = scratch.written(parts.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least), "full")
    total = full.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    bundles = max(int(gifts.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUNDLE)  # small parts share a task's call
    parts = parts.join(full.select(*ids), ids, "left_semi").withColumn("bundle", F.pmod(F.xxhash64(*ids), F.lit(bundles)))

    def sweep(begin: int, y: np.ndarray, at: np.ndarray, smaller: np.ndarray, own: np.ndarray) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        xs = np.unique(y[own])
        if not len(xs):
            return out
        lo, hi = np.searchsorted(xs * spread, y, side="left"), np.searchsorted(xs, y, side="right")
        lo = np.maximum(lo, np.searchsorted(xs, smaller, side="right")).tolist()
        hi, counts, n, end = hi.tolist(), Counts(len(xs)), len(y), begin + width
        moments = np.concatenate((np.maximum(at - width, begin), at + 1))
        order = np.argsort(moments, kind="stable").tolist()
        moments = moments.tolist()
        for k, i in enumerate(order):
            t = moments[i]
            if t >= end:
                break
            counts.add(lo[i % n], hi[i % n], 1 if i < n else -1)
            later = min(moments[order[k + 1]], end) if k + 1 < len(order) else end
            if later > t and (v := counts.greatest()) >= least:
                if out and out[-1][1:] == (t, v):
                    out[-1] = (out[-1][0], later, v)
                else:
                    out.append((t, later, v))
        return out

    def swept(pdf: pd.DataFrame) -> pd.DataFrame:
        y, at, smaller = pdf["amount"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64), pdf["before"].fillna(-1).to_numpy(np.int64)
        own, keys = (pdf["own"] == pdf["cell"]).to_numpy(), pdf["key"].to_numpy()
        rows = [(keys[i[0]], *r) for (_, s, _), i in pdf.groupby(ids, sort=False).indices.items() for r in sweep(int(s) * width, y[i], at[i], smaller[i], own[i])]
        return pd.DataFrame(rows, columns=["key", "_from", "_until", "_v"])

    return parts.groupBy("bundle").applyInPandas(swept, f"key {gifts.schema['key'].dataType.simpleString()}, _from long, _until long, _v int")
