"""Streams of arriving transfers: scoring each against what is known, dedup, and sliding fan-in."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Why a transfer may be scored again.
RESCORE_REASONS = ("late_arriving_data", "dispute_upheld", "rule_set_change", "model_change", "correction")


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))


def score_arrivals(arrivals: DataFrame, history_path: str, out_path: str, score: Callable[[DataFrame], DataFrame], checkpoint: str, keys: list[str], buckets: int = 256):
    """Remember each batch, then score its rows against history and batch; scores are appended.

    ``score`` takes a ledger and returns rows keyed by donation_id; it reads the history of the batch's values of
    ``keys`` alone: history lies in ``buckets`` folders by a hash of the keys, sorted by key inside, so a batch opens the folders of its
    own keys and skips the row groups of others. A batch is written under its id before it is scored, so a repeated batch
    replaces itself. Only rows recorded by a row's time count, so late rows never change rows already scored.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns, bucket = batch.columns, _bucket(keys, buckets)
        path = f"{history_path}/batch={batch_id}"
        batch.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", *keys).write.mode("overwrite").partitionBy("bucket").parquet(path)
        schema = batch.schema.add("bucket", "long")
        own = spark.read.schema(schema).parquet(path)
        mine = own.select("bucket", *keys).distinct()
        wanted = [r["bucket"] for r in mine.select("bucket").distinct().collect()]  # ``buckets`` at most
        held = spark.read.schema(schema.add("batch", "long")).parquet(history_path).where(F.col("bucket").isin(wanted)).join(mine, ["bucket", *keys], "left_semi").select(*columns)
        score(held).join(own.select("donation_id"), "donation_id", "left_semi").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def dedup(arrivals: DataFrame, key: list[str], delay: str = "90 days") -> DataFrame:
    """The first arrival of each key within the watermark on recording time."""
    return arrivals.withWatermark("recorded_at", delay).dropDuplicatesWithinWatermark(key)


def _covered(days: DataFrame, width: int) -> DataFrame:
    """(receiver_id, start, senders): for each pair and window of ``width`` days that holds one of its ``days``: 1. A window is its earliest day's."""
    before = F.lag("day").over(Window.partitionBy("receiver_id", "sender_id").orderBy("day"))
    first = F.greatest(F.date_sub("day", width - 1), F.coalesce(F.date_add(before, 1), F.date_sub("day", width - 1)))
    return days.withColumn("_first", first).select("receiver_id", F.explode(F.sequence("_first", F.col("day"))).alias("start"), F.lit(1).cast("long").alias("senders"))


def fan_in(arrivals: DataFrame, state_path: str, out_path: str, checkpoint: str, days: int = 14, delay_days: int = 120):
    """Distinct senders and transfers per receiver and window of ``days`` days of occurrence, as changes: a batch appends what it adds.

    What is remembered is the days on which each pair met, in folders by month: a batch reads the days around its own, of its own pairs,
    counts their windows with and without its new days, and appends the difference. Rows that occurred over ``delay_days`` before the newest day of
    earlier batches are dropped; days as old as that can be deleted. ``windows`` adds the changes up.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = batch.select("receiver_id", "sender_id", F.to_date("occurred_at").alias("day")).schema.add("month", "string").add("batch", "long")
        rows = batch.withColumn("day", F.to_date("occurred_at"))
        known = spark.read.schema(schema).parquet(state_path) if batch_id else spark.createDataFrame([], schema)
        known = known.where(F.col("batch") < batch_id)
        low, high = rows.agg(F.min("day"), F.max("day")).first()
        if low is None:
            return
        newest = known.agg(F.max("day")).first()[0]
        if newest is not None:
            rows = rows.where(F.col("day") >= F.date_sub(F.lit(newest), delay_days))
        pairs = rows.where("sender_id is not null").select("receiver_id", "sender_id", "day").distinct()
        same = lambda a, b, *more: reduce(and_, [a[c].eqNullSafe(b[c]) for c in ("receiver_id", "sender_id", *more)])  # noqa: E731  an unresolved receiver is one of its own
        begin, end = (F.date_add(F.lit(d), n) for d, n in ((low, -days), (high, days)))
        near = known.where(F.col("month").between(F.date_format(begin, "yyyy-MM"), F.date_format(end, "yyyy-MM")) & F.col("day").between(begin, end)).select(*pairs.columns)
        near = near.join(own := pairs.select("receiver_id", "sender_id").distinct(), same(near, own), "left_semi")
        new = pairs.join(near, same(pairs, near, "day"), "left_anti")
        after, was = _covered(near.unionByName(new), days), _covered(near, days).withColumn("senders", -F.col("senders"))
        gifts = rows.select("receiver_id", F.explode(F.sequence(F.date_sub("day", days - 1), F.col("day"))).alias("start"), F.lit(1).cast("long").alias("donations"))
        change = after.unionByName(was).withColumn("donations", F.lit(0).cast("long")).unionByName(gifts.withColumn("senders", F.lit(0).cast("long")))
        change = change.groupBy("receiver_id", "start").agg(F.sum("senders").alias("senders"), F.sum("donations").alias("donations"))
        change.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        new.withColumn("month", F.date_format("day", "yyyy-MM")).repartition("month").write.mode("overwrite").partitionBy("month").parquet(f"{state_path}/batch={batch_id}")

    return arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def windows(changes: DataFrame) -> DataFrame:
    """The windows as they stand: sums of the changes that ``fan_in`` appended."""
    return changes.groupBy("receiver_id", "start").agg(F.sum("senders").alias("senders"), F.sum("donations").alias("donations"))


def rescored(events: DataFrame, scores: DataFrame, ids: DataFrame, reason: str, at) -> DataFrame:
    """New scoring events for a set of transfers, with the score each had before; append them, keep the old."""
    if reason not in RESCORE_REASONS:
        raise ValueError(reason)
    last = events.groupBy("donation_id").agg(F.max_by("score", "scored_at").alias("previous"))
    return scores.join(ids.select("donation_id").distinct(), "donation_id", "left_semi").join(last, "donation_id", "left").withColumns({"reason": F.lit(reason), "scored_at": at})
