"""Press coverage: admission of items with a reason for each refusal, events, independent sources and decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import STAGES

#: Fixed pattern: text that speaks of the scoring itself.
SELF_REFERENCE = r"(?i)sistem\s+deteksi\s+risiko\s+donasi|risk\s+score\s+of\s+\d+"


def stage_weight(stage: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in STAGES:
        out = F.when(stage == name, F.lit(weight)).otherwise(out)
    return out


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.parse_url(url, F.lit("HOST"))), r"^www\.", "")


def event_key(entity: Column, at: Column, headline: Column) -> Column:
    """Entity, ISO week, and the first eight sorted headline words of over four characters, hashed."""
    words = F.filter(F.regexp_extract_all(F.lower(headline), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) > 4)
    week = F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), at).cast("string"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))
    return F.substring(F.sha2(F.concat_ws("|", entity.cast("string"), week, F.array_join(F.slice(F.array_sort(words), 1, 8), " ")), 256), 1, 16)


def admitted(items: DataFrame, allowed: DataFrame, least: float = 0.3) -> DataFrame:
    """``items`` with ``refusal`` (null: admitted): unknown host, self-reference, weak stage, or a repeat of an event by one source.

    ``allowed``: host. Of repeats the earliest stays; ties by url.
    """
    known = allowed.select(F.lower("host").alias("_host")).distinct().withColumn("_known", F.lit(True))
    rows = items.withColumn("_host", host(F.col("url"))).join(F.broadcast(known) if allowed.limit(10_001).count() <= 10_000 else known, "_host", "left")
    first = (
        F.when(F.col("_known").isNull(), "source is not on the list")
        .when(F.concat_ws(" ", "headline", "body").rlike(SELF_REFERENCE), "refers to the scoring itself")
        .when(stage_weight(F.col("stage")) < least, "stage is too weak")
    )
    rows = rows.withColumns({"_first": first, "event": event_key(F.col("entity_id"), F.col("published_at"), F.col("headline"))})
    w = Window.partitionBy("event", "source", F.col("_first").isNull()).orderBy("published_at", "url")
    again = F.when(F.row_number().over(w) > 1, "repeats an event of the same source")
    return rows.withColumn("refusal", F.coalesce("_first", again)).drop("_host", "_known", "_first")


def independent_sources(items: DataFrame) -> DataFrame:
    return items.where("refusal is null").groupBy("event").agg(F.count_distinct("source").alias("sources"))


def decayed(stage: Column, at: Column, now: Column, half_life_days: int = 730) -> Column:
    return stage_weight(stage) * F.pow(F.lit(0.5), F.datediff(now, at) / F.lit(float(half_life_days)))


def retracted(items: DataFrame, retractions: DataFrame) -> DataFrame:
    """Marks items by url and keeps them."""
    gone = retractions.select("url").distinct().withColumn("_gone", F.lit(True))
    return items.join(gone, "url", "left").withColumn("retracted", F.coalesce("_gone", F.lit(False))).drop("_gone")
