"""Reference data: registers, filings and their tolerant reconciliation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.text import fold

from .dims import small


def usable(now: Column) -> Column:
    """Is a register available and fresh enough at ``now``? One that has a maximum age must say when it was refreshed."""
    age = F.datediff(F.to_date(now), F.to_date("refreshed_at"))
    return F.col("available") & (F.col("max_age_days").isNull() | (F.col("refreshed_at").isNotNull() & (age <= F.col("max_age_days"))))


def register_status(registers: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """One row per register with its entries; order by (usable, name) to see the unusable first."""
    n = entries.groupBy(F.col("register").alias("name")).agg(F.count(F.lit(1)).alias("entries"))
    return registers.join(n, "name", "left").select("name", F.coalesce(usable(now), F.lit(False)).alias("usable"), F.coalesce("entries", F.lit(0)).alias("entries"))


def register_lookup(rows: DataFrame, registers: DataFrame, entries: DataFrame, register: str, id_col: str, name_col: str, day: Column) -> DataFrame:
    """``rows`` with ``listed``: true, false, or null where the register cannot be used on that day.

    An entry with the row's id decides, even if it does not cover the day; without one, an entry with the
    folded name or an alias does.
    """
    own = entries.where(F.col("register") == register)
    by_id = own.where("entity_id is not null").groupBy(F.col("entity_id").alias("_id")).agg(F.collect_list(F.struct("effective_from", "effective_to")).alias("_spans"))
    names = own.select(F.explode(F.array_distinct(F.concat(F.array(fold(F.col("canonical_name"))), F.transform("aliases", fold)))).alias("_name"), "effective_from", "effective_to")
    by_name = names.where("_name is not null").groupBy("_name").agg(F.collect_list(F.struct("effective_from", "effective_to")).alias("_named"))
    covers = lambda spans: F.exists(spans, lambda s: (s["effective_from"].isNull() | (s["effective_from"] <= day)) & (s["effective_to"].isNull() | (s["effective_to"] >= day)))
    out = rows.join(small(by_id), F.col(id_col) == F.col("_id"), "left").withColumn("_fold", fold(F.col(name_col))).join(small(by_name), F.col("_fold") == F.col("_name"), "left")
    state = small(registers.where(F.col("name") == register).select("available", "refreshed_at", "max_age_days", "authoritative", F.lit(True).alias("_set")))
    out = out.join(state, F.lit(True), "left")
    ready = F.coalesce(F.col("_set") & usable(day), F.lit(False))
    found = F.when(F.col("_spans").isNotNull(), covers(F.col("_spans"))).otherwise(F.coalesce(covers(F.col("_named")), F.lit(False)))
    return out.select(*rows.columns, F.when(ready, found).alias("listed"), F.col("authoritative"))


def covered_days(rows: DataFrame, periods: DataFrame, day: Column) -> DataFrame:
    """``rows`` whose context has a filed period that covers the day."""
    p = small(periods.select(F.col("electoral_context").alias("_ctx"), F.col("start").alias("_from"), F.col("end").alias("_to")))
    return rows.join(p, (F.col("electoral_context") == F.col("_ctx")) & day.between(F.col("_from"), F.col("_to")), "left_semi")


def declared(ledger: DataFrame, filings: DataFrame, tolerance_percent: int = 2, days: int = 3) -> DataFrame:
    """``ledger`` rows (by donation_id) for which a filing line of the same context matches.

    Parties match if equal or null on either side, amounts within the tolerance, days within ``days``;
    a null amount or day of a line matches anything. Lines with parties and day meet their rows by an
    equi-join on context, donor and day bucket; the lines that leave some open are grouped by what they
    have, and meet their rows by that.
    """
    width = days + 1
    day = F.to_date("occurred_at")
    bucket = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01")) / width)
    lines = filings.select(F.col("electoral_context").alias("f_ctx"), F.col("donor_ref").alias("f_donor"), F.col("recipient_ref").alias("f_recipient"), F.col("amount_idr").alias("f_amount"), F.col("occurred_on").alias("f_day"))
    fits = (
        (F.col("f_donor").isNull() | F.col("sender_id").isNull() | (F.col("f_donor") == F.col("sender_id")))
        & (F.col("f_recipient").isNull() | F.col("receiver_id").isNull() | (F.col("f_recipient") == F.col("receiver_id")))
        & (F.col("f_amount").isNull() | (F.abs(F.col("f_amount") - F.col("amount_idr")) * 100 <= F.col("amount_idr") * tolerance_percent))
        & (F.col("f_day").isNull() | (F.abs(F.datediff(F.col("f_day"), day)) <= days))
    )
    rows = ledger.select("donation_id", "electoral_context", "sender_id", "receiver_id", "amount_idr", "occurred_at")
    three = rows.withColumn("_b", F.explode(F.array(*[bucket(day) + k for k in (-1, 0, 1)])))
    ctx = F.col("electoral_context") == F.col("f_ctx")
    by_day = ctx & (F.col("_b") == F.col("f_b"))
    dated = lines.where("f_day is not null").withColumn("f_b", bucket(F.col("f_day")))
    found = [
        three.join(dated.where("f_donor is not null"), by_day & (F.col("sender_id") == F.col("f_donor")) & fits, "left_semi"),
        three.join(dated.where("f_donor is null and f_recipient is not null"), by_day & (F.col("receiver_id") == F.col("f_recipient")) & fits, "left_semi"),
        rows.join(lines.where("f_day is null and f_donor is not null"), ctx & (F.col("sender_id") == F.col("f_donor")) & fits, "left_semi"),
    ]
    # The rest meet on context, day and a step of the amount alone, so lines are cut to their kinds first: what they leave open
    # is null, and equal kinds are one row. An amount step is wider than the tolerance, so neighbours suffice.
    step = lambda a: F.floor(F.log(F.greatest(a.cast("double"), F.lit(1.0))) / math.log(1 + 3 * tolerance_percent / 100))
    with_amount = lambda d: d.withColumn("_s", F.explode(F.array(*[step(F.col("amount_idr")) + k for k in (-1, 0, 1)])))
    kinds = lambda d: d.distinct().withColumn("f_s", step(F.col("f_amount")))
    loose = three.where("sender_id is null or receiver_id is null")
    undated = lines.where("f_day is null and f_donor is null")
    for left, right, on in ((loose, dated, by_day), (three, dated.where("f_donor is null and f_recipient is null"), by_day), (rows, undated, ctx)):
        priced = kinds(right.where("f_amount is not null"))
        found.append(with_amount(left).join(priced, on & (F.col("_s") == F.col("f_s")) & fits, "left_semi"))
        free = right.where("f_amount is null").distinct()
        found.append(left.join(free.where("f_recipient is null"), on & fits, "left_semi"))
        named = free.where("f_recipient is not null")
        found.append(left.join(named, on & (F.col("receiver_id") == F.col("f_recipient")) & fits, "left_semi"))
        found.append(left.where("receiver_id is null").join(named.drop("f_recipient").distinct().withColumn("f_recipient", F.lit(None).cast("long")), on & fits, "left_semi"))
    out = found[0].select("donation_id")
    for f in found[1:]:
        out = out.unionByName(f.select("donation_id"))
    return out.distinct()


def reconcile(ledger: DataFrame, filings: DataFrame, periods: DataFrame) -> DataFrame:
    """(donation_id, declared): null where no filed period covers the day."""
    covered = covered_days(ledger, periods, F.to_date("occurred_at"))
    yes = declared(covered, filings).withColumn("_yes", F.lit(True))
    return ledger.select("donation_id").join(covered.select("donation_id", F.lit(True).alias("_covered")), "donation_id", "left").join(yes, "donation_id", "left").select(
        "donation_id", F.when(F.col("_covered"), F.coalesce("_yes", F.lit(False))).alias("declared")
    )
