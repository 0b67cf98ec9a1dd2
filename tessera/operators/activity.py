"""Status of identities from decayed activity signals."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Weights of signals, half life, lookback and thresholds.
SIGNALS = {"STRONG_ACTIVE": 3.0, "WEAK_ACTIVE": 2.0, "NEUTRAL": 0.0, "DORMANCY": -2.0, "CLOSURE": -4.0}
HALF_LIFE, LOOKBACK, STRONG_WITHIN = 180, 548, 180
ACTIVE_FROM, CLOSED_FROM = 2.0, -3.0
# The signal that an event type gives.
EVENT_SIGNALS = {
    "LICENCE_RENEWAL": "STRONG_ACTIVE", "GST_FILING": "STRONG_ACTIVE", "TAX_PAYMENT": "STRONG_ACTIVE", "ANNUAL_RETURN": "STRONG_ACTIVE",
    "INSPECTION": "WEAK_ACTIVE", "POLLUTION_CLEARANCE": "WEAK_ACTIVE", "LABOUR_COMPLIANCE": "WEAK_ACTIVE",
    "COMPLIANCE_NOTICE": "NEUTRAL", "ELECTRICITY_DISCONNECT": "DORMANCY", "CLOSURE_CERT": "CLOSURE",
}


def lookup(values: dict[str, object], key: Column, default: object) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def signal_of(event_type: Column) -> Column:
    return lookup(EVENT_SIGNALS, event_type, "NEUTRAL")


def decay(age_days: Column) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * F.greatest(age_days, F.lit(0)) / float(HALF_LIFE))


def in_lookback(events: DataFrame, ref: date, days: int = LOOKBACK) -> DataFrame:
    return events.where(F.col("event_date").between(F.date_sub(F.lit(ref), days), F.lit(ref)))


def weighted(events: DataFrame, ref: date) -> DataFrame:
    """Events of the lookback window with base weight, age, decay, and their product."""
    rows = in_lookback(events, ref).withColumn("base_weight", lookup(SIGNALS, F.col("signal_class"), 0.0)).withColumn("age_days", F.datediff(F.lit(ref), "event_date"))
    return rows.withColumn("decay", decay(F.col("age_days"))).withColumn("weight", F.col("base_weight") * F.col("decay"))


def classify(score: Column, closed: Column, last_strong: Column, ref: date) -> Column:
    recent = F.coalesce(F.datediff(F.lit(ref), last_strong) <= STRONG_WITHIN, F.lit(False))
    return F.when(closed | (score <= CLOSED_FROM), "CLOSED").when((score >= ACTIVE_FROM) & recent, "ACTIVE").otherwise("DORMANT")


STATE = ["score", "closures", "event_count", "last_strong_active", "last_event_date"]


def _summed(rows: DataFrame) -> DataFrame:
    """Weighted events to one row an identity (STATE)."""
    return rows.groupBy("ubid").agg(
        F.sum("weight").alias("score"),
        F.count_if(F.col("signal_class") == "CLOSURE").alias("closures"),
        F.count("*").alias("event_count"),
        F.max(F.when(F.col("signal_class") == "STRONG_ACTIVE", F.col("event_date"))).alias("last_strong_active"),
        F.max("event_date").alias("last_event_date"),
    )


def _days(events: DataFrame) -> DataFrame:
    """(ubid, days): of each identity the number of events by day and signal, in order; at most five rows a day of the window."""
    per = events.groupBy("ubid", "event_date", "signal_class").agg(F.count("*").alias("n"))
    return per.groupBy("ubid").agg(F.sort_array(F.collect_list(F.struct("event_date", "signal_class", "n"))).alias("days"))


def _state_of(days: DataFrame, ref: date) -> DataFrame:
    """(ubid, days) with STATE as it is at a date: nothing in it rests on what it was before, so no error adds up."""
    weight = lambda d: lookup(SIGNALS, d["signal_class"], 0.0) * decay(F.datediff(F.lit(ref), d["event_date"]))
    total = lambda value, zero, only=None: F.aggregate(F.filter("days", only) if only else F.col("days"), zero, lambda t, d: t + value(d))
    of = lambda kind: lambda d: F.coalesce(d["signal_class"] == kind, F.lit(False))
    none, n = F.lit(0).cast("bigint"), lambda d: d["n"]
    newest = lambda rows: F.array_max(F.transform(rows, lambda d: d["event_date"]))
    return days.select(
        "ubid", "days", total(lambda d: d["n"] * weight(d), F.lit(0.0)).alias("score"), total(n, none, of("CLOSURE")).alias("closures"), total(n, none).alias("event_count"),
        newest(F.filter("days", of("STRONG_ACTIVE"))).alias("last_strong_active"), newest(F.col("days")).alias("last_event_date"),
    )


def window_state(events: DataFrame, ref: date) -> DataFrame:
    """What the lookback window holds of each identity: STATE, and the days that it comes from, by which advance() moves it on."""
    return _state_of(_days(in_lookback(events.where("ubid IS NOT NULL"), ref)), ref)


def advance(state: DataFrame, events: DataFrame, was: date, ref: date) -> DataFrame:
    """window_state() at a later date from that of an earlier one, and from those events alone that have come into the window; days that have left it go from the state itself.

    Days are kept as counts, and the score is made of them at each date, so it is the one that all events would give, however many the steps. Raises ValueError if `ref` is earlier.
    """
    if ref < was:
        raise ValueError(f"{ref} is before {was}")
    first = F.date_sub(F.lit(ref), LOOKBACK)
    come = in_lookback(events.where("ubid IS NOT NULL"), ref).where(F.col("event_date") > F.lit(was))
    old = state.select("ubid", F.filter("days", lambda d: d["event_date"] >= first).alias("days"))
    both = old.unionByName(_days(come)).groupBy("ubid").agg(F.sort_array(F.flatten(F.collect_list("days"))).alias("days"))
    return _state_of(both.where(F.size("days") > 0), ref)


def status_of(state: DataFrame, masters: DataFrame, ref: date) -> DataFrame:
    """One row for each ACTIVE master: status, score (unrounded), last strong signal, number of events, last event."""
    rows = masters.where("status = 'ACTIVE'").select("ubid").join(state, "ubid", "left")
    score = F.coalesce("score", F.lit(0.0))
    kind = classify(score, F.coalesce(F.col("closures") > 0, F.lit(False)), F.col("last_strong_active"), ref)
    return rows.select("ubid", kind.alias("status"), score.alias("score"), "last_strong_active", F.coalesce("event_count", F.lit(0)).alias("event_count"), "last_event_date")


def status(events: DataFrame, masters: DataFrame, ref: date) -> DataFrame:
    """status_of() from all events: one partial aggregate, then one join."""
    return status_of(_summed(weighted(events.where("ubid IS NOT NULL"), ref)), masters, ref)


def timeline(events: DataFrame, statuses: DataFrame, ref: date) -> DataFrame:
    """Weighted events with rounded weights, and the tipping point: the first event, in order of time, at which the running sum of rounded weights reaches the threshold of the identity's status."""
    rows = weighted(events, ref).join(statuses.select("ubid", F.col("status").alias("ubid_status")), "ubid")
    rows = rows.withColumn("decay", F.round("decay", 4)).withColumn("weight", F.round("weight", 4))
    by = W.partitionBy("ubid").orderBy("event_date", "id")
    rows = rows.withColumn("cumulative", F.sum("weight").over(by.rowsBetween(W.unboundedPreceding, 0)))
    crossed = ((F.col("ubid_status") == "ACTIVE") & (F.col("cumulative") >= ACTIVE_FROM)) | ((F.col("ubid_status") == "CLOSED") & (F.col("cumulative") <= CLOSED_FROM))
    first = F.sum(crossed.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("is_tipping_point", crossed & (first == 1))


def join_events(events: DataFrame, source_records: DataFrame, records: DataFrame) -> DataFrame:
    """Events without an identity get it by the record that their payload names, else by the ground-truth id (the last identity that has it)."""
    known = events.where("ubid IS NOT NULL")
    open_ = events.where("ubid IS NULL").drop("ubid")
    ref, gt = F.get_json_object("payload", "$.record_ref"), F.get_json_object("payload", "$.business_gt_id")
    by_record = source_records.groupBy(F.col("record_id").cast("string").alias("ref")).agg(F.max_by("ubid", "id").alias("ubid_r"))
    by_gt = source_records.join(records.select(F.col("id").alias("record_id"), F.col("gt_id").alias("gt")).where("gt IS NOT NULL"), "record_id").groupBy("gt").agg(F.max_by("ubid", "id").alias("ubid_g"))
    found = open_.withColumns({"ref": ref, "gt": gt}).join(by_record, "ref", "left").join(by_gt, "gt", "left")
    return known.unionByName(found.withColumn("ubid", F.coalesce("ubid_r", "ubid_g")).drop("ref", "gt", "ubid_r", "ubid_g"))


def join_counts(events: DataFrame, joined: DataFrame) -> DataFrame:
    """One row on join_events(): events that had no identity, how many of them got one, and how many didn't."""
    open_ = events.agg(F.count_if(F.col("ubid").isNull()).alias("open"))
    left = joined.agg(F.count_if(F.col("ubid").isNull()).alias("unmatched"))
    return open_.join(left).select("open", (F.col("open") - F.col("unmatched")).alias("joined"), "unmatched")


def upsert(old: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """The next snapshot of statuses: new rows replace old ones of their key; status_since moves only where the status changed."""
    o = old.select("ubid", *[F.col(c).alias(f"old_{c}") for c in old.columns if c != "ubid"])
    rows = o.join(new, "ubid", "full_outer")
    since = F.when(F.col("status").isNull() | F.col("old_status").eqNullSafe(F.col("status")), F.col("old_status_since")).otherwise(F.lit(now))
    taken = F.col("status").isNotNull()
    return rows.select(
        "ubid", F.coalesce("status", "old_status").alias("status"), F.when(taken, F.col("score")).otherwise(F.col("old_score")).alias("score"),
        since.alias("status_since"), F.when(taken, F.lit(now)).otherwise(F.col("old_last_recomputed_at")).alias("last_recomputed_at"),
    )


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Identities that had a status and have another now: what goes to the ledger as STATUS_CHANGED."""
    o = old.select("ubid", F.col("status").alias("old_status"))
    return new.join(o, "ubid").where("status <> old_status").select("ubid", "old_status", F.col("status").alias("new_status"), "score")
