"""The fixed library of analytical queries and statistics."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.resolution import cluster_edges

# The departments that an identity may be registered with.
DEPARTMENTS = ["SHOP_EST", "FACTORIES", "LABOUR", "KSPCB", "GST"]
DAYS_A_MONTH = 30


def active_not_inspected(masters: DataFrame, statuses: DataFrame, events: DataFrame, source_records: DataFrame, ref: date, pincode: str | None = "560058", months: int = 18) -> DataFrame:
    """Active identities of a pincode (None: of all) without an inspection in the last months of 30 days: score, number of sources, last inspection at any time, days since."""
    active = masters.where("status = 'ACTIVE'")
    active = active.where(F.col("primary_pincode") == pincode) if pincode else active
    active = active.join(statuses.where("status = 'ACTIVE'").select("ubid", "score"), "ubid")
    inspections = events.where("event_type = 'INSPECTION'")
    recent = inspections.where(F.col("event_date") >= F.date_sub(F.lit(ref), months * DAYS_A_MONTH)).select("ubid")
    last = inspections.groupBy("ubid").agg(F.max("event_date").alias("last_inspection"))
    counts = source_records.groupBy("ubid").agg(F.count("*").alias("source_count"))
    rows = active.join(recent, "ubid", "left_anti").join(last, "ubid", "left").join(counts, "ubid", "left")
    return rows.select("ubid", "primary_name", "primary_pincode", F.round("score", 4).alias("activity_score"), F.coalesce("source_count", F.lit(0)).alias("source_count"), "last_inspection", F.datediff(F.lit(ref), "last_inspection").alias("days_since"))


def ghost_candidates(masters: DataFrame, statuses: DataFrame, ref: date, district: str | None = None, months_silent: int = 12, limit: int | None = 50, strict: bool = False) -> DataFrame:
    """Dormant identities, of a district if one is given (identities without a district pass). `strict` also asks for no event in the last months, which by default isn't applied."""
    rows = masters.where("status = 'ACTIVE'").join(statuses.where("status = 'DORMANT'").select("ubid", "score", "last_event_date", "event_count"), "ubid")
    if district:
        low = F.lower(F.coalesce("primary_district", F.lit("")))
        rows = rows.where((low == "") | F.contains(low, F.lit(district.lower())))
    if strict:
        rows = rows.where(F.col("last_event_date").isNull() | (F.col("last_event_date") < F.date_sub(F.lit(ref), months_silent * DAYS_A_MONTH)))
    rows = rows.select("ubid", "primary_name", "primary_district", F.round("score", 4).alias("activity_score"), "last_event_date", "event_count")
    return rows.orderBy("ubid").limit(limit) if limit else rows


def coverage(source_records: DataFrame, departments: list[str] = DEPARTMENTS) -> DataFrame:
    """Departments of each identity, those it lacks, and the share it has in percent."""
    per = source_records.groupBy("ubid").agg(F.array_sort(F.collect_set("source_system")).alias("covered"))
    missing = F.array_except(F.array(*map(F.lit, departments)), "covered")
    return per.select("ubid", "covered", missing.alias("missing"), F.round(100.0 * F.size("covered") / len(departments), 1).alias("coverage_pct"))


def sector_trend(masters: DataFrame, statuses: DataFrame, district: str) -> DataFrame:
    """Identities of a district by status, with zeros."""
    rows = masters.where(F.col("primary_district").ilike(f"%{district}%")).where("status = 'ACTIVE'").select("ubid").join(statuses.select("ubid", F.col("status").alias("activity_status")), "ubid")
    counts = rows.groupBy("activity_status").agg(F.count("*").alias("n"))
    domain = masters.sparkSession.createDataFrame([("ACTIVE",), ("DORMANT",), ("CLOSED",)], "activity_status string")
    return domain.join(counts, "activity_status", "left").select("activity_status", F.coalesce("n", F.lit(0)).alias("n"))


def system_statistics(records: DataFrame, masters: DataFrame, merges: DataFrame, events: DataFrame, statuses: DataFrame, pairs: DataFrame, ledger: DataFrame, active_only: bool = False) -> DataFrame:
    """Twelve figures in one row, each table aggregated once. Statuses of deprecated identities count, unless active_only. A row of `pairs` stands for as many pairs as its `links` say, or for one."""
    if active_only:
        statuses = statuses.join(masters.where("status = 'ACTIVE'").select("ubid"), "ubid", "left_semi")
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    links = F.col("links") if "links" in pairs.columns else F.lit(1)
    parts = [
        records.agg(F.count("*").alias("total_records")),
        masters.agg(is_("status", "ACTIVE").alias("active_ubids")),
        merges.agg(F.count_if(~F.col("reversed")).alias("merges")),
        events.agg(F.count("*").alias("events")),
        statuses.agg(*[is_("status", s).alias(s.lower()) for s in ("ACTIVE", "DORMANT", "CLOSED")]),
        pairs.agg(
            total(F.when((F.col("decision") == "REVIEW") & (F.col("review_status") == "PENDING"), links)).alias("pending_reviews"),
            F.round(total(F.when(F.col("decision") == "AUTO_LINK", links)) / F.greatest(total(F.when(F.col("score").isNotNull(), links)), F.lit(1)), 4).alias("auto_link_rate"),
            F.round(F.sum(F.col("score") * links) / F.sum(F.when(F.col("score").isNotNull(), links)), 4).alias("avg_score"),
        ),
        ledger.agg(F.lit(len(DEPARTMENTS)).alias("departments"), F.count("*").alias("ledger_entries")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)
    return out


def pipeline_counts(records: DataFrame, pairs: DataFrame, masters: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of the four stages; reviews warn over 50."""
    stage = lambda df, name, label, n: df.agg(n.alias("n")).select(F.lit(name).alias("name"), F.lit(label).alias("label"), "n")
    review = F.count_if((F.col("decision") == "REVIEW") & (F.col("review_status") == "PENDING"))
    rows = [stage(records, "ingest", "Ingestion", F.count("*")), stage(masters, "resolve", "Resolution", F.count_if(F.col("status") == "ACTIVE")), stage(pairs, "review", "Review", review), stage(events, "activity", "Activity", F.count_if(F.col("ubid").isNotNull()))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("status", F.when((F.col("name") == "review") & (F.col("n") > 50), "warning").otherwise("healthy"))


def review_queue(pairs: DataFrame, records: DataFrame, offset: int = 0, limit: int = 20, by_score: bool = True) -> DataFrame:
    """A page of what waits for review, with both names; pairs that lack a record go after the page is cut."""
    open_ = pairs.where("decision = 'REVIEW' AND review_status = 'PENDING'")
    order = [F.desc("score"), F.col("pair_id")] if by_score else [F.col("created_at"), F.col("pair_id")]
    page = open_.orderBy(*order).offset(offset).limit(limit)
    name = records.select("id", "business_name")
    a = name.select(F.col("id").alias("record_a_id"), F.col("business_name").alias("name_a"))
    b = name.select(F.col("id").alias("record_b_id"), F.col("business_name").alias("name_b"))
    return page.join(a, "record_a_id").join(b, "record_b_id").select("pair_id", "record_a_id", "record_b_id", "name_a", "name_b", F.round("score", 4).alias("score"))


def decide(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs after decisions (pair_id, decision, reviewer_id, notes, reviewed_at): the last one of a pair counts, but a reviewer's own repeat on a decided pair changes nothing."""
    last = decisions.groupBy("pair_id").agg(F.max_by(F.struct("decision", "reviewer_id", "notes", "reviewed_at"), "reviewed_at").alias("d"))
    return folded(pairs.join(last, "pair_id", "left"))


def folded(rows: DataFrame) -> DataFrame:
    """Pairs that hold their last decision as a struct `d` (null: none), after it."""
    repeat = (F.col("review_status") != "PENDING") & F.col("reviewer_id").eqNullSafe(F.col("d.reviewer_id"))
    use = F.col("d").isNotNull() & ~repeat
    new = {"review_status": "decision", "reviewer_id": "reviewer_id", "reviewer_notes": "notes", "reviewed_at": "reviewed_at"}
    return rows.withColumns({k: F.when(use, F.col(f"d.{v}")).otherwise(F.col(k)) for k, v in new.items()}).drop("d")


def confirmed_links(pairs: DataFrame, source_records: DataFrame) -> DataFrame:
    """What confirmed pairs of a score other than 0 merge: record A's identity wins."""
    a = source_records.select(F.col("record_id").alias("record_a_id"), F.col("ubid").alias("winner"))
    b = source_records.select(F.col("record_id").alias("record_b_id"), F.col("ubid").alias("loser"))
    rows = pairs.where("review_status = 'CONFIRM' AND coalesce(score, 0) <> 0").join(a, "record_a_id").join(b, "record_b_id")
    return rows.where("winner <> loser").select("winner", "loser", "score", F.col("reviewer_id").alias("decided_by"))


def reviewer_history(pairs: DataFrame, reviewer: str, limit: int | None = 50) -> DataFrame:
    """A reviewer's decisions, newest first; all of them if limit is None."""
    rows = pairs.where((F.col("reviewer_id") == reviewer) & (F.col("review_status") != "PENDING"))
    rows = rows.orderBy(F.desc("reviewed_at"), "pair_id")
    return rows if limit is None else rows.limit(limit)


def reviewer_kpis(pairs: DataFrame) -> DataFrame:
    """Reviews by anyone, confirmed, rejected, share confirmed, and the assumed 45 seconds a review."""
    done = F.count_if((F.col("review_status") != "PENDING") & F.col("reviewer_id").isNotNull())
    rows = pairs.agg(done.alias("total_reviews"), F.count_if(F.col("review_status") == "CONFIRM").alias("confirmed"), F.count_if(F.col("review_status") == "REJECT").alias("rejected"))
    return rows.withColumns({"confirm_rate": F.round(F.col("confirmed") / F.greatest("total_reviews", F.lit(1)), 3), "avg_review_seconds": F.lit(45)})


def identity_detail(ubid: str, masters: DataFrame, timeline: DataFrame, source_records: DataFrame, records: DataFrame, merges: DataFrame, newest: int = 50) -> dict[str, DataFrame]:
    """An identity's row, source records, newest events, merges and graph. Raises KeyError if there's none."""
    one = masters.where(F.col("ubid") == ubid)
    if one.isEmpty():
        raise KeyError(ubid)
    mine = source_records.where(F.col("ubid") == ubid)
    history = merges.where((F.col("winner") == ubid) | (F.col("loser") == ubid)).orderBy(F.desc("decided_at"), "merge_id")
    return {
        "identity": one,
        "sources": mine.join(records.withColumnRenamed("id", "record_id"), "record_id", "left"),
        "timeline": timeline.where(F.col("ubid") == ubid).orderBy(F.desc("event_date"), "id").limit(newest),
        "merges": history,
        "edges": cluster_edges(mine),
    }


def adapter_state(rows: DataFrame, source: str, read_at: str, now: datetime, stale_after: timedelta) -> DataFrame:
    """A row of adapter_health for each source: its last row, how many it gave, how old the last is at `now`, and STALE if it is older than that."""
    per = rows.groupBy(F.col(source).alias("source_system")).agg(F.max(read_at).alias("last_successful_pull_at"), F.count("*").alias("total_records"))
    age = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("last_successful_pull_at")).cast("double")
    return per.withColumn("freshness_seconds", age).withColumn("status", F.when(age <= stale_after.total_seconds(), "HEALTHY").otherwise("STALE"))


def health(adapters: DataFrame) -> DataFrame:
    """One row: adapters, the healthy ones, their share, and whether all are."""
    ok = F.col("status") == "HEALTHY"
    return adapters.agg(F.count("*").alias("adapters"), F.count_if(ok).alias("healthy"), F.round(F.count_if(ok) / F.greatest(F.count("*"), F.lit(1)), 4).alias("ratio"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_healthy"))


def audit_row(spark, query_type: str, params: str, result_count: int, latency_ms: float, at) -> DataFrame:
    """What a query leaves in the audit table."""
    return spark.createDataFrame([(query_type, params, result_count, latency_ms, at)], "query_type string, query_params string, result_count int, latency_ms double, executed_at timestamp")
