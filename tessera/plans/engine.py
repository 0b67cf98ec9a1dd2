"""One object for all that the engine does over a store of tables; each method returns DataFrames."""

from __future__ import annotations

import json
import time
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import pii
from tessera.operators import activity, blocking, evaluation, ledger, pair_filter, resolution, scoring, search
from tessera.plans import named
from tessera.plans.shared import materialise
from tessera.sources import adapters
from tessera.sources.schemas import SCHEMAS
from tessera.sources.store import Store, export_csv

# Pairs that the filter of seen pairs is made for, and its share of false positives.
FILTER_PAIRS, FILTER_RATE = 50_000_000, 0.001


class Engine:
    """`ref` is the reference date of all decay and windows, `now` what is written as the time of changes: neither is read from a clock."""

    def __init__(self, spark: SparkSession, root: str, ref: date, now: datetime | None = None) -> None:
        self.spark, self.store, self.ref = spark, Store(spark, f"{root}/tables"), ref
        self.now = now or datetime.combine(ref, datetime.min.time())
        #: Of the last run of run_activity(): events that were open, joined, unmatched.
        self.last_join: dict[str, int] = {}
        #: Pairs that the last run of run_blocking() hadn't seen.
        self.last_new = 0
        self.filter_blocks = pair_filter.blocks_for(FILTER_PAIRS, FILTER_RATE)
        self.models = evaluation.Registry(spark, f"{root}/models")

    def t(self, name: str) -> DataFrame:
        return self.store.read(name)

    def pairs(self) -> DataFrame:
        """Candidate pairs with what reviewers have decided. A decision is one appended row; it is folded in here, at the read."""
        said = self.t("review_decisions").groupBy("pair_id").agg(F.max_by(F.struct("decision", "reviewer_id", "notes", "reviewed_at"), "said_at").alias("d")).select("pair_id", "d.*")
        return named.decide(self.t("candidate_pairs").withColumnRenamed("id", "pair_id"), said).withColumnRenamed("pair_id", "id")

    # ---- pipeline

    def load(self, table: str, df: DataFrame) -> None:
        self.store.overwrite(table, df)

    def run_blocking(self) -> DataFrame:
        """Candidate pairs. Pairs that are found again, between records with the same content, stay as they are, with score and review; the pair filter tells new ones mostly without a look at the old."""
        norm = materialise(blocking.normalised(self.t("business_records")), "norm")
        pairs = materialise(blocking.with_content(blocking.candidate_pairs(norm), norm).withColumnRenamed("pair_id", "id"), "pairs")
        held = self.pairs()
        fresh = pair_filter.unseen(pairs, "content_key", self.t("pair_filter"), held.where("content_key IS NOT NULL"), self.filter_blocks)
        fresh = materialise(fresh, "fresh")
        reviewed = held.select("id", "review_status", "reviewer_id", "reviewer_notes", "reviewed_at", "created_at")
        new = fresh.join(reviewed, "id", "left").withColumns({"review_status": F.coalesce("review_status", F.lit("PENDING")), "created_at": F.coalesce("created_at", F.lit(self.now)), "score": F.lit(None).cast("double"), "decision": F.lit(None).cast("string")})
        kept = held.join(pairs.select("content_key"), "content_key", "left_semi")
        self.last_new = fresh.count()
        self.store.overwrite("candidate_pairs", kept.unionByName(new, allowMissingColumns=True))
        if self.last_new:
            self.store.overwrite("pair_filter", pair_filter.merged(self.t("pair_filter"), pair_filter.of(fresh, "content_key", self.filter_blocks)))
        return blocking.statistics(self.t("business_records"), self.pairs())

    def run_scoring(self) -> DataFrame:
        """Scores what has no score yet, by the active model."""
        pairs = self.pairs()
        norm = blocking.normalised(self.t("business_records"))
        scored = scoring.score_pairs(pairs.drop("feature_breakdown", "model_version", "decided_at"), norm, self.models.load())
        scored = scored.withColumn("feature_breakdown", F.struct(*scoring.FEATURES)).withColumn("decided_at", F.lit(self.now)).drop(*scoring.FEATURES)
        kept = pairs.where("score IS NOT NULL")
        self.store.overwrite("candidate_pairs", kept.unionByName(scored, allowMissingColumns=True))
        return self.pairs().groupBy("decision").agg(F.count("*").alias("n"))

    def run_resolution(self) -> DataFrame:
        """Over the state that is kept: what is assigned, merged or reversed already stays, and the ledger gets only what is new."""
        norm = blocking.normalised(self.t("business_records"))
        held, given = self.t("ubid_master"), self.t("ubid_source_records")
        done = self.t("merge_provenance").select(F.col("ubid_winner").alias("winner"), F.col("ubid_loser").alias("loser"))
        created, merges, after, sources = resolution.resolve(norm, self.pairs(), held, given, done)
        when = F.lit(self.now)
        was = held.select("ubid", "created_at", "updated_at", F.struct("status", "deprecated_by_ubid").alias("was"))
        rows = after.join(was, "ubid", "left").withColumn("updated_at", F.when(F.col("was") == F.struct("status", "deprecated_by_ubid"), F.col("updated_at")).otherwise(when))
        self.store.overwrite("ubid_master", rows.withColumn("created_at", F.coalesce("created_at", when)).drop("was"))
        joined = given.select("record_id", "joined_at").groupBy("record_id").agg(F.min("joined_at").alias("joined_at"))
        sources = sources.join(joined, "record_id", "left").withColumns({"id": F.xxhash64("record_id"), "joined_at": F.coalesce("joined_at", when)})
        self.store.overwrite("ubid_source_records", sources)
        self.store.append("merge_provenance", merges.select("merge_id", F.col("winner").alias("ubid_winner"), F.col("loser").alias("ubid_loser"), "score", F.lit(scoring.MODEL_VERSION).alias("model_version"), F.lit("SYSTEM").alias("decided_by"), when.alias("decided_at"), F.lit(None).cast("string").alias("feature_breakdown"), F.lit(False).alias("reversed")))
        born = created.select(F.lit(0).alias("o"), F.col("ubid").alias("aggregate_id"), F.lit("UBID_CREATED").alias("event_type"), F.lit("UBID").alias("aggregate_type"), ledger.canonical(F.struct("anchor_type", "anchor_value", "primary_name")).alias("payload"))
        merged = merges.select(F.lit(1).alias("o"), F.col("merge_id").alias("aggregate_id"), F.lit("UBID_MERGED").alias("event_type"), F.lit("MERGE").alias("aggregate_type"), ledger.canonical(F.struct("loser", "score", "winner")).alias("payload"))
        self._record(born.unionByName(merged))
        return self.t("merge_provenance").agg(F.count("*").alias("merges")).join(self.t("ubid_master").agg(F.count_if(F.col("status") == "ACTIVE").alias("active_ubids")))

    def run_activity(self) -> DataFrame:
        masters = self.t("ubid_master")
        given = self.t("activity_events")
        events = materialise(activity.join_events(given, self.t("ubid_source_records"), self.t("business_records")), "joined")
        self.last_join = activity.join_counts(given, events).first().asDict()
        events = resolution.repoint(events, masters)  # events of a merged identity count for the one that it became
        old = self.t("activity_status_current")
        new = materialise(activity.status(events, masters, self.ref), "status")
        changes = activity.changed(old, new)
        self._record(changes.select(F.lit(2).alias("o"), F.col("ubid").alias("aggregate_id"), F.lit("STATUS_CHANGED").alias("event_type"), F.lit("STATUS").alias("aggregate_type"), ledger.canonical(F.struct("new_status", "old_status", "score")).alias("payload")))
        rows = activity.upsert(old.select("ubid", "status", "score", "status_since", "last_recomputed_at"), new, self.now)
        rows = rows.join(new.select("ubid", F.col("last_strong_active").cast("timestamp").alias("last_strong_active_at"), F.col("event_count").cast("int").alias("event_count"), "last_event_date"), "ubid", "left")
        self.store.overwrite("activity_events", events)
        self.store.overwrite("activity_status_current", rows)
        return self.t("activity_status_current").groupBy("status").agg(F.count("*").alias("n"))

    def run_all(self) -> dict[str, DataFrame]:
        """All four stages, each committed by itself."""
        done = {"blocking": self.run_blocking(), "scoring": self.run_scoring(), "resolution": self.run_resolution(), "activity": self.run_activity()}
        self.build_index()
        return done

    # ---- ledger and audit

    def _record(self, entries: DataFrame) -> None:
        """Append a batch (o, aggregate_id, event_type, aggregate_type, payload) to the ledger, in order of o and id."""
        entries = materialise(entries, "entries")
        if entries.isEmpty():
            return
        # ids go on from batch to batch, so the head is in what was written last
        last = self.store.newest("event_ledger").agg(F.max_by("hash", "ledger_id").alias("h"), F.max("ledger_id").alias("n")).first()
        rows = entries.withColumn("seq", F.struct("o", "aggregate_id"))
        chained = ledger.chain(rows.drop("o"), "seq", "payload", last["h"] or ledger.GENESIS, (last["n"] or 0) + 1)
        self.store.append("event_ledger", chained.drop("seq").withColumn("created_at", F.lit(self.now)))

    def _audited(self, kind: str, params: dict, rows: DataFrame) -> DataFrame:
        """The rows of a query, after a line about it went to the audit table."""
        began = time.perf_counter()
        rows = materialise(rows, "answer")
        n = rows.count()
        self.store.append("query_audit", named.audit_row(self.spark, kind, json.dumps(params, sort_keys=True), n, 1000 * (time.perf_counter() - began), self.now))
        return rows

    def verify_ledger(self) -> DataFrame:
        return ledger.verify(self.t("event_ledger"))

    def ledger_entries(self, **filters) -> DataFrame:
        return ledger.browse(self.t("event_ledger"), **filters)

    def recompute_from_ledger(self) -> DataFrame:
        return ledger.recompute(self.t("event_ledger"), self.t("merge_provenance"))

    def audit_log(self, limit: int = 50) -> DataFrame:
        return self.t("query_audit").orderBy(F.desc("executed_at"), "query_type").limit(limit)

    # ---- queries

    def active_not_inspected(self, pincode: str = "560058", months: int = 18) -> DataFrame:
        rows = named.active_not_inspected(self.t("ubid_master"), self.t("activity_status_current"), self.t("activity_events"), self.t("ubid_source_records"), self.ref, pincode, months)
        return self._audited("active_not_inspected", {"pincode": pincode, "months": months}, rows)

    def ghost_candidates(self, district: str | None = None, months_silent: int = 12, limit: int = 50, strict: bool = False) -> DataFrame:
        rows = named.ghost_candidates(self.t("ubid_master"), self.t("activity_status_current"), self.ref, district, months_silent, limit, strict)
        return self._audited("ghost_candidates", {"district": district, "min_months_silent": months_silent}, rows)

    def department_coverage(self, ubid: str | None = None) -> DataFrame:
        rows = self.t("ubid_source_records")
        return named.coverage(rows.where(F.col("ubid") == ubid) if ubid else rows)

    def sector_trend(self, district: str = "Bengaluru Urban") -> DataFrame:
        return self._audited("sector_trend", {"district": district}, named.sector_trend(self.t("ubid_master"), self.t("activity_status_current"), district))

    def search(self, q: str = "", status: str | None = None, district: str | None = None, limit: int = 20) -> DataFrame:
        rows = search.identity_search(self.t("ubid_master"), self.t("activity_status_current"), self.t("ubid_source_records"), q, status, district, limit)
        return self._audited("identity_search", {"q": q, "status": status, "district": district}, rows)

    def build_index(self) -> None:
        """Search documents and their postings as tables; run_all() ends with it."""
        self.store.overwrite("search_documents", search.documents(self.t("ubid_master"), self.t("activity_status_current"), self.t("ubid_source_records"), self.t("business_records")))
        found = materialise(search.postings(self.t("search_documents")), "postings")
        self.store.overwrite("search_postings", search.bucketed(found), ["field", "bucket"], ["term"])
        self.store.overwrite("search_keys", search.term_keys(found), ["bucket"], ["key"])

    def _lookup(self, q: str, filters: dict[str, str] | None) -> DataFrame:
        if self.t("search_documents").isEmpty():
            self.build_index()
        return search.lookup(self.t("search_keys"), self.t("search_postings"), self.t("search_documents"), q, filters)

    def fuzzy_search(self, q: str, filters: dict[str, str] | None = None, limit: int = 20) -> DataFrame:
        """By the index as it was last built, of which only the partitions are read that the words can meet; it is built if there's none."""
        return self._lookup(q, filters).orderBy(F.desc("relevance"), "ubid").limit(limit)

    def find(self, q: str, status: str | None = None, district: str | None = None, limit: int = 20) -> tuple[str, DataFrame]:
        """How the search was made, and its rows: 'index' if an index was built, else 'predicates'."""
        mode, _, rows = self.find_page(q, status, district, limit)
        return mode, rows

    def find_page(self, q: str, status: str | None = None, district: str | None = None, limit: int = 20) -> tuple[str, int, DataFrame]:
        """As find(), with the number of all that match: by the index all of them, by predicates those of the page."""
        if self.t("search_documents").isEmpty() or not q:
            rows = self.search(q, status, district, limit)
            return "predicates", rows.count(), rows
        asked = {k: v for k, v in (("status", status), ("primary_district", district)) if v}
        every = materialise(self._lookup(q, asked), "found")
        page = every.orderBy(F.desc("relevance"), "ubid").limit(limit)
        return "index", every.count(), page.join(self.t("search_documents"), "ubid").orderBy(F.desc("relevance"), "ubid")

    def identity(self, ubid: str) -> dict[str, DataFrame]:
        events = self.t("activity_events")
        lines = activity.timeline(events, activity.status(events, self.t("ubid_master"), self.ref), self.ref)
        merges = self.t("merge_provenance").withColumnsRenamed({"ubid_winner": "winner", "ubid_loser": "loser"})
        return named.identity_detail(ubid, self.t("ubid_master"), lines, self.t("ubid_source_records"), self.t("business_records"), merges)

    def statistics(self) -> DataFrame:
        t = self.t
        return named.system_statistics(t("business_records"), t("ubid_master"), t("merge_provenance"), t("activity_events"), t("activity_status_current"), self.pairs(), t("event_ledger"))

    def pipeline_counts(self) -> DataFrame:
        return named.pipeline_counts(self.t("business_records"), self.pairs(), self.t("ubid_master"), self.t("activity_events"))

    def departments(self) -> DataFrame:
        return self.t("business_records").groupBy("source_system").agg(F.count("*").alias("n"))

    def adapter_health(self) -> DataFrame:
        return self.t("adapter_health").withColumn("freshness_seconds", F.round("freshness_seconds", 1))

    def export(self, rows: DataFrame, path: str) -> None:
        export_csv(rows, path)

    # ---- reviews

    def review_queue(self, offset: int = 0, limit: int = 20, by_score: bool = True) -> DataFrame:
        return named.review_queue(self.pairs().withColumnRenamed("id", "pair_id"), self.t("business_records"), offset, limit, by_score)

    def explanation(self, pair_id: str) -> DataFrame:
        """Sanitised records of a pair, the score in words, and what raw personal data is left (nothing should be)."""
        pair = self.pairs().where(F.col("id") == pair_id).withColumnRenamed("id", "pair_id")
        raw = self.t("business_records")
        clean = pii.sanitized(raw)
        out = pair
        for side in ("a", "b"):
            safe = clean.select(F.col("id").alias(f"record_{side}_id"), F.struct(*clean.columns).alias(f"record_{side}"))
            own = raw.select(F.col("id").alias(f"record_{side}_id"), F.struct("business_name", "phone", "email", "pan", "gstin").alias(f"raw_{side}"))
            out = out.join(safe, f"record_{side}_id").join(own, f"record_{side}_id")
        f = lambda c: F.col(f"feature_breakdown.{c}")
        payload = F.to_json(F.struct("record_a", "record_b"))
        left = [pii.violations(payload, *[F.col(f"raw_{s}.{c}") for c in ("business_name", "phone", "email", "pan", "gstin")]) for s in ("a", "b")]
        return out.select("pair_id", payload.alias("payload"), pii.explanation(*map(f, scoring.FEATURES), F.col("score"), F.col("decision")).alias("explanation"), F.concat(*left).alias("violations"))

    def decide(self, pair_id: str, decision: str, reviewer: str, notes: str | None = None) -> None:
        """A reviewer's decision: the pair, the ledger, and the merge if it confirms."""
        before = self.pairs().where(F.col("id") == pair_id).first()
        if before is None:
            raise KeyError(pair_id)
        if before["review_status"] != "PENDING" and before["reviewer_id"] == reviewer:
            return
        said = self.spark.createDataFrame([(pair_id, decision, reviewer, notes, self.now, time.time_ns())], SCHEMAS["review_decisions"])
        self.store.append("review_decisions", said)
        entry = said.select(F.lit(3).alias("o"), F.col("pair_id").alias("aggregate_id"), F.lit("REVIEW_DECIDED").alias("event_type"), F.lit("REVIEW").alias("aggregate_type"), ledger.canonical(F.struct("decision", "notes", "reviewer_id", F.lit(before["score"]).cast("double").alias("score"))).alias("payload"))
        self._record(entry)
        if decision == "CONFIRM":
            links = materialise(named.confirmed_links(self.pairs().where(F.col("id") == pair_id), self.t("ubid_source_records")), "confirmed")
            if not links.isEmpty():
                self._merge(links)

    def _merge(self, links: DataFrame) -> None:
        """Merges that people decided: (winner, loser, score, decided_by)."""
        rows = materialise(links.withColumns({"merge_id": F.sha2(F.concat_ws("|", "winner", "loser", F.col("score").cast("string")), 256), "step": F.lit(0)}), "merges")
        masters = materialise(resolution.apply_merges(self.t("ubid_master"), rows), "masters")
        self.store.overwrite("ubid_master", masters)
        self.store.overwrite("ubid_source_records", resolution.repoint(self.t("ubid_source_records"), masters))
        self.store.append("merge_provenance", rows.select("merge_id", F.col("winner").alias("ubid_winner"), F.col("loser").alias("ubid_loser"), "score", F.lit(scoring.MODEL_VERSION).alias("model_version"), "decided_by", F.lit(self.now).alias("decided_at"), F.lit(None).cast("string").alias("feature_breakdown"), F.lit(False).alias("reversed")))
        self._record(rows.select(F.lit(1).alias("o"), F.col("merge_id").alias("aggregate_id"), F.lit("UBID_MERGED").alias("event_type"), F.lit("MERGE").alias("aggregate_type"), ledger.canonical(F.struct("loser", "score", "winner")).alias("payload")))

    def reverse_merge(self, merge_id: str, reason: str, by: str = "admin") -> None:
        merges = self.t("merge_provenance").withColumnsRenamed({"ubid_winner": "winner", "ubid_loser": "loser"})
        masters, after, reversal = resolution.reverse(self.t("ubid_master"), merges, merge_id, reason, by, self.now)
        self.store.overwrite("ubid_master", masters)
        self.store.overwrite("merge_provenance", after.withColumnsRenamed({"winner": "ubid_winner", "loser": "ubid_loser"}))
        self.store.append("merge_reversals", reversal)
        self._record(reversal.select(F.lit(4).alias("o"), F.col("reversal_id").alias("aggregate_id"), F.lit("MERGE_REVERSED").alias("event_type"), F.lit("MERGE").alias("aggregate_type"), ledger.canonical(F.struct("merge_id", "reason", "reversed_by")).alias("payload")))

    def reviewer_history(self, reviewer: str, limit: int = 50) -> DataFrame:
        return named.reviewer_history(self.pairs().withColumnRenamed("id", "pair_id"), reviewer, limit)

    def reviewer_kpis(self) -> DataFrame:
        return named.reviewer_kpis(self.pairs())

    # ---- models

    def _features(self) -> DataFrame:
        norm = blocking.normalised(self.t("business_records"))
        pairs = self.pairs().select(F.col("id").alias("pair_id"), "record_a_id", "record_b_id")
        return materialise(scoring.with_features(scoring.with_records(pairs, norm)), "features")

    def train(self) -> dict:
        model, found = evaluation.train(self._features())
        self.models.register(model.version, model, found)
        return found

    def active_learning(self) -> dict:
        n = self.pairs().where(F.col("review_status").isin("CONFIRM", "REJECT")).count()
        return evaluation.active_learning(self._features(), n)

    def predict(self, *features: float) -> float:
        """The active model's probability of five features."""
        row = self.spark.createDataFrame([tuple(map(float, features))], ", ".join(f"{f} double" for f in scoring.FEATURES))
        model = self.models.load()
        scored = model(row) if model else row.withColumn("score", scoring.linear_score(*map(F.col, scoring.FEATURES)))
        return float(scored.first()["score"])

    # ---- operations

    def infrastructure(self) -> dict:
        """What runs, and that adapters only read."""
        return {"spark": self.spark.version, "master": self.spark.sparkContext.master, "adapters": adapters.list_adapters(), "read_only": adapters.read_only_report(), "model": self.models.active(), "pair_filter": bloom_sizing(FILTER_PAIRS, FILTER_RATE)}


def bloom_sizing(n: int, p: float) -> dict[str, int]:
    """Bits and hash functions of a Bloom filter of n items at a false-positive rate of p."""
    import math

    m = int(-n * math.log(p) / math.log(2) ** 2)
    return {"bits": m, "hashes": int(m / n * math.log(2))}
