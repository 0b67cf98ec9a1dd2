import hashlib
import hmac
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, scoring
from tessera.plans.engine import Engine, bloom_sizing
from tessera.sources import adapters, store
from tessera.sources.demo import Demo
from tessera.sources.store import Store
from tessera.streaming import jobs


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")), date(2024, 6, 30))
    rows = adapters.get_adapter("synthetic")(spark, businesses="60", seed="1").pull()
    records = rows.withColumns({"registration_date": F.to_date("registration_date"), "content_hash": F.lit("h")})
    e.load("business_records", records)
    kinds = F.array(*[F.lit(k) for k in ("STRONG_ACTIVE", "WEAK_ACTIVE", "NEUTRAL", "DORMANCY", "CLOSURE")])
    n = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(400)).cast("int")
    events = records.select(F.concat(F.lit("E"), "id").alias("id"), F.lit(None).cast("string").alias("ubid"), "source_system", F.lit("TAX_PAYMENT").alias("event_type"), F.get(kinds, n % 5).alias("signal_class"), F.date_sub(F.lit(date(2024, 6, 30)), n).alias("event_date"), F.to_json(F.struct(F.col("id").alias("record_ref"))).alias("payload"))
    e.load("activity_events", events)
    return e, {k: v.collect() for k, v in e.run_all().items()}


def test_run_all(engine):
    e, out = engine
    assert out["blocking"][0]["total_pairs"] > 0 and out["resolution"][0]["active_ubids"] > 0
    assert sum(r["n"] for r in out["activity"]) >= out["resolution"][0]["active_ubids"]
    assert e.verify_ledger().first()["verified"]
    assert e.recompute_from_ledger().first()["verified"]
    assert e.t("activity_events").where("ubid IS NULL").count() == 0
    assert e.run_scoring().count() > 0  # nothing is left to score; the decisions stay


def test_queries_are_audited(engine):
    e, _ = engine
    district = e.sector_trend("Bengaluru").collect()
    assert sum(r["n"] for r in district) > 0
    assert e.active_not_inspected("560001").count() >= 0
    assert e.ghost_candidates().count() >= 0
    assert e.search("ubid-gst").count() >= 0
    assert {"sector_trend", "active_not_inspected", "ghost_candidates", "identity_search"} <= {r["query_type"] for r in e.audit_log().collect()}
    assert e.department_coverage().count() > 0 and e.statistics().count() == 1 and e.pipeline_counts().count() == 4 and e.departments().count() == 5
    assert e.fuzzy_search("apxe").count() > 0
    mode, rows = e.find("ápex textiles")
    assert mode == "index" and rows.count() > 0 and e.find("")[0] == "predicates"
    assert e.infrastructure()["read_only"]["verified"]


def test_identity_detail(engine):
    e, _ = engine
    ubid = e.t("ubid_source_records").groupBy("ubid").count().orderBy(F.desc("count")).first()["ubid"]
    found = e.identity(ubid)
    n = found["sources"].count()
    assert found["identity"].count() == 1 and found["edges"].count() == n * (n - 1) // 2
    with pytest.raises(KeyError):
        e.identity("UBID-none")


def test_reviews_merge_and_reverse(engine):
    e, _ = engine
    homes = {r["record_id"]: r["ubid"] for r in e.t("ubid_source_records").collect()}
    pair = next(r for r in e.review_queue(limit=1000).collect() if homes[r["record_a_id"]] != homes[r["record_b_id"]])
    e.decide(pair["pair_id"], "CONFIRM", "ann", "same")
    e.decide(pair["pair_id"], "REJECT", "ann")  # a reviewer's own repeat changes nothing
    assert [r["review_status"] for r in e.reviewer_history("ann").collect()] == ["CONFIRM"]
    assert e.reviewer_kpis().first()["confirmed"] == 1
    said = e.explanation(pair["pair_id"]).first()
    assert said["violations"] == [] and "RECOMMENDATION" in said["explanation"]
    mine = e.t("merge_provenance").where("decided_by = 'ann'").collect()
    assert len(mine) == 1  # what waits for review isn't one identity yet
    e.reverse_merge(mine[0]["merge_id"], "test")
    with pytest.raises(ValueError):
        e.reverse_merge(mine[0]["merge_id"], "test")
    kept = sorted(map(tuple, e.t("merge_provenance").select("merge_id", "decided_by", "reversed").collect()))
    states = {r["ubid"]: r["status"] for r in e.t("ubid_master").collect()}
    homes = {r["record_id"]: r["ubid"] for r in e.t("ubid_source_records").collect()}
    entries = e.t("event_ledger").count()
    e.run_resolution()  # another run keeps the reviewer's merge and its reversal, and tells nothing twice
    assert sorted(map(tuple, e.t("merge_provenance").select("merge_id", "decided_by", "reversed").collect())) == kept
    assert {r["ubid"]: r["status"] for r in e.t("ubid_master").collect()} == states
    assert {r["record_id"]: r["ubid"] for r in e.t("ubid_source_records").collect()} == homes
    assert e.t("event_ledger").count() == entries
    assert e.verify_ledger().first()["verified"] and e.recompute_from_ledger().first()["verified"]
    with pytest.raises(KeyError):
        e.decide("none", "CONFIRM", "ann")


def test_predict_by_weights(engine):
    assert engine[0].predict(1, 1, 1, 1, 1) == pytest.approx(1.0)


def test_bloom_sizing():
    assert bloom_sizing(50_000_000, 0.001) == {"bits": 718_879_378, "hashes": 9}


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.read("query_audit").count() == 0
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    s.overwrite("t", df)
    s.append("t", spark.createDataFrame([(3, "c")], "k bigint, v string"))
    s.upsert("t", spark.createDataFrame([(2, "z")], "k bigint, v string"), "k")
    assert sorted(map(tuple, s.read("t").collect())) == [(1, "a"), (2, "z"), (3, "c")]
    s.overwrite("t", s.read("t").where("k > 1"))
    assert s.read("t").count() == 2
    assert sorted(map(tuple, store.first_by(df.unionByName(df.withColumn("v", F.lit("y"))), "k", "v").collect())) == [(1, "y"), (2, "y")]
    store.export_csv(spark.createDataFrame([(1, None), (2, 'q"')], "k bigint, v string").coalesce(1), f"{tmp_path}/csv")
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text.splitlines()[:2] == ["k,v", "1,"]


def test_topic_logs(spark, tmp_path):
    root = str(tmp_path)
    made = lambda a, b: spark.range(a, b).selectExpr("CAST(id % 7 AS string) AS key", "CAST(id AS string) AS value")
    for a, b in ((0, 100), (100, 130), (130, 130)):
        jobs.publish(made(a, b), root, "ubid.events")
    log = jobs.messages(spark, root, "ubid.events").collect()
    assert sorted(int(r["value"]) for r in log) == list(range(130))
    by = {}
    for r in log:
        by.setdefault(r["partition"], []).append((r["offset"], int(r["value"]), r["key"]))
    assert all(sorted(o for o, *_ in rows) == list(range(len(rows))) for rows in by.values())
    assert all(max(o for o, v, _ in rows if v < 100) < min((o for o, v, _ in rows if v >= 100), default=10**9) for rows in by.values())
    assert len({(k, p) for p, rows in by.items() for *_, k in rows}) == 7 and set(by) <= set(range(6))
    assert {r["partition"]: r["next_offset"] for r in jobs.topic_statistics(spark, root).collect()} == {p: len(rows) for p, rows in by.items()}
    assert jobs.topic_settings("system.alerts") == {"partitions": 1, "retention.ms": 30 * 86_400_000}
    assert jobs.messages(spark, root, "system.alerts").count() == 0


def test_adapters(spark, tmp_path):
    assert adapters.list_adapters() == ["api", "parquet", "synthetic", "webhook"]
    assert adapters.get_adapter("api")(spark).pull().count() == 0
    with pytest.raises(KeyError):
        adapters.get_adapter("none")
    body = json.dumps({"id": "r1", "business_name": "Apex"})
    good = hmac.new(b"k", body.encode(), hashlib.sha256).hexdigest()
    (tmp_path / "drops.json").write_text("\n".join(json.dumps(x) for x in ({"body": body, "signature": good}, {"body": body, "signature": "0" * 64}, {"body": body, "signature": None})))
    got = adapters.get_adapter("webhook")(spark, path=str(tmp_path), secret="k").pull().collect()
    assert [(r["id"], r["business_name"]) for r in got] == [("r1", "Apex")]
    one, two = (adapters.get_adapter("synthetic")(spark, businesses="40", slices=n).pull() for n in ("1", "4"))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    two.write.parquet(f"{tmp_path}/pq")
    assert adapters.get_adapter("parquet")(spark, path=f"{tmp_path}/pq", source_system="GST").pull().where("source_system <> 'GST'").count() == 0


def test_synthetic_events_labels_and_health(spark):
    made = adapters.get_adapter("synthetic")(spark, businesses="400", today="2024-06-30")
    records, events, labels = made.pull().toPandas(), made.events().toPandas(), made.labels().toPandas()
    of = records.groupby("gt_id")["id"].apply(set)
    assert records["id"].is_unique and of.map(len).between(2, 10).all() and len(of) == 400
    want = {(min(a, b), max(a, b)) for ids in of for a in ids for b in ids if a != b}
    assert {(min(p), max(p)) for p in zip(labels["record_a_id"], labels["record_b_id"], strict=True)} == want
    known = set(records["id"])
    gt = events["payload"].map(lambda p: json.loads(p)["business_gt_id"])
    assert events["payload"].map(lambda p: json.loads(p)["record_ref"] in known).all() and set(gt) == set(of.index)
    last = events.groupby(gt)["event_date"].max()
    silent = sum((date(2024, 6, 30) - d).days >= 540 for d in last)
    assert 0.06 * 400 <= silent <= 0.2 * 400
    closed = events[events["event_type"] == "CLOSURE_CERT"]
    assert 0.01 * 400 <= len(closed) <= 0.1 * 400 and ((date(2024, 6, 30) - closed["event_date"].iloc[0]).days in range(30, 366))
    share = lambda m: float(m.mean())
    names = records["business_name"]
    assert 0.1 < share(names.str.startswith("M/s ") | names.str.startswith("m/s ")) + share(names == names.str.upper()) < 0.5
    assert 0.01 < share(~records["address_pincode"].str.startswith("5600")) < 0.08
    health = made.health(datetime(2024, 7, 1)).collect()
    assert {r["source_system"]: r["total_records"] for r in health} == records["source_system"].value_counts().to_dict()
    assert all(10 <= r["freshness_seconds"] <= 300 and r["status"] == "HEALTHY" for r in health)


def test_businesses_of_a_table(spark):
    """Made from a table's numbers as from a range of them; nulls make none."""
    from tessera.sources import synthetic

    numbers = spark.createDataFrame([(7,), (3,), (None,)], "k int").repartition(2)
    got = sorted(map(tuple, synthetic.of_numbers(numbers, "k", "records", 42, date(2024, 1, 1)).collect()))
    assert got == sorted(r for b in (3, 7) for r in synthetic.Business(b, 42, date(2024, 1, 1)).records())


class _Writer(adapters.Adapter):
    def update_rows(self): ...


def test_a_writing_adapter_is_reported():
    adapters.register_adapter("bad")(_Writer)
    try:
        assert adapters.read_only_report()["violations"] == ["bad.update_rows"]
    finally:
        del adapters.ADAPTERS["bad"]


def test_topics_and_late_events(spark, tmp_path):
    root = str(tmp_path)
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "a" if i % 2 else "b", 1.0) for i in range(20)] + [(5, "2024-01-01 00:05:00", "a", 1.0)]
    df = spark.createDataFrame(rows, "id bigint, t string, k string, v double").withColumn("at", F.to_timestamp("t")).drop("t")
    df.write.json(f"{root}/business.records.raw")
    stream = jobs.read_topic(spark, root, "business.records.raw", "id bigint, k string, v double, at timestamp")
    jobs.emit(jobs.deduplicated(stream, ["id"], "at"), root, "business.records.canonical", f"{root}/c1").awaitTermination()
    clean = spark.read.schema("id bigint, k string, v double, at timestamp").json(f"{root}/business.records.canonical")
    assert clean.count() == 20
    out = jobs.run_to_end(jobs.windowed(jobs.read_topic(spark, root, "business.records.canonical", clean.schema), "at", "k", "v", "10 minutes"), f"{root}/w", f"{root}/c2", "complete")
    assert {(r["start"].minute, r["k"]): r["n"] for r in out.collect()} == {(0, "a"): 5, (0, "b"): 5, (10, "a"): 5, (10, "b"): 5}
    with pytest.raises(KeyError):
        jobs.read_topic(spark, root, "none", clean.schema)


def test_heartbeats(spark):
    beats = spark.createDataFrame([("GST", datetime(2024, 1, 1, 0, 0, 0)), ("KSPCB", datetime(2024, 1, 1, 0, 2, 0))], "source_system string, beat_at timestamp")
    got = {r["source_system"]: r["state"] for r in jobs.heartbeats(beats, datetime(2024, 1, 1, 0, 2, 30)).collect()}
    assert got == {"GST": "STALE", "KSPCB": "ALIVE"}


def test_signal_totals(spark, tmp_path):
    rows = [("u", "STRONG_ACTIVE", datetime(2024, 1, 1, 5)), ("u", "CLOSURE", datetime(2024, 1, 1, 7)), ("v", "NEUTRAL", datetime(2024, 2, 1))]
    df = spark.createDataFrame(rows, "ubid string, signal_class string, event_time timestamp")
    df.write.parquet(f"{tmp_path}/in")
    out = jobs.run_to_end(jobs.signal_totals(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/c", "complete")
    assert {(r["ubid"], r["weight"], r["n"]) for r in out.collect()} == {("u", -1.0, 2), ("v", 0.0, 1)}


def test_demo_views(spark, sf):
    d = Demo(spark, sf)
    assert d.records().count() == 200 and d.source_records().count() > 100 and d.masters().count() == 150


def test_stale_sources(spark, tmp_path):
    """Two batches: the second moves event time far enough that the first source's last beat is stale."""
    schema = "source_system string, beat_at timestamp"
    batches = [[("GST", datetime(2024, 1, 1, 0, 0)), ("GST", datetime(2024, 1, 1, 0, 1))], [("LABOUR", datetime(2024, 1, 1, 1, 0))], [("LABOUR", datetime(2024, 1, 1, 1, 1))]]
    said = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.stale_sources(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        collect = lambda b, n: said.extend(map(tuple, b.select("source_system", "state").collect()))
        stream.writeStream.outputMode("update").foreachBatch(collect).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert ("GST", "ALIVE") in said and ("GST", "STALE") in said and ("LABOUR", "ALIVE") in said


def test_blocking_again_scores_only_what_is_new(engine):
    e, _ = engine
    before = {r["id"]: (r["score"], r["review_status"]) for r in e.pairs().collect()}
    e.run_blocking()
    assert e.last_new == 0
    assert {r["id"]: (r["score"], r["review_status"]) for r in e.pairs().collect()} == before
    # a record changes: its pairs are new ones, the others keep their scores
    records = e.t("business_records").persist()
    one = e.pairs().first()["record_a_id"]
    e.load("business_records", records.withColumn("email", F.when(F.col("id") == one, "new@firm.in").otherwise(F.col("email"))))
    e.run_blocking()
    open_ = e.pairs().where("score IS NULL").collect()
    assert open_ and e.last_new == len(open_) and all(one in (r["record_a_id"], r["record_b_id"]) for r in open_)
    e.run_scoring()
    after = {r["id"]: r["review_status"] for r in e.pairs().collect()}
    assert after == {k: v[1] for k, v in before.items()}
    e.load("business_records", records)


def test_parts_become_one_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MAX_PARTS", 3)
    s = Store(spark, str(tmp_path))
    for i in range(10):
        s.append("ledger", spark.createDataFrame([(i,)], "n int"))
        assert [r["n"] for r in s.newest("ledger").collect()][-1:] == [i] or s.newest("ledger").count() > 1
    assert sorted(r["n"] for r in s.read("ledger").collect()) == list(range(10))
    last = [v.endswith("-full") for v in s._versions("ledger")]
    assert any(last) and len(last) - 1 - max(i for i, full in enumerate(last) if full) <= 3


def test_search_tells_how_many(engine):
    e, _ = engine
    mode, total, rows = e.find_page("textiles", limit=2)
    assert mode == "index" and rows.count() == min(2, total) and total >= 1
    assert e.find_page("")[0] == "predicates"


def test_deprecated_identities_are_not_found(engine):
    e, _ = engine
    gone = e.t("ubid_master").where("status = 'DEPRECATED'").first()
    assert gone is not None and e.search(gone["ubid"]).count() == 0


def test_consumers_of_a_topic(spark, tmp_path):
    """Polls go on from the last commit, a group has offsets of its own, and a stream that fails in a batch has each message once in the end."""
    root, topic = str(tmp_path), "system.alerts"
    put = lambda a, b: jobs.publish(spark.range(a, b).selectExpr("CAST(id AS string) AS key", "CAST(id AS string) AS value"), root, topic)
    read = lambda df: sorted(int(r["value"]) for r in df.collect())
    put(0, 10)
    one = jobs.Consumer(spark, root, topic, "g")
    first = read(one.poll(4))
    assert len(first) == 4
    again = jobs.Consumer(spark, root, topic, "g")
    assert read(again.poll(4)) == first  # not committed
    again.commit()
    rest = read(again.poll(100))
    assert sorted(first + rest) == list(range(10)) and again.poll(5).isEmpty()
    again.commit()
    assert jobs.Consumer(spark, root, topic, "other").lag().first()["lag"] == 10
    assert jobs.Consumer(spark, root, topic, "g").lag().first()["lag"] == 0
    again.seek({0: 7})
    assert len(read(jobs.Consumer(spark, root, topic, "g").poll())) == 3
    seen, fail = {}, [True]

    def sink(batch, no):
        if no == 1 and fail:
            fail.clear()
            raise RuntimeError("lost")
        seen[no] = read(batch)

    live = jobs.Consumer(spark, root, topic, "live")
    live.follow(sink)
    put(10, 30)
    with pytest.raises(Exception, match="lost"):
        live.follow(sink)
    jobs.Consumer(spark, root, topic, "live").follow(sink, files=1)
    put(30, 35)
    live.follow(sink)
    assert sorted(x for xs in seen.values() for x in xs) == list(range(35))
    assert jobs.Consumer(spark, root, topic, "live").lag().first()["lag"] == 0
    with pytest.raises(KeyError):
        jobs.Consumer(spark, root, "none", "g")


def test_a_promotion_counts_from_the_next_batch_on(spark, tmp_path):
    models = evaluation.Registry(spark, f"{tmp_path}/models")
    models.register("lr-calibrated-v2", evaluation.Calibrated([([0.0] * 5, 9.0, 1.0, 0.0)]), {})
    schema = "pair_id string, " + ", ".join(f"{f} double" for f in scoring.FEATURES)
    put = lambda i: spark.createDataFrame([(f"p{i}", 0.0, 0.0, 0.0, 0.0, 0.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = {}

    def each(batch, no):
        for r in batch.collect():
            seen[r["pair_id"]] = (no, r["model_version"], r["decision"])
            if r["pair_id"] == "p0":
                models.promote("lr-calibrated-v2")  # while the stream runs

    put(0)
    put(1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.score_stream(stream, models, each, f"{tmp_path}/state").awaitTermination()
    assert seen["p0"][1:] == ("weighted-linear-v1", "HOLD") and seen["p1"][1:] == ("lr-calibrated-v2", "AUTO_LINK") and seen["p0"][0] < seen["p1"][0]
