import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import activity, blocking, evaluation, ledger, resolution, scoring
from tessera.plans import named

REF = date(2024, 6, 30)


# ---- resolution against one record after another

def sequential(rows):
    """(id, pan, gstin) in order of id: join the GSTIN's identity, else the PAN's, else found one."""
    known, out = set(), {}
    for i, p, g in sorted(rows):
        if g and f"UBID-GST-{g}" in known:
            out[i] = f"UBID-GST-{g}"
        elif p and f"UBID-PAN-{p}" in known:
            out[i] = f"UBID-PAN-{p}"
        elif g or p:
            out[i] = f"UBID-GST-{g}" if g else f"UBID-PAN-{p}"
            known.add(out[i])
        else:
            out[i] = "internal"
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_assign_matches_one_after_another(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, *"abcdef"]), r.choice([None, *"uvwxyz"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, valid_pan string, valid_gstin string")
    got = {x["id"]: x["ubid"] for x in resolution.assign(df).collect()}
    want = sequential(rows)
    assert {k: "internal" if v.startswith("UBID-INT-") else v for k, v in got.items()} == want
    assert len({v for v in got.values() if v.startswith("UBID-INT-")}) == sum(v == "internal" for v in want.values())


def test_assign_with_existing(spark):
    df = spark.createDataFrame([(1, "p", "g"), (2, "q", None), (3, None, "d"), (4, None, "d")], "id bigint, valid_pan string, valid_gstin string")
    old = spark.createDataFrame([("UBID-PAN-p", "PAN", "p", "ACTIVE"), ("UBID-GST-d", "GSTIN", "d", "DEPRECATED")], "ubid string, anchor_type string, anchor_value string, status string")
    got = {x["id"]: x["ubid"] for x in resolution.assign(df, old).collect()}
    assert got[1] == "UBID-PAN-p" and got[2] == "UBID-PAN-q"
    assert got[3].startswith("UBID-INT-") and got[4].startswith("UBID-INT-") and got[3] != got[4]


@pytest.mark.parametrize("seed", [0, 1])
def test_merge_matches_one_after_another(spark, seed):
    r = random.Random(seed)
    ids = [f"u{i}" for i in range(40)]
    counts = {u: r.randrange(1, 4) for u in ids}
    links = [(*r.sample(ids, 2), round(r.random(), 3), i, 1000 + i) for i in range(45)]
    up, size, want = {u: u for u in ids}, dict(counts), []
    for a, b, s, x, y in sorted(links, key=lambda t: (-t[2], t[3], t[4])):
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        if a != b:
            w, lo = (a, b) if size[a] >= size[b] else (b, a)
            up[lo], size[w] = w, size[w] + size[lo]
            want.append((w, lo, s))
    df = spark.createDataFrame(links, "ubid_a string, ubid_b string, score double, record_a_id bigint, record_b_id bigint")
    n = spark.createDataFrame(list(counts.items()), "ubid string, n_records bigint")
    merges = resolution.merge(df, n)
    assert sorted((x["winner"], x["loser"], x["score"]) for x in merges.collect()) == sorted(want)
    masters = n.select("ubid", F.lit("ACTIVE").alias("status"), F.lit(None).cast("string").alias("deprecated_by_ubid"))
    ends = {x["ubid"]: x["active_ubid"] for x in resolution.active_of(resolution.apply_merges(masters, merges)).collect()}
    for u in ids:
        a = u
        while up[a] != a:
            a = up[a]
        assert ends[u] == a


def test_chain_and_cycle(spark):
    rows = [("a", "DEPRECATED", "b"), ("b", "DEPRECATED", "c"), ("c", "ACTIVE", None), ("x", "DEPRECATED", "y"), ("y", "DEPRECATED", "x")]
    df = spark.createDataFrame(rows, "ubid string, status string, deprecated_by_ubid string")
    got = {x["ubid"]: x["active_ubid"] for x in resolution.active_of(df).collect()}
    assert (got["a"], got["b"], got["c"]) == ("c", "c", "c") and got["x"] in "xy"


def test_reverse_twice(spark):
    masters = spark.createDataFrame([("w", "ACTIVE", None), ("l", "DEPRECATED", "w")], "ubid string, status string, deprecated_by_ubid string")
    merges = spark.createDataFrame([("m", "w", "l", False)], "merge_id string, winner string, loser string, reversed boolean")
    back, after, row = resolution.reverse(masters, merges, "m", "wrong", "admin", datetime(2024, 1, 1))
    assert {(x["ubid"], x["status"], x["deprecated_by_ubid"]) for x in back.collect()} == {("w", "ACTIVE", None), ("l", "ACTIVE", None)}
    assert row.first()["merge_id"] == "m"
    with pytest.raises(ValueError):
        resolution.reverse(back, after, "m", "again", "admin", datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        resolution.reverse(back, after, "none", "", "", datetime(2024, 1, 1))


# ---- blocking and scoring

def records(spark, rows):
    columns = "id string, business_name string, address_pincode string, pan string, gstin string, address_locality string, address_district string, phone string, email string, registration_date date, gt_id string"
    n = len(columns.split(","))
    return spark.createDataFrame([(*r, *[None] * (n - len(r))) for r in rows], columns)


def test_groups_over_the_cap_are_skipped(spark):
    for n, want in ((50, 1225), (51, 0)):
        df = records(spark, [(f"r{i:03d}", "zeta motors", "560001") for i in range(n)])
        assert blocking.candidate_pairs(blocking.normalised(df)).count() == want
    anchored = records(spark, [(f"r{i:03d}", f"n{i}", None, "ABCDE1234F") for i in range(60)])
    assert blocking.candidate_pairs(blocking.normalised(anchored)).count() == 60 * 59 // 2


def test_stars_stand_for_all_pairs_of_an_anchor(spark):
    """Counts, scores and components equal those of all pairs; a large group of equal records costs a row."""
    from tessera.operators.components import connected_components

    r = random.Random(2)
    rows = []
    for i in range(80):
        kind = r.randrange(6)
        rows.append((f"r{i:03d}", ["zeta motors", "zeta motor", "yak foods"][kind % 3], "560001", f"ABCDE123{kind // 2}F", "29ABCDE1230F1Z5" if kind == 5 else None, "whitefield", "X", None, None, date(2020, 1, 1), None))
    norm = blocking.normalised(records(spark, rows)).persist()
    full = scoring.score_pairs(blocking.candidate_pairs(norm).where("blocking_keys[0] = 'ANCHOR'"), norm).persist()
    stars = blocking.anchor_stars(norm).withColumn("pair_id", blocking.pair_id("record_a_id", "record_b_id"))
    scored = scoring.score_pairs(stars, norm).persist()
    assert scored.count() < 40 < full.count()
    tell = lambda df, n: sorted((x["decision"], round(x["score"], 9), x["n"]) for x in df.groupBy("decision", "score").agg(n.alias("n")).collect())
    assert tell(scored, F.sum("links")) == tell(full, F.count("*"))
    parts = lambda links: {(x["node"], x["root"]) for x in connected_components(links, "record_a_id", "record_b_id").collect()}
    links = blocking.star_links(scored, norm)
    assert parts(links) == parts(full.where("decision = 'AUTO_LINK'")) and links.count() < 120
    many = records(spark, [(f"m{i:06d}", "one name", "560001", "ABCDE1234F") for i in range(20_000)])
    big = blocking.anchor_stars(blocking.normalised(many)).collect()
    assert [(x["record_a_id"], x["links"]) for x in big] == [("m000000", 20_000 * 19_999 // 2)]


def test_first_strategy_wins(spark):
    df = records(spark, [("a", "zeta motors", "560001", "ABCDE1234F"), ("b", "zeta motors", "560001", "ABCDE1234F")])
    assert [x["blocking_keys"] for x in blocking.candidate_pairs(blocking.normalised(df)).collect()] == [["ANCHOR"]]


@pytest.mark.parametrize("features, score, decision", [((0, 1, 1, 1, 1), 0.60, "REVIEW"), ((1, 1, 1, 0, 0), 0.85, "REVIEW"), ((-0.5, 1, 1, 1, 1), 0.40, "HOLD"), ((1, 1, 1, 1, 1), 1.0, "AUTO_LINK")])
def test_scores(spark, features, score, decision):
    df = spark.createDataFrame([tuple(map(float, features))], ", ".join(f"{f} double" for f in scoring.FEATURES))
    row = df.withColumn("s", scoring.linear_score(*map(F.col, scoring.FEATURES))).withColumn("d", scoring.route(F.col("s"), F.col("anchor_score"))).first()
    assert row["s"] == pytest.approx(score) and row["d"] == decision


def test_pair_features(spark):
    a = ("a", "Apex Textiles Ltd", "560001", "ABCDE1234F", None, "kiadb peenya", "Bengaluru", "+91 98-123", "x@firm.in", date(2020, 1, 1), "g")
    b = ("b", "Textiles Apex", "560001", None, None, "Peenya Phase 2", "BENGALURU", "98123", "y@firm.in", date(2021, 2, 14), "g")
    norm = blocking.normalised(records(spark, [a, b]))
    row = scoring.score_pairs(blocking.candidate_pairs(norm).limit(0).unionByName(spark.createDataFrame([("p", "a", "b", ["ANCHOR"])], "pair_id string, record_a_id string, record_b_id string, blocking_keys array<string>")), norm).first()
    assert (row["anchor_score"], row["name_score"], row["address_score"], row["contact_score"]) == (0.0, 1.0, pytest.approx(1.0), 1.0)
    assert row["date_proximity_score"] == pytest.approx(0.5)


# ---- activity

def events(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, ubid string, event_date date, signal_class string")


def status_of(spark, *rows):
    ev = events(spark, [("u", d, s) for d, s in rows])
    masters = spark.createDataFrame([("u", "ACTIVE")], "ubid string, status string")
    return activity.status(ev, masters, REF).first(), ev, masters


def ago(n):
    return date.fromordinal(REF.toordinal() - n)


def test_status(spark):
    row, _, _ = status_of(spark, (REF, "STRONG_ACTIVE"))
    assert (row["score"], row["status"]) == (3.0, "ACTIVE")
    assert status_of(spark, *[(ago(181), "STRONG_ACTIVE")] * 4)[0]["status"] == "DORMANT"
    assert status_of(spark, (ago(10), "CLOSURE"), (REF, "STRONG_ACTIVE"))[0]["status"] == "CLOSED"
    assert status_of(spark, (ago(600), "CLOSURE"))[0]["status"] == "DORMANT"
    row, _, _ = status_of(spark, (ago(548), "WEAK_ACTIVE"), (ago(549), "WEAK_ACTIVE"), (ago(-1), "WEAK_ACTIVE"))
    assert row["event_count"] == 1


def test_state_moves_on(spark):
    """Steps of all lengths, also beyond the whole window, equal the state made anew."""
    r = random.Random(8)
    rows = [(f"u{r.randrange(12)}", ago(r.randrange(0, 1500)), r.choice(list(activity.SIGNALS))) for _ in range(400)] + [("u1", ago(548), "STRONG_ACTIVE"), ("u2", ago(549), "CLOSURE"), (None, ago(3), "CLOSURE")]
    ev = events(spark, rows).persist()
    tell = lambda df: {x["ubid"]: (round(x["score"], 9), *(x[c] for c in activity.STATE[1:])) for x in df.collect()}
    for steps in ((900, 899, 700, 0), (1400, 100, 100, 0), (548, 0), (1, 0)):
        state = activity.window_state(ev, ago(steps[0]))
        for was, ref in zip(steps, steps[1:], strict=False):
            state = activity.advance(state, ev, ago(was), ago(ref))
        assert tell(state) == tell(activity.window_state(ev, REF))
    with pytest.raises(ValueError):
        activity.advance(state, ev, REF, ago(1))


def test_tipping_point(spark):
    _, ev, masters = status_of(spark, (ago(180), "STRONG_ACTIVE"), (REF, "STRONG_ACTIVE"))
    got = activity.timeline(ev, activity.status(ev, masters, REF), REF).where("is_tipping_point").collect()
    assert [x["event_date"] for x in got] == [REF]


# ---- ledger

def test_ledger_errors(spark):
    df = spark.createDataFrame([(i, f'{{"n":{i}}}') for i in range(40)], "seq bigint, payload string").repartition(4)
    book = ledger.chain(df, "seq", "payload")
    assert ledger.verify(book).first()["verified"] and ledger.verify(book.where("false")).first()["verified"]
    altered = book.withColumn("payload", F.when(F.col("seq") == 0, "x").otherwise(F.col("payload")))
    assert [(x["ledger_id"], x["error"]) for x in ledger.errors(altered).collect()] == [(1, "hash mismatch")]
    assert [(x["ledger_id"], x["error"]) for x in ledger.errors(book.where("ledger_id <> 7")).collect()] == [(8, "prev_hash mismatch")]
    ledger_stride, ledger.STRIDE = ledger.STRIDE, 8
    try:
        assert ledger.errors(book).count() == 0 and ledger.errors(book.where("ledger_id not between 5 and 30")).count() == 1
    finally:
        ledger.STRIDE = ledger_stride


# ---- model

def test_train_promote_rollback(spark, tmp_path):
    r = random.Random(0)
    rows = []
    for i in range(400):
        y = i % 2
        f = [float(y and r.random() < 0.6), min(1.0, max(0.0, 0.3 + 0.5 * y + r.gauss(0, 0.1))), min(1.0, max(0.0, 0.4 + 0.4 * y + r.gauss(0, 0.1))), float(y and r.random() < 0.5), r.random()]
        rows.append((f"p{i}", {"gt_id": "g" if y else "h"}, {"gt_id": "g"}, *f))
    df = spark.createDataFrame(rows, "pair_id string, a struct<gt_id:string>, b struct<gt_id:string>, " + ", ".join(f"{f} double" for f in scoring.FEATURES))
    model, found = evaluation.train(df)
    assert found["pr_auc"] > 0.97 and found["roc_auc"] > 0.97 and found["false_merge_rate"] < 0.05
    reg = evaluation.Registry(spark, str(tmp_path))
    reg.register(model.version, model, found)
    assert reg.active() == reg.DEFAULT and reg.load() is None
    reg.promote(model.version)
    assert reg.active() == model.version and reg.metrics()["pr_auc"] == found["pr_auc"]
    same = reg.load()(df).select("score").collect()
    assert same == model(df).select("score").collect()
    assert reg.rollback() == reg.DEFAULT
    with pytest.raises(ValueError):
        reg.promote("none")
    with pytest.raises(ValueError):
        evaluation.train(df.limit(10))
    assert evaluation.active_learning(df, 3)["status"] == "skipped"
    assert "<table>" in evaluation.report(found, [], [])


def pairs_of_a_model(spark, n=900):
    """Pairs whose labels follow the features with noise."""
    r = random.Random(5)
    rows = []
    for i in range(n):
        f = [r.choice([-0.5, 0.0, 1.0]), *[r.random() for _ in range(4)]]
        y = int(2 * f[0] + 3 * f[1] + f[2] - f[3] + r.gauss(0, 1) > 2)
        rows.append((f"p{i}", *f, y))
    return spark.createDataFrame(rows, "pair_id string, " + ", ".join(f"{f} double" for f in scoring.FEATURES) + ", label int")


def test_folds_are_fitted_as_by_another_solver(spark):
    """All folds at once, by Newton steps, against one fit after the other by the library."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    df = pairs_of_a_model(spark).withColumn("fold", evaluation.fold_of()).persist()
    found = evaluation.fit_folds(df.drop("fold"))
    assert {r["fold"] for r in df.select("fold").distinct().collect()} == {0, 1, 2}
    for k in (evaluation.WHOLE, 0, 1, 2):
        part = df.where(F.col("fold") != k)
        n = {r["label"]: r["count"] for r in part.groupBy("label").count().collect()}
        total = sum(n.values())
        part = part.withColumn("w", F.when(F.col("label") == 1, total / (2.0 * n[1])).otherwise(total / (2.0 * n[0])))
        made = VectorAssembler(inputCols=scoring.FEATURES, outputCol="features").transform(part)
        want = LogisticRegression(weightCol="w", regParam=1.0 / total, standardization=False, maxIter=500, tol=1e-12).fit(made)
        assert found[k] == pytest.approx([*want.coefficients, want.intercept], abs=2e-4)


def test_newton_ends_where_the_slope_is_zero(spark):
    df = pairs_of_a_model(spark, 300).withColumns({"model": F.lit(4), "one": F.lit(1.0), "y": F.col("label").cast("double"), "w": F.lit(1.0)})
    x = [*scoring.FEATURES, "one"]
    point = evaluation.newton(df, x, [0.0] * 6, [30.0, -30.0, 30.0, -30.0, 30.0, 5.0], [4])  # a bad start: steps are halved
    sums = evaluation.newton_sums(df, x, point).first()
    assert all(abs(sums[f"g{i}"]) < 1e-6 for i in range(6))


def test_folds_of_one_class(spark):
    df = pairs_of_a_model(spark, 60).withColumn("label", F.lit(1))
    model, _ = evaluation.fit_calibrated(df)
    assert all(0 <= r["score"] <= 1 for r in model(df).collect())


def test_history_of_a_reviewer_without_a_limit(spark):
    rows = spark.range(120).selectExpr("CAST(id AS string) AS pair_id", "'r' AS reviewer_id", "'CONFIRM' AS review_status", "timestamp_seconds(id) AS reviewed_at")
    assert named.reviewer_history(rows, "r", None).count() == 120 and named.reviewer_history(rows, "r").count() == 50
