"""Pairs by classes of equal records, against all pairs."""
import random
from datetime import date

from pyspark.sql import functions as F

from tessera.operators import activity, blocking, evaluation, ledger, resolution, scoring
from tessera.plans import catalog

COLUMNS = "id string, business_name string, address_pincode string, pan string, gstin string, address_locality string, address_district string, phone string, email string, registration_date date, gt_id string"


def copies(spark, n=120):
    r = random.Random(4)
    rows = []
    for i in range(n):
        k = r.randrange(6)
        rows.append((f"r{r.randrange(10**6):06d}x{i}", ["zeta motors ltd", "zeta motor", "yak foods"][k % 3], "560001", f"ABCDE123{k // 2}F" if k < 5 else None, "29ABCDE1230F1Z5" if k in (1, 5) else None, "whitefield", "X", None, None, date(2020, 1, 1), f"g{k // 2}"))
    return spark.createDataFrame(rows, COLUMNS)


def by_hand(df):
    """(a, b, rank) of all pairs, by the definition."""
    rows = blocking.normalised(df).collect()
    keys = [(0, "valid_pan", 10), (0, "valid_gstin", 15)]
    out = {}
    name = [(1, lambda x: (x["address_pincode"], x["sound"])), (2, lambda x: (x["address_pincode"], x["punct_stripped"][:3]))]
    size = {(k, f(x)): sum(f(y) == f(x) for y in rows) for k, f in name for x in rows}
    for x in rows:
        for y in rows:
            if x["id"] < y["id"]:
                ranks = [0 for _, c, _ in keys if x[c] and x[c] == y[c]] + [k for k, f in name if f(x) == f(y) and size[k, f(x)] <= blocking.CAP]
                if ranks:
                    out[x["id"], y["id"]] = min(ranks)
    return out


def test_classes_give_all_pairs_once(spark, monkeypatch):
    monkeypatch.setattr(blocking, "CHUNK", 7)  # classes of several rows of members
    df = copies(spark).persist()
    want = by_hand(df)
    got = [((x["record_a_id"], x["record_b_id"]), blocking.STRATEGIES.index(x["blocking_keys"][0])) for x in blocking.candidate_pairs(df).collect()]
    assert len(got) == len(want) and dict(got) == want
    pairs = blocking.class_pairs(blocking.classes(df)).collect()
    assert len(pairs) < 30 and sum(x["links"] for x in pairs) == len(want)


def test_class_scores_are_those_of_pairs(spark):
    df = copies(spark).persist()
    norm, groups = blocking.normalised(df), blocking.classes(df, scoring.SAME)
    full = scoring.score_pairs(blocking.candidate_pairs(df), norm)
    short = blocking.expanded(scoring.score_classes(groups), df, groups, scoring.SAME)
    tell = lambda rows: sorted((x["record_a_id"], x["record_b_id"], x["decision"], *(x[f] for f in [*scoring.FEATURES, "score"])) for x in rows.collect())
    assert tell(full) == tell(short)


def test_strings_are_compared_once(spark, monkeypatch):
    """Each two different strings of all pairs are one row of the table that is looked up; without it the scores are the same."""
    df = copies(spark).withColumns({"address_locality": F.when(F.col("id") > "r5", "whitefield"), "address_district": F.when(F.col("id") > "r3", " Xa ").otherwise("xb")}).persist()
    groups = blocking.classes(df, scoring.SAME)
    made = []
    keep = scoring.materialise
    monkeypatch.setattr(scoring, "materialise", lambda rows, tag: made.append((tag, keep(rows, tag))) or made[-1][1])
    tell = lambda rows: sorted(str(x) for x in rows.select("record_a_id", "record_b_id", "links", "decision", *scoring.FEATURES, "score").collect())
    looked = tell(scoring.score_classes(groups))
    held = [(x["x"], x["y"]) for tag, rows in made if tag == "ratios" for x in rows.collect()]
    assert len(set(held)) == len(held) <= 5 and ("xa", "xb") in held and all(x < y for x, y in held)
    monkeypatch.setattr(scoring, "LOOKED_UP", 0)
    assert tell(scoring.score_classes(groups)) == looked != []


def test_merges_by_classes(spark):
    df = copies(spark, 200).persist()
    norm, groups = blocking.normalised(df).persist(), blocking.classes(df, scoring.SAME)
    given = norm.select("id", F.concat("business_name", F.lit("/"), F.right("id", F.lit(1))).alias("ubid")).persist()  # identities that cross classes
    full = resolution.ubid_links(scoring.score_pairs(blocking.candidate_pairs(df), norm), given).persist()
    short = resolution.ubid_links(scoring.score_classes(groups), given, blocking.members(df, groups, scoring.SAME)).persist()
    counts = given.groupBy("ubid").agg(F.count("*").alias("n_records"))
    tell = lambda links: sorted(map(tuple, resolution.merge(links, counts).collect()))
    assert tell(short) == tell(full) != [] and short.count() < full.count() / 5


def test_counted_pairs_fit_the_same(spark):
    r = random.Random(3)
    rows = [(f"p{i}", *[r.choice([0.0, 0.5, 1.0]) for _ in range(5)], r.randrange(2)) for i in range(600)]
    df = spark.createDataFrame(rows, "pair_id string, " + ", ".join(f"{f} double" for f in scoring.FEATURES) + ", label int").persist()
    short, full = evaluation.fit_folds(evaluation.counted(df)), evaluation.fit_folds(df)
    assert all(abs(a - b) < 1e-9 for k in full for a, b in zip(full[k], short[k], strict=True))


def test_ranges_of_a_ledger_are_one_chain(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 AS seq", "CAST(id AS string) AS payload").persist()
    tell = lambda rows: sorted((x["ledger_id"], x["seq"], x["prev_hash"], x["hash"]) for x in rows.collect())
    assert tell(ledger.chain(df, "seq", "payload", most=90)) == tell(ledger.chain(df, "seq", "payload"))


def test_a_state_that_moved_is_exact(spark):
    """Scores at a threshold: an error in the last digit would give another status."""
    ref = date(2024, 1, 1)
    kinds = ["WEAK_ACTIVE", "DORMANCY", "STRONG_ACTIVE", "CLOSURE"]
    rows = [(f"u{i}", date.fromordinal(ref.toordinal() - (i * 53 + j * 97) % 1100), kinds[(i + j) % 4]) for i in range(40) for j in range(9)]
    ev = spark.createDataFrame(rows, "ubid string, event_date date, signal_class string").persist()
    state, steps = None, [500, 333, 100, 7, 0]
    for was, now in zip([None, *steps], steps, strict=False):
        at = lambda n: date.fromordinal(ref.toordinal() - n)
        state = activity.window_state(ev, at(now)) if was is None else activity.advance(state, ev, at(was), at(now))
    tell = lambda df: sorted((x["ubid"], *(x[c] for c in activity.STATE)) for x in df.collect())
    assert tell(state) == tell(activity.window_state(ev, ref))


def test_edges_of_an_identity_in_parts(spark, monkeypatch):
    monkeypatch.setattr(blocking, "CHUNK", 5)
    df = spark.createDataFrame([(f"u{i % 3}" if i else None, f"r{i:02d}") for i in range(60)], "ubid string, record_id string")
    got = sorted((x["ubid"], x["source"], x["target"]) for x in resolution.cluster_edges(df).collect())
    assert got == [(f"u{u}", f"r{i:02d}", f"r{j:02d}") for u in range(3) for i in range(1, 60) for j in range(i + 1, 60) if i % 3 == j % 3 == u]


def test_a_pair_is_hashed_once(spark, sf):
    plan = catalog.QUERIES["rev_history"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1


def with_phones(spark, n):
    """Copies of which some have one of four phones, written in two ways."""
    at = F.pmod(F.xxhash64("id"), F.lit(6))
    phone = F.when(at < 4, F.concat(F.when(F.right("id", F.lit(1)) < "5", "+91 ").otherwise(""), F.lit("98000 0000"), at.cast("string"))).when(at == 4, "")
    return copies(spark, n).withColumn("phone", phone).persist()


def test_phones_make_no_classes(spark, monkeypatch):
    """A phone that differs from copy to copy adds no class; pairs that share one are a row of their own."""
    monkeypatch.setattr(blocking, "CHUNK", 7)
    df = with_phones(spark, 120)
    groups = blocking.classes(df, scoring.SAME)
    assert groups.count() == blocking.classes(copies(spark, 120), scoring.SAME).count()
    full = scoring.score_pairs(blocking.candidate_pairs(df), blocking.normalised(df)).persist()
    rows = scoring.score_classes(groups)
    assert rows.agg(F.sum("links")).first()[0] == full.count() and rows.count() < 60
    tell = lambda rows: sorted((x["record_a_id"], x["record_b_id"], x["decision"], *(x[f] for f in [*scoring.FEATURES, "score"])) for x in rows.collect())
    told = tell(full)
    assert tell(blocking.expanded(rows, df, groups, scoring.SAME)) == told and {x[6] for x in told} == {0.0, 1.0}
    linked = [x[:2] for x in told if x[2] == "AUTO_LINK"]  # a condition on rows is one on their pairs
    assert [x[:2] for x in tell(blocking.expanded(rows.where("decision = 'AUTO_LINK'"), df, groups, scoring.SAME))] == linked


def test_first_links_by_phone(spark):
    """Of each two identities the link that comes first among all pairs, where the score hangs on the phone."""
    df = with_phones(spark, 200)
    norm, groups = blocking.normalised(df).persist(), blocking.classes(df, scoring.SAME)
    given = norm.select("id", F.concat("business_name", F.lit("/"), F.pmod(F.crc32("id"), F.lit(9)).cast("string")).alias("ubid")).persist()
    full = resolution.ubid_links(scoring.score_pairs(blocking.candidate_pairs(df), norm), given).collect()
    first = {}
    for x in sorted(full, key=lambda x: (-x["score"], x["record_a_id"], x["record_b_id"])):
        first.setdefault(frozenset((x["ubid_a"], x["ubid_b"])), tuple(x))
    short = resolution.ubid_links(scoring.score_classes(groups), given, blocking.members(df, groups, scoring.SAME))
    assert sorted(map(tuple, short.collect())) == sorted(first.values()) != []


def test_members_come_from_the_written_records(spark, sf, monkeypatch):
    """The view of the records is read for their classes and once more, not for each step."""
    seen, keep = [], blocking.members
    monkeypatch.setattr(blocking, "members", lambda rows, *a: seen.append(rows.inputFiles()) or keep(rows, *a))
    for name in ("res_components", "res_merge"):
        catalog.QUERIES[name](spark, sf)
    assert len(seen) == 2 and not any("part.parquet" in f for files in seen for f in files)


def test_scores_are_rounded_once_a_class(spark, sf):
    """What a pair of classes says is made before its pairs of records are."""
    plan = catalog.QUERIES["sco_pairs"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan


def test_identities_are_looked_up(spark):
    """Records look up the first ones of their anchors, which are written, and are neither grouped nor joined with each other; what is kept of them spares a join by id."""
    df = with_phones(spark, 200)
    norm, groups = blocking.normalised(df).persist(), blocking.classes(df, scoring.SAME)
    given = resolution.assign(norm)
    plan = given._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan
    members = blocking.members(norm, groups, scoring.SAME, ("valid_pan", "valid_gstin"))
    kept = resolution.assign(members, keep=["first", "phone_key"])
    tell = lambda rows: sorted(map(tuple, rows.collect()))
    assert tell(kept.select("id", "ubid")) == tell(given)
    scored = scoring.score_classes(groups)
    assert tell(resolution.ubid_links(scored, kept)) == tell(resolution.ubid_links(scored, given, blocking.members(norm, groups, scoring.SAME))) != []


def test_statistics_count_entries_unchained(spark, sf, monkeypatch):
    """Statuses are made once, and their entries are counted without one task that chains them."""
    made, keep = [], catalog.materialise
    monkeypatch.setattr(catalog, "materialise", lambda rows, tag: made.append(tag) or keep(rows, tag))
    plan = catalog.QUERIES["agg_system"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("statuses") == 1 and "MapInArrow" not in plan


def test_members_without_phones_are_plain_ids(spark):
    """A pair is put together from two ids, not from two structs, where nothing but ids is asked for; whether its chunks are one isn't compared for each pair."""
    df = copies(spark)
    groups = blocking.classes(df)
    assert blocking.chunks(df, groups).schema["members"].dataType.simpleString() == "array<string>"
    rows = blocking.expanded(blocking.class_pairs(groups), df, groups)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT _one" in plan
    got = [(x["record_a_id"], x["record_b_id"]) for x in rows.collect()]
    assert sorted(got) == sorted(by_hand(df))
