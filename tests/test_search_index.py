import random

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import search
from tessera.sources.store import Store

NAMES = ["apex", "apxe", "textile", "textiles", "motors", "motor", "cafe", "zinc", "sun", "su", "s", "peenya", "foods", "fodo", "industrial"]


def documents(spark, n=150):
    r = random.Random(4)
    rows = []
    for i in range(n):
        name = " ".join(r.choice(NAMES) for _ in range(r.randrange(4)))
        rows.append((f"U{i:03d}", name, [name.title(), r.choice(NAMES).upper()], "PAN", f"ABCDE{i:04d}F", f"5600{i % 7:02d}", r.choice(["A", "B"]), "ACTIVE", 0.0, 1))
    return spark.createDataFrame(rows, "ubid string, primary_name string, name_variants array<string>, anchor_type string, anchor_value string, primary_pincode string, primary_district string, status string, activity_score double, source_record_count int")


def test_deletions(spark):
    words = ["", "a", "ab", "aab", "textiles", "é字x"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.deletions(F.col("w")).alias("d")).collect()
    for r in got:
        assert set(r["d"]) == search.without(r["w"], 2) and len(r["d"]) == len(set(r["d"]))


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    docs = documents(spark)
    found = search.postings(docs)
    kept = Store(spark, str(tmp_path))
    kept.overwrite("search_postings", search.bucketed(found), ["field", "bucket"], ["term"])
    kept.overwrite("search_keys", search.term_keys(found), ["bucket"], ["key"])
    keys, index = kept.read("search_keys"), kept.read("search_postings")
    for q in ("apex", "áPEX textils", "mtr", "su", "s", "ABCDE0003F", "560003", "fodos industry", "xyzzy", "", "!!"):
        for filters in (None, {"primary_district": "A"}):
            want = search.fuzzy_search(found, docs, q, filters, 10_000).collect()
            got = search.lookup(keys, index, docs, q, filters).collect()
            assert {r["ubid"]: round(r["relevance"], 9) for r in got} == {r["ubid"]: round(r["relevance"], 9) for r in want}, q


def test_only_some_partitions_are_read(spark, tmp_path, capsys):
    docs = documents(spark)
    found = search.postings(docs)
    kept = Store(spark, str(tmp_path))
    kept.overwrite("search_postings", search.bucketed(found), ["field", "bucket"], ["term"])
    kept.overwrite("search_keys", search.term_keys(found), ["bucket"], ["key"])
    search.lookup(kept.read("search_keys"), kept.read("search_postings"), docs, "textiles").explain("formatted")
    told = [line for line in capsys.readouterr().out.splitlines() if line.startswith("PartitionFilters") and "bucket" in line]
    assert told and all("field" in line for line in told)
