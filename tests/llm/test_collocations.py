import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations as C
from tessera.llm import queries

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, longest=4, best=2000):
    """The definition, by counting everything."""
    f, n = {}, Counter()
    for text, lang in rows:
        own = f.setdefault(lang or "und", Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        cover = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    cover[p[i : i + k]] = max(cover[p[i : i + k]], a)
        kept = []
        for p, a in found.items():
            if 100 * cover[p] >= 80 * a and cover[p]:
                continue
            score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def made(seed, n=60):
    r = random.Random(seed)
    words = ["alpha", "Beta", "beta", "gamma", "delta", "é", "字", "x-1", "don't", "a", "the"]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(r.randrange(60)):
            text += r.choice(["New York City", "the New York", *words]) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!?", " "])
        out.append((text, r.choice(["en", "en", "en", "de", None])))
    return out + [(None, "en"), ("", None), (" \t\n", "en"), ("a a a a a a a a", "fr"), ("a a a a a a a a", "fr")]


@pytest.mark.parametrize("seed, size, sent", [(1, C.SHARD, C.MAX_SENT), (2, 40, C.MAX_SENT), (3, 40, 0)])
def test_equals_the_definition(spark, seed, size, sent):
    """Also with many small shards, and with pairs joined instead of sent."""
    rows = made(seed)
    df = spark.createDataFrame([(i, t, x, "clash", 1) for i, (t, x) in enumerate(rows)], "doc_id int, text string, lang string, phrase string, shard int").repartition(3)
    got = C.collocations(df, least=3, size=size, max_sent=sent)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(rows, 3)


def test_best_are_cut_by_all_keys(spark):
    rows = made(4)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, C.collocations(df, least=3, best=2).collect())) == plain(rows, 3, best=2)


def test_empty(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert C.collocations(none).collect() == []
    assert C.collocations(spark.createDataFrame([("one two", "en")], "text string, lang string")).collect() == []


@pytest.mark.parametrize("n, m", [(700, 600), (700, 3), (3, 600), (4, 3), (0, 5), (600, 0)])
def test_bitmaps(n, m):
    """Dense and sparse ones, in all pairs."""
    r = random.Random(1)
    a, b = (np.array(sorted(r.sample(range(5000), k)), np.int64) for k in (n, m))
    a[-2:], b[-2:] = [4998, 4999][: len(a)], [4998, 4999][: len(b)]
    a, b = np.unique(a), np.unique(b)
    x, y = C.bitmap(a, 5000), C.bitmap(b, 5000)
    assert C.dense(x) == (n > 9) and C.dense(y) == (m > 9)
    assert C.positions_of(x).tolist() == a.tolist() and C.count(x) == len(a)
    assert C.positions_of(C.shifted(x)).tolist() == (a + 1).tolist()
    assert sorted(C.positions_of(C.both(x, y, 5000)).tolist()) == sorted(set(a.tolist()) & set(b.tolist()))


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits: the score's expression on counts near the limit of long."""
    a = (1 << 62) + 12345
    df = spark.createDataFrame([(a, a + 7, a + 9)], "a bigint, l bigint, r bigint")
    got = df.selectExpr("(cast(2000000 AS decimal(10, 0)) * cast(a AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) + cast(r AS decimal(19, 0))) AS s").first()["s"]
    assert int(got) == 2_000_000 * a // (2 * a + 16)


def test_hashes_of_words_are_sparks(spark):
    words = ["a", "é", "longer word"]
    want = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64('en', w)").collect()]
    assert C.word_hashes("en", words).view(np.int64)[1:].tolist() == want


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op12_collocations(spark, sf)
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({C.ORACLE})").fetchall())


def test_hashes_reach_the_driver_as_a_column(spark, monkeypatch):
    """Not as rows, which took 1.9 GB of the driver for 3.9 million."""
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"))
    want = sorted(r["h"] for r in rows.collect())
    monkeypatch.setattr(type(rows), "collect", lambda self: pytest.fail("rows on the driver"))
    assert C._sent(rows, 5000).value.tolist() == want
    assert C._sent(rows, 4999) is None
    assert C._sent(rows.where("h IS NULL"), 5000).value.tolist() == []
