import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language
from tessera.llm.common import crc_mod

WORDS = {
    "en": "the and of that with this thing shore other weather",
    "de": "der und die nicht einer schule zwischen heit licht",
    "fr": "le et que dans une eau leur toujours mais ville",
    "es": "el y que para una ción donde siempre pero ciudad",
    "ja": "これ それ は の に です ます 字 文",
    "xx": "qqz zzq xqx qzx zxq",
}


def corpus(n=900):
    r = random.Random(0)
    langs = list(WORDS)
    return [(i, " ".join(r.choice(WORDS[langs[i % 6]].split()) for _ in range(r.randrange(4, 50))), langs[i % 6]) for i in range(n)]


def test_hierarchy_on_held_out(spark):
    rows = corpus()
    rows += [(None, "the weather and the thing", None), (2001, None, "en"), (2002, " 12 !? ", "de"), (2003, "", None), (4, rows[4][1], "ja"), (2004, "the other " * 40000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS draw")
    model = language.fit(df, crc_mod("doc_id", 4) != 2)
    assert model.langs == sorted(WORDS) and set(model.pairs) == {("de", "en"), ("es", "fr")}
    got = language.predict(df, model).withColumn("held", crc_mod("doc_id", 4) == 2).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert [by[k]["lang_pred"] for k in (2001, 2002, 2003)] == ["und"] * 3 and by[2004]["lang_pred"] == by[None]["lang_pred"] == "en"
    truth = {k: g for k, _, g in rows}
    held = [r for r in got if r["held"] and r["doc_id"] is not None and r["doc_id"] < 2000]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_nothing_to_learn_from_and_empty(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    model = language.fit(df, crc_mod("doc_id", 4) != 2)
    assert language.predict(df, model).collect()[0]["lang_pred"] == "und"
    assert language.predict(df.where("false"), model).count() == 0


def test_one_language(spark):
    df = spark.createDataFrame([(i, f"word number {i}", "en") for i in range(8)], "doc_id bigint, text string, lang string")
    model = language.fit(df, crc_mod("doc_id", 4) != 2)
    assert {r["lang_pred"] for r in language.predict(df, model).collect()} == {"en"}


def test_vector_in_blocks(monkeypatch):
    t = "Some Text, with é and 字 " * 30
    whole = language.vector(t)
    monkeypatch.setattr(language, "_BLOCK", 17)
    assert np.allclose(language.vector(t), whole)


def test_every_language_is_sampled(spark):
    rows = [(100 * g + n, f"word{n} of {g}", f"l{g:02d}") for g in range(6) for n in range(language.LEAST_EACH + 10 * g)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language.sample(docs, F.lit(True), "doc_id", "text", "lang", 2 * language.LEAST_EACH).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {f"l{g:02d}": language.LEAST_EACH for g in range(6)}


def test_repeats_of_one_row_are_learned_once(spark):
    """A language that is one row repeated, far more often than any sample is large, is learned, whatever its key."""
    for key in range(5):
        docs = spark.range(3000).selectExpr("id AS doc_id", "concat('the weather of number ', id) AS text", "'en' AS lang")
        again = spark.range(20000).selectExpr(f"CAST({key} AS bigint) AS doc_id", "'qqz zzq xqx qzx' AS text", "'xx' AS lang")
        got = language.sample(docs.unionByName(again), F.lit(True), "doc_id", "text", "lang", 300).groupBy("lang").count().collect()
        assert {r["lang"]: r["count"] for r in got} == {"en": 150, "xx": 1}
    model = language.fit(docs.unionByName(again), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(again.limit(3), model).collect()} == {"xx"}


def test_machine_is_near_the_minimum():
    """The dual solver's weights against plain gradient steps on the loss itself."""
    r = np.random.default_rng(3)
    x = r.normal(size=(120, 6)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.4 * r.normal(size=120) > 0.3, 1, -1)
    one = np.hstack([x, np.ones((120, 1))]).astype(float)
    weight = 4.0 * np.array([120 / (2 * (y == s).sum()) for s in y])
    loss = lambda w: 0.5 * w @ w + (weight * np.maximum(0, 1 - y * (one @ w)) ** 2).sum()
    w = np.zeros(7)
    for _ in range(200):  # Newton steps of a loss that is quadratic by pieces
        on = y * (one @ w) < 1
        slope = w - 2 * one[on].T @ (weight[on] * (y[on] - one[on] @ w))
        w = w - np.linalg.solve(np.eye(7) + 2 * (one[on].T * weight[on]) @ one[on], slope)
    got = language.machine(x, y, rounds=200).astype(float)
    assert loss(got) <= 1.001 * loss(w) and np.abs(got - w).max() < 0.05


def test_votes_by_hand():
    """The family of the highest margin; in it the language with most wins, ties by the sum of margins."""
    r = np.random.default_rng(1)
    langs, families = ["de", "en", "es", "fr", "ja", "nl", "sv"], ["germanic", "ja", "romance"]
    pairs = [(a, b) for i, a in enumerate(langs) for b in langs[i + 1 :] if language.family(a) == language.family(b)]
    width = (1 << language.BITS) + 1
    model = language.Model(langs, families, r.normal(size=(3, width)).astype(np.float32), pairs, r.normal(size=(len(pairs), width)).astype(np.float32))
    x = r.normal(size=(60, width - 1)).astype(np.float32) / 60
    got, scores = model.predict(x)
    for i in range(60):
        row = np.append(x[i], 1).astype(np.float32)
        own = families[int(np.argmax([row @ f for f in model.by_family]))]
        mine = [g for g in langs if language.family(g) == own]
        wins, total = dict.fromkeys(mine, 0), dict.fromkeys(mine, 0.0)
        for (a, b), w in zip(pairs, model.by_pair, strict=True):
            if a in mine:
                m = float(row @ w)
                wins[a if m >= 0 else b] += 1
                total[a] += m
                total[b] -= m
        assert got[i] == max(mine, key=lambda g: (wins[g], total[g]))
    assert set(got) > {"ja"} and len(set(got)) > 4 and ((scores >= 0) & (scores <= 1)).all()
