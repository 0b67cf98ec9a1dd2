import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.common import crc_mod


def corpus(n=700):
    r = random.Random(1)
    words = [a + b for a in ("lo", "mi", "ka", "tre", "su") for b in ("na", "ro", "ti", "pel", "du")]
    docs, labels = [], []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randrange(20, 90))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                t.insert(r.randrange(len(t)), r.choice(["grobnik,", "Idiot", "scum."]))
        docs.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    return docs, labels


def test_learns_and_holds_on_held_out(spark):
    docs, labels = corpus()
    docs += [(None, "null key"), (5000, ""), (5001, None), (3, docs[3][1]), (5002, "x " * 30000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'a' AS score", "1 AS y")
    lab = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, lab, crc_mod("doc_id", 5) != 0)
    assert b"grobnik" in model.lexicon
    got = toxicity.score(df, model).withColumn("held", crc_mod("doc_id", 5) == 0).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held"] and r["doc_id"] in truth]
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in held]) > 0.97
    flagged, name = toxicity.flag(df, model)
    assert name == "score_" and flagged.columns == [*df.columns, "score_"]
    assert sorted((str(r["doc_id"]), r[name]) for r in flagged.collect()) == sorted((str(r["doc_id"]), r["score"]) for r in got)


def test_without_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    lab = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(df, lab, F.lit(True))
    assert toxicity.score(df, model).collect()[0]["score"] == 0
    assert toxicity.score(df.where("false"), model).count() == 0


def test_features_of_long_texts_match_one_block(monkeypatch):
    t = "Idiot you f.o.o sc*um AAAaaa !!! ??? " * 50 + "é字" * 40
    whole = toxicity.features(t, {b"idiot": 2.0})
    monkeypatch.setattr(toxicity, "_BLOCK", 13)
    assert np.allclose(toxicity.features(t, {b"idiot": 2.0}), whole)


def test_isotonic_against_brute_force():
    r = np.random.default_rng(0)
    s, y = r.integers(0, 12, 60).astype(float), r.integers(0, 2, 60).astype(float)
    xs, ys = toxicity.isotonic(s, y)
    assert (np.diff(ys) >= 0).all()
    levels = np.unique(s)
    means, counts = np.array([y[s == v].mean() for v in levels]), np.array([(s == v).sum() for v in levels])
    best = [max(min((means[a : b + 1] * counts[a : b + 1]).sum() / counts[a : b + 1].sum() for b in range(i, len(levels))) for a in range(i + 1)) for i in range(len(levels))]
    assert np.allclose(np.interp(levels, xs, ys), best)


def test_trees_fit_an_interaction():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((toxicity.boost(x, y).margin(x) > 0) == y).mean() > 0.97


def slow_features(text, lexicon):
    """toxicity.features(), one character after the other."""
    raw = (text or "").encode()
    kind = lambda c: ("upper" if 65 <= c <= 90 else "letter" if 97 <= c <= 122 or c >= 128 else "digit" if 48 <= c <= 57 else "symbol" if chr(c) in "#$%&*+/<=>@\\^_`|~" else "stop" if chr(c) in ".,;:'\"()[]{}-" else "!" if c == 33 else "?" if c == 63 else "none")
    kinds = [kind(c) for c in raw]
    words, word = [], b""
    for c, k in zip(raw, kinds, strict=True):
        if k in ("upper", "letter", "digit"):
            word += bytes([c]).lower() if k == "upper" else bytes([c])
        elif word:
            words, word = [*words, word], b""
    words += [word] if word else []
    second = {w.encode() for w in toxicity.SECOND_PERSON}
    hits = [i for i, w in enumerate(words) if w in lexicon]
    you = [i for i, w in enumerate(words) if w in second]
    near = [1 / (1 + min(abs(i - j) for j in you)) for i in hits] if hits and you else [0.0]
    weights = [lexicon[w] for w in {words[i] for i in hits}]
    n, total, letters = max(1, len(words)), max(1, len(raw)), max(1, kinds.count("letter") + kinds.count("upper"))
    spelt = ("letter", "upper")
    triples = list(zip(kinds, kinds[1:], kinds[2:]))  # noqa: B905
    obfuscated = sum(a in spelt and c in spelt and b in ("digit", "symbol", "!", "?") for a, b, c in triples)
    stretched = sum(kinds[i] in spelt and raw[i] == raw[i - 1] == raw[i - 2] for i in range(2, len(raw)))
    share = lambda k: kinds.count(k) / total
    return [
        np.log1p(len(words)), len(hits) / n, len(weights), sum(weights), max(weights, default=0.0), len(you) / n, max(near), sum(near) / len(near),
        kinds.count("upper") / letters, triples.count(("upper",) * 3) / letters, share("!"), share("?"), share("stop"), share("symbol"), share("digit"),
        obfuscated / n, stretched / n, letters / n,
    ]


def test_features_against_a_plain_version():
    r = random.Random(6)
    bits = ["Idiot", "you", "YOU", "du", " ", "  ", "sc*um", "f.o.o", "aaaa", "é", "字", "!!", "?", "#", "12", "LOUD", "vous,", "scum", "-", "\n"]
    lexicon, other = {b"idiot": 2.0, b"scum": 1.5, "é".encode(): 0.5}, {b"loud": 3.0}
    for t in [None, "", "   ", *("".join(r.choice(bits) for _ in range(r.randrange(1, 60))) for _ in range(150))]:
        one, two = toxicity.features(t, lexicon, other)
        assert np.allclose(one, slow_features(t, lexicon)) and np.allclose(two, slow_features(t, other))


def test_lexicons_of_folds_know_nothing_of_the_fold(spark):
    """A word that stands only in one fold's documents is in no lexicon learned without that fold."""
    rows = [(f"plain text {i} here" + (f" mark{i % 4}" if i % 3 == 0 else ""), int(i % 3 == 0), i % 4) for i in range(600)]
    df = spark.createDataFrame(rows, "text string, y int, fold int")
    whole, *apart = toxicity.learned_lexicons(df)
    for f in range(4):
        assert f"mark{f}".encode() in whole
        assert [f"mark{g}".encode() in apart[f] for g in range(4)] == [g != f for g in range(4)]
