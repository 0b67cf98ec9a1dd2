import random
import re

import numpy as np

from tessera.llm import cotraining
from tessera.llm.common import crc_mod


def corpus(n=900):
    r = random.Random(2)
    words = [a + b for a in ("lo", "mi", "ka", "tre", "su") for b in ("na", "ro", "ti", "pel", "du")]
    docs, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        t = [r.choice(words) for _ in range(r.randrange(30, 90))]
        text = " ".join(t) if good else " ".join(w + r.choice(["***", "$$$", "###"]) for w in t)
        docs.append((i, text, r.choice(["a", "b"]) if good else r.choice(["b", "c"]), "en", len(text)))
        if i % 5 < 2:
            labels.append((i, int(good)))
    return docs, labels


PAGES = "page_id bigint, url string, html string, doc_id bigint, key string, x int, text string"


def pages_of(docs):
    """A page for most documents: of a good one with many paragraphs."""
    html = lambda k: "<html><article>" + "<p>w</p>" * (9 if k % 4 else 1) + "</article></html>"
    rows = [(k, f"https://www.site{k % 7}.example/en/{k}{'.html' if k % 2 else '?a=1'}", html(k), 1, "k", 2, "t") for k, *_ in docs if k is not None and k % 10]
    return rows + [(None, None, None, None, None, None, None), (1, "no number", "x", 1, "k", 2, "t"), (5, "https://a.b/c/9", None, 1, "k", 2, "t"), (5, "https://a.b/c/9", "", 1, "k", 2, "t")]


def test_both_views_hold_on_held_out(spark):
    docs, labels = corpus()
    truth = {k: int(k % 4 != 0) for k, *_ in docs}
    pages = spark.createDataFrame(pages_of(docs), PAGES)
    docs += [(None, None, None, None, None), (3, *docs[3][1:]), (5001, "", "zzz", "xx", 7), (5002, "a\n" * 40000, "a", "en", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string, n_chars bigint").selectExpr("*", "1 AS score", "2 AS y", "3 AS key", "'p' AS named", "0 AS t")
    lab = spark.createDataFrame(labels + [(None, 1), (8, None)], "doc_id bigint, quality int")
    model = cotraining.fit(df, lab, pages, crc_mod("doc_id", 5) != 0)
    got = cotraining.score(df, model, pages).withColumn("held", crc_mod("doc_id", 5) == 0).collect()
    assert len(got) == len(docs) and all(0 <= r[c] <= 1 for r in got for c in ("text_score", "page_score", "score"))
    held = [r for r in got if r["held"] and r["doc_id"] in truth]
    right = lambda c: np.mean([(r[c] >= 0.5) == truth[r["doc_id"]] for r in held])
    assert right("score") > 0.95 and right("text_score") > 0.95 and right("page_score") > 0.9


def test_without_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "text", "a", "en", 4)], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    lab, pages = spark.createDataFrame([], "doc_id bigint, quality int"), spark.createDataFrame([], PAGES)
    model = cotraining.fit(df, lab, pages, crc_mod("doc_id", 5) != 9)
    assert cotraining.score(df, model, pages).collect()[0]["score"] == 0.5
    assert cotraining.score(df.where("false"), model, pages).count() == 0


def slow_scores(model, docs, pages):
    """Scores row by row: every weight looked up for each number and category."""
    found = {}
    for url, html in pages:
        m = re.search(r"/([0-9]+)(?:\.[A-Za-z]+)?/?(?:[?#].*)?$", url or "")
        if m:
            x, s = cotraining.page_view(url, html)
            found.setdefault(m[1], []).append((x, [cotraining.slot(c) for c in s]))
    sigmoid = lambda m: 1 / (1 + np.exp(-m))

    def margin(view, numbers, slots):
        out = view.weights[-1]
        for j, x in enumerate(numbers):
            out += view.weights[j * cotraining.BINS + sum(c < x for c in view.cuts[j])]
        for k, s in enumerate(slots):
            out += view.weights[len(view.cuts) * cotraining.BINS + k * cotraining.SLOTS + s]
        return out

    for k, text, source, lang, size in docs:
        x, s = min(found.get(str(k), [([cotraining.NO_PAGE] * (cotraining.PAGE_NUMBERS - 1), [cotraining.SLOTS - 1] * 3)]))
        numbers = [*x, np.log1p(0.0 if size is None else size + 1.0)]
        t = margin(model.text, cotraining.text_view(text), []) * model.by_text[0] + model.by_text[1]
        g = margin(model.page, numbers, [cotraining.slot(source), cotraining.slot(lang), *s]) * model.by_page[0] + model.by_page[1]
        yield sigmoid(t), sigmoid(g), sigmoid(t * model.both[0] + g * model.both[1] + model.both[2])


def test_scores_against_brute_force(spark):
    docs, labels = corpus(300)
    pages = pages_of(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    made = spark.createDataFrame(pages, PAGES)
    model = cotraining.fit(df, spark.createDataFrame(labels, "doc_id bigint, quality int"), made, crc_mod("doc_id", 5) != 0)
    got = {r["doc_id"]: (r["text_score"], r["page_score"], r["score"]) for r in cotraining.score(df, model, made).collect()}
    for (k, *_), want in zip(docs, slow_scores(model, docs, [p[1:3] for p in pages]), strict=True):
        assert np.allclose(got[k], want)


def test_exchange_raises_the_page_view_on_the_tables(spark, monkeypatch):
    """With 400 labels, drawn eight times, the page view of documents that have a page gains by what the text view teaches it, and the text view keeps what it knows."""
    sf, views = "/root/testdata/sf0.1", []
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    docs, labels, pages = read("documents"), read("labels"), read("pages")
    some = docs.join(cotraining.page_rows(pages).selectExpr("CAST(key AS bigint) AS doc_id"), "doc_id", "left_semi")
    with monkeypatch.context() as m:
        m.setattr(cotraining, "cotrain", lambda *a: views.append(a))
        cotraining.fit(some, labels, pages, crc_mod("doc_id", 5) != 9)
    x, p, slots, y, rounds = views[0]
    labelled, right = np.flatnonzero(y >= 0), {0: [], rounds: []}
    for seed in range(8):
        few = np.random.default_rng(seed).choice(labelled, 400, replace=False)
        known, rest = np.full(len(y), -1), np.setdiff1d(labelled, few)
        known[few] = y[few]
        for n in right:
            scores = cotraining.cotrain(x, p, slots, known, n).score(x[rest], p[rest], slots[rest])
            right[n].append([((s >= 0.5) == y[rest]).mean() for s in scores])
    before, after = (np.mean(r, axis=0) for r in right.values())
    assert after[1] > before[1] + 0.002 and after[0] > before[0] - 0.002 and after[2] > before[2] - 0.002


def test_exchange_uses_the_pool():
    """What the text view is sure of teaches the page view, though few rows have labels."""
    r = np.random.default_rng(0)
    n = 1200
    y = r.integers(0, 2, n)
    x = np.column_stack([y + r.normal(0, 0.15, n), r.normal(size=n)])
    p = np.column_stack([y * 0.9 + r.normal(0, 0.3, n), r.normal(size=n)])
    slots = np.zeros((n, 2), int)
    known = np.where(np.arange(n) < 60, y, -1)
    model = cotraining.cotrain(x, p, slots, known)
    _, page, both = model.score(x, p, slots)
    assert ((page >= 0.5) == y)[60:].mean() > 0.85 and ((both >= 0.5) == y)[60:].mean() > 0.97
