"""Quality classifier by co-training of two views.

The text view sees what a document says: shares of character classes, repetition, word statistics. The page view sees what
is known about it without its text: source, language, given length, and, where a web page names the document at the end of
its URL's path, that URL and the page's markup (counts of tags and entities, sizes of head and tail). Each is a logistic
regression over binned features. In each round both are calibrated on labelled documents that neither trains on and label
the pool of unlabelled documents, and what one is confident about becomes training data of the other, unless that makes the other worse on those. In the end their
calibrated log odds are combined by weights fitted on the documents of the calibration. Every document is scored.

The models are fitted on the driver, from at most SAMPLE labelled and POOL unlabelled documents. A page's part of the page
view's log odds is worked out beside the page, so scoring joins a few numbers a document, neither texts nor pages.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.rules import class_counts
from tessera.plans.shared import materialise

#: Documents that the models are fitted on: those whose keys hash lowest.
SAMPLE, POOL = 12_000, 12_000
#: Rounds, the confidence that a pseudo-label needs, and the share of the pool that a view may label in a round.
ROUNDS, SURE, SHARE = 4, 0.95, 0.1
#: Hash slots of a category, quantile bins of a number, and the number that stands for no page.
SLOTS, BINS, NO_PAGE = 64, 12, -1.0
TEXT_WIDTH, PAGE_NUMBERS, SLOT_COLUMNS = 20, 22, 5
#: Tags of a page that are counted.
TAGS = [b"<p>", b"<br", b"<b>", b"<a ", b"<li", b"<div", b"<h"]
#: The number at the end of a URL's path, before an extension, a slash, a query or a fragment, is a document's key.
KEY_IN_URL = r"/([0-9]+)(?:\.[A-Za-z]+)?/?(?:[?#].*)?$"


def text_view(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    classes = class_counts(raw)
    words = raw.split()
    n, total = max(1, len(words)), max(1, int(classes.sum()))
    kinds = len(set(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    letters = max(1, int(classes[:3].sum()))
    alone = sum(1 for w in words if len(w) == 1)
    return [
        *(classes / total).tolist(), classes[2] / letters, classes[0] / letters, kinds / n, pairs / n, same / n,
        float(lengths.mean()), float(lengths.std()), alone / n, np.log1p(len(words)),
    ]


def page_view(url: str | None, html: str | None) -> tuple[list[float], list[str]]:
    """Numbers and categories of a page: its markup's size, tags and entities, how far paragraphs lie apart, and its URL's host and form. Words of its text don't count."""
    raw, url = (html or "").encode("utf-8", "replace"), url or ""
    low, high = raw.find(b"<article"), raw.rfind(b"</article>")
    tags = [raw.count(t) for t in TAGS]
    sizes = [len(raw), len(raw) / max(1, tags[0]), max(0, low), len(raw) - high if high >= 0 else 0, raw.count(b"&"), len(url)]
    at = [m.start() for m in re.finditer(b"<p>", raw[max(0, low) : high if high >= 0 else len(raw)])]
    apart = np.diff(at) if len(at) > 1 else np.zeros(1)
    layout = [apart.mean(), apart.std(), apart.max(), apart.min(), np.median(apart), 9 * (apart < 60).mean(), 9 * (apart < 120).mean(), 9 * apart.std() / (apart.mean() + 1)]
    host = re.sub(r"^\w+://(www\.|m\.|blog\.)?|/.*$", "", url)
    form = "".join(c for c in re.sub(r"^\w+://[^/]*", "", url) if c in "./?#&=")
    return [float(np.log1p(x)) for x in (*sizes, *tags, *layout)], [host, form, url.split(":")[0]]


def slot(value: str | None) -> int:
    return SLOTS - 1 if value is None else zlib.crc32(value.encode("utf-8", "replace")) % (SLOTS - 1)


@dataclass
class View:
    """Quantile cuts of the numbers, and weights of each bin and each slot; the bias is last."""

    cuts: list[np.ndarray]
    weights: np.ndarray

    def places(self, x: np.ndarray, slots: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(c, x[:, j]) + j * BINS for j, c in enumerate(self.cuts)]
        columns += [slots[:, k] + len(self.cuts) * BINS + k * SLOTS for k in range(slots.shape[1])]
        return np.stack(columns, axis=1)

    def part(self, x: np.ndarray, slots: np.ndarray, first: int, first_slot: int) -> np.ndarray:
        """What some of the numbers and categories, from the first ones given, add to the margin."""
        out = np.zeros(len(x))
        for j in range(x.shape[1]):
            out += self.weights[np.searchsorted(self.cuts[first + j], x[:, j]) + (first + j) * BINS]
        for k in range(slots.shape[1]):
            out += self.weights[slots[:, k] + len(self.cuts) * BINS + (first_slot + k) * SLOTS]
        return out

    def margin(self, x: np.ndarray, slots: np.ndarray) -> np.ndarray:
        return self.weights[self.places(x, slots)].sum(axis=1) + self.weights[-1]


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit_view(cuts: list[np.ndarray], x: np.ndarray, slots: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, ridge: float = 0.5) -> View:
    """Logistic regression by gradient descent with a step for each weight (the curvature's diagonal bounds it)."""
    view = View(cuts, np.zeros(len(cuts) * BINS + slots.shape[1] * SLOTS + 1))
    at, size = view.places(x, slots), len(view.weights)
    wide = at.shape[1] + 1
    curve = np.bincount(at.ravel(), np.repeat(weight, at.shape[1]), size) * 0.25 * wide + ridge
    curve[-1] = weight.sum() * 0.25 * wide + 1e-9
    moved = np.zeros(size)
    for _ in range(steps):
        miss = weight * (y - _sigmoid(view.weights[at].sum(axis=1) + view.weights[-1]))
        pull = np.bincount(at.ravel(), np.repeat(miss, at.shape[1]), size) - ridge * view.weights
        pull[-1] = miss.sum()
        moved = 0.9 * moved + pull / curve
        view.weights += moved
    return view


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of a logistic map from columns of margins (the last is the bias), by damped Newton steps."""
    a = np.column_stack([margins, np.ones(len(y))])
    w = np.append(np.full(a.shape[1] - 1, 1.0 / (a.shape[1] - 1)), 0.0)
    for _ in range(steps):
        p = _sigmoid(a @ w)
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        w = w + 0.5 * np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w)
    return w


@dataclass
class Model:
    text: View
    page: View
    by_text: np.ndarray
    by_page: np.ndarray
    both: np.ndarray

    def score(self, x: np.ndarray, p: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of the text view, of the page view, and of both."""
        of = lambda w, m: np.column_stack([m, np.ones(len(m))]) @ w
        t = of(self.by_text, self.text.margin(x, slots[:, :0]))
        g = of(self.by_page, self.page.margin(p, slots))
        return _sigmoid(t), _sigmoid(g), _sigmoid(of(self.both, np.column_stack([t, g])))


def cotrain(x: np.ndarray, p: np.ndarray, slots: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    """y: 1, 0, or -1 for the unlabelled. Every third labelled row is for calibration alone."""

    def cut(v: np.ndarray) -> np.ndarray:
        """Quantiles of what is given; NO_PAGE has a bin of its own."""
        given = v[v != NO_PAGE]
        inner = np.quantile(given, np.linspace(0, 1, BINS)[1:-1]) if len(given) else np.empty(0)
        return np.unique(np.append(inner, [NO_PAGE] if len(given) < len(v) else []))

    cuts = lambda v: [cut(v[:, j]) for j in range(v.shape[1])]
    cut_x, cut_p = cuts(x), cuts(p)
    labelled = np.flatnonzero(y >= 0)
    keep = labelled[np.arange(len(labelled)) % 3 == 0]
    base = np.setdiff1d(labelled, keep)
    pool = np.flatnonzero(y < 0)
    given = [dict(zip(base.tolist(), y[base].tolist(), strict=True)) for _ in range(2)]
    none = slots[:, :0]

    def train(k: int) -> View:
        rows = np.array(sorted(given[k]), np.int64)
        target = np.array([given[k][r] for r in rows.tolist()], np.float64)
        weight = np.where(y[rows] >= 0, 1.0, 0.5)
        return fit_view(cut_x, x[rows], none[rows], target, weight) if k == 0 else fit_view(cut_p, p[rows], slots[rows], target, weight)

    def loss(k: int, view: View) -> float:
        m = (view.margin(x[keep], none[keep]) if k == 0 else view.margin(p[keep], slots[keep]))[:, None]
        chance = np.clip(_sigmoid(np.column_stack([m, np.ones(len(keep))]) @ platt(m, y[keep])), 1e-9, 1 - 1e-9)
        return float(-np.mean(np.where(y[keep] == 1, np.log(chance), np.log(1 - chance))))

    views = [train(0), train(1)]
    for _ in range(rounds if len(base) and len(pool) else 0):
        margins = [views[0].margin(x, none), views[1].margin(p, slots)]
        fitted = [platt(m[keep][:, None], y[keep]) for m in margins]
        sure = [_sigmoid(m[pool] * w[0] + w[1]) for m, w in zip(margins, fitted, strict=True)]
        before = [dict(g) for g in given]
        for k in (0, 1):
            most = max(1, int(SHARE * len(pool)))
            far = np.argsort(-np.abs(sure[k] - 0.5), kind="stable")[:most]
            for i in far[np.maximum(sure[k][far], 1 - sure[k][far]) >= SURE].tolist():
                given[1 - k].setdefault(int(pool[i]), int(sure[k][i] >= 0.5))
        for k in (0, 1):  # what makes a view worse on the documents of the calibration is taken back
            taught = train(k)
            if loss(k, taught) <= loss(k, views[k]):
                views[k] = taught
            else:
                given[k] = before[k]
    t, g = views[0].margin(x[keep], none[keep]), views[1].margin(p[keep], slots[keep])
    by_text, by_page = platt(t[:, None], y[keep]), platt(g[:, None], y[keep])
    of = lambda w, m: m * w[0] + w[1]
    return Model(views[0], views[1], by_text, by_page, platt(np.column_stack([of(by_text, t), of(by_page, g)]), y[keep]))


def _doc_side(source: list, lang: list, sizes: list) -> tuple[np.ndarray, np.ndarray]:
    """What the page view has of the documents: the last number and the first two categories."""
    size = np.log1p([0.0 if n is None else max(0.0, n + 1.0) for n in sizes])
    return size.reshape(len(sizes), 1), np.array([[slot(s), slot(g)] for s, g in zip(source, lang, strict=True)], int).reshape(len(sizes), 2)


def page_rows(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(key, x, s): of each document that a page's URL names, the numbers and categories of that page (of several, those of the least row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [page_view(u.as_py(), h.as_py()) for u, h in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in rows], pa.list_(pa.float64())), pa.array([[slot(c) for c in s] for _, s in rows], pa.list_(pa.int32()))], ["key", "x", "s"])

    named = pages.select(F.regexp_extract(url, KEY_IN_URL, 1).alias("key"), url, html).where(F.col("key") != "")
    rows = named.mapInArrow(run, "key string, x array<double>, s array<int>")
    return rows.groupBy("key").agg(F.min(F.struct("x", "s")).alias("p")).select("key", "p.x", "p.s")


def fit(docs: DataFrame, labels: DataFrame, pages: DataFrame, learn: Column, key: str = "doc_id", label: str = "quality", rounds: int = ROUNDS) -> Model:
    """Learns from labels and documents for which `learn` (over the key) holds.

    Labels of one key count as their largest; of documents of one key the one with the largest text is taken. Null keys and
    labels are left out, null texts count as empty, whole texts are read. Without labels, or with empty tables, all scores
    become 0.5. Other columns aren't read.
    """
    known = labels.where(learn & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    marked = F.broadcast(known.orderBy(F.xxhash64(key), key).limit(SAMPLE))
    every = docs.where(learn & F.col(key).isNotNull()).select(F.col(key).alias("key"), "text", "source", "lang", "n_chars")
    named = marked.select(F.col(key).alias("key"), "y")
    pool = every.select("key").distinct().join(known.select(F.col(key).alias("key")), "key", "left_anti").orderBy(F.xxhash64("key"), "key").limit(POOL).withColumn("y", F.lit(-1))
    chosen = materialise(named.unionByName(pool), "chosen")
    rows = every.join(F.broadcast(chosen), "key").groupBy("key", "y").agg(F.max(F.struct("text", "source", "lang", "n_chars")).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [text_view(t.as_py()) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.list_(pa.float64())), *batch.columns[4:]], ["key", "order", "y", "t", "source", "lang", "n_chars"])

    viewed = rows.select(F.col("key").cast("string").alias("key"), F.xxhash64("key").alias("order"), "y", "d.text", "d.source", "d.lang", F.col("d.n_chars").cast("double").alias("n_chars"))
    viewed = viewed.mapInArrow(run, "key string, order bigint, y int, t array<double>, source string, lang string, n_chars double")
    keys = F.broadcast(chosen.select(F.col("key").cast("string").alias("key")))
    got = materialise(viewed.join(page_rows(pages).join(keys, "key"), "key", "left"), "views").toPandas().sort_values(["order", "key"], kind="stable")
    n = len(got)
    x = np.array(got["t"].tolist(), float).reshape(n, TEXT_WIDTH)
    sizes, of_docs = _doc_side(got["source"].tolist(), got["lang"].tolist(), [None if v != v else v for v in got["n_chars"].astype(float)])
    p = np.array([np.full(PAGE_NUMBERS - 1, NO_PAGE) if v is None else v for v in got["x"]], float).reshape(n, PAGE_NUMBERS - 1)
    s = np.array([np.full(SLOT_COLUMNS - 2, SLOTS - 1) if v is None else v for v in got["s"]], int).reshape(n, SLOT_COLUMNS - 2)
    return cotrain(x, np.hstack([p, sizes]), np.hstack([of_docs, s]), got["y"].to_numpy(np.int64), rounds)


def score(docs: DataFrame, model: Model, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text_score, page_score, score) of every document, from its columns text, source, lang and n_chars, and the page whose URL names it.

    A null text counts as empty, a null source or lang is a category of its own, a null n_chars or no page is a value of
    its own. Repeated rows and null keys keep rows of their own; an empty table gives none; other columns aren't read.
    Without any label all scores are 0.5.
    """
    view, near, last = model.page, PAGE_NUMBERS - 1, 2

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                texts, source, lang, sizes = (c.to_pylist() for c in batch.columns[1:])
                x = np.array([text_view(t) for t in texts]).reshape(len(texts), TEXT_WIDTH)
                number, slots = _doc_side(source, lang, sizes)
                parts = [model.text.margin(x, np.zeros((len(texts), 0), int)), view.part(number, slots, near, 0) + view.weights[-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, parts)], ["key", "t", "g"])

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, s = (np.array(batch.column(n).to_pylist()).reshape(batch.num_rows, wide) for n, wide in ((1, near), (2, SLOT_COLUMNS - last)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(view.part(x.astype(float), s.astype(int), 0, last))], ["named", "of_page"])

    none = float(view.part(np.full((1, near), NO_PAGE), np.full((1, SLOT_COLUMNS - last), SLOTS - 1), 0, last)[0])
    chosen = docs.select(F.col(key).alias("key"), "text", "source", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    margins = chosen.mapInArrow(of_docs, f"key {docs.schema[key].dataType.simpleString()}, t double, g double")
    found = page_rows(pages).mapInArrow(of_pages, "named string, of_page double")
    both = margins.join(found, F.col("key").cast("string") == F.col("named"), "left")
    linear = lambda w, *m: sum((float(a) * x for a, x in zip(w, m, strict=False)), F.lit(float(w[-1])))
    odds = lambda m: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), m))))
    t, g = linear(model.by_text, F.col("t")), linear(model.by_page, F.col("g") + F.coalesce("of_page", F.lit(none)))
    return both.select(F.col("key").alias(key), odds(t).alias("text_score"), odds(g).alias("page_score"), odds(linear(model.both, t, g)).alias("score"))
