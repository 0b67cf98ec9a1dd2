"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a lexicon (fixed words, and words that the training labels single out), how near its words
stand to the second person, and rates of capitals, punctuation and obfuscation. Trees and calibration are fitted on the
driver, from a sample of at most SAMPLE labelled documents; every whole text is then scored where it lies. The calibration
rests on folds whose labels neither the trees nor the lexicon have seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh
from tessera.plans.shared import materialise

#: Labelled documents that the model is fitted on: those whose keys hash lowest.
SAMPLE = 20_000
#: Words that the labels single out: at most so many, of at least this log-likelihood ratio and these odds.
LEXICON, LEAST_RATIO, LEAST_ODDS = 300, 24.0, 4.0
#: Bytes of the words that may be singled out (longer runs are no words of a language), and folds of the calibration.
WORD_BYTES, FOLDS = range(2, 41), 4
# Abusive words, and the second person in a few languages.
ABUSIVE = "idiot moron loser pathetic worthless disgusting scum trash clown stupid dumb imbecile vermin filth garbage".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tus usted ustedes".split()
FEATURES = (
    "words lexicon kinds weight heaviest second near mean_near capitals shouted exclaim question punctuation symbols digits obfuscated stretched word_length"
).split()


def _fold_table() -> bytes:
    """Lower case; anything ASCII that is no letter or digit becomes a space."""
    t = bytearray(range(256))
    for c in range(128):
        t[c] = c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() else 32
    return bytes(t)


def _kind_table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[ord("a") : ord("z") + 1] = 1
    t[0x80:] = 1
    t[ord("A") : ord("Z") + 1] = 2
    t[ord("0") : ord("9") + 1] = 3
    t[list(b"#$%&*+/<=>@\\^_`|~")] = 4
    t[list(b".,;:'\"()[]{}-")] = 5
    t[ord("!")] = 6
    t[ord("?")] = 7
    return t


_FOLD, _KIND, _BLOCK = _fold_table(), _kind_table(), 1 << 18
_SECOND = {w.encode() for w in SECOND_PERSON}


def folded_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def features(text: str | None, *lexicons: dict[bytes, float]) -> list[list[float]]:
    """The values of FEATURES for a whole text, under each of the lexicons."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.translate(_FOLD).split()
    n = max(1, len(words))
    kinds = set(words)
    second = kinds & _SECOND
    you = np.array([i for i, w in enumerate(words) if w in second], np.int64) if second else np.empty(0, np.int64)
    counts, obfuscated, stretched, shouted = np.zeros(8, np.int64), 0, 0, 0
    for a in range(0, len(raw), _BLOCK):
        b = np.frombuffer(raw[a : a + _BLOCK + 2], np.uint8)
        kind = _KIND[b]
        counts += np.bincount(kind[:_BLOCK], minlength=8)
        letter = (kind == 1) | (kind == 2)
        if len(b) > 2:
            obfuscated += int((letter[:-2] & (kind[1:-1] >= 3) & (kind[1:-1] != 5) & letter[2:]).sum())
            stretched += int((letter[2:] & (b[2:] == b[1:-1]) & (b[1:-1] == b[:-2])).sum())
            shouted += int(((kind[:-2] == 2) & (kind[1:-1] == 2) & (kind[2:] == 2)).sum())
    total, letters = max(1, len(raw)), max(1, int(counts[1] + counts[2]))
    marks = [counts[6] / total, counts[7] / total, counts[5] / total, counts[4] / total, counts[3] / total, obfuscated / n, stretched / n, letters / n]
    out, known = [], {}
    for lexicon in lexicons:
        found = kinds & lexicon.keys()
        if (seen := frozenset(found)) not in known:
            at = np.array([i for i, w in enumerate(words) if w in found], np.int64) if found else np.empty(0, np.int64)
            near = np.zeros(1)
            if len(at) and len(you):
                right = np.searchsorted(you, at)
                gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - at), np.abs(at - you[np.maximum(right - 1, 0)]))
                near = 1.0 / (1.0 + gap)
            known[seen] = len(at) / n, float(near.max()), float(near.mean())
        density, nearest, mean = known[seen]
        weights = [lexicon[w] for w in found]
        of_lexicon = [np.log1p(len(words)), density, float(len(found)), sum(weights), max(weights, default=0.0), len(you) / n, nearest, mean]
        out.append([*of_lexicon, counts[2] / letters, shouted / letters, *marks])
    return out


@dataclass
class Trees:
    """Boosted trees of one depth, as complete binary trees in arrays: split feature and value of each inner node, gain in log odds of each leaf."""

    start: float
    feature: np.ndarray
    value: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, value, leaf in zip(self.feature, self.value, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > value[node])
            out += leaf[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss over histograms of quantile bins."""
    n, d = x.shape
    if not n:
        inner = (1 << depth) - 1
        return Trees(-20.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    rate_of_ones = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    margin, inner = np.full(n, start), (1 << depth) - 1
    features_, values, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, value, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first = (1 << level) - 1
            for k in range(first, 2 * first + 1):
                own = np.flatnonzero(node == k)
                best = 1e-6
                if len(own) >= 4:
                    gs, hs = g[own], h[own]
                    base = gs.sum() ** 2 / (hs.sum() + ridge)
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        gl = np.cumsum(np.bincount(binned[own, j], gs, len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[own, j], hs, len(c) + 1))[:-1]
                        gr, hr = gs.sum() - gl, hs.sum() - hl
                        gain = np.where((hl > 0.5) & (hr > 0.5), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - base, -1.0)
                        if gain[i := int(gain.argmax())] > best:
                            best, feature[k], value[k] = gain[i], j, c[i]
                node[own] = 2 * k + 1 + (x[own, feature[k]] > value[k])
        leaf = np.array([rate * g[node == k].sum() / (h[node == k].sum() + ridge) for k in range(inner, 2 * inner + 1)])
        margin += leaf[node - inner]
        features_.append(feature), values.append(value), leaves.append(leaf)
    shape = lambda a, w: np.array(a).reshape(len(leaves), w)
    return Trees(start, shape(features_, inner).astype(np.int64), shape(values, inner), shape(leaves, inner + 1))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots of a non-decreasing map from margins to shares of ones."""
    order = np.lexsort((y, score))
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            ones, n, _, high = blocks.pop()
            blocks[-1][0] += ones
            blocks[-1][1] += n
            blocks[-1][3] = high
    xs = [e for b in blocks for e in ((b[2], b[3]) if b[2] < b[3] else (b[2],))]
    ys = [b[0] / b[1] for b in blocks for _ in range(2 if b[2] < b[3] else 1)]
    return np.array(xs), np.array(ys)


@dataclass
class Model:
    lexicon: dict[bytes, float]
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        xs, ys = self.knots
        return np.interp(self.trees.margin(x), xs, ys) if len(xs) else np.zeros(len(x))


def fold_of(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(FOLDS)).cast("int")


def learned_lexicons(train: DataFrame, text: str = "text", label: str = "y", fold: str = "fold") -> list[dict[bytes, float]]:
    """Lexicons learned from all rows, and from all but each fold: the fixed words, and those that occur in far more documents of label 1 than of label 0 (LEXICON at most, of WORD_BYTES bytes), each with its log odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels, folds = (c.to_pylist() for c in batch.columns)
            every: Counter[tuple[int, bytes]] = Counter()
            ones: Counter[tuple[int, bytes]] = Counter()
            for t, y, f in zip(texts, labels, folds, strict=True):
                # documents are counted under the empty word
                own = [(f, w) for w in {b"", *(w for w in folded_words(t) if len(w) in WORD_BYTES)}]
                every.update(own)
                if y:
                    ones.update(own)
            keys = list(every)
            columns = [[w for _, w in keys], [f for f, _ in keys], [every[k] for k in keys], [ones[k] for k in keys]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["word", "fold", "n", "k"])

    rows = train.select(text, label, fold).mapInArrow(run, "word binary, fold int, n bigint, k bigint")
    by_fold = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for c in "nk" for f in range(FOLDS)]
    counts = materialise(rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), *by_fold).where("k >= 3 OR word = X''"), "lexicon")
    total = counts.where("word = X''").first()
    out = []
    for f in (None, *range(FOLDS)):
        words = {w.encode(): 4.0 for w in ABUSIVE}
        docs, toxic = (0.0, 0.0) if total is None else tuple(float(total[c] - (0 if f is None else total[f"{c}{f}"])) for c in "nk")
        if toxic and toxic < docs:
            n, k = ((F.col(c) - (F.lit(0) if f is None else F.col(f"{c}{f}"))).cast("double") for c in "nk")
            term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
            ratio = 2 * (term(k, n * toxic / docs) + term(n - k, n * (docs - toxic) / docs) + term(toxic - k, (docs - n) * toxic / docs) + term(docs - toxic - n + k, (docs - n) * (docs - toxic) / docs))
            odds = ((k + 0.5) / (toxic + 1)) / ((n - k + 0.5) / (docs - toxic + 1))
            best = counts.where("word <> X''").where((n < docs) & (k >= 3)).select("word", ratio.alias("ratio"), odds.alias("odds")).where((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") >= LEAST_ODDS))
            words |= {bytes(r["word"]): float(np.log(r["odds"])) for r in best.orderBy(F.desc("ratio"), "word").limit(LEXICON).collect()}
        out.append(words)
    return out


def sample(docs: DataFrame, labels: DataFrame, learn: Column, key: str, text: str, label: str, most: int) -> DataFrame:
    """(key, y, text) of at most `most` labelled documents. Labels of one key count as their largest; of texts of one key the largest is taken."""
    keyed = labels.where(learn & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    keyed = F.broadcast(keyed.orderBy(F.xxhash64(key), key).limit(most))
    return docs.select(key, text).join(keyed, key).groupBy(key, "y").agg(F.max(text).alias(text))


def feature_rows(train: DataFrame, key: str, text: str, lexicons: list[dict[bytes, float]]) -> DataFrame:
    """(order, y, fold, x): x has the features under each lexicon, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [sum(features(t.as_py(), *lexicons), []) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.list_(pa.float64()))], ["order", "y", "fold", "x"])

    return train.select(F.xxhash64(key).alias("order"), "y", "fold", text).mapInArrow(run, "order bigint, y int, fold int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> Model:
    """Learns from the rows of `labels` for which `learn` holds, at most `most` of them.

    Without any, or with empty tables, all scores are 0. A null text counts as empty, null keys and labels are left out,
    labels and texts that repeat a key count once (see sample()). Whole texts are read, however long.
    """
    train = materialise(sample(docs, labels, learn, key, text, label, most).withColumn("fold", fold_of(key)), "train")
    lexicons = learned_lexicons(train, text)
    rows = feature_rows(train, key, text, lexicons).orderBy("order", "x").toPandas()
    y, fold = rows["y"].to_numpy(np.float64), rows["fold"].to_numpy()
    if not len(y):
        return Model(lexicons[0], boost(np.zeros((0, len(FEATURES))), y), (np.empty(0), np.empty(0)))
    x = np.stack(rows["x"].to_numpy()).reshape(len(y), len(lexicons), len(FEATURES))
    apart = np.zeros(len(y))
    for k in range(FOLDS):
        mine = fold == k
        if mine.any():
            apart[mine] = boost(x[~mine, k + 1], y[~mine]).margin(x[mine, k + 1])
    return Model(lexicons[0], boost(x[:, 0], y), isotonic(apart, y))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every whole text; a null text counts as empty, repeated rows and null keys keep rows of their own, an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = np.array([features(t.as_py(), model.lexicon)[0] for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def flag(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """All rows and columns of docs, and a column of scores, whose name is returned: `score`, longer if docs have that. Rows as in score()."""
    name, columns = fresh(docs, "score")[0], docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(text)
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                x = np.array([features(t.as_py(), model.lexicon)[0] for t in batch.column(at)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], [*columns, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{name}` double"), name
