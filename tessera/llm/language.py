"""Language identification by hierarchical discrimination.

One linear support vector machine for each language family predicts the family; within it, one for each pair of its
languages votes for the language. All work on hashed byte trigrams of the folded text (square roots of counts, unit
length). They are fitted on the driver, from at most SAMPLE documents shared evenly by the languages; every whole text is
then predicted where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Documents that the machines are fitted on, and the fewest that a language gets of them.
SAMPLE, LEAST_EACH = 3000, 15
BITS = 12
UNKNOWN = "und"
# Families of languages by ISO 639-1 code; any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky",
    "indo_aryan": "hi bn ur pa mr gu ne si",
    "semitic": "ar he am mt",
    "celtic": "ga cy gd br",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint32)
_BLOCK = 1 << 18


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def vector(text: str) -> np.ndarray:
    """Hashed byte trigrams of a whole text: square roots of counts, scaled to unit length."""
    raw = b" " + text.encode("utf-8", "replace") + b" "
    counts = np.zeros(1 << BITS, np.int64)
    for a in range(0, len(raw) - 2, _BLOCK):
        b = _FOLD[np.frombuffer(raw[a : a + _BLOCK + 2], np.uint8)]
        grams = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
        counts += np.bincount(grams, minlength=1 << BITS)
    x = np.sqrt(counts, dtype=np.float32)
    return x / max(float(np.linalg.norm(x)), 1e-9)


def machine(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine with squared hinge loss, by dual coordinate descent. y: 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    slack = np.array([1 / (2 * c * share[int(s)]) for s in y])
    square = (x * x).sum(axis=1) + slack
    r = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in r.permutation(len(x)):
            step = (y[i] * float(x[i] @ w) - 1 + slack[i] * alpha[i]) / square[i]
            new = max(0.0, alpha[i] - step)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


@dataclass
class Model:
    """Families, their machines, the pairs of languages within each, and the pairs' machines."""

    langs: list[str]
    families: list[str]
    by_family: np.ndarray
    pairs: list[tuple[str, str]]
    by_pair: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages, and scores from 0 to 1: how clear the family is, times how clear the language is within it."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        of_family, of_pair = x @ self.by_family.T, x @ self.by_pair.T
        clear = lambda m: 1 / (1 + np.exp(-3 * np.clip(m, -20, 20)))
        out, scores = [], np.empty(len(x))
        for i in range(len(x)):
            f = int(of_family[i].argmax())
            own = [g for g in self.langs if family(g) == self.families[f]]
            votes, margin = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
            for k, (a, b) in enumerate(self.pairs):
                if a in votes:
                    m = float(of_pair[i, k])
                    votes[a if m >= 0 else b] += 1
                    margin[a] += m
                    margin[b] -= m
            best = max(own, key=lambda g: (votes[g], margin[g]))
            out.append(best)
            scores[i] = (clear(of_family[i, f]) if len(self.families) > 1 else 1.0) * (clear(margin[best] / (len(own) - 1)) if len(own) > 1 else 1.0)
        return out, scores


def sample(docs: DataFrame, learn: Column, key: str, text: str, lang: str, most: int) -> DataFrame:
    """(text, lang) of about `most` documents at most, shared evenly by the languages: those whose keys and texts hash lowest. Each language gives LEAST_EACH at least if it has them, so with more than most / LEAST_EACH languages there are LEAST_EACH of each. Rows that repeat a key and a text are one document, however many they are."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.xxhash64(text)).alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.select("lang", "h").distinct().groupBy("lang").count().collect()}
    each = max(LEAST_EACH, most // max(1, len(sizes)))
    draw = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    # a hash threshold by language takes a few more than `each`; repeats meet before the shuffle, and the window sees these few alone
    share = spark_map({g: min(1.0, 1.5 * each / n + 10 / n) for g, n in sizes.items()})
    few = rows.where(draw < F.coalesce(share[F.col("lang")], F.lit(0.0))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    return few.withColumn("no", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("no") <= each).select("text", "lang")


def spark_map(values: dict[str, float]) -> Column:
    flat = [F.lit(v) for pair in values.items() for v in pair]
    return F.create_map(*flat) if flat else F.create_map().cast("map<string,double>")


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE) -> Model:
    """Learns from the texts and languages of the rows for which `learn` holds, at most about `most` of them.

    Rows with a null text or language, and texts without a letter, teach nothing; null keys are one key. Repeated rows count
    once. Texts are read whole, however long. Without a row to learn from the model predicts `und`. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [i for i, t in enumerate(batch.column(0)) if _LETTER.search(t.as_py())]
            vectors = [vector(batch.column(0)[i].as_py()).astype(np.float16).tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at, pa.int64())), pa.array(vectors, pa.binary())], ["lang", "x"])

    rows = sample(docs, learn, key, text, lang, most).mapInArrow(run, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    langs = sorted(rows["lang"].unique())
    x = np.array([np.frombuffer(b, np.float16) for b in rows["x"]], np.float32).reshape(len(rows), 1 << BITS)
    y = rows["lang"].to_numpy()
    families = sorted({family(g) for g in langs})
    of = np.array([family(g) for g in y])
    none = np.zeros((0, (1 << BITS) + 1), np.float32)
    if len(families) > 1:
        by_family = np.array([machine(x, np.where(of == f, 1, -1)) for f in families])
    else:
        by_family = np.zeros((len(families), (1 << BITS) + 1), np.float32)
    pairs = [(a, b) for a, b in combinations(langs, 2) if family(a) == family(b)]
    by_pair = [machine(x[(y == a) | (y == b)], np.where(y[(y == a) | (y == b)] == a, 1, -1)) for a, b in pairs]
    return Model(langs, families, by_family, pairs, np.array(by_pair) if pairs else none)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every whole text. A null text, or one without a letter, is `und` with score 0; so is any if no language was learned. Repeated rows and null keys keep rows of their own; an empty table gives none; other columns aren't read."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # at most (languages squared) x 16 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                texts = [t.as_py() or "" for t in batch.column(1)]
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                known = [i for i, t in enumerate(texts) if m.langs and _LETTER.search(t)]
                if known:
                    got, s = m.predict(np.array([vector(texts[i]) for i in known]))
                    scores[known] = s
                    for i, g in zip(known, got, strict=True):
                        langs[i] = g
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")
