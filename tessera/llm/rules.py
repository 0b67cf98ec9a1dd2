"""Quality rules: base counts of each text, and its divergence from references of its language.

Two histograms of a document, of its character classes and of its language's common words, are compared with those of all
documents of that language by the Jensen-Shannon distance (base 2, from 0 to 1). Texts under the minimum lengths, and
languages under the minimum evidence, aren't judged by divergence.

A word is common if it makes at least COMMON of its language's words, so a language has at most 1 / COMMON of them. A first
pass finds a bounded list of words that holds them all, from summaries of batches that never lose one; the second counts
the list exactly, in every document, beside all that the base needs. The references and verdicts come from that narrow
table.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.shared import materialise

COMMON = 0.005
#: Code points and words under which a text isn't judged by a histogram.
MIN_CHARS, MIN_WORDS = 200, 50
#: What chance alone puts between a text and its reference falls with the root of its length (about 1.34 / sqrt(n) for the classes): texts under STEADY code points are given what they stray more than those.
STEADY, STRAY = 400, 1.34
#: Code points and words that a reference must rest on.
EVIDENCE_CHARS, EVIDENCE_WORDS = 10_000, 2_000
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.45
#: References that are broadcast (a language's is at most 1 / COMMON words, 5 KB); more are joined by shuffle.
MAX_REFERENCES = 10_000
SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
CLASSES = ["vowel", "consonant", "upper", "digit", "blank", "line", "stop", "quote", "symbol", "control", "other"]


def _class_table() -> np.ndarray:
    """The class of each byte; bytes that continue a code point have none (11)."""
    t = np.full(256, 8)
    t[[*range(32), 127]] = 9
    t[list(b" \t")] = 4
    t[list(b"\n\r")] = 5
    t[list(b".,;:!?")] = 6
    t[list(b"'\"()[]{}`-")] = 7
    t[ord("0") : ord("9") + 1] = 3
    t[ord("A") : ord("Z") + 1] = 2
    t[ord("a") : ord("z") + 1] = 1
    t[list(b"aeiouy")] = 0
    t[0x80:0xC0] = 11
    t[0xC0:] = 10
    return t


_TABLE = _class_table()


def class_counts(raw: bytes) -> np.ndarray:
    out = np.zeros(12, np.int64)
    for at in range(0, len(raw), 1 << 18):
        out += np.bincount(_TABLE[np.frombuffer(raw[at : at + (1 << 18)], np.uint8)], minlength=12)
    return out[:11]


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that stand in windows found twice or more in the text, the first included."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    at = one
    for k in range(1, window):
        at = at[:-1] * (len(ids) + 1) + one[k:]
        at = np.unique(at, return_inverse=True)[1]
    twice = np.bincount(at)[at] > 1
    if not twice.any():
        return 0
    step = np.zeros(n + 1, np.int64)
    first = np.flatnonzero(twice)
    np.add.at(step, first, 1)
    np.add.at(step, first + window, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def base_counts(raw: bytes) -> tuple[int, int, int, int, int, list[bytes]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words) of a text in UTF-8."""
    words = raw.split()
    packed = raw.translate(None, BLANKS)
    chars = len(packed.translate(None, bytes(range(0x80, 0xC0))))
    return len(words), chars, len(packed) - len(packed.translate(None, SYMBOLS)), duplicate_lines(raw), repeated_words(words), words


def _raw(value) -> bytes:
    return (value.as_py() or "").encode("utf-8", "replace")


def common_candidates(docs: DataFrame, text: str, lang: str) -> list[str]:
    """All words that make COMMON of a language's words, and some others: at most 2 / COMMON for each language of enough evidence.

    Each batch keeps the words that beat its (2 / COMMON + 1)-th most frequent one, by how much they do. That takes less
    than COMMON / 2 of the batch's words from any count, so a common word keeps COMMON / 2 of its language's words at least.
    """
    most = round(2 / COMMON)
    kind = docs.schema[lang].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str | None, Counter] = {}
            for t, g in zip(batch.column(0), batch.column(1), strict=True):
                counts.setdefault(g.as_py(), Counter()).update(_raw(t).lower().split())
            rows = []
            for g, c in counts.items():
                cut = heapq.nlargest(most + 1, c.values())[most] if len(c) > most else 0
                rows += [(g, b"", c.total()), *((g, w, n - cut) for w, n in c.items() if n > cut)]
            langs, words, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, batch.schema.field(1).type), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["g", "word", "n"])

    sums = docs.select(text, lang).mapInArrow(run, f"g {kind.simpleString()}, word binary, n bigint").groupBy("g", "word").agg(F.sum("n").alias("n"))
    sums = materialise(sums, "words")
    totals = sums.where("word = X''").select(F.col("g").alias("of"), F.col("n").alias("total")).where(F.col("total") >= EVIDENCE_WORDS)
    kept = sums.where("word <> X''").join(totals, F.col("g").eqNullSafe(F.col("of"))).where(F.col("n") >= COMMON / 2 * F.col("total"))
    return sorted(bytes(r["word"]).decode("utf-8", "replace") for r in kept.select("word").distinct().collect())


def measured(docs: DataFrame, key: str, text: str, lang: str, common: list[str]) -> DataFrame:
    """A narrow row for each document: base counts, class counts, counts of the candidate words."""
    kinds = docs.schema
    place = {w.encode(): i for i, w in enumerate(common)}
    names = [key, lang, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, rows = whole.slice(at, 256), []
                for t in batch.column(2):
                    raw = _raw(t)
                    *base, words = base_counts(raw)
                    seen = Counter(filter(place.__contains__, raw.lower().split() if place else []))
                    rows.append((*base, class_counts(raw), [(place[w], n) for w, n in seen.items()]))
                columns = [pa.array(x, pa.int64()) for x in list(zip(*rows, strict=True))[:5]]
                classes = pa.array([r[5] for r in rows], pa.list_(pa.int64()))
                words = pa.array([r[6] for r in rows], pa.map_(pa.int32(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, classes, words], names)

    types = ["bigint"] * 5 + ["array<bigint>", "map<int,bigint>"]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, [kinds[key].dataType.simpleString(), kinds[lang].dataType.simpleString(), *types], strict=True))
    return docs.select(key, lang, text).mapInArrow(run, schema)


def _half_divergence(p: Column, q: Column) -> Column:
    """What one class adds to the Jensen-Shannon divergence."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, _half_divergence), F.lit(0.0), lambda a, x: a + x)))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row a document: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    A null text counts as empty. Documents without a language share a reference of their own. A distance is null where a
    minimum isn't met, and a null distance never rejects. base_failed: under 10 words, or over 20 % of them in repeated
    windows. Repeated rows and null keys give rows of their own; an empty table gives none; other columns aren't read.
    """
    docs = docs.select(key, text, lang)
    common = common_candidates(docs, text, lang)
    rows = materialise(measured(docs, key, text, lang, common), "rules")
    sums = rows.groupBy(lang).agg(*[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))], F.sum("n_words").alias("words"))
    share = F.array(*[F.col(f"c{i}") for i in range(len(CLASSES))])
    total = F.aggregate(share, F.lit(0).cast("bigint"), lambda a, x: a + x)
    refs = sums.select(lang, "words", F.when(total >= EVIDENCE_CHARS, F.transform(share, lambda x: x / total)).alias("class_ref"))
    counts = rows.select(lang, F.explode("common")).groupBy(lang, "key").agg(F.sum("value").alias("n"))
    refs_by = refs.select(F.col(lang).alias("of"), "words", "class_ref")
    listed = counts.join(refs_by, counts[lang].eqNullSafe(refs_by["of"])).where((F.col("n") >= COMMON * F.col("words")) & (F.col("words") >= EVIDENCE_WORDS))
    listed = listed.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("key", (F.col("n") / F.col("words")).alias("share")))).alias("word_ref")).select(F.col("of").alias("of2"), "word_ref")
    refs = refs_by.join(listed, F.col("of").eqNullSafe(F.col("of2")), "left").select("of", "class_ref", "word_ref")
    refs = materialise(refs, "references")
    refs = F.broadcast(refs) if refs.count() <= MAX_REFERENCES else refs
    out = rows.join(refs, rows[lang].eqNullSafe(F.col("of")), "left")
    n_chars = F.aggregate("classes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    mine = F.transform("classes", lambda x: x / n_chars)
    of_words = F.transform("word_ref", lambda r: F.coalesce(F.try_element_at("common", r["key"]), F.lit(0)) / F.col("n_words"))
    rest = lambda a: F.concat(a, F.array(F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(a, F.lit(0.0), lambda s, x: s + x))))
    by_class = F.when((n_chars >= MIN_CHARS) & F.col("class_ref").isNotNull(), distance(mine, F.col("class_ref")))
    by_word = F.when((F.col("n_words") >= MIN_WORDS) & F.col("word_ref").isNotNull(), distance(rest(of_words), rest(F.transform("word_ref", lambda r: r["share"]))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    strays = STRAY * (1 / F.sqrt(F.greatest(F.lit(1), F.least(n_chars, F.lit(STEADY)))) - 1 / STEADY**0.5)
    limit = MAX_CLASS_DISTANCE + F.coalesce(strays, F.lit(0.0))
    base = [F.col(c) for c in (key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    out = out.select(*base, failed.alias("base_failed"), by_class.alias("class_distance"), by_word.alias("word_distance"), limit.alias("_limit"))
    diverges = (F.coalesce("class_distance", F.lit(0.0)) > F.col("_limit")) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return out.select(*out.columns[:7], (~F.col("base_failed") & ~diverges).alias("kept"), "class_distance", "word_distance")
