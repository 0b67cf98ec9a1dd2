"""Phrase collocations from position bitmaps, depth first.

The texts of a language are laid out in shards: words in a row, one empty position between pieces. In a shard each word has
a bitmap of its positions (a list of them where they are few). Shifting a phrase's bitmap by one and taking the bits
that it shares with a word's bitmap gives the bitmap of the longer phrase; as the position between pieces belongs to no
word, no phrase leaves its piece. The bits are counted, and the counts of all shards are added up.

A phrase can't be frequent unless each pair of neighbours in it is. So words are counted first, then pairs of words that
may be frequent, by 64-bit hashes (where two pairs share one, both go on: nothing is lost), and phrases grow along such
pairs only.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.shared import materialise

LEAST, LONGEST, BEST = 30, 4, 2000
#: A part of a candidate that a longer one holds is dropped if the longer one has this share of its occurrences, in percent.
COVERED = 80
#: Positions of a shard, and of all shards that a task has open.
SHARD, OPEN = 1 << 19, 1 << 20
#: A bitmap with fewer bits than one in SPARSE positions is held as their positions.
SPARSE = 512
#: Hashes of pairs, and of words, that are sent to all tasks (8 bytes each); of more pairs each shard gets its own by a join, and with more words no pair is left out for its words.
MAX_SENT = 4_000_000
_STOPS = b".,;:!?\n\x0b\x0c\r"
#: Lower case for A to Z; a mark for each end of a piece.
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _STOPS, bytes(range(97, 123)) + b"." * len(_STOPS))

#: A bitmap: 64-bit words over the whole shard, or, where it has few bits, their sorted positions (64-bit integers with a sign).
Bits = np.ndarray


def dense(bits: Bits) -> bool:
    return bits.dtype == np.uint64


def bitmap(positions: np.ndarray, length: int) -> Bits:
    if len(positions) * SPARSE < length:
        return positions.astype(np.int64)
    out = np.zeros(length // 64 + 2, np.uint64)  # with room for a shift
    np.bitwise_or.at(out, positions >> 6, np.uint64(1) << (positions & 63).astype(np.uint64))
    return out


def shifted(bits: Bits) -> Bits:
    """All positions moved on by one."""
    if not dense(bits):
        return bits + 1
    out = bits << np.uint64(1)
    out[1:] |= bits[:-1] >> np.uint64(63)
    return out


def count(bits: Bits) -> int:
    return int(np.bitwise_count(bits).sum()) if dense(bits) else len(bits)


def positions_of(bits: Bits) -> np.ndarray:
    if not dense(bits):
        return bits
    held = np.flatnonzero(bits)
    at, bit = np.nonzero(np.unpackbits(bits[held].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return held[at] * 64 + bit


def both(a: Bits, b: Bits, length: int) -> Bits:
    """The bits that two bitmaps share."""
    if dense(a) and dense(b):
        out = a & b
        return bitmap(positions_of(out), length) if count(out) * SPARSE < length else out
    if dense(b):
        a, b = b, a
    if dense(a):
        return b[(a[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1]
    return np.intersect1d(a, b, assume_unique=True)


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    """As xxhash64(lang, word) in Spark; the place 0 is no word's."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in ("", *words)), np.uint64, len(words) + 1)


def pairs_of(ids: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, count) of neighbours in one piece."""
    a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    inside = (a > 0) & (b > 0)
    pair, n = np.unique(a[inside] * (n_words + 1) + b[inside], return_counts=True)
    return pair // (n_words + 1), pair % (n_words + 1), n


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of the hashes of two words, in this order."""
    h = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second >> np.uint64(29))
    h = (h + second) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def phrases(ids: np.ndarray, first: np.ndarray, second: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[tuple[int, ...], int]]:
    """Phrases of 2 to `longest` words along the pairs given, with their counts: depth first, by bitmaps."""
    if not len(first):
        return
    follows: dict[int, set[int]] = {}
    for a, b in zip(first.tolist(), second.tolist(), strict=True):
        follows.setdefault(a, set()).add(b)
    length, after = len(ids), memoryview(ids)[1:]  # a shard ends with the end of a piece, so each word has a position after it
    used = np.zeros(int(ids.max()) + 1, bool)
    used[first] = used[second] = True
    used[0] = False
    at = np.flatnonzero(used[ids])
    at = at[np.argsort(ids[at], kind="stable")]
    words, begins = np.unique(ids[at], return_index=True)
    bits = {w: bitmap(p, length) for w, p in zip(words.tolist(), np.split(at, begins[1:]), strict=True)}

    def grow(phrase: tuple[int, ...], held: Bits, then: set[int]) -> Iterator[tuple[tuple[int, ...], int]]:
        if not dense(held):
            yield from few(phrase, held.tolist(), then)
            return
        on = shifted(held)
        for w in then:
            shared = both(on, bits[w], length)
            if n := count(shared):
                more = (*phrase, w)
                yield more, n
                if len(more) < longest and w in follows:
                    yield from grow(more, shared, follows[w])

    def few(phrase: tuple[int, ...], held: list[int], then: set[int]) -> Iterator[tuple[tuple[int, ...], int]]:
        """Of few bits, which of them each word's bitmap shares is read from the shard itself."""
        shared: dict[int, list[int]] = {}
        for p in held:
            w = after[p]
            if w in then:
                if w in shared:
                    shared[w].append(p + 1)
                else:
                    shared[w] = [p + 1]
        for w, ps in shared.items():
            more = (*phrase, w)
            yield more, len(ps)
            if len(more) < longest and w in follows:
                yield from few(more, ps, follows[w])

    for a, then in follows.items():
        yield from grow((a,), bits[a], then)


class _Open:
    """The shard of one language that a task is filling."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        self.ids[b"."] = 0
        words = text.encode("utf-8", "surrogatepass").translate(_PLAIN).replace(b".", b" . ").split()
        ids, known = [], self.ids
        for w in words:
            i = known.get(w)
            if i is None:
                i = known[w] = len(known)
            ids.append(i)
        ids.append(0)
        self.parts.append(np.array(ids, "<i4"))
        self.size += len(ids)

    def row(self, lang: str, no: int) -> pa.RecordBatch:
        ids = np.concatenate(self.parts)
        words = [w.decode("utf-8", "surrogatepass") for w in self.ids if w != b"."]
        n = np.bincount(ids, minlength=len(words) + 1)[1:]
        return pa.RecordBatch.from_arrays([pa.array([no]), pa.array([lang]), pa.array([int(n.sum())]), pa.array([ids.tobytes()], pa.binary()), pa.array([words], pa.list_(pa.string())), pa.array([n.tolist()], pa.list_(pa.int64()))], ["shard", "lang", "n", "ids", "words", "counts"])


def shards(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = SHARD, together: int = OPEN) -> DataFrame:
    """Shards of the texts of each language: (shard, lang, n, ids, words, counts). ids are 32-bit numbers of words, from 1, in the order of `words`, and 0 between pieces."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Open] = {}
        no = TaskContext.get().partitionId() << 32
        for batch in batches:
            for one, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = held.setdefault(one, _Open())
                shard.add(t.as_py())
                over = one if shard.size >= size else max(held, key=lambda k: held[k].size) if sum(s.size for s in held.values()) >= together else None
                if over is not None:
                    yield held.pop(over).row(over, no)
                    no += 1
        for one, shard in held.items():
            yield shard.row(one, no)
            no += 1

    own = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "shard bigint, lang string, n bigint, ids binary, words array<string>, counts array<bigint>")


def _sent(hashes: DataFrame, most: int) -> object | None:
    """A bounded set of hashes, in order, for all tasks; None if there are more. They come to the driver as an Arrow column, 8 bytes each: as rows they would take some hundred MB there."""
    if hashes.count() > most:
        return None
    return hashes.sparkSession.sparkContext.broadcast(np.sort(hashes.toArrow().column(0).to_numpy()))


def _pairs(held: DataFrame, words, name: str) -> DataFrame:
    """(shard, h, n) of the pairs of each shard; those of words that aren't frequent are left out, where the frequent ones were sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, lang, ids, own = (c[i].as_py() for c in batch.columns)
                h = word_hashes(lang, own)
                a, b, n = pairs_of(np.frombuffer(ids, "<i4"), len(own))
                if words is not None:
                    good = among(h.view(np.int64), words.value)
                    keep = good[a] & good[b]
                    a, b, n = a[keep], b[keep], n[keep]
                got = pair_hashes(h[a], h[b])
                for at in range(0, len(got), 1 << 16):
                    part = got[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard)), pa.array(part), pa.array(n[at : at + (1 << 16)])], ["shard", name, "n"])

    return held.select("shard", "lang", "ids", "words").mapInArrow(run, f"shard bigint, {name} bigint, n bigint")


def _phrases(held: DataFrame, sent, longest: int) -> DataFrame:
    """(lang, phrase, f) of each shard. `held` has the hashes of pairs to follow as `keep`, unless they were sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, raw, words, keep = (c[i].as_py() for c in batch.columns)
                keep = sent.value if sent is not None else np.sort(np.array(keep or [], np.int64))
                ids, h = np.frombuffer(raw, "<i4"), word_hashes(lang, words)
                a, b, _ = pairs_of(ids, len(words))
                good = among(pair_hashes(h[a], h[b]), keep)
                names, out, n = ["", *words], [], []
                for phrase, m in phrases(ids, a[good], b[good], longest):
                    out.append(" ".join([names[w] for w in phrase]))
                    n.append(m)
                    if len(out) == 1 << 15:
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out)), pa.array(out), pa.array(n)], ["lang", "phrase", "f"])
                        out, n = [], []
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(out, pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "f"])
                del ids, h, a, b, good, names, words, raw
                gc.collect()  # the functions that grow phrases hold each other, and so their bitmaps
                pa.default_memory_pool().release_unused()

    return held.select("lang", "ids", "words", "keep").mapInArrow(run, "lang string, phrase string, f bigint")


def frequencies(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, size: int = SHARD, max_sent: int = MAX_SENT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f, k) of all phrases of 1 to `longest` words that occur `least` times or more in their language, and (lang, n) of all its words."""
    held = materialise(shards(docs, lang, text, size, max(size, OPEN)), "positions")
    each = held.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    words = materialise(each.groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("f")).where(F.col("f") >= least), "words")
    known = _sent(words.select(F.xxhash64("lang", "phrase")), max_sent)
    with _few_rows_a_batch(docs.sparkSession):
        frequent = materialise(_pairs(held, known, "h").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"), "pairs")
    sent = _sent(frequent, max_sent)
    if sent is None:
        mine = _pairs(held, known, "h").join(frequent, "h", "left_semi").groupBy("shard").agg(F.collect_list("h").alias("keep"))  # a shard has at most SHARD pairs
        held = held.join(mine, "shard")
    else:
        held = held.withColumn("keep", F.lit(None).cast("array<bigint>"))
    with _few_rows_a_batch(docs.sparkSession):
        longer = _phrases(held, sent, longest).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        every = materialise(words.unionByName(longer).withColumn("k", F.size(F.split("phrase", " "))), "frequencies")
    return every, held.groupBy("lang").agg(F.sum("n").alias("n"))


@contextmanager
def _few_rows_a_batch(spark: SparkSession, rows: int = 2) -> Iterator[None]:
    """A shard is a row of some MB, so few of them make a batch for Python; what runs here is done when this ends."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _part(first, n):
    return F.array_join(F.slice("w", first, n), " ")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, best: int = BEST, size: int = SHARD, max_sent: int = MAX_SENT) -> DataFrame:
    """The `best` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts in lower case (A to Z) are cut into pieces at .,;:!? and line ends, pieces into words at spaces and tabs. A
    candidate is a phrase of 2 to `longest` words with a >= `least` occurrences, overlapping ones counted. Cut after its
    first words it scores floor(2000000 a / (l + r)); the lowest cut counts, of equal ones the first. A candidate is dropped
    if a longer candidate holds it and has COVERED percent of its occurrences. Order: score, a, both from the highest, then
    the phrase by its bytes.

    A null text is empty, a null language is `und`. Repeated rows count again. Texts are read whole, however long: a task
    holds one shard and the text that ends it. An empty table, or one without a frequent pair, gives no rows. Other columns
    are not read.
    """
    every, totals = frequencies(docs, lang, text, least, longest, size, max_sent)
    single = every.select("lang", "phrase", "f")
    found = every.where("k > 1").withColumn("w", F.split("phrase", " "))
    # the longer ones that hold a candidate
    inner = found.where("k > 2").select("lang", "f", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: _part(i, n))))).alias("phrase"))
    cover = inner.groupBy("lang", "phrase").agg(F.max("f").alias("covered"))
    left = found.join(cover, ["lang", "phrase"], "left").where(F.col("covered").isNull() | (100 * F.col("covered") < COVERED * F.col("f")))
    cuts = left.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(i.alias("k"), _part(F.lit(1), i).alias("head"), _part(i + 1, F.col("k") - i).alias("tail")))).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut.k", F.col("cut.head").alias("head"), F.col("cut.tail").alias("tail"))
    cuts = cuts.join(single.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(single.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("(cast(2000000 AS decimal(10, 0)) * cast(a AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) + cast(r AS decimal(19, 0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", rank).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents
), w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, {LONGEST + 1}) t(k)),
f AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}
), c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
parts AS (
  SELECT lang, f, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))
), gone AS (
  SELECT DISTINCT c.lang, c.phrase FROM c JOIN parts ON parts.lang = c.lang AND parts.phrase = c.phrase WHERE 100 * parts.f >= {COVERED} * c.f
), cuts AS (
  SELECT lang, phrase, f AS a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c ANTI JOIN gone USING (lang, phrase))
), scored AS (
  SELECT cuts.*, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {BEST}
"""
