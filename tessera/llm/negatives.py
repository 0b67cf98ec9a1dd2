"""Hard negatives by one-dimensional distance keys.

With one more component, sqrt(M - |x|^2) for a row (M is the largest |x|^2) and 0 for an anchor, the order of inner products
is the order of Euclidean distances: d^2 = |q|^2 + M - 2<q, x>. Each row is stored under the key (nearest pivot, distance to
it), sorted, in blocks; a block spans an interval of keys. A row of a block lies no nearer to an anchor than the gap between
the interval and the anchor's own distance to that pivot, and no farther than the sum of both. A search scans the intervals
around the anchor's keys in rounds, ever wider; a block is left out once its bounds show that it can't hold any of the best k,
and the last round scans all that its bounds don't exclude, so the result is exact.

Anchors go in blocks too: a block of anchors meets a block of rows in one product of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.shared import materialise

#: Rows that pivots are chosen from, pivots, rows of a block, anchors of a block.
SAMPLE, PIVOTS, ROWS, ANCHORS = 2_000, 32, 2_048, 256
#: Shares of all (anchors, block) gaps that the rounds before the last one reach.
ROUNDS = (0.1,)
#: Products up to this are exact in doubles.
EXACT = float(1 << 53)
#: Distances are compared with this slack, relative to the largest.
SLACK = 1e-6
_LONG = (1 << 63) - 1


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows of a matrix; shorter ones end in zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(ends) and (ends == dim).all():
        return flat.reshape(len(ends), dim)
    out = np.zeros((len(ends), dim), np.int64)
    at = 0
    for i, n in enumerate(ends.tolist()):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def distances(vectors: np.ndarray, largest: float, pivots: np.ndarray, anchors: bool) -> np.ndarray:
    """From each row, or anchor, to each pivot; pivots have the additional component."""
    v = vectors.astype(np.float64)
    size = (v * v).sum(1)
    extra = np.zeros(len(v)) if anchors else np.sqrt(np.maximum(0.0, largest - size))
    dot = v @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1]
    return np.sqrt(np.maximum(0.0, (size + extra * extra)[:, None] + (pivots * pivots).sum(1) - 2 * dot))


def choose_pivots(sample: np.ndarray, largest: float, n: int) -> np.ndarray:
    """Rows of the sample far from each other, one after another, with the additional component."""
    v = sample.astype(np.float64)
    v = np.c_[v, np.sqrt(np.maximum(0.0, largest - (v * v).sum(1)))]
    chosen, far = [0], ((v - v[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(v)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((v - v[chosen[-1]]) ** 2).sum(1))
    return v[chosen]


def scores(anchors: np.ndarray, rows: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products: in doubles where these are exact, else in Python's integers, held within 64 bits."""
    if largest < EXACT:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return np.clip(anchors.astype(object) @ rows.astype(object).T, -_LONG - 1, _LONG).astype(np.int64)


def best_of(row: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores that fit; of equal ones the first."""
    at = np.flatnonzero(fits)
    if len(at) > k:
        s = row[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
        at = at[np.argsort(-row[at], kind="stable")][:k]
    return at


class Index:
    """All rows by (pivot, distance), in blocks, and the anchors among them."""

    def __init__(self, rows: DataFrame, is_anchor, sample: int = SAMPLE, pivots: int = PIVOTS, block: int = ROWS, together: int = ANCHORS) -> None:
        """`rows`: id bigint, label bigint, v array<bigint>."""
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        one = rows.agg(F.max(F.size("v")), F.max(square), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
        self.dim, self.largest, top = one[0] or 0, float(one[1] or 0.0), one[2] or 0.0
        self.kind = "<i2" if top < 1 << 15 else "<i8"
        near = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().column(0).combine_chunks()
        self.pivots = choose_pivots(matrix(near, self.dim), self.largest, pivots) if len(near) else np.zeros((1, 1))
        self.rows = materialise(self._blocks(rows, block, False), "blocks")
        self.anchors = materialise(self._blocks(rows.where(is_anchor), together, True), "anchors")
        # gaps and reaches of every pair of blocks: a row for each, however few of them a search will scan
        legs = self.anchors.select(F.col("block").alias("g"), F.posexplode(F.arrays_zip("near", "far")).alias("pivot", "d")).select("g", "pivot", F.col("d.near").alias("near"), F.col("d.far").alias("far"))
        gap = F.greatest(F.lit(0.0), F.col("lo") - F.col("far"), F.col("near") - F.col("hi"))
        self.gaps = materialise(legs.join(self.rows.select("block", "pivot", "lo", "hi"), "pivot").select("g", "block", gap.alias("gap"), (F.col("hi") + F.col("far")).alias("reach")), "gaps")

    def _blocks(self, rows: DataFrame, size: int, anchors: bool) -> DataFrame:
        dim, kind, largest, pivots = self.dim, self.kind, self.largest, self.pivots

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    some = batch.slice(start, 4096)
                    v = matrix(some.column(2), dim)
                    d = distances(v, largest, pivots, anchors)
                    at = d.argmin(1)
                    packed = pa.array([r.tobytes() for r in v.astype(kind)], pa.binary())
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), packed, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(d)), at])], ["id", "label", "v", "pivot", "distance"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            no = TaskContext.get().partitionId() << 32
            held: list[pa.RecordBatch] = []

            def out() -> pa.RecordBatch:
                t = pa.Table.from_batches(held).sort_by("id")
                v = b"".join(t.column("v").to_pylist())
                d = distances(np.frombuffer(v, kind).reshape(-1, dim), largest, pivots, True) if anchors else t.column("distance").to_numpy()[:, None]
                low, high = d.min(0), d.max(0)
                ids, labels = (t.column(c).to_numpy().astype("<i8").tobytes() for c in ("id", "label"))
                return pa.RecordBatch.from_arrays([pa.array([no]), pa.array([t.column("pivot")[0].as_py()], pa.int32()), pa.array([float(low[0])]), pa.array([float(high[0])]), pa.array([low.tolist()]), pa.array([high.tolist()]), *(pa.array([x], pa.binary()) for x in (ids, labels, v))], ["block", "pivot", "lo", "hi", "near", "far", "ids", "labels", "v"])

            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    if held and held[0].column(3)[0] != batch.column(3)[at]:
                        yield out()
                        held, no = [], no + 1
                    p = batch.column(3).to_numpy()[at:]
                    run = int(np.argmax(p != p[0])) if (p != p[0]).any() else len(p)
                    use = min(run, size - sum(b.num_rows for b in held))
                    held.append(batch.slice(at, use))
                    at += use
                    if sum(b.num_rows for b in held) == size:
                        yield out()
                        held, no = [], no + 1
            if held:
                yield out()

        made = rows.select("id", "label", "v").mapInArrow(keyed, "id bigint, label bigint, v binary, pivot int, distance double")
        # the id breaks ties, so rows of one key can go to several tasks
        stored = made.repartitionByRange("pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")
        return stored.mapInArrow(cut, "block bigint, pivot int, lo double, hi double, near array<double>, far array<double>, ids binary, labels binary, v binary")

    def _scan(self, work: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, slot, id, score): of each pair of blocks the best k of each target."""
        dim, kind, largest = self.dim, self.kind, self.largest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    asked, ai, al, av, ri, rl, rv = (c[i].as_py() for c in batch.columns)
                    ids, labels, aids, alabels = (np.frombuffer(x, "<i8") for x in (ri, rl, ai, al))
                    s = scores(np.frombuffer(av, kind).reshape(-1, dim), np.frombuffer(rv, kind).reshape(-1, dim), largest)
                    place = {a: j for j, a in enumerate(aids.tolist())}
                    out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
                    for t in asked:
                        j = place[t["anchor"]]
                        fits = (labels == alabels[j]) & (ids != aids[j]) if same else labels != alabels[j]
                        if t["low"] is not None:
                            fits &= s[j] >= t["low"]
                        if t["high"] is not None:
                            fits &= s[j] <= t["high"]
                        at = best_of(s[j], fits, k)
                        if len(at):
                            out.append((t["anchor"], t["slot"], ids[at], s[j][at]))
                    if out:
                        n = [len(x[2]) for x in out]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in out], n)), pa.array(np.repeat(np.array([x[1] for x in out], np.int32), n)), pa.array(np.concatenate([x[2] for x in out])), pa.array(np.concatenate([x[3] for x in out]))], ["anchor", "slot", "id", "score"])

        return work.select("asked", "ai", "al", "av", "ids", "labels", "v").mapInArrow(run, "anchor bigint, slot int, id bigint, score bigint")

    def search(self, targets: DataFrame, k: int, same: bool) -> DataFrame:
        """Targets (g, anchor, slot, size, low, high) to (anchor, slot, id, score, rank): the k highest scores from low to high (null: any) among rows of the same label (the anchor left out), or of others.

        `size` is |q|^2 of the anchor. Ties by the smaller id.
        """
        targets = materialise(targets, "targets")
        edges = self.gaps.agg(F.percentile_approx("gap", list(ROUNDS))).first()[0] or []
        edges = [-1.0, *edges, float("inf")]
        slack = SLACK * (self.largest**0.5 + 1)

        def far(score: str, none: float) -> Column:
            """The distance of a score."""
            return F.when(F.col(score).isNull(), none).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("size") + F.lit(self.largest) - 2.0 * F.col(score))))

        found, ranked = None, None
        for after, to in zip(edges, edges[1:], strict=False):
            open_ = targets
            if ranked is not None:
                last = ranked.where(F.col("rank") == k).select("anchor", "slot", F.col("score").alias("kth"))
                open_ = targets.join(last, ["anchor", "slot"], "left").withColumn("low", F.greatest("low", "kth")).drop("kth")
            # per block of anchors: its targets, and between which distances rows can matter to any of them
            asked = open_.groupBy("g").agg(F.collect_list(F.struct("anchor", "slot", "low", "high")).alias("asked"), F.max(far("low", float("inf"))).alias("outer"), F.min(far("high", 0.0)).alias("inner"))
            near = self.gaps.where((F.col("gap") > after) & (F.col("gap") <= to))
            pairs = near.join(asked.select("g", "outer", "inner"), "g").where((F.col("gap") <= F.col("outer") + slack) & (F.col("reach") >= F.col("inner") - slack)).select("g", "block")
            sides = asked.select("g", "asked").join(self.anchors.select(F.col("block").alias("g"), F.col("ids").alias("ai"), F.col("labels").alias("al"), F.col("v").alias("av")), "g")
            work = pairs.join(sides, "g").join(self.rows.select("block", "ids", "labels", "v"), "block")
            got = self._scan(work, k, same)
            found = got if ranked is None else ranked.drop("rank").unionByName(got)
            rank = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
            ranked = materialise(found.withColumn("rank", rank).where(F.col("rank") <= k), "ranked")
        return ranked


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(rows: DataFrame, key: str, label: str, vector: str, scale: float | None) -> DataFrame:
    """(id, label, v): rows whose key, label and components are all given and finite; v is floor(scale x), or the integers themselves."""
    c = F.col(f"`{vector}`")
    good = F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = (lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))) if scale else (lambda x: x)
    return rows.where(F.coalesce(good, F.lit(False))).select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), F.transform(c, lambda x: whole(x).cast("bigint")).alias("v"))


def mine(rows: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float | None = 256.0, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = ROWS, together: int = ANCHORS, pivots: int = PIVOTS) -> DataFrame:
    """For each anchor (a row whose key is divisible by `every`) and each of its `positives` best rows of the same label: the first `negatives` rows of other labels whose score is `low` to `high` percent of the positive's.

    The columns are those of RESULT. Scores are integer inner products (of floor(scale x)); higher ones come first, ties by
    the smaller key. A positive under zero has no negatives.

    Rows with a null key or label, a null vector, or a component that is null or not finite take no part. Shorter vectors count as
    ended by zeros. Rows that share a key count once (that of the smallest label, then vector). Scores beyond 64 bits are
    held at the limits. An empty table, or one without an anchor, gives no rows. Other columns are not read.

    The pivots come from a sample of SAMPLE rows; all rows are indexed.
    """
    rows = usable(rows, key, label, vector, scale)
    again = materialise(rows.groupBy("id").count().where("count > 1").select("id"), "again")
    if not again.isEmpty():
        once = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
        rows = rows.join(again, "id", "left_anti").unionByName(once)
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], RESULT)
    rows = materialise(rows, "vectors")
    is_anchor = F.col("id") % every == 0
    index = Index(rows, is_anchor, pivots=pivots, block=block, together=together)
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    members = index.anchors.select(F.col("block").alias("g"), "ids")
    anchors = materialise(_members(members).join(rows.where(is_anchor).select(F.col("id").alias("anchor"), size.alias("size")), "anchor"), "members")
    none = F.lit(None).cast("bigint")
    first = index.search(anchors.select("g", "anchor", F.lit(0).alias("slot"), "size", none.alias("low"), none.alias("high")), positives, True)
    pairs = materialise(first.where("score >= 0").select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score").cast("decimal(22, 0)")
    bounds = pairs.select("anchor", "slot", F.floor((low * score + 99) / 100).cast("bigint").alias("low"), F.floor(high * score / 100).cast("bigint").alias("high"))
    second = index.search(bounds.join(anchors, "anchor").select("g", "anchor", "slot", "size", "low", "high"), negatives, False)
    out = second.withColumnsRenamed({"id": "negative", "score": "negative_score"}).join(pairs, ["anchor", "slot"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("negative").alias("negative_id"), "positive_score", "negative_score")


def _members(blocks: DataFrame) -> DataFrame:
    """(g, anchor) of blocks of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), g)), pa.array(a)], ["g", "anchor"])

    return blocks.mapInArrow(run, "g bigint, anchor bigint")


ORACLE = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
