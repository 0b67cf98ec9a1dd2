"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to). On the driver, which gets one row
a pattern, a flow network routes each pattern's tokens to the quotas of its sources: the first pass over a pattern costs
nothing, each repetition one more than the last, so the cheapest flow repeats as little as it can. Documents are then
selected: all of a pattern's documents as often as its flow is a multiple of its size, and once more those that come
first in a seeded order, up to the rest. The place where that order stops is found from a histogram of hash buckets, so
no source is ever sorted as a whole; only the documents of one zone of buckets meet in a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, fresh
from tessera.plans.shared import materialise

#: A third copy is the last that a document gives.
MAX_COPIES = 3
#: Hash buckets of each pattern; the zone in which documents are chosen one by one is one of them, or as many as hold ZONE_DOCS.
BUCKETS, ZONE_DOCS = 4096, 256
#: Patterns and sources that the driver takes; more raise an error.
MAX_PATTERNS = 200_000
#: Chosen documents of the zones that are broadcast (24 bytes each); more are joined by shuffle.
MAX_BROADCAST = 1_000_000


def words(text: Column) -> Column:
    """Number of words; 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def quotas(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float = MAX_COPIES) -> list[float]:
    """Shares of the budget by weight; a share stops at `most` times its source's size, and the excess is shared anew among the others until none is above."""
    target: list[float] = [0.0] * len(sizes)
    open_, left = {i for i in range(len(sizes)) if weights[i] > 0}, float(budget)
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        share = {i: left * weights[i] / total for i in open_}
        full = [i for i in sorted(open_) if share[i] > most * sizes[i]]
        for i in full or open_:
            target[i] = float(most * sizes[i]) if full else share[i]
        if not full:
            break
        left -= sum(target[i] for i in full)
        open_ -= set(full)
    return target


def route(patterns: Sequence[tuple[Sequence[int], int]], quota: Sequence[int], copies: int = MAX_COPIES) -> list[dict[int, int]]:
    """Tokens that each pattern (its sources, its size) gives to each source: a maximal flow of least repetition cost, by successive shortest paths."""
    n, m = len(patterns), len(quota)
    start, end = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, cap: int, price: int) -> int:
        for x, y, c, p in ((a, b, cap, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y), room.append(c), cost.append(p)
        return len(to) - 2

    routes: list[dict[int, int]] = [{} for _ in patterns]
    for i, (sources, size) in enumerate(patterns):
        for again in range(copies):
            arc(start, i, size, again)
        for s in sources:
            routes[i][s] = arc(i, n + s, copies * size, 0)
    for s, q in enumerate(quota):
        arc(n + s, end, q, 0)
    height = [0] * len(graph)
    while True:
        far: dict[int, int] = {start: 0}
        via: dict[int, int] = {}
        heap, done = [(0, start)], set()
        while heap:
            d, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            for e in graph[a]:
                b = to[e]
                if room[e] > 0 and b not in done and (now := d + cost[e] + height[a] - height[b]) < far.get(b, 1 << 60):
                    far[b], via[b] = now, e
                    heapq.heappush(heap, (now, b))
        if end not in far:
            return [{s: room[e ^ 1] for s, e in r.items() if room[e ^ 1]} for r in routes]
        for a, d in far.items():
            height[a] += min(d, far[end])
        for a in range(len(graph)):
            if a not in far:
                height[a] += far[end]
        flow, at = 1 << 60, end
        while at != start:
            flow, at = min(flow, room[via[at]]), to[via[at] ^ 1]
        at = end
        while at != start:
            room[via[at]] -= flow
            room[via[at] ^ 1] += flow
            at = to[via[at] ^ 1]


def in_turn(names: Sequence[str | None], weights: Sequence[float] = (1, 2, 3)) -> list[float]:
    """Weights given to the sources in order, repeating."""
    return [weights[i % len(weights)] for i in range(len(names))]


@dataclass
class Plan:
    """What the driver decides: a row for each pattern, and the documents of the patterns' zones that are chosen once more."""

    patterns: DataFrame
    chosen: DataFrame
    seed: int


def _described(docs: DataFrame, sources: Column, size: Column, key: str, seed: int) -> Column:
    """All that decides about a document: its pattern, its size, and the hash that orders it."""
    n = F.coalesce(size, F.lit(0)).cast("bigint")
    content = F.xxhash64(F.lit(seed), F.col(key).cast("string"), n)
    return F.struct(F.array_sort(F.array_distinct(sources)).alias("sources"), n.alias("size"), content.alias("content"), F.pmod(content, F.lit(BUCKETS)).cast("int").alias("bucket"))


def plan(docs: DataFrame, sources: Column, size: Column, key: str = "doc_id", weigh: Callable[[Sequence[str | None]], Sequence[float]] = in_turn, share: float = 1.0, copies: int = MAX_COPIES, seed: int = 7) -> Plan:
    """Routes the tokens of all documents; see mix()."""
    spark = docs.sparkSession
    base = materialise(docs.select(_described(docs, sources, size, key, seed).alias("d")).select("d.*"), "mix")
    groups = base.groupBy("sources").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    names = sorted({s for g in groups for s in g["sources"] or []}, key=lambda s: (s is None, s or ""))
    if len(groups) > MAX_PATTERNS or len(names) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns")
    groups.sort(key=lambda g: (g["sources"] is None, [(s is None, s or "") for s in g["sources"] or []]))
    place = {s: i for i, s in enumerate(names)}
    members = [([place[s] for s in g["sources"] or []], g["size"]) for g in groups]
    sizes = [0] * len(names)
    for of, n in members:
        for s in of:
            sizes[s] += n
    target = quotas(sizes, list(weigh(names)), share * sum(n for _, n in members), copies)
    flow = [sum(r.values()) for r in route(members, [round(t) for t in target], copies)]
    rows = [
        (i, g["sources"], [sizes[s] for s in of], [target[s] for s in of], f // n if n else 0, f % n if n else 0)
        for i, (g, (of, n), f) in enumerate(zip(groups, members, flow, strict=True))
    ]
    schema = "pattern int, of array<string>, source_sizes array<bigint>, targets array<double>, whole bigint, rest bigint"
    partial = F.broadcast(spark.createDataFrame([r for r in rows if r[5]], schema)).select("pattern", "of", "rest")
    open_ = base.join(partial, base["sources"].eqNullSafe(F.col("of"))).select("pattern", "rest", "content", "size", "bucket")
    # the zone: from the bucket in which the seeded order reaches the rest, until ZONE_DOCS documents are in it
    by = W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    hist = open_.groupBy("pattern", "rest", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    late = hist.withColumn("up_to", F.sum("words").over(by)).where("up_to > rest").withColumn("docs_up_to", F.sum("docs").over(by))
    zones = late.groupBy("pattern").agg(
        F.min("bucket").alias("low"),
        F.coalesce(F.min(F.when(F.col("docs_up_to") >= ZONE_DOCS, F.col("bucket"))), F.lit(BUCKETS)).alias("high"),
        F.min_by(F.col("rest") - F.col("up_to") + F.col("words"), "bucket").alias("left"),
    )
    zone_rows = [tuple(z) for z in zones.collect()]
    zones = F.broadcast(spark.createDataFrame(zone_rows, "pattern int, low int, high int, left bigint"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        """In seeded order, what still fits; documents of one hash and size go together."""
        pdf = pdf.sort_values(["content", "size"], kind="stable")
        left, take = int(pdf["left"].iloc[0]), []
        for n in (pdf["size"] * pdf["docs"]).tolist():
            take.append(n <= left)
            left -= n * take[-1]
        return pdf[take][["pattern", "content", "size"]]

    inside = open_.join(zones, "pattern").where(F.col("bucket").between(F.col("low"), F.col("high")))
    inside = inside.groupBy("pattern", "left", "content", "size").agg(F.count("*").alias("docs"))
    chosen = materialise(inside.groupBy("pattern").applyInPandas(choose, "pattern int, content bigint, size bigint"), "chosen")
    low = {z[0]: z[1] for z in zone_rows}
    patterns = spark.createDataFrame([(*r, low.get(r[0], 0)) for r in rows], schema + ", low int")
    return Plan(patterns, chosen, seed)


def apply(docs: DataFrame, plan: Plan, sources: Column, size: Column, key: str = "doc_id") -> tuple[DataFrame, str]:
    """The rows and columns of docs, and a struct whose name is returned: size, source_sizes, targets, copies. Documents stay where they are, unless the zones hold over MAX_BROADCAST documents."""
    d, p, z = fresh(docs, "mix", "mix_pattern", "mix_zone")
    patterns = F.broadcast(plan.patterns.select(F.struct("*").alias(p)))
    rows = docs.withColumn(d, _described(docs, sources, size, key, plan.seed)).join(patterns, F.col(f"{d}.sources").eqNullSafe(F.col(f"{p}.of")))
    chosen = plan.chosen.select(F.struct("*").alias(z))
    chosen = F.broadcast(chosen) if plan.chosen.count() <= MAX_BROADCAST else chosen
    same = [F.col(f"{p}.pattern") == F.col(f"{z}.pattern"), F.col(f"{d}.content") == F.col(f"{z}.content"), F.col(f"{d}.size") == F.col(f"{z}.size")]
    rows = rows.join(chosen, same, "left")
    early = (F.col(f"{p}.rest") > 0) & (F.col(f"{d}.bucket") < F.col(f"{p}.low"))
    copies = F.col(f"{p}.whole") + F.when(early | F.col(z).isNotNull(), 1).otherwise(0)
    done = F.struct(F.col(f"{d}.size").alias("size"), F.col(f"{p}.source_sizes").alias("source_sizes"), F.col(f"{p}.targets").alias("targets"), copies.alias("copies"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], done.alias(d)), d


def one_source(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """Documents that belong to one source each, sized in words: key, size, source_size, target, taken, copies.

    A document's sources are a set of names: order and repeats don't matter, and null is a source of its own; a document
    of none is never taken. `weigh` gives the weights of all sources, which it gets by code point, null last. The budget
    is `share` of the sizes of all documents. A null text has size 0. Reruns agree: what a document gets depends on its
    key, its size, the seed and the totals, so rows that agree in these get the same. Repeated rows count as documents of
    their own, null keys too; an empty table gives an empty result.
    """
    sized = materialise(docs.select(key, source, words(F.col(text)).alias("size")), "sized")  # texts are read once
    by = F.array(F.col(source))
    mixed, m = apply(sized, plan(sized, by, F.col("size"), key, **options), by, F.col("size"), key)
    of = lambda c: F.col(f"{m}.{c}")
    return mixed.select(key, of("size").alias("size"), of("source_sizes")[0].alias("source_size"), of("targets")[0].alias("target"), (of("size") * of("copies")).alias("taken"), of("copies").alias("copies"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The columns of docs; each row as often as the mix takes it. As one_source() otherwise."""
    by, size = F.array(F.col(source)), words(F.col(text))
    mixed, m = apply(docs, plan(docs, by, size, key, **options), by, size, key)
    n = fresh(docs, "copy")[0]
    rows = mixed.where(F.col(f"{m}.copies") > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(f"{m}.copies").cast("int"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
