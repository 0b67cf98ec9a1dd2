"""SimHash near-duplicates: BK-trees over shards of fingerprints.

A BK-tree alone cannot prune a radius of 4 among random 64-bit values (distances crowd around 32, and the window of
edges that the triangle inequality leaves open holds most of them), so one tree over all fingerprints would make the
search quadratic. The trees are therefore cut into shards that lose no link: the 64 bits fall into blocks, and two
fingerprints that differ in at most `radius` bits agree on all but `radius` of them; each such choice of blocks with its
bits names a shard. With more fingerprints there are more blocks, so shards stay small. Each shard's tree is built where the shard lies; a shard over MAX_TREE fingerprints becomes several trees,
each sent to every block of the shard's queries, so no task holds more than two blocks.

Equal texts are one fingerprint from the start, and a shard returns a spanning star of each cluster instead of its pairs.

near_duplicates() links by one fingerprint. deduplicate() must find what a radius of 4 over shingles misses (a changed word
changes four or five shingles): it searches several fingerprints over distinct words, which a few changes move by few bits,
and confirms what it finds by wider fingerprints over shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh
from tessera.operators.components import connected_components
from tessera.plans.shared import materialise

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of one shard that make one tree.
MAX_TREE = 2048
#: Fingerprints that a shard holds on average; there are as many blocks as that takes.
MEAN_SHARD = 64
#: Shards over MAX_TREE that are broadcast as a list (24 bytes each); a longer list is joined by shuffle.
MAX_HEAVY = 100_000
#: deduplicate(): seeds of the SimHashes over distinct words that find copies, and of those over five-word shingles that
#: confirm them within so many bits of all; rows whose hashes (16 bytes each) are broadcast.
WORD_SEEDS, COPY_SHINGLE, CHECK_SEEDS, WITHIN, MAX_BROADCAST = (11, 22, 33), 5, (1, 2), 26, 2_000_000
#: Fingerprints, their nodes, and words to check.
Rows = tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a whole text; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.append(0, ends[:-shingle])
        cuts = map(slice, starts.tolist(), (ends[shingle - 1 :] - 1).tolist())
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, cuts), repeat(SEED)), np.uint64, len(starts))
    return _bits(hashes)


def _bits(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of every row; a null text counts as empty."""
    names = [key, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp bigint")


class BKTree:
    """Children are keyed by their integer distance to the parent."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        plain = [int(v) & (1 << 64) - 1 for v in values]
        for i in range(1, len(plain)):
            at, v = 0, plain[i]
            while True:
                d = (plain[at] ^ v).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = i
                    break
                at = below

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, indexes of the queries within the radius of it), all queries walking the tree together and following only edges within the radius."""
        if not len(self.values):
            return
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, who = todo.pop()
            d = np.bitwise_count((queries[who] ^ self.values[node]).view(np.uint64))
            near = who[d <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                if len(on := who[np.abs(d.astype(np.int16) - edge) <= radius]):
                    todo.append((child, on))


def stars(rows: Rows, queries: Rows | None, radius: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between nodes: a spanning star of each cluster that the links between rows and queries make (None: between the rows themselves).

    A link is a fingerprint within the radius; where rows carry words to check, these must differ in `within` bits at most too.
    """
    fp, node, check = rows
    asked, nodes, checks = rows if queries is None else queries
    if queries is None and len(fp) == 2 and ((int(fp[0]) ^ int(fp[1])) & (1 << 64) - 1).bit_count() > radius:
        return node[:0], node[:0]
    every = node if queries is None else np.concatenate([node, nodes])
    shift = 0 if queries is None else len(node)
    label = np.arange(len(every))
    for at, near in BKTree(fp).search(asked, radius):
        if checks:
            near = near[sum(np.bitwise_count((c[near] ^ own[at]).view(np.uint64)).astype(np.int16) for c, own in zip(checks, check, strict=True)) <= within]
        mine = np.unique(np.append(label[near + shift], label[at]))
        if len(mine) > 1:
            label[np.isin(label, mine)] = mine[0]
    moved = np.flatnonzero(label != np.arange(len(every)))
    return every[moved], every[label[moved]]


def _search(radius: int, within: int):
    """Rows (shard, part, side, fp, node, words to check), sorted by shard and part, to edges. side 0: tree and queries, 1: tree, 2: queries."""

    def group(side: np.ndarray, fp: np.ndarray, node: np.ndarray, *check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if side[0] == 0:
            return stars((fp, node, check), None, radius, within)
        tree, asked = ((fp[side == n], node[side == n], tuple(c[side == n] for c in check)) for n in (1, 2))
        return stars(tree, asked, radius, within)

    def cut(held: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
        shard, part = held[:2]
        if not len(shard):
            return held, []
        at = np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1
        starts, ends = np.append(0, at), np.append(at, len(shard))
        done = len(starts) if last else len(starts) - 1
        big = np.flatnonzero(ends[:done] - starts[:done] > 1)
        found = [group(*(c[s:e] for c in held[2:])) for s, e in zip(starts[big], ends[big], strict=True)]
        rest = len(shard) if last else starts[-1]
        return [x[rest:] for x in held], found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            held, found = cut(held, False)
            yield from out(found)
        yield from out(cut(held, True)[1] if held else [])

    def out(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["src", "dst"])

    return run


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks, at least radius + 2, whose shards of n fingerprints hold MEAN_SHARD on average."""
    for blocks in range(radius + 2, 2 * radius + 1):
        if n >> 64 * (blocks - radius) // blocks <= MEAN_SHARD:
            return blocks
    return 2 * radius + 1


def _shards(fp: Column, radius: int, blocks: int) -> list[Column]:
    """The shard keys of a fingerprint: a hash of which blocks are chosen and of their bits. Shards whose hashes collide are searched as one, which loses nothing."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    kept = [sum(((1 << edges[i + 1] - edges[i]) - 1) << edges[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in kept]
    return [F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m).cast("bigint"))) for i, m in enumerate(signed)]


def links(distinct: DataFrame, radius: int = RADIUS, max_tree: int = MAX_TREE, blocks: int | None = None, fp: str = "fp", node: str = "fp", check: tuple[str, ...] = (), within: int = 0) -> DataFrame:
    """Rows with a fingerprint each to edges (src, dst) of their nodes, whose components are those of all links within the radius.

    With words to check, two rows are linked only if these differ in `within` bits at most, all words together.
    """
    blocks = blocks_for(distinct.count(), radius) if blocks is None else blocks
    carried = [F.col(fp).alias("_fp"), F.col(node).alias("_node"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(check))]
    names = ["_fp", "_node", *(f"_c{i}" for i in range(len(check)))]
    rows = materialise(distinct.select(*carried, F.explode(F.array(*_shards(F.col(fp), radius, blocks))).alias("shard")), "shards")
    heavy = materialise(rows.groupBy("shard").count().where(F.col("count") > max_tree).select("shard", F.ceil(F.col("count") / max_tree).cast("int").alias("k")), "heavy")
    n = heavy.count()
    light = rows
    parts = None
    if n:
        heavy = F.broadcast(heavy) if n <= MAX_HEAVY else heavy
        light = rows.join(heavy, "shard", "left_anti")
        mine = F.pmod(F.xxhash64("_node"), F.col("k")).cast("int")
        parts = rows.join(heavy, "shard").withColumn("mine", mine).select("shard", *names, "k", "mine", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
        low, high = F.least("mine", "other"), F.greatest("mine", "other")
        side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
        parts = parts.select("shard", (low * F.col("k") + high).cast("int").alias("part"), side.cast("int").alias("side"), *names)
    task = light.select("shard", F.lit(0).alias("part"), F.lit(0).alias("side"), *names)
    task = task if parts is None else task.unionByName(parts)
    return task.repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(_search(radius, within), "src bigint, dst bigint")


def _rooted(classes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """The classes, with the root of each one's component (its own node, if it has no link)."""
    roots = connected_components(edges).select(F.col("node").alias(node), "root")
    return materialise(classes.join(roots, node, "left").withColumn("root", F.coalesce("root", node)), "rooted")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, max_tree: int = MAX_TREE, blocks: int | None = None) -> DataFrame:
    """One row a document: key, fp (signed), component_id (the smallest key that links of at most `radius` differing bits reach).

    A null or empty text has the fingerprint 0, which links like any other. A null key is never the smallest, unless its
    component has no other. Repeated rows give repeated rows; an empty table gives none; other columns are not read.
    """
    fps = materialise(fingerprints(docs, key, text), "fingerprints")
    classes = materialise(fps.groupBy("fp").agg(F.min(key).alias("least")), "classes")
    rooted = _rooted(classes, links(classes, radius, max_tree, blocks), "fp")
    # written, so that the join below deals out both sides anew and can split a large component
    of_root = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    members = rooted.select("fp", "root").join(of_root, "root").select("fp", "component_id")
    return fps.join(members, "fp").select(key, "fp", "component_id")


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_prints(text: str | None) -> tuple[list[int], list[int]]:
    """SimHashes of the distinct words of a whole text, one for each of WORD_SEEDS, and of its COPY_SHINGLE-word shingles, repeats included, for each of CHECK_SEEDS. All 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return [0] * len(WORD_SEEDS), [0] * len(CHECK_SEEDS)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    kinds, k = np.unique(h), min(COPY_SHINGLE, len(words))
    shingles = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        shingles = _mixed(shingles + h[i : len(h) - k + 1 + i], i + 1)
    return [_bits(_mixed(kinds, s)) for s in WORD_SEEDS], [_bits(_mixed(shingles, s)) for s in CHECK_SEEDS]


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, within: int = WITHIN, max_tree: int = MAX_TREE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The columns of docs; of each component of near-duplicates exactly one row stays: that of the smallest key, nulls last, and of rows that share it the one whose content hashes lowest.

    Two texts are linked if one of their SimHashes over distinct words, of which each text has one for each of WORD_SEEDS,
    differs in `radius` bits at most, and their SimHashes over five-word shingles (128 bits) in `within` at most, which
    texts of similarity 0.8 stay under. Case and white space don't count; null, empty and blank texts are one component.
    Rows that are equal in all columns are one row. Texts under five words are one shingle. An empty table gives an empty
    one. Columns of maps can't be compared and aren't supported.

    Rows that go are named by two hashes of their content (16 bytes); up to `max_broadcast` of them are broadcast, more are
    joined by shuffle.
    """
    one, two, n = fresh(docs, "content_hash", "content_hash2", "row_number")
    own = [F.col(f"`{c}`") for c in docs.columns]
    hashes = [F.xxhash64(*own).alias(one), F.xxhash64(F.lit(1), *own, F.lit(2)).alias(two)]
    words, checks = [f"w{i}" for i in range(len(WORD_SEEDS))], [f"c{i}" for i in range(len(CHECK_SEEDS))]
    names = ["key", "h1", "h2", *words, *checks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [sum(word_prints(t.as_py()), []) for t in batch.column(3)]
            columns = np.array(prints, np.int64).reshape(len(prints), len(words) + len(checks)).T
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c) for c in columns)], names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"{c} bigint" for c in names[1:])
    marks = docs.select(F.col(key).alias("key"), *hashes, F.col(text).alias("text")).mapInArrow(run, schema)
    # a row for each content: its class, and how many rows have it
    contents = marks.groupBy(*names).agg(F.count("*").alias("rows")).withColumn("node", F.xxhash64(*words, *checks))
    contents = materialise(contents, "contents")
    classes = materialise(contents.groupBy("node", *words, *checks).agg(F.min(_rank("key", "h1", "h2")).alias("best")), "classes")
    edges = None
    for w in words:
        found = materialise(links(classes, radius, max_tree, None, w, "node", tuple(checks), within), "links")
        edges = found if edges is None else edges.unionByName(found)
    rooted = _rooted(classes.select("node", "best"), edges, "node")
    keepers = materialise(rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.*"), "keepers")
    gone = contents.select("h1", "h2").distinct().join(keepers.select("h1", "h2"), ["h1", "h2"], "left_anti").select(F.col("h1").alias(one), F.col("h2").alias(two))
    repeated = contents.groupBy("h1", "h2").agg(F.sum("rows").alias("n")).where("n > 1").join(keepers.select("h1", "h2"), ["h1", "h2"], "left_semi").select(F.col("h1").alias(one), F.col("h2").alias(two))
    gone, repeated = materialise(gone, "gone"), materialise(repeated, "repeated")
    sized = lambda d: F.broadcast(d) if d.count() <= max_broadcast else d
    rows = docs.select(*own, *hashes)
    kept = rows.join(sized(gone), [one, two], "left_anti")
    if repeated.isEmpty():
        return kept.select(*own)
    repeated = sized(repeated)
    return kept.join(repeated, [one, two], "left_anti").select(*own).unionByName(kept.join(repeated, [one, two], "left_semi").select(*own).distinct())


def _rank(key: str, *hashes: str) -> Column:
    """Orders rows by key, nulls last, then by hashes."""
    return F.struct(F.col(key).isNull().alias("without"), F.col(key).alias("key"), *hashes)
