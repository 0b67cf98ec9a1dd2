import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import negatives as N
from tessera.llm import queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank string, g int"


def plain(rows, scale=256.0, every=100, positives=5, negatives=10):
    """The definition, by comparing every anchor with every row."""
    kept = {}
    for k, v, label in rows:
        if k is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = (label, [math.floor(scale * float(np.float32(x))) for x in v])
        kept[k] = min(one, kept.get(k, one))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        ranked = sorted((-dot(v, w), k, other) for k, (other, w) in kept.items() if k != a)
        for s, p, _ in [r for r in ranked if r[2] == label][:positives]:
            fits = [(k, n) for n, k, other in ranked if other != label and 30 * -s <= 100 * -n <= 90 * -s]
            out += [(a, p, i, k, -s, -n) for i, (k, n) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def cloud(seed, n=700, dim=6, groups=5):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    return [(i - 50, [c + r.gauss(0, 0.2) for c in r.choice(centres)], r.randrange(4)) for i in range(n)]


def odd():
    same = [(2000 + i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0], i % 2) for i in range(300)]  # ties, more than a block of them
    nan, inf = float("nan"), float("inf")
    bad = [(100, None, 1), (200, [nan] * 6, 1), (300, [inf, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (400, [1.0] * 6, None), (None, [1.0] * 6, 1), (500, [None, 1.0], 1)]
    return same + bad + [(3000, [], 0), (3100, [0.7], 1), (3200, [0.0] * 6, 1), (3300, [-1.0] * 6, 0)]


@pytest.mark.parametrize("seed, block, together, pivots", [(1, 64, 3, 8), (2, 16, 2, 20), (3, 2048, 256, 1)])
def test_equals_the_definition(spark, seed, block, together, pivots):
    rows = cloud(seed) + odd() + cloud(seed)[:20] + [(k, v, 3 - label) for k, v, label in cloud(seed)[40:60]]
    df = spark.createDataFrame([(k, v, label, "clash", 1) for k, v, label in rows], SCHEMA).repartition(3)
    got = N.mine(df, block=block, together=together, pivots=pivots)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got, want = sorted(map(tuple, got.collect())), plain(rows)
    assert len(want) > 100 and got == want


def test_far_blocks_are_left_out(spark):
    """Well-parted groups: the bounds exclude most pairs of blocks, and nothing is lost."""
    r = random.Random(9)
    rows = []
    for i in range(1500):
        centre = [0.0] * 12
        centre[i % 12] = 1.0
        rows.append((i, [c + r.gauss(0, 0.02) for c in centre], (i // 12) % 3))
    df = spark.createDataFrame([(k, v, label, None, None) for k, v, label in rows], SCHEMA)
    seen = []
    scan = N.Index._scan
    N.Index._scan = lambda self, work, k, same: seen.append((work.count(), self.gaps.count())) or scan(self, work, k, same)
    try:
        got = N.mine(df, block=16, together=1, pivots=24)
        assert sorted(map(tuple, got.collect())) == plain(rows)
    finally:
        N.Index._scan = scan
    positive, whole = sum(n for n, _ in seen[: len(N.ROUNDS) + 1]), seen[0][1]
    assert positive < 0.5 * whole


def test_empty_and_no_anchor(spark):
    assert N.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert N.mine(spark.createDataFrame([(1, [1.0], 1, None, None), (2, [1.0], 0, None, None)], SCHEMA)).collect() == []
    assert N.mine(spark.createDataFrame([(100, [1.0], 1, None, None)], SCHEMA)).collect() == []


def test_scores_beyond_doubles_are_exact():
    a = np.array([[(1 << 40) + 1, 3]], np.int64)
    b = np.array([[(1 << 20) + 1, 5], [1 << 62, 1 << 62]], np.int64)
    got = N.scores(a, b, float(1 << 124))
    assert got.tolist() == [[((1 << 40) + 1) * ((1 << 20) + 1) + 15, (1 << 63) - 1]]


def test_matrix_of_slices():
    whole = pa.array([[1, 2], [3], [], [4, 5]], pa.list_(pa.int64()))
    assert N.matrix(whole.slice(1), 2).tolist() == [[3, 0], [0, 0], [4, 5]]


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = queries.op11_negatives(spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({N.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
