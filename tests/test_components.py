import random

import pytest

from tessera.operators.components import connected_components


def brute(edges):
    low = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            low.setdefault(a, a), low.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a in low and b in low and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                moved = True
    return low


@pytest.mark.parametrize("seed", [0, 1])
def test_matches_brute_force(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 230)] + [(5, 5), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()
    assert {x["node"]: x["root"] for x in got} == brute(edges)
    assert len(got) == len(brute(edges))


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0
