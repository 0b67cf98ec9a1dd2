import pytest
from pyspark.sql import functions as F

from tessera.operators import pair_filter as P


def keys(spark, low, high):
    return spark.range(low, high).select(F.sha2(F.col("id").cast("string"), 256).alias("pair_id"), F.col("id").alias("block"))


def test_no_pair_is_lost_and_few_are_asked_in_vain(spark):
    blocks = P.blocks_for(20_000, 0.01)
    held = P.of(keys(spark, 0, 20_000), "pair_id", blocks)
    assert P.asked(keys(spark, 0, 20_000), "pair_id", held, blocks).where("NOT maybe_seen").count() == 0
    wrong = P.asked(keys(spark, 20_000, 60_000), "pair_id", held, blocks).where("maybe_seen").count()
    assert 0 < wrong <= 1.2 * 0.01 * 40_000
    assert P.false_positives(blocks, 20_000) <= 0.01 < P.false_positives(blocks - 1, 20_000)


def test_filters_merge(spark):
    blocks = P.blocks_for(1000, 0.01)
    whole = P.of(keys(spark, 0, 1000), "pair_id", blocks)
    parts = P.merged(P.of(keys(spark, 0, 400), "pair_id", blocks), P.of(keys(spark, 300, 1000), "pair_id", blocks))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_unseen_is_exact(spark):
    """Also with a filter so small that it takes nearly every pair for seen; columns may have its names."""
    old = keys(spark, 0, 700)
    for blocks in (1, 50):
        held = P.of(old, "pair_id", blocks)
        got = P.unseen(keys(spark, 500, 1500), "pair_id", held, old, blocks)
        assert got.columns == ["pair_id", "block"] and sorted(r["block"] for r in got.collect()) == list(range(700, 1500))
    nothing = spark.createDataFrame([], P.SCHEMA)
    assert P.unseen(keys(spark, 0, 10), "pair_id", nothing, old.limit(0), 5).count() == 10
    assert P.unseen(spark.createDataFrame([(None,)], "pair_id string"), "pair_id", held, old, 50).count() == 1


@pytest.mark.parametrize("items, rate", [(1, 0.5), (1000, 0.001), (50_000_000, 0.001)])
def test_sizing(items, rate):
    blocks = P.blocks_for(items, rate)
    assert P.false_positives(blocks, items) <= rate and blocks * 512 < 40 * items + 512
