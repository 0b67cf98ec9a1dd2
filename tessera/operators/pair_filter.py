"""Which pairs were seen before: a Bloom filter kept as a table, asked before any exact join.

The bits lie in blocks of eight 64-bit words, and a pair sets one bit in each word of its block, so one hash places it and
one equi-join asks for it. Adding is a partial aggregate (bit_or), and two filters of the same size merge the same way.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 8
BITS = [f"b{i}" for i in range(LANES)]
SCHEMA = "block bigint, " + ", ".join(f"{b} bigint" for b in BITS)


def false_positives(blocks: int, items: int) -> float:
    """The share of pairs not added that a filter of so many blocks takes for added, with so many pairs in it."""
    load = items / blocks
    total, weight, n = 0.0, math.exp(-load), 0
    if weight == 0.0:
        return 1.0
    while n <= load + 12 * math.sqrt(load) + 30:
        total += weight * (1 - (63 / 64) ** n) ** LANES
        n += 1
        weight *= load / n
    return total


def blocks_for(items: int, rate: float) -> int:
    """The fewest blocks that keep the share of false positives within `rate`."""
    low, high = 1, 1
    while false_positives(high, items) > rate:
        low, high = high, 2 * high
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if false_positives(mid, items) <= rate else (mid + 1, high)
    return high


def _placed(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and its bit in each word."""
    h = F.xxhash64(F.lit(1), key)
    one = F.lit(1).cast("bigint")
    bit = lambda i: F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    return F.pmod(F.xxhash64(F.lit(2), key), F.lit(blocks)), [bit(i) for i in range(LANES)]


def of(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter (SCHEMA) of the keys; only blocks with a bit have a row."""
    block, bits = _placed(F.col(key), blocks)
    marked = rows.select(block.alias("block"), *[b.alias(n) for b, n in zip(bits, BITS, strict=True)])
    return marked.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in BITS])


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two filters of as many blocks as one."""
    return a.unionByName(b).groupBy("block").agg(*[F.bit_or(n).alias(n) for n in BITS])


def asked(rows: DataFrame, key: str, held: DataFrame, blocks: int, name: str = "maybe_seen") -> DataFrame:
    """The rows with whether their key may have been added; false is certain. A null key was never seen."""
    block, bits = _placed(F.col(key), blocks)
    mine = held.select(F.col("block").alias("_block"), *[F.col(n).alias(f"_{n}") for n in BITS])
    hit = reduce(Column.__and__, [F.col(f"_{n}").bitwiseAND(b) == b for n, b in zip(BITS, bits, strict=True)])
    joined = rows.withColumn("_at", block).join(mine, F.col("_at") == F.col("_block"), "left")
    return joined.select(*rows.columns, F.coalesce(hit & F.col(key).isNotNull(), F.lit(False)).alias(name))


def unseen(rows: DataFrame, key: str, held: DataFrame, exact: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key isn't in `exact`, all of whose keys `held` has: those that the filter doesn't know without a look at `exact`, the others after it."""
    told = asked(rows, key, held, blocks)
    sure, maybe = told.where("NOT maybe_seen"), told.where("maybe_seen")
    return sure.unionByName(maybe.join(exact.select(key), key, "left_anti").select(sure.columns)).drop("maybe_seen")
