"""An append-only ledger chained by hashes.

hash = sha256(prev_hash | canonical payload). The chain is sequential, so one batch is folded by one task, in a stream that
holds one row; verification is parallel, as it needs the neighbour's stored hash alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.shared import materialise

GENESIS = hashlib.sha256(b"GENESIS").hexdigest()
#: Ledger ids of one window when neighbours are looked up.
STRIDE = 100_000
#: Entries that one task sorts and chains; more are chained block after block.
BLOCK = 1_000_000


def canonical(payload: Column) -> Column:
    """A struct as JSON with nulls kept; fields stand in the struct's order, which the caller sorts."""
    return F.to_json(payload, {"ignoreNullFields": "false"})


def chain(entries: DataFrame, seq: str, payload: str, prev: str = GENESIS, start: int = 1, most: int = BLOCK) -> DataFrame:
    """Entries in order of `seq` with ledger_id, prev_hash and hash; all other columns stay.

    Of more than `most` entries ranges of `seq` are chained one after the other: a task sorts one range, and the next starts
    from the last hash of the one before, which is all that the driver sees.
    """
    n = entries.count()
    if n <= most:
        return _chained(entries, seq, payload, prev, start)
    ranges = -(-n // most)
    held = materialise(entries.repartitionByRange(ranges, seq).withColumn("_range", F.spark_partition_id()), "entries")
    out = None
    for i in range(ranges):
        part = materialise(_chained(held.where(F.col("_range") == i).drop("_range"), seq, payload, prev, start), "chained")
        last = part.agg(F.max_by(F.struct("ledger_id", "hash"), "ledger_id")).first()[0]
        if last is not None:
            prev, start = last["hash"], last["ledger_id"] + 1
        out = part if out is None else out.unionByName(part)
    return out


def _chained(entries: DataFrame, seq: str, payload: str, prev: str, start: int) -> DataFrame:
    columns = entries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = prev, start
        for batch in batches:
            before, after = [], []
            for p in batch.column(columns.index(payload)):
                before.append(last)
                last = hashlib.sha256(f"{last}|{p.as_py()}".encode()).hexdigest()
                after.append(last)
            ids = pa.array(range(n, n + batch.num_rows), pa.int64())
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(before), pa.array(after)], [*columns, "ledger_id", "prev_hash", "hash"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return entries.repartition(1).sortWithinPartitions(seq).mapInArrow(run, f"{fields}, ledger_id bigint, prev_hash string, hash string")


def errors(ledger: DataFrame, payload: str = "payload") -> DataFrame:
    """(ledger_id, error, expected, found): entries whose own hash, or whose link to the entry before, doesn't hold; prefixes of 16."""
    rows = ledger.select("ledger_id", "prev_hash", "hash", F.sha2(F.concat_ws("|", "prev_hash", payload), 256).alias("own"), F.expr(f"ledger_id div {STRIDE}").alias("block"))
    ends = rows.groupBy("block").agg(F.max_by("hash", "ledger_id").alias("last"))
    before = ends.select("block", F.lag("last", 1, GENESIS).over(W.orderBy("block")).alias("carried"))  # a row for each STRIDE ids
    rows = rows.withColumn("near", F.lag("hash").over(W.partitionBy("block").orderBy("ledger_id"))).join(before, "block")
    linked = F.coalesce("near", "carried")
    short = lambda c: F.substring(c, 1, 16)
    found = F.array_compact(
        F.array(
            F.when(F.col("prev_hash") != linked, F.struct(F.lit("prev_hash mismatch").alias("error"), short(linked).alias("expected"), short("prev_hash").alias("found"))),
            F.when(F.col("hash") != F.col("own"), F.struct(F.lit("hash mismatch").alias("error"), short("own").alias("expected"), short("hash").alias("found"))),
        )
    )
    return rows.select("ledger_id", F.explode(found).alias("e")).select("ledger_id", "e.*")


def verify(ledger: DataFrame, payload: str = "payload") -> DataFrame:
    """One row: entries, errors, verified. An empty ledger is verified."""
    n = ledger.agg(F.count("*").alias("total_entries"))
    bad = errors(ledger, payload).agg(F.count("*").alias("n_errors"))
    return n.join(bad).withColumn("verified", F.col("n_errors") == 0)


def browse(ledger: DataFrame, aggregate_type: str | None = None, aggregate_id: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    rows = ledger.where(F.col("aggregate_type") == aggregate_type) if aggregate_type else ledger
    rows = rows.where(F.col("aggregate_id") == aggregate_id) if aggregate_id else rows
    page = rows.orderBy(F.desc("ledger_id")).offset(offset).limit(limit)
    return page.withColumns({"prev_hash": F.substring("prev_hash", 1, 16), "hash": F.substring("hash", 1, 16)})


def recent(ledger: DataFrame, limit: int = 20) -> DataFrame:
    return ledger.orderBy(F.desc("created_at"), F.desc("ledger_id")).limit(limit).withColumn("hash", F.substring("hash", 1, 12))


def recompute(ledger: DataFrame, merges: DataFrame) -> DataFrame:
    """State replayed from the ledger alone, beside the live number of merges."""
    of = lambda kind: F.col("event_type") == kind
    gone = ledger.where(of("MERGE_REVERSED")).select(F.get_json_object("payload", "$.merge_id").alias("aggregate_id"))
    net = ledger.where(of("UBID_MERGED")).select("aggregate_id").distinct().join(gone, "aggregate_id", "left_anti").agg(F.count("*").alias("net_merges"))
    one = ledger.agg(
        F.count("*").alias("ledger_entries_replayed"),
        F.count_distinct(F.when(of("UBID_CREATED"), F.col("aggregate_id"))).alias("ubids_created"),
        F.count_distinct(F.when(of("STATUS_CHANGED"), F.col("aggregate_id"))).alias("status_changes"),
        F.count_if(of("REVIEW_DECIDED")).alias("reviews"),
    )
    live = merges.agg(F.count_if(~F.col("reversed")).alias("live_net_merges"))
    return one.join(net).join(live).withColumn("verified", F.col("net_merges") == F.col("live_net_merges"))


def latest_status(ledger: DataFrame) -> DataFrame:
    """The last status of each identity that the ledger tells."""
    rows = ledger.where("event_type = 'STATUS_CHANGED'")
    return rows.groupBy("aggregate_id").agg(F.max_by(F.get_json_object("payload", "$.new_status"), "ledger_id").alias("status"))
