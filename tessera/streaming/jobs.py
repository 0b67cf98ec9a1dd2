"""Streaming jobs: ingest from folders, routing by decision, windows of status signals, staleness of heartbeats.

A topic is a folder of files, or a Kafka topic where servers are given and Spark has that connector (it isn't here, so that
path is untested). In append and update mode all state is keyed and bounded by a watermark; all sinks are idempotent by batch
id, so a query that restarts from its checkpoint writes nothing twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import scoring
from tessera.operators.activity import SIGNALS, lookup
from tessera.operators.evaluation import Registry
from tessera.plans.shared import get_text, materialise, names_in, put_text

# Topics with partitions and days of retention, and the topic of each decision.
TOPICS = {
    "business.records.raw": (6, 7),
    "business.records.canonical": (6, 30),
    "business.records.dead-letter": (3, 14),
    "resolution.candidates": (6, 7),
    "resolution.auto-link": (3, 7),
    "resolution.review-queue": (3, 30),
    "resolution.hold-separate": (3, 7),
    "resolution.anchor-conflict": (1, 30),
    "resolution.review-confirmed": (3, 30),
    "resolution.review-rejected": (3, 30),
    "ubid.events": (6, 90),
    "activity.status-changes": (6, 90),
    "system.alerts": (1, 30),
}
ROUTES = {"AUTO_LINK": "resolution.auto-link", "REVIEW": "resolution.review-queue", "HOLD": "resolution.hold-separate"}
STALE_AFTER = 60


def read_topic(spark: SparkSession, root: str, topic: str, schema: str, fmt: str = "json", servers: str | None = None) -> DataFrame:
    """A topic as a stream, from its first message on; with Kafka servers, the values of its messages read as JSON."""
    if topic not in TOPICS:
        raise KeyError(topic)
    if servers:
        rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
        return rows.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")
    return spark.readStream.schema(schema).format(fmt).load(f"{root}/{topic}")


MESSAGE = "partition int, offset bigint, key string, value string"


def topic_settings(topic: str) -> dict[str, int]:
    """What a topic is created with."""
    partitions, days = TOPICS[topic]
    return {"partitions": partitions, "retention.ms": days * 86_400_000}


def messages(spark: SparkSession, root: str, topic: str) -> DataFrame:
    """The log of a topic: partition, offset within it, key, value. Reading from an offset on is a filter."""
    log = f"{root}/log/{topic}"
    return spark.read.schema(MESSAGE).parquet(log) if names_in(spark, log) else spark.createDataFrame([], MESSAGE)


def publish(rows: DataFrame, root: str, topic: str) -> None:
    """Append messages (key, value) to a topic's log. A key always goes to one partition; within it offsets go on without a gap. One writer at a time."""
    spark, parts = rows.sparkSession, topic_settings(topic)["partitions"]
    part = F.pmod(F.crc32(F.coalesce("key", F.lit("")).cast("binary")), F.lit(parts)).cast("int")
    held = materialise(rows.select(part.alias("partition"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")), "messages")
    # a running number in blocks: the window sees one block of one partition, never a whole one
    block = F.pmod(F.xxhash64("key", "value"), F.lit(1024)).cast("int")
    ranked = held.withColumn("block", block)
    sizes = ranked.groupBy("partition", "block").count()
    before = sizes.select("partition", "block", F.coalesce(F.sum("count").over(W.partitionBy("partition").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    base = messages(spark, root, topic).groupBy("partition").agg((F.max("offset") + 1).alias("base"))
    numbered = ranked.withColumn("no", F.row_number().over(W.partitionBy("partition", "block").orderBy("key", "value")) - 1)
    out = numbered.join(F.broadcast(before), ["partition", "block"]).join(F.broadcast(base), "partition", "left")
    out.select("partition", (F.coalesce("base", F.lit(0)) + F.col("before") + F.col("no")).cast("bigint").alias("offset"), "key", "value").write.mode("append").parquet(f"{root}/log/{topic}")


class Consumer:
    """What one group has read of a topic: an offset for each partition, kept beside the log.

    poll() gives the next messages, commit() says that they are dealt with; a consumer that starts anew goes on from the last
    commit, so messages polled but not committed come again. follow() does both as a stream.
    """

    def __init__(self, spark: SparkSession, root: str, topic: str, group: str) -> None:
        if topic not in TOPICS:
            raise KeyError(topic)
        self.spark, self.root, self.topic = spark, root, topic
        self.home = f"{root}/groups/{group}/{topic}"
        self.ahead: dict[int, int] = {}

    def position(self) -> dict[int, int]:
        """The next offset of each partition, one number for each; 0 where nothing was committed."""
        at = dict.fromkeys(range(TOPICS[self.topic][0]), 0)
        if text := get_text(self.spark, f"{self.home}/offsets.json"):
            at |= {int(k): v for k, v in json.loads(text).items()}
        return at

    def poll(self, most: int = 1000) -> DataFrame:
        """The next messages, `most` of each partition at most, after those that were polled last. The offsets asked for reach the scan of the log as filters."""
        at = self.position() | self.ahead
        there = F.lit(False)
        for p, n in at.items():
            there = there | ((F.col("partition") == p) & (F.col("offset") >= n) & (F.col("offset") < n + most))
        got = materialise(messages(self.spark, self.root, self.topic).where(there), "polled")
        self.ahead = at | {r["partition"]: r["n"] + 1 for r in got.groupBy("partition").agg(F.max("offset").alias("n")).collect()}  # a row for each partition
        return got

    def commit(self) -> None:
        """All that was polled is dealt with."""
        put_text(self.spark, f"{self.home}/offsets.json", json.dumps(self.position() | self.ahead))

    def seek(self, offsets: dict[int, int]) -> None:
        """Go on from these offsets, forwards or back; other partitions stay where they are."""
        self.ahead = {}
        put_text(self.spark, f"{self.home}/offsets.json", json.dumps(self.position() | offsets))

    def lag(self) -> DataFrame:
        """(partition, lag): messages after the last commit."""
        ends = messages(self.spark, self.root, self.topic).groupBy("partition").agg((F.max("offset") + 1).alias("end"))
        at = self.spark.createDataFrame(list(self.position().items()), "partition int, at bigint")
        return at.join(ends, "partition", "left").select("partition", (F.coalesce("end", "at") - F.col("at")).alias("lag"))

    def follow(self, each: Callable[[DataFrame, int], None], files: int | None = None) -> None:
        """Hand all that isn't read yet to `each` with the number of its batch, as a stream that ends when all is read; at most so many files of the log a batch. A batch that failed comes again under its number and with the same messages, so a sink that overwrites by number has each message once."""
        start = self.position()
        rows = self.spark.readStream.schema(MESSAGE)
        rows = rows.option("maxFilesPerTrigger", files) if files else rows
        past = F.lit(True)
        for p, n in start.items():
            past = past & ~((F.col("partition") == p) & (F.col("offset") < n))

        def deal(batch: DataFrame, no: int) -> None:
            held = batch.persist()
            each(held, no)
            self.ahead |= {r["partition"]: r["n"] + 1 for r in held.groupBy("partition").agg(F.max("offset").alias("n")).collect()}
            self.commit()
            held.unpersist()

        stream = rows.parquet(f"{self.root}/log/{self.topic}").where(past)
        stream.writeStream.foreachBatch(deal).option("checkpointLocation", f"{self.home}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def topic_statistics(spark: SparkSession, root: str) -> DataFrame:
    """(topic, partition, messages, next_offset) of all topics that have any."""
    out = spark.createDataFrame([], "topic string, partition int, messages bigint, next_offset bigint")
    for topic in names_in(spark, f"{root}/log"):
        per = messages(spark, root, topic).groupBy("partition").agg(F.count("*").alias("messages"), (F.max("offset") + 1).alias("next_offset"))
        out = out.unionByName(per.select(F.lit(topic).alias("topic"), "*"))
    return out


def emit(df: DataFrame, root: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a topic, until what is there now is done."""
    return df.writeStream.format("json").option("path", f"{root}/{topic}").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def route_decisions(scored: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Scored pairs to the topic of their decision; unknown decisions are held. A repeated batch overwrites its own files."""

    def write(batch: DataFrame, n: int) -> None:
        topic = lookup(ROUTES, F.col("decision"), ROUTES["HOLD"])
        routed = batch.withColumn("topic", topic).persist()
        for t in ROUTES.values():
            routed.where(F.col("topic") == t).drop("topic").write.mode("overwrite").json(f"{root}/{t}/batch={n}")
        routed.unpersist()

    return scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_stream(features: DataFrame, models: Registry, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Score pairs (with the columns of FEATURES) by the model that the registry's pointer names when a batch begins: a promotion or a rollback counts from the next batch on, without a restart. Hands (..., score, decision, model_version) and the number of the batch to `each`."""

    def run(batch: DataFrame, no: int) -> None:
        version = models.active()
        model = models.load(version)
        scored = model(batch) if model else batch.withColumn("score", scoring.linear_score(*map(F.col, scoring.FEATURES)))
        each(scored.withColumns({"decision": scoring.route(F.col("score"), F.col("anchor_score")), "model_version": F.lit(version)}), no)

    return features.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, key: list[str], ts: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, ts: str, key: str, value: str, width: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums by key in tumbling (or, with `slide`, sliding) windows; events later than the watermark are dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    rows = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def signal_totals(events: DataFrame, late: str = "548 days") -> DataFrame:
    """Base weights of signals by identity and day, from which decayed scores of any reference date follow; events may be as late as the lookback is long."""
    weight = lookup(SIGNALS, F.col("signal_class"), 0.0)
    rows = events.withWatermark("event_time", late).groupBy(F.window("event_time", "1 day"), "ubid").agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))
    return rows.select(F.to_date("window.start").alias("day"), "ubid", "weight", "n")


def heartbeats(beats: DataFrame, now, stale_after: int = STALE_AFTER) -> DataFrame:
    """Last beat of each source, and whether it is stale at `now`."""
    last = beats.groupBy("source_system").agg(F.max("beat_at").alias("last_beat"))
    age = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("last_beat")
    return last.select("source_system", "last_beat", age.alias("age_seconds"), F.when(age > stale_after, "STALE").otherwise("ALIVE").alias("state"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is there now into Parquet, and read the result. In `complete` mode the last batch is the result."""
    spark = stream.sparkSession
    if mode == "append" and each is None:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    else:
        put = lambda b, n: (each(b) if each else b).write.mode("overwrite").parquet(path)
        stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def stale_sources(beats: DataFrame, minutes: int = 1, late: str = "1 minute") -> DataFrame:
    """Heartbeats (source_system, beat_at) as a stream to (source_system, last_beat, state): ALIVE at each beat, and STALE once event time has passed the last beat by `minutes`. One timestamp of state a source."""
    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"source_system": [key[0]], "last_beat": [pd.Timestamp(last, unit="us")], "state": ["STALE"]})
            return
        last = state.get[0] if state.exists else 0
        for pdf in rows:
            last = max(last, int(pdf["beat_at"].max().value // 1000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"source_system": [key[0]], "last_beat": [pd.Timestamp(last, unit="us")], "state": ["ALIVE"]})

    keyed = beats.withWatermark("beat_at", late).groupBy("source_system")
    return keyed.applyInPandasWithState(step, "source_system string, last_beat timestamp, state string", "last bigint", "update", GroupStateTimeout.EventTimeTimeout)
