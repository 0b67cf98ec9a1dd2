"""Adapters of the departments' registries: read only, found by name."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.schemas import SCHEMAS
from tessera.sources.synthetic import SyntheticRegistry

ADAPTERS: dict[str, type] = {}
# Names that a read-only adapter's methods must not begin with.
WRITING = re.compile("^(write|put|post|delete|update|insert|create_in|push_to|send|upload|modify|mutate|save_to)")


def register_adapter(name: str) -> Callable[[type], type]:
    def put_in(cls: type) -> type:
        ADAPTERS[name] = cls
        return cls

    return put_in


def get_adapter(name: str) -> type:
    if name not in ADAPTERS:
        raise KeyError(f"no adapter {name}; there are {sorted(ADAPTERS)}")
    return ADAPTERS[name]


def list_adapters() -> list[str]:
    return sorted(ADAPTERS)


def read_only_report() -> dict:
    """Methods of the adapters that their names say write."""
    found = [f"{n}.{m}" for n, cls in sorted(ADAPTERS.items()) for m in dir(cls) if WRITING.match(m)]
    return {"verified": not found, "adapters_checked": len(ADAPTERS) + 1, "violations": found}


class Adapter:
    """pull() gives the records of one source system as a DataFrame; health() says how it stands."""

    source_system = ""

    def __init__(self, spark: SparkSession, **options: str) -> None:
        self.spark, self.options = spark, options

    def pull(self) -> DataFrame:
        raise NotImplementedError

    def health(self) -> dict:
        return {"source_system": self.source_system, "status": "HEALTHY"}


@register_adapter("parquet")
class ParquetAdapter(Adapter):
    def pull(self) -> DataFrame:
        df = self.spark.read.schema(SCHEMAS["business_records"]).parquet(self.options["path"])
        return df.where(F.col("source_system") == self.options["source_system"]) if "source_system" in self.options else df


@register_adapter("api")
class ApiAdapter(Adapter):
    """A stub: no rows."""

    def pull(self) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS["business_records"])


@register_adapter("webhook")
class WebhookAdapter(Adapter):
    """Bodies that were dropped as JSON lines (body, signature) in a folder; only those whose signature holds are parsed."""

    def pull(self) -> DataFrame:
        drops = self.spark.read.schema("body string, signature string").json(self.options["path"])
        return parsed(accepted(drops, self.options["secret"])[0])


def signature_holds(body: Column, signature: Column, secret: str) -> Column:
    """HMAC-SHA256 of the raw body, compared in constant time. The secret comes from configuration, and is never kept in a table."""
    key = secret.encode()

    @F.pandas_udf("boolean")
    def check(bodies: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([b is not None and s is not None and hmac.compare_digest(hmac.new(key, b.encode(), hashlib.sha256).hexdigest(), s) for b, s in zip(bodies, given, strict=True)])

    return check(body, signature)


def accepted(drops: DataFrame, secret: str) -> tuple[DataFrame, DataFrame]:
    """Drops whose signature holds, and the others."""
    judged = drops.withColumn("ok", signature_holds(F.col("body"), F.col("signature"), secret))
    return judged.where("ok").drop("ok"), judged.where("NOT ok").drop("ok")


def parsed(drops: DataFrame) -> DataFrame:
    return drops.select(F.from_json("body", SCHEMAS["business_records"]).alias("r")).select("r.*")


@register_adapter("synthetic")
class SyntheticAdapter(Adapter):
    """Options: businesses, seed, slices, today. pull() gives the records; events(), labels() and health() what belongs to them."""

    def _table(self, name: str) -> DataFrame:
        self.spark.dataSource.register(SyntheticRegistry)
        return self.spark.read.format("synthetic_registry").options(**self.options, table=name).load()

    def pull(self) -> DataFrame:
        return self._table("records")

    def events(self) -> DataFrame:
        return self._table("events").withColumn("event_date", F.to_date("event_date"))

    def labels(self) -> DataFrame:
        """All pairs of records of one business."""
        return self._table("labels")

    def health(self, now: datetime) -> DataFrame:
        """A row for each department: records, and how many seconds ago it was last read."""
        per = self.pull().groupBy("source_system").agg(F.count("*").alias("total_records"))
        age = 10 + F.pmod(F.crc32(F.col("source_system").cast("binary")), F.lit(2900)) / 10.0
        return per.select("source_system", F.lit(now).alias("last_successful_pull_at"), F.col("total_records").alias("last_record_count"), "total_records", F.lit("HEALTHY").alias("status"), age.alias("freshness_seconds"))
