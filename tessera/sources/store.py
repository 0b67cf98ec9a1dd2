"""Tables as versioned snapshots: a write makes a new version, a read takes the newest finished one."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.schemas import SCHEMAS

#: Appended parts of a table that a read may have to list.
MAX_PARTS = 50


class Store:
    """A folder of tables, reached through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = jvm.org.apache.hadoop.fs.Path
        return sorted(f.getPath().getName() for f in fs.listStatus(path) if fs.exists(done(f.getPath(), "_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        """The newest version, all appended parts with it; an empty table if there's none."""
        found = self._versions(name)
        if not found:
            return self.spark.createDataFrame([], SCHEMAS[name])
        base = [v for v in found if v.endswith("-full")]
        use = found[found.index(base[-1]) :] if base else found
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{name}/{v}" for v in use])

    def _write(self, name: str, df: DataFrame, kind: str, by: list[str] | None = None) -> None:
        # named by the time of writing, so two writers never take one name, and the later one is the newer version
        df.write.parquet(f"{self.root}/{name}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}-{kind}", partitionBy=by)

    def overwrite(self, name: str, df: DataFrame, by: list[str] | None = None, sort: list[str] | None = None) -> None:
        """Readers of the old version keep it, so a table may be made from itself. With `by` it is kept in partitions of these columns, one file each, in the order of `sort`."""
        if by:
            df = df.repartition(*by).sortWithinPartitions(*by, *(sort or []))
        self._write(name, df, "full", by)

    def append(self, name: str, df: DataFrame) -> None:
        """One more part; when there are MAX_PARTS of them they become one version."""
        self._write(name, df, "part")
        found = self._versions(name)
        if len(found) - max([i for i, v in enumerate(found) if v.endswith("-full")], default=0) > MAX_PARTS:
            self.overwrite(name, self.read(name))

    def newest(self, name: str) -> DataFrame:
        """Only what was written last: the last part, or the last full version."""
        found = self._versions(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{found[-1]}") if found else self.read(name)

    def upsert(self, name: str, df: DataFrame, key: str) -> None:
        """Rows of df replace those of their key."""
        old = self.read(name)
        self.overwrite(name, old.join(df.select(key), key, "left_anti").unionByName(df, allowMissingColumns=True))


def first_by(df: DataFrame, key: str, priority: str) -> DataFrame:
    """One row a key: that of the highest priority."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, priority).alias("r")).select("r.*")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nulls are empty."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def paged(df: DataFrame, order: list, offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """A page, and the number of all rows as a one-row table."""
    return df.orderBy(*order).offset(offset).limit(limit), df.agg(F.count("*").alias("total"))


def newest(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each key, oldest first."""
    ranked = df.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("rn") <= n)
    return ranked.drop("rn").orderBy(key, order)
