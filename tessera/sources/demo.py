"""The registry's tables as views of the generic test tables, for Spark and (VIEWS) for DuckDB."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REF = date(2001, 8, 1)
PRIORITIES = {
    "1-URGENT": ("STRONG_ACTIVE", "TAX_PAYMENT", "SHOP_EST"),
    "2-HIGH": ("WEAK_ACTIVE", "INSPECTION", "FACTORIES"),
    "3-MEDIUM": ("NEUTRAL", "COMPLIANCE_NOTICE", "LABOUR"),
    "4-NOT SPECIFIED": ("DORMANCY", "ELECTRICITY_DISCONNECT", "KSPCB"),
    "5-LOW": ("CLOSURE", "CLOSURE_CERT", "GST"),
}
ENDINGS = [" Pvt Ltd", " Private Limited", " LLP", " & Co.", " Industries", ""]


class Demo:
    """Each method is one table, read from the Parquet files of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _by_priority(self, i: int):
        out = None
        for p, values in PRIORITIES.items():
            out = F.when(F.col("o_orderpriority") == p, values[i]) if out is None else out.when(F.col("o_orderpriority") == p, values[i])
        return out

    def events(self) -> DataFrame:
        day = F.to_date("o_orderdate").alias("event_date")
        return self.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("ubid"), day, self._by_priority(0).alias("signal_class"), self._by_priority(1).alias("event_type"), self._by_priority(2).alias("source_system"))

    def masters(self) -> DataFrame:
        nation = F.broadcast(self.table("nation").select("n_nationkey", "n_name"))  # 25 rows by definition
        c = self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        state = F.when(F.col("c_acctbal") < -900, "DEPRECATED").otherwise("ACTIVE")
        return c.select(F.col("c_custkey").alias("ubid"), F.lit("INTERNAL").alias("anchor_type"), F.lit(None).cast("string").alias("anchor_value"), F.col("c_name").alias("primary_name"), (F.lit(560000) + F.col("c_nationkey")).cast("string").alias("primary_pincode"), F.col("n_name").alias("primary_district"), state.alias("status"))

    def source_records(self) -> DataFrame:
        o = self.table("orders").groupBy(F.col("o_custkey").alias("ubid"), self._by_priority(2).alias("source_system"))
        return o.agg(F.min("o_orderkey").alias("record_id"))

    def records(self) -> DataFrame:
        p = self.table("part").withColumn("gt_id", F.concat_ws("|", "p_brand", "p_name")).withColumn("h", F.md5("gt_id"))
        letters = lambda a, n: F.translate(F.substring("h", a, n), "0123456789abcdef", "ABCDEFGHIJKLMNOP")
        pan = F.concat(letters(1, 5), F.translate(F.substring("h", 6, 4), "abcdef", "012345"), letters(10, 1))
        size = F.col("p_size") % 5
        types = F.pmod(F.length("p_type"), F.lit(6))
        ending = F.get(F.array(*map(F.lit, ENDINGS)), types)
        return p.select(
            F.format_string("R%09d", "p_partkey").alias("id"), F.get(F.array(*[F.lit(v[2]) for v in PRIORITIES.values()]), F.pmod("p_partkey", F.lit(5)).cast("int")).alias("source_system"), F.col("p_partkey").cast("string").alias("source_record_id"),
            F.concat("p_name", ending).alias("business_name"), F.when(types < 3, "KIADB Peenya").otherwise("whitefield").alias("address_locality"), F.lit("Bengaluru").alias("address_city"), F.col("p_brand").alias("address_district"),
            F.concat(F.lit("5600"), F.right("p_brand", F.lit(2))).alias("address_pincode"), F.when(size <= 2, pan).alias("pan"), F.when(size.isin(2, 3), F.concat(F.lit("29"), pan, F.lit("1Z5"))).alias("gstin"),
            F.when(size == 1, F.concat(F.lit("+91 98"), F.lpad(F.pmod("p_partkey", F.lit(40)).cast("string"), 8, "0"))).alias("phone"), F.when(size >= 3, F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("."))), F.when(size == 3, "@gmail.com").otherwise("@firm.in"))).alias("email"),
            F.expr("date_add(date '2010-01-01', p_size * 20)").alias("registration_date"), "gt_id",
        )

    def reviews(self, scored: DataFrame) -> DataFrame:
        """Scored pairs with review columns: what a rule by pair id has decided so far."""
        first = F.substring("pair_id", 1, 1)
        status = F.when(F.col("decision") != "REVIEW", "PENDING").when(first.isin("0", "1"), "CONFIRM").when(first == "2", "REJECT").when(first == "3", "ESCALATE").otherwise("PENDING")
        rows = scored.withColumn("review_status", status)
        return rows.withColumns({"reviewer_id": F.when(status != "PENDING", F.concat(F.lit("rev"), F.substring("pair_id", 2, 1))), "reviewer_notes": F.lit(None).cast("string"), "reviewed_at": F.when(status != "PENDING", F.expr("timestamp_seconds(1000000000 + pmod(crc32(cast(pair_id AS binary)), 1000000))")), "created_at": F.expr("timestamp_seconds(1000000000)")})


_case = lambda i: "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN '{v[i]}'" for p, v in PRIORITIES.items()) + " END"
_SYSTEMS = ", ".join(f"'{v[2]}'" for v in PRIORITIES.values())
_ENDINGS = ", ".join(f"'{e}'" for e in ENDINGS)
_PAN = "translate(substr(h, 1, 5), '0123456789abcdef', 'ABCDEFGHIJKLMNOP') || translate(substr(h, 6, 4), 'abcdef', '012345') || translate(substr(h, 10, 1), '0123456789abcdef', 'ABCDEFGHIJKLMNOP')"
#: The same in DuckDB's SQL, as common table expressions.
VIEWS = {
    "ev": f"ev AS (SELECT o_orderkey AS id, o_custkey AS ubid, CAST(o_orderdate AS DATE) AS event_date, {_case(0)} AS signal_class, {_case(1)} AS event_type, {_case(2)} AS source_system FROM orders)",
    "ma": "ma AS (SELECT c_custkey AS ubid, c_name AS primary_name, CAST(560000 + c_nationkey AS VARCHAR) AS primary_pincode, n_name AS primary_district, CASE WHEN c_acctbal < -900 THEN 'DEPRECATED' ELSE 'ACTIVE' END AS status FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    "sr": f"sr AS (SELECT o_custkey AS ubid, {_case(2)} AS source_system, min(o_orderkey) AS record_id FROM orders GROUP BY ALL)",
    "re": f"""re0 AS (SELECT *, p_brand || '|' || p_name AS gt_id, md5(p_brand || '|' || p_name) AS h, p_size % 5 AS s, length(p_type) % 6 AS t FROM part),
      re AS (SELECT 'R' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, [{_SYSTEMS}][1 + CAST(p_partkey % 5 AS INT)] AS source_system, CAST(p_partkey AS VARCHAR) AS source_record_id, p_name || [{_ENDINGS}][1 + t] AS business_name,
        CASE WHEN t < 3 THEN 'KIADB Peenya' ELSE 'whitefield' END AS address_locality, 'Bengaluru' AS address_city, p_brand AS address_district, '5600' || right(p_brand, 2) AS address_pincode,
        CASE WHEN s <= 2 THEN {_PAN} END AS pan, CASE WHEN s IN (2, 3) THEN '29' || {_PAN} || '1Z5' END AS gstin,
        CASE WHEN s = 1 THEN '+91 98' || lpad(CAST(p_partkey % 40 AS VARCHAR), 8, '0') END AS phone, CASE WHEN s >= 3 THEN lower(replace(p_name, ' ', '.')) || CASE WHEN s = 3 THEN '@gmail.com' ELSE '@firm.in' END END AS email,
        DATE '2010-01-01' + CAST(p_size * 20 AS INT) AS registration_date, gt_id FROM re0)""",
}
