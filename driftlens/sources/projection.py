"""The driver's tables read as records of boundaries: who provides, who consumes, what each declares, reads and writes.

Every projection is a narrow map of one table, so that column pruning and filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_key(nation: Column) -> Column:
    return F.concat(F.lit("GET /nations/"), nation.cast("string"), F.lit("/{id}"))


def providers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers; the boundary is their nation's. Every eighth has none."""
    return scan(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 8 != 0, nation_key(F.col("s_nationkey"))).alias("boundary_key"), F.col("s_suppkey").alias("provider"))


def consumers(spark: SparkSession, d: str) -> DataFrame:
    """Customers of the nations; those of the segment BUILDING have a default branch."""
    return scan(spark, d, "customer").select(nation_key(F.col("c_nationkey")).alias("boundary_key"), F.col("c_custkey").alias("consumer"), (F.col("c_mktsegment") == "BUILDING").alias("has_default"))


def provider_statuses(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's line items: N 200, A 404, R 409; seventh lines with R are unclear."""
    flag = F.col("l_returnflag")
    opaque = (F.col("l_linenumber") == 7) & (flag == "R")
    status = F.when(opaque, None).when(flag == "N", 200).when(flag == "A", 404).otherwise(409)
    return scan(spark, d, "lineitem").select(F.col("l_suppkey").alias("provider"), status.cast("int").alias("status"), opaque.alias("opaque")).distinct()


def consumer_statuses(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders: O 200, F 404, P 500."""
    s = F.col("o_orderstatus")
    return scan(spark, d, "orders").select(F.col("o_custkey").alias("consumer"), F.when(s == "O", 200).when(s == "F", 404).otherwise(500).cast("int").alias("status")).distinct()


def declared_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Nations declare 200 and, by their region, 404 or 409 or 500."""
    n = scan(spark, d, "nation").select(nation_key(F.col("n_nationkey")).alias("boundary_key"), F.col("n_regionkey").alias("r"))
    return n.select("boundary_key", F.lit(200).alias("status")).unionByName(n.select("boundary_key", F.when(F.col("r") == 0, 404).when(F.col("r") == 1, 409).otherwise(500).alias("status")))


def accesses(spark: SparkSession, d: str) -> DataFrame:
    """Events: the table is the type, the field comes from props.k, every 500th but clicks touches all columns; even ids read."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    field = F.when((F.col("event_id") % 500 == 499) & (F.col("event_type") != "click"), "*").otherwise(F.concat(F.lit("f"), F.coalesce(k, F.lit(0)) % 20))
    return scan(spark, d, "events").select(F.col("event_type").alias("tbl"), field.alias("field"), F.when((F.col("event_id") % 2 == 0) & (k % 3 != 0), "read").otherwise("write").alias("mode"))


def declared_columns(spark: SparkSession, d: str) -> DataFrame:
    """f0 to f24 of each type but 'error'."""
    types = scan(spark, d, "events").select(F.col("event_type").alias("tbl")).where("tbl != 'error'").distinct()
    return types.select("tbl", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i")).select("tbl", F.concat(F.lit("f"), "i").alias("field"))
