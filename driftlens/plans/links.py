"""Queries that resolve names and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolution
from ..sources import projection as p
from ..sources.projection import scan


def pack_applicability(spark, d):
    files = scan(spark, d, "documents").select(F.col("doc_id").alias("file"), F.concat("source", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/"), "lang")).otherwise(F.when(F.col("doc_id") % 3 == 1, "x").otherwise(""))).alias("module"))
    gates = spark.createDataFrame([("one", "src1"), ("german", "src2/de"), ("two", "src2"), ("none", "sr")], "pack string, gate string")
    return resolution.pack_gates(files, gates)


def follow_links(spark, d):
    calls = scan(spark, d, "orders").select(F.col("o_orderkey").alias("call"), F.concat(F.when(F.col("o_custkey") % 2 == 0, "svc.").otherwise(""), F.lit("f"), F.col("o_custkey") % 60).alias("callee"))
    units = scan(spark, d, "supplier").select(F.concat(F.when(F.col("s_suppkey") % 4 == 0, "svc.").otherwise(""), F.lit("f"), F.col("s_suppkey") % 50).alias("name"), F.col("s_suppkey").alias("unit"), F.col("s_suppkey").alias("ord"))
    return resolution.follow_targets(calls, units)


def rethrow_enrichment(spark, d):
    n = F.col("l_suppkey")
    throws = scan(spark, d, "lineitem").select(n.alias("unit"), (F.col("l_partkey") * 7).alias("start"), (F.col("l_partkey") * 7 + 5).alias("end"), F.concat(F.lit("m"), n % 5, F.lit(".ts")).alias("file"))
    callees = scan(spark, d, "part").select((F.col("p_partkey") * 7).alias("start"), (F.col("p_partkey") * 7 + 5).alias("end"), F.concat(F.lit("/app/m"), F.col("p_size") % 5, F.lit(".ts")).alias("path"), F.col("p_brand").alias("exception"))
    return resolution.rethrows(throws, callees)


def spawned_sub_units(spark, d):
    e = scan(spark, d, "events").select(F.col("user_id").alias("parent"), F.col("event_type").alias("via"), "event_id")
    return resolution.positional(e.where("event_id % 2 = 0").select("parent", "via", F.col("event_id").alias("pos")), e.where("event_id % 2 = 1").select("parent", "via", F.col("event_id").alias("ord"), F.col("event_id").alias("sub_unit")))


def phase_times(spark, d):
    return resolution.phases(scan(spark, d, "lineitem").select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("label"), F.col("l_linenumber").alias("ms")))


def consumer_contract(spark, d):
    reads = p.consumers(spark, d).select("boundary_key", "consumer", F.when(F.col("consumer") % 4 != 0, 200 + (F.col("consumer") % 3) * 2).cast("int").alias("status"), F.concat(F.lit("b"), F.col("consumer") % 7).alias("field"))
    n = scan(spark, d, "supplier")
    declared = n.select(p.nation_key(F.col("s_nationkey")).alias("boundary_key"), (200 + F.col("s_suppkey") % 5).cast("int").alias("status"), F.col("s_suppkey").alias("ord"), F.when(F.col("s_suppkey") % 9 != 0, F.transform(F.sequence(F.lit(0), F.col("s_suppkey") % 6), lambda i: F.concat(F.lit("b"), i))).alias("fields"))
    return resolution.declared_reads(reads, declared)


def unit_labels(spark, d):
    units = scan(spark, d, "part").select(F.col("p_partkey").alias("unit"), F.when(F.col("p_partkey") % 10 == 0, "loader").otherwise(F.concat(F.lit("u"), F.col("p_partkey") % 900)).alias("name"), F.concat(F.lit("src/"), F.col("p_brand"), F.lit(".test.ts")).alias("file"))
    return resolution.unit_label(units, ("loader", "action"))


QUERIES = {f.__name__: f for f in (pack_applicability, follow_links, rethrow_enrichment, spawned_sub_units, phase_times, consumer_contract, unit_labels)}

ORACLE = {
    "pack_applicability": """
WITH f AS (SELECT doc_id AS file, source || CASE doc_id % 3 WHEN 0 THEN '/' || lang WHEN 1 THEN 'x' ELSE '' END AS module FROM documents), g(pack, gate) AS (VALUES ('one', 'src1'), ('german', 'src2/de'), ('two', 'src2'), ('none', 'sr'))
SELECT DISTINCT file, pack FROM f JOIN g ON module = gate OR starts_with(module, gate || '/')""",
    "follow_links": """
WITH c AS (SELECT o_orderkey AS call, CASE WHEN o_custkey % 2 = 0 THEN 'svc.' ELSE '' END || 'f' || CAST(o_custkey % 60 AS VARCHAR) AS callee FROM orders),
u AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'svc.' ELSE '' END || 'f' || CAST(s_suppkey % 50 AS VARCHAR) AS name, min(s_suppkey) AS unit FROM supplier GROUP BY 1)
SELECT call, callee, coalesce(a.unit, b.unit) AS unit FROM c LEFT JOIN u a ON a.name = callee LEFT JOIN u b ON b.name = replace(callee, 'svc.', '')""",
    "rethrow_enrichment": """
SELECT DISTINCT l_suppkey AS unit, p_brand AS exception FROM lineitem JOIN part ON l_partkey = p_partkey AND p_size % 5 = l_suppkey % 5""",
    "spawned_sub_units": """
WITH a AS (SELECT user_id AS parent, event_type AS via, event_id AS pos, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_id % 2 = 0),
b AS (SELECT user_id AS parent, event_type AS via, event_id AS sub_unit, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_id % 2 = 1)
SELECT parent, via, pos, sub_unit FROM a JOIN b USING (parent, via, k)""",
    "phase_times": "SELECT l_returnflag || '-' || l_linestatus AS label, CAST(sum(l_linenumber) AS BIGINT) AS total_ms, count(*) AS n FROM lineitem GROUP BY 1",
    "consumer_contract": """
WITH r AS (SELECT 'GET /nations/' || CAST(c_nationkey AS VARCHAR) || '/{id}' AS boundary_key, c_custkey AS consumer, CASE WHEN c_custkey % 4 <> 0 THEN 200 + (c_custkey % 3) * 2 END AS status, c_custkey % 7 AS f FROM customer),
d AS (SELECT 'GET /nations/' || CAST(s_nationkey AS VARCHAR) || '/{id}' AS boundary_key, 200 + s_suppkey % 5 AS status, max(s_suppkey) AS s FROM supplier GROUP BY 1, 2)
SELECT DISTINCT r.boundary_key, consumer, d.status, 'b' || CAST(f AS VARCHAR) AS field FROM r JOIN d ON r.boundary_key = d.boundary_key AND (r.status IS NULL OR r.status = d.status) WHERE s % 9 <> 0 AND f > s % 6""",
    "unit_labels": """
WITH u AS (SELECT p_partkey AS unit, CASE WHEN p_partkey % 10 = 0 THEN 'loader' ELSE 'u' || CAST(p_partkey % 900 AS VARCHAR) END AS name, p_brand AS brand FROM part), s AS (SELECT name, count(DISTINCT brand) > 1 AS several FROM u GROUP BY 1)
SELECT unit, CASE WHEN several OR name = 'loader' THEN brand || '.test.' || name ELSE name END AS label FROM u JOIN s USING (name)""",
}
