"""Queries that hold single paths of execution against consumers: customers provide, their orders consume."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import assembly
from ..operators import paths
from ..sources.projection import scan

STATUS = '{"type":"input","inputRef":"response","path":["status"]}'
ASKS_200 = f'{{"type":"comparison","op":"eq","left":{STATUS},"right":{{"type":"literal","value":200}}}}'
FLAG = '{"type":"truthinessCheck","subject":{"type":"input","inputRef":"flag","path":[]},"negated":false}'
LOST = '{"type":"opaque","sourceText":"?"}'
ID = '{"type":"record","properties":{"id":{"type":"integer"}}}'
ID_TEXT = '{"type":"record","properties":{"id":{"type":"text"}}}'
ID_NOTE = '{"type":"record","properties":{"id":{"type":"integer"},"note":{"type":"union","variants":[{"type":"text"},{"type":"undefined"}]}}}'


def _texts(*x: str):
    return F.array(*(F.lit(t) for t in x)).cast("array<string>")


def _provided(spark, d):
    """Three paths of each customer: 200 behind a flag, its default with 200 or, in odd nations, 201, and 404 without a body."""
    second = F.when(F.col("c_nationkey") % 2 == 0, 200).otherwise(201)
    path = lambda name, status, default, conditions, body: F.struct(F.lit(name).alias("transition"), status.cast("int").alias("status"), F.lit(default).alias("is_default"), conditions.alias("conditions"), F.lit(body).cast("string").alias("body"))
    three = F.array(path("a", F.lit(200), False, _texts(FLAG), ID_NOTE), path("b", second, True, _texts(), ID), path("c", F.lit(404), False, _texts(LOST), None))
    customers = scan(spark, d, "customer").select(F.concat(F.lit("GET /c/"), "c_custkey").alias("boundary_key"), F.concat(F.lit("c"), "c_custkey").alias("summary"), F.explode(three).alias("path"))
    return customers.select("boundary_key", "summary", F.lit(False).alias("opaque"), "path.*")


def _consumed(spark, d):
    """A path of each order, which asks for 200 or 404 or is a default; conditions and reads go by its key."""
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    conditions = F.when(key % 3 == 0, _texts(ASKS_200)).when(key % 3 == 1, _texts(ASKS_200, LOST)).otherwise(_texts(FLAG))
    unknown = '{"type":"unknown"}'
    read = F.when(key % 4 == 1, f'{{"type":"record","properties":{{"body":{ID}}}}}').when(key % 4 == 2, f'{{"type":"record","properties":{{"note":{unknown}}}}}').when(key % 4 == 3, f'{{"type":"record","properties":{{"gone":{unknown}}}}}')
    asks = F.when(state == "O", F.array(F.lit(200))).when(state == "F", F.array(F.lit(404))).otherwise(F.array().cast("array<int>"))
    return scan(spark, d, "orders").select(
        F.concat(F.lit("GET /c/"), "o_custkey").alias("boundary_key"), F.concat(F.lit("o"), key).alias("summary"), F.lit("x").alias("transition"), asks.alias("asks"), (state == "P").alias("is_default"),
        conditions.alias("conditions"), read.alias("expected_input"), _texts("status").alias("accessors"), _texts("body").alias("body_accessors"),
    )


def _declared(spark, d):
    """Two sources of each customer that declare 200; in every third nation the second has ids as text."""
    second = F.when(F.col("c_nationkey") % 3 == 0, ID_TEXT).otherwise(ID)
    source = lambda name, place, body: F.struct(F.concat(F.lit(name), "c_custkey").alias("summary"), F.lit(place).alias("place"), body.alias("declared_body"))
    rows = scan(spark, d, "customer").select(F.concat(F.lit("GET /c/"), "c_custkey").alias("boundary_key"), F.explode(F.array(source("s", 1, F.lit(ID)), source("t", 2, second))).alias("s"))
    return rows.select("boundary_key", F.lit(200).alias("status"), "s.*")


def path_sub_cases(spark, d):
    return paths.sub_cases(_provided(spark, d), _consumed(spark, d))


def path_body_reads(spark, d):
    return paths.body_reads(_provided(spark, d), _consumed(spark, d))


def declared_body_reads(spark, d):
    return paths.declared_body_reads(_declared(spark, d), _consumed(spark, d))


def declared_bodies(spark, d):
    return paths.declared_bodies(_declared(spark, d))


def assembled_paths(spark, d):
    """Every line item as a unit with one path: its ends, conditions, inputs and metadata go by its columns."""
    flag, line, key = F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_orderkey")
    none = F.lit(None).cast("string")
    status = F.when(line <= 2, F.struct(F.lit("literal").alias("type"), F.when(flag == "N", 200.0).otherwise(404.0).alias("value"), none.alias("sourceText"))).when(line == 3, F.struct(F.lit("dynamic").alias("type"), F.lit(None).cast("double").alias("value"), F.lit("code").alias("sourceText")))
    kind = F.when(flag == "N", "response").when(flag == "A", "throw").otherwise("render")
    body = F.struct(none.alias("shape"), F.when(line == 1, "User").alias("typeText"))
    terminal = F.struct(kind.alias("kind"), status.alias("statusCode"), body.alias("body"), F.lit("Gone").alias("exceptionType"), F.when(line == 4, "Page").alias("target"))
    condition = F.struct(F.when(line % 2 == 0, FLAG).alias("structured"), F.concat(F.lit("q"), line).alias("sourceText"), F.when(key % 2 == 0, "negative").otherwise("positive").alias("polarity"))
    branch = F.struct(F.array(condition).alias("conditions"), terminal.alias("terminal"), F.lit(False).alias("isDefault"), none.alias("expectedInput"))
    param = F.struct(F.lit("id").alias("name"), line.cast("int").alias("position"), F.lit("path").alias("role"), F.when(flag == "A", "text").otherwise("").alias("typeText"))
    raw = scan(spark, d, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("name"), key, line, F.array(param).alias("parameters"), F.array(branch).alias("branches"), none.alias("declared_contract"),
        F.when(flag == "R", F.array(F.lit("data"))).alias("body_accessors"), F.array().cast("array<string>").alias("status_accessors"), F.when(line == 5, "query Q").alias("graphql_document"), none.alias("graphql_schema"), none.alias("graphql_contract"),
    )
    t = F.col("transitions")[0]
    out = t["output"]
    return assembly.assemble(raw).select(
        "l_orderkey", "l_linenumber", t["id"].alias("path"), t["conditions"][0].alias("condition"), F.col("inputs")[0].alias("input"), out["type"].alias("ends"), out["statusCode"]["type"].alias("status_type"),
        out["statusCode"]["value"].cast("int").alias("status"), out["body"].alias("body"), out["exceptionType"].alias("exception"), out["target"].alias("target"), "level", "metadata",
    )


QUERIES = {f.__name__: f for f in (path_sub_cases, path_body_reads, declared_body_reads, declared_bodies, assembled_paths)}

KEYS = "'GET /c/' || CAST(c_custkey AS VARCHAR) AS boundary_key, 'c' || CAST(c_custkey AS VARCHAR) AS provider, 'o' || CAST(o_orderkey AS VARCHAR) AS consumer"

ORACLE = {
    "path_sub_cases": f"""
SELECT {KEYS}, CAST(NULL AS VARCHAR) AS transition, CASE o_orderkey % 3 WHEN 0 THEN 'unhandledProviderCase' ELSE 'lowConfidence' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'warning' ELSE 'info' END AS severity,
CASE o_orderkey % 3 WHEN 0 THEN 'Status 200 has 2 cases that the consumer takes for one: path a' ELSE 'Status 200 has cases that can''t be compared with the consumer''s branches: path a' END AS description
FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey % 2 = 0 AND o_orderstatus <> 'F' AND o_orderkey % 3 < 2""",
    "path_body_reads": f"""
WITH met AS (SELECT {KEYS}, path, o_orderkey % 4 AS r, CAST(CASE WHEN path = 'a' OR c_nationkey % 2 = 0 THEN 200 ELSE 201 END AS VARCHAR) AS status, CASE WHEN o_orderstatus = 'P' THEN ' in the default branch' ELSE '' END AS of_default
 FROM customer JOIN orders ON o_custkey = c_custkey, (VALUES ('a'), ('b')) v(path) WHERE o_orderstatus = 'P' OR o_orderstatus = 'O' AND (path = 'a' OR c_nationkey % 2 = 0))
SELECT boundary_key, provider, consumer, 'x' AS transition, 'unhandledProviderCase' AS kind, 'error' AS severity, 'Consumer reads a field that the body lacks at status ' || status || of_default AS description FROM met WHERE r = 3 OR r = 2 AND path = 'b'
UNION ALL SELECT boundary_key, provider, consumer, 'x', 'consumerContractViolation', 'info', 'Consumer reads note that the provider may leave out at status ' || status || of_default FROM met WHERE r = 2 AND path = 'a'""",
    "declared_body_reads": f"""
WITH k AS (SELECT {KEYS}, c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND o_orderkey % 4 >= 2)
SELECT boundary_key, s || CAST(c_custkey AS VARCHAR) AS provider, consumer, 'x' AS transition, 'consumerContractViolation' AS kind, 'warning' AS severity, 'Consumer reads a field that the contract doesn''t declare at status 200' AS description FROM k, (VALUES ('s'), ('t')) v(s)""",
    "declared_bodies": """
SELECT 'GET /c/' || CAST(c_custkey AS VARCHAR) AS boundary_key, 's' || CAST(c_custkey AS VARCHAR) AS provider, 't' || CAST(c_custkey AS VARCHAR) AS consumer, CAST(NULL AS VARCHAR) AS transition, 'contractDisagreement' AS kind, 'warning' AS severity, 'Sources declare bodies that don''t match at status 200' AS description
FROM customer WHERE c_nationkey % 3 = 0""",
    "assembled_paths": f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber AS n, l_returnflag AS f, 's' || CAST(l_suppkey AS VARCHAR) AS name, 'q' || CAST(l_linenumber AS VARCHAR) AS q, CASE WHEN l_orderkey % 2 = 0 THEN 'negative' ELSE 'positive' END AS polarity,
 CASE l_returnflag WHEN 'N' THEN 'response' WHEN 'A' THEN 'throw' ELSE 'render' END AS kind, CASE WHEN l_linenumber <= 2 THEN CASE l_returnflag WHEN 'N' THEN 200 ELSE 404 END END AS code FROM lineitem),
y AS (SELECT *, CASE WHEN kind = 'throw' AND n <= 3 THEN 'response' ELSE kind END AS ends, CASE WHEN n % 2 = 0 THEN '{FLAG}' ELSE '{{"type":"opaque","sourceText":"' || q || '","reason":"complexExpression"}}' END AS pred,
 CASE WHEN f = 'R' THEN '"http":{{"bodyAccessors":["data"]}}' END AS http, CASE WHEN n = 5 THEN '"graphql":{{"document":"query Q"}}' END AS graphql FROM x)
SELECT l_orderkey, l_linenumber, name || ':' || kind || ':' || CASE WHEN n <= 2 THEN CAST(code AS VARCHAR) WHEN n = 3 THEN 'dyn:code' ELSE 'none' END || ':' || substr(sha1(polarity || ':' || q), 1, 7) AS path,
CASE WHEN polarity = 'negative' THEN '{{"type":"negation","operand":' || pred || '}}' ELSE pred END AS condition,
'{{"type":"parameter","name":"id","position":' || CAST(n AS VARCHAR) || ',"role":"path","shape":' || CASE WHEN f = 'A' THEN '{{"type":"ref","name":"text"}}' ELSE 'null' END || '}}' AS input, ends,
CASE WHEN ends = 'response' AND n <= 3 THEN CASE WHEN n <= 2 THEN 'literal' ELSE 'unresolved' END END AS status_type, CASE WHEN ends = 'response' THEN code END AS status, CASE WHEN ends = 'response' AND n = 1 THEN '{{"type":"ref","name":"User"}}' END AS body,
CASE WHEN ends = 'throw' THEN 'Gone' END AS exception, CASE WHEN ends = 'render' THEN CASE WHEN n = 4 THEN 'Page' ELSE 'unknown' END END AS target, CASE WHEN n % 2 = 0 THEN 'high' ELSE 'low' END AS level,
CASE WHEN http IS NOT NULL OR graphql IS NOT NULL THEN '{{' || concat_ws(',', http, graphql) || '}}' END AS metadata FROM y""",
}
