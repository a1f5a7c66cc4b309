"""Queries that hold boundaries' sides against each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boundaries, pairing
from ..sources import projection as p
from ..sources.projection import scan

KEY = "'GET /nations/' || CAST({} AS VARCHAR) || '/{{id}}'"

BASE = f"""
WITH providers AS (SELECT CASE WHEN s_suppkey % 8 <> 0 THEN {KEY.format('s_nationkey')} END AS boundary_key, s_suppkey AS provider FROM supplier),
consumers AS (SELECT {KEY.format('c_nationkey')} AS boundary_key, c_custkey AS consumer, c_mktsegment = 'BUILDING' AS has_default FROM customer),
ps AS (SELECT DISTINCT l_suppkey AS provider, CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN NULL WHEN l_returnflag = 'N' THEN 200 WHEN l_returnflag = 'A' THEN 404 ELSE 409 END AS status, (l_linenumber = 7 AND l_returnflag = 'R') AS opaque FROM lineitem),
cs AS (SELECT DISTINCT o_custkey AS consumer, CASE o_orderstatus WHEN 'O' THEN 200 WHEN 'F' THEN 404 ELSE 500 END AS status FROM orders),
declared AS (SELECT {KEY.format('n_nationkey')} AS boundary_key, 200 AS status FROM nation UNION ALL SELECT {KEY.format('n_nationkey')}, CASE n_regionkey WHEN 0 THEN 404 WHEN 1 THEN 409 ELSE 500 END FROM nation)
"""


def _sides(spark, d):
    return p.providers(spark, d), p.consumers(spark, d), p.provider_statuses(spark, d), p.consumer_statuses(spark, d)


def provider_coverage(spark, d):
    return pairing.provider_coverage(*_sides(spark, d))


def consumer_satisfaction(spark, d):
    return pairing.consumer_satisfaction(*_sides(spark, d))


def pair_summaries(spark, d):
    return pairing.pairing_report(p.providers(spark, d), p.consumers(spark, d).withColumn("boundary_key", F.when((F.col("consumer") % 2 == 0) | ~F.col("boundary_key").like("%/1/%"), F.col("boundary_key"))))


def contract_consistency(spark, d):
    return pairing.contract_consistency(p.declared_statuses(spark, d), p.consumers(spark, d), p.consumer_statuses(spark, d))


def contract_agreement(spark, d):
    return pairing.contract_agreement(scan(spark, d, "part").select(F.col("p_brand").alias("boundary_key"), F.col("p_type").alias("source"), (200 + F.col("p_size") % 5).alias("status")).distinct())


def declared_gaps(spark, d):
    declared = scan(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), F.explode(F.array(F.lit(200), F.lit(404), F.lit(500))).alias("status"))
    return pairing.gaps(declared, p.provider_statuses(spark, d).where("status is not null").select(F.col("provider").alias("unit"), "status"))


def semantic_bridging(spark, d):
    flag = F.when(F.col("l_returnflag") == "N", 200).when(F.col("l_returnflag") == "A", 404).otherwise(409)
    t = scan(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), flag.alias("status"), F.col("l_linenumber").alias("t_ord"), F.when(F.col("l_linenumber") != 3, F.col("l_linestatus")).alias("literal")).distinct()
    tests = scan(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"), F.when(F.col("s_suppkey") % 3 == 0, "O").when(F.col("s_suppkey") % 3 == 1, "F").alias("literal"))
    return pairing.bridging(t, tests)


def relational_storage(spark, d):
    return boundaries.relational_storage(p.declared_columns(spark, d), p.accesses(spark, d))


def _runtimes(spark, d):
    docs = scan(spark, d, "documents").select("source", "lang", "doc_id")
    runtimes = docs.select("source").distinct().select(F.col("source").alias("runtime"), F.when(~F.col("source").endswith("7"), F.concat(F.lit("app/"), "source", F.lit("/"))).alias("scope"))
    provided = docs.select(F.col("source").alias("runtime"), F.concat(F.lit("VAR_"), F.upper("lang"), F.col("doc_id") % 7).alias("variable"), (F.col("lang") == "de").alias("platform")).distinct()
    reads = docs.select(F.concat(F.lit("app/"), "source", F.lit("/"), "lang", F.lit("/x.ts")).alias("file"), F.concat(F.lit("VAR_"), F.upper("lang"), F.col("doc_id") % 5 + 4).alias("variable"))
    return runtimes, provided, reads


def runtime_config(spark, d):
    return boundaries.runtime_config(*_runtimes(spark, d))


def runtime_for_file(spark, d):
    runtimes, _, reads = _runtimes(spark, d)
    ranked = runtimes.where("scope is not null").select("runtime", F.col("runtime").alias("ord"), "scope")
    wide = ranked.select("runtime", "ord", "scope").unionByName(ranked.where("runtime = 'src3'").select(F.lit("all").alias("runtime"), F.lit("src50").alias("ord"), F.lit("app/").alias("scope")))
    return boundaries.first_runtime(wide, reads.select("file").distinct())


def _channels(spark, d):
    """Every event stands in all three: by its user it is sent, received, both or only queued; what it isn't has a null channel."""
    e = scan(spark, d, "events").select(F.concat("event_type", F.lit("-"), F.col("user_id") % 50).alias("channel"), "user_id", "event_id", "event_type")
    part = F.col("user_id") % 5
    only = lambda *parts: e.withColumn("channel", F.when(part.isin(*parts), F.col("channel")))
    return only(0, 3, 4), only(1, 3, 4), e


def message_bus(spark, d):
    return boundaries.message_bus(*_channels(spark, d))


def message_bodies(spark, d):
    sent, received, _ = _channels(spark, d)
    field = lambda n: F.concat(F.lit("b"), F.col("event_id") % n).alias("field")
    return boundaries.message_bodies(sent.select("channel", F.when(F.col("event_type") != "click", field(6)).alias("field")), received.select("channel", field(9)))


def component_stories(spark, d):
    part = scan(spark, d, "part")
    inputs = F.transform(F.sequence(F.lit(1), F.col("p_size") % 6 + 1), lambda i: F.concat(F.lit("in"), i))
    components = part.select(F.col("p_brand").alias("component"), F.col("p_partkey").alias("ord"), inputs.alias("inputs"), F.slice(inputs, 1, 3).alias("gating"))
    stories = part.select(F.col("p_brand").alias("component"), F.col("p_partkey").alias("story"), F.concat(F.lit("in"), F.col("p_size") % 4 * 2).alias("arg")).withColumn("story", F.col("story").cast("string"))
    return boundaries.component_stories(components, stories)


def graphql_pairing(spark, d):
    o = scan(spark, d, "orders")
    selections = o.select(F.col("o_orderkey").alias("operation"), F.when(F.col("o_orderstatus") == "F", "Mutation").otherwise("Query").alias("type_name"), F.concat(F.lit("field"), F.col("o_custkey") % 30).alias("field_name"))
    resolvers = scan(spark, d, "supplier").select(F.lit("Query").alias("type_name"), F.concat(F.lit("field"), F.col("s_suppkey") % 24).alias("field_name"))
    return boundaries.graphql_roots(selections, resolvers)


def graphql_nested(spark, d):
    nation = scan(spark, d, "nation")
    fields = nation.select(F.concat(F.lit("R"), "n_regionkey").alias("type_name"), F.concat(F.when(F.col("n_nationkey") % 4 == 3, "other").otherwise("n"), F.col("n_nationkey") % 10).alias("field_name"), F.concat(F.lit("R"), (F.col("n_regionkey") + 1) % 6).alias("target"))
    fields = fields.groupBy("type_name", "field_name").agg(F.min("target").alias("target"))
    c = scan(spark, d, "customer")
    roots = c.select(F.col("c_custkey").alias("operation"), F.lit(0).alias("node"), F.concat(F.lit("R"), F.col("c_nationkey") % 5).alias("type_name"))
    nested = c.select(F.col("c_custkey").alias("operation"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("node"), "c_nationkey").select("operation", "node", (F.col("node") - 1).alias("parent"), F.concat(F.lit("n"), (F.col("c_nationkey") + F.col("node")) % 10).alias("field_name"))
    return boundaries.graphql_nested(nested, fields, roots, 3)


QUERIES = {f.__name__: f for f in (provider_coverage, consumer_satisfaction, pair_summaries, contract_consistency, contract_agreement, declared_gaps, semantic_bridging, relational_storage, runtime_config, runtime_for_file, message_bus, message_bodies, component_stories, graphql_pairing, graphql_nested)}

RUNTIMES = """
WITH runtimes AS (SELECT DISTINCT source AS runtime, CASE WHEN source NOT LIKE '%7' THEN 'app/' || source || '/' END AS scope FROM documents),
provided AS (SELECT DISTINCT source AS runtime, 'VAR_' || upper(lang) || CAST(doc_id % 7 AS VARCHAR) AS variable, lang = 'de' AS platform FROM documents),
reads AS (SELECT 'app/' || source || '/' || lang || '/x.ts' AS file, 'VAR_' || upper(lang) || CAST(doc_id % 5 + 4 AS VARCHAR) AS variable FROM documents)
"""
CHANNELS = """
WITH e AS (SELECT event_type || '-' || CAST(user_id % 50 AS VARCHAR) AS channel, user_id, event_id, event_type FROM events),
sent AS (SELECT * FROM e WHERE user_id % 5 IN (0, 3, 4)), received AS (SELECT * FROM e WHERE user_id % 5 IN (1, 3, 4))
"""

ORACLE = {
    "provider_coverage": BASE + """
, made AS (SELECT boundary_key, status, opaque, CAST(count(DISTINCT provider) AS BIGINT) AS n_sources FROM providers JOIN ps USING (provider) WHERE boundary_key IS NOT NULL GROUP BY ALL)
SELECT boundary_key, consumer, status, 'unhandledProviderCase' AS kind, 'error' AS severity, n_sources FROM consumers c JOIN made m USING (boundary_key)
WHERE NOT opaque AND NOT EXISTS (SELECT 1 FROM cs WHERE cs.consumer = c.consumer AND cs.status = m.status) AND NOT (has_default AND status BETWEEN 200 AND 299)
UNION ALL SELECT boundary_key, consumer, NULL, 'lowConfidence', 'info', n_sources FROM consumers JOIN made USING (boundary_key) WHERE opaque""",
    "consumer_satisfaction": BASE + """
, own AS (SELECT p.boundary_key, p.provider, coalesce(bool_or(opaque), false) AS unclear FROM providers p LEFT JOIN ps USING (provider) WHERE boundary_key IS NOT NULL GROUP BY ALL)
SELECT c.boundary_key, c.consumer, cs.status, CASE WHEN own.unclear THEN 'lowConfidence' ELSE 'deadConsumerBranch' END AS kind, CASE WHEN own.unclear THEN 'info' ELSE 'warning' END AS severity, CAST(count(*) AS BIGINT) AS n_sources
FROM consumers c JOIN cs USING (consumer) JOIN own ON own.boundary_key = c.boundary_key
WHERE NOT EXISTS (SELECT 1 FROM ps WHERE ps.provider = own.provider AND ps.status = cs.status) GROUP BY ALL""",
    "pair_summaries": BASE + """
, p AS (SELECT boundary_key, count(*) AS n FROM providers GROUP BY 1), c AS (SELECT CASE WHEN consumer % 2 = 0 OR boundary_key NOT LIKE '%/1/%' THEN boundary_key END AS boundary_key, count(*) AS n FROM consumers GROUP BY 1),
k AS (SELECT boundary_key FROM p UNION SELECT boundary_key FROM c)
SELECT k.boundary_key, CAST(coalesce(p.n, 0) AS BIGINT) AS n_providers, CAST(coalesce(c.n, 0) AS BIGINT) AS n_consumers,
CASE WHEN k.boundary_key IS NULL THEN 'no_binding' WHEN p.n IS NULL THEN 'unmatched_consumers' WHEN c.n IS NULL THEN 'unmatched_providers' ELSE 'paired' END AS state,
CAST(CASE WHEN k.boundary_key IS NULL THEN 0 ELSE coalesce(p.n, 0) * coalesce(c.n, 0) END AS BIGINT) AS n_pairs
FROM k LEFT JOIN p ON p.boundary_key IS NOT DISTINCT FROM k.boundary_key LEFT JOIN c ON c.boundary_key IS NOT DISTINCT FROM k.boundary_key""",
    "contract_consistency": BASE + """
SELECT boundary_key, consumer, status, 'consumerContractViolation' AS kind, 'warning' AS severity, 'unhandled' AS reason FROM consumers c JOIN (SELECT DISTINCT * FROM declared) d USING (boundary_key)
WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.consumer = c.consumer AND cs.status = d.status) AND NOT (has_default AND status BETWEEN 200 AND 299)
UNION ALL SELECT boundary_key, consumer, status, 'consumerContractViolation', 'error', 'undeclared' FROM consumers c JOIN cs USING (consumer)
WHERE boundary_key IN (SELECT boundary_key FROM declared) AND NOT EXISTS (SELECT 1 FROM declared d WHERE d.boundary_key = c.boundary_key AND d.status = cs.status)""",
    "contract_agreement": """
WITH s AS (SELECT DISTINCT p_brand AS boundary_key, p_type AS source, 200 + p_size % 5 AS status FROM part), n AS (SELECT boundary_key, count(DISTINCT source) AS n FROM s GROUP BY 1 HAVING count(DISTINCT source) > 1)
SELECT boundary_key, status, CAST(count(DISTINCT source) AS BIGINT) AS n_with, CAST(n - count(DISTINCT source) AS BIGINT) AS n_without FROM s JOIN n USING (boundary_key) GROUP BY boundary_key, status, n HAVING count(DISTINCT source) < n""",
    "declared_gaps": BASE + """
, d AS (SELECT s_suppkey AS unit, unnest([200, 404, 500]) AS status FROM supplier), m AS (SELECT DISTINCT provider AS unit, status FROM ps WHERE status IS NOT NULL)
SELECT unit, status, 'never produced' AS gap FROM (SELECT unit, status FROM d EXCEPT SELECT unit, status FROM m) UNION ALL SELECT unit, status, 'undeclared' FROM (SELECT unit, status FROM m EXCEPT SELECT unit, status FROM d)""",
    "semantic_bridging": """
WITH t AS (SELECT DISTINCT l_suppkey AS unit, CASE l_returnflag WHEN 'N' THEN 200 WHEN 'A' THEN 404 ELSE 409 END AS status, l_linenumber AS t_ord, CASE WHEN l_linenumber <> 3 THEN l_linestatus END AS literal FROM lineitem),
tests AS (SELECT s_suppkey AS unit, CASE s_suppkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' END AS literal FROM supplier)
SELECT unit, status, t_ord, literal FROM t a WHERE literal IS NOT NULL
AND EXISTS (SELECT 1 FROM t b WHERE b.unit = a.unit AND b.status = a.status AND (b.literal IS NULL OR b.literal <> a.literal))
AND NOT EXISTS (SELECT 1 FROM tests x WHERE x.unit = a.unit AND x.literal = a.literal)""",
    "relational_storage": """
WITH a AS (SELECT event_type AS tbl, CASE WHEN event_id % 500 = 499 AND event_type <> 'click' THEN '*' ELSE 'f' || CAST(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 0) % 20 AS VARCHAR) END AS field,
 CASE WHEN event_id % 2 = 0 AND TRY_CAST(json_extract_string(props, '$.k') AS INT) % 3 <> 0 THEN 'read' ELSE 'write' END AS mode FROM events),
d AS (SELECT tbl, 'f' || CAST(i AS VARCHAR) AS field FROM (SELECT DISTINCT event_type AS tbl FROM events WHERE event_type <> 'error'), range(25) r(i))
SELECT DISTINCT tbl, field, 'boundaryFieldUnknown' AS kind, 'error' AS severity, mode AS aspect FROM a WHERE field <> '*' AND tbl IN (SELECT tbl FROM d) AND (tbl, field) NOT IN (SELECT tbl, field FROM d)
UNION ALL SELECT tbl, field, 'boundaryFieldUnused', 'warning', CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.tbl = d.tbl AND a.field IN (d.field, '*') AND mode = 'write') THEN 'write-only' ELSE 'unused' END
FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.tbl = d.tbl AND a.field IN (d.field, '*') AND mode = 'read')""",
    "runtime_config": RUNTIMES + """
, used AS (SELECT DISTINCT runtime, variable FROM runtimes JOIN reads ON starts_with(file, scope))
SELECT runtime, variable, 'boundaryFieldUnknown' AS kind, 'error' AS severity FROM used u WHERE NOT EXISTS (SELECT 1 FROM provided p WHERE p.runtime = u.runtime AND p.variable = u.variable)
UNION ALL SELECT DISTINCT runtime, variable, 'boundaryFieldUnused', 'warning' FROM provided p WHERE NOT platform AND runtime IN (SELECT runtime FROM runtimes WHERE scope IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM used u WHERE p.runtime = u.runtime AND p.variable = u.variable)
UNION ALL SELECT runtime, NULL, 'runtimeScopeUnknown', 'info' FROM runtimes WHERE scope IS NULL""",
    "runtime_for_file": RUNTIMES + """
, w AS (SELECT runtime, runtime AS ord, scope FROM runtimes WHERE scope IS NOT NULL UNION ALL SELECT 'all', 'src50', 'app/')
SELECT file, arg_min(runtime, ord) AS runtime FROM (SELECT DISTINCT file FROM reads) JOIN w ON starts_with(file, scope) GROUP BY file""",
    "message_bus": CHANNELS + """
SELECT DISTINCT channel, 'messageBusProducerOrphan' AS kind, 'warning' AS severity FROM sent WHERE channel NOT IN (SELECT channel FROM received)
UNION ALL SELECT DISTINCT channel, 'messageBusConsumerOrphan', 'warning' FROM received WHERE channel NOT IN (SELECT channel FROM sent)
UNION ALL SELECT DISTINCT channel, 'messageBusUnused', 'warning' FROM e WHERE channel NOT IN (SELECT channel FROM sent) AND channel NOT IN (SELECT channel FROM received)""",
    "message_bodies": CHANNELS + """
, s AS (SELECT channel, 'b' || CAST(event_id % 6 AS VARCHAR) AS field FROM sent WHERE event_type <> 'click'), r AS (SELECT DISTINCT channel, 'b' || CAST(event_id % 9 AS VARCHAR) AS field FROM received)
SELECT channel, field FROM r WHERE channel IN (SELECT channel FROM s) AND (channel, field) NOT IN (SELECT channel, field FROM s)""",
    "component_stories": """
WITH c AS (SELECT p_brand AS component, arg_max(p_size, p_partkey) % 6 + 1 AS n FROM part GROUP BY 1), st AS (SELECT p_brand AS component, CAST(p_partkey AS VARCHAR) AS story, 'in' || CAST(p_size % 4 * 2 AS VARCHAR) AS arg FROM part),
i AS (SELECT component, x, 'in' || CAST(x AS VARCHAR) AS inp FROM c, range(1, 7) r(x) WHERE x <= n)
SELECT component, story, arg, 'boundaryFieldUnknown' AS kind FROM st JOIN c USING (component) WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.component = st.component AND i.inp = st.arg)
UNION ALL SELECT component, NULL, inp, 'scenarioCoverageGap' FROM i WHERE x <= 3 AND component IN (SELECT component FROM st) AND NOT EXISTS (SELECT 1 FROM st WHERE st.component = i.component AND st.arg = i.inp)""",
    "graphql_pairing": """
WITH s AS (SELECT o_orderkey AS operation, CASE WHEN o_orderstatus = 'F' THEN 'Mutation' ELSE 'Query' END AS type_name, 'field' || CAST(o_custkey % 30 AS VARCHAR) AS field_name FROM orders),
r AS (SELECT 'Query' AS type_name, 'field' || CAST(s_suppkey % 24 AS VARCHAR) AS field_name, count(*) AS n FROM supplier GROUP BY ALL)
SELECT operation, type_name, field_name, CAST(coalesce(n, 0) AS BIGINT) AS n_resolvers, n IS NULL AS unmatched FROM s LEFT JOIN r USING (type_name, field_name)""",
    "graphql_nested": """
WITH RECURSIVE f AS (SELECT 'R' || CAST(n_regionkey AS VARCHAR) AS type_name, CASE WHEN n_nationkey % 4 = 3 THEN 'other' ELSE 'n' END || CAST(n_nationkey % 10 AS VARCHAR) AS field_name, min('R' || CAST((n_regionkey + 1) % 6 AS VARCHAR)) AS target FROM nation GROUP BY ALL),
walk AS (SELECT c_custkey AS operation, c_nationkey AS nk, 0 AS node, CAST(NULL AS VARCHAR) AS parent_type, CAST(NULL AS VARCHAR) AS field_name, 'R' || CAST(c_nationkey % 5 AS VARCHAR) AS at_type FROM customer
 UNION ALL SELECT w.operation, w.nk, w.node + 1, w.at_type, 'n' || CAST((w.nk + w.node + 1) % 10 AS VARCHAR), f.target FROM walk w LEFT JOIN f ON f.type_name = w.at_type AND f.field_name = 'n' || CAST((w.nk + w.node + 1) % 10 AS VARCHAR) WHERE w.node < 3 AND w.at_type IN (SELECT type_name FROM f))
SELECT operation, parent_type AS type_name, field_name FROM walk WHERE node > 0 AND at_type IS NULL""",
}
