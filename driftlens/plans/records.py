"""Queries over records themselves: keys, shapes, predicates, findings, snapshots, ordinals, reachability, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, lattice, shapes
from ..operators import findings
from ..sources import contracts
from ..sources import projection as p
from ..sources.projection import scan
from .checks import BASE


def path_keys(spark, d):
    """Normalised paths of page URLs, with numbers as :id."""
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1), "[0-9]+", ":Id")
    return scan(spark, d, "pages").select(keys.rest_key(F.lit("get"), path).alias("boundary_key")).groupBy("boundary_key").agg(F.count("*").alias("n_pages"))


def rule_boundaries(spark, d):
    raw = F.concat(F.lower("o_orderpriority"), F.lit("/Orders/:Key/"), "o_orderstatus")
    return scan(spark, d, "orders").select(keys.rule_boundary(F.when(F.col("o_custkey") % 5 == 0, F.lit("gql:Query.f")).otherwise(F.concat(F.lit("post "), raw))).alias("boundary")).groupBy("boundary").agg(F.count("*").alias("n"))


def transition_ids(spark, d):
    line = scan(spark, d, "lineitem")
    status = F.when(F.col("l_linenumber") != 5, F.when(F.col("l_returnflag") == "N", 200).otherwise(404))
    return line.select(keys.transition_id(F.concat(F.lit("s"), "l_suppkey"), F.lit("response"), status, F.concat("l_linestatus", F.lit("|"), "l_linenumber")).alias("transition_id")).groupBy("transition_id").agg(F.count("*").alias("n"))


def predicate_match(spark, d):
    """Three-valued equality of predicates in canonical JSON, for parts of one brand and size."""
    part = scan(spark, d, "part")
    pred = F.to_json(F.struct(F.lit("comparison").alias("type"), F.col("p_type").alias("left"), (F.col("p_size") % 4).alias("right")))
    rows = part.select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_partkey").alias("part"), pred.alias("pred"), (F.col("p_partkey") % 17 == 0).alias("opaque"))
    return lattice.pairwise(rows, ["brand", "size"]).groupBy("brand").agg(lattice.name(lattice.all_of(F.col("least"))).alias("all_of"), lattice.name(lattice.any_of(F.col("most"))).alias("any_of"), F.sum("n_pairs").alias("n_pairs"))


def _shape(flags, optional=None):
    """A record shape as JSON: id always, then a field for each (name, kind, condition)."""
    fields = [F.lit('"id":{"type":"integer"}')]
    for name, kind, when in flags:
        body = F.lit(f'"{name}":{{"type":"{kind}"}}')
        if optional is not None and name == optional:
            body = F.lit(f'"{name}":{{"type":"union","variants":[{{"type":"{kind}"}},{{"type":"undefined"}}]}}')
        fields.append(F.when(when, body))
    return F.concat(F.lit('{"type":"record","properties":{'), F.concat_ws(",", *fields), F.lit("}}"))


def _bodies(spark, d):
    n = F.col("p_partkey")
    names = [("name", "text"), ("price", "integer"), ("size", "integer")]
    actual = _shape([(x, k, n % (i + 2) != 0) for i, (x, k) in enumerate(names)], "size")
    declared = _shape([("name", "text", n % 5 != 0), ("price", "number", n % 7 != 0), ("size", "integer", n % 3 == 0)])
    spread = F.when(n % 11 == 0, F.lit('{"type":"unknown"}')).otherwise(declared)
    return scan(spark, d, "part").select(n.alias("part"), actual.alias("actual"), spread.alias("declared"))


def _odd_bodies(spark, d):
    """Records against dictionaries, and wider values against literals."""
    n = F.col("p_partkey")
    price = F.when(n % 4 == 0, F.lit('{"type":"text"}')).when(n % 4 == 1, F.lit('{"type":"literal","value":2.0}')).otherwise(F.lit('{"type":"integer"}'))
    actual = F.when(n % 2 == 0, F.concat(F.lit('{"type":"record","properties":{"a":{"type":"integer"},"b":'), price, F.lit("}"), F.when(n % 5 == 0, F.lit(',"spreads":["rest"]')).otherwise(""), F.lit("}"))).otherwise(price)
    declared = F.when(n % 2 == 0, F.lit('{"type":"dictionary","values":{"type":"integer"}}')).when(n % 3 == 0, F.lit('{"type":"literal","value":2}')).otherwise(F.lit('{"type":"integer"}'))
    return scan(spark, d, "part").select((-n).alias("part"), actual.alias("actual"), declared.alias("declared"))


def body_match(spark, d):
    return _bodies(spark, d).unionByName(_odd_bodies(spark, d)).select("part", lattice.name(shapes.shape_match("actual", "declared")).alias("verdict"))


def body_compatibility(spark, d):
    b = _bodies(spark, d)
    return b.select("part", lattice.name(shapes.shape_covers("actual", "declared")).alias("verdict"), F.array_join(shapes.shape_optional_reads("actual", "declared"), ",").alias("optional_reads"))


def confidence(spark, d):
    return findings.confidence(scan(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), (F.col("l_returnflag") == "R").alias("opaque")))


def _raw_findings(spark, d):
    made = p.providers(spark, d).where("boundary_key is not null").join(p.provider_statuses(spark, d), "provider").where("status is not null")
    kinds = F.when(F.col("status") == 409, "error").otherwise(F.when(F.col("provider") % 2 == 0, "info").otherwise("warning"))
    gap = F.when(F.col("provider") % 3 == 0, "  ").otherwise(" ")
    return made.select((F.col("provider") * 1000 + F.col("status")).alias("seq"), F.lit("unhandledProviderCase").alias("kind"), F.when(F.col("provider") % 5 != 0, F.col("boundary_key")).alias("boundary_key"), F.concat(F.lit("status"), gap, "status").alias("description"), F.lit("c").alias("consumer"), F.lit("t").alias("transition"), F.col("provider").cast("string").alias("provider"), kinds.alias("severity"))


def dedupe_findings(spark, d):
    out = findings.dedupe(_raw_findings(spark, d))
    return out.select("seq", "kind", "boundary", "description", "severity", F.array_join("sources", ",").alias("sources"), "n_merged")


#: Rules as people write them: ord, kind, boundary, consumer, transition, effect.
RULES = [(1, None, "get /Nations/3/:id/", None, None, "hide"), (2, "unhandledProviderCase", "GET /nations/4/{id}", "c", None, "downgrade"), (3, None, "GET /nations/5/:id", None, "t", "mark"), (4, "lowConfidence", None, None, None, "hide"), (5, "unhandledProviderCase", "_noboundary_", None, None, "mark"), (6, None, "GET /nations/5/{id}", None, None, "hide"), (7, None, "GET /nations/6/{id}", "another", None, "hide"), (8, None, None, None, None, "hide")]
#: The boundaries that they mean, for the SQL twin.
MEANT = {1: "GET /nations/3/{id}", 2: "GET /nations/4/{id}", 3: "GET /nations/5/{id}", 5: "_NOBOUNDARY_", 6: "GET /nations/5/{id}", 7: "GET /nations/6/{id}"}


def _suppressed(spark, d):
    rules = spark.createDataFrame(RULES, "ord int, kind string, boundary string, consumer string, transition string, effect string")
    return findings.suppress(findings.dedupe(_raw_findings(spark, d)), rules)


def suppressions(spark, d):
    return _suppressed(spark, d).select("seq", "boundary", "severity", "effect", "counts")


def severity_summary(spark, d):
    return findings.severities(_suppressed(spark, d))


def _snapshots(spark, d):
    line = scan(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), (F.year("l_shipdate") < 1998).alias("early"))
    n = line.groupBy("part", "line", "early").agg(F.count("*").alias("n"))
    return n.where("early").drop("early"), n.where("not early").drop("early")


def diff_summaries(spark, d):
    before, after = _snapshots(spark, d)
    return findings.diff(before, after, ["part", "line"], "n")


def file_churn(spark, d):
    docs = scan(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "doc_id", "n_chars")
    before = docs.where("doc_id % 10 != 3").select("path", F.col("n_chars").alias("stamp"))
    now = docs.where("doc_id % 10 != 7").select("path", (F.col("n_chars") + (F.col("doc_id") % 4 == 0).cast("int")).alias("stamp"))
    return findings.churn(before, now).groupBy("state").agg(F.count("*").alias("n"))


def handler_ordinals(spark, d):
    c = scan(spark, d, "conversations").select("conv_id", "role", "turn")
    return findings.ordinals(c, ["conv_id", "role"], ["turn"]).select("conv_id", "role", "turn", "idx", "suffix")


def reachable_closure(spark, d):
    """Orders as a binary tree: the steps from order 1 to each."""
    o = scan(spark, d, "orders").where("o_orderkey > 0")
    return findings.reach(o.select(F.expr("o_orderkey div 2").alias("src"), F.col("o_orderkey").alias("dst")).where("src > 0"), o.where("o_orderkey = 1").select(F.col("o_orderkey").alias("node")))


def merge_parameters(spark, d):
    part = scan(spark, d, "part")
    row = lambda df: df.select(F.col("p_brand").alias("place"), (F.col("p_size") % 20).alias("name"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("schema"))
    return findings.merge_keyed(row(part.where("p_partkey % 3 = 0")), row(part.where("p_partkey % 3 != 0")), ["place", "name"], "ord")


def interaction_index(spark, d):
    """Interactions by class and semantics."""
    e = scan(spark, d, "events")
    cls = F.when(F.col("event_type") == "view", "storage-access").when(F.col("event_type") == "click", "message-send").when(F.col("event_type") == "purchase", "message-receive").otherwise("config-read")
    return e.groupBy(cls.alias("class"), (F.col("user_id") % 4).alias("semantics")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_callers"))


def wrapper_expansion(spark, d):
    """Wrappers without a path of their own, one summary for each caller with a literal path."""
    wrappers = scan(spark, d, "supplier").select(F.col("s_suppkey").alias("wrapper"))
    calls = scan(spark, d, "lineitem").select(F.col("l_suppkey").alias("wrapper"), F.concat(F.lit("/Orders/"), F.col("l_orderkey") % 100, F.lit("/")).alias("path"))
    return calls.join(wrappers, "wrapper").select("wrapper", keys.rest_key(F.lit("get"), F.col("path")).alias("boundary_key")).groupBy("wrapper", "boundary_key").agg(F.count("*").alias("n_callers"))


def boundary_counts(spark, d):
    """Sides of paired boundaries, which directory reports list; each side is counted by itself."""
    return p.providers(spark, d).groupBy("boundary_key").agg(F.count_distinct("provider").alias("providers")).join(p.consumers(spark, d).groupBy("boundary_key").agg(F.count_distinct("consumer").alias("consumers")), "boundary_key")


def queue_channels(spark, d):
    """Channels of resource references in the forms that templates write."""
    n = F.col("s_suppkey")
    raw = F.when(n % 4 == 0, F.concat(F.lit('{"Ref":"Queue'), n, F.lit('"}'))).when(n % 4 == 1, F.concat(F.lit('{"Fn::GetAtt":["Queue'), n, F.lit('","Arn"]}'))).when(n % 4 == 2, F.concat(F.lit('"arn:aws:sqs:eu-west-1:1:Queue'), n, F.lit('"'))).otherwise(F.concat(F.lit('"Queue'), n, F.lit('"')))
    return scan(spark, d, "supplier").select(n.alias("supplier"), contracts.queue_channel(raw).alias("channel"))


def status_codes(spark, d):
    """Response keys of an API description as status, range or default."""
    n = F.col("c_custkey") % 7
    code = F.element_at(F.array(*(F.lit(x) for x in ("200", "4XX", "default", "404", "abc", "6XX", "5xx"))), (n + 1).cast("int"))
    return scan(spark, d, "customer").select(code.alias("code")).select("code", *contracts.status_code(F.col("code"))).groupBy("code", "status", "status_class", "is_default").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (path_keys, rule_boundaries, transition_ids, predicate_match, body_match, body_compatibility, confidence, dedupe_findings, suppressions, severity_summary, diff_summaries, file_churn, handler_ordinals, reachable_closure, merge_parameters, interaction_index, wrapper_expansion, boundary_counts, queue_channels, status_codes)}

RAW = BASE + """
, made AS (SELECT provider, boundary_key, status FROM providers JOIN ps USING (provider) WHERE boundary_key IS NOT NULL AND status IS NOT NULL),
raw AS (SELECT provider * 1000 + status AS seq, 'unhandledProviderCase' AS kind, CASE WHEN provider % 5 <> 0 THEN boundary_key ELSE '_noboundary_' END AS boundary, 'status' || CASE WHEN provider % 3 = 0 THEN '  ' ELSE ' ' END || CAST(status AS VARCHAR) AS description, status AS said, CAST(provider AS VARCHAR) AS provider, CASE WHEN status = 409 THEN 0 WHEN provider % 2 = 0 THEN 2 ELSE 1 END AS rank FROM made),
merged AS (SELECT min(seq) AS seq, kind, boundary, arg_min(description, seq) AS description, min(rank) AS rank, list_sort(list(DISTINCT provider)) AS providers, count(*) AS n_merged FROM raw GROUP BY kind, boundary, said)
"""
SEV = "CASE {} WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END"
SUPPRESSED = RAW + f"""
, rules(ord, kind, boundary, consumer, transition, effect) AS (VALUES {', '.join('(' + ', '.join('CAST(NULL AS VARCHAR)' if x is None else repr(x) for x in (r[0], r[1], MEANT.get(r[0]), *r[3:])) + ')' for r in RULES)}),
hit AS (SELECT seq, arg_min(effect, ord) AS effect FROM merged m JOIN rules r ON (r.kind IS NULL OR r.kind = m.kind) AND (r.boundary IS NULL OR r.boundary = m.boundary AND m.boundary <> '_noboundary_') AND (r.consumer IS NULL OR r.consumer = 'c') AND (r.transition IS NULL OR r.transition = 't')
AND coalesce(r.kind, r.boundary, r.consumer, r.transition) IS NOT NULL GROUP BY seq),
sup AS (SELECT m.seq, m.boundary, {SEV.format("CASE WHEN effect = 'downgrade' THEN least(rank + 1, 2) ELSE rank END")} AS severity, effect, effect IS NULL OR effect = 'downgrade' AS counts FROM merged m LEFT JOIN hit USING (seq) WHERE effect IS NULL OR effect <> 'hide')
"""

ORACLE = {
    "path_keys": """
WITH x AS (SELECT regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '[0-9]+', '{Id}', 'g') AS path FROM pages),
y AS (SELECT CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END AS path FROM x)
SELECT 'GET ' || replace(lower(path), '{id}', '{Id}') AS boundary_key, count(*) AS n_pages FROM y GROUP BY 1""",
    "rule_boundaries": """
SELECT CASE WHEN o_custkey % 5 = 0 THEN 'GQL:QUERY.F' ELSE 'POST ' || lower(o_orderpriority) || '/orders/{Key}/' || lower(o_orderstatus) END AS boundary, count(*) AS n FROM orders GROUP BY 1""",
    "transition_ids": """
SELECT 's' || CAST(l_suppkey AS VARCHAR) || ':response:' || CASE WHEN l_linenumber = 5 THEN 'none' WHEN l_returnflag = 'N' THEN '200' ELSE '404' END || ':' || substr(sha1(l_linestatus || '|' || CAST(l_linenumber AS VARCHAR)), 1, 7) AS transition_id, count(*) AS n FROM lineitem GROUP BY 1""",
    "predicate_match": """
WITH r AS (SELECT p_brand AS brand, p_size AS size, p_partkey AS part, p_type || '|' || CAST(p_size % 4 AS VARCHAR) AS pred, p_partkey % 17 = 0 AS opaque FROM part),
v AS (SELECT a.brand, CASE WHEN a.opaque OR b.opaque THEN 1 WHEN a.pred = b.pred THEN 2 ELSE 0 END AS v FROM r a JOIN r b ON a.brand = b.brand AND a.size = b.size AND a.part < b.part)
SELECT brand, CASE min(v) WHEN 0 THEN 'nomatch' WHEN 1 THEN 'unknown' ELSE 'match' END AS all_of, CASE max(v) WHEN 0 THEN 'nomatch' WHEN 1 THEN 'unknown' ELSE 'match' END AS any_of, count(*) AS n_pairs FROM v GROUP BY 1""",
    "body_match": """
WITH x AS (SELECT p_partkey AS n FROM part), f AS (SELECT n, n % 2 <> 0 AS a_name, n % 3 <> 0 AS a_price, n % 4 <> 0 AS a_size, n % 5 <> 0 AS d_name, n % 7 <> 0 AS d_price, n % 3 = 0 AS d_size FROM x)
SELECT n AS part, CASE WHEN n % 11 = 0 THEN 'unknown' WHEN d_name AND NOT a_name OR d_price AND NOT a_price OR d_size THEN 'nomatch' ELSE 'match' END AS verdict FROM f
UNION ALL SELECT -n, CASE WHEN n % 2 = 0 THEN CASE WHEN n % 5 = 0 THEN 'unknown' WHEN n % 4 = 0 THEN 'nomatch' ELSE 'match' END WHEN n % 3 = 0 THEN CASE WHEN n % 4 = 1 THEN 'match' ELSE 'nomatch' END ELSE 'match' END FROM x""",
    "body_compatibility": """
WITH x AS (SELECT p_partkey AS n FROM part), f AS (SELECT n, n % 2 <> 0 AS a_name, n % 3 <> 0 AS a_price, n % 4 <> 0 AS a_size, n % 5 <> 0 AS d_name, n % 7 <> 0 AS d_price, n % 3 = 0 AS d_size FROM x)
SELECT n AS part, CASE WHEN n % 11 = 0 THEN 'match' WHEN d_name AND NOT a_name OR d_price AND NOT a_price OR d_size AND NOT a_size THEN 'nomatch' ELSE 'match' END AS verdict, CASE WHEN n % 11 <> 0 AND d_size AND a_size THEN 'size' ELSE '' END AS optional_reads FROM f""",
    "confidence": """
SELECT l_orderkey AS unit, count(*) AS total, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS n_opaque, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'high' WHEN 2 * count(*) FILTER (l_returnflag = 'R') < count(*) THEN 'medium' ELSE 'low' END AS level FROM lineitem GROUP BY 1""",
    "dedupe_findings": RAW + f"SELECT seq, kind, boundary, description, {SEV.format('rank')} AS severity, CASE WHEN n_merged > 1 THEN array_to_string(providers, ',') END AS sources, n_merged FROM merged",
    "suppressions": SUPPRESSED + "SELECT * FROM sup",
    "severity_summary": SUPPRESSED + "SELECT severity, count(*) AS n, count(*) FILTER (counts) AS n_counted FROM sup GROUP BY 1",
    "diff_summaries": """
WITH n AS (SELECT l_partkey AS part, l_linenumber AS line, year(l_shipdate) < 1998 AS early, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT * FROM n WHERE early), a AS (SELECT * FROM n WHERE NOT early)
SELECT coalesce(b.part, a.part) AS part, coalesce(b.line, a.line) AS line, CASE WHEN b.part IS NULL THEN 'added' WHEN a.part IS NULL THEN 'removed' ELSE 'changed' END AS change, b.n AS "old", a.n AS "new"
FROM b FULL JOIN a ON a.part = b.part AND a.line = b.line WHERE b.n IS DISTINCT FROM a.n""",
    "file_churn": """
WITH x AS (SELECT doc_id % 10 <> 3 AS b, doc_id % 10 <> 7 AS a, doc_id % 4 = 0 AS moved FROM documents)
SELECT CASE WHEN NOT b THEN 'added' WHEN NOT a THEN 'removed' WHEN moved THEN 'changed' ELSE 'unchanged' END AS state, count(*) AS n FROM x WHERE a OR b GROUP BY 1""",
    "handler_ordinals": """
SELECT conv_id, role, turn, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS INT) AS idx, CASE WHEN count(*) OVER (PARTITION BY conv_id, role) > 1 THEN '#' || CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS VARCHAR) ELSE '' END AS suffix FROM conversations""",
    "reachable_closure": """
WITH RECURSIVE r AS (SELECT o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderkey = 1 UNION ALL SELECT o.o_orderkey, r.depth + 1 FROM orders o JOIN r ON o.o_orderkey // 2 = r.node WHERE o.o_orderkey > 1)
SELECT node, min(depth) AS depth FROM r GROUP BY 1""",
    "merge_parameters": """
SELECT place, name, ord, schema FROM (SELECT p_brand AS place, p_size % 20 AS name, p_partkey AS ord, p_type AS schema, row_number() OVER (PARTITION BY p_brand, p_size % 20 ORDER BY p_partkey % 3 <> 0, p_partkey) AS k FROM part) WHERE k = 1""",
    "interaction_index": """
SELECT CASE event_type WHEN 'view' THEN 'storage-access' WHEN 'click' THEN 'message-send' WHEN 'purchase' THEN 'message-receive' ELSE 'config-read' END AS class, user_id % 4 AS semantics, count(*) AS n, count(DISTINCT user_id) AS n_callers FROM events GROUP BY 1, 2""",
    "wrapper_expansion": """
SELECT l_suppkey AS wrapper, 'GET /orders/' || CAST(l_orderkey % 100 AS VARCHAR) AS boundary_key, count(*) AS n_callers FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2""",
    "boundary_counts": BASE + "SELECT boundary_key, count(DISTINCT provider) AS providers, count(DISTINCT consumer) AS consumers FROM providers JOIN consumers USING (boundary_key) GROUP BY 1",
    "queue_channels": "SELECT s_suppkey AS supplier, 'Queue' || CAST(s_suppkey AS VARCHAR) AS channel FROM supplier",
    "status_codes": """
WITH x AS (SELECT ['200', '4XX', 'default', '404', 'abc', '6XX', '5xx'][c_custkey % 7 + 1] AS code FROM customer)
SELECT code, CASE WHEN regexp_full_match(code, '[0-9]{3}') THEN CAST(code AS INT) END AS status, CASE WHEN regexp_full_match(code, '[1-5]XX') THEN CAST(substr(code, 1, 1) AS INT) END AS status_class, code = 'default' AS is_default, count(*) AS n FROM x GROUP BY ALL""",
}
