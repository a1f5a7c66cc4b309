"""The main query: all checks over a folder of summaries, merged and suppressed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lattice, predicates, shapes
from ..operators import boundaries, findings, pairing, paths
from ..session import checkpointed
from ..sources import graphql
from ..sources import summaries as src

COLUMNS = ["stage", "kind", "boundary_key", "description", "consumer", "transition", "provider", "severity"]


def _finding(df: DataFrame, stage: int, description, **given) -> DataFrame:
    for name in COLUMNS[1:]:
        if name in given:
            df = df.withColumn(name, given[name])
        elif name not in df.columns and name != "description":
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df.withColumn("description", description).withColumn("stage", F.lit(stage)).select(*(F.col(c).cast("string") if c != "stage" else F.col(c) for c in COLUMNS))


def _stories(summaries: DataFrame) -> DataFrame:
    """Findings of component_stories(): components are those without a story's metadata, gating inputs those that conditions test."""
    story = F.get_json_object("metadata", "$.component.storybook")
    named = F.expr("transform(filter(inputs, x -> get_json_object(x, '$.type') = 'parameter'), x -> get_json_object(x, '$.name'))")
    components = summaries.where((F.col("kind") == "component") & story.isNull()).select("summary", F.col("identity.name").alias("component"), F.struct("src", "place").alias("ord"), F.coalesce(named, F.array().cast("array<string>")).alias("inputs"), "transitions")
    tested = components.select("summary", "ord", F.explode("transitions.conditions").alias("conditions")).select("summary", "ord", F.explode("conditions").alias("condition")).select("summary", "ord", predicates.condition_inputs("condition").alias("gating"))
    gates = tested.groupBy("summary", "ord").agg(F.array_distinct(F.flatten(F.collect_list("gating"))).alias("gating"))  # one summary's
    components = components.drop("transitions").join(gates, ["summary", "ord"], "left").withColumn("gating", F.coalesce("gating", F.array().cast("array<string>")))
    args = F.map_keys(F.from_json(F.get_json_object(story, "$.args"), "map<string,string>"))
    stories = summaries.where(story.isNotNull()).select(F.get_json_object(story, "$.component").alias("component"), F.col("summary").alias("story"), F.explode_outer(args).alias("arg")).where("component is not null")
    return boundaries.component_stories(components, stories)


def _graphql(summaries: DataFrame) -> DataFrame:
    """Root selections of operations that no resolver answers, and nested ones that the schema of one of their resolvers lacks.

    A schema is named by its text, so that resolvers with one schema share its walk.
    """
    s, meta = F.col("identity.boundaryBinding.semantics"), lambda name: F.get_json_object("metadata", f"$.graphql.{name}")
    documents = summaries.where((s["name"] == "graphql-operation") & meta("document").isNotNull()).select(F.col("summary").alias("path"), meta("document").alias("content"))
    nodes = checkpointed(graphql.read_operations(documents).withColumnRenamed("operation", "name").withColumnRenamed("source", "operation"))
    kinds = F.create_map(*(F.lit(x) for pair in graphql.ROOTS.items() for x in pair))
    roots = nodes.where("parent = 0").withColumn("type_name", kinds[F.col("operation_type")])
    resolvers = summaries.where(s["name"] == "graphql-resolver").select(s["typeName"].alias("type_name"), s["fieldName"].alias("field_name"), meta("schemaSdl").alias("text"))
    alone = boundaries.graphql_roots(roots, resolvers).where("unmatched")
    schemas = resolvers.where("text is not null").withColumn("schema", F.sha2("text", 256))
    fields = graphql.read_schema(schemas.select(F.col("schema").alias("path"), F.col("text").alias("content")).distinct()).select(F.col("source").alias("schema"), "type_name", "field_name", "target")
    met = roots.join(schemas.select("schema", "type_name", "field_name").distinct(), ["type_name", "field_name"]).join(fields, ["schema", "type_name", "field_name"])
    within = lambda name: F.concat_ws(":", "schema", name)
    lost = boundaries.graphql_nested(
        nodes.where("parent > 0").select("operation", "node", "parent", "field_name"),
        fields.select(within("type_name").alias("type_name"), "field_name", within("target").alias("target")), met.select("operation", "node", within("target").alias("type_name")),
    ).withColumn("type_name", F.substring_index("type_name", ":", -1))
    say = lambda df, what: df.select("operation", F.concat_ws(" ", F.lit(what), F.concat_ws(".", "type_name", "field_name")).alias("description"))
    return say(alone, "No resolver for").unionByName(say(lost.distinct(), "The schema lacks"))


def check_all(summaries: DataFrame) -> DataFrame:
    """Every finding of every check, numbered by stage and content, before merging."""
    t = checkpointed(src.transitions(summaries))
    p, c = t.where("role = 'provider' and boundary_key is not null"), t.where("role = 'consumer' and boundary_key is not null")
    providers = p.select("boundary_key", F.col("summary").alias("provider")).distinct()
    made = p.select(F.col("summary").alias("provider"), "status", "opaque").where("status is not null or opaque").distinct()
    consumers = c.groupBy("boundary_key", F.col("summary").alias("consumer")).agg(F.bool_or("is_default").alias("has_default"))
    asked = c.select(F.col("summary").alias("consumer"), F.explode("asks").alias("status")).distinct()
    say = lambda what: F.concat(F.lit(what), F.coalesce(F.concat(F.lit(" "), F.col("status")), F.lit("")))
    out = [_finding(pairing.provider_coverage(providers, consumers, made, asked), 1, F.when(F.col("kind") == "lowConfidence", "Provider returns a status that is not known").otherwise(say("Provider status without a handler:")))]
    out.append(_finding(pairing.consumer_satisfaction(providers, consumers, made, asked), 2, say("Consumer expects a status that no path returns:")))
    contract = summaries.where("boundary_key is not null and role = 'provider'").select("boundary_key", F.explode(F.from_json(F.get_json_object("metadata", "$.http.declaredContract.responses"), "array<struct<statusCode:int,body:string>>")).alias("r"))
    declared = contract.select("boundary_key", F.col("r.statusCode").alias("status"), F.col("r.body").alias("declared_body"))
    out.append(_finding(pairing.contract_consistency(declared, consumers, asked), 3, F.when(F.col("reason") == "unhandled", say("Declared status without a handler:")).otherwise(say("Handled status that is not declared:"))))
    bodies = p.where("status is not null and body is not null").join(declared.where("declared_body is not null"), ["boundary_key", "status"]).withColumn("verdict", shapes.shape_match("body", "declared_body"))
    out.append(_finding(bodies.where(F.col("verdict") == lattice.NOMATCH), 3, say("Body does not match the declared one at status"), kind=F.lit("providerContractViolation"), severity=F.lit("error"), provider=F.col("summary")))
    responses = F.from_json(F.get_json_object("metadata", "$.http.declaredContract.responses"), "array<struct<statusCode:int,body:string>>")
    sources = summaries.where("boundary_key is not null").select("boundary_key", "summary", "src", "place", F.col("identity.name").alias("source"), responses.alias("r")).where("r is not null")
    said = sources.select("boundary_key", "summary", "source", "src", "place", F.posexplode_outer("r").alias("r_ord", "r")).select("boundary_key", "summary", "source", F.struct("src", "place", "r_ord").alias("place"), F.col("r.statusCode").alias("status"), F.col("r.body").alias("declared_body"))
    bound = said.where("status is not null")
    for stage, found in ((2, paths.sub_cases(p, c)), (4, paths.body_reads(p, c)), (4, paths.declared_body_reads(bound, c)), (5, paths.declared_bodies(bound))):
        out.append(_finding(found, stage, F.col("description")))
    differ = pairing.contract_agreement(said.select("boundary_key", "source", "status")).where("status is not null")
    out.append(_finding(differ, 5, say("Some sources declare a status and others don't:"), kind=F.lit("contractDisagreement"), severity=F.lit("warning")))
    out.append(_finding(_graphql(summaries), 5, F.col("description"), kind=F.lit("boundaryFieldUnknown"), severity=F.lit("warning"), consumer=F.col("operation")))
    out.append(_finding(_stories(summaries), 5, F.when(F.col("kind") == "scenarioCoverageGap", F.concat_ws(" ", F.lit("No story sets the input"), "arg", F.lit("of"), "component")).otherwise(F.concat_ws(" ", F.lit("Story sets an input that the component lacks:"), "arg")), consumer=F.coalesce("story", "component"), provider=F.col("component"), severity=F.lit("warning")))
    gaps = summaries.where("boundary_key is not null").select("boundary_key", F.col("summary").alias("provider"), F.explode("gaps").alias("g"))
    out.append(_finding(gaps, 3, F.col("g.description"), kind=F.lit("providerContractViolation"), severity=F.lit("error")))

    met = src.interactions(summaries)
    s = F.col("identity.boundaryBinding.semantics")
    table_name = lambda sys, scope, tbl: F.concat_ws("/", sys, F.nullif(scope, F.lit("default")), tbl)
    columns = summaries.where(s["name"] == "storage-relational").select(table_name(s["storageSystem"], s["scope"], s["table"]).alias("tbl"), F.explode(F.from_json(F.get_json_object("metadata", "$.storageContract.columns"), "array<struct<name:string>>")).alias("c")).select("tbl", F.col("c.name").alias("field"))
    touched = met.where("class = 'storage-access'").select(table_name(F.col("storageSystem"), F.col("scope"), F.col("tbl")).alias("tbl"), F.explode("fields").alias("field"), "mode")
    out.append(_finding(boundaries.relational_storage(columns, touched), 6, F.concat_ws(" ", F.lit("Column"), F.concat_ws(".", "tbl", "field"), F.col("aspect"))))

    runtime = summaries.where(s["name"] == "runtime-config")
    scope = F.get_json_object("metadata", "$.codeScope.path")
    runtimes = runtime.select(s["instanceName"].alias("runtime"), scope.alias("scope"))
    variables = runtime.select(s["instanceName"].alias("runtime"), F.explode(F.from_json(F.get_json_object("metadata", "$.runtimeContract.envVars"), "array<string>")).alias("variable"), F.from_json(F.get_json_object("metadata", "$.runtimeContract.platformVars"), "array<string>").alias("own")).select("runtime", "variable", F.coalesce(F.array_contains("own", F.col("variable")), F.lit(False)).alias("platform"))
    env = met.where("class = 'config-read'").select("file", "variable")
    out.append(_finding(boundaries.runtime_config(runtimes, variables, env), 5, F.concat_ws(" ", F.lit("Variable"), "variable", F.lit("of"), "runtime")))

    sent = met.where("class = 'message-send'").select("channel")
    queue = summaries.where(s["name"] == "message-bus")
    out.append(_finding(boundaries.message_bus(sent, queue.where("kind = 'consumer'").select(s["channel"].alias("channel")), queue.where("kind = 'library'").select(s["channel"].alias("channel"))), 7, F.concat_ws(" ", F.lit("Channel"), "channel")))
    return reduce(DataFrame.unionByName, out).withColumn("seq", F.xxhash64(*COLUMNS[1:]).bitwiseAND(F.lit((1 << 56) - 1)) + F.col("stage").cast("long") * (1 << 58))


def check_dir(spark: SparkSession, path: str, rules: DataFrame | None = None) -> DataFrame:
    """Findings over the JSON files of a folder: merged, and with rules (ord, kind, boundary, effect) suppressed."""
    merged = findings.dedupe(check_all(src.read(spark, path)))
    if rules is None:
        return merged.withColumn("effect", F.lit(None).cast("string")).withColumn("counts", F.lit(True))
    return findings.suppress(merged, rules)
