"""Behavioral summaries: the JSON files that hold them, and the flat tables that checks work on.

A file is an array of summaries. Recursive parts (conditions, shapes) stay JSON text in string columns; all else is typed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, predicates
from ..session import checkpointed

# Kinds of code units by their side of a boundary.
PROVIDER_KINDS = ("handler", "loader", "action", "middleware", "resolver", "worker", "component", "hook", "library")
CONSUMER_KINDS = ("client", "consumer", "caller")

BINDING = """struct<transport:string,recognition:string,semantics:struct<name:string,method:string,path:string,typeName:string,fieldName:string,package:string,
exportPath:array<string>,storageSystem:string,scope:string,`table`:string,messageBus:string,channel:string,deploymentTarget:string,instanceName:string,operationType:string,operationName:string,declaredResponses:array<int>>>""".replace("\n", "")
EFFECT = f"struct<type:string,callee:string,binding:{BINDING},interaction:struct<class:string,kind:string,fields:array<string>,name:string,defaulted:boolean,body:string>>"
TRANSITION = f"struct<id:string,conditions:array<string>,output:struct<type:string,statusCode:struct<type:string,value:double,sourceText:string>,body:string,exceptionType:string>,effects:array<{EFFECT}>,isDefault:boolean,expectedInput:string>"
SCHEMA = f"""kind string, location struct<file:string,range:struct<start:int,end:int>,exportName:string>, identity struct<name:string,exportPath:array<string>,boundaryBinding:{BINDING}>,
inputs array<string>, transitions array<{TRANSITION}>, gaps array<struct<type:string,description:string>>, confidence struct<source:string,level:string>, metadata string, _bad string""".replace("\n", " ")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of the JSON files directly in a folder, or of one file; files in order of name, records as they stand.

    ord numbers them by file and place; src is the file. Records that break the schema stop the read, with the first ten.
    """
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(path)
    raw = raw.withColumn("src", F.input_file_name()).withColumn("place", F.monotonically_increasing_id())
    broken = F.col("_bad").isNotNull() | F.col("kind").isNull() | ~F.col("kind").isin(*PROVIDER_KINDS, *CONSUMER_KINDS) | F.col("identity.name").isNull() | F.col("location.file").isNull()
    raw = checkpointed(raw)  # parsed once, and read anew whenever the folder is
    wrong = raw.where(broken).select("src", F.coalesce("_bad", "identity.name", "kind").alias("what")).limit(10).collect()
    if wrong:
        raise ValueError("not summaries: " + "; ".join(f"{r.src}: {r.what}" for r in wrong))
    return raw.drop("_bad").withColumn("summary", F.concat_ws("::", "location.file", "identity.name")).withColumn("role", F.when(F.col("kind").isin(*PROVIDER_KINDS), "provider").otherwise("consumer")).withColumn("boundary_key", binding_key(F.col("identity.boundaryBinding.semantics")))


def binding_key(s: Column) -> Column:
    return (
        F.when((s["name"] == "rest") & s["path"].isNotNull(), keys.rest_key(s["method"], s["path"]))
        .when(s["name"] == "graphql-resolver", F.concat(F.lit("gql:"), s["typeName"], F.lit("."), s["fieldName"]))
        .when((s["name"] == "function-call") & s["package"].isNotNull() & (F.size(s["exportPath"]) > 0), F.concat(F.lit("fn:"), s["package"], F.lit("::"), F.array_join(s["exportPath"], ".")))
    )


def _accessors(of: str, *default: str) -> Column:
    """Names of the properties that a summary reads the status or the body of a response by."""
    named = F.from_json(F.get_json_object("metadata", f"$.http.{of}Accessors"), "array<string>")
    return F.when(F.size(named) > 0, named).otherwise(F.array(*(F.lit(x) for x in default)))


def transitions(summaries: DataFrame) -> DataFrame:
    """One row for each path of execution: its literal status, whether the status is unclear, and the statuses that it asks for."""
    t = summaries.select("summary", "role", "boundary_key", _accessors("status", *predicates.DEFAULT_STATUS).alias("accessors"), _accessors("body", "body").alias("body_accessors"), F.posexplode("transitions").alias("t_ord", "t"))
    out, code = F.col("t.output"), F.col("t.output.statusCode")
    response = out["type"] == "response"
    return t.select(
        "summary", "role", "boundary_key", "accessors", "body_accessors", "t_ord", F.col("t.id").alias("transition"), F.col("t.isDefault").alias("is_default"),
        F.when(response & (code["type"] == "literal"), code["value"].cast("int")).alias("status"), F.coalesce(response & code.isNotNull() & (code["type"] != "literal"), F.lit(False)).alias("opaque"),
        out["body"].alias("body"), F.col("t.expectedInput").alias("expected_input"), F.col("t.conditions").alias("conditions"),
        predicates.condition_statuses(F.coalesce("t.conditions", F.array().cast("array<string>")), F.col("accessors")).alias("asks"),
    )


def interactions(summaries: DataFrame) -> DataFrame:
    """One row for each interaction with another boundary."""
    t = summaries.select("summary", F.col("location.file").alias("file"), F.explode("transitions").alias("t")).select("summary", "file", F.col("t.id").alias("transition"), F.explode("t.effects").alias("e")).where("e.type = 'interaction'")
    return t.select("summary", "file", "transition", "e.callee", F.col("e.interaction").alias("i"), F.col("e.binding.semantics").alias("s")).select("summary", "file", "transition", "callee", F.col("i.class").alias("class"), F.col("i.kind").alias("mode"), "i.fields", F.col("i.name").alias("variable"), "i.body", "s.storageSystem", "s.scope", F.col("s.table").alias("tbl"), "s.channel")


def write_findings(findings: DataFrame, path: str) -> None:
    """As JSON lines, in order of place."""
    findings.orderBy("seq").write.mode("overwrite").json(path)
