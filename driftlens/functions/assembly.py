"""Raw structures of code to the parts of a summary, as column expressions: a row map without shuffles or Python.

A raw condition is a struct (structured: JSON or null, sourceText, polarity); a raw terminal a struct (kind, statusCode: (type,
value, sourceText) or null, body: (shape: JSON, typeText) or null, exceptionType, target: what it renders, delegates to or emits).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import keys

#: Fixed value: terminals that name a target, which is "unknown" where it isn't given.
TARGETED = ("render", "delegate", "emit")
KEEP_NULLS = {"ignoreNullFields": "false"}


def condition(c: Column) -> Column:
    """A condition as JSON: its structure, else its source text as opaque; negated where its polarity is negative."""
    opaque = F.to_json(F.struct(F.lit("opaque").alias("type"), c["sourceText"].alias("sourceText"), F.lit("complexExpression").alias("reason")))
    pred = F.coalesce(c["structured"], opaque)
    return F.when(c["polarity"] == "negative", F.concat(F.lit('{"type":"negation","operand":'), pred, F.lit("}"))).otherwise(pred)


def _ref(name: Column) -> Column:
    return F.to_json(F.struct(F.lit("ref").alias("type"), name.alias("name")))


def output(t: Column) -> Column:
    """What a path ends with; a throw with a status is a response, as its caller sees one."""
    code, literal = t["statusCode"], t["statusCode"]["type"] == "literal"
    status = F.struct(F.when(literal, "literal").otherwise("unresolved").alias("type"), F.when(literal, code["value"]).alias("value"), F.when(~literal, code["sourceText"]).alias("sourceText"))
    body = F.coalesce(t["body"]["shape"], F.when(t["body"]["typeText"].isNotNull(), _ref(t["body"]["typeText"])))
    kind = F.when((t["kind"] == "throw") & code.isNotNull(), "response").otherwise(t["kind"])
    return F.struct(
        kind.alias("type"), F.when((kind == "response") & code.isNotNull(), status).alias("statusCode"), F.when(kind.isin("response", "return"), body).alias("body"),
        F.when(kind == "throw", t["exceptionType"]).alias("exceptionType"), F.when(kind.isin(*TARGETED), F.coalesce(t["target"], F.lit("unknown"))).alias("target"),
    )


def path_id(name: Column, t: Column, conditions: Column) -> Column:
    """The stable id of a path: its unit, kind of end, status, and the order and polarity of its conditions."""
    code = t["statusCode"]
    number = F.when(code["value"] == F.floor(code["value"]), F.floor(code["value"]).cast("string")).otherwise(code["value"].cast("string"))
    status = F.when(code["type"] == "literal", number).when(code.isNotNull(), F.concat(F.lit("dyn:"), code["sourceText"]))
    return keys.transition_id(name, t["kind"], status, F.array_join(F.transform(conditions, lambda c: F.concat_ws(":", c["polarity"], c["sourceText"])), ";"))


def parameter(p: Column) -> Column:
    """A raw parameter (name, position, role, typeText) as an input in JSON; a type that isn't given or empty has a null shape."""
    shape = F.when(p["typeText"] != "", F.struct(F.lit("ref").alias("type"), p["typeText"].alias("name")))
    return F.to_json(F.struct(F.lit("parameter").alias("type"), p["name"].alias("name"), p["position"].alias("position"), p["role"].alias("role"), shape.alias("shape")), KEEP_NULLS)


def _object(**parts: Column) -> Column:
    """A JSON object of JSON texts without those that are null; null if none is left."""
    held = F.array_join(F.array_compact(F.array(*(F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()))), ",")
    return F.when(held != "", F.concat(F.lit("{"), held, F.lit("}")))


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def metadata(raw: dict[str, Column]) -> Column:
    """Metadata by family: http of declared_contract (JSON) and accessors, where there are any, graphql of document, schema and contract (JSON)."""
    names = lambda c: F.when(F.size(c) > 0, F.to_json(c))
    http = _object(declaredContract=raw["declared_contract"], bodyAccessors=names(raw["body_accessors"]), statusAccessors=names(raw["status_accessors"]))
    graphql = _object(document=_quoted(raw["graphql_document"]), schemaSdl=_quoted(raw["graphql_schema"]), declaredContract=raw["graphql_contract"])
    return _object(http=http, graphql=graphql)


def level(conditions: Column) -> Column:
    """Confidence of a unit by all its conditions: high if each has a structure, medium if under half lack one, else low."""
    lost = F.size(F.filter(conditions, lambda c: c["structured"].isNull()))
    return F.when(lost == 0, "high").when(2 * lost < F.size(conditions), "medium").otherwise("low")


def assemble(raw: DataFrame) -> DataFrame:
    """Raw units (name, parameters, branches of (conditions, terminal, isDefault, expectedInput), metadata's columns) with inputs, transitions, level and metadata in their place.

    Other columns stay. Gaps compare units with their contracts: operators.pairing.gaps. Null arrays count as empty.
    """
    none = lambda c: F.coalesce(F.col(c), F.from_json(F.lit("[]"), raw.schema[c].dataType))
    path = lambda b: F.struct(path_id(F.col("name"), b["terminal"], b["conditions"]).alias("id"), F.transform(b["conditions"], condition).alias("conditions"), output(b["terminal"]).alias("output"), b["isDefault"].alias("isDefault"), b["expectedInput"].alias("expectedInput"))
    parts = ("declared_contract", "body_accessors", "status_accessors", "graphql_document", "graphql_schema", "graphql_contract")
    used = ("parameters", "branches", *parts)
    return raw.select(
        *(c for c in raw.columns if c not in used), F.transform(none("parameters"), parameter).alias("inputs"), F.transform(none("branches"), path).alias("transitions"),
        level(F.flatten(F.transform(none("branches"), lambda b: b["conditions"]))).alias("level"), metadata({c: F.col(c) for c in parts}).alias("metadata"),
    )
