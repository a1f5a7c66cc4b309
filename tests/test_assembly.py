"""Parts of summaries from raw structures."""

import hashlib
import json

from driftlens.functions.assembly import assemble

SCHEMA = """name string, parameters array<struct<name:string,position:int,role:string,typeText:string>>,
branches array<struct<conditions:array<struct<structured:string,sourceText:string,polarity:string>>,terminal:struct<kind:string,statusCode:struct<type:string,value:double,sourceText:string>,body:struct<shape:string,typeText:string>,exceptionType:string,target:string>,isDefault:boolean,expectedInput:string>>,
declared_contract string, body_accessors array<string>, status_accessors array<string>, graphql_document string, graphql_schema string, graphql_contract string"""


def end(kind, status=None, shape=None, type_text=None, exception=None, target=None):
    return kind, status, (shape, type_text) if shape or type_text else None, exception, target


def unit(name="f", parameters=(), ends=(), conditions=(), **more):
    more = {"declared_contract": None, "body_accessors": None, "status_accessors": None, "graphql_document": None, "graphql_schema": None, "graphql_contract": None} | more
    return (name, list(parameters), [(list(conditions), e, False, None) for e in ends], *more.values())


def test_ends(spark):
    literal, dynamic = ("literal", 404.0, None), ("dynamic", None, "code")
    ends = [end("response", literal, '{"type":"text"}'), end("response", dynamic), end("throw", literal), end("throw", exception="Gone"), end("render"), end("emit", target="saved"), end("return", type_text="User"), end("void")]
    row = assemble(spark.createDataFrame([unit(ends=ends)], SCHEMA)).first()
    got = [t.output.asDict(recursive=True) for t in row.transitions]
    assert [g["type"] for g in got] == ["response", "response", "response", "throw", "render", "emit", "return", "void"]
    assert got[0]["statusCode"] == {"type": "literal", "value": 404.0, "sourceText": None} and got[0]["body"] == '{"type":"text"}'
    assert got[1]["statusCode"] == {"type": "unresolved", "value": None, "sourceText": "code"}
    assert got[2]["statusCode"]["value"] == 404.0 and got[3]["exceptionType"] == "Gone"
    assert got[4]["target"] == "unknown" and got[5]["target"] == "saved" and json.loads(got[6]["body"]) == {"type": "ref", "name": "User"}
    empty = hashlib.sha1(b"").hexdigest()[:7]
    assert [t.id for t in row.transitions][:4] == [f"f:response:404:{empty}", f"f:response:dyn:code:{empty}", f"f:throw:404:{empty}", f"f:throw:none:{empty}"]
    assert row.level == "high" and row.metadata is None


def test_conditions_and_inputs(spark):
    known = '{"type":"truthinessCheck"}'
    conditions = [(known, "a", "negative"), (None, 'x "y"', "positive")]
    row = assemble(spark.createDataFrame([unit(parameters=[("id", 0, "path", "string"), ("rest", 1, "other", "")], ends=[end("void")], conditions=conditions)], SCHEMA)).first()
    first, second = (json.loads(c) for c in row.transitions[0].conditions)
    assert first == {"type": "negation", "operand": json.loads(known)} and second == {"type": "opaque", "sourceText": 'x "y"', "reason": "complexExpression"}
    assert row.transitions[0].id.endswith(hashlib.sha1(b'negative:a;positive:x "y"').hexdigest()[:7])
    assert [json.loads(i)["shape"] for i in row.inputs] == [{"type": "ref", "name": "string"}, None]
    assert row.level == "low"  # half of them


def test_metadata_and_nulls(spark):
    told = unit(declared_contract='{"responses":[]}', body_accessors=["data"], status_accessors=[], graphql_document='query { "a" }')
    rows = assemble(spark.createDataFrame([told, ("g", None, None, None, None, None, None, None, None)], SCHEMA)).collect()
    assert json.loads(rows[0].metadata) == {"http": {"declaredContract": {"responses": []}, "bodyAccessors": ["data"]}, "graphql": {"document": 'query { "a" }'}}
    assert rows[1].transitions == [] and rows[1].inputs == [] and rows[1].metadata is None and rows[1].level == "high"
