"""Summaries as text."""

import json

from driftlens.functions import render

TRUTH = {"type": "truthinessCheck", "subject": {"type": "input", "inputRef": "user", "path": []}, "negated": False}
NOT = {"type": "negation", "operand": TRUTH}
response = lambda n, *keys: {"type": "response", "statusCode": {"type": "literal", "value": n}, "body": {"type": "record", "properties": {k: {"type": "text"} for k in keys}} if keys else None}


def test_bodies_and_outputs():
    assert render.output_text(response(200, "id", "name")) == "200 { id, name }"
    assert render.output_text(response(200, *"abcdef")) == "200 { a, b, c, d, ... }"
    assert render.output_text({"type": "response", "statusCode": None, "body": None}) == "???"
    assert render.output_text({"type": "throw", "exceptionType": None}) == "throw Error"
    assert render.output_text({"type": "return", "value": {"type": "array", "items": {"type": "ref", "name": "User"}}}) == "return [User]"
    assert render.output_text({"type": "void"}) == "void"


def test_shapes_without_keys():
    shape = lambda t, **more: {"type": t, **more}
    named = {"text": "string", "integer": "int", "number": "number", "boolean": "bool", "null": "null", "undefined": "undefined", "unknown": "any"}
    assert {k: render.body_text(shape(k)) for k in named} == named
    assert render.body_text(shape("array", items=shape("unknown"))) == "[any]"
    assert render.body_text(shape("dictionary", values=shape("integer"))) == "{ [key]: int }"
    assert render.body_text(shape("union", variants=[shape("text"), shape("literal", value="é")])) == 'string | "é"'
    assert render.body_text(None) == ""


def test_tree(spark):
    t = [{"conditions": [NOT], "output": response(404)}, {"conditions": [TRUTH, NOT], "output": response(500)}, {"conditions": [TRUTH], "output": response(200)}, {"conditions": [NOT], "output": response(410)}]
    df = spark.createDataFrame([("a", json.dumps(t)), ("b", None)], "summary string, transitions string")
    got = {r.summary: r.text for r in render.render(df).collect()}
    assert got == {"a": "if !user:\n  -> 404\nelif user:\n  if !user:\n    -> 500\n  else:\n    -> 200", "b": ""}
