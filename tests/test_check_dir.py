"""Summaries from files to findings."""

import json

import pytest

from driftlens.functions import predicates
from driftlens.plans.check_dir import check_dir
from driftlens.sources import summaries as src

STATUS = {"type": "derived", "from": {"type": "dependency", "name": "fetch", "accessChain": []}, "derivation": {"type": "propertyAccess", "property": "status"}}
eq = lambda n: {"type": "comparison", "op": "eq", "left": STATUS, "right": {"type": "literal", "value": n}}


def summary(kind, name, transitions, semantics, metadata=None, file=None):
    return {"kind": kind, "location": {"file": file or f"src/{name}.ts", "range": {"start": 1, "end": 9}, "exportName": name}, "identity": {"name": name, "exportPath": None, "boundaryBinding": {"transport": "http", "recognition": "x", "semantics": semantics}}, "inputs": [], "transitions": transitions, "gaps": [], "confidence": {"source": "inferred_static", "level": "high"}, "metadata": metadata or {}}


def path(i, conditions=(), status=None, default=False, effects=(), **more):
    out = {"type": "response", "statusCode": {"type": "literal", "value": status}, "body": more.get("body")} if status else {"type": "void"}
    return {"id": i, "conditions": list(conditions), "output": out, "effects": list(effects), "isDefault": default, "expectedInput": more.get("reads")}


def interaction(cls, semantics, **more):
    return {"type": "interaction", "binding": {"transport": "x", "recognition": "x", "semantics": semantics}, "interaction": {"class": cls, **more}}


REST = {"name": "rest", "method": "get", "path": "/users/:id"}
USER = {"name": "storage-relational", "storageSystem": "postgres", "scope": "default", "table": "User"}


def folder(tmp_path):
    body = {"type": "record", "properties": {"id": {"type": "integer"}}}
    reads = {"type": "record", "properties": {"name": {"type": "unknown"}}}
    provider = summary("handler", "getUser", [path("a", status=200, default=True, body=body), path("b", status=404), path("c", status=503)], REST)
    client = summary("client", "loadUser", [path("x", [eq(200)], reads=reads), path("y", [{"type": "negation", "operand": eq(404)}]), path("z", [eq(500)])], {**REST, "path": "/users/{id}"})
    table = summary("library", "User", [], USER, {"storageContract": {"columns": [{"name": "id"}, {"name": "email"}, {"name": "old"}]}})
    access = summary("caller", "find", [path("q", effects=[interaction("storage-access", USER, kind="read", fields=["id", "email", "emial"])])], {"name": "function-call"})
    (tmp_path / "a.json").write_text(json.dumps([provider, client]))
    (tmp_path / "b.json").write_text(json.dumps([table, access]))
    (tmp_path / "nested").mkdir()
    (tmp_path / "nested" / "c.json").write_text("[1]")
    return str(tmp_path)


def test_check_dir(spark, tmp_path):
    where = folder(tmp_path)
    got = sorted((r.kind, r.severity, r.description) for r in check_dir(spark, where).collect())
    assert got == [
        ("boundaryFieldUnknown", "error", "Column postgres/User.emial read"),
        ("boundaryFieldUnused", "warning", "Column postgres/User.old unused"),
        ("deadConsumerBranch", "warning", "Consumer expects a status that no path returns: 500"),
        ("unhandledProviderCase", "error", "Consumer reads a field that the body lacks at status 200"),
        ("unhandledProviderCase", "error", "Provider status without a handler: 503"),
    ]
    rules = spark.createDataFrame([(1, "unhandledProviderCase", "GET /users/{id}", "hide")], "ord int, kind string, boundary string, effect string")
    assert {r.kind for r in check_dir(spark, where, rules).collect()} == {"boundaryFieldUnknown", "boundaryFieldUnused", "deadConsumerBranch"}


def test_broken_files_stop_the_read(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"kind": "nonsense"}]))
    with pytest.raises(ValueError, match="not summaries"):
        src.read(spark, str(tmp_path))


def test_predicates():
    ref = {"type": "input", "inputRef": "a", "path": ["b"]}
    truth = {"type": "truthinessCheck", "subject": ref, "negated": False}
    assert predicates.text({"type": "negation", "operand": truth}) == "!a.b"
    assert predicates.text({"type": "negation", "operand": {"type": "negation", "operand": truth}}) == "a.b"
    assert predicates.text({"type": "negation", "operand": eq(1)}) == "!(fetch().status === 1)"
    assert predicates.text({"type": "compound", "op": "or", "operands": [truth, {"type": "nullCheck", "subject": ref, "negated": True}]}) == "a.b || a.b != null"
    assert predicates.text({"type": "opaque", "sourceText": " f(\n x ) "}) == "f( x )"
    assert predicates.inputs({"type": "compound", "op": "and", "operands": [truth, eq(3)]}) == ["a"]
    assert predicates.unclear({"type": "negation", "operand": {"type": "opaque", "sourceText": "?"}}) and not predicates.unclear(truth)
    assert predicates.statuses({"type": "compound", "op": "or", "operands": [eq(200), {"type": "negation", "operand": eq(404)}]}) == [200, 404]


def found(spark, tmp_path, *records):
    (tmp_path / "all.json").write_text(json.dumps(records))
    return {(r.kind, r.severity, r.description) for r in check_dir(spark, str(tmp_path)).collect()}


TRUTH = {"type": "truthinessCheck", "subject": {"type": "input", "inputRef": "flag", "path": []}, "negated": False}
RECORD = lambda **fields: {"type": "record", "properties": fields}
INT = {"type": "integer"}


def test_cases_of_one_status(spark, tmp_path):
    two = [path("a", [TRUTH], status=200), path("b", status=200, default=True)]
    one_branch = summary("client", "plain", [path("x", [eq(200)])], REST)
    unsure = summary("client", "unsure", [path("x", [eq(200), {"type": "opaque", "sourceText": "?"}])], REST)
    same = summary("client", "same", [path("x", [eq(200), TRUTH])], REST)
    got = found(spark, tmp_path, summary("handler", "get", two, REST), one_branch, unsure, same)
    assert got == {
        ("unhandledProviderCase", "warning", "Status 200 has 2 cases that the consumer takes for one: path a"),
        ("lowConfidence", "info", "Status 200 has cases that can't be compared with the consumer's branches: path a"),
    }


def test_single_paths_are_no_cases(spark, tmp_path):
    got = found(spark, tmp_path, summary("handler", "get", [path("a", [TRUTH], status=200), path("b", status=404)], REST), summary("client", "c", [path("x", [eq(200)]), path("y", [eq(404)])], REST))
    assert got == set()


def test_reads_of_bodies(spark, tmp_path):
    body = RECORD(id=INT, note={"type": "union", "variants": [{"type": "text"}, {"type": "undefined"}]})
    provider = summary("handler", "get", [path("a", status=200, default=True, body=body)], REST)
    wrapped = summary("client", "wrapped", [path("x", [eq(200)], reads=RECORD(body=RECORD(note={"type": "unknown"})))], REST)
    default = summary("client", "default", [path("y", default=True, reads=RECORD(gone={"type": "unknown"}))], REST)
    assert found(spark, tmp_path, provider, wrapped, default) == {
        ("consumerContractViolation", "info", "Consumer reads note that the provider may leave out at status 200"),
        ("unhandledProviderCase", "error", "Consumer reads a field that the body lacks at status 200 in the default branch"),
    }


def test_declared_sources(spark, tmp_path):
    contract = lambda *r: {"http": {"declaredContract": {"framework": "x", "responses": [{"statusCode": s, "body": b} for s, b in r]}}}
    one = summary("library", "one", [path("a", status=200, default=True)], REST, contract((200, RECORD(id=INT)), (404, None)))
    two = summary("library", "two", [path("a", status=200, default=True)], REST, contract((200, RECORD(id={"type": "text"}))))
    client = summary("client", "c", [path("x", default=True, reads=RECORD(name={"type": "unknown"})), path("y", [eq(404)])], REST)
    got = found(spark, tmp_path, one, two, client)
    assert ("contractDisagreement", "warning", "Some sources declare a status and others don't: 404") in got
    assert ("contractDisagreement", "warning", "Sources declare bodies that don't match at status 200") in got
    assert ("consumerContractViolation", "warning", "Consumer reads a field that the contract doesn't declare at status 200") in got
    assert not any("status and others don't: 200" in d for _, _, d in got)


def test_stories(spark, tmp_path):
    flag = {"type": "parameter", "name": "flag"}
    button = {**summary("component", "Button", [path("a", [TRUTH]), path("b", default=True)], REST), "inputs": [flag]}
    button["identity"]["boundaryBinding"] = None
    story = lambda name, args: {**summary("component", name, [], REST, {"component": {"storybook": {"component": "Button", "args": args}}}), "identity": {"name": name, "exportPath": None, "boundaryBinding": None}}
    bare = found(spark, tmp_path, button, story("Plain", {}), story("Wide", {"width": 3}))
    assert bare == {("scenarioCoverageGap", "warning", "No story sets the input flag of Button"), ("boundaryFieldUnknown", "warning", "Story sets an input that the component lacks: width")}
    assert found(spark, tmp_path, button, story("On", {"flag": True})) == set()


def test_graphql_operations(spark, tmp_path):
    sdl = "type Query { user: User! } type User { id: ID name: String pet: Pet } type Pet { name: String owner: User }"
    resolver = summary("resolver", "user", [path("a", default=True)], {"name": "graphql-resolver", "typeName": "Query", "fieldName": "user"}, {"graphql": {"schemaSdl": sdl}})
    operation = lambda name, document: summary("client", name, [path("a", default=True)], {"name": "graphql-operation", "operationType": "query"}, {"graphql": {"document": document}})
    deep = operation("deep", "query Q { user { id pet { owner { pet { age } nick } } } gone { id } }")
    fine = operation("fine", "{ user { id pet { name owner { name } } } }")
    assert found(spark, tmp_path, resolver, deep, fine) == {
        ("boundaryFieldUnknown", "warning", "No resolver for Query.gone"),
        ("boundaryFieldUnknown", "warning", "The schema lacks Pet.age"),
        ("boundaryFieldUnknown", "warning", "The schema lacks User.nick"),
    }
