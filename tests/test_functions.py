"""Keys, three-valued results and shapes."""

import pytest
from pyspark.sql import functions as F

from driftlens.functions import keys, lattice, shapes


@pytest.mark.parametrize(
    ("raw", "want"),
    [("/Users/:id", "/users/{id}"), ("/Users/{Id}/", "/users/{Id}"), ("/", "/"), ("/a//", "/a/"), ("/A{b", "/a{b"), ("", ""), ("/x/:Key/Y", "/x/{Key}/y")],
)
def test_normalize_path(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "p string").select(keys.normalize_path(F.col("p"))).first()[0] == want


def test_boundary_key(spark):
    schema = "sem struct<name:string,method:string,path:string,type_name:string,field_name:string,package:string,export_path:array<string>>"
    rows = [(("rest", "get", "/A/:b", None, None, None, None),), (("graphql-resolver", None, None, "Query", "f", None, None),), (("function-call", None, None, None, None, "p", ["a", "b"]),), (("storage-relational", None, None, None, None, None, None),), (("function-call", None, None, None, None, None, None),)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(keys.boundary_key(F.col("sem"))).collect()]
    assert got == ["GET /a/{b}", "gql:Query.f", "fn:p::a.b", None, None]


def test_rule_boundary_without_space_is_upper_case(spark):
    got = [r[0] for r in spark.createDataFrame([("get /A/:b/",), ("gql:Query.f",)], "r string").select(keys.rule_boundary(F.col("r"))).collect()]
    assert got == ["GET /a/{b}", "GQL:QUERY.F"]


def test_lattice(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "x int")
    assert df.agg(lattice.all_of(F.col("x")), lattice.any_of(F.col("x"))).first() == (0, 2)
    assert df.where("x > 9").agg(lattice.all_of(F.col("x")), lattice.any_of(F.col("x"))).first() == (2, 0)
    assert [r[0] for r in df.orderBy("x").select(lattice.name(F.col("x"))).collect()] == ["nomatch", "unknown", "match"]


T = {k: {"type": k} for k in ("text", "integer", "number", "boolean", "null", "undefined", "unknown")}
rec = lambda spreads=False, **p: {"type": "record", "properties": p} | ({"spreads": True} if spreads else {})
union = lambda *v: {"type": "union", "variants": list(v)}
lit = lambda v: {"type": "literal", "value": v}


@pytest.mark.parametrize(
    ("actual", "declared", "want"),
    [
        (T["text"], T["text"], 2), (T["integer"], T["number"], 2), (T["number"], T["integer"], 0), (T["unknown"], T["text"], 1), (T["text"], T["unknown"], 1),
        ({"type": "ref", "name": "A"}, {"type": "ref", "name": "A"}, 2), ({"type": "ref", "name": "A"}, T["text"], 1), (union(T["text"], T["null"]), T["text"], 0),
        (T["text"], union(T["text"], T["null"]), 2), (rec(a=T["text"], b=T["text"]), rec(a=T["text"]), 2), (rec(a=T["text"]), rec(a=T["text"], b=T["text"]), 0),
        (rec(a=T["text"]), rec(a=T["text"], b=union(T["text"], T["undefined"])), 2), (rec(True, a=T["text"]), rec(b=T["text"]), 1), (lit("x"), T["text"], 2), (lit(1), T["number"], 2),
        (lit(True), T["number"], 0), (T["text"], lit("x"), 0), (lit("x"), lit("y"), 0), (lit(2.0), T["integer"], 2), (lit(2.5), T["integer"], 0), (lit(1), lit(1.0), 2), (lit(1), lit(True), 0), (lit(None), T["null"], 0), ({"type": "array", "items": T["integer"]}, {"type": "array", "items": T["number"]}, 2),
        ({"type": "dictionary", "values": T["text"]}, {"type": "dictionary", "values": T["number"]}, 0), (rec(a=T["unknown"], b=T["text"]), rec(a=T["text"], b=T["number"]), 0),
        (rec(a=T["text"], b=lit("x")), {"type": "dictionary", "values": T["text"]}, 2), (rec(a=T["text"], b=T["null"]), {"type": "dictionary", "values": T["text"]}, 0), (rec(True, a=T["null"]), {"type": "dictionary", "values": T["text"]}, 1),
        (rec(), {"type": "dictionary", "values": T["text"]}, 2), ({"type": "dictionary", "values": T["text"]}, rec(a=T["text"]), 1), ({"type": "dictionary", "values": T["text"]}, T["text"], 0), (T["text"], {"type": "dictionary", "values": T["text"]}, 0),
    ],
)
def test_match(actual, declared, want):
    assert shapes.match(actual, declared) == want


def test_covers_and_optional_reads():
    optional = union(rec(c=T["text"]), T["undefined"])
    assert shapes.covers(rec(a=optional), rec(a=rec(c=T["unknown"]))) == 2
    assert shapes.covers(rec(a=T["text"]), rec(b=T["unknown"])) == 0
    assert shapes.covers(rec(True, a=T["text"]), rec(b=T["unknown"])) == 1
    assert shapes.covers({"type": "dictionary", "values": T["text"]}, rec(b=T["unknown"])) == 2
    assert shapes.optional_reads(rec(a=optional), rec(a=rec(c=T["unknown"]))) == ["a"]
    assert shapes.optional_reads(rec(x=rec(y=union(T["text"], T["undefined"]))), rec(x=rec(y=T["unknown"]))) == ["x.y"]
