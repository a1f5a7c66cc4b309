"""Checks on small hand-made sides."""

from driftlens.operators import boundaries, findings, pairing


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def sides(spark, provider, consumer, default=False):
    p = spark.createDataFrame([("k", 1)], "boundary_key string, provider int")
    c = spark.createDataFrame([("k", 9, default)], "boundary_key string, consumer int, has_default boolean")
    ps = spark.createDataFrame([(1, s, s is None) for s in provider], "provider int, status int, opaque boolean")
    return p, c, ps, spark.createDataFrame([(9, s) for s in consumer], "consumer int, status int")


def test_coverage(spark):
    assert rows(pairing.provider_coverage(*sides(spark, [200, 404], [200, 404])), "status") == []
    assert rows(pairing.provider_coverage(*sides(spark, [200, 503], [200])), "status", "kind", "severity") == [(503, "unhandledProviderCase", "error")]
    assert rows(pairing.provider_coverage(*sides(spark, [201, 404], [], default=True)), "status") == [(404,)]  # a default handles 2xx alone
    assert rows(pairing.provider_coverage(*sides(spark, [None], [200])), "kind", "severity") == [("lowConfidence", "info")]


def test_satisfaction(spark):
    assert rows(pairing.consumer_satisfaction(*sides(spark, [200], [200, 404])), "status", "kind") == [(404, "deadConsumerBranch")]
    assert rows(pairing.consumer_satisfaction(*sides(spark, [200, None], [404])), "status", "kind") == [(404, "lowConfidence")]


def test_pairing_keeps_unbound_records_apart(spark):
    p = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "boundary_key string, provider int")
    c = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3)], "boundary_key string, consumer int")
    got = {(r.boundary_key, r.state, r.n_pairs) for r in pairing.pairing_report(p, c).collect()}
    assert got == {("a", "paired", 2), ("b", "unmatched_providers", 0), ("c", "unmatched_consumers", 0), (None, "no_binding", 0)}


def test_storage(spark):
    declared = spark.createDataFrame([("User", f) for f in ("id", "email", "name", "deletedAt")] + [("Post", f) for f in ("id", "title", "authorId")], "tbl string, field string")
    accesses = spark.createDataFrame([("User", f, "read") for f in ("id", "email", "name", "emial")] + [("Post", f, "write") for f in ("title", "authorId", "bdoy")] + [("Elsewhere", "x", "read")], "tbl string, field string, mode string")
    got = rows(boundaries.relational_storage(declared, accesses), "tbl", "field", "aspect")
    assert got == [("Post", "authorId", "write-only"), ("Post", "bdoy", "write"), ("Post", "id", "unused"), ("Post", "title", "write-only"), ("User", "deletedAt", "unused"), ("User", "emial", "read")]
    star = spark.createDataFrame([("User", "*", "read")], "tbl string, field string, mode string")
    assert {t for (t,) in rows(boundaries.relational_storage(declared, star), "tbl")} == {"Post"}


def test_runtime_config(spark):
    runtimes = spark.createDataFrame([("Checkout", "src/checkout/"), ("Hook", "src/hook/"), ("Lost", None)], "runtime string, scope string")
    provided = spark.createDataFrame([("Checkout", "STRIPE_KEY", False), ("Checkout", "DATABASE_URL", False), ("Checkout", "AWS_REGION", True), ("Hook", "SECRET", False)], "runtime string, variable string, platform boolean")
    reads = spark.createDataFrame([("src/checkout/a.ts", "STRIPE_API_KEY"), ("src/checkout/b/c.ts", "DATABASE_URL"), ("src/hook/x.ts", "SECRET"), ("src/hookx/x.ts", "NO")], "file string, variable string")
    got = rows(boundaries.runtime_config(runtimes, provided, reads).na.fill("-"), "runtime", "variable", "kind")
    assert got == [("Checkout", "STRIPE_API_KEY", "boundaryFieldUnknown"), ("Checkout", "STRIPE_KEY", "boundaryFieldUnused"), ("Lost", "-", "runtimeScopeUnknown")]


def test_message_bus(spark):
    one = lambda *c: spark.createDataFrame([(x,) for x in c], "channel string")
    got = rows(boundaries.message_bus(one("Orders", "Orphan"), one("Orders", "Notes"), one("Orders", "Idle", "Notes")), "channel", "kind")
    assert got == [("Idle", "messageBusUnused"), ("Notes", "messageBusConsumerOrphan"), ("Orphan", "messageBusProducerOrphan")]
    sent = spark.createDataFrame([("Orders", "id"), ("Orders", "total"), ("Orphan", None)], "channel string, field string")
    received = spark.createDataFrame([("Orders", "id"), ("Orders", "totalAmount"), ("Orphan", "x")], "channel string, field string")
    assert rows(boundaries.message_bodies(sent, received), "channel", "field") == [("Orders", "totalAmount")]


def test_component_stories(spark):
    components = spark.createDataFrame([("B", 1, ["old"], ["old"]), ("B", 2, ["label", "busy"], ["busy"])], "component string, ord int, inputs array<string>, gating array<string>")
    stories = spark.createDataFrame([("B", "s1", "label"), ("B", "s1", "lable")], "component string, story string, arg string")
    assert rows(boundaries.component_stories(components, stories), "arg", "kind") == [("busy", "scenarioCoverageGap"), ("lable", "boundaryFieldUnknown")]


FINDINGS = "seq int, kind string, boundary_key string, description string, consumer string, transition string, provider string, severity string"


def test_dedupe_keeps_first_row_worst_severity_and_sources(spark):
    f = spark.createDataFrame([(2, "k", "b", "x  y", "c", "t", "p2", "error"), (1, "k", "b", "x y ", "c", "t", "p1", "info"), (3, "k", None, "x y", "c", "t", "p1", "info")], FINDINGS)
    got = {r.seq: (r.description, r.severity, r.sources) for r in findings.dedupe(f).collect()}
    assert got == {1: ("x y ", "error", ["p1", "p2"]), 3: ("x y", "info", None)}


def test_suppressions_first_rule_wins(spark):
    f = spark.createDataFrame([(1, "a", "B1", "error"), (2, "a", "B2", "info"), (3, "b", "B3", "warning")], "seq int, kind string, boundary string, severity string")
    r = spark.createDataFrame([(2, "a", None, "hide"), (1, "a", "B1", "downgrade"), (3, None, None, "hide")], "ord int, kind string, boundary string, effect string")
    got = rows(findings.suppress(f, r), "seq", "severity", "counts")
    assert got == [(1, "warning", True), (3, "warning", True)]
    assert findings.meets_threshold(findings.suppress(f, r), "warning") and not findings.meets_threshold(findings.suppress(f, r), "error") and not findings.meets_threshold(findings.suppress(f, r), "none")


def test_rules_are_normalised_and_may_name_the_consumer(spark):
    f = spark.createDataFrame([(1, "k", "GET /users/{id}", "c::one", "t1", "error"), (2, "k", "GET /users/{id}", "c::two", "t2", "error"), (3, "k", "_noboundary_", "c::one", "t1", "error"), (4, "k", None, "c::three", None, "error")], "seq int, kind string, boundary string, consumer string, transition string, severity string")
    r = spark.createDataFrame([(1, None, "get /Users/:id/", "c::one", None, "hide"), (2, None, "_noboundary_", None, None, "hide"), (3, None, None, None, "t2", "downgrade"), (4, "k", None, "c::three", "t9", "hide"), (5, None, None, None, None, "hide")], "ord int, kind string, boundary string, consumer string, transition string, effect string")
    assert rows(findings.suppress(f, r), "seq", "severity") == [(2, "warning"), (3, "error"), (4, "error")]


def test_diff_and_churn(spark):
    b, a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "n")], "k int, v string")
    assert rows(findings.diff(b, a, ["k"], "v"), "k", "change") == [(2, "changed"), (4, "added")]
    b, a = spark.createDataFrame([("p", 1), ("q", 1)], "path string, stamp int"), spark.createDataFrame([("p", 2), ("r", 1)], "path string, stamp int")
    assert rows(findings.churn(b, a), "path", "state") == [("p", "changed"), ("q", "removed"), ("r", "added")]


def test_reach_stops_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    assert rows(findings.reach(e, spark.createDataFrame([(1,)], "node int")), "node", "depth") == [(1, 0), (2, 1), (3, 2)]


def test_confidence(spark):
    c = spark.createDataFrame([("a", False)] + [("b", i == 0) for i in range(3)] + [("c", True), ("c", False), ("d", None)], "unit string, opaque boolean")
    assert rows(findings.confidence(c), "unit", "level") == [("a", "high"), ("b", "medium"), ("c", "low"), ("d", "high")]


def test_graphql_nested_stops_at_missing_fields(spark):
    fields = spark.createDataFrame([("Q", "user", "User"), ("User", "name", "String")], "type_name string, field_name string, target string")
    selections = spark.createDataFrame([(1, 1, 0, "user"), (1, 2, 1, "nmae"), (1, 3, 2, "deeper"), (1, 4, 1, "name"), (1, 5, 4, "x")], "operation int, node int, parent int, field_name string")
    roots = spark.createDataFrame([(1, 0, "Q")], "operation int, node int, type_name string")
    assert rows(boundaries.graphql_nested(selections, fields, roots, 4), "type_name", "field_name") == [("User", "nmae")]
