"""The driver gives freed memory back after each stored table; the pipeline stores tables in every stage but the last."""

import pytest

from driftlens.llm import cluster


def test_freed_memory_goes_back_after_each_stored_table(spark, monkeypatch):
    told = []
    spare = cluster.spare
    monkeypatch.setattr(cluster, "spare", lambda s: told.append(spare(s)))
    rows = cluster.stored(spark.range(10).selectExpr("id", "id % 3 as k"), "numbers")
    again = cluster.stored(rows.groupBy("k").count(), "counts")
    assert sorted(map(tuple, again.collect())) == [(0, 4), (1, 3), (2, 3)]
    assert len(told) == 2
    assert all("Trim native heap" in t for t in told) or pytest.skip("this JVM has no such command")


def test_a_jvm_without_the_command_does_no_harm(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext._gateway), "new_array", lambda *a: (_ for _ in ()).throw(cluster.Py4JError("none")))
    assert cluster.spare(spark) == ""
