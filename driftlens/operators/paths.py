"""Checks of single paths of execution: cases of one status, bodies against reads, declared bodies against reads and each other.

Inputs are rows of sources.summaries.transitions(): provider paths p and consumer paths c, and declared responses (boundary_key,
summary, place, status, declared_body). A finding names the consumer and a provider's path, so its rows are the pairs of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lattice, predicates, shapes
from .pairing import success

COLUMNS = ["boundary_key", "provider", "consumer", "transition", "kind", "severity", "description"]
INFO, WARNING, ERROR = "info", "warning", "error"


def _say(df: DataFrame, kind: str, severity: str, *words) -> DataFrame:
    text = F.concat_ws(" ", *(F.lit(w) if isinstance(w, str) else w for w in words))
    return df.withColumn("kind", F.lit(kind)).withColumn("severity", F.lit(severity)).withColumn("description", text).select(COLUMNS)


def sub_cases(p: DataFrame, c: DataFrame) -> DataFrame:
    """Several paths of a provider to one status, against consumers that handle it.

    A path with conditions is a warning where no branch of the consumer tests anything but the status, and a note where the
    branches' conditions can't be compared with its own; an equal or another known condition is no finding.
    """
    known = p.where("status is not null and not opaque")
    cases = known.groupBy("summary", "status").agg(F.count("*").alias("n_cases")).where("n_cases > 1")
    paths = known.where("not coalesce(is_default, false) and size(conditions) > 0").join(cases, ["summary", "status"])
    paths = paths.select("boundary_key", F.col("summary").alias("provider"), F.col("transition").alias("path"), "status", "n_cases", "conditions")
    branch = F.struct("asks", F.coalesce("is_default", F.lit(False)).alias("is_default"), F.coalesce("conditions", F.array().cast("array<string>")).alias("conditions"))
    consumers = c.groupBy("boundary_key", F.col("summary").alias("consumer"), "accessors").agg(F.collect_list(branch).alias("branches"))  # one summary's
    handles = lambda b: F.array_contains(b["asks"], F.col("status")) | (b["is_default"] & success())
    met = paths.join(consumers, "boundary_key").withColumn("branches", F.filter("branches", handles)).where(F.size("branches") > 0)
    met = met.withColumn("tests", F.flatten(F.transform("branches", lambda b: b["conditions"]))).withColumn("transition", F.lit(None).cast("string"))
    met = met.withColumn("apart", predicates.conditions_told_apart("conditions", "tests", "accessors"))
    return _say(met.where("apart = 'not at all'"), "unhandledProviderCase", WARNING, "Status", F.col("status"), "has", F.col("n_cases"), "cases that the consumer takes for one: path", F.col("path")).unionByName(
        _say(met.where("apart = 'perhaps'"), "lowConfidence", INFO, "Status", F.col("status"), "has cases that can't be compared with the consumer's branches: path", F.col("path"))
    )


def _reads(c: DataFrame) -> DataFrame:
    """What consumers read of a body at each status; a default branch that asks for none reads at null."""
    own = c.where("expected_input is not null and (size(asks) > 0 or is_default)")
    asked = F.explode_outer(F.array_distinct("asks")).alias("status")
    return own.select("boundary_key", F.col("summary").alias("consumer"), "transition", shapes.shape_of_body("expected_input", "body_accessors").alias("read"), asked)


def _meet(reads: DataFrame, bodies: DataFrame) -> DataFrame:
    """Reads with the bodies of their status; those of default branches with the bodies of every 2xx."""
    named = reads.where("status is not null").join(bodies, ["boundary_key", "status"]).withColumn("by_default", F.lit(False))
    rest = reads.where("status is null").drop("status").join(bodies.where(success()), "boundary_key").withColumn("by_default", F.lit(True))
    return named.unionByName(rest.select(named.columns))


def body_reads(p: DataFrame, c: DataFrame) -> DataFrame:
    """Fields that consumers read and a provider's body of that status lacks, can't be told to have, or may leave out."""
    bodies = p.where("status is not null and body is not null").select("boundary_key", "status", "body", F.col("summary").alias("provider"))
    met = _meet(_reads(c), bodies.distinct()).withColumn("verdict", shapes.shape_covers("body", "read"))
    optional = met.withColumn("field", F.explode(shapes.shape_optional_reads("body", "read")))
    where = F.concat(F.col("status").cast("string"), F.when(F.col("by_default"), " in the default branch").otherwise(""))
    return (
        _say(met.where(F.col("verdict") == lattice.NOMATCH), "unhandledProviderCase", ERROR, "Consumer reads a field that the body lacks at status", where)
        .unionByName(_say(met.where((F.col("verdict") == lattice.UNKNOWN) & ~F.col("by_default")), "lowConfidence", INFO, "Consumer's reads can't be compared with the body at status", where))
        .unionByName(_say(optional, "consumerContractViolation", INFO, "Consumer reads", F.col("field"), "that the provider may leave out at status", where))
    )


def declared_body_reads(declared: DataFrame, c: DataFrame) -> DataFrame:
    """Fields that consumers read and the declared body of that status lacks, or can't be told to have; of a provider's repeated statuses the last body counts."""
    bodies = declared.where("declared_body is not null").groupBy("boundary_key", "status", F.col("summary").alias("provider")).agg(F.max_by("declared_body", "place").alias("body"))
    met = _meet(_reads(c).where(F.get_json_object("read", "$.type") == "record"), bodies).withColumn("verdict", shapes.shape_covers("body", "read"))
    return _say(met.where(F.col("verdict") == lattice.NOMATCH), "consumerContractViolation", WARNING, "Consumer reads a field that the contract doesn't declare at status", F.col("status")).unionByName(
        _say(met.where(F.col("verdict") == lattice.UNKNOWN), "lowConfidence", INFO, "Consumer's reads can't be compared with the contract at status", F.col("status"))
    )


def declared_bodies(declared: DataFrame) -> DataFrame:
    """Sources of one boundary whose body of a status doesn't match that of the first source that declares one."""
    each = declared.where("declared_body is not null").groupBy("boundary_key", "status", "summary").agg(F.min_by("declared_body", "place").alias("body"), F.min("place").alias("place"))
    first = each.groupBy("boundary_key", "status").agg(F.min_by(F.struct("summary", "body"), "place").alias("first"))
    others = each.join(first, ["boundary_key", "status"]).where("summary != first.summary").withColumn("verdict", shapes.shape_match(F.col("first.body"), F.col("body")))
    found = others.where(F.col("verdict") == lattice.NOMATCH).select("boundary_key", "status", F.col("first.summary").alias("provider"), F.col("summary").alias("consumer"), F.lit(None).cast("string").alias("transition"))
    return _say(found, "contractDisagreement", WARNING, "Sources declare bodies that don't match at status", F.col("status"))
