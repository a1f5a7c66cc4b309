"""Pairing of providers and consumers by boundary, and the status-level checks of every pair.

Pairs of a boundary multiply, and a hot boundary would multiply without bound. A finding doesn't tell which provider of a
boundary it comes from (they merge as its sources), so the checks go from consumers to the statuses of a boundary with
counts of providers, which is linear in both sides. pairs() itself returns the pairs where someone wants them.

Inputs: providers (boundary_key, provider), consumers (boundary_key, consumer, has_default), provider_statuses
(provider, status, opaque; status null where opaque), consumer_statuses (consumer, status). Keys may be null: unbound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def success(column: str = "status"):
    return F.col(column).between(200, 299)


def pairs(providers: DataFrame, consumers: DataFrame) -> DataFrame:
    """Every provider with every consumer of its boundary."""
    return providers.join(consumers, "boundary_key")


def pairing_report(providers: DataFrame, consumers: DataFrame) -> DataFrame:
    """For each boundary the numbers of providers, consumers and pairs, and whether it is paired or lacks a side; unbound records under a null key."""
    p = providers.groupBy("boundary_key").agg(F.count("*").alias("n_providers"))
    c = consumers.groupBy("boundary_key").agg(F.count("*").alias("n_consumers"))
    both = p.join(c, p.boundary_key.eqNullSafe(c.boundary_key), "full_outer").select(
        F.coalesce(p.boundary_key, c.boundary_key).alias("boundary_key"), F.coalesce("n_providers", F.lit(0)).alias("n_providers"), F.coalesce("n_consumers", F.lit(0)).alias("n_consumers")
    )
    state = F.when(F.col("boundary_key").isNull(), "no_binding").when(F.col("n_providers") == 0, "unmatched_consumers").when(F.col("n_consumers") == 0, "unmatched_providers").otherwise("paired")
    return both.withColumn("state", state).withColumn("n_pairs", F.when(F.col("state") == "paired", F.col("n_providers") * F.col("n_consumers")).otherwise(0))


def provider_coverage(providers: DataFrame, consumers: DataFrame, provider_statuses: DataFrame, consumer_statuses: DataFrame) -> DataFrame:
    """Statuses that a boundary's providers return and a consumer doesn't handle (a default handles 2xx), and unclear statuses.

    boundary_key, consumer, status (null: unclear), kind, severity, n_sources (providers that return it).
    """
    made = providers.join(provider_statuses, "provider").groupBy("boundary_key", "status", "opaque").agg(F.count_distinct("provider").alias("n_sources"))
    facing = consumers.join(made, "boundary_key")
    known = facing.where("not opaque and status is not null")
    missing = known.join(consumer_statuses.select("consumer", "status").distinct(), ["consumer", "status"], "left_anti").where(~(F.col("has_default") & success()))
    unclear = facing.where("opaque")
    cols = ["boundary_key", "consumer", "status", "kind", "severity", "n_sources"]
    return (
        missing.withColumn("kind", F.lit("unhandledProviderCase")).withColumn("severity", F.lit("error")).select(cols)
        .unionByName(unclear.withColumn("kind", F.lit("lowConfidence")).withColumn("severity", F.lit("info")).withColumn("status", F.lit(None).cast("int")).select(cols))
    )


def consumer_satisfaction(providers: DataFrame, consumers: DataFrame, provider_statuses: DataFrame, consumer_statuses: DataFrame) -> DataFrame:
    """Statuses that a consumer tests and some provider of its boundary never returns; where that provider also has unclear statuses, only a low-confidence note.

    boundary_key, consumer, status, kind, severity, n_sources (providers that lack it).
    """
    own = providers.select("boundary_key", "provider").join(provider_statuses, "provider", "left")
    clear = own.groupBy("boundary_key", "provider").agg(F.coalesce(F.bool_or("opaque"), F.lit(False)).alias("unclear"))
    total = clear.groupBy("boundary_key", "unclear").agg(F.count("*").alias("n"))
    having = own.where("not opaque and status is not null").select("boundary_key", "provider", "status").distinct().join(clear, ["boundary_key", "provider"]).groupBy("boundary_key", "unclear", "status").agg(F.count("*").alias("n_with"))
    tested = consumers.join(consumer_statuses.select("consumer", "status").distinct(), "consumer").select("boundary_key", "consumer", "status")
    lacking = tested.join(total, "boundary_key").join(having, ["boundary_key", "unclear", "status"], "left").withColumn("n_sources", F.col("n") - F.coalesce("n_with", F.lit(0))).where("n_sources > 0")
    return lacking.select("boundary_key", "consumer", "status", F.when(F.col("unclear"), "lowConfidence").otherwise("deadConsumerBranch").alias("kind"), F.when(F.col("unclear"), "info").otherwise("warning").alias("severity"), "n_sources")


def contract_consistency(declared: DataFrame, consumers: DataFrame, consumer_statuses: DataFrame) -> DataFrame:
    """Declared statuses (boundary_key, status) that a consumer doesn't handle, and statuses that it handles and nobody declared."""
    facing = consumers.join(declared.select("boundary_key", "status").distinct(), "boundary_key")
    tested = consumers.join(consumer_statuses.select("consumer", "status").distinct(), "consumer")
    bound = tested.join(declared.select("boundary_key").distinct(), "boundary_key", "left_semi")
    unhandled = facing.join(tested.select("consumer", "status"), ["consumer", "status"], "left_anti").where(~(F.col("has_default") & success()))
    undeclared = bound.join(declared.select("boundary_key", "status"), ["boundary_key", "status"], "left_anti")
    say = lambda df, what, how: df.select("boundary_key", "consumer", "status", F.lit("consumerContractViolation").alias("kind"), F.lit(how).alias("severity"), F.lit(what).alias("reason"))
    return say(unhandled, "unhandled", "warning").unionByName(say(undeclared, "undeclared", "error"))


def contract_agreement(sources: DataFrame) -> DataFrame:
    """Sources (boundary_key, source, status) of one boundary that don't declare the same statuses: boundary_key, status, with it, without it."""
    names = sources.groupBy("boundary_key").agg(F.count_distinct("source").alias("n")).where("n > 1")
    each = sources.groupBy("boundary_key", "status").agg(F.count_distinct("source").alias("n_with"))
    return each.join(names, "boundary_key").where("n_with < n").select("boundary_key", "status", "n_with", (F.col("n") - F.col("n_with")).alias("n_without"))


def gaps(declared: DataFrame, produced: DataFrame) -> DataFrame:
    """Set differences of (unit, status) both ways."""
    d, p = declared.select("unit", "status").distinct(), produced.select("unit", "status").distinct()
    return d.join(p, ["unit", "status"], "left_anti").withColumn("gap", F.lit("never produced")).unionByName(p.join(d, ["unit", "status"], "left_anti").withColumn("gap", F.lit("undeclared")))


def bridging(transitions: DataFrame, tests: DataFrame) -> DataFrame:
    """Transitions (unit, status, t_ord, literal) that share a status with others but have another literal, which no test (unit, literal) asks for."""
    shared = transitions.groupBy("unit", "status").agg(F.count("*").alias("n"), F.min("literal").alias("lo"), F.max("literal").alias("hi"), F.count("literal").alias("n_lit")).where("n > 1")
    telling = transitions.where("literal is not null").join(shared, ["unit", "status"]).where("lo != hi or n_lit < n")
    return telling.join(tests.select("unit", "literal").distinct(), ["unit", "literal"], "left_anti").select("unit", "status", "t_ord", "literal")
