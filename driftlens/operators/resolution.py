"""Resolving names, modules and positions: gates, links, rethrows, sub-units, timers, declared reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boundaries import prefixes


def pack_gates(files: DataFrame, gates: DataFrame) -> DataFrame:
    """Files (file, module) with the packs (pack, gate) that they concern: the module is the gate or lies below it. A module's prefixes are exploded, so this joins on equality."""
    below = files.withColumn("gate", F.explode(F.transform(prefixes(F.col("module")), lambda p: F.rtrim(p, F.lit("/")))))
    return below.join(gates, "gate").select("file", "pack").distinct()


def follow_targets(calls: DataFrame, units: DataFrame) -> DataFrame:
    """The summary that a call's callee means: the unit of that name, else that of its last segment; of several the first by ord."""
    first = units.groupBy("name").agg(F.min_by("unit", "ord").alias("unit"))
    exact, last = first.select(F.col("name").alias("callee"), F.col("unit").alias("by_name")), first.select(F.col("name").alias("tail"), F.col("unit").alias("by_tail"))
    out = calls.withColumn("tail", F.substring_index("callee", ".", -1)).join(exact, "callee", "left").join(last, "tail", "left")
    return out.select("call", "callee", F.coalesce("by_name", "by_tail").alias("unit"))


def rethrows(throws: DataFrame, callees: DataFrame) -> DataFrame:
    """Throws passed on (unit, start, end, file) with the exceptions of the function that lies there (start, end, path, exception); the path ends in the file."""
    return throws.distinct().join(callees.distinct(), ["start", "end"]).where(F.col("path").endswith(F.col("file"))).select("unit", "exception").distinct()


def positional(calls: DataFrame, sub_units: DataFrame) -> DataFrame:
    """The k-th call (parent, via, pos) with the k-th sub-unit (parent, via, ord, sub_unit) of a parent and primitive."""
    number = lambda df, by: df.withColumn("k", F.row_number().over(Window.partitionBy("parent", "via").orderBy(by)))
    return number(calls, "pos").join(number(sub_units, "ord"), ["parent", "via", "k"]).select("parent", "via", "pos", "sub_unit")


def phases(spans: DataFrame) -> DataFrame:
    """Total and number of the spans (label, ms) of each phase."""
    return spans.groupBy("label").agg(F.sum("ms").alias("total_ms"), F.count("*").alias("n"))


def declared_reads(reads: DataFrame, declared: DataFrame) -> DataFrame:
    """Fields that a consumer reads (boundary_key, consumer, status; null: its default branch; field) and the declared body of that status, or of a 2xx for the default, lacks.

    declared (boundary_key, status, ord, fields): of repeated statuses the last counts; null fields aren't known and not checked.
    """
    last = declared.groupBy("boundary_key", "status").agg(F.max_by("fields", "ord").alias("fields")).where("fields is not null")
    named = reads.where("status is not null").join(last, ["boundary_key", "status"])
    rest = reads.where("status is null").drop("status").join(last.where(F.col("status").between(200, 299)), "boundary_key").select(*named.columns)
    return named.unionByName(rest).where(~F.array_contains("fields", F.col("field"))).select("boundary_key", "consumer", "status", "field").distinct()


def unit_label(units: DataFrame, generic: tuple[str, ...]) -> DataFrame:
    """Names (unit, name, file) with their file's stem before them where they are generic or occur in several files."""
    several = units.groupBy("name").agg((F.count_distinct("file") > 1).alias("several"))
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*$", "")
    return units.join(several, "name").select("unit", F.when(F.col("several") | F.col("name").isin(*generic), F.concat(stem, F.lit("."), "name")).otherwise(F.col("name")).alias("label"))
