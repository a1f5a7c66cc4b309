"""Three-valued results: no match 0, unknown 1, match 2. All-of is the least (of nothing: match), any-of the greatest (of nothing: no match)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOMATCH, UNKNOWN, MATCH = 0, 1, 2
NAMES = {NOMATCH: "nomatch", UNKNOWN: "unknown", MATCH: "match"}


def all_of(x: Column) -> Column:
    """Aggregate."""
    return F.coalesce(F.min(x), F.lit(MATCH))


def any_of(x: Column) -> Column:
    """Aggregate."""
    return F.coalesce(F.max(x), F.lit(NOMATCH))


def structural(a: Column, b: Column, unclear: Column) -> Column:
    """Two canonical JSON texts; unknown if either holds something that wasn't resolved."""
    return F.when(unclear, UNKNOWN).when(a == b, MATCH).otherwise(NOMATCH)


def pairwise(rows: DataFrame, group: list[str]) -> DataFrame:
    """Least and greatest verdict of structural() over all pairs of each group's rows (pred, opaque), and the number of pairs, from counts alone."""
    texts = rows.groupBy(*group, "opaque", "pred").agg(F.count("*").alias("n"))
    clear, n = ~F.col("opaque"), F.col("n")
    told = texts.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.when(clear, 0).otherwise(n)).alias("n_opaque"), F.count_if(clear).alias("n_texts"), F.max(F.when(clear, n).otherwise(0)).alias("most_alike"))
    told = told.where("n > 1")
    seen = F.array_compact(F.array(F.when(F.col("n_texts") > 1, NOMATCH), F.when(F.col("n_opaque") > 0, UNKNOWN), F.when(F.col("most_alike") > 1, MATCH)))
    return told.select(*group, F.array_min(seen).alias("least"), F.array_max(seen).alias("most"), F.expr("n * (n - 1) div 2").alias("n_pairs"))


def name(x: Column) -> Column:
    return F.element_at(F.array(*(F.lit(NAMES[k]) for k in sorted(NAMES))), x + 1)
