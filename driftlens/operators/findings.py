"""Findings: merging, suppression, thresholds; snapshots of records: differences and churn; ordinals; reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import collapsed, rule_boundary
from ..session import checkpointed

RANK = {"error": 0, "warning": 1, "info": 2}


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), rank + 1)


def dedupe(findings: DataFrame) -> DataFrame:
    """Merges findings (seq, kind, boundary_key, description, consumer, transition, provider, severity) that say the same of a consumer.

    The first by seq stays, with the worst severity and, where several merged, their providers in order. Partial aggregation
    merges copies before the shuffle.
    """
    key = ["kind", "boundary", "said", "consumer", "transition"]
    marked = findings.withColumn("boundary", F.coalesce("boundary_key", F.lit("_noboundary_"))).withColumn("said", collapsed(F.col("description"))).withColumn("rank", severity_rank(F.col("severity")))
    merged = marked.groupBy(*key).agg(F.min("seq").alias("seq"), F.min_by("description", "seq").alias("description"), F.min("rank").alias("rank"), F.collect_set("provider").alias("providers"), F.count("*").alias("n_merged"))
    return merged.select("seq", "kind", "boundary", "description", "consumer", "transition", severity_name(F.col("rank")).alias("severity"), F.when(F.col("n_merged") > 1, F.array_sort("providers")).alias("sources"), "n_merged")


def _rule_key(*fields: Column) -> Column:
    """The set fields of a rule, or some fields of a finding, as one text; a null field is one that isn't asked for."""
    return F.to_json(F.array(*fields))


def suppress(findings: DataFrame, rules: DataFrame, keep_hidden: bool = False) -> DataFrame:
    """Applies to each finding (seq, kind, boundary, severity; consumer and transition if there) the first rule by ord whose set fields all agree.

    Rules are (ord, kind, boundary, effect) and perhaps consumer and transition; their boundaries are normalised, so that
    "get /users/:id" is "GET /users/{id}", and none is that of unbound findings. A rule without a set field agrees with none.
    hide drops, mark keeps and doesn't count, downgrade lowers the severity by a step and counts. Each finding asks for every
    choice of its fields, so that the rules are joined on equality.
    """
    names = ["kind", "boundary", "consumer", "transition"]
    missing = lambda df: [F.col(x).cast("string") if x in df.columns else F.lit(None).cast("string") for x in names]
    kind, boundary, consumer, transition = missing(rules)
    wanted = rules.where(F.coalesce(kind, boundary, consumer, transition).isNotNull()).select("ord", "effect", _rule_key(kind, rule_boundary(boundary), consumer, transition).alias("asked"))
    own = missing(findings)
    own[1] = F.nullif(own[1], F.lit("_noboundary_"))
    choices = [[x if mask >> k & 1 else F.lit(None).cast("string") for k, x in enumerate(own)] for mask in range(1, 1 << len(own))]
    asked = findings.select("seq", F.explode(F.array_distinct(F.array(*(_rule_key(*c) for c in choices)))).alias("asked"))
    hit = asked.join(wanted, "asked").groupBy("seq").agg(F.min_by("effect", "ord").alias("effect"))
    out = findings.join(hit, "seq", "left")
    rank = severity_rank(F.col("severity"))
    out = out.withColumn("severity", F.when(F.col("effect") == "downgrade", severity_name(F.least(rank + 1, F.lit(2)))).otherwise(F.col("severity")))
    out = out.withColumn("counts", F.col("effect").isNull() | (F.col("effect") == "downgrade"))
    return out if keep_hidden else out.where("effect is null or effect != 'hide'")


def severities(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"), F.count_if("counts").alias("n_counted"))


def meets_threshold(findings: DataFrame, fail_on: str) -> bool:
    """Whether any counted finding is as severe as fail_on; 'none' never."""
    return fail_on != "none" and not findings.where(F.col("counts") & (severity_rank(F.col("severity")) <= RANK[fail_on])).isEmpty()


def diff(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Full outer comparison of two snapshots: key columns and change (added, removed, changed); equal records don't appear."""
    b = before.select(*key, F.col(value).alias("old"), F.lit(True).alias("in_before"))
    a = after.select(*key, F.col(value).alias("new"), F.lit(True).alias("in_after"))
    both = b.join(a, key, "full_outer")
    change = F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*key, "change", "old", "new")


def churn(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files (path, stamp) of two moments: unchanged, changed, added or removed."""
    both = before.select("path", F.col("stamp").alias("old")).join(now.select("path", F.col("stamp").alias("new")), "path", "full_outer")
    return both.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed").alias("state"))


def ordinals(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """A running number from 0 in each group, and the group's size; a name gets its number only where the size is over 1."""
    w = Window.partitionBy(*group)
    return rows.withColumn("idx", F.row_number().over(w.orderBy(*order)) - 1).withColumn("group_size", F.count("*").over(w)).withColumn("suffix", F.when(F.col("group_size") > 1, F.concat(F.lit("#"), F.col("idx"))).otherwise(""))


def confidence(conditions: DataFrame) -> DataFrame:
    """Units (unit, opaque) to high (none opaque, or none at all), medium (under half) or low."""
    n = conditions.groupBy("unit").agg(F.count("opaque").alias("total"), F.count_if("opaque").alias("n_opaque"))
    level = F.when(F.col("n_opaque") == 0, "high").when(2 * F.col("n_opaque") < F.col("total"), "medium").otherwise("low")
    return n.select("unit", "total", "n_opaque", level.alias("level"))


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that edges (src, dst) reach from seeds (node), with the least number of steps. Each round joins the frontier alone; checkpoints cut the lineage."""
    edges = edges.select("src", "dst").where("src != dst").distinct()
    seen = checkpointed(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while not frontier.isEmpty():
        depth += 1
        new = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = checkpointed(new.withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def merge_keyed(preferred: DataFrame, other: DataFrame, key: list[str], order: str) -> DataFrame:
    """Union by key: rows of preferred win over those of other, and the first by order wins within one."""
    both = preferred.withColumn("rank", F.lit(0)).unionByName(other.withColumn("rank", F.lit(1)))
    rest = [c for c in preferred.columns if c not in key]
    return both.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("rank", order)).alias("v")).select(*key, *(f"v.{c}" for c in rest))
