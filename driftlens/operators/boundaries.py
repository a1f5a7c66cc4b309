"""Checks of storage, runtime configuration, message channels and component stories against what is declared for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def relational_storage(declared: DataFrame, accesses: DataFrame) -> DataFrame:
    """Declared columns (tbl, field) against accesses (tbl, field, mode read or write; field '*' is all columns).

    Fields that no column declares: an error, by mode. Columns never touched, or only written: a warning; a read of '*' spares
    all of a table, a write of '*' writes all. Tables that nothing declares aren't checked.
    """
    known = declared.select("tbl", "field").distinct()
    checked = accesses.join(known.select("tbl").distinct(), "tbl", "left_semi")
    named = checked.where("field != '*'").groupBy("tbl", "field").agg(F.count_if(F.col("mode") == "read").alias("reads"), F.count_if(F.col("mode") == "write").alias("writes"))
    unknown = named.join(known, ["tbl", "field"], "left_anti")
    bad = unknown.select("tbl", "field", F.lit("boundaryFieldUnknown").alias("kind"), F.lit("error").alias("severity"), F.explode(F.array(F.when(F.col("reads") > 0, "read"), F.when(F.col("writes") > 0, "write"))).alias("aspect")).where("aspect is not null")
    stars = checked.where("field = '*'").groupBy("tbl").agg(F.bool_or(F.col("mode") == "read").alias("star_read"), F.bool_or(F.col("mode") == "write").alias("star_write"))
    used = known.join(named, ["tbl", "field"], "left").join(stars, "tbl", "left").na.fill(0, ["reads", "writes"]).na.fill(False, ["star_read", "star_write"])
    idle = used.where("not star_read and reads = 0")
    aspect = F.when((F.col("writes") > 0) | F.col("star_write"), "write-only").otherwise("unused")
    return bad.unionByName(idle.select("tbl", "field", F.lit("boundaryFieldUnused").alias("kind"), F.lit("warning").alias("severity"), aspect.alias("aspect")))


def prefixes(path):
    """All prefixes of a path that end in '/', the path itself too."""
    parts = F.split(path, "/")
    return F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))), F.array(path)))


def runtime_config(runtimes: DataFrame, provided: DataFrame, reads: DataFrame) -> DataFrame:
    """Variables that code under a runtime's scope reads and the runtime doesn't provide, and the other way round.

    runtimes (runtime, scope; scope null: unknown; else ending in '/'), provided (runtime, variable, platform), reads
    (file, variable). A file lies in a runtime if the scope is one of its prefixes: the prefixes are exploded, so this is an
    equi-join. Variables of the platform are never called unused.
    """
    scoped = reads.withColumn("scope", F.explode(prefixes(F.col("file")))).join(runtimes.where("scope is not null"), "scope").select("runtime", "variable").distinct()
    missing = scoped.join(provided, ["runtime", "variable"], "left_anti").select("runtime", "variable", F.lit("boundaryFieldUnknown").alias("kind"), F.lit("error").alias("severity"))
    own = provided.where("not platform").join(runtimes.where("scope is not null").select("runtime"), "runtime", "left_semi")
    unused = own.join(scoped, ["runtime", "variable"], "left_anti").select("runtime", "variable", F.lit("boundaryFieldUnused").alias("kind"), F.lit("warning").alias("severity"))
    unknown = runtimes.where("scope is null").select("runtime", F.lit(None).cast("string").alias("variable"), F.lit("runtimeScopeUnknown").alias("kind"), F.lit("info").alias("severity"))
    return missing.unionByName(unused.distinct()).unionByName(unknown)


def first_runtime(runtimes: DataFrame, files: DataFrame) -> DataFrame:
    """For each file the first runtime, in order ord, whose scope is a prefix of it (not the longest)."""
    hits = files.withColumn("scope", F.explode(prefixes(F.col("file")))).join(runtimes, "scope")
    return hits.groupBy("file").agg(F.min_by("runtime", "ord").alias("runtime"))


def message_bus(producers: DataFrame, consumers: DataFrame, queues: DataFrame) -> DataFrame:
    """Channels (channel) with a producer and no consumer, a consumer and no producer, or a queue that neither uses."""
    p, c, q = (x.select("channel").where("channel is not null").distinct() for x in (producers, consumers, queues))
    say = lambda df, kind: df.select("channel", F.lit(kind).alias("kind"), F.lit("warning").alias("severity"))
    return (
        say(p.join(c, "channel", "left_anti"), "messageBusProducerOrphan")
        .unionByName(say(c.join(p, "channel", "left_anti"), "messageBusConsumerOrphan"))
        .unionByName(say(q.join(p, "channel", "left_anti").join(c, "channel", "left_anti"), "messageBusUnused"))
    )


def message_bodies(sent: DataFrame, received: DataFrame) -> DataFrame:
    """Fields (channel, field) that a consumer takes and no producer of the channel sends; channels whose producers' bodies are unknown aren't checked."""
    known = sent.where("field is not null").select("channel").distinct()
    return received.join(known, "channel", "left_semi").join(sent, ["channel", "field"], "left_anti").select("channel", "field").distinct()


def component_stories(components: DataFrame, stories: DataFrame) -> DataFrame:
    """Story arguments (component, story, arg) that the component (component, ord, inputs, gating; last of a name wins) lacks, and gating inputs in no story.

    Components without stories aren't checked.
    """
    last = components.groupBy("component").agg(F.max_by(F.struct("inputs", "gating"), "ord").alias("c")).select("component", "c.inputs", "c.gating")
    told = stories.join(last, "component")
    unknown = told.where(~F.array_contains("inputs", F.col("arg"))).select("component", "story", "arg", F.lit("boundaryFieldUnknown").alias("kind"))
    told_args = stories.groupBy("component").agg(F.collect_set("arg").alias("args"))
    gaps = last.join(told_args, "component").select("component", F.lit(None).cast("string").alias("story"), F.explode(F.array_except("gating", "args")).alias("arg"), F.lit("scenarioCoverageGap").alias("kind"))
    return unknown.unionByName(gaps)


def graphql_roots(selections: DataFrame, resolvers: DataFrame) -> DataFrame:
    """Root selections (operation, type_name, field_name) with the number of resolvers of their key; none is a finding."""
    n = resolvers.groupBy("type_name", "field_name").agg(F.count("*").alias("n"))
    return selections.join(n, ["type_name", "field_name"], "left").select("operation", "type_name", "field_name", F.coalesce("n", F.lit(0)).alias("n_resolvers"), F.col("n").isNull().alias("unmatched"))


def graphql_nested(selections: DataFrame, fields: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """Nested selections (operation, node, parent, field_name) walked down the schema (type_name, field_name, target) from roots (operation, node, type_name).

    A child that its parent's type lacks is returned and not walked further; nor are types without fields. The walk ends
    after depth levels; without a depth where no selection is left, and levels are checkpointed.
    """
    level, out = roots, None
    typed = fields.select("type_name").distinct()
    while depth is None or depth > 0:
        children = selections.join(level.select("operation", F.col("node").alias("parent"), "type_name"), ["operation", "parent"]).join(typed, "type_name", "left_semi")
        met = children.join(fields, ["type_name", "field_name"], "left")
        lost = met.where("target is null").select("operation", "type_name", "field_name")
        out = lost if out is None else out.unionByName(lost)
        level = met.where("target is not null").select("operation", "node", F.col("target").alias("type_name"))
        if depth is not None:
            depth -= 1
            continue
        level = checkpointed(level)
        if level.isEmpty():
            break
    return out
