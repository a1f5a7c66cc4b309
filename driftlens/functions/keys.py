"""Keys that decide which records belong together, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """:name segments to {name}, one trailing slash off (not of '/'), lower case outside braces; an unclosed brace stays."""
    p = F.regexp_replace(path, r":([A-Za-z_][A-Za-z0-9_]*)", r"{$1}")
    p = F.when((F.length(p) > 1) & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)
    parts = F.regexp_extract_all(p, F.lit(r"\{[^}]+\}|[^{]+|\{"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("{"), x).otherwise(F.lower(x))), "")


def rest_key(method: Column, path: Column) -> Column:
    return F.concat(F.upper(method), F.lit(" "), normalize_path(path))


def boundary_key(sem: Column) -> Column:
    """REST 'METHOD path', 'gql:Type.field', 'fn:package::a.b'; null for every other kind of boundary."""
    name = sem["name"]
    return (
        F.when((name == "rest") & sem["path"].isNotNull(), rest_key(sem["method"], sem["path"]))
        .when(name == "graphql-resolver", F.concat(F.lit("gql:"), sem["type_name"], F.lit("."), sem["field_name"]))
        .when((name == "function-call") & sem["package"].isNotNull() & (F.size(sem["export_path"]) > 0), F.concat(F.lit("fn:"), sem["package"], F.lit("::"), F.array_join(sem["export_path"], ".")))
    )


def rule_boundary(raw: Column) -> Column:
    """A suppression rule's boundary: method in upper case and a normalised path; without a space, all in upper case."""
    method, path = F.substring_index(raw, " ", 1), F.regexp_replace(raw, r"^\S*\s+", "")
    return F.when(raw.contains(" "), F.concat(F.upper(method), F.lit(" "), normalize_path(path))).otherwise(F.upper(raw))


def collapsed(text: Column) -> Column:
    """White space of any kind as one space, trimmed: what makes two descriptions the same finding."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def transition_id(name: Column, kind: Column, status: Column, conditions: Column) -> Column:
    """name:kind:status:first seven hex digits of the conditions' SHA-1."""
    return F.concat_ws(":", name, kind, F.coalesce(status.cast("string"), F.lit("none")), F.substring(F.sha1(conditions.cast("binary")), 1, 7))
