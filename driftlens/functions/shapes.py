"""Recursive shapes of values, as JSON text, and how they compare. Shapes recurse, which no StructType can, so Arrow-batched functions walk them.

A shape is an object with a type: record {properties, spreads}, dictionary {values}, array {items}, union {variants},
literal {value}, ref {name}, or a plain text, integer, number, boolean, null, undefined or unknown.
"""

from __future__ import annotations

import json
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lattice import MATCH, NOMATCH, UNKNOWN

#: Shapes that a literal of a Python type is one of.
WIDER = {"str": {"text"}, "bool": {"boolean"}, "int": {"integer", "number"}, "float": {"number"}, "NoneType": set()}


def _wider(value) -> set[str]:
    return WIDER["int"] if isinstance(value, float) and value.is_integer() else WIDER[type(value).__name__]


def _same(a, b) -> bool:
    """Equality of JSON values: 1 and 1.0 are one number, 1 and true aren't equal."""
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def _kind(shape: dict) -> str:
    return shape.get("type", "unknown")


def allows_undefined(shape: dict) -> bool:
    return _kind(shape) == "undefined" or _kind(shape) == "union" and any(map(allows_undefined, shape["variants"]))


def match(actual: dict, declared: dict) -> int:
    """Whether every value of actual is one of declared; extra fields of actual pass. What can't be told is unknown."""
    a, d = _kind(actual), _kind(declared)
    if "unknown" in (a, d):
        return UNKNOWN
    if a == "ref" or d == "ref":
        return MATCH if a == d and actual.get("name") == declared.get("name") else UNKNOWN
    if a == "union":
        return min((match(v, declared) for v in actual["variants"]), default=MATCH)
    if d == "union":
        return max((match(actual, v) for v in declared["variants"]), default=NOMATCH)
    if d == "dictionary" and a == "record":  # every value is one of the dictionary's
        return UNKNOWN if actual.get("spreads") else min((match(v, declared["values"]) for v in actual.get("properties", {}).values()), default=MATCH)
    if a == "dictionary":
        return match(actual["values"], declared["values"]) if d == a else UNKNOWN if d == "record" else NOMATCH
    if a == "record" and d == "record":
        if actual.get("spreads") or declared.get("spreads"):
            return UNKNOWN
        own, results = actual.get("properties", {}), []
        for field, wanted in declared.get("properties", {}).items():
            if field in own:
                results.append(match(own[field], wanted))
            elif not allows_undefined(wanted):
                return NOMATCH
        return min(results, default=MATCH)
    if a == "array" and d == "array":
        return match(actual["items"], declared["items"])
    if d == "literal":  # nothing wider is sure to be that value
        return MATCH if a == d and _same(actual.get("value"), declared.get("value")) else NOMATCH
    if a == "literal":
        return MATCH if d in _wider(actual.get("value")) else NOMATCH
    return MATCH if a == d or (a, d) == ("integer", "number") else NOMATCH


def unwrap_optional(shape: dict) -> dict:
    if _kind(shape) != "union":
        return shape
    left = [v for v in shape["variants"] if _kind(v) != "undefined"]
    return left[0] if len(left) == 1 else {**shape, "variants": left}


def covers(provider: dict, consumer: dict) -> int:
    """Whether the provider's body has the fields that the consumer reads."""
    if _kind(consumer) == "unknown":
        return MATCH
    provider = unwrap_optional(provider)
    p = _kind(provider)
    if p in ("unknown", "ref"):
        return UNKNOWN
    if _kind(consumer) != "record":
        return MATCH
    if p == "dictionary":
        return MATCH
    if p == "union":
        return min((covers(v, consumer) for v in provider["variants"]), default=MATCH)
    if p != "record":
        return NOMATCH
    own, results = provider.get("properties", {}), []
    for field, wanted in consumer.get("properties", {}).items():
        if field in own:
            results.append(covers(own[field], wanted))
        else:
            results.append(UNKNOWN if provider.get("spreads") else NOMATCH)
    return min(results, default=MATCH)


def optional_reads(provider: dict, consumer: dict, prefix: tuple[str, ...] = ()) -> list[str]:
    """Dotted paths that the consumer reads where the provider may leave the value undefined."""
    out: list[str] = []
    provider = unwrap_optional(provider)
    if _kind(provider) != "record" or _kind(consumer) != "record":
        return out
    for field, wanted in consumer.get("properties", {}).items():
        own = provider.get("properties", {}).get(field)
        if own is not None:
            if allows_undefined(own):
                out.append(".".join((*prefix, field)))
            out += optional_reads(own, wanted, (*prefix, field))
    return out


@lru_cache(maxsize=65_536)
def _parsed(text: str | None) -> Any:
    return json.loads(text) if text else {"type": "unknown"}


@F.pandas_udf(T.IntegerType())
def shape_match(actual: pd.Series, declared: pd.Series) -> pd.Series:
    return pd.Series([match(_parsed(a), _parsed(d)) for a, d in zip(actual, declared, strict=True)], dtype="int32")


@F.pandas_udf(T.IntegerType())
def shape_covers(provider: pd.Series, consumer: pd.Series) -> pd.Series:
    return pd.Series([covers(_parsed(a), _parsed(d)) for a, d in zip(provider, consumer, strict=True)], dtype="int32")


@F.pandas_udf(T.ArrayType(T.StringType()))
def shape_optional_reads(provider: pd.Series, consumer: pd.Series) -> pd.Series:
    return pd.Series([optional_reads(_parsed(a), _parsed(d)) for a, d in zip(provider, consumer, strict=True)])


@F.pandas_udf(T.StringType())
def shape_of_body(shape: pd.Series, accessors: pd.Series) -> pd.Series:
    """What a consumer reads of the body: the first property of a record that is named as a body, else the shape itself."""

    def inner(text: str | None, names) -> str | None:
        s = _parsed(text)
        held = s.get("properties", {}) if s and s["type"] == "record" else {}
        return next((json.dumps(held[n]) for n in names if n in held), text)

    return pd.Series([inner(x, names) for x, names in zip(shape, accessors, strict=True)], dtype=object)
