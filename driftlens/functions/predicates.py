"""Conditions and the values they test, as JSON trees: what statuses they ask for, how far they are known, how they read."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Signs of comparisons as they read.
SIGNS = {"eq": "===", "neq": "!==", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
DEFAULT_STATUS = ("status", "statusCode")


def children(p: dict) -> list[dict]:
    if p["type"] == "compound":
        return p["operands"]
    return [p["operand"]] if p["type"] == "negation" else []


def walk(p: dict) -> Iterator[dict]:
    yield p
    for c in children(p):
        yield from walk(c)


def last_step(ref: dict) -> str | None:
    """Name of the last property that a value is read by; calls, awaits and indexes have none."""
    kind = ref["type"]
    if kind == "derived":
        d = ref["derivation"]
        return d.get("property") if d["type"] == "propertyAccess" else d.get("field") if d["type"] == "destructured" else None
    steps = ref.get("path") if kind == "input" else ref.get("accessChain") if kind == "dependency" else None
    return steps[-1] if steps else None


def statuses(p: dict, accessors: tuple[str, ...] = DEFAULT_STATUS) -> list[int]:
    """Numbers that a status-like value is compared with for equality; negations don't turn that round."""
    out = []
    for q in walk(p):
        if q["type"] == "comparison" and q["op"] == "eq":
            for side, other in ((q["left"], q["right"]), (q["right"], q["left"])):
                value = other.get("value") if other["type"] == "literal" else None
                if last_step(side) in accessors and isinstance(value, (int, float)) and not isinstance(value, bool):
                    out.append(int(value))
    return out


def about_status(p: dict, accessors: tuple[str, ...] = DEFAULT_STATUS) -> bool:
    """Whether a condition compares a status with something, negated or not."""
    if p["type"] == "negation":
        return about_status(p["operand"], accessors)
    return p["type"] == "comparison" and any(last_step(p[side]) in accessors for side in ("left", "right"))


def told_apart(own: list[dict], branches: list[dict], accessors: tuple[str, ...] = DEFAULT_STATUS) -> str:
    """How a consumer's branches for a status tell a provider's path apart: not at all, by an equal condition, perhaps, or by others."""
    theirs = [p for p in branches if not about_status(p, accessors)]
    if not theirs:
        return "not at all"
    mine = [p for p in own if not about_status(p, accessors)]
    clear = {json.dumps(p, sort_keys=True) for p in theirs if not unclear(p)}
    if any(not unclear(p) and json.dumps(p, sort_keys=True) in clear for p in mine):
        return "equal"
    return "perhaps" if mine and (len(clear) == 0 or any(map(unclear, [*mine, *theirs]))) else "others"


def refs(p: dict) -> Iterator[dict]:
    for key in ("left", "right", "subject"):
        if key in p:
            yield p[key]
    yield from p.get("args", []) if p["type"] == "call" else []


def unclear(p: dict) -> bool:
    """Whether a condition holds something that wasn't understood."""

    def lost(r: dict) -> bool:
        return r["type"] == "unresolved" or r["type"] == "derived" and lost(r["from"])

    return any(q["type"] == "opaque" or any(map(lost, refs(q))) for q in walk(p))


def inputs(p: dict) -> list[str]:
    """Names of inputs that a condition tests."""

    def base(r: dict) -> dict:
        return base(r["from"]) if r["type"] == "derived" else r

    return sorted({b["inputRef"] for q in walk(p) for r in refs(q) if (b := base(r))["type"] == "input"})


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def ref_text(r: dict) -> str:
    kind = r["type"]
    if kind == "literal":
        return json.dumps(r["value"], ensure_ascii=False)
    if kind == "input":
        return ".".join([r["inputRef"], *r["path"]])
    if kind == "dependency":
        return ".".join([f"{_squeezed(r['name'])}()", *r["accessChain"]])
    if kind == "state":
        return f"state.{r['name']}"
    if kind == "unresolved":
        return _squeezed(r["sourceText"])
    d = r["derivation"]
    if d["type"] == "indexAccess":
        return f"{ref_text(r['from'])}[{d['index']}]"
    step = {"propertyAccess": d.get("property"), "destructured": d.get("field"), "methodCall": f"{d.get('method')}()", "awaited": "await"}[d["type"]]
    return f"{ref_text(r['from'])}.{step}"


def text(p: dict) -> str:
    """A condition as one line; a negation of a truth or null test, or of a negation, is folded into it."""
    kind = p["type"]
    if kind == "comparison":
        return f"{ref_text(p['left'])} {SIGNS.get(p['op'], p['op'])} {ref_text(p['right'])}"
    if kind in ("truthinessCheck", "nullCheck"):
        of = ref_text(p["subject"])
        if kind == "truthinessCheck":
            return f"!{of}" if p["negated"] else of
        return f"{of} {'!=' if p['negated'] else '=='} null"
    if kind == "typeCheck":
        return f'typeof {ref_text(p["subject"])} === "{p["expectedType"]}"'
    if kind == "propertyExists":
        return f'{"!" if p["negated"] else ""}{ref_text(p["subject"])}.has("{p["property"]}")'
    if kind == "compound":
        return (" && " if p["op"] == "and" else " || ").join(map(text, p["operands"]))
    if kind == "call":
        return f"{p['callee']}({', '.join(map(ref_text, p['args']))})"
    if kind == "opaque":
        return _squeezed(p["sourceText"])
    inner = p["operand"]
    if inner["type"] == "negation":
        return text(inner["operand"])
    if inner["type"] in ("truthinessCheck", "nullCheck"):
        return text({**inner, "negated": not inner["negated"]})
    return f"!({text(inner)})"


@lru_cache(maxsize=65_536)
def _parsed(raw: str) -> dict:
    return json.loads(raw)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def condition_statuses(conditions: pd.Series, accessors: pd.Series) -> pd.Series:
    """Statuses that an array of conditions asks for."""
    return pd.Series([[s for c in cs for s in statuses(_parsed(c), tuple(a))] for cs, a in zip(conditions, accessors, strict=True)])


@F.pandas_udf(T.StringType())
def conditions_told_apart(own: pd.Series, branches: pd.Series, accessors: pd.Series) -> pd.Series:
    """told_apart() of arrays of conditions."""
    return pd.Series([told_apart([_parsed(x) for x in a], [_parsed(x) for x in b], tuple(names)) for a, b, names in zip(own, branches, accessors, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def condition_unclear(condition: pd.Series) -> pd.Series:
    return condition.map(lambda c: unclear(_parsed(c)))


@F.pandas_udf(T.StringType())
def condition_text(condition: pd.Series) -> pd.Series:
    return condition.map(lambda c: text(_parsed(c)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def condition_inputs(condition: pd.Series) -> pd.Series:
    return condition.map(lambda c: inputs(_parsed(c)))
