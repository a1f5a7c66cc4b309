"""Outputs, bodies and whole summaries as text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame

from . import predicates

#: Keys of a record that a line shows, and those that it shows of a longer one.
SHOWN, SHOWN_OF_MORE = 5, 4


#: How shapes without parts read.
PLAIN = {"text": "string", "integer": "int", "number": "number", "boolean": "bool", "null": "null", "undefined": "undefined", "unknown": "any"}


def body_text(shape: dict | None) -> str:
    """A body in braces by its keys, in brackets by its items; others by their type."""
    if not shape:
        return ""
    kind = shape["type"]
    if kind == "record":
        names = list(shape.get("properties", {}))
        return "{ " + ", ".join(names if len(names) <= SHOWN else [*names[:SHOWN_OF_MORE], "..."]) + " }" if names else "{}"
    if kind == "array":
        return f"[{body_text(shape['items'])}]"
    if kind == "dictionary":
        return f"{{ [key]: {body_text(shape['values'])} }}"
    if kind == "literal":
        return json.dumps(shape["value"], ensure_ascii=False)
    if kind == "ref":
        return shape["name"]
    if kind == "union":
        return " | ".join(map(body_text, shape["variants"]))
    return PLAIN.get(kind, kind)


def output_text(output: dict) -> str:
    kind = output["type"]
    if kind == "response":
        status = predicates.ref_text(output["statusCode"]) if output.get("statusCode") else "???"
        return " ".join(filter(None, (status, body_text(output.get("body")))))
    if kind == "throw":
        return f"throw {output.get('exceptionType') or 'Error'}"
    if kind == "render":
        return f"render <{output['component']} />"
    if kind == "return":
        return " ".join(filter(None, ("return", body_text(output.get("value")))))
    return {"delegate": f"delegate -> {output.get('to')}", "emit": f'emit "{output.get("event")}"'}.get(kind, "void")


def tree(transitions: list[dict]) -> dict:
    """Transitions as a decision tree: conditions that are equal as JSON share a branch; of leaves at one place the first stays."""
    top: dict = {"branches": {}, "leaf": None}
    for t in transitions:
        at = top
        for c in t["conditions"]:
            key = json.dumps(c, sort_keys=True)
            at = at["branches"].setdefault(key, {"condition": c, "branches": {}, "leaf": None})
        if at["leaf"] is None:
            at["leaf"] = output_text(t["output"])
    return top


def lines(node: dict, depth: int = 0) -> list[str]:
    pad, out = "  " * depth, []
    for k, child in enumerate(node["branches"].values()):
        out.append(f"{pad}{'if' if k == 0 else 'elif'} {predicates.text(child['condition'])}:")
        out += lines(child, depth + 1)
    if node["leaf"] is not None:
        out += [f"{pad}else:", f"{pad}  -> {node['leaf']}"] if node["branches"] else [f"{pad}-> {node['leaf']}"]
    return out


def render(summaries: DataFrame) -> DataFrame:
    """summary and text of each row (summary, transitions: JSON text of an array)."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"summary": b["summary"], "text": ["\n".join(lines(tree(json.loads(t or "[]")))) for t in b["transitions"]]})

    return summaries.select("summary", "transitions").mapInPandas(run, "summary string, text string")
