"""GraphQL documents as rows: fields of a schema, and nodes of an operation's selections."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .contracts import _rows

TOKEN = re.compile(r'"""(?:.|\n)*?"""|"(?:[^"\\]|\\.)*"|\.\.\.|[A-Za-z_]\w*|-?\d+(?:\.\d+)?|[{}()\[\]:!=|@$&]|#[^\n]*')
FIELDS = "source string, type_name string, field_name string, target string, printed string, args array<string>"
NODES = "source string, operation string, operation_type string, node int, parent int, field_name string"
#: Definitions that have fields, and root types by kind of operation.
WITH_FIELDS = ("type", "interface")
ROOTS = {"query": "Query", "mutation": "Mutation", "subscription": "Subscription"}


class Reader:
    def __init__(self, text: str):
        self.tokens = [t for t in TOKEN.findall(text) if not t.startswith(("#", '"'))]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        t = self.peek()
        self.at += 1
        return t

    def skip(self, opening: str, closing: str) -> None:
        """Past a bracketed group, the opening token already seen next."""
        depth = 0
        while self.peek():
            t = self.take()
            depth += (t == opening) - (t == closing)
            if depth == 0:
                return

    def directives(self) -> None:
        while self.peek() == "@":
            self.at += 2
            if self.peek() == "(":
                self.skip("(", ")")

    def type(self) -> str:
        if self.peek() == "[":
            self.take()
            out = f"[{self.type()}]"
            self.take()
        else:
            out = self.take()
        if self.peek() == "!":
            out += self.take()
        return out


def named(printed: str) -> str:
    return printed.strip("[]!")


def schema_rows(source: str, text: str) -> Iterator[tuple]:
    """Fields of object and interface types and of their extensions; a later field of the same name wins."""
    r, found = Reader(text), {}
    while r.peek():
        word = r.take()
        if word not in WITH_FIELDS:
            if word == "{":  # of a definition without fields
                r.at -= 1
                r.skip("{", "}")
            continue
        owner = r.take()
        while r.peek() and r.peek() not in ("{", "type", "interface", "enum", "union", "input", "scalar", "schema", "extend", "directive"):
            r.take()
        if r.peek() != "{":
            continue
        r.take()
        while r.peek() and r.peek() != "}":
            field, args = r.take(), []
            if r.peek() == "(":
                r.take()
                while r.peek() and r.peek() != ")":
                    name = r.take()
                    r.take()
                    args.append(f"{name}: {r.type()}")
                    if r.peek() == "=":
                        r.take()
                        if r.peek() in "[{":
                            r.skip(r.peek(), {"[": "]", "{": "}"}[r.peek()])
                        else:
                            r.take()
                    r.directives()
                r.take()
            r.take()
            printed = r.type()
            r.directives()
            found[owner, field] = (source, owner, field, named(printed), printed, args)
        r.take()
    yield from found.values()


def operation_rows(source: str, text: str) -> Iterator[tuple]:
    """Selections of the first operation; node 0 is its root. Fragments are left out, aliases give way to field names; a broken document gives nothing."""
    r = Reader(text)
    while r.peek() == "fragment":
        while r.peek() and r.peek() != "{":
            r.take()
        r.skip("{", "}")
    kind, name = "query", ""
    if r.peek() in ROOTS:
        kind = r.take()
        if r.peek() not in ("{", "(", "@"):
            name = r.take()
        if r.peek() == "(":
            r.skip("(", ")")
        r.directives()
    if r.peek() != "{":
        return
    rows: list[tuple] = []

    def selections(parent: int) -> bool:
        r.take()
        while r.peek() != "}":
            if not r.peek():
                return False
            if r.peek() == "...":
                r.take()
                if r.peek() == "on":
                    r.at += 2
                elif r.peek() not in ("{", "@"):
                    r.take()
                r.directives()
                if r.peek() == "{":
                    r.skip("{", "}")
                continue
            field = r.take()
            if r.peek() == ":":
                r.take()
                field = r.take()
            if r.peek() == "(":
                r.skip("(", ")")
            r.directives()
            node = len(rows) + 1
            rows.append((source, name, kind, node, parent, field))
            if r.peek() == "{" and not selections(node):
                return False
        r.take()
        return True

    if selections(0):
        yield from rows


def read_schema(files: DataFrame) -> DataFrame:
    return _rows(files, schema_rows, FIELDS)


def read_operations(files: DataFrame) -> DataFrame:
    return _rows(files, operation_rows, NODES)
