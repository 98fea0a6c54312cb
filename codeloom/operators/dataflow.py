"""Data flow inside methods: assignments, initialised locals, returns, and parameter lists.

C#, Java and JavaScript/TypeScript go through one scanner of brace languages; Python through its own
grammar. The order is the same for all: assignments, then locals, then returns.
"""

from __future__ import annotations

import ast
import re
import textwrap
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import stable_id
from codeloom.operators.extract.csharp import NAME as CSHARP
from codeloom.operators.extract.csharp import clean
from codeloom.operators.extract.java import NAME as JAVA
from codeloom.operators.extract.node import NAME as NODE
from codeloom.operators.extract.python import NAME as PYTHON

RETURN_VALUE = "RETURN_VALUE"
ASSIGNMENT, RETURN = "Assignment", "Return"

_ASSIGN = re.compile(r"(?<![=!<>+\-*/%&|^?])(?:\?\?|<<|>>|[+\-*/%&|^])?=(?![=>])")
_DECLARED = re.compile(r"^(?:const\s+|using\s+|await\s+)*(?!return\b|new\b|throw\b|await\b|else\b|in\b|out\b|ref\b)[A-Za-z_][\w.]*(?:\s*<.*>)?(?:\[[,\s]*\])*\??\s+([A-Za-z_]\w*)\s*$", re.S)
_GOES_ON = re.compile(r"(?:[=+\-*/%&|^?:,.({\[<>!]|=>)\s*$")
_LEADS_ON = re.compile(r"\s*(?:[.?:+*/%&|=<>,)\]]|-(?!-))")
_TYPED = re.compile(r"^(\s*(?:const|let|var)\s+[A-Za-z_]\w*)\s*:[^=;]*$", re.S)
_SCRIPT_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_RETURN = re.compile(r"\breturn\b")
_TARGET = re.compile(r"[\w.\]\[?\s()!]*[\w\])]\s*$")


class _Places:
    """Places of some characters: the last one before a place without scanning back for it."""

    def __init__(self, src: str, characters: str):
        self.at = [m.start() for m in re.finditer(f"[{re.escape(characters)}]", src)]

    def before(self, place: int) -> int:
        k = bisect_right(self.at, place - 1)
        return self.at[k - 1] if k else -1


def _end_of(src: str, at: int, stop: int, by_line: bool = False) -> int:
    """Where an expression that starts at ``at`` ends: an unmatched bracket, comma or semicolon.

    ``by_line``: or a line's end, unless the line or the next one shows that it goes on.
    """
    depth = 0
    for i in range(at, stop):
        c = src[i]
        if by_line and c == "\n" and not depth and src[at:i].strip() and not _GOES_ON.search(src[max(at, i - 80) : i]) and not _LEADS_ON.match(src, i):
            return i
        if c in "([{":
            depth += 1
        elif c in ")]}":
            if not depth:
                return i
            depth -= 1
        elif c in ",;" and not depth:
            return i
    return stop


def _plain_script(text: str) -> str:
    """Comments blanked, strings and templates as a word of their length, and $ as part of a name."""
    plain = _SCRIPT_NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else "x" * len(m[0]), text)
    return plain.replace("$", "_")


def edges_of(text: str, language: str = CSHARP) -> list[tuple[str, str, str]]:
    """(source, target, relation): all assignments, then all locals, then all returns, in text order."""
    if language == PYTHON:
        return _python_edges(text)
    script = language == NODE
    src = _plain_script(text) if script else clean(text)
    open_ = src.find("{")
    arrow = src.find("=>")
    if open_ < 0 or (0 <= arrow < open_):
        open_ = arrow + 1 if arrow >= 0 else len(src)
    assigned, local, returned = [], [], []
    cuts, ends = _Places(src, ";{}(,\n" if script else ";{}(,"), _Places(src, ";{}")
    heads = [(m.start(), _end_of(src, m.end(), len(src))) for m in re.finditer(r"\b(?:for|foreach)\s*\(", src)]
    starts, reach = [a for a, _ in heads], []
    for _, b in heads:
        reach.append(max(b, reach[-1] if reach else 0))
    for m in _ASSIGN.finditer(src, open_ + 1):
        left_from = cuts.before(m.start()) + 1
        left = src[left_from : m.start()]
        value = text[m.end() : _end_of(src, m.end(), len(src), script)].strip()
        shown = text[left_from : m.start()].strip()
        if not value or not shown:
            continue
        k = bisect_right(starts, m.start())
        in_header = bool(k) and m.start() < reach[k - 1]
        if script and (t := _TYPED.match(left)):
            left = t[1]
        if d := _DECLARED.match(left.strip()):
            if not in_header:
                local.append((value, d[1], ASSIGNMENT))
        elif previous := _further_declarator(src, left_from, left, ends):
            if not in_header:
                local.append((value, previous, ASSIGNMENT))
        elif _TARGET.fullmatch(left.strip()):
            assigned.append((value, re.sub(r"^(?:return|else|await)\s+", "", shown), ASSIGNMENT))
    for m in _RETURN.finditer(src, open_ + 1):
        value = text[m.end() : _end_of(src, m.end(), len(src), script)].strip()
        if value:
            returned.append((value, RETURN_VALUE, RETURN))
    return assigned + local + returned


def _further_declarator(src: str, left_from: int, left: str, ends: _Places) -> str | None:
    """The name in ``int a = 1, b = 2``: a later part of a declaration."""
    if left_from and src[left_from - 1] == "," and re.fullmatch(r"\s*[A-Za-z_]\w*\s*", left):
        before = src[ends.before(left_from) + 1 : left_from - 1]
        if before.count("(") == before.count(")") and _DECLARED.match(before.split("=")[0].strip()):
            return left.strip()
    return None


def _python_edges(text: str) -> list[tuple[str, str, str]]:
    """Assignments (augmented ones too), annotated names with a value as locals, and returns; none if the text does not parse."""
    try:
        own = textwrap.dedent(text)
        tree = ast.parse(own)
    except (SyntaxError, ValueError):
        return []
    shown = lambda node: ast.get_source_segment(own, node)
    nodes = sorted((n for n in ast.walk(tree) if hasattr(n, "lineno")), key=lambda n: (n.lineno, n.col_offset))
    assigned = [(shown(n.value), shown(t), ASSIGNMENT) for n in nodes if isinstance(n, ast.Assign) for t in n.targets]
    assigned += [(shown(n.value), shown(n.target), ASSIGNMENT) for n in nodes if isinstance(n, ast.AugAssign | ast.NamedExpr)]
    local = [(shown(n.value), shown(n.target), ASSIGNMENT) for n in nodes if isinstance(n, ast.AnnAssign) and n.value]
    returned = [(shown(n.value), RETURN_VALUE, RETURN) for n in nodes if isinstance(n, ast.Return) and n.value]
    return assigned + local + returned


def parameters_of(text: str) -> list[str]:
    """``type name`` of the first method's parameters, angle brackets escaped."""
    src = clean(text)
    m = re.search(r"\w+\s*(?:<[\w\s,]*>)?\s*\(([^{}]*?)\)\s*(?:where\b[^{]*)?(?:\{|=>|;|$)", src, re.S)
    if not m:
        return []
    parts, depth, start, stop = [], 0, m.start(1), None
    for i in range(m.start(1), m.end(1) + 1):
        c = src[i] if i < m.end(1) else ","
        depth += (c in "<([") - (c in ">)]")
        if c == "=" and stop is None:
            stop = i  # what follows is a default
        if c == "," and (depth <= 0 or i == m.end(1)):
            parts.append(re.sub(r"\s+", " ", text[start : i if stop is None else stop]).strip())
            depth, start, stop = 0, i + 1, None
    return [p.replace("<", "&lt;").replace(">", "&gt;") for p in parts if p]


def data_flow(methods: DataFrame) -> DataFrame:
    """Edges of every method (id, class_name, method_name, source_code, language), in emission order.

    Languages without a scanner give one row of relation ``unsupported`` each.
    """
    known = {CSHARP, JAVA, NODE, PYTHON}

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.language in known:
                    rows += [(r.id, r.class_name, r.method_name, i, *e) for i, e in enumerate(edges_of(r.source_code or "", r.language))]
                else:
                    rows.append((r.id, r.class_name, r.method_name, 0, "", "", "unsupported"))
            yield pd.DataFrame(rows, columns=["method_id", "class_name", "method_name", "seq", "source_token", "target_token", "relation_type"])

    schema = "method_id string, class_name string, method_name string, seq int, source_token string, target_token string, relation_type string"
    found = methods.select("id", "class_name", "method_name", "source_code", "language").mapInPandas(run, schema)
    return found.withColumn("id", stable_id("method_id", "seq"))


def parameters(source: str):
    """A column of ``parameters_of`` each source text."""
    return F.udf(parameters_of, "array<string>", useArrow=True)(F.coalesce(source, F.lit("")))
