"""Sinks of a call graph: JSON, Markdown, HTML. Each is one document, which the driver writes as rows come in, line by line."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits of the diagram renderer.
MAX_EDGES, MAX_TEXT = 10000, 90000

_FIELDS = {"caller_class": "CallerClass", "caller_method": "CallerMethod", "callee_class": "CalleeClass", "callee_method": "CalleeMethod", "language": "Language"}

_PAGE = """<!doctype html>
<meta charset="utf-8"><title>Call graph</title>
<style>body{{font:14px sans-serif;margin:2em}}pre{{overflow:auto}}</style>
<h1>Call graph</h1>
{body}
<script type="module">
import mermaid from "https://cdn.jsdelivr.net/npm/mermaid@11/dist/mermaid.esm.min.mjs";
mermaid.initialize({{startOnLoad: true, maxEdges: {edges}, maxTextSize: {text}}});
</script>
"""


def write_json(edges: DataFrame, path: str) -> None:
    """An object with the key CallGraph: edges in order, null fields left out; streamed edge by edge."""
    rows = edges.orderBy("edge_ord").select(*[F.col(c).alias(n) for c, n in _FIELDS.items() if c in edges.columns])
    with open(path, "w", encoding="utf-8") as f:
        f.write('{\n  "CallGraph": [')
        for i, row in enumerate(rows.toLocalIterator()):
            own = {k: v for k, v in row.asDict().items() if v is not None}
            f.write(("," if i else "") + "\n    " + json.dumps(own, ensure_ascii=False, indent=2).replace("\n", "\n    "))
        f.write("\n  ]\n}\n")


def write_markdown(lines: Iterable[str], folder: str) -> None:
    """The diagram's lines in a fence; no file without lines."""
    f = None
    for line in lines:
        if f is None:
            f = open(os.path.join(folder, "call_graph.md"), "w", encoding="utf-8")
            f.write("# Call Graph\n\n```mermaid\n")
        f.write(f"{line}\n")
    if f is not None:
        f.write("\n```")
        f.close()


def page(body: str) -> str:
    return _PAGE.format(body=body, edges=MAX_EDGES, text=MAX_TEXT)


def write_html(lines: Iterable[str], folder: str) -> None:
    """The diagram's lines in a page, twice under both names."""
    mark = "\0"
    before, after = page(f'<pre class="mermaid">{mark}</pre>').split(mark)
    names = [os.path.join(folder, name) for name in ("output_graph.html", "call_graph.html")]
    with open(names[0], "w", encoding="utf-8") as f, open(names[1], "w", encoding="utf-8") as g:
        none = True
        for line in lines:
            text = (before if none else "") + html.escape(line) + "\n"
            none = False
            f.write(text)
            g.write(text)
        last = page("<p>No call graph was found.</p>") if none else after
        f.write(last)
        g.write(last)


def lines_of(ordered: DataFrame) -> Iterable[str]:
    """The lines of a written, ordered diagram: the driver holds one partition at a time."""
    return (r["line"] for r in ordered.select("line").toLocalIterator())
