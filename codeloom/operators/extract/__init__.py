"""Extraction of methods and call edges from source files, by language.

``register_parser`` adds a language: a function (path, text) -> facts, run inside one ``mapInPandas`` over
all files. A file whose parser fails gives an error row and the run goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import stable_id
from codeloom.operators.extract import csharp, csharp_bind
from codeloom.operators.extract.base import Fact, scan
from codeloom.operators.extract.java import JAVA
from codeloom.operators.extract.node import NODE
from codeloom.operators.extract.python import PYTHON
from codeloom.plans.staging import cut
from codeloom.schemas import FACTS
from codeloom.sources.files import LANGUAGES

Parser = Callable[[str, str], Iterator[Fact]]
#: Facts from which a task hands on what it has, so that its memory goes by the largest file and not by files a batch.
SLICE = 20_000
PARSERS: dict[str, Parser] = {**{x.name: partial(scan, x) for x in (JAVA, PYTHON, NODE)}, csharp.NAME: csharp.facts}


def register_parser(language: str, extensions: list[str], parser: Parser) -> None:
    """Make a further language known."""
    PARSERS[language] = parser
    LANGUAGES.update({e.lower(): language for e in extensions})


def _in_slices(parsers: dict[str, Parser]):
    """Facts of batches of files, handed on ``SLICE`` at a time."""
    names = [f.name for f in FACTS]

    def run(batches):
        for pdf in batches:
            rows = []
            for path, language, file_ord, text in zip(pdf["path"], pdf["language"], pdf["file_ord"], pdf["content"], strict=True):
                own = []
                try:
                    if text is None:
                        raise OSError("unreadable")
                    own = [(f[0], language, path, file_ord, i, *f[1:]) for i, f in enumerate(parsers[language](path, text))]
                except Exception as e:  # one bad file must not end the run
                    own = [("error", language, path, file_ord, 0, None, None, None, None, f"{type(e).__name__}: {e}")]
                rows += own
                if len(rows) >= SLICE:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return run


def extract_facts(files: DataFrame) -> DataFrame:
    """Facts of all files (columns of ``FACTS``), numbered in each file by ``seq``."""
    return files.select("path", "language", "file_ord", "content").mapInPandas(_in_slices(dict(PARSERS)), FACTS)


def dedup_edges(edges: DataFrame, keys: list[str] | None = None, order: str = "edge_ord") -> DataFrame:
    """The first edge, by ``order``, of each (caller, callee) four-tuple; the language is not part of it.

    A minimum per key: partial minima before the shuffle, so repeated edges cost little.
    """
    keys = keys or ["caller_class", "caller_method", "callee_class", "callee_method"]
    rest = [c for c in edges.columns if c not in keys and c != order]
    first = edges.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("first"))
    return first.select(*keys, *[F.col(f"first.{c}").alias(c) for c in [order, *rest]])


def call_graph(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, methods, errors) of a repository's files: edges are distinct and ordered by ``edge_ord``.

    Files are parsed once; the facts are written to the shared folder.
    """
    facts = cut(extract_facts(files))
    plain = facts.filter("kind = 'edge'").select(
        "language", "path", "file_ord", "seq", F.lit(0).cast("long").alias("part"), F.col("class_name").alias("caller_class"), F.col("method_name").alias("caller_method"), "callee_class", "callee_method"
    )
    edges = plain.unionByName(csharp_bind.resolve(facts))
    # an order, not a dense number: the file, then the edge's place in it and among an interface's implementations
    place = F.row_number().over(Window.partitionBy("file_ord", "path").orderBy("seq", "part"))
    order = F.col("file_ord") * F.lit(1 << 32) + place
    numbered = dedup_edges(edges.select("language", order.cast("long").alias("edge_ord"), "caller_class", "caller_method", "callee_class", "callee_method"))
    methods = facts.filter("kind = 'method'").select("class_name", "method_name", "source_code", "language", "path", "seq")
    errors = facts.filter("kind = 'error'").select("path", "language", F.col("source_code").alias("error"))
    return numbered, methods.withColumn("id", stable_id("path", "seq")), errors
