"""The query layer: optional filters, ordering, paging, nested lookups."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import contains_ci, equals_ci, trim_all

#: Up to so many values an IN-list is a literal set; beyond, it becomes a semi join.
LITERAL_SET = 1000


def where(df: DataFrame, predicates: Iterable[Column | None]) -> DataFrame:
    """All given predicates; None stands for a parameter that is not set."""
    own = [p for p in predicates if p is not None]
    return df.filter(reduce(lambda a, b: a & b, own)) if own else df


def text_filter(column: str, value: str | None) -> Column | None:
    """Contains, ignoring case; blank means no filter."""
    return contains_ci(F.col(column), value) if value and value.strip() else None


def same_text(column: str, value: str | None) -> Column | None:
    return equals_ci(F.col(column), value) if value and value.strip() else None


def equal(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def in_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is one of the values: a literal set while small, else a semi join."""
    if len(values) <= LITERAL_SET:
        return df.filter(F.col(column).isin(values))
    kind = df.schema[column].dataType.simpleString()
    listed = df.sparkSession.createDataFrame([(v,) for v in set(values)], f"{column} {kind}")
    return df.join(listed, column, "left_semi")


def touching_classes(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges whose caller's or callee's class, trimmed and in any case, is among ``classes`` (column class_name).

    Two semi joins with a distinct set instead of one join on OR, and an edge comes once.
    """
    named = classes.select(F.lower(trim_all(F.col("class_name"))).alias("_class")).distinct()
    by_caller = edges.join(named, F.lower(trim_all(F.col("caller_class"))) == F.col("_class"), "left_semi")
    rest = edges.join(named, F.lower(trim_all(F.col("caller_class"))) == F.col("_class"), "left_anti")
    by_callee = rest.join(named, F.lower(trim_all(F.col("callee_class"))) == F.col("_class"), "left_semi")
    return by_caller.unionByName(by_callee)


@dataclass
class Page:
    items: DataFrame
    total_count: int
    page: int
    page_size: int

    @property
    def total_pages(self) -> int:
        return math.ceil(self.total_count / self.page_size)

    @property
    def has_previous(self) -> bool:
        return self.page > 1

    @property
    def has_next(self) -> bool:
        return self.page < self.total_pages


def clamp(page: int, page_size: int) -> tuple[int, int]:
    """Pages start at 1; a size outside 1 to 100 becomes 10."""
    return max(1, page), page_size if 1 <= page_size <= 100 else 10


def page_rows(df: DataFrame, order: list[Column | str], page: int, page_size: int) -> DataFrame:
    page, size = clamp(page, page_size)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def paged(df: DataFrame, order: list[Column | str], page: int = 1, page_size: int = 10) -> Page:
    """A page and its totals: one count and one top-k, both over the same filtered plan."""
    page, size = clamp(page, page_size)
    return Page(page_rows(df, order, page, size), df.count(), page, size)


def page_metadata(df: DataFrame, page: int, page_size: int) -> DataFrame:
    """The totals as a row: total_count, page, page_size, total_pages, has_previous, has_next."""
    page, size = clamp(page, page_size)
    total = F.count("*").alias("total_count")
    pages = F.ceil(F.col("total_count") / size).cast("long")
    return df.agg(total).select("total_count", F.lit(page).alias("page"), F.lit(size).alias("page_size"), pages.alias("total_pages"), F.lit(page > 1).alias("has_previous"), (F.lit(page) < pages).alias("has_next"))


def newest_first(df: DataFrame) -> list[Column]:
    return [F.desc("created_at"), F.asc("id")]


def runs_page(runs: DataFrame, owner: str | None = None, name: str | None = None, language: str | None = None, is_public: bool | None = None, page: int = 1, page_size: int = 10) -> Page:
    found = where(runs, [text_filter("repo_owner", owner), text_filter("repo_name", name), text_filter("repo_language", language), equal("is_public", is_public)])
    return paged(found, newest_first(found), page, page_size)


def flow_summaries(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """Flows with their number of steps and whether they have diagrams."""
    counts = steps.groupBy(F.col("business_flow_id").alias("id")).agg(F.count("*").alias("step_count"))
    blank = lambda c: F.length(trim_all(F.coalesce(F.col(c), F.lit("")))) > 0
    joined = flows.join(counts, "id", "left").withColumn("step_count", F.coalesce("step_count", F.lit(0)))
    return joined.withColumns({"has_mermaid_graph": blank("mermaid_graph"), "has_data_flow_graph": blank("data_flow_mermaid_graph")})


def flows_page(flows: DataFrame, steps: DataFrame, run_id: str | None = None, name: str | None = None, page: int = 1, page_size: int = 10) -> Page:
    found = where(flows, [equal("analysis_run_id", run_id), text_filter("name", name)])
    own = paged(found, newest_first(found), page, page_size)
    shown = flow_summaries(own.items, steps.join(own.items.select(F.col("id").alias("business_flow_id")), "business_flow_id", "left_semi"))
    own.items = shown.orderBy(*newest_first(shown))
    return own


def flow_details(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """Flows with their steps nested in order, each with a label ``A.b → C.d``."""
    text = F.concat("caller_class", F.lit("."), "caller_method", F.lit(" → "), "callee_class", F.lit("."), "callee_method")
    step = F.struct("step_order", "caller_class", "caller_method", "callee_class", "callee_method", text.alias("display_label"))
    nested = steps.groupBy(F.col("business_flow_id").alias("id")).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    return flows.join(nested, "id", "left").withColumn("step_count", F.when(F.col("steps").isNull(), 0).otherwise(F.size("steps")))


def flows_of_run(flows: DataFrame, steps: DataFrame, run_id: str) -> DataFrame:
    return flow_details(flows.filter(F.col("analysis_run_id") == run_id), steps).orderBy("name", "id")


def examples_page(examples: DataFrame, difficulty: str | None = None, tag: str | None = None, page: int = 1, page_size: int = 10) -> Page:
    found = where(examples, [same_text("difficulty", difficulty), text_filter("tag", tag)])
    return paged(found, newest_first(found), page, page_size)


def by_id(df: DataFrame, row_id: str) -> DataFrame:
    return df.filter(F.col("id") == row_id).limit(1)


def methods_of_feature(feature_id: str, mappings: DataFrame, methods: DataFrame) -> DataFrame:
    """The methods mapped to a feature; a mapping whose method is gone drops out."""
    own = mappings.filter(F.col("feature_id") == feature_id).select(F.col("method_source_id").alias("id"))
    return methods.join(own, "id")
