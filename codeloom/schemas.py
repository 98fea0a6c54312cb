"""Explicit schemas of all tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()  # noqa: E741


def _table(**fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(k, kind, nullable) for k, (kind, nullable) in fields.items()])


need, may = (lambda kind: (kind, False)), (lambda kind: (kind, True))

TABLES: dict[str, T.StructType] = {
    "analysis_runs": _table(
        id=need(S), repository_path=need(S), created_at=need(TS), repo_name=may(S), repo_owner=may(S), repo_description=may(S),
        repo_url=may(S), repo_language=may(S), repo_stars=may(I), is_public=may(B), repo_updated_at=may(TS),
    ),
    "call_graph_edges": _table(
        id=need(S), analysis_run_id=need(S), caller_class=need(S), caller_method=need(S), callee_class=need(S),
        callee_method=need(S), created_at=may(TS), language=may(S), edge_ord=need(L),
    ),
    "method_sources": _table(id=need(S), analysis_run_id=need(S), class_name=need(S), method_name=need(S), source_code=need(S), created_at=may(TS), language=may(S)),
    "feature_records": _table(id=need(S), analysis_run_id=need(S), feature_name=need(S), created_at=need(TS)),
    "feature_method_mappings": _table(id=need(S), feature_id=need(S), method_source_id=need(S), mapped_at=need(TS)),
    "business_flows": _table(
        id=need(S), analysis_run_id=need(S), name=need(S), entry_point=need(S), mermaid_graph=need(S), data_flow_mermaid_graph=need(S), created_at=may(TS)
    ),
    "business_flow_steps": _table(
        id=need(S), business_flow_id=need(S), caller_class=need(S), caller_method=need(S), callee_class=need(S), callee_method=need(S), step_order=need(I), created_at=may(TS)
    ),
    "few_shot_examples": _table(id=need(S), question=need(S), suggested_answer=need(S), difficulty=need(S), tag=may(S), description=may(S), created_at=may(TS)),
    "data_flow_edges": _table(
        id=need(S), analysis_run_id=need(S), class_name=need(S), method_name=need(S), source_token=need(S), target_token=need(S), relation_type=need(S), created_at=may(TS)
    ),
}

#: (child table, column, parent): a parent's rows take their children along when they go, whichever parent goes first.
REFERENCES: list[tuple[str, str, str]] = [
    ("call_graph_edges", "analysis_run_id", "analysis_runs"),
    ("method_sources", "analysis_run_id", "analysis_runs"),
    ("feature_records", "analysis_run_id", "analysis_runs"),
    ("business_flows", "analysis_run_id", "analysis_runs"),
    ("data_flow_edges", "analysis_run_id", "analysis_runs"),
    ("business_flow_steps", "business_flow_id", "business_flows"),
    ("feature_method_mappings", "feature_id", "feature_records"),
    ("feature_method_mappings", "method_source_id", "method_sources"),
]

SOURCE_FILES = _table(path=need(S), ext=need(S), language=need(S), file_ord=need(L), content=need(S))

#: What extractors emit, one row per fact; ``kind`` is edge, method, error or a symbol of the C# tables.
FACTS = T.StructType(
    [
        T.StructField("kind", S),
        T.StructField("language", S),
        T.StructField("path", S),
        T.StructField("file_ord", L),
        T.StructField("seq", I),
        T.StructField("class_name", S),
        T.StructField("method_name", S),
        T.StructField("callee_class", S),
        T.StructField("callee_method", S),
        T.StructField("source_code", S),
    ]
)

FEATURE_TEMPLATE = T.ArrayType(T.StructType([T.StructField("feature_name", S), T.StructField("apis", T.ArrayType(T.StructType([T.StructField("controller", S), T.StructField("method", S)])))]))
