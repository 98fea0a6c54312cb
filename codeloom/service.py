"""The public surface: analysing a repository, and lookups over what is stored."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.errors import BadRequest, NotFound, Unprocessable
from codeloom.functions.text import stable_id
from codeloom.operators import dataflow, features, graph, lookup, prompts
from codeloom.operators.extract import call_graph
from codeloom.operators.ledger import Ledger
from codeloom.operators.store import Store
from codeloom.operators.validate import violations
from codeloom.plans.staging import cut, is_local, shared_path
from codeloom.schemas import TABLES
from codeloom.sources import export
from codeloom.sources.files import scan_repository
from codeloom.sources.git import is_git_url, local_repository


#: Errors that a response lists.
ERRORS_SHOWN = 100


@dataclass
class AnalysisResponse:
    message: str
    analysis_run_id: str
    edges_count: int  #: distinct edges
    methods_count: int  #: all methods, overloads too
    parsed_count: int = 0  #: files that were parsed
    error_count: int = 0  #: files that could not be read or parsed; their errors are in ``errors``
    errors: list[str] = field(default_factory=list)  #: the first ``ERRORS_SHOWN`` of them, by path


class Engine:
    """``shipped``: repositories lie in folders that only the driver sees. ``ledger``: a folder that all see, for a model's answers."""

    def __init__(self, spark: SparkSession, root: str, client=prompts.offline_client, shipped: bool = False, ledger: str | None = None):
        self.spark, self.store, self.client, self.shipped = spark, Store(spark, root), client, shipped
        self.ledger = Ledger(spark, ledger) if ledger else None

    # -- analysis ---------------------------------------------------------
    def analyze(self, repository_path: str, out: str = "./output", **run_fields) -> AnalysisResponse:
        """Scan, extract, trace, map and store a repository; write its exports to ``out``."""
        if not repository_path or not repository_path.strip():
            raise BadRequest("a repository path is required")
        with local_repository(repository_path, shared_path(self.spark)) as folder:
            return self._analyze(repository_path.strip().strip('"').strip(), folder, out, run_fields)

    def _analyze(self, named: str, folder: str, out: str, run_fields: dict) -> AnalysisResponse:
        now = F.lit(datetime.now(UTC))
        apart = is_git_url(named) and shared_path(self.spark) is None and not is_local(self.spark)  # cloned where only the driver sees it
        files = cut(scan_repository(self.spark, folder, shipped=self.shipped or apart))
        edges, methods, failed = call_graph(files)
        edges, methods, failed = cut(edges), cut(methods), cut(failed)
        run = self.spark.createDataFrame([(named, *run_fields.values())], "repository_path string" + "".join(f", {k} {TABLES['analysis_runs'][k].dataType.simpleString()}" for k in run_fields))
        run = cut(run.withColumns({"id": stable_id(F.lower("repository_path"), now), "created_at": now}))
        run_id = run.first()["id"]
        owned = {"analysis_run_id": F.lit(run_id), "created_at": now}
        flow_edges = cut(dataflow.data_flow(methods))
        steps = cut(graph.trace_flows(edges, graph.entry_points(edges)))
        flows, flow_steps = graph.flow_tables(steps, run_id)
        drawn = graph.flow_diagrams(steps).withColumnRenamed("mermaid", "mermaid_graph")
        with_params = methods.filter(F.col("language").startswith("C#")).select("class_name", "method_name", dataflow.parameters("source_code").alias("params"))
        flow_data = graph.data_flow_diagrams(steps, with_params, flow_edges).withColumnRenamed("mermaid", "data_flow_mermaid_graph")
        both = drawn.join(flow_data, ["entry_class", "entry_method"], "left").withColumn("id", stable_id(F.lit(run_id), F.col("entry_class"), F.col("entry_method")))
        flows = flows.join(both.select("id", "mermaid_graph", F.coalesce("data_flow_mermaid_graph", F.lit("")).alias("data_flow_mermaid_graph")), "id", "left").fillna("", ["mermaid_graph", "data_flow_mermaid_graph"]).withColumn("created_at", now)
        run_edges = edges.withColumn("id", stable_id(F.lit(run_id), F.col("edge_ord"))).withColumns(owned)
        run_methods = methods.withColumn("id", stable_id(F.lit(run_id), F.col("id"))).withColumns(owned)
        tables = {
            "call_graph_edges": run_edges,
            "method_sources": run_methods,
            "business_flows": flows,
            "business_flow_steps": flow_steps.withColumn("created_at", now),
            "data_flow_edges": flow_edges.filter("relation_type <> 'unsupported'").withColumn("id", stable_id(F.lit(run_id), F.col("id"))).withColumns(owned),
        }
        if template := features.find_template(folder):
            records, maps = features.map_features(features.read_template(self.spark, template), run_methods, edges, run_id)
            tables |= {"feature_records": records.withColumn("created_at", now), "feature_method_mappings": maps.withColumn("mapped_at", now)}
        self.store.replace_run(run, tables)
        os.makedirs(out, exist_ok=True)
        drawn = cut(graph.ordered_lines(edges, "edge_ord"))
        export.write_json(edges, os.path.join(out, "output_graph.json"))
        export.write_markdown(export.lines_of(drawn), out)
        export.write_html(export.lines_of(drawn), out)
        shown = [f"{r['path']}: {r['error']}" for r in failed.orderBy("path").limit(ERRORS_SHOWN).collect()]
        n_failed = failed.count()
        return AnalysisResponse("analysis completed", run_id, edges.count(), methods.count(), files.count() - n_failed, n_failed, shown)

    # -- runs -------------------------------------------------------------
    def runs(self, **filters) -> lookup.Page:
        return lookup.runs_page(self.store.table("analysis_runs"), **filters)

    def run(self, run_id: str):
        return self._required("analysis_runs", run_id)

    def create_run(self, **fields) -> str:
        return self._create("analysis_runs", fields)

    def update_run(self, run_id: str, **fields) -> None:
        self._update("analysis_runs", run_id, fields)

    def delete_run(self, run_id: str) -> bool:
        return self._delete("analysis_runs", run_id)

    # -- flows ------------------------------------------------------------
    def flows(self, **filters) -> lookup.Page:
        return lookup.flows_page(self.store.table("business_flows"), self.store.table("business_flow_steps"), **filters)

    def flows_of_run(self, run_id: str) -> DataFrame:
        return lookup.flows_of_run(self.store.table("business_flows"), self.store.table("business_flow_steps"), run_id)

    def flow(self, flow_id: str):
        own = self.store.table("business_flows").filter(F.col("id") == flow_id)
        found = lookup.flow_details(own, self.store.table("business_flow_steps").filter(F.col("business_flow_id") == flow_id)).first()
        if not found:
            raise NotFound(f"no flow {flow_id}")
        return found

    # -- features ---------------------------------------------------------
    def features(self, run_id: str | None = None) -> DataFrame:
        return lookup.where(self.store.table("feature_records"), [lookup.equal("analysis_run_id", run_id)])

    def feature(self, feature_id: str):
        return self._required("feature_records", feature_id)

    def code_flow(self, feature_id: str):
        own = self.store.table("feature_records").filter(F.col("id") == feature_id)
        maps = self.store.table("feature_method_mappings").filter(F.col("feature_id") == feature_id)
        found = features.code_flow(own, maps, self.store.table("method_sources")).first()
        if not found:
            raise NotFound(f"no feature {feature_id}")
        return found

    # -- few-shot examples ------------------------------------------------
    def examples(self, **filters) -> lookup.Page:
        return lookup.examples_page(self.store.table("few_shot_examples"), **filters)

    def example(self, example_id: str):
        return self._required("few_shot_examples", example_id)

    def create_example(self, **fields) -> str:
        return self._create("few_shot_examples", fields)

    def update_example(self, example_id: str, **fields) -> None:
        self._update("few_shot_examples", example_id, fields)

    def delete_example(self, example_id: str) -> bool:
        return self._delete("few_shot_examples", example_id)

    # -- questions --------------------------------------------------------
    def questions_from_feature(self, feature_id: str, count: int, difficulty: str, focus: str | None = None) -> DataFrame:
        self.feature(feature_id)
        maps, methods = self.store.table("feature_method_mappings"), self.store.table("method_sources")
        if lookup.methods_of_feature(feature_id, maps, methods).isEmpty():
            raise Unprocessable("no method is mapped to the feature")
        context = prompts.feature_context(feature_id, self.store.table("feature_records"), maps, methods, self.store.table("call_graph_edges"))
        return self._questions(prompts.feature_prompt(context, count, difficulty, focus), "feature_id", 0.3)

    def questions_from_flow(self, flow_id: str, count: int, difficulty: str, example_ids: list[str] | None = None, extra: str | None = None) -> DataFrame:
        if count <= 0:
            raise BadRequest("the number of questions must be positive")
        flows = self.store.table("business_flows").filter(F.col("id") == flow_id)
        if flows.isEmpty():
            raise NotFound(f"no flow {flow_id}")
        examples = prompts.choose_examples(self.store.table("few_shot_examples"), example_ids, difficulty)
        steps = self.store.table("business_flow_steps").filter(F.col("business_flow_id") == flow_id)
        own = cut(prompts.flow_prompt(flows, steps, examples, count, difficulty, extra))
        return self._questions(own, "id", 0.4).join(own.select("id", "total_steps", "few_shot_used"), "id")

    def _questions(self, asked: DataFrame, id_col: str, temperature: float) -> DataFrame:
        if self.ledger is None:
            return prompts.generate(asked, id_col, self.client, temperature)
        return prompts.questions(self.ledger.ask(asked, id_col, self.client, temperature), id_col)

    # -- shared -----------------------------------------------------------
    def _required(self, table: str, row_id: str):
        found = self.store.get(table, row_id)
        if found is None:
            raise NotFound(f"no row {row_id} in {table}")
        return found

    def _rows(self, table: str, fields: dict) -> DataFrame:
        own = {k: v.strip() if isinstance(v, str) else v for k, v in fields.items()}
        unknown = set(own) - set(TABLES[table].fieldNames())
        if unknown:
            raise BadRequest(f"unknown fields: {', '.join(sorted(unknown))}")
        kinds = {k: TABLES[table][k].dataType.simpleString() for k in own}
        return self.spark.createDataFrame([tuple(own.values())], ", ".join(f"{k} {v}" for k, v in kinds.items()))

    def _checked(self, table: str, rows: DataFrame, creating: bool) -> None:
        if bad := [r["violation"] for r in violations(table, rows, creating).collect()]:
            raise BadRequest("; ".join(bad))

    def _create(self, table: str, fields: dict) -> str:
        for required in ("repository_path",) if table == "analysis_runs" else ("question", "suggested_answer", "difficulty"):
            fields.setdefault(required, "")
        rows = self._rows(table, fields)
        self._checked(table, rows, True)
        now = datetime.now(UTC)
        rows = cut(rows.withColumns({"id": stable_id(F.lit(str(now)), *rows.columns), "created_at": F.lit(now)}))
        row_id = rows.first()["id"]
        self.store.insert(table, rows, row_id if table == "analysis_runs" else None)
        return row_id

    def _update(self, table: str, row_id: str, fields: dict) -> None:
        self._required(table, row_id)
        rows = self._rows(table, {"id": row_id, **fields})
        self._checked(table, rows, False)
        self.store.update(table, rows)

    def _delete(self, table: str, row_id: str) -> bool:
        if self.store.get(table, row_id) is None:
            return False
        self.store.delete(table, self.spark.createDataFrame([(row_id,)], "id string"))
        return True


__all__ = ["AnalysisResponse", "Engine"]
