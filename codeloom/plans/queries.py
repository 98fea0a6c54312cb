"""The engine's queries over the test tables: adapters present the tables as graphs, runs, flows and files."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import dataflow, features, graph, lookup, prompts
from codeloom.operators.extract import call_graph, dedup_edges, extract_facts
from codeloom.operators.extract import csharp, csharp_bind
from codeloom.operators.ledger import Ledger
from codeloom.operators.ranking import numbered
from codeloom.operators.store import Store, patched, without
from codeloom.operators.validate import violations
from codeloom.plans import snippets
from codeloom.plans.staging import cut, shared_dir, shared_path
from codeloom.service import Engine
from codeloom.sources import export, files as source_files
from codeloom.sources.files import language_counts


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _edge(kind_a: str, key_a, kind_b: str, key_b, ord_) -> list:
    return [F.lit(kind_a).alias("caller_class"), key_a.cast("string").alias("caller_method"), F.lit(kind_b).alias("callee_class"), key_b.cast("string").alias("callee_method"), ord_.cast("long").alias("edge_ord")]


def star_graph(spark: SparkSession, d: str) -> DataFrame:
    """region -> nation -> supplier -> part, and nation -> region back; regions are controllers."""
    nation, supplier, item = (_read(spark, d, t) for t in ("nation", "supplier", "lineitem"))
    down = nation.select(*_edge("RegionController", F.col("n_regionkey"), "Nation", F.col("n_nationkey"), F.col("n_nationkey")))
    back = nation.select(*_edge("Nation", F.col("n_nationkey"), "RegionController", F.col("n_regionkey"), F.col("n_nationkey") + 1000))
    held = supplier.select(*_edge("Nation", F.col("s_nationkey"), "Supplier", F.col("s_suppkey"), F.col("s_suppkey") + 10_000))
    sold = item.groupBy("l_suppkey", "l_partkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    sold = sold.select(*_edge("Supplier", F.col("l_suppkey"), "Part", F.col("l_partkey"), F.col("o") * (1 << 20) + F.col("l_partkey") + 100_000_000))
    return down.union(back).union(held).union(sold)


def flow_trace(spark: SparkSession, d: str) -> DataFrame:
    edges = star_graph(spark, d)
    steps = graph.trace_flows(edges, graph.entry_points(edges))
    return steps.select(F.col("entry_method").alias("flow"), F.col("level").cast("long"), F.col("step_order").cast("long"), "caller_class", "caller_method", "callee_class", "callee_method")


def entry_points(spark: SparkSession, d: str) -> DataFrame:
    return graph.entry_points(star_graph(spark, d))


def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    item = _read(spark, d, "lineitem")
    edges = item.select(*_edge("Supplier", F.col("l_suppkey"), "Part", F.col("l_partkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber")))
    return dedup_edges(edges)


def call_graph_diagram(spark: SparkSession, d: str) -> DataFrame:
    return graph.diagram(star_graph(spark, d), "edge_ord")


def diagram_text(spark: SparkSession, d: str) -> DataFrame:
    """The diagram of the whole graph as written to part files and read back: every line with its number in the text."""
    path = f"{shared_dir(spark)}/diagram-{uuid.uuid4().hex}"
    graph.write_diagram(star_graph(spark, d), "edge_ord", path)
    parts = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("line"))
    return numbered(parts, [], ["file", "block", "nth"], "number").select("number", "line")


def flow_diagrams(spark: SparkSession, d: str) -> DataFrame:
    steps = flow_trace(spark, d).withColumnRenamed("flow", "entry_method").withColumn("entry_class", F.lit("RegionController"))
    return graph.flow_diagrams(steps).select("entry_method", "mermaid")


def call_sites(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r"(\w+)\s*\("), 1)
    return _read(spark, d, "pages").select("page_id", F.posexplode(found).alias("pos", "name")).select("page_id", F.col("pos").cast("long"), "name")


def link_edges(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return _read(spark, d, "pages").select("page_id", F.posexplode(found).alias("pos", "target")).select("page_id", F.col("pos").cast("long"), "target")


def source_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.select("doc_id", F.col("line_no").cast("long"), F.length("line").cast("long").alias("n"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("repo_name"), F.col("c_mktsegment").alias("repo_language"), F.col("c_acctbal").alias("created_at"), (F.col("c_nationkey") % 2 == 0).alias("is_public"))


def run_page(spark: SparkSession, d: str) -> DataFrame:
    found = lookup.where(_runs(spark, d), [lookup.text_filter("repo_language", " BUILD "), lookup.text_filter("repo_name", None), lookup.equal("is_public", True)])
    return lookup.page_rows(found, lookup.newest_first(found), 2, 10)


def page_meta(spark: SparkSession, d: str) -> DataFrame:
    found = lookup.where(_runs(spark, d), [lookup.text_filter("repo_language", "build")])
    meta = lookup.page_metadata(found, 2, 7)
    return meta.select("total_count", F.col("page").cast("long"), F.col("page_size").cast("long"), "total_pages", "has_previous", "has_next")


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return lookup.by_id(_runs(spark, d), 42)


def in_list(spark: SparkSession, d: str) -> DataFrame:
    keys = [f"{k}" for k in range(0, 4000, 2)]
    own = _read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), "o_orderkey")
    return lookup.in_values(own, "id", keys)


def _flows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    turns = _read(spark, d, "conversations")
    own = turns.groupBy("conv_id").agg(F.max("turn").alias("created_at"))
    flows = own.select(F.col("conv_id").alias("id"), F.lit("run").alias("analysis_run_id"), F.concat(F.lit("conversation "), "conv_id").alias("name"), F.lit("x").alias("mermaid_graph"), F.when(F.col("conv_id") % 2 == 0, " ").otherwise("y").alias("data_flow_mermaid_graph"), "created_at")
    nxt = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    steps = turns.select(F.col("conv_id").alias("business_flow_id"), F.col("turn").cast("int").alias("step_order"), F.lit("Turn").alias("caller_class"), F.col("role").alias("caller_method"), F.lit("Turn").alias("callee_class"), F.coalesce(nxt, F.lit("end")).alias("callee_method"))
    return flows, steps


def flow_summary(spark: SparkSession, d: str) -> DataFrame:
    """Flows with the number of their steps; turn 0 opens a conversation and is no step, so a flow of it alone has none."""
    flows, steps = _flows(spark, d)
    return lookup.flow_summaries(flows, steps.filter("step_order > 0")).select("id", "name", "step_count", "has_mermaid_graph", "has_data_flow_graph")


def flow_detail(spark: SparkSession, d: str) -> DataFrame:
    flows, steps = _flows(spark, d)
    found = lookup.flow_details(flows, steps)
    return found.select("id", F.col("step_count").cast("long"), F.array_join(F.transform("steps", lambda s: s["display_label"]), "|").alias("labels"))


def step_listing(spark: SparkSession, d: str) -> DataFrame:
    return prompts.step_listing(_flows(spark, d)[1], ["business_flow_id"])


def flow_prompts(spark: SparkSession, d: str) -> DataFrame:
    flows, steps = _flows(spark, d)
    flows = flows.withColumn("entry_point", F.col("name"))
    few = prompts.choose_examples(_examples(spark, d), None, "HARD")
    made = prompts.flow_prompt(flows, steps, few, 7, "hard")
    return made.select("id", F.col("total_steps").cast("long"), F.col("few_shot_used").cast("long"), "prompt")


def _examples(spark: SparkSession, d: str) -> DataFrame:
    b = _read(spark, d, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.lit("answer").alias("suggested_answer"), F.when(F.col("item_id") % 3 == 0, "hard").when(F.col("item_id") % 3 == 1, "medium").otherwise("easy").alias("difficulty"), F.when(F.col("item_id") % 2 == 0, "Even").alias("tag"), F.col("item_id").alias("created_at"))


def example_page(spark: SparkSession, d: str) -> DataFrame:
    found = lookup.where(_examples(spark, d), [lookup.same_text("difficulty", "HARD "), lookup.text_filter("tag", "eve")])
    return lookup.page_rows(found, lookup.newest_first(found), 1, 0).select("id", "difficulty", "tag", "created_at")


def example_choice(spark: SparkSession, d: str) -> DataFrame:
    return prompts.choose_examples(_examples(spark, d), None, "Easy").select("id", "difficulty")


def class_semi(spark: SparkSession, d: str) -> DataFrame:
    """Supplier-part edges that touch a rare class."""
    item = _read(spark, d, "lineitem")
    edges = item.select(F.concat(F.lit(" S"), "l_suppkey").alias("caller_class"), F.concat(F.lit("p"), "l_partkey").alias("callee_class"), "l_orderkey")
    named = _read(spark, d, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("class_name"))
    named = named.union(_read(spark, d, "part").filter("p_size = 1").select(F.concat(F.lit("P"), "p_partkey").alias("class_name")))
    return lookup.touching_classes(edges, named)


def event_edges(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _read(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("caller"), F.lead("event_type").over(order).alias("callee"))
    return rows


def pascal_case(spark: SparkSession, d: str) -> DataFrame:
    own = _read(spark, d, "orders").select("o_orderpriority").distinct()
    return own.select("o_orderpriority", T.pascal_case(F.lower("o_orderpriority"), "-_ ").alias("pascal"), T.camel_upper(F.lower("o_orderpriority")).alias("upper_first"))


def git_urls(spark: SparkSession, d: str) -> DataFrame:
    own = _read(spark, d, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(x) for x in ("https://github.com/o/r", "https://gitlab.com/o/r/tree/main", " http://Bitbucket.org/a/b/ ", "x.GIT", "https://example.org/o/r", "/local/path")]), (F.col("c_custkey") % 6 + 1).cast("int")).alias("url"))
    return own.select("c_custkey", T.is_git_url(F.col("url")).alias("is_git"), T.normalize_git_url(F.col("url")).alias("clone_url"))


def files_by_language(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select(F.col("lang").alias("language"), F.col("doc_id").alias("path"))
    return language_counts(docs).select("language", "n_files", F.element_at("paths", 1).alias("first_path"))


def _template(spark: SparkSession, d: str) -> DataFrame:
    nation = _read(spark, d, "nation")
    apis = nation.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.lit("Nation").alias("controller"), F.concat(F.lit("GET "), F.col("n_nationkey")).alias("method"))).alias("apis"))
    return apis.select(F.array(F.struct(F.col("n_regionkey").cast("string").alias("feature_name"), "apis")).alias("template"))


def _methods(spark: SparkSession, d: str) -> DataFrame:
    own = _read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("Supplier").alias("class_name"), F.col("s_suppkey").cast("string").alias("method_name"), F.col("s_name").alias("source_code"))
    nations = _read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("nation").alias("class_name"), F.col("n_nationkey").cast("string").alias("method_name"), F.col("n_name").alias("source_code"))
    return own.union(nations)


def feature_map(spark: SparkSession, d: str) -> DataFrame:
    edges = star_graph(spark, d)
    records, maps = features.map_features(features.explode_template(_template(spark, d)), _methods(spark, d), edges, "run")
    return maps.join(records.select(F.col("id").alias("feature_id"), "feature_name"), "feature_id").select("feature_name", "method_source_id")


def code_flow(spark: SparkSession, d: str) -> DataFrame:
    records, maps = features.map_features(features.explode_template(_template(spark, d)), _methods(spark, d), star_graph(spark, d), "run", mode="direct")
    flow = features.code_flow(records, maps, _methods(spark, d))
    return flow.select("feature_name", F.size("methods").cast("long").alias("n_methods"), F.array_join(F.transform("methods", lambda m: m["source_code"]), ",").alias("sources"))


def patch_update(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d)
    changes = runs.filter("id % 10 = 0").select("id", F.when(F.col("id") % 20 == 0, "renamed").alias("repo_name"), F.lit("SET").alias("repo_language"))
    return patched(runs, changes)


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Orders and their items that remain after customers of one segment went."""
    c, o, item = (_read(spark, d, t) for t in ("customer", "orders", "lineitem"))
    tables = {
        "customer": c.select(F.col("c_custkey").alias("id"), "c_mktsegment"),
        "orders": o.select(F.col("o_orderkey").alias("id"), "o_custkey"),
        "lineitem": item.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_orderkey"),
    }
    references = [("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders")]
    return _kept(tables | without(tables.__getitem__, "customer", tables["customer"].filter("c_mktsegment = 'BUILDING'"), references))


def _kept(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of rows and sum of ids by table.

    Sums are added up as DECIMAL and are BIGINT in the result, as the SQL says. If one is beyond BIGINT, where the SQL fails, the
    column stays DECIMAL(38, 0) and is exact.
    """
    sums = [rows.agg(F.count("*").alias("n"), F.sum(F.col("id").cast("decimal(28,0)")).alias("ids")).select(F.lit(t).alias("kept"), "n", "ids") for t, rows in tables.items()]
    kept = cut(reduce(DataFrame.union, sums))  # one row a table
    beyond = kept.filter(F.col("ids").isNotNull() & F.col("ids").try_cast("long").isNull())
    return kept.withColumn("ids", F.col("ids").cast("long")) if beyond.isEmpty() else kept


def mapping_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Mappings that remain of all pairs in items after some runs and some methods went: they hang on features and on methods.

    Nations are runs, suppliers features, parts methods, an item's pair a mapping; a run takes its features and methods along.
    """
    s, p, item = (_read(spark, d, t) for t in ("supplier", "part", "lineitem"))
    tables = {
        "analysis_runs": _read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_regionkey"),
        "feature_records": s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("analysis_run_id")),
        "method_sources": p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 25).alias("analysis_run_id"), "p_size"),
        "feature_method_mappings": item.select((F.col("l_suppkey") * 1_000_000_000 + F.col("l_partkey")).alias("id"), F.col("l_suppkey").alias("feature_id"), F.col("l_partkey").alias("method_source_id")).distinct(),
    }
    tables |= without(tables.get, "analysis_runs", tables["analysis_runs"].filter("n_regionkey = 1"))
    tables |= without(tables.get, "method_sources", tables["method_sources"].filter("p_size > 40"))
    return _kept(tables)


def replace_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Runs after new ones replaced those of the same path in any case."""
    old = _read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("repository_path"))
    new = old.filter("id % 7 = 0").select((F.col("id") + 1_000_000).alias("id"), F.upper("repository_path").alias("repository_path"))
    paths = new.select(F.lower("repository_path").alias("_path")).distinct()
    gone = old.join(paths, F.lower("repository_path") == F.col("_path"), "left_semi")
    return without({"analysis_runs": old}.__getitem__, "analysis_runs", gone, [])["analysis_runs"].unionByName(new)


def request_violations(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 50 == 0, " ").otherwise(F.col("text")).alias("repository_path"), F.col("source").alias("repo_name"), (F.lit(100) - F.col("doc_id")).cast("int").alias("repo_stars"))
    return violations("analysis_runs", rows).select("id", "violation")


def _rendered(spark: SparkSession, d: str, language: str, template: list) -> DataFrame:
    """Classes rendered as source text from the customers and their first orders."""
    orders = _read(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    c = _read(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    files = c.select(F.concat(F.lit("f"), "c_custkey", F.lit(".x")).alias("path"), F.lit(language).alias("language"), F.col("c_custkey").alias("file_ord"), template(F.col("c_custkey"), F.col("keys")).alias("content"))
    return _dealt(files)


def _dealt(files: DataFrame) -> DataFrame:
    """Few bytes, but much to do with each: as many tasks as there are cores, where rendering ended in one."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism, "path")


def _roundtrip(files: DataFrame, resolve: bool = False) -> DataFrame:
    facts = cut(extract_facts(files)) if resolve else extract_facts(files)
    edges = facts.filter("kind = 'edge'").select("file_ord", F.col("class_name").alias("caller_class"), F.col("method_name").alias("caller_method"), "callee_class", "callee_method")
    if resolve:
        edges = csharp_bind.resolve(facts).drop("language", "path", "seq", "part")
    return edges


def _python_text(key, keys):
    body = F.array_join(F.transform(keys, lambda k: F.concat(F.lit("    def load_"), k, F.lit("(self):\n        item = order_store.fetch_"), k, F.lit("(self)\n"))), "\n")
    return F.concat(F.lit("class Customer"), key, F.lit(":\n"), body)


def _java_text(key, keys):
    body = F.array_join(F.transform(keys, lambda k: F.concat(F.lit("  public Order load"), k, F.lit("() {\n    return orderStore.fetch"), k, F.lit("();\n  }"))), "\n")
    return F.concat(F.lit("@Service\npublic class Customer"), key, F.lit(" {\n"), body, F.lit("\n}\n"))


def _node_text(key, keys):
    body = F.array_join(F.transform(keys, lambda k: F.concat(F.lit("  load"), k, F.lit("(id) {\n    return order_store.fetch"), k, F.lit("(id);\n  }"))), "\n")
    return F.concat(F.lit("export class Customer"), key, F.lit(" {\n"), body, F.lit("\n}\n"))


def _csharp_text(key, keys):
    body = F.array_join(F.transform(keys, lambda k: F.concat(F.lit("  public void Load"), k, F.lit("() {\n    _store.Fetch"), k, F.lit("();\n  }"))), "\n")
    store = F.array_join(F.transform(keys, lambda k: F.concat(F.lit("  public void Fetch"), k, F.lit("() { }"))), "\n")
    return F.concat(F.lit("namespace Shop { public class Store"), key, F.lit(" {\n"), store, F.lit("\n}\npublic class Customer"), key, F.lit(" {\n  private readonly Store"), key, F.lit(" _store;\n"), body, F.lit("\n} }\n"))


def parse_python(spark: SparkSession, d: str) -> DataFrame:
    return _roundtrip(_rendered(spark, d, "Python (FastAPI)", _python_text))


def parse_java(spark: SparkSession, d: str) -> DataFrame:
    return _roundtrip(_rendered(spark, d, "Java (Spring Boot)", _java_text))


def parse_node(spark: SparkSession, d: str) -> DataFrame:
    return _roundtrip(_rendered(spark, d, "Node.js (Express)", _node_text))


def parse_csharp(spark: SparkSession, d: str) -> DataFrame:
    return _roundtrip(_rendered(spark, d, csharp.NAME, _csharp_text), resolve=True)


def data_flow(spark: SparkSession, d: str) -> DataFrame:
    """Data flow of methods rendered from orders: one local, one assignment, one return each."""
    o = _read(spark, d, "orders")
    code = F.concat(F.lit("int M"), "o_orderkey", F.lit("(int a) { int x = a + "), "o_orderkey", F.lit("; this.y = x; return x * 2; }"))
    methods = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("C").alias("class_name"), F.concat(F.lit("M"), "o_orderkey").alias("method_name"), code.alias("source_code"), F.lit(csharp.NAME).alias("language"))
    return dataflow.data_flow(methods).select("method_name", F.col("seq").cast("long"), "source_token", "target_token", "relation_type")


def interface_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls through an interface lead on to the class that implements it."""
    c = _read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_custkey").alias("file_ord"))
    text = F.expr(
        "concat('namespace Shop { public interface IStore', k, ' { void Fetch(); }\\npublic class SqlStore', k, ' : IStore', k, ' { public void Fetch() { } }\\n',"
        "'public class Customer', k, ' { private readonly IStore', k, ' _s; public void Load() { _s.Fetch(); } } }')"
    )
    files = c.select(F.concat("k", F.lit(".cs")).alias("path"), F.lit(csharp.NAME).alias("language"), "file_ord", text.alias("content"))
    return csharp_bind.resolve(cut(extract_facts(_dealt(files)))).select("file_ord", "caller_class", "caller_method", "callee_class", "callee_method")


def csharp_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Calls on classes of one name in the namespace of every nation: which one is meant depends on the file of the customer.

    By the customer's id, the file has a ``using`` line, an alias, the full name or a nested type, or lies in the nation's namespace
    itself, where a ``using`` line of another nation must not win. Only the meant class has the called method.
    """
    n, other = F.col("c_nationkey").cast("string"), ((F.col("c_nationkey") + 1) % 25).cast("string")
    nation = _read(spark, d, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("path"), F.col("n_nationkey").cast("long").alias("file_ord"),
        F.format_string("namespace Nation%1$s { public class Account { public void Pay%1$s() { } public class Line { public void Print%1$s() { } } } }", F.col("n_nationkey").cast("string")).alias("content"),
    )
    desk = "public class Desk%1$s { private {kind} item; public void Run() { item.{call}%2$s(); } }"
    ways = [
        ("using Nation%2$s;\nnamespace Desks;\n", "Account", "Pay"),
        ("using Nation%3$s;\nusing Acc = Nation%2$s.Account;\nnamespace Desks;\n", "Acc", "Pay"),
        ("using Nation%3$s;\nnamespace Desks;\n", "Nation%2$s.Account", "Pay"),
        ("using Nation%2$s;\nnamespace Desks;\n", "Account.Line", "Print"),
        ("using Nation%3$s;\nnamespace Nation%2$s.Desks;\n", "Account", "Pay"),
    ]
    texts = [F.format_string(head + desk.replace("{kind}", kind).replace("{call}", call), F.col("c_custkey").cast("string"), n, other) for head, kind, call in ways]
    text = F.element_at(F.array(*texts), (F.col("c_custkey") % len(ways) + 1).cast("int"))
    files = _read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("path"), (F.col("c_custkey") + 100).alias("file_ord"), text.alias("content"))
    files = nation.unionByName(files).withColumn("language", F.lit(csharp.NAME))
    return csharp_bind.resolve(cut(extract_facts(_dealt(files)))).select("file_ord", "caller_class", "caller_method", "callee_class", "callee_method")


def csharp_chains(spark: SparkSession, d: str) -> DataFrame:
    """Calls on results of calls through a generic class: a chain for every order, as long as the order has lines.

    What a chain ends on is told by the type argument of the field that it starts from; every customer is a file.
    """
    lines = _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    key = F.col("o_orderkey").cast("string")
    orders = _read(spark, d, "orders").join(lines, "o_orderkey").select(
        "o_custkey", "o_orderkey",
        F.format_string("public class Order%1$s { public void Pay%1$s() { } }\n", key).alias("kind"),
        F.format_string("  private Box<Order%1$s> box%1$s;\n  public void Run%1$s() { box%1$s", key).alias("head"),
        F.concat(F.repeat(F.lit(".Next()"), F.col("n").cast("int")), F.format_string(".Open().Pay%1$s(); }\n", key)).alias("tail"),
    )
    files = orders.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("kind")), "").alias("kinds"), F.array_join(F.sort_array(F.collect_list(F.concat("head", "tail"))), "").alias("body"))
    text = F.concat(F.lit("namespace Shop;\n"), "kinds", F.lit("public class Customer"), "o_custkey", F.lit(" {\n"), "body", F.lit("}\n"))
    files = files.select(F.concat(F.lit("c"), "o_custkey").alias("path"), F.col("o_custkey").alias("file_ord"), text.alias("content"))
    # the shared class lies in one file more, made from the table's least key
    least = _read(spark, d, "region").agg(F.min("r_regionkey").cast("long").alias("file_ord"))
    box = "namespace Shop; public abstract class Bin<T> { public T Open() { return item; } protected T item; } public class Box<T> : Bin<T> { public Box<T> Next() { return this; } }"
    files = files.unionByName(least.select(F.lit("box").alias("path"), "file_ord", F.lit(box).alias("content"))).withColumn("language", F.lit(csharp.NAME))
    edges = csharp_bind.resolve(cut(extract_facts(_dealt(files))))
    return edges.groupBy("file_ord", "caller_class", "caller_method", "callee_class", "callee_method").agg(F.count("*").alias("n"))


def method_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of methods rendered from orders, angle brackets escaped."""
    text = F.concat(F.lit("public List<int> M"), "o_orderkey", F.lit("(Map<int, string> a"), "o_orderkey", F.lit(', string b = "x, y", int[] c) { return null; }'))
    own = _read(spark, d, "orders").select("o_orderkey", dataflow.parameters(text).alias("params"))
    return own.select("o_orderkey", F.array_join("params", "|").alias("params"))


def feature_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of one feature: sources of its methods, and the calls that touch their classes."""
    edges = star_graph(spark, d).withColumn("analysis_run_id", F.lit("run"))
    records, maps = features.map_features(features.explode_template(_template(spark, d)), _methods(spark, d), edges, "run", mode="direct")
    own = records.filter("feature_name = '2'").first()["id"]
    context = prompts.feature_context(own, records, maps, _methods(spark, d), edges)
    return prompts.feature_prompt(context, 25, "easy", "names").select("prompt")


def data_flow_diagrams(spark: SparkSession, d: str) -> DataFrame:
    """Diagrams of conversations as flows: a block for each role with what flows in it, then the calls."""
    _, steps = _flows(spark, d)
    steps = steps.select(F.lit("Turn").alias("entry_class"), F.col("business_flow_id").cast("string").alias("entry_method"), "caller_class", "caller_method", "callee_class", "callee_method", (F.col("step_order") + 1).alias("step_order"))
    roles = spark.createDataFrame([("Turn", "user", ["int a"]), ("Turn", "assistant", [])], "class_name string, method_name string, params array<string>")
    tokens = spark.createDataFrame([("m", "Turn", "user", 0, "a < 1", "x", "Assignment"), ("m", "Turn", "user", 1, "x", "RETURN_VALUE", "Return")], "method_id string, class_name string, method_name string, seq int, source_token string, target_token string, relation_type string")
    return graph.data_flow_diagrams(steps, roles, tokens).select("entry_method", "mermaid")


def _snippet_facts(spark: SparkSession, d: str, language: str, path: str, text: str) -> DataFrame:
    """Facts of one file for each supplier: the snippet with its key in place of ``{k}``."""
    key = F.col("s_suppkey").cast("string")
    own = lambda t: F.replace(F.lit(t), F.lit("{k}"), key)
    files = _read(spark, d, "supplier").select(own(path).alias("path"), F.lit(language).alias("language"), F.col("s_suppkey").alias("file_ord"), own(text).alias("content"))
    return extract_facts(_dealt(files))


def _edges_and_methods(facts: DataFrame) -> DataFrame:
    return facts.filter("kind in ('edge', 'method')").select("file_ord", "kind", "class_name", "method_name", "callee_class", "callee_method")


def java_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules of the Java scanner, each with what it takes and what it leaves."""
    return _edges_and_methods(_snippet_facts(spark, d, "Java (Spring Boot)", "src/Shop{k}.java", snippets.JAVA))


def python_rules(spark: SparkSession, d: str) -> DataFrame:
    return _edges_and_methods(_snippet_facts(spark, d, "Python (FastAPI)", "src/shop{k}.py", snippets.PYTHON))


def node_rules(spark: SparkSession, d: str) -> DataFrame:
    return _edges_and_methods(_snippet_facts(spark, d, "Node.js (Express)", "src/my-shop{k}.ts", snippets.NODE))


def csharp_rules(spark: SparkSession, d: str) -> DataFrame:
    """Calls that the C# binding keeps: fields, properties, parameters, statics, bases and interfaces."""
    facts = cut(_snippet_facts(spark, d, csharp.NAME, "Shop{k}.cs", snippets.CSHARP))
    return csharp_bind.resolve(facts).select("file_ord", "caller_class", "caller_method", "callee_class", "callee_method")


def csharp_methods(spark: SparkSession, d: str) -> DataFrame:
    facts = _snippet_facts(spark, d, csharp.NAME, "Shop{k}.cs", snippets.CSHARP)
    return facts.filter("kind = 'method'").select("file_ord", "class_name", "method_name")


def parse_report(spark: SparkSession, d: str) -> DataFrame:
    """Files that could not be parsed, beside those that could: unreadable ones, and ones of no known parser."""
    key = F.col("c_custkey")
    language = F.when(key % 7 == 0, "none").otherwise("Python (FastAPI)")
    content = F.when(key % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("def f"), key, F.lit("():\n    pass\n")))
    files = _read(spark, d, "customer").select(F.concat(F.lit("m"), key, F.lit(".py")).alias("path"), language.alias("language"), key.alias("file_ord"), content.alias("content"))
    _, methods, errors = call_graph(files)
    parsed = methods.select("path", F.col("method_name").alias("found"), F.lit(None).cast("string").alias("error"))
    return parsed.unionByName(errors.select("path", F.lit(None).cast("string").alias("found"), "error"))


def source_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths made from parts: kept by extension in any case, and if no folder on the way is a skipped one."""
    return source_files.source_paths(_made_paths(_read(spark, d, "part")).select("path")).select("path", "ext", "language")


def _made_paths(parts: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    folder = F.element_at(F.array(*[F.lit(x) for x in snippets.FOLDERS]), (key % len(snippets.FOLDERS) + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(x) for x in snippets.EXTENSIONS]), (key % len(snippets.EXTENSIONS) + 1).cast("int"))
    return parts.withColumn("path", F.concat(folder, F.lit("f"), key, ext))


def feature_methods(spark: SparkSession, d: str) -> DataFrame:
    """The methods of one feature; mappings whose method is gone drop out."""
    s = _read(spark, d, "supplier")
    maps = s.select(F.col("s_nationkey").cast("string").alias("feature_id"), F.col("s_suppkey").cast("string").alias("method_source_id"))
    methods = s.filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("method_name"))
    return lookup.methods_of_feature("3", maps, methods)


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "supplier").select("s_suppkey", T.stable_id(F.lit("run"), "s_name", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey"))).alias("id"))


def _answer(prompt: str, temperature: float) -> str:
    """Stands in for a model: answers of both key cases, no JSON for some prompts, a refusal for others."""
    if prompt.endswith("9"):
        raise prompts.ModelError(400, "refused")
    if prompt.endswith("7"):
        return "no json"
    return json.dumps([{"question": prompt, "suggestedAnswer": "yes", "difficulty": "easy"}, {"QUESTION": "again"}])


def generated_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions parsed from a model's answers, with the errors of those that are none."""
    asked = _read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("about "), "c_custkey").alias("prompt"))
    return prompts.generate(asked, "id", _answer)


def _impatient(prompt: str, temperature: float) -> str:
    """Stands in for a busy model: some prompts are answered by the second call only, some never, one kind is refused."""
    if prompt.endswith("3") and prompt not in _BUSY:
        _BUSY.add(prompt)
        raise prompts.ModelError(429, "busy")
    if prompt.endswith("5"):
        raise prompts.ModelError(503, "down")
    if prompt.endswith("9"):
        raise prompts.ModelError(400, "refused")
    return f"answer {prompt}"


_BUSY: set[str] = set()


def model_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Answers of two runs: the second asks only what the first, to a busier model, did not get."""
    asked = _read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("about "), "c_custkey").alias("prompt"))
    ledger = Ledger(spark, f"{shared_path(spark)}/ledger-{uuid.uuid4().hex}")
    first = ledger.ask(asked, "id", _impatient, 0.4, sleep=lambda s: None)
    ledger.compact()
    second = ledger.ask(asked, "id", lambda prompt, temperature: f"later {prompt}", 0.4)
    return first.select("id", F.col("answer").alias("first"), "error").join(second.select("id", F.col("answer").alias("second")), "id")


def repository_scan(spark: SparkSession, d: str) -> DataFrame:
    """A repository that tasks write, list and read: its source files in order, with their text."""
    root = f"{shared_path(spark)}/repository-{uuid.uuid4().hex}"

    def write(batches):
        for pdf in batches:
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                at = os.path.join(root, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "w", encoding="utf-8") as f:
                    f.write(text)
            yield pdf[["path"]]

    made = _made_paths(_read(spark, d, "part")).select("path", F.concat(F.lit("# "), F.coalesce("p_name", F.lit(""))).alias("text"))
    cut(made.mapInPandas(write, "path string"))
    return source_files.scan_repository(spark, root).select("path", "language", "file_ord", "content")


def store_changes(spark: SparkSession, d: str) -> DataFrame:
    """A store after inserts, a patch, a delete with all that is below, and a run put in place of an old one."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    at = F.lit("2024-01-01").cast("timestamp")
    n = _read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").cast("string").alias("id"), "n_name")
    s = _read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").cast("string").alias("analysis_run_id"), "s_name")
    store.insert("analysis_runs", n.select("id", F.col("n_name").alias("repository_path"), at.alias("created_at"), F.lit("old").alias("repo_language")))
    store.insert("method_sources", s.select("id", "analysis_run_id", F.lit("Supplier").alias("class_name"), F.col("s_name").alias("method_name"), F.lit("").alias("source_code")))
    store.insert("feature_records", s.select(F.concat(F.lit("f"), "id").alias("id"), "analysis_run_id", F.col("s_name").alias("feature_name"), at.alias("created_at")))
    store.insert("feature_method_mappings", s.select(F.concat(F.lit("m"), "id").alias("id"), F.concat(F.lit("f"), "id").alias("feature_id"), F.col("id").alias("method_source_id"), at.alias("mapped_at")))
    store.update("analysis_runs", n.filter("k % 5 = 0").select("id", F.lit("new").alias("repo_language"), F.lit("never").alias("repository_path")))
    store.delete("analysis_runs", n.filter("k % 7 = 0").select("id"))
    run = n.filter("k = 1").select(F.lit("fresh").alias("id"), F.lower("n_name").alias("repository_path"), at.alias("created_at"))
    own = n.filter("k = 1").select(F.lit("only").alias("id"), F.lit("fresh").alias("analysis_run_id"), F.lit("Supplier").alias("class_name"), F.lit("x").alias("method_name"), F.lit("").alias("source_code"))
    store.replace_run(run, {"method_sources": own})
    left = [
        store.table("analysis_runs").select(F.lit("analysis_runs").alias("kept"), "id", F.concat_ws(":", "repository_path", "repo_language").alias("what")),
        store.table("method_sources").select(F.lit("method_sources"), "id", "analysis_run_id"),
        store.table("feature_records").select(F.lit("feature_records"), "id", "analysis_run_id"),
        store.table("feature_method_mappings").select(F.lit("feature_method_mappings"), "id", "feature_id"),
    ]
    return left[0].union(left[1]).union(left[2]).union(left[3])


def exports(spark: SparkSession, d: str) -> DataFrame:
    """The files that a call graph is written to, with their contents."""
    nation = _read(spark, d, "nation")
    edges = nation.select(*_edge("Region<1>", F.col("n_regionkey"), "Nation", F.col("n_nationkey"), F.col("n_nationkey")), F.when(F.col("n_nationkey") % 2 == 0, "C# (.NET)").alias("language"))
    drawn = cut(graph.ordered_lines(edges, "edge_ord"))
    with tempfile.TemporaryDirectory() as out:  # sinks write where the driver is, and only it reads them
        export.write_json(edges, os.path.join(out, "output_graph.json"))
        export.write_markdown(export.lines_of(drawn), out)
        export.write_html(export.lines_of(drawn), out)
        rows = []
        for name in sorted(os.listdir(out)):
            with open(os.path.join(out, name), encoding="utf-8") as f:
                rows.append((name, f.read()))
    return spark.createDataFrame(rows, "file string, content string")


def analysis_response(spark: SparkSession, d: str) -> DataFrame:
    """A repository of four files for each nation, a folder that is skipped and a file that cannot be read, analysed."""
    texts = {"src/Shop{k}.java": snippets.JAVA, "src/shop{k}.py": snippets.PYTHON, "web/my-shop{k}.ts": snippets.NODE, "Shop{k}.cs": snippets.CSHARP, "node_modules/x{k}.js": snippets.NODE, "notes{k}.md": "class"}
    with tempfile.TemporaryDirectory() as root:  # as a clone is, on the driver's machine
        for r in _read(spark, d, "nation").select("n_nationkey").collect():
            for name, text in texts.items():
                path = os.path.join(root, "repository", name.replace("{k}", str(r[0])))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w", encoding="utf-8") as f:
                    f.write(text.replace("{k}", str(r[0])))
        os.symlink(os.path.join(root, "nowhere"), os.path.join(root, "repository", "broken.py"))
        engine = Engine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}")
        got = engine.analyze(os.path.join(root, "repository"), out=os.path.join(root, "out"), repo_name="shop")
    stored = engine.store.table("call_graph_edges").filter(F.col("analysis_run_id") == got.analysis_run_id).count()
    row = (got.message, got.edges_count, got.methods_count, got.parsed_count, got.error_count, stored, engine.run(got.analysis_run_id)["repo_name"])
    return spark.createDataFrame([row], "message string, edges_count long, methods_count long, parsed_count long, error_count long, stored_edges long, repo_name string")


QUERIES = [
    flow_trace, entry_points, edge_dedup, call_graph_diagram, diagram_text, flow_diagrams, call_sites, link_edges, source_lines, run_page, page_meta, point_lookup,
    in_list, flow_summary, flow_detail, step_listing, flow_prompts, example_page, example_choice, class_semi, event_edges, pascal_case, git_urls,
    files_by_language, feature_map, code_flow, patch_update, cascade_delete, mapping_cascade, replace_by_path, request_violations, parse_python, parse_java, parse_node,
    parse_csharp, data_flow, interface_calls, csharp_scopes, csharp_chains, method_parameters, feature_prompts, data_flow_diagrams,
    java_rules, python_rules, node_rules, csharp_rules, csharp_methods, parse_report, source_paths, feature_methods, stable_ids, generated_questions,
    store_changes, exports, analysis_response, repository_scan, model_ledger,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
