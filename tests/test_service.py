from __future__ import annotations

import json
import os

import pytest

from codeloom.errors import BadRequest, NotFound, Unprocessable, status_of
from codeloom.operators import dataflow, lookup, prompts
from codeloom.operators.store import Conflict, Store, cascade
from codeloom.plans import queries as plans
from codeloom.service import Engine
from codeloom.sources import files, git
from codeloom.sources.files import scan_repository


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    files = {
        "app/__init__.py": "def boot():\n    order_store.load()\n",
        "app/_private.py": "def run():\n    pass\n",
        "web/OrderController.java": '@RestController\npublic class OrderController {\n  @GetMapping("/o")\n  public Order list() {\n    orderService.findAll();\n  }\n}\n',
        "web/OrderService.JAVA": "@Service\r\npublic class OrderService {\r\n  public int findAll() {\r\n    orderRepo.load();\r\n  }\r\n}\r\n",
        "node_modules/x.js": "function skipped() {\n}\n",
        "Shop.cs": "﻿namespace S { public class ShopController { Till _till; public int Buy(int n) { int x = n + 1; _till.Pay(x); return x; } } public class Till { public void Pay(int x) { } } }",
        "template_feature.json": json.dumps([{"feature_name": "orders", "apis": [{"controller": "OrderController", "method": "GET list"}]}, {"feature_name": "none", "apis": [{"controller": "X", "method": "y"}]}]),
    }
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text.encode())
    return root


@pytest.fixture(scope="module")
def engine(spark, repo, tmp_path_factory):
    own = Engine(spark, str(tmp_path_factory.mktemp("store")))
    own.out = tmp_path_factory.mktemp("out")
    own.first = own.analyze(str(repo), str(own.out), repo_name="Shop", is_public=True)
    return own


def test_scan(spark, repo):
    rows = scan_repository(spark, str(repo)).orderBy("file_ord").collect()
    assert [r.path for r in rows] == ["Shop.cs", "app/__init__.py", "app/_private.py", "web/OrderController.java", "web/OrderService.JAVA"]
    assert rows[0].content.startswith("namespace")
    assert scan_repository(spark, str(repo), shipped=True).orderBy("file_ord").collect() == rows
    assert scan_repository(spark, str(repo), absolute_skip=True).count() == 5
    assert files.ship(spark, str(repo), [r.path for r in rows] + ["gone.py"], 10).filter("raw is null").count() == 1


def test_analysis_is_stored_and_exported(engine):
    got = engine.first
    edges = engine.store.table("call_graph_edges")
    assert got.edges_count == edges.count() and got.methods_count == engine.store.table("method_sources").count()
    assert (got.parsed_count, got.error_count, got.errors) == (5, 0, [])
    out = json.loads((engine.out / "output_graph.json").read_text())["CallGraph"]
    assert len(out) == got.edges_count and set(out[0]) == {"CallerClass", "CallerMethod", "CalleeClass", "CalleeMethod", "Language"}
    assert {"call_graph.md", "call_graph.html", "output_graph.html"} <= set(os.listdir(engine.out))


def test_flows(engine):
    page = engine.flows(name="ordercontroller")
    names = {r.name for r in page.items.collect()}
    assert names == {"OrderController.__CLASS__", "OrderController.GET list"} and page.total_count == 2
    row = next(r for r in page.items.collect() if r.name.endswith("GET list"))
    flow = engine.flow(row.id)
    assert [s.display_label for s in flow.steps] == ["OrderController.GET list → OrderService.findAll", "OrderService.findAll → OrderRepo.load"]
    shop = engine.flows(name="shopcontroller.buy").items.first()
    assert "param: int n" in engine.flow(shop.id).data_flow_mermaid_graph
    with pytest.raises(NotFound):
        engine.flow("nothing")


def test_features_and_questions(engine, spark, tmp_path):
    by_name = {r.feature_name: r.id for r in engine.features().collect()}
    assert [m.method_name for m in engine.code_flow(by_name["orders"]).methods] == ["list", "findAll"]
    assert engine.code_flow(by_name["none"]).methods == []
    engine.client = lambda prompt, temperature: json.dumps([{"Question": prompt[:9], "SUGGESTEDANSWER": "a", "difficulty": "d"}])
    assert engine.questions_from_feature(by_name["orders"], 21, "hard").first().question == "Number of"
    with pytest.raises(Unprocessable):
        engine.questions_from_feature(by_name["none"], 5, "hard")
    flow = engine.flows(name="get list").items.first()
    row = engine.questions_from_flow(flow.id, 3, "hard").first()
    assert (row.total_steps, row.few_shot_used) == (2, 0)
    with pytest.raises(BadRequest):
        engine.questions_from_flow(flow.id, 0, "hard")
    kept = Engine(spark, engine.store.root, engine.client, ledger=str(tmp_path / "ledger"))
    want = engine.questions_from_flow(flow.id, 3, "hard").collect()
    assert kept.questions_from_flow(flow.id, 3, "hard").collect() == want
    kept.client = None  # not called again
    assert kept.questions_from_flow(flow.id, 3, "hard").collect() == want


def test_a_second_analysis_replaces_the_first(engine, repo, tmp_path):
    again = engine.analyze(f' "{repo}" ', str(tmp_path))
    assert [r.id for r in engine.runs().items.collect()] == [again.analysis_run_id]
    assert engine.store.table("call_graph_edges").select("analysis_run_id").distinct().count() == 1
    assert engine.store.table("business_flow_steps").join(engine.store.table("business_flows").withColumnRenamed("id", "business_flow_id"), "business_flow_id", "left_anti").count() == 0


def test_examples(engine):
    key = engine.create_example(question=" q ", suggested_answer="a", difficulty="Hard", tag="T")
    assert engine.example(key).question == "q"
    engine.update_example(key, tag="new", question=None)
    assert (engine.example(key).tag, engine.example(key).question) == ("new", "q")
    assert engine.examples(difficulty="HARD", tag=" ").total_count == 1
    for bad in ({"question": ""}, {"question": "x" * 2001, "suggested_answer": "a", "difficulty": "d"}, {"nothing": 1}):
        with pytest.raises(BadRequest):
            engine.create_example(**bad)
    assert engine.delete_example(key) and not engine.delete_example(key)


def test_runs(engine):
    key = engine.create_run(repository_path="/x", repo_stars=3)
    engine.update_run(key, repo_owner="Me", repository_path="/y")
    assert (engine.run(key).repository_path, engine.run(key).repo_owner) == ("/x", "Me")
    with pytest.raises(BadRequest):
        engine.create_run(repository_path="/x", repo_stars=-1)
    assert engine.delete_run(key)


@pytest.mark.parametrize(("page", "size", "want"), [(0, 10, (1, 10)), (2, 0, (2, 10)), (1, 101, (1, 10)), (3, 100, (3, 100))])
def test_clamp(page, size, want):
    assert lookup.clamp(page, size) == want


def test_filters_are_literal(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), (None,)], "x string")
    assert lookup.where(df, [lookup.text_filter("x", " %B")]).count() == 1
    assert lookup.where(df, [lookup.text_filter("x", " ")]).count() == 3
    meta = lookup.page_metadata(df, 1, 2).first()
    assert (meta.total_count, meta.total_pages, meta.has_previous, meta.has_next) == (3, 2, False, True)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("int M() { return 1; }", [("1", "RETURN_VALUE", "Return")]),
        ("void M() { a.b += f(1, 2); for (int i = 0; i < 3; i++) { } var x = \"a=b\"; }", [("f(1, 2)", "a.b", "Assignment"), ('"a=b"', "x", "Assignment")]),
        ("void M() { if (a == b) { } int a = 1, b = 2; }", [("1", "a", "Assignment"), ("2", "b", "Assignment")]),
        ("void M() { var o = new P { X = 1, Y = z }; }", [("1", "X", "Assignment"), ("z", "Y", "Assignment"), ("new P { X = 1, Y = z }", "o", "Assignment")]),
        ("int M() => 3;", []),
    ],
)
def test_data_flow(text, want):
    assert dataflow.edges_of(text) == want


def test_parameters():
    assert dataflow.parameters_of("public async Task<int> M(List<int> a, string b = \"x\") { }") == ["List&lt;int&gt; a", "string b"]
    assert dataflow.parameters_of("void M() { }") == []


def test_retry_waits_and_gives_up():
    waits, calls = [], []

    def client(prompt, temperature):
        calls.append(prompt)
        raise prompts.ModelError(503)

    with pytest.raises(prompts.ModelError):
        prompts.call_with_retry(client, "p", 0.3, waits.append)
    assert (len(calls), waits) == (3, [3.0, 6.0])
    with pytest.raises(KeyError):
        prompts.call_with_retry(lambda p, t: {}["x"], "p", 0.3, waits.append)
    assert prompts.parse_answer("{") == ([], "{")


def test_git_urls():
    assert git.normalize_git_url(" https://GitHub.com/a/b/tree/x ") == "https://github.com/a/b.git"
    assert git.is_git_url("X.GIT") and not git.is_git_url("/tmp/x")
    assert status_of(TimeoutError()) == 504 and status_of(NotFound()) == 404 and status_of(Exception()) == 500


def test_a_change_writes_only_what_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    runs = "id string, repository_path string, created_at timestamp"
    edges = "id string, analysis_run_id string, caller_class string"
    flows, steps = "id string, analysis_run_id string, name string", "id string, business_flow_id string, caller_class string"

    def put(run_id, path, n):
        store.replace_run(
            spark.createDataFrame([(run_id, path, None)], runs),
            {
                "call_graph_edges": spark.createDataFrame([(f"{run_id}e{i}", run_id, "A") for i in range(n)], edges),
                "business_flows": spark.createDataFrame([(f"{run_id}f", run_id, "F")], flows),
                "business_flow_steps": spark.createDataFrame([(f"{run_id}s{i}", f"{run_id}f", "A") for i in range(n)], steps),
            },
        )

    put("r1", "/a", 3)
    put("r2", "/B", 2)
    _, before = store._manifest()
    put("r3", "/b", 4)  # the same repository as r2
    _, after = store._manifest()
    assert all([f for f in after[t] if f["run"] == "r1"] == [f for f in before[t] if f["run"] == "r1"] for t in before)
    assert {f["run"] for folders in after.values() for f in folders} == {"r1", "r3"}
    assert store.table("call_graph_edges").count() == 7 and store.table("call_graph_edges", "r3").count() == 4
    assert {r.id for r in store.table("analysis_runs").collect()} == {"r1", "r3"}
    # rows without a tag are found by their ids, down to the steps of their flows
    store.insert("analysis_runs", spark.createDataFrame([("r4", "/c", None)], runs))
    store.insert("business_flows", spark.createDataFrame([("x", "r4", "F"), ("y", "r1", "F")], flows))
    store.insert("business_flow_steps", spark.createDataFrame([("x1", "x", "A"), ("y1", "y", "A")], steps))
    store.delete("analysis_runs", spark.createDataFrame([("r4",)], "id string"))
    assert {r.id for r in store.table("business_flows").collect()} == {"r1f", "r3f", "y"}
    assert {r.id for r in store.table("business_flow_steps").filter("id like 'x%' or id like 'y%'").collect()} == {"y1"}
    store.update("call_graph_edges", spark.createDataFrame([("r1e0", "B")], "id string, caller_class string"))
    assert {r.id for r in store.table("call_graph_edges").filter("caller_class = 'B'").collect()} == {"r1e0"}
    assert [f for f in store._manifest()[1]["call_graph_edges"] if f["run"] == "r3"] == [f for f in after["call_graph_edges"] if f["run"] == "r3"]
    with pytest.raises(NotFound):
        store.delete("analysis_runs", spark.createDataFrame([("r9",)], "id string"), must_exist=True)
    rows = store.table("call_graph_edges").count()
    assert store.vacuum(1) > 0 and store.table("call_graph_edges").count() == rows


class Between(Store):
    """A store in which another writer publishes just before this one does."""

    other = None

    def _publish(self, number, manifest):
        if self.other:
            act, self.other = self.other, None
            act()
        return super()._publish(number, manifest)


def test_writers_of_different_runs_both_commit(spark, tmp_path):
    runs, edges = "id string, repository_path string, created_at timestamp", "id string, analysis_run_id string, caller_class string"
    ours, theirs = Between(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))

    def put(store, run_id, path, n=1):
        store.replace_run(spark.createDataFrame([(run_id, path, None)], runs), {"call_graph_edges": spark.createDataFrame([(f"{run_id}e{i}", run_id, "A") for i in range(n)], edges)})

    put(ours, "r1", "/a", 2)
    ours.other = lambda: (put(theirs, "r2", "/b"), put(theirs, "r3", "/c"))
    put(ours, "r4", "/A", 3)  # in place of r1, on top of both others
    assert {r.id for r in theirs.table("analysis_runs").collect()} == {"r2", "r3", "r4"}
    assert {r.id for r in theirs.table("call_graph_edges").collect()} == {"r2e0", "r3e0", "r4e0", "r4e1", "r4e2"}
    # the same repository, the same run, untagged rows
    before = ours._manifest()
    for other, mine in [
        (lambda: put(theirs, "r5", "/new"), lambda: put(ours, "r6", "/NEW")),
        (lambda: theirs.delete("analysis_runs", spark.createDataFrame([("r2",)], "id string")), lambda: put(ours, "r7", "/B")),
        (lambda: theirs.insert("few_shot_examples", spark.createDataFrame([("x", "q", "a", "easy")], "id string, question string, suggested_answer string, difficulty string")), lambda: put(ours, "r8", "/z")),
    ]:
        ours.other = other
        with pytest.raises(Conflict):
            mine()
    assert ours._manifest()[0] == before[0] + 3
    assert {r.id for r in ours.table("analysis_runs").collect()} == {"r3", "r4", "r5"}
    # what the failed writers wrote goes with the vacuum, once it is old enough
    folders = lambda: sum(len(list((tmp_path / "store" / t).iterdir())) for t in ("analysis_runs", "call_graph_edges"))
    ours.vacuum(1)
    held = folders()
    assert ours.vacuum(1, grace_seconds=-60) > 0 and folders() < held
    assert {r.id for r in ours.table("call_graph_edges").collect()} == {"r3e0", "r4e0", "r4e1", "r4e2", "r5e0"}


def test_methods_take_their_mappings_along(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.insert("method_sources", spark.createDataFrame([("m1", "r"), ("m2", "r")], "id string, analysis_run_id string"), "r")
    store.insert("feature_records", spark.createDataFrame([("f1", "r")], "id string, analysis_run_id string"), "r")
    store.insert("feature_method_mappings", spark.createDataFrame([("a", "f1", "m1"), ("b", "f1", "m2")], "id string, feature_id string, method_source_id string"), "r")
    store.delete("method_sources", spark.createDataFrame([("m1",)], "id string"))
    assert [r.id for r in store.table("feature_method_mappings").collect()] == ["b"]
    assert store.table("feature_records").count() == 1


def test_a_cascade_follows_all_ways(spark):
    rows = {
        "a": spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id long, up long"),  # refers to itself
        "b": spark.createDataFrame([(10, 1), (11, 4), (12, None)], "id long, a long"),
        "c": spark.createDataFrame([(20, 3, 11), (21, 4, 10), (22, 4, 11), (23, None, None)], "id long, a long, b long"),
    }
    found = cascade(rows.get, "a", rows["a"].filter("id = 1"), [("a", "up", "a"), ("b", "a", "a"), ("c", "a", "a"), ("c", "b", "b"), ("d", "c", "c")])
    assert {t: sorted(r.id for r in ids.collect()) for t, ids in found.items()} == {"a": [1, 2, 3], "b": [10], "c": [20, 21]}


def _tables(spark, root, **tables):
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize(("first", "kind"), [(4_611_686_016, "bigint"), (5_000_000_000, "decimal(38,0)")])
def test_mappings_are_summed_beyond_bigint(spark, tmp_path, first, kind):
    s1, s2, s3 = first + 1, first + 2, first + 3
    d = _tables(
        spark,
        tmp_path,
        nation=("n_nationkey int, n_regionkey int", [(0, 0), (1, 1)]),
        supplier=("s_suppkey long, s_nationkey int", [(s1, 0), (s2, 0), (s3, 1)]),
        part=("p_partkey long, p_size int", [(25, 1), (26, 1), (50, 41), (75, 40)]),
        lineitem=("l_suppkey long, l_partkey long", [(s1, 25), (s1, 25), (s1, 50), (s2, 26), (s2, 75), (s3, 25)]),
    )
    got = plans.mapping_cascade(spark, d)
    want = {("analysis_runs", 1, 0), ("feature_records", 2, s1 + s2), ("method_sources", 2, 100), ("feature_method_mappings", 2, (s1 + s2) * 1_000_000_000 + 100)}
    assert {(r.kept, r.n, int(r.ids)) for r in got.collect()} == want
    assert dict(got.dtypes)["ids"] == kind


@pytest.mark.parametrize(("first", "kind"), [(10, "bigint"), (900_000_000_000_000_000, "decimal(38,0)")])
def test_items_are_summed_beyond_bigint(spark, tmp_path, first, kind):
    d = _tables(
        spark,
        tmp_path,
        customer=("c_custkey long, c_mktsegment string", [(1, "BUILDING"), (2, "MACHINERY")]),
        orders=("o_orderkey long, o_custkey long", [(first, 2), (first + 1, 1)]),
        lineitem=("l_orderkey long, l_linenumber int", [(first, 1), (first, 2), (first + 1, 1)]),
    )
    got = plans.cascade_delete(spark, d)
    assert {(r.kept, r.n, int(r.ids)) for r in got.collect()} == {("customer", 1, 2), ("orders", 1, first), ("lineitem", 2, first * 20 + 3)}
    assert dict(got.dtypes)["ids"] == kind


def test_sums_of_nothing_are_null(spark, tmp_path):
    d = _tables(spark, tmp_path, customer=("c_custkey long, c_mktsegment string", []), orders=("o_orderkey long, o_custkey long", []), lineitem=("l_orderkey long, l_linenumber int", []))
    got = plans.cascade_delete(spark, d)
    assert {(r.kept, r.n, r.ids) for r in got.collect()} == {(t, 0, None) for t in ("customer", "orders", "lineitem")}
    assert dict(got.dtypes)["ids"] == "bigint"


DATA_FLOW = {
    "Java (Spring Boot)": ("int pay(int a) {\n  int x = a + 1;\n  this.y = x;\n  return x * 2;\n}", [("x", "this.y"), ("a + 1", "x"), ("x * 2", "RETURN_VALUE")]),
    "Node.js (Express)": (
        "function pay(a) {\n  const x = a\n    .then(b => b)\n  let $y = `;${a}`\n  var n: number = 3;\n  this.z = x\n  for (let i = 0; i < 2; i++) { }\n  return x\n}",
        [("x", "this.z"), ("a\n    .then(b => b)", "x"), ("`;${a}`", "_y"), ("3", "n"), ("x", "RETURN_VALUE")],
    ),
    "Python (FastAPI)": (
        "    def pay(self, a):\n        x = y = a + 1\n        self.z += x\n        n: int = 3\n        k: int\n        return x * (\n            2)\n",
        [("a + 1", "x"), ("a + 1", "y"), ("x", "self.z"), ("3", "n"), ("x * (\n        2)", "RETURN_VALUE")],
    ),
}


@pytest.mark.parametrize("language", [*DATA_FLOW])
def test_data_flow_of_other_languages(language):
    text, want = DATA_FLOW[language]
    assert [e[:2] for e in dataflow.edges_of(text, language)] == want
    assert dataflow.edges_of("", language) == dataflow.edges_of("(((", language) == []


def test_scanners_take_time_in_proportion():
    import time

    from codeloom.operators.extract import csharp

    def took(n):
        body = "".join(f" a{i} = b.Call{i}(new Thing(x{i}));" for i in range(n))
        text = f"class A {{ B b; void M() {{{body}}} }}"
        began = time.process_time()
        list(csharp.facts("a.cs", text))
        dataflow.edges_of(f"void M() {{{body}}}")
        return time.process_time() - began

    took(100)
    assert took(16_000) < 14 * max(took(2_000), 0.02)
