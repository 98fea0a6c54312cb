"""One accepted and one rejected snippet per extraction rule, and whole files."""

from __future__ import annotations

import pandas as pd
import pytest

from codeloom.operators import extract
from codeloom.operators.extract import PARSERS, call_graph, extract_facts
from codeloom.operators.extract.base import scan
from codeloom.operators.extract.csharp import NAME as CSHARP
from codeloom.operators.extract.csharp import facts as csharp_facts
from codeloom.operators.extract.csharp_bind import arguments, resolve
from codeloom.operators.extract.java import JAVA
from codeloom.operators.extract.node import NODE
from codeloom.operators.extract.python import PYTHON
from codeloom.schemas import SOURCE_FILES


def edges(language, text, path="dir/my-file.x"):
    return [f[1:5] for f in scan(language, path, text) if f[0] == "edge"]


def methods(language, text, path="dir/my-file.x"):
    return [(f[1], f[2]) for f in scan(language, path, text) if f[0] == "method"]


def test_java_class_is_first_match_even_in_comments():
    assert methods(JAVA, "// this class handles x\npublic int run() {\n}\n") == [("handles", "run")]
    assert methods(JAVA, "public int run() {\n}\n") == [("my-file", "run")]
    assert methods(JAVA, "interface A {}\npublic int run() {\n}\n") == [("my-file", "run")]


def test_java_mapping_consumes_its_line_and_names_the_next_method():
    text = '@RestController\nclass A {\n@GetMapping("/x")\npublic int list() {\n}\n@PostMapping public int add() {\n}\n}'
    assert edges(JAVA, text) == [("A", "__CLASS__", "A", "GET list")]
    assert methods(JAVA, text) == [("A", "list")]


def test_java_methods():
    assert methods(JAVA, "class A {\nint x() {\n}\n}") == []
    assert methods(JAVA, "class A {\npublic A() {\n}\n}") == []
    assert methods(JAVA, "class A {\n@Override public int x() {\n}\n}") == [("A", "x")]
    assert methods(JAVA, "class A {\npublic a.B x() {\n}\n}") == []


def test_java_entry_needs_spring_and_public_or_verb():
    assert edges(JAVA, "@Service\nclass A {\nprivate int x() {\n}\n}") == []
    assert edges(JAVA, "@Service\nclass A {\npublic int x() {\n}\n}") == [("A", "__CLASS__", "A", "x")]
    assert edges(JAVA, "class A {\npublic int x() {\n}\n}") == []


def test_java_body_is_capped_and_nested_declarations_follow():
    body = "\n".join(f"b.c{i}();" for i in range(300))
    assert len(edges(JAVA, "class A {\npublic int x() {\n" + body + "\n}\n}")) == 199
    assert methods(JAVA, "class A {\npublic int x() {\npublic int y() {\n}\n}\n}") == [("A", "x"), ("A", "y")]


def test_java_calls():
    text = "class A {\npublic int x() {\nuserService.find(1); helper(); new Foo(); System.out(); list.add(2); // c.d()\n// e.f();\na.b().c(); A.x();\n}\n}"
    assert edges(JAVA, text) == [
        ("A", "x", "UserService", "find"), ("A", "x", "A", "Foo"), ("A", "x", "C", "d"), ("A", "x", "A", "b")
    ]


def test_java_verb_resets():
    assert edges(JAVA, '@Service\nclass A {\n@GetMapping("x")\nint y;\nprivate int x() {\n}\n}') == []
    assert edges(JAVA, '@Service\nclass A {\n@GetMapping("x")\n@Other\n// c\n\nprivate int x() {\n}\n}') == [("A", "__CLASS__", "A", "GET x")]


def test_python_classes():
    assert methods(PYTHON, "class A(B):\n    def f(self):\n        pass\ndef g():\n    pass") == [("A", "f"), ("A", "g")]
    assert methods(PYTHON, "class A(B(1)):\n    def f(self):\n        pass") == [("my-file", "f")]
    assert methods(PYTHON, "class A :\n  def f(): pass") == [("A", "f")]


def test_python_routes_and_privates():
    assert edges(PYTHON, "@app.get('/x')\nasync def f():\n    pass", "m.py") == [("m", "__CLASS__", "m", "GET f")]
    assert edges(PYTHON, "@self.router.post('/x')\ndef f():\n    pass", "m.py") == [("m", "__CLASS__", "m", "f")]
    assert methods(PYTHON, "def _f():\n    pass\ndef __init__(self):\n    pass", "m.py") == [("m", "__init__")]
    assert edges(PYTHON, "def __init__(self):\n    pass", "m.py") == []
    assert edges(PYTHON, "@app.get('/x')\n# c\nx = 1\ndef f():\n    pass", "m.py") == [("m", "__CLASS__", "m", "f")]


def test_python_bodies_and_calls():
    text = "def f(a,\n      b\n):\n    user_store.load(a)\n"
    assert edges(PYTHON, text, "m.py") == [("m", "__CLASS__", "m", "f")]
    text = "def f():\n    user_store.load(a)\n    self.go()\n    helper()\n    Thing()\n    print(x.get())\n    # c.d()\n    f()\n    a._b()\ng.h()"
    assert edges(PYTHON, text, "m.py") == [("m", "__CLASS__", "m", "f"), ("m", "f", "UserStore", "load"), ("m", "f", "Self", "go"), ("m", "f", "m", "helper")]
    assert len(edges(PYTHON, "def f():\n" + "\n".join(f"    a.b{i}()" for i in range(400)), "m.py")) == 150


def test_node_rules():
    assert edges(NODE, "router.get('/x', h)\nmyapp.post(\"/y\")\napp.use(fn)\napp.get(`/z`)") == [("MyFile", "__CLASS__", "MyFile", "GET /x"), ("MyFile", "__CLASS__", "MyFile", "POST /y")]
    assert edges(NODE, "@Getter()\nfunction f() {\n}") == [("MyFile", "__CLASS__", "MyFile", "GET f")]
    assert methods(NODE, "const f = async (a) => {\n}\nconst g = (a): number => {\n}\nexports.h = function () {}") == [("MyFile", "f")]
    assert methods(NODE, "class A {\n  run(a) {\n  }\n  public go() {\n  }\n  constructor() {\n  }\n}") == [("A", "run")]
    assert methods(NODE, "  run(a) {\n  }") == []


def test_node_calls():
    text = "class A {\n  run(a) {\n    this.x(); user_api.load(); helper(); Thing(); a.then(); run();\n  }\n}"
    assert edges(NODE, text) == [("A", "__CLASS__", "A", "run"), ("A", "run", "UserApi", "load"), ("A", "run", "A", "helper")]
    assert edges(NODE, "const f = a => b.c(a)\nd.e()") == [("MyFile", "__CLASS__", "MyFile", "f"), ("MyFile", "f", "B", "c")]


SHOP = """
using System;
namespace Shop.Core;
// class Ghost { void M() { } }
public interface IStore { Order Load(int id); }
public class Base { protected ILog _log; public void Note(string s) { } }
public class SqlStore : Base, IStore
{
    public Order Load(int id) { Note("x"); return new Order(); }
}
public abstract class Half : IStore { public abstract Order Load(int id); }
public class OrderController : Base
{
    private readonly IStore _store;
    public Helper Tools { get; set; }
    public OrderController(IStore store) { _store = store; _store.Load(0); }
    public Order Get(int id) => _store.Load(id);
    public void Run(Helper h)
    {
        Order o = this._store.Load(1);
        o.Pay(); h.Go(); Tools.Go(); Helper.Make(); base.Note("a{b"); Console.WriteLine("x"); Unknown.Call();
        var x = new Helper(); x.Go();
    }
}
public class Helper { public void Go() { } public static Helper Make() { return null; } }
public class Order { public void Pay() { } }
public class AddMigration { public void Up() { } }
"""


@pytest.fixture(scope="module")
def shop(spark):
    files = spark.createDataFrame([("a.cs", ".cs", CSHARP, 0, SHOP), ("b.py", ".py", "Python (FastAPI)", 1, "def f():\n    a.b()\n"), ("c.py", ".py", "Python (FastAPI)", 2, "def f():\n    a.b()\n")], SOURCE_FILES)
    return call_graph(files)


def test_csharp_binding(shop):
    got = {(r.caller_class, r.caller_method, r.callee_class, r.callee_method) for r in shop[0].filter("language like 'C#%'").collect()}
    run = "OrderController", "Run"
    assert got == {
        ("SqlStore", "Load", "Base", "Note"), ("OrderController", "Get", "IStore", "Load"), ("IStore", "Load", "SqlStore", "Load"),
        (*run, "IStore", "Load"), (*run, "Order", "Pay"), (*run, "Helper", "Go"), (*run, "Helper", "Make"), (*run, "Base", "Note"),
    }


def test_csharp_methods(shop):
    names = {(r.class_name, r.method_name) for r in shop[1].filter("language like 'C#%'").collect()}
    assert ("OrderController", "Run") in names and ("IStore", "Load") in names
    assert not any("Migration" in c or c == "Ghost" for c, _ in names)


def test_edges_are_ordered_by_file_and_place(shop):
    rows = shop[0].orderBy("edge_ord").collect()
    assert [r.caller_class for r in rows][-4:] == ["b", "b", "c", "c"]


def test_a_failing_parser_gives_an_error_row(spark, monkeypatch):
    def bad(path, text):
        raise ValueError("no")

    monkeypatch.setitem(PARSERS, "Python (FastAPI)", bad)
    files = spark.createDataFrame([("b.py", ".py", "Python (FastAPI)", 1, "x"), ("c.java", ".java", "Java (Spring Boot)", 2, "class A {\npublic int f() {\n}\n}")], SOURCE_FILES)
    rows = extract_facts(files).collect()
    assert sorted(r.kind for r in rows) == ["error", "method"]


def test_csharp_scanner_survives_odd_text():
    for text in ("", "}}}}", "class A {", 'class A { void M() { "', "namespace X { class A { int P => 3; void M(int a = 1) { if (a) { } } } }"):
        list(csharp_facts("x.cs", text))


def test_csharp_locals_from_calls_and_extension_methods(spark):
    text = """
namespace Shop;
public class Order { public void Pay() { } public Line First() { return null; } }
public class Line { public void Print() { } }
public static class OrderTools { public static void Mail(this Order o) { } public static void Pay(this Order o) { } }
public class Store { public async Task<Order> LoadAsync(int id) { return null; } public Order Load() { return null; } }
public class Desk
{
    private readonly Store _store;
    Order Own() { return null; }
    void Run()
    {
        var a = _store.Load();
        var b = await _store.LoadAsync(1);
        var c = Own();
        var d = a.First();
        a.Pay();
        b.Mail();
        c.Pay();
        d.Print();
    }
}
"""
    files = spark.createDataFrame([("a.cs", CSHARP, 0, text)], "path string, language string, file_ord long, content string")
    found = {(r.callee_class, r.callee_method) for r in resolve(extract_facts(files)).filter("caller_method = 'Run'").collect()}
    assert found == {("Store", "Load"), ("Store", "LoadAsync"), ("Desk", "Own"), ("Order", "First"), ("Order", "Pay"), ("OrderTools", "Mail"), ("Line", "Print")}


def bound(spark, **files):
    rows = [(f"{name}.cs", CSHARP, i, text) for i, (name, text) in enumerate(files.items())]
    df = spark.createDataFrame(rows, "path string, language string, file_ord long, content string")
    return resolve(extract_facts(df).persist()).filter("callee_class is not null")


def callees(edges, method="Run"):
    return sorted((r.callee_class, r.callee_method) for r in edges.filter(f"caller_method = '{method}'").collect())


TWO = """
namespace A { public class Account { public void PayA() { } public class Line { public void PrintA() { } } } public class Store { public Account item; } }
namespace B { public class Account { public void PayB() { } public static Account Make() { return null; } } public class Store { public Account item; } }
public class Account { public void PayGlobal() { } }
"""


SCOPES = [
    ("using A;\nnamespace Use;", "Store s; void Run() { s.item.PayA(); s.item.PayB(); }", [("Account", "PayA")]),
    ("using B;\nnamespace Use;", "Store s; void Run() { s.item.PayA(); s.item.PayB(); }", [("Account", "PayB")]),
    ("using Acc = B.Account;\nnamespace Use;", "void Run(Acc a) { a.PayB(); a.PayA(); Acc.Make(); }", [("Account", "Make"), ("Account", "PayB")]),
    ("namespace Use;", "void Run() { A.Account a = null; a.PayA(); B.Account.Make().PayB(); Account c; c.PayGlobal(); }", [("Account", "Make"), ("Account", "PayA"), ("Account", "PayB"), ("Account", "PayGlobal")]),
    ("using B;\nnamespace A.Inner;", "void Run(Account a) { a.PayA(); a.PayB(); }", [("Account", "PayA")]),  # around before using
    ("namespace A;", "void Run(Account.Line x) { x.PrintA(); }", [("Line", "PrintA")]),
    ("namespace A;", "class Account { public void Own() { } } void Run(Account x) { x.Own(); x.PayA(); }", [("Account", "Own")]),
    ("namespace Use;", "class Inner { void Deep() { Run(); Helper.Go(); } } static class Helper { public static void Go() { Go2(); } static void Go2() { } } void Run() { Helper.Go(); }", [("Helper", "Go")]),
]


def test_csharp_scopes(spark):
    edges = bound(spark, lib=TWO, **{f"use{i}": f"{head}\npublic class Use{i} {{ {body} }}" for i, (head, body, _) in enumerate(SCOPES)})
    got = edges.filter("caller_method = 'Run'").collect()
    for i, (head, body, want) in enumerate(SCOPES):
        assert sorted((r.callee_class, r.callee_method) for r in got if r.caller_class == f"Use{i}") == want, (head, body)


def test_csharp_partial_classes_and_global_usings(spark):
    edges = bound(
        spark,
        a="namespace P; public partial class Both { Part one; void Run() { one.Go(); Other(); } }",
        b="namespace P; public partial class Both { void Other() { } }",
        c="namespace Far; public class Part { public void Go() { } }",
        d="global using Far;",
    )
    assert callees(edges) == [("Both", "Other"), ("Part", "Go")]


GENERIC = """
namespace G;
public interface ISource<T> { T One(); ISource<T> Where(); }
public abstract class Base<T> : ISource<T> { public T One() { return default; } public ISource<T> Where() { return this; } public T this[int i] { get { return default; } } }
public class Repo : Base<Order> { public Box<Line> Lines() { return null; } public TOut As<TOut>() { return default; } public Order[] Many() { return null; } }
public class Box<T> { public T Open() { return default; } public Box<Box<T>> Wrap() { return null; } public T item; }
public class Box { public Order Open() { return null; } }
public class Order { public Order Next() { return this; } public void Pay() { } public Task<Line> LineAsync() { return null; } }
public class Line { public void Print() { } }
public static class More { public static T Best<T>(this IEnumerable<T> all) { return default; } public static Line Sum(this Order o) { return null; } public static T Same<T>(this T x) { return x; } }
"""


CHAINS = [
    ("o.Next().Next().Pay();", [("Order", "Next"), ("Order", "Next"), ("Order", "Pay")]),
    ("repo.One().Pay();", [("Base", "One"), ("Order", "Pay")]),
    ("var x = repo.Where(); x.One().Pay();", [("Base", "Where"), ("ISource", "One"), ("Order", "Pay")]),
    ("repo.Lines().Open().Print();", [("Box", "Open"), ("Line", "Print"), ("Repo", "Lines")]),
    ("repo.Lines().Wrap().Open().item.Print();", [("Box", "Open"), ("Box", "Wrap"), ("Line", "Print"), ("Repo", "Lines")]),
    ("repo.As<Line>().Print(); repo.As<Box<Order>>().Open().Pay();", [("Box", "Open"), ("Line", "Print"), ("Order", "Pay"), ("Repo", "As"), ("Repo", "As")]),
    ("new Box<Line>(1, o.Next()).Open().Print(); new Box().Open().Pay();", [("Box", "Open"), ("Box", "Open"), ("Line", "Print"), ("Order", "Next"), ("Order", "Pay")]),
    ("(await o.LineAsync()).Print(); ((Order)thing).Pay(); (thing as Line)?.Print();", [("Line", "Print"), ("Line", "Print"), ("Order", "LineAsync"), ("Order", "Pay")]),
    ("foreach (var a in list) { a.Pay(); } foreach (var b in repo.Many()) b.Pay(); list[0].Pay(); repo[1].Pay(); map[\"k\"].Print();", [("Line", "Print")] + [("Order", "Pay")] * 4 + [("Repo", "Many")]),
    ("list.Best().Sum().Print();", [("Line", "Print"), ("More", "Best"), ("More", "Sum")]),
    ("if (thing is Order p && p.Next() != null) p.Pay(); Get(out Line l); l.Print();", [("Line", "Print"), ("Order", "Next"), ("Order", "Pay")]),
    ("var y = flag ? o : null; y.Pay(); var z = o ?? o; z.Pay(); o.Missing().Pay();", [("Order", "Pay")]),
    ("o\n  .Next() // one\n  ?.Next()!\n  .Pay();", [("Order", "Next"), ("Order", "Next"), ("Order", "Pay")]),
]


def test_csharp_chains_and_generics(spark):
    use = "namespace G; public class Use{} {{ Repo repo; List<Order> list; Dictionary<string, Line> map; void Run(Order o, object thing, bool flag) {{ {} }} }}"
    got = bound(spark, lib=GENERIC, **{f"use{i}": use.format(i, body) for i, (body, _) in enumerate(CHAINS)}).filter("caller_method = 'Run'").collect()
    for i, (body, want) in enumerate(CHAINS):
        assert sorted((r.callee_class, r.callee_method) for r in got if r.caller_class == f"Use{i}") == want, body


def test_csharp_calls_are_ordered_as_in_a_tree_walk(spark):
    use = "namespace G; public class Use { void Run(Order o, Box<Order> b) { o.Next().Eat(b.Open().Next()).Pay(); o.Pay(); } }"
    lib = GENERIC.replace("public void Pay() { }", "public void Pay() { } public Order Eat(Order x) { return this; }")
    rows = sorted((r.seq, r.callee_method) for r in bound(spark, lib=lib, use=use).filter("caller_method = 'Run'").collect())
    assert [m for _, m in rows] == ["Pay", "Eat", "Next", "Next", "Open", "Pay"]


def test_interfaces_lead_to_inherited_implementations(spark):
    text = """
namespace I;
public interface IA<T> { T Do(); }
public class Impl : IA<Thing> { public Thing Do() { return null; } }
public class Child : Impl { }
public abstract class Half : IA<Thing> { public abstract Thing Do(); }
public class Thing { public void End() { } }
public class Use { IA<Thing> a; void Run() { a.Do().End(); } }
namespace Other; public class Impl { public void Do() { } }
"""
    edges = bound(spark, a=text.replace("namespace Other; public class Impl { public void Do() { } }", ""), b="namespace Other; public class Impl { public void Do() { } }")
    assert callees(edges) == [("IA", "Do"), ("Thing", "End")]
    assert callees(edges, "Do") == [("Impl", "Do")]


def test_written_types():
    from codeloom.operators.extract.csharp import Types

    types = Types({"Acc": "B.Account"}, {"T": "!0"})
    assert types.write("Dictionary<string, List<T?[]>>?") == "@Dictionary`2;<@string;,@List`1;<@[]`1;<!0>>>"
    assert types.write("Acc") == "@B.Account;" and types.result("Task<Acc>") == "@B.Account;" and types.write("void") == ""
    assert arguments("A`2<B`1<C,D>,E>") == ["B`1<C,D>", "E"] and arguments("A") == []


def test_long_chains_cost_in_proportion():
    import time

    def took(n):
        body = "a" + ".Next(b.Get(1))" * n + ";"
        began = time.process_time()
        found = list(csharp_facts("a.cs", f"class A {{ void M(B a, B b) {{ {body} }} }}"))
        assert sum(f[0] == "cs_call" for f in found) == 2 * n and sum(f[0] == "cs_chain" for f in found) == n + 1
        return time.process_time() - began

    took(50)
    assert took(8000) < 14 * max(took(1000), 0.02)


def test_facts_are_handed_on_in_slices(monkeypatch):
    monkeypatch.setattr(extract, "SLICE", 6)
    text = "export class A {\n  load(id) {\n    store.fetch(id);\n  }\n}\n"
    files = pd.DataFrame({"path": [f"f{i}.js" for i in range(40)], "language": NODE.name, "file_ord": range(40), "content": text})
    each = len(list(scan(NODE, "f0.js", text)))
    frames = list(extract._in_slices(dict(PARSERS))([files]))
    assert max(len(f) for f in frames) < 6 + each and len(frames) > 5
    assert sum(len(f) for f in frames) == 40 * each and pd.concat(frames)["path"].nunique() == 40


def test_binding_sends_no_table_whole(spark):
    """Estimates of facts are far too low to choose a broadcast by."""
    text = "namespace S { public interface I { void Go(); } public class A : I { public void Go() { } } public class B { I _i; public void Run() { _i.Go(); } } }"
    files = spark.createDataFrame([("a.cs", CSHARP, 0, text)], "path string, language string, file_ord long, content string")
    edges = resolve(extract_facts(files))
    assert {(r.caller_class, r.callee_class) for r in edges.collect()} == {("B", "I"), ("I", "A")}
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()
