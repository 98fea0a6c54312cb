from codeloom.streaming.rescan import facts, rescan


def test_each_file_is_taken_in_once(spark, tmp_path):
    src, out, mark = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    (src / "a.py").write_text("def f():\n    b.c()\n")
    rescan(spark, str(src), out, mark)
    (src / "b.js").write_text("function g() {\n}\n")
    rescan(spark, str(src), out, mark)
    rows = facts(spark, out).filter("kind = 'method'").collect()
    assert sorted(r.method_name for r in rows) == ["f", "g"]
