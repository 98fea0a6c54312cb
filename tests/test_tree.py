"""Trees that tasks list and read."""

import os
import subprocess

import pytest

from codeloom.operators import ranking
from codeloom.sources import tree
from codeloom.sources.files import SKIPPED, scan_repository


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "shop"
    made = {f"d{i % 7}/e{i % 3}/f{i}.py": f"def f{i}():\n    pass\n".encode() for i in range(60)}
    made |= {"_top.py": b"\xef\xbb\xbfx = 1\n", "a b/ü.java": "class Ü {}".encode(), "node_modules/p/q.js": b"skipped", "src/Node_Modules/r.js": b"skipped", "empty.py": b"", "bad.py": b"\xff\xfe"}
    for path, raw in made.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(raw)
    return root


def plain(root):
    """The files by a walk on one machine."""
    found = {}
    for at, _, names in os.walk(root):
        for name in names:
            path = os.path.relpath(os.path.join(at, name), root)
            if not {p.lower() for p in path.split("/")} & set(SKIPPED) and path.rsplit(".", 1)[-1] in ("py", "java", "js"):
                with open(os.path.join(root, path), "rb") as f:
                    found[path] = f.read().removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    return [(p, k, found[p]) for k, p in enumerate(sorted(found))]


def rows(df):
    return [(r.path, r.file_ord, r.content) for r in df.orderBy("file_ord").collect()]


@pytest.mark.parametrize("subtrees", [1, 4, 1000])
def test_any_division_gives_the_same_files(spark, folder, subtrees, monkeypatch):
    monkeypatch.setattr(tree, "SUBTREES", subtrees)
    monkeypatch.setattr(tree, "BATCH_PATHS", 7)
    parts = tree._FolderReader(str(folder), frozenset(SKIPPED), 3).partitions()
    reader = tree._FolderReader(str(folder), frozenset(SKIPPED), 3)
    got = sorted(p for part in parts for batch in reader.read(part) for p in batch.column(0).to_pylist())
    assert got == sorted(p for p in (os.path.relpath(os.path.join(a, n), folder) for a, _, names in os.walk(folder) for n in names) if "ode_" not in p)
    assert not any("ode_" in f for part in parts for f in part.folders)


def test_a_scan_equals_a_plain_walk(spark, folder, monkeypatch):
    want = plain(folder)
    assert rows(scan_repository(spark, str(folder))) == want == rows(scan_repository(spark, str(folder), shipped=True))
    monkeypatch.setattr(ranking, "FEW", 10)
    assert rows(scan_repository(spark, str(folder))) == want


def test_links_and_unreadable_files(spark, tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "real/a.py").write_text("a")
    os.symlink(tmp_path / "real", tmp_path / "again")
    os.symlink(tmp_path / "real/a.py", tmp_path / "link.py")
    os.symlink(tmp_path / "nowhere", tmp_path / "gone.py")
    got = {r.path: r for r in scan_repository(spark, str(tmp_path)).collect()}
    assert set(got) == {"real/a.py", "link.py", "gone.py"} and got["link.py"].content == "a"
    assert got["gone.py"].content is None and "No such file" in got["gone.py"].error


def test_empty_and_absent_trees(spark, tmp_path):
    assert scan_repository(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="No such file"):
        scan_repository(spark, str(tmp_path / "absent")).count()


def test_commits_are_read_from_git_objects(spark, folder, tmp_path):
    work, bare = tmp_path / "work", tmp_path / "bare.git"
    subprocess.run(["cp", "-r", str(folder), str(work)], check=True)
    run = lambda *a, at=work: subprocess.run(["git", "-C", str(at), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    (work / "later.py").write_text("x")
    run("add", "-A")
    run("commit", "-qm", "two")
    run("clone", "-q", "--bare", str(work), str(bare))
    assert rows(scan_repository(spark, str(bare), rev="HEAD~1")) == plain(folder)
    assert rows(scan_repository(spark, str(bare), rev="HEAD")) == plain(work)
    with pytest.raises(OSError, match="rev-parse"):
        scan_repository(spark, str(bare), rev="nothing")
