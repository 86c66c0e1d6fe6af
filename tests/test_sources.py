import subprocess

import pytest
from helpers import make, rows
from pyspark.sql import functions as F

from graphloom.index import Index, read_meta
from graphloom.sources import build, files, git
from graphloom.sources.parse import doc, parse
from graphloom.streaming import events

PY = 'import os\nfrom .util import helper\n\nLIMIT = 3\n\nclass Base:\n    pass\n\nclass Kid(Base, metaclass=M):\n    """A kid."""\n    def run(self, x: Base) -> int:\n        return helper(self.step(x))\n\n    def step(self, x):\n        return x\n\ndef main():\n    Kid().run(1)\n'
RS = "use std::fs;\n/// Adds.\nfn add(a: i32) -> i32 {\n    helper(a)\n}\nfn helper(a: i32) -> i32 { a }\n"


def source(spark, *rows_):
    return spark.createDataFrame([(p, c, {"py": "python", "rs": "rust"}[p.rpartition(".")[2]]) for p, c in rows_], "path string, content string, language string")


def test_python_symbols():
    symbols, refs, imports, edges = parse(PY, "python")
    assert [(s[0], s[1], s[5]) for s in symbols] == [("LIMIT", "constant", None), ("Base", "class", None), ("Kid", "class", None), ("run", "method", "Kid"), ("step", "method", "Kid"), ("main", "function", None)]
    assert ("Kid", "Base", "extends") in edges and len(edges) == 1
    assert imports == ["os", ".util"]
    calls = {(r[0], r[5]) for r in refs if r[1] == "call"}
    assert {("helper", "run"), ("step", "run"), ("run", "main")} <= calls
    assert [s[:3] for s in parse("def broken(:", "python")[0]] == [("broken", "function", 1)]  # by its form, where the grammar fails


@pytest.mark.parametrize("language, text, names, parents", [
    ("rust", RS + "trait Show { fn s(&self); }\nimpl Show for P {\n fn s(&self) {}\n}\n", {"add", "helper", "Show"}, {("P", "Show", "implements")}),
    ("go", 'package m\nimport "fmt"\ntype T struct {\n}\nfunc (t T) Run() {\n\tfmt.Println(1)\n}\n', {"T", "Run"}, set()),
    ("java", "import a.B;\npublic class C extends D implements E, F {\n  public void run() {\n    go();\n  }\n}\n", {"C", "run"}, {("C", "D", "extends"), ("C", "E", "implements"), ("C", "F", "implements")}),
    ("typescript", "import {x} from './x';\nexport class A extends B {\n}\ninterface I {\n}\nfunction f() {\n}\n", {"A", "I", "f"}, {("A", "B", "extends")}),
    ("ruby", "require 'x'\nclass A < B\n  def run\n    go()\n  end\nend\n", {"A", "run"}, {("A", "B", "extends")}),
    ("csharp", "using System;\nclass A : B, IC {\n  public void Run() {\n  }\n}\n", {"A", "Run"}, {("A", "B", "extends"), ("A", "IC", "implements")}),
    ("cpp", "#include <x.h>\nclass A : public B {\n};\nint run(int a) {\n  return go(a);\n}\n", {"A", "run"}, {("A", "B", "extends")}),
    ("php", "<?php\nuse X\\Y;\nclass A extends B {\n  function run() {\n    go();\n  }\n}\n", {"A", "run"}, {("A", "B", "extends")}),
])
def test_other_languages(language, text, names, parents):
    symbols, refs, imports, edges = parse(text, language)
    assert names <= {s[0] for s in symbols}
    assert set(edges) == parents
    assert language == "rust" or imports


def test_docs_are_cut_at_words():
    assert doc(None) is None and doc(" a \n b ") == "a b"
    long = doc("word " * 60)
    assert long.endswith("word...") and len(long) <= 203


def test_index_build_resolves(spark):
    ix = build.index(source(spark, ("a.py", PY), ("util.py", "def helper(x):\n    return x\n"), ("lib.rs", RS)))
    names = {r.id: r.name for r in ix.symbols.collect()}
    refs = {(r.name, r.file): r for r in ix.refs.collect()}
    assert names[refs["helper", "lib.rs"].target_id] == "helper" and refs["helper", "lib.rs"].confidence == 0.85
    assert names[refs["helper", "a.py"].caller_id] == "run"
    assert refs["helper", "a.py"].target_id is None  # two files define it
    assert refs["step", "a.py"].confidence == 0.85
    assert [(names[r.child_id], names[r.parent_id]) for r in ix.type_edges.collect()] == [("Kid", "Base")]
    assert ix.files.count() == 3


def test_update_skips_same_hashes_and_deletes(spark, tmp_path):
    ix = build.index(source(spark, ("a.py", "def f():\n    g()\n"), ("b.py", "def g():\n    pass\n")))
    new = build.updated(ix, source(spark, ("a.py", "def f():\n    g()\n"), ("b.py", "def h():\n    pass\n")))
    assert {r.name for r in new.symbols.collect()} == {"f", "h"}
    assert rows(new.refs, "name", "target_id") == [("g", None)]
    gone = build.reconcile(ix, source(spark, ("a.py", "def f():\n    g()\n")))
    assert rows(gone.files, "path") == [("a.py",)] and gone.symbols.count() == 1
    ix.save(str(tmp_path / "ix"), {"repo": "r"})
    assert Index.load(spark, str(tmp_path / "ix")).symbols.count() == 2 and read_meta(spark, str(tmp_path / "ix")) == {"repo": "r"}


def test_chunks_and_embedding(spark):
    ix = build.index(source(spark, ("lib.rs", RS)))
    text = source(spark, ("lib.rs", RS))
    got = {r.chunk for r in build.chunks(ix.symbols, ix.imports, text).collect()}
    assert "File: lib.rs\nImports: std::fs\n---\nfn helper(a: i32) -> i32 { a }" in got
    short = build.chunks(ix.symbols, ix.imports, text, 60).collect()
    assert all(len(r.chunk.encode()) <= 60 for r in short)
    vectors = build.embedded(build.chunks(ix.symbols, ix.imports, text), lambda texts: [[float(len(t)), 0.0] for t in texts])
    stored = build.stored(spark.createDataFrame([], "symbol_id long, file string, vector array<float>, stale boolean"), vectors)
    assert {tuple(r.vector) for r in stored.collect()} == {(1.0, 0.0)}
    assert build.missing(ix.with_(embeddings=stored)).count() == 0
    stale = build.marked_stale(stored, spark.createDataFrame([("lib.rs",)], "path string"))
    assert build.missing(ix.with_(embeddings=stale)).count() == 2


def test_walk(spark, tmp_path):
    for p, c in {"src/a.py": "x = 1", "node_modules/b.py": "", ".hidden/c.py": "", ".github/d.py": "y = 2", "skip/e.py": "", "nested/.git/HEAD": "", "nested/f.py": "", ".gitignore": "skip/\n", "notes.txt": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    assert {r.path for r in files.walk(spark, str(tmp_path)).collect()} == {"src/a.py", ".github/d.py"}
    assert {r.path for r in files.walk(spark, str(tmp_path), ["src/"]).collect()} == {".github/d.py"}


def test_walk_in_tasks(spark, tmp_path):
    """More directories than the driver goes through, odd names, nested ignore files that take back, links, no file at all."""
    tree = {f"d{k}/e{k % 3}/f.py": f"x = {k}" for k in range(60)} | {"a b/c#%20.py": "y", "n/.gitignore": "*.py\n!keep.py\n# n/\n/g/\n", "n/a.py": "", "n/keep.py": "", "n/g/keep.py": "", "n/m/.ignore": "keep.py\n", "n/m/keep.py": "", "node_modules/x/y.py": ""}
    for p, c in tree.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    (tmp_path / "d0" / "loop").symlink_to(tmp_path)
    found = {r.path: r.content for r in files.walk(spark, str(tmp_path)).collect()}
    assert found == {p: c for p, c in tree.items() if p.startswith(("d", "a")) or p == "n/keep.py"}
    assert "node_modules/x/y.py" not in {r.path for r in files.listed(spark, str(tmp_path)).collect()}
    (tmp_path / "none").mkdir()
    assert files.walk(spark, str(tmp_path / "none")).isEmpty()
    assert files._inside(f"file://{tmp_path}", "gone") == ([], []) and "/etc" not in files._inside("file:", "")[0] and "etc" in files._inside("file:", "")[0]
    with pytest.raises(FileNotFoundError):
        files.walk(spark, str(tmp_path / "missing"))


def test_contents_are_passed_on_by_bytes(tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.py").write_text("x" * 60)
    names = [f"{k}.py" for k in range(5)]
    got = list(files._contents(100)(iter([files._named(f"file://{tmp_path}", names)])))
    assert [b.num_rows for b in got] == [2, 2, 1] and [n for b in got for n in b["path"].to_pylist()] == names


def test_git_hunks(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("a\nb\nc\n")
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("a\nB\nc\nd\n")
    assert rows(git.changed_files(spark, str(tmp_path)), "path") == [("a.py",)]
    assert rows(git.hunks(spark, str(tmp_path)).orderBy("first"), "file", "first", "last") == [("a.py", 2, 2), ("a.py", 4, 4)]
    for bad in ("--output=x", "a b", ""):
        with pytest.raises(ValueError):
            git.checked_ref(bad)
    with pytest.raises(ValueError):
        git.checked_path("../x")


def test_debounce_and_state(spark):
    data = [("p", "modified", "2024-01-01 00:00:00", "h1", 1), ("p", "deleted", "2024-01-01 01:00:00", "h2", 2), ("p", "modified", "2024-01-02 00:00:00", "h3", 3), ("q", "created", "2024-01-01 00:00:00", "h4", 4)]
    e = spark.createDataFrame(data, "path string, op string, ts string, hash string, event_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(events.debounced(e).orderBy("path", "first"), "path", "events", "op") == [("p", 2, "deleted"), ("p", 1, "modified"), ("q", 1, "created")]
    state = events.applied(spark.createDataFrame([], events.STATE), e)
    assert rows(state.orderBy("path"), "path", "hash") == [("p", "h3"), ("q", "h4")]
    again = events.applied(state, e.filter("event_id = 2"))
    assert rows(again, "path") == [("q",)]
    there = spark.createDataFrame([("p",)], "path string")
    assert {(r.path, r.op) for r in events.classified(e, there).collect()} == {("p", "modified"), ("q", "deleted")}


def test_stream_equals_batch(spark, tmp_path):
    e = spark.range(200).selectExpr("concat('f', id % 7) AS path", "CASE WHEN id % 5 = 0 THEN 'deleted' ELSE 'modified' END AS op", "timestamp_seconds(1704067200 + id * 600) AS ts", "md5(cast(id AS string)) AS hash", "id AS event_id")
    e.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    follower = events.Follower(spark)
    got = follower.run(stream)
    assert follower.batches >= 2 and got.count() > 0
    windows = events.debounced_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "30 minutes")
    q = windows.writeStream.outputMode("complete").format("memory").queryName("bursts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("bursts").count() == events.debounced(e, "30 minutes").count()


def test_fixture_helper(spark):
    assert make(spark).symbols.count() == 0
