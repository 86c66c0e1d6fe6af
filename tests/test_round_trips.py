"""The index's life, the service over a real repository, streams that start again, and operators against plain code."""

import random
import subprocess

import numpy as np
import pytest
from helpers import make, rows
from pyspark.sql import functions as F

from graphloom.functions import render
from graphloom.index import Index, discovered, read_meta
from graphloom.operators import budget, changes, graph, ranking, summary, vectors
from graphloom.plans.frames import numbered
from graphloom.plans.service import Service
from graphloom.sources import build, parse
from graphloom.streaming import events


# --- parsing


def test_long_functions_keep_their_end_and_calls():
    body = "\n".join(f"    call_{k}(x);" for k in range(2500))
    symbols, refs, _, _ = parse.parse(f"fn big(x: u8) {{\n{body}\n}}\nfn next() {{ helper(); }}\n", "rust")
    assert [(s[0], s[2], s[4]) for s in symbols] == [("big", 1, 2502), ("next", 2503, 2503)]
    assert sum(r[5] == "big" for r in refs) == 2500 and [r[5] for r in refs if r[0] == "helper"] == ["next"]


def test_many_definitions_take_time_in_proportion():
    import time

    began = time.time()
    symbols, refs, _, _ = parse.parse("\n".join(f"fn f{k}(\n  a: u8,\n) -> u8 {{\n  g{k}(a)\n}}" for k in range(6000)), "rust")
    assert len(symbols) == 6000 and all(r[5] == "f" + r[0][1:] for r in refs) and time.time() - began < 20
    assert all(s[4] == s[2] + 4 for s in symbols)


def test_python_with_an_error_keeps_its_definitions():
    text = "import os\nclass A(Base):\n    def m(self):\n        helper()\n\ndef broken(:\n    pass\n\ndef last():\n    other()\n"
    symbols, refs, imports, edges = parse.parse(text, "python")
    assert {(s[0], s[1], s[5]) for s in symbols} == {("A", "class", None), ("m", "method", "A"), ("broken", "function", None), ("last", "function", None)}
    assert {(r[0], r[5]) for r in refs if r[1] == "call"} == {("helper", "m"), ("other", "last")} and imports == ["os"] and edges == [("A", "Base", "extends")]


def test_diff_paths_of_any_length(spark):
    path = "d/" * 3000 + "x.rs"
    diff = [(0, f"+++ b/{path}"), (1, "@@ -1 +3,2 @@"), (2, "+++ /dev/null"), (3, "@@ -1 +0,0 @@")]
    assert rows(changes.hunks(spark.createDataFrame(diff, "n long, text string")), "file", "first", "last") == [(path, 3, 4)]


# --- the index's life


def test_outline_is_in_order_of_lines(spark):
    text = "\n".join(f"fn f{k}() {{}}" for k in range(80))
    ix = build.index(spark.createDataFrame([("a.rs", text, "rust")], "path string, content string, language string"))
    assert [r[0] for r in rows(summary.outline(ix, "a.rs"), "line")] == list(range(1, 51))


def test_load_update_save_load(spark, tmp_path):
    files = lambda *names: spark.createDataFrame([(n, t, "rust") for n, t in names], "path string, content string, language string")
    path = f"file://{tmp_path}/repo"
    build.index(files(("a.rs", "fn a() { b(); }"), ("b.rs", "fn b() {}"))).save(path, {"repository": "/x/repo"})
    ix = Index.load(spark, path)
    build.updated(ix, files(("b.rs", "fn b() {}\nfn c() { a(); }"))).save(path)
    assert {n for (n,) in rows(ix.symbols, "name")} == {"a", "b"}  # a reader of the version before is not disturbed
    again = Index.load(spark, path)
    assert sorted(rows(again.symbols, "name", "file")) == [("a", "a.rs"), ("b", "b.rs"), ("c", "b.rs")] and again.files.count() == 2
    build.updated(again, files(("a.rs", "fn z() {}"))).save(path)
    assert read_meta(spark, path) == {"repository": "/x/repo"} and discovered(spark, f"file://{tmp_path}") == {"repo": path.replace("file://", "file:")}
    assert {n for (n,) in rows(Index.load(spark, path).symbols, "name")} == {"z", "b", "c"}
    assert len([p for p in (tmp_path / "repo").iterdir() if p.name.startswith("v")]) == 2


def test_reembedding_and_its_fallback(spark):
    ix = make(spark, [(1, "f", "function", "a.rs", 1), (2, "g", "function", "b.rs", 1), (3, "bad", "function", "a.rs", 2)], vectors=[(1, "a.rs", [1.0, 0.0], False), (2, "b.rs", [0.0, 1.0], False), (3, "a.rs", [1.0, 0.0], False)])
    contents = spark.createDataFrame([("a.rs", "fn f()\nfn bad()"), ("b.rs", "fn g()")], "path string, content string")
    changed = spark.createDataFrame([("a.rs",)], "path string")
    down = build.reembedded(ix, contents, changed, None, healthy=lambda: False)
    assert sorted(rows(down, "symbol_id", "stale")) == [(1, True), (2, False), (3, True)]

    def embed(texts):
        if any("fn bad" in t and "fn f" not in t for t in texts):
            raise RuntimeError("no vector for this")
        return [[0.0, 2.0] for _ in texts]

    ix = ix.with_(symbols=ix.symbols.withColumn("end_line", F.col("line")))
    up = build.reembedded(ix, contents, changed, embed)
    assert sorted(rows(up, "symbol_id", "vector", "stale")) == [(1, [0.0, 1.0], False), (2, [0.0, 1.0], False)]
    long = build.embedded(build.chunks(ix.symbols, ix.imports, contents), lambda texts: [] if len(texts) < 1 else (_ for _ in ()).throw(ValueError("context length exceeded")) if len(texts) > 1 else [[1.0]])
    assert long.count() == 3


@pytest.fixture
def repository(tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("def helper():\n    return 1\n\n\ndef main():\n    helper()\n")
    (root / "src/b.py").write_text("from a import helper\n\n\nclass Box:\n    def open(self):\n        helper()\n")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", "-C", str(root), *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "x")
    return root


def test_service_over_a_repository(spark, repository, tmp_path):
    vector = lambda text: [float(len(text)), 1.0]
    service = Service(None, embed=vector, home=f"file://{tmp_path}/home")
    status = service.call("init", root=str(repository)).first()
    assert (status.files, status.symbols, status.embeddings) == (2, 4, 4)
    assert rows(service.call("callers", name="helper"), "caller_name", "file") == [("main", "src/a.py"), ("<module>", "src/b.py"), ("open", "src/b.py")]  # the import stands outside any symbol
    assert rows(service.call("show", name="main"), "body") == [("def main():\n    helper()",)]
    assert [r.body.splitlines()[0] for r in service.call("show", name="Box,main", shallow=True).orderBy("asked").collect()] == ["class Box", "def main()"]
    assert service.call("show", paths=["src/a.py", "src/b.py"]).count() == 3 and service.call("search", pattern="helper", raw=True, file="src/b").count() == 2
    assert rows(service.call("repos"), "repo", "files") == [("proj", 2)]
    assert Service(None, home=f"file://{tmp_path}/home").use("proj").call("sym", name="Box").count() == 1
    (repository / "src/a.py").write_text("def helper(x):\n    return x\n\n\ndef main():\n    helper(1)\n\n\ndef extra():\n    main()\n")
    found = {(r.name, r.change) for r in service.call("changes").collect()}
    assert found >= {("helper", "modified"), ("extra", "added")}
    assert ("main", "src/a.py") in rows(service.call("changes", blast=True).filter("source = 'helper'"), "name", "file")
    assert {e for (e,) in rows(service.call("changes", flows=True), "entry")} >= {"main"}
    near = service.call("impact", file="src/a.py")
    assert near.count() > 0 and set(near.columns) == {"changed", "name", "kind", "file", "line", "score"}
    assert service.call("impact", since="HEAD").count() == near.count()
    assert service.call("update").first().symbols == 5 and service.call("status").first().embeddings == 5
    assert service.call("update", force=True, ).first().files == 2
    tree = service.call("summary", path=".", recursive=True)
    assert sorted(rows(tree, "path", "level")) == [(".", 0), ("src", 1), ("src/a.py", 2), ("src/b.py", 2)]
    with pytest.raises(KeyError):
        service.call("nothing")


def test_pages_follow_the_tools_order(spark):
    ix = make(spark, [(k, f"z{9 - k}", "function", "f.rs", k) for k in range(10)] + [(50, "target", "function", "t.rs", 1)], [("target", "f.rs", k, k, 0.9) for k in range(10)])
    service = Service(ix)
    whole = rows(service.call("callers", name="target"), "caller_name", "line")
    assert whole == [(f"z{9 - k}", k) for k in range(10)]
    first = service.call("callers", limit=80, name="target")
    assert rows(first, "caller_name", "line") == whole[: first.count()] and 0 < first.count() < 10
    page = service.answer("callers", limit=80, name="target").first()
    assert page.shown == first.count() == len(page.results) and page.has_more and page.total == 10 and page.hint == f"Page 1. Showing {page.shown} of 10 matches. Use page=2 for more."
    assert '"caller_name":"z9"' in page.results[0]
    last = service.answer("callers", name="target").first()
    assert not last.has_more and last.shown == 10 and last.hint.endswith("No more pages.")


def test_semantic_search_puts_the_nearest_first(spark):
    ix = make(spark, [(1, "near", "function", "a.rs", 1), (2, "far", "function", "b.rs", 1)], vectors=[(1, "a.rs", [1.0, 0.0], False), (2, "b.rs", [0.0, 1.0], False)])
    text = spark.createDataFrame([("c.rs", 1, "nothing")], "file string, line long, content string")
    found = rows(Service(ix, text, lambda _: [1.0, 0.1]).call("search", pattern="q", mode="semantic"), "file", "source")
    assert found == [("a.rs", "semantic"), ("b.rs", "semantic")]


# --- streams


def write_events(spark, folder, k, data):
    spark.createDataFrame([(p, o, t, h, n) for n, (p, o, t, h) in enumerate(data, 100 * k)], "path string, op string, ts timestamp_ntz, hash string, event_id long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{folder}/part{k}")


def test_a_follower_that_starts_again(spark, tmp_path):
    from datetime import datetime as T

    folder, source = f"file://{tmp_path}/follow", f"file://{tmp_path}/in"
    schema = "path string, op string, ts timestamp, hash string, event_id long"
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    write_events(spark, source, 0, [("a", "created", T(2024, 1, 1), "1"), ("b", "created", T(2024, 1, 1), "1"), (None, "created", T(2024, 1, 1), "1"), ("c", "renamed", T(2024, 1, 1), "1")])
    events.Follower(spark, folder).run(stream())
    write_events(spark, source, 1, [("b", "deleted", T(2024, 1, 2), "1"), ("d", "created", T(2024, 1, 2), "1"), ("a", "modified", T(2024, 1, 2), "1")])
    again = events.Follower(spark, folder)  # as after a restart of the driver
    assert sorted(rows(again.run(stream()), "path")) == [("a",), ("d",)]
    assert sorted(rows(again.status, "batch", "files", "updated", "rejected")) == [(0, 2, 2, 2), (1, 2, 2, 0)]
    seen = []
    again.second_stage(lambda batch, n: seen.extend(rows(batch, "path", "op")))
    assert sorted(seen) == [("a", "created"), ("b", "created"), ("b", "deleted"), ("d", "created")]
    again(spark.createDataFrame([("x", "created", T(2024, 1, 3), "1", 1)], schema), 1)  # a batch that runs again does nothing
    assert again.state.count() == 2


# --- operators against plain code


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert sorted(rows(numbered(df, "k"), "k", "position")) == [(k, k + 1) for k in range(1000)]
    assert numbered(df.limit(0), "k").count() == 0


def test_budget_fold(spark):
    r = random.Random(4)
    texts = [(k, "x" * r.randint(0, 40)) for k in range(300)]
    df = spark.createDataFrame(texts, "k long, t string").repartition(5)
    for limit, page in ((50, 1), (50, 2), (10, 7), (5000, 1)):
        left, used, want = (page - 1) * limit, 0, []
        for k, t in texts:
            n = -(-len(t) // 4)
            if left > 0:
                left = left - n if n <= left else 0
            elif used + n <= limit:
                used += n
                want.append(k)
        assert sorted(k for (k,) in rows(budget.within(df, limit, ["k"], page, "t").filter("taken"), "k")) == want


def test_reach_of_random_imports(spark):
    r = random.Random(8)
    files = [f"d{k % 4}/f{k % 15}.{'rs' if k % 2 else 'py'}" for k in range(40)]
    files = sorted(set(files))
    imports = [(r.choice(files), f"./f{r.randrange(15)}") for _ in range(25)]
    ix = make(spark, imports=imports, files=files)
    stem = lambda p: p.rpartition("/")[2].partition(".")[0]
    edges = {(a, b) for a, i in imports for b in files if stem(b) == stem(i) and a != b}
    for start in files[:3]:
        for reverse in (False, True):
            want, queue = {start}, [start]
            while queue:
                x = queue.pop()
                for a, b in edges:
                    a, b = (b, a) if reverse else (a, b)
                    if a == x and b not in want:
                        want.add(b)
                        queue.append(b)
            assert {f for (f,) in rows(graph.reach(ix, start, reverse), "file")} == want
            assert {f for (f,) in rows(graph.reach(graph.dep_edges(ix), start, reverse), "file")} == want


def test_flows_take_the_first_definitions(spark):
    """Branching 3: of the callee with four definitions the first three by place use up all the room."""
    ix = make(spark, [(1, "entry", "function", "e.rs", 1), *[(10 - k, "many", "function", f"m{k}.rs", 1) for k in range(4)], (20, "zed", "function", "z.rs", 1)], [("many", "e.rs", 2, 1, 0.9), ("zed", "e.rs", 3, 1, 0.9)])
    assert rows(graph.flows(ix, ix.symbols.filter("name = 'entry'"), 3, 3), "name", "file") == [("entry", "e.rs"), ("many", "m0.rs")]
    assert rows(graph.flows(ix, ix.symbols.filter("name = 'entry'"), 3, 5), "name", "file") == [("entry", "e.rs"), ("many", "m0.rs"), ("zed", "z.rs")]


def test_clusters_of_a_sweep(spark):
    g = np.random.default_rng(2)
    centres = np.eye(6)[:4] * 10
    points = [(int(k), "f.rs", (centres[k % 4] + g.normal(0, 0.2, 6)).tolist(), False) for k in range(400)]
    ix = make(spark, vectors=points)
    found = vectors.cluster(vectors.scoped(ix, ""), 8).toPandas()
    groups = {frozenset(x.symbol_id % 4) for _, x in found.groupby("cluster")}
    assert groups == {frozenset([k]) for k in range(4)} and found.distance.max() < 2
    few = vectors.cluster(ix.embeddings.filter("symbol_id < 2"), 5).toPandas()
    assert set(few.cluster) == {0} and len(few) == 2 and vectors.cluster(ix.embeddings.limit(0)).count() == 0


def test_silhouette_of_a_stride(spark):
    points = spark.createDataFrame([(k, k % 3, [float(k % 3), float(k)]) for k in range(50)], "id long, cluster int, vector array<float>")
    every = points.filter("id % 5 = 0")
    assert vectors.silhouette(points, most=10).first() == vectors.silhouette(every).first()


def test_ranks_of_fusion_are_global(spark):
    df = spark.createDataFrame([(f"f{k % 7}", k) for k in range(100)], "file string, line long").repartition(6)
    want = sorted((f"f{k % 7}", k) for k in range(100))
    assert sorted(rows(ranking.ranked_rows(df, "file", "line"), "rank", "file", "line")) == [(n + 1, *x) for n, x in enumerate(want)]


def test_tree_passes_through_single_directories(spark):
    files = ["a/b/c/one.rs", "a/b/c/two.rs", "a/b/d/e/three.rs", "top.rs"]
    ix = make(spark, [(k, f"s{k}", "function", f, 1) for k, f in enumerate(files)], files=files)
    tree = lambda path, depth: rows(summary.tree(ix, path, depth), "path", "parent", "level", "type", "files")
    assert tree(".", 0) == [(".", None, 0, "directory", 4)]
    assert tree(".", 1) == [(".", None, 0, "directory", 4), ("a", ".", 1, "directory", 3)]
    assert tree("a", 1) == [("a", None, 0, "directory", 3), ("a/b/c", "a", 1, "directory", 2), ("a/b/d", "a", 1, "directory", 1)]
    assert tree("a", None)[3:] == [("a/b/c/one.rs", "a/b/c", 2, "file", 1), ("a/b/c/two.rs", "a/b/c", 2, "file", 1), ("a/b/d/e/three.rs", "a/b/d", 2, "file", 1)]
    assert tree("no/where", 2) == [("no/where", None, 0, "directory", 0)] and tree("top.rs", 1) == [("top.rs", None, 0, "file", 1)]
    rich = summary.detailed(ix, summary.tree(ix, "a/b/c", 1)).collect()
    assert [r.outline[0].name for r in rich if r.type == "file"] == ["s0", "s1"]


def test_descriptions_are_cached_by_content(spark):
    ix = make(spark, [(1, "f", "function", "src/a.rs", 1)])
    cache = spark.createDataFrame([("other", "h", "kept", 1)], "path string, content_hash string, description string, created_at long")
    row, cache = summary.described(ix, cache, "src", lambda prompt: "about f" if "function f" in prompt else "?", 5)
    assert row.first().description == "about f" and cache.count() == 2
    row, cache = summary.described(ix, cache, "src", lambda _: pytest.fail("asked again"), 6)
    assert row.first().description == "about f"
    assert "src/a.rs" in summary.overview(ix, "src").first().prompt


def test_lines_of_each_kind(spark):
    caller = spark.createDataFrame([("main", "a.rs", 3, "t.rs", 2, 0.95)], "caller_name string, file string, line long, target_file string, depth long, confidence double")
    assert rows(render.grep_lines(caller, "caller"), "value") == [("a.rs:3:  main calls into t.rs depth 2, confidence 0.95",)]
    hop = spark.createDataFrame([(0, "f", "function", "a.rs", 1), (1, "g", "function", None, None)], "hop long, name string, kind string, file string, line long")
    assert rows(render.grep_lines(hop, "path"), "value") == [("0. function f (a.rs:1)",), ("1. function g",)]
    hits = spark.createDataFrame([("a.rs", 1, "x\n\ny"), ("a.rs", 2, "z"), ("b.rs", 1, "w"), ("c.rs", 9, "v")], "file string, line long, content string")
    assert [v for _, v in rows(render.one_line_a_file(hits, ["file", "line"]), "n", "value")] == ["a.rs:1:x ; y ; a.rs:2:z", "b.rs:1:w", "c.rs:9:v"]
    assert rows(render.compact_lines(hits.filter("file = 'b.rs'"), "hits"), "value") == [("hits[1]{file,line,content}:",), ("  b.rs,1,w",)]
