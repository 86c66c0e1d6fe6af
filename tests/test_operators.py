import io
from types import SimpleNamespace

import pytest
from helpers import make, rows
from pyspark.sql import functions as F

from graphloom.functions import render
from graphloom.functions import text as X
from graphloom.operators import budget, changes, context, lookup, ranking, summary, vectors
from graphloom.plans.service import Service


def hits(spark, data):
    return spark.createDataFrame(data, "file string, line long, content string")


def test_categories_and_order(spark):
    ix = make(spark, [(1, "f", "function", "a.rs", 1)], [("f", "b.rs", 2, None, 0.9)])
    found = hits(spark, [("tests/t.rs", 1, "f"), ("b.rs", 2, "f()"), ("a.rs", 1, "fn f"), ("c.rs", 1, "use f;"), ("d.rs", 1, "// f"), ("e.rs", 9, "f")])
    got = rows(ranking.rank(ranking.classify(found, ix)), "category", "tier")
    assert got == [("definition", 0), ("call_site", 1), ("import", 2), ("other", 3), ("comment", 4), ("test", 5)]


@pytest.mark.parametrize("n, label", [(1, "(+1 other location)"), (3, "(+3 other locations)")])
def test_reexports_fold_into_definitions(spark, n, label):
    ix = make(spark, [(1, "f", "function", "a.rs", 1)])
    found = ranking.classify(hits(spark, [("a.rs", 1, "fn f"), *[("u.rs", k, "use f;") for k in range(n)]]), ix)
    assert rows(ranking.fold_reexports(found), "file", "annotation") == [("a.rs", label)]
    assert ranking.fold_reexports(found.filter("category = 'import'")).count() == n


def test_fusion_adds_up(spark):
    a = spark.createDataFrame([("x", 1, 1, "code"), ("y", 2, 2, "more")], "file string, line long, rank int, content string")
    b = spark.createDataFrame([("x", 1, 1, "n", "k", 0.5), ("z", 3, 2, "m", "k", 0.25)], "file string, line long, rank int, name string, kind string, score double")
    got = ranking.fuse(a, b).collect()
    assert [(r.file, r.source) for r in got] == [("x", "both"), ("y", "structural"), ("z", "semantic")]
    assert got[0].content == "code" and abs(got[0].score - 2 / 61) < 1e-12
    assert got[2].content == "m (k)" and got[2].annotation == "[semantic: 0.25]"


def test_budget_leaves_holes_and_skips_pages(spark):
    df = spark.createDataFrame([(i, "x" * (4 * t)) for i, t in enumerate((3, 6, 7, 4, 1))], "i int, s string")
    assert rows(budget.within(df, 10, ["i"], text="s").filter("taken").orderBy("i"), "i") == [(0,), (1,), (4,)]
    page = budget.within(df, 3, ["i"], 2, "s")
    assert rows(page.filter("taken").orderBy("i"), "i") == [(4,)]
    big = budget.within(df, 10, ["i"], 2, "s")  # 3, 6 are passed over, 7 crosses the mark
    assert rows(big.filter("taken").orderBy("i"), "i") == [(3,), (4,)]
    info = budget.page_info(big).first()
    assert (info.shown, info.used, info.truncated, info.has_more) == (2, 5, 0, False)
    assert budget.page_info(big, skipped_count=True).first().truncated == 3
    assert budget.within(df.filter("i < 0"), 3, ["i"], text="s").count() == 0


def test_lookups(spark):
    syms = [(1, "red_a", "function", "src/x.rs", 1), (2, "redXa", "method", "tests/y.rs", 2, "S"), (3, "Base", "class", "b.rs", 1), (4, "Kid", "class", "k.rs", 1)]
    ix = make(spark, syms, [("red_a", "src/x.rs", 4, 1, None), ("red_a", "lib/z.rs", 1, None, 0.9)], [("a.rs", "./x"), ("b.rs", "crate::X"), ("src/x.rs", "./y")], [(4, 3, "extends")])
    assert rows(lookup.symbols(ix, "RED_"), "id") == [(1,), (2,)]  # _ is a wildcard, tests last
    assert rows(lookup.show_symbol(ix, "red_"), "id") == [(1,)]  # literal here
    assert rows(lookup.symbols(ix, "red_a", exact=True), "id") == [(1,)]
    assert rows(lookup.references(ix, "red_a").orderBy("file"), "file", "caller_name", "confidence") == [("lib/z.rs", None, 0.9), ("src/x.rs", "red_a", 0.5)]
    assert rows(lookup.references_and_subclasses(ix, "Base"), "name", "kind", "confidence") == [("Kid", "subclass", 1.0)]
    assert rows(lookup.rdeps(ix, "src/x.rs"), "source_file") == [("a.rs",), ("b.rs",)]
    assert rows(lookup.near_names(ix, "e", 2), "name") == [("Base",), ("redXa",)]
    assert lookup.has_file(ix, "b.rs") and not lookup.has_file(ix, "nope")
    assert lookup.scope_file(ix, "redXa", "S") == "tests/y.rs"
    assert lookup.has_call_graph(ix)
    assert lookup.search_mode(ix, "red a") == "smart" and lookup.search_mode(ix, "zzz") == "plain"


def test_bodies(spark):
    ix = make(spark, [(1, "C", "class", "c.rs", 1), (2, "m", "method", "c.rs", 2, "C")])
    src = spark.createDataFrame([("c.rs", "class C {\n  m() {\n  }\n}\n")], "path string, content string")
    shown = lookup.show_symbol(ix, "C", exact=True)
    assert lookup.bodies(shown, ix, src).first().body == "class C {\n  m() {\n  }\n}"
    assert lookup.bodies(shown, ix, src, "shallow").first().body == "class C\n    method m"
    assert lookup.bodies(shown, ix, src, "signatures").first().body == "class C"


def test_grep_fallbacks(spark):
    text = hits(spark, [("a.rs", 1, "pub fn run(x: i32) {"), ("a.rs", 2, "use crate::run;"), ("b.rs", 1, "struct Run;"), ("b.rs", 2, "  runner()")])
    assert rows(lookup.grep_symbols(text, "run"), "line") == [(1,)]
    assert lookup.grep_references(text, "run").count() == 2
    assert lookup.grep_signatures(text, "run").count() == 1
    assert rows(lookup.grep_file_symbols(text, "b.rs"), "name") == [("Run",)]
    assert lookup.grep_deps(text, "a.rs").count() == 1 and lookup.grep_rdeps(text, "run").count() == 1
    around = lookup.with_source(text.filter("line = 1 AND file = 'a.rs'").select("file", "line", "content"), text)
    assert around.first().context == "1: pub fn run(x: i32) {\n2: use crate::run;"


def test_snapshot_diff_matches_null_scopes(spark):
    schema = "file string, name string, kind string, scope string, line long, signature string"
    old = spark.createDataFrame([("a", "f", "function", None, 1, "f()"), ("a", "g", "function", None, 2, "g()")], schema)
    new = spark.createDataFrame([("a", "f", "function", None, 1, "f(x)"), ("a", "h", "function", None, 3, "h()")], schema)
    assert rows(changes.snapshot_diff(old, new), "name", "change") == [("f", "modified"), ("g", "removed"), ("h", "added")]


def test_hunks(spark):
    diff = ["diff --git a/x.rs b/x.rs", "--- a/x.rs", "+++ b/x.rs", "@@ -1,2 +5,3 @@ fn", "+a", "@@ -9 +20 @@", "@@ -3,2 +7,0 @@"]
    got = changes.hunks(spark.createDataFrame(list(enumerate(diff)), "n long, text string"))
    assert rows(got.orderBy("first"), "file", "first", "last") == [("x.rs", 5, 7), ("x.rs", 20, 20)]
    ix = make(spark, [(1, "a", "function", "x.rs", 1), (2, "b", "function", "x.rs", 4), (3, "c", "function", "x.rs", 8)])
    symbols = ix.symbols.withColumn("end_line", F.when(F.col("id") == 1, 4).when(F.col("id") == 2, 5).otherwise(9).cast("long"))
    assert rows(changes.overlapping(symbols, got.filter("first = 5")), "name") == [("b",)]


def test_merge_prefers_the_parser(spark):
    s = "file string, name string, kind string, line long, change string"
    a = spark.createDataFrame([("x", "f", "function", 1, "added")], s)
    b = spark.createDataFrame([("x", "f", "function", 1, "modified"), ("x", "g", "function", 2, "modified")], s)
    assert rows(changes.merged(a, b), "name", "change", "via") == [("f", "added", "parser"), ("g", "modified", "hunk")]


def test_summary_prefix_trap(spark):
    ix = make(spark, [(1, "a", "function", "src/a.rs", 1), (2, "b", "function", "src_utils.rs", 1)], imports=[("src/a.rs", "x"), ("src/a.rs", "y")])
    assert summary.languages(ix, "src").first().files == 1
    assert summary.languages(ix, "nowhere").count() == 0
    assert summary.dependencies(ix, "src/").first().deps == 2
    assert rows(summary.root_dirs(ix), "dir") == [("src",)]
    assert rows(summary.roll_up(ix), "path", "files", "deps") == [(".", 2, 2), ("src", 1, 2), ("src/a.rs", 1, 2), ("src_utils.rs", 1, 0)]


def test_children_pass_single_directories(spark):
    ix = make(spark, [(1, "a", "function", "r/s/a.rs", 1), (2, "b", "function", "r/s/b.rs", 1)])
    assert rows(summary.children(ix, "."), "path") == [("r/s/a.rs",), ("r/s/b.rs",)]


def test_content_hash_follows_files(spark):
    ix = make(spark, [(1, "a", "function", "a.rs", 1)])
    other = ix.with_(files=ix.files.withColumn("hash", F.lit("new")))
    assert summary.content_hash(ix).first() != summary.content_hash(other).first()
    assert summary.prompt(ix, ".").first().prompt.startswith(".: 1 files, 10 lines")


def test_vectors(spark):
    v = [(1, "a.rs", [1.0, 0.0], False), (2, "b.rs", [0.0, 1.0], True), (3, "b.rs", [0.6, 0.8], False)]
    ix = make(spark, [(i, f"s{i}", "function", f, 1) for i, f, *_ in v], vectors=v)
    assert rows(vectors.top_k(ix.embeddings, [1.0, 0.0], 2), "symbol_id") == [(1,), (3,)]
    assert rows(vectors.scoped(ix, "b"), "symbol_id") == [(3,)]
    assert vectors.ask(ix, [0.0, 1.0], 5, spark.createDataFrame([("b.rs",)], "file string")).count() == 2
    unit = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(vectors.normalized("v").alias("u"))
    assert [r.u for r in unit.collect()] == [[0.6, 0.8], [0.0, 0.0]]
    got = vectors.impact(spark.createDataFrame([("s1", [1.0, 0.0])], "name string, vector array<double>"), ix, 3)
    assert rows(got, "name") == [("s3",), ("s2",)]


def test_clusters(spark):
    pts = [(i, "a", [float(i // 5 * 10) + i % 5 * 0.1, 0.0], False) for i in range(10)]
    ix = make(spark, [(i, f"s{i}", "function", "a", 1) for i in range(10)], vectors=pts)
    found = {r.symbol_id: r.cluster for r in vectors.cluster(ix.embeddings).collect()}
    assert len(set(found.values())) == 2 and len({found[i] for i in range(5)}) == 1
    assert {r.cluster for r in vectors.cluster(ix.embeddings.filter("symbol_id < 2")).collect()} == {0}
    marked = vectors.representatives(vectors.cluster(ix.embeddings), ix, 2)
    assert marked.filter("representative").count() == 4


def test_context(spark):
    syms = [(1, "m", "function", "m.rs", 1), (2, "T", "class", "t.rs", 1), (3, "K", "class", "k.rs", 1)]
    ix = make(spark, syms, [("T", "m.rs", 2, 1, 0.9), ("T", "x.rs", 1, None, 0.9), ("m", "t.rs", 3, 2, 0.9)], [("y.rs", "crate/T"), ("t.rs", "./z")], [(3, 2, "extends")])
    row = context.symbol_context(ix, "T").first()
    assert [c.name for c in row.callers] == ["m"] and [c.source_file for c in row.importers] == ["y.rs"]
    assert [c.file for c in row.type_users] == ["x.rs"] and [c.name for c in row.callees] == ["m"]
    assert [c.name for c in row.children] == ["K"] and [c.import_path for c in row.imports] == ["./z"]


def test_service_and_rendering(spark):
    ix = make(spark, [(1, "a", "function", "a.rs", 1), (2, "b", "function", "tests/b.rs", 1)], [("a", "tests/b.rs", 2, 2, 0.9)])
    text = hits(spark, [("a.rs", 1, "fn a() {}"), ("tests/b.rs", 2, "a()")])
    s = Service(ix, text)
    assert s.call("callers", name="a").count() == 0 and s.call("callers", name="a", include_tests=True).count() == 1
    assert rows(s.call("search", pattern="a("), "file") == [("a.rs",)]
    assert s.call("sym", limit=100, name="a").count() == 1
    assert rows(render.grep_lines(s.call("search", pattern="a(")), "value") == [("a.rs:1:fn a() {}",)]
    assert '"name":"a"' in render.json_lines(s.call("sym", name="a")).first()[0]
    with pytest.raises(KeyError):
        s.call("nothing")


def test_cut_body(spark):
    df = spark.createDataFrame([("\n".join(map(str, range(100))),)], "b string")
    out = df.select(budget.cut_body("b", 30)).first()[0].split("\n")
    assert len(out) == 31 and out[-1] == "... (70 more lines)"
    assert [budget.body_limit(r, a) for r, a in ((0, 10), (500, 10), (10**6, 10))] == [20, 50, 80]
    assert X.confidence(0.3) == 0.3


def test_nearest_holds_and_sends_k_a_change_whatever_the_ties():
    """A task with thousands of equal vectors in several batches gives k rows a change, those of least id."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    changes = r.normal(size=(512, 8))
    packed = io.BytesIO()
    np.save(packed, changes)
    ids = r.permutation(20_000)
    given = np.tile(np.float32([1, 0, 0, 0, 0, 0, 0, 0]), (20_000, 1))
    given[ids >= 15_000] = r.normal(size=(5_000, 8)).astype(np.float32)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + 10_000]), pa.array(list(given[a : a + 10_000]))], ["symbol_id", "vector"]) for a in (0, 10_000)]
    tracemalloc.start()
    got = list(vectors._nearest(SimpleNamespace(value=packed.getvalue()), 20)(iter(batches)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in got) == 20 * len(changes) and most < 60e6
    found = {}
    for change, i in zip(*(c for b in got for c in (b["change"].to_pylist(), b["symbol_id"].to_pylist()))):
        found.setdefault(change, set()).add(i)
    scores = np.round(given.astype(float) @ changes.T, 12)
    for c in range(0, len(changes), 16):
        assert found[c] == set(ids[np.lexsort((ids, -scores[:, c]))[:20]].tolist())
