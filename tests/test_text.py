import pytest

from graphloom.functions import text as X

from helpers import rows


def flags(spark, f, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(f("x")).collect()]


def test_test_paths(spark):
    paths = ["tests/a.rs", "src/a_test.go", "src/a.test.ts", "src/a.spec.js", "src/testing.rs", "docs/x.md", "src/contest.rs", "a/bench/b.rs", "bench"]
    assert flags(spark, X.is_test, paths) == [True, True, True, True, False, True, False, True, True]
    assert flags(spark, X.is_test_lookup, ["src/testing.rs", "x/mocks/a.rs", "Test.java", "src/latest.rs"]) == [True, True, True, False]


def test_line_kinds(spark):
    assert flags(spark, X.is_import_line, ["use a::b;", "  import x", "#include <a>", "user", "require('x')", "from x import y"]) == [True, True, True, False, True, True]
    assert flags(spark, X.is_comment_line, ["// a", "  /* b", "* c", "*d", "#include <x>", "# e", "a // b", "*/"]) == [True, True, True, False, False, True, False, True]


def test_stems(spark):
    assert flags(spark, X.stem, ["src/a.b.rs", ".env", "x/y", "src/.hidden"]) == ["a.b", ".env", "y", ".hidden"]
    assert flags(spark, X.import_stem, ["crate::util", "./a/b.ts", "std::fs::", "x"]) == ["util", "b", "fs", "x"]


def test_lines_and_grep(spark):
    files = spark.createDataFrame([("a", "x\r\nyX\n"), ("b", "n\0hidden x"), ("c", ""), ("d", None)], "path string, content string")
    assert rows(X.lines(files).orderBy("file", "line"), "file", "line", "content") == [("a", 1, "x"), ("a", 2, "yX"), ("b", 1, "n")]
    assert X.grep(X.lines(files), "X").count() == 1
    assert X.grep(X.lines(files), "x", ignore_case=True).count() == 2
    assert X.grep(X.lines(files), "^[xy]", regex=True).count() == 2


def test_tokens_count_bytes(spark):
    assert flags(spark, X.tokens, ["", "abcd", "abcde", "éé é"]) == [0, 1, 2, 2]


def test_phrases(spark):
    assert flags(spark, lambda c: X.has_phrase(c, "Red gizmo"), ["red_gizmo_1", "gizmo_red", "a_red_gizmos", "RED-GIZMO"]) == [True, False, False, True]


def test_ascii_folding_only(spark):
    assert flags(spark, lambda c: X.contains_ci(c, "É"), ["É", "é"]) == [True, False]
    assert flags(spark, lambda c: X.like_ci(c, "%A_C%"), ["abc", "xaBcx", "ac"]) == [True, True, False]


@pytest.mark.parametrize("text, name, file, scope", [
    ("tokio::runtime::Handle", "Handle", "tokio/runtime", None),
    ("Client.get", "get", None, "Client"),
    ("foo.bar.baz", "baz", "foo", "bar"),
    ("mod::Class.method", "method", "mod", "Class"),
    ("ScheduledIo::run", "run", "scheduled_io", None),
    ("foo.bar", "bar", "foo", "foo"),
    ("plain", "plain", None, None),
    ("odd::", "odd::", None, None),
    ("odd.", "odd.", None, None),
])
def test_qualified_names(text, name, file, scope):
    assert X.split_qualified(text) == X.Qualified(name, file, scope)


def test_parameters():
    assert [X.snake(x) for x in ("ScheduledIo", "IOHandler", "IO", "a")] == ["scheduled_io", "io_handler", "io", "a"]
    assert [X.looks_like_regex(p) for p in (r"\bfoo", "a|b", "|b", "a|", r"a\|b", "[ab]", "foo()")] == [True, True, False, False, False, True, False]
    assert [X.confidence(c) for c in (None, float("nan"), float("inf"), -1, 2, 0.5)] == [0, 0, 0, 0, 1, 0.5]
    assert [X.normal_path(p) for p in ("./src/", "", "src", "/")] == ["src", ".", "src", "."]
    assert [X.duration(s) for s in (5, 65, 3700, 90061)] == ["5s", "1m 5s", "1h 1m", "1d 1h"]


def test_ignore_patterns(spark):
    paths = ["a.log", "x/a.log", "build/x", "keep.log", "x/build2/y", "docs/a/b.md", "src/tmp"]
    got = flags(spark, lambda c: X.ignored(c, ["*.log", "!keep.log", "build/", "/docs/**/*.md", "# no", ""]), paths)
    assert got == [True, True, True, False, False, True, False]
