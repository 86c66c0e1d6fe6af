import random

from helpers import make, rows

from graphloom.operators import graph

F = "function"


def chain(spark):
    return make(spark, [(1, "a", F, "a.rs", 1), (2, "b", F, "b.rs", 5), (3, "c", F, "c.rs", 9)], [("b", "a.rs", 2, 1, 0.9), ("c", "b.rs", 6, 2, 0.9)])


def test_callers_of_a_chain(spark):
    got = rows(graph.callers(chain(spark), "c", 2), "caller_name", "depth", "target_file")
    assert got == [("b", 1, "b.rs"), ("a", 2, "a.rs")]
    assert rows(graph.callers(chain(spark), "c", 1), "caller_name") == [("b",)]


def test_callees_are_call_sites(spark):
    assert rows(graph.callees(chain(spark), "a", 5), "callee_name", "file", "line", "depth") == [("b", "a.rs", 2, 1), ("c", "b.rs", 6, 2)]


def test_shortest_path_takes_the_shortcut(spark):
    ix = make(spark, [(1, "a", F, "a.rs", 1), (2, "b", F, "b.rs", 5), (3, "c", F, "c.rs", 9)], [("b", "a.rs", 2, 1, 0.9), ("c", "b.rs", 6, 2, 0.9), ("c", "a.rs", 3, 1, 0.9)])
    assert rows(graph.call_path(ix, "a", "c"), "hop", "name", "line") == [(0, "a", 1), (1, "c", 9)]
    assert graph.call_path(ix, "c", "a").count() == 0
    assert rows(graph.call_path(ix, "a", "a"), "name") == [("a",)]
    assert graph.call_path(ix, "a", "c", destination_file="nowhere").count() == 0


def test_cycles_end_and_show_the_seed(spark):
    ix = make(spark, [(1, "a", F, "a.rs", 1), (2, "b", F, "b.rs", 5)], [("b", "a.rs", 2, 1, 0.9), ("a", "b.rs", 6, 2, 0.9), ("a", "a.rs", 3, 1, 0.9)])
    assert {r[0] for r in rows(graph.callers(ix, "a", 10), "caller_name")} == {"a", "b"}


def test_same_name_in_two_files(spark):
    ix = make(spark, [(1, "helper", F, "a.rs", 1), (2, "helper", F, "b.rs", 1), (3, "t", F, "t.rs", 1)], [("t", "a.rs", 2, 1, 0.9), ("t", "b.rs", 2, 2, 0.9)])
    assert rows(graph.callers(ix, "t", 1), "caller_name", "file") == [("helper", "a.rs"), ("helper", "b.rs")]


def test_module_scope_calls_once_a_file_and_first_level_only(spark):
    ix = make(spark, [(1, "a", F, "a.rs", 1), (2, "b", F, "b.rs", 5)], [("a", "m.rs", 2, None, 0.9), ("a", "m.rs", 3, None, 0.5), ("a", "b.rs", 6, 2, 0.9), ("b", "n.rs", 1, None, 0.9)])
    assert rows(graph.callers(ix, "a", 3), "caller_name", "file", "line", "depth") == [("b", "b.rs", 5, 1), ("<module>", "m.rs", 2, 1)]


def test_confidence_and_file_filters(spark):
    ix = make(spark, [(1, "a", F, "x/a.rs", 1), (2, "b", F, "y/b.rs", 5), (3, "t", F, "t.rs", 1)], [("t", "x/a.rs", 2, 1, 0.5, 3), ("t", "y/b.rs", 6, 2, 0.9, None)])
    assert rows(graph.callers(ix, "t", 1, 0.8), "caller_name") == [("b",)]
    assert rows(graph.callers(ix, "t", 1, None, "T.RS"), "caller_name") == [("a",)]
    assert graph.callers(ix, "t", 1, None, "none.rs").count() == 0
    assert rows(graph.callers(ix, "t", 1, None, None, "Y/"), "caller_name") == [("b",)]


def test_entry_points_ignore_module_calls(spark):
    ix = make(spark, [(1, "a", F, "a.rs", 1), (2, "b", "method", "b.rs", 5), (3, "S", "struct", "s.rs", 1)], [("b", "a.rs", 2, 1, 0.9), ("a", "m.rs", 1, None, 0.9)])
    assert rows(graph.entry_points(ix), "name") == [("a",)]
    assert rows(graph.entry_points(ix, 0.95), "name") == [("a",), ("b",)]


def test_flow_branching_counts_rows_of_each_definition(spark):
    syms = [(1, "m", F, "m.rs", 1), (2, "x", F, "a.rs", 1), (3, "x", F, "b.rs", 1), (4, "y", F, "c.rs", 1), (5, "z", F, "d.rs", 1)]
    ix = make(spark, syms, [("x", "m.rs", 2, 1, 0.9), ("y", "m.rs", 3, 1, 0.8), ("z", "m.rs", 4, 1, 0.7)])
    entries = ix.symbols.filter("name = 'm'")
    assert rows(graph.flows(ix, entries, 3, 2), "name", "step") == [("m", 0), ("x", 1)]
    assert rows(graph.flows(ix, entries, 3, 3), "name", "step") == [("m", 0), ("x", 1), ("y", 2)]
    assert graph.flows(ix, ix.symbols.filter("name = 'y'"), 3, 3).count() == 0


def test_unresolved_callees_are_steps_without_place(spark):
    ix = make(spark, [(1, "m", F, "m.rs", 1)], [("gone", "m.rs", 2, 1, 0.9)])
    assert rows(graph.flows(ix, ix.symbols, 3, 4), "name", "file", "line", "depth") == [("m", "m.rs", 1, 0), ("gone", "", 0, 1)]


def test_blast_stops_at_tests(spark):
    syms = [(1, "a", F, "a.rs", 1), (2, "b", F, "tests/b.rs", 5), (3, "c", F, "c.rs", 9)]
    ix = make(spark, syms, [("b", "a.rs", 2, 1, 0.9), ("c", "tests/b.rs", 6, 2, 0.9)])
    assert graph.blast(ix, ["c"]).count() == 0
    assert rows(graph.blast(ix, ["c"], include_tests=True), "name", "severity") == [("b", "will_break"), ("a", "likely_affected")]
    assert rows(graph.callers(ix, "c", 3), "caller_name") == [("b",), ("a",)]


def test_blast_children_first_level_only(spark):
    syms = [(1, "P", "class", "p.rs", 1), (2, "C", "class", "c.rs", 1), (3, "D", "class", "d.rs", 1)]
    ix = make(spark, syms, edges=[(2, 1, "extends"), (3, 2, "extends")])
    assert rows(graph.blast(ix, ["P"]), "name", "depth", "confidence") == [("C", 1, 1.0)]


def test_several_sources_in_one_loop(spark):
    ix = chain(spark)
    got = rows(graph.blast(ix, ["b", "c"]), "source", "name", "depth")
    assert got == [("b", "a", 1), ("c", "b", 1), ("c", "a", 2)]
    assert rows(graph.blast_risk(graph.blast(ix, ["b", "c"])).orderBy("source"), "source", "total", "risk") == [("b", 1, "low"), ("c", 2, "low")]


def test_diamond_reachability(spark):
    ix = make(spark, imports=[("a.rs", "./b"), ("a.rs", "./c"), ("b.rs", "./d"), ("c.rs", "./d"), ("d.rs", "./d")], files=["a.rs", "b.rs", "c.rs", "d.rs", "e.rs"])
    edges = graph.dep_edges(ix)
    assert {r[0] for r in rows(graph.reach(edges, "a.rs"), "file")} == {"a.rs", "b.rs", "c.rs", "d.rs"}
    assert {r[0] for r in rows(graph.reach(edges, "d.rs", reverse=True), "file")} == {"a.rs", "b.rs", "c.rs", "d.rs"}
    assert {r[0] for r in rows(graph.reach_between(edges, "b.rs", "d.rs"), "file")} == {"b.rs", "d.rs"}


def test_random_graph_against_plain_search(spark):
    rng = random.Random(3)
    n = 30
    syms = [(i, f"s{i}", F, f"f{i}.rs", i) for i in range(n)]
    calls = {(rng.randrange(n), rng.randrange(n)) for _ in range(60)}
    ix = make(spark, syms, [(f"s{b}", f"f{a}.rs", 1, a, 0.9) for a, b in calls])
    level, front, seen = {}, {0}, {0}
    for d in range(1, 7):
        new = {a for a, b in calls if b in front}
        for a in new:
            level.setdefault(a, d)
        front = new - seen
        seen |= new
    got = dict(rows(graph.callers(ix, "s0", 6), "caller_name", "depth"))
    assert got == {f"s{a}": d for a, d in level.items()}


def test_blast_of_many_deals_out_what_it_finds_once(spark):
    """Reached names' files are dealt by ranges of sources, which is their order as well; counts carry no more than places."""
    ix = chain(spark)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    many = graph.blast(ix, ix.symbols.select("name"), depth=2)
    dealt = [x for x in plan(many).splitlines() if "Exchange" in x and "source" in x and "frontier" not in x]
    assert sum("rangepartitioning(source" in x for x in dealt) == 1 and not any("depth" in x for x in dealt)
    assert rows(many, "source", "name", "depth") == [("b", "a", 1), ("c", "b", 1), ("c", "a", 2)]
    counted = graph.blast_risk(many).select("source", "total")
    at = next(x for x in plan(counted).splitlines() if "rangepartitioning(source" in x)
    assert plan(counted).count("less") == 0, at
    assert dict(rows(counted, "source", "total")) == {"b": 1, "c": 2}


def test_sizes_are_the_rows_of_a_blast(spark, monkeypatch):
    """On a random graph with tests, types and over 64 sources, held a few edges at a time."""
    r = random.Random(5)
    symbols = [(k, f"s{r.randrange(90)}", "class", f"f{r.randrange(9)}{r.choice(('', '', '_test'))}.rs", k) for k in range(300)]
    refs = [(f"s{r.randrange(90)}", "x.rs", 1, r.randrange(300), r.choice((0.5, 0.95))) for _ in range(500)]
    ix = make(spark, symbols, refs=refs, edges=[(r.randrange(300), r.randrange(300), "extends") for _ in range(60)])
    names = spark.createDataFrame([(f"s{k}",) for k in range(80)] + [("absent",)], "name string")
    monkeypatch.setattr(graph, "HELD", 40)
    for direction, depth, tests, least in (("upstream", 1, False, None), ("upstream", 2, False, None), ("upstream", 3, True, 0.9), ("upstream", 6, False, None), ("downstream", 2, False, None)):
        want = dict(rows(graph.blast_risk(graph.blast(ix, names, direction, depth, tests, least)), "source", "total"))
        assert want and dict(rows(graph.blast_sizes(ix, names, direction, depth, tests, least), "source", "total")) == want
