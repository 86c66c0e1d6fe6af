"""Catalogue queries do the whole job, held against plain code rather than against their SQL."""

import os
import random

import numpy as np
import pytest
from helpers import make, rows

from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"
on_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@on_tables
def test_silhouette_counts_every_embedding(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    v, label = np.array(given.embedding.tolist(), float), given.label.to_numpy()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    scores = []
    for i in range(len(v)):
        others = np.arange(len(v)) != i
        mean = {c: d[i, others & (label == c)].mean() for c in set(label) if (others & (label == c)).any()}
        a, b = mean.pop(label[i], None), min(mean.values(), default=None)
        scores.append(0 if a is None or b is None or max(a, b) == 0 else (b - a) / max(a, b))
    got = catalog.queries()["silhouette_given_labels"](spark, SF).first()
    assert got.points == len(given) and abs(got.silhouette - np.mean(scores)) < 1e-6


def test_flows_start_at_every_entry_point(spark, monkeypatch):
    """30 entries call symbol 40, which the diff modifies, and 36, which it leaves alone."""
    symbols = [(k, f"s{k}", "function", f"f{k:02}.rs", 1) for k in [*range(1, 31), 36, 40]]
    ix = make(spark, symbols, refs=[(f"s{callee}", f"f{k:02}.rs", 2, k, 0.95) for k in range(1, 31) for callee in (36, 40)])
    monkeypatch.setattr(catalog.P, "index", lambda *_: ix)
    queries = catalog.queries()
    flows = queries["flow_trace"](spark, "")
    assert {e for (e,) in rows(flows, "entry")} == {f"s{k}" for k in range(1, 31)}
    # a modified (every fifth) or removed (every seventh) entry counts as itself and as its first step
    own = {k for k in range(1, 31) if k % 5 == 0 or k % 7 == 0}
    assert dict(rows(queries["change_flows"](spark, ""), "entry", "matches")) == {f"s{k}": 1 + 2 * (k in own) for k in range(1, 31)}


def test_blast_of_every_changed_name(spark, monkeypatch):
    """Of symbols 1 to 40 those divisible by 5 or 7 change; symbol 100 + k, where it does not change itself, calls k and 141 calls all."""
    symbols = [(k, f"s{k}", "function", f"f{k:02}.rs", 1) for k in range(1, 41)] + [(k, f"c{k}", "function", "c.rs", k) for k in range(101, 142)]
    symbols = [x for x in symbols if x[0] < 100 or (x[0] % 5 and x[0] % 7)]
    calls = [(f"s{k}", "c.rs", k, caller, 0.95) for k in range(1, 41) for caller in (100 + k, 141) if caller in {x[0] for x in symbols}]
    ix = make(spark, symbols, refs=calls)
    monkeypatch.setattr(catalog.P, "index", lambda *_: ix)
    changed = {f"s{k}" for k in range(1, 41) if k % 5 == 0 or k % 7 == 0}
    want = {(c[0], f"c{c[3]}") for c in calls if c[0] in changed}
    assert {(source, name) for source, name in rows(catalog.queries()["change_blast"](spark, ""), "source", "name")} == want
    risk = catalog.queries()["change_risk"](spark, "").first()
    assert risk.total == len(want) and risk.most == max(sum(s == x for s, _ in want) for x in changed)


def test_children_of_every_symbol(spark, monkeypatch):
    ix = make(spark, [(k, f"s{k}", "class", "a.rs", k) for k in (1, 2, 500, 501, 9000)], edges=[(2, 1, "extends"), (9000, 501, "implements"), (1, 9000, "extends")])
    monkeypatch.setattr(catalog.P, "index", lambda *_: ix)
    monkeypatch.setattr(catalog, "seed", lambda *_: "s1")
    parents = {p: c for c, p, _ in rows(ix.type_edges, "child_id", "parent_id", "relationship")}
    assert set(rows(catalog.queries()["ctx_children"](spark, ""), "id", "name")) == {(p, f"s{c}") for p, c in parents.items()}


def test_impact_of_every_change(spark, monkeypatch):
    """Added and modified symbols, one name in several files, each with its own 20 nearest."""
    r = random.Random(3)
    v = {k: [r.gauss(0, 1) for _ in range(6)] for k in range(1, 121)}
    at = {k: (f"s{k % 30}", "function", f"f{k % 7}.rs", k) for k in v}
    ix = make(spark, [(k, *at[k]) for k in v], vectors=[(k, at[k][2], x, False) for k, x in v.items()])
    ix = ix.with_(symbols=ix.symbols.withColumn("scope", catalog.F.lit(None).cast("string")))
    monkeypatch.setattr(catalog.P, "index", lambda *_: ix)
    changed = [(f"s{k % 30}", k) for k in v if k % 5 == 0 and k % 7] + [(f"s{k % 30}_new", k) for k in v if k % 13 == 0]
    best = {}
    for name, k in changed:
        near = sorted((-float(np.float32(v[j]).astype(float) @ np.float32(v[k]).astype(float)), j) for j in v)[:20]
        for score, j in near:
            if (name, at[k][2]) != (at[j][0], at[j][2]):
                best[at[j]] = min(best.get(at[j], (9e9, "")), (round(score, 6), name))
    got = {tuple(x[1:5]): (-x[5], x[0]) for x in rows(catalog.queries()["semantic_impact"](spark, ""), "changed", "name", "kind", "file", "line", "score")}
    assert got.keys() == best.keys()
    assert all(abs(got[x][0] - best[x][0]) < 2e-6 and got[x][1] == best[x][1] for x in got)


@on_tables
def test_hunks_are_all_line_items(spark):
    items = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_linenumber", "l_quantity").toPandas()
    symbols = catalog.P.symbols(spark, SF).select("id", "file", "line", "end_line").toPandas()
    file = dict(zip(symbols.id, symbols.file))
    hunks = {(file[p], n * 40, int(n * 40 + q)) for p, n, q in items.itertuples(index=False) if p in file}
    by_file = {}
    for f, a, b in hunks:
        by_file.setdefault(f, []).append((a, b))
    want = {s.id for s in symbols.itertuples() if any(s.line <= b and a <= s.end_line for a, b in by_file.get(s.file, ()))}
    assert {i for (i,) in rows(catalog.queries()["hunk_overlap"](spark, SF), "id")} == want
    merged = rows(catalog.queries()["change_merge"](spark, SF), "file", "name")
    named = catalog.P.symbols(spark, SF).select("id", "file", "name").toPandas()
    assert {(f, n) for i, f, n in named.itertuples(index=False) if i in want} <= set(merged)


@on_tables
def test_tables_that_grow_are_not_sent_through_the_driver(spark):
    """Parts weigh far more than their file; a count of references needs neither callers nor their window; a context computes references once."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 2 * os.path.getsize(f"{SF}/part.parquet"))
    try:
        ix = catalog.P.index(spark, SF)
        assert "BroadcastHashJoin" not in plan(ix.refs.select("name", "file", "caller_id"))
        assert "Window" not in plan(ix.refs.groupBy("name").count())
        ix = ix.with_(imports=spark.createDataFrame([], "source_file string, import_path string"))
        assert "lag(" not in plan(catalog.context.symbol_context(ix, catalog.seed(ix)).select("id", "callers", "type_users", "callees", "flows"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@on_tables
def test_a_high_threshold_sends_no_table_that_grows(spark):
    """Where the session's threshold is above all tables, references and callers still join symbols without the driver."""
    tree = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        ix = catalog.P.index(spark, SF)
        assert "BroadcastHashJoin" not in tree(ix.refs)
        assert "Window" not in tree(ix.refs.groupBy("name").count())
        callers = catalog.graph.callers(ix, catalog.seed(ix), 3)
        callers.collect()
        sent = [x for x in tree(callers).splitlines() if "BroadcastHashJoin" in x]
        assert "SortMergeJoin" in tree(callers) and all("BuildLeft" in x for x in sent)  # the seed
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
