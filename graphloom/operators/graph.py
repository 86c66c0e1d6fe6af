"""Traversals: level-synchronous loops over call and dependency edges.

A traversal expands *names* and reports *(name, file)*, the way a call graph without resolved
targets has to. Names are walked first: a level is one join of the frontier with the pairs of names
and an anti join with what was seen; several sources travel in one loop, told apart by ``source``.
Then the files of all reached names are taken in one join; where only their number is asked for, they are counted in
blocks of places and never listed. Levels are kept (persisted) so that a
level's plan never contains its predecessors twice, and every few levels are written to the shared
folder, so lineage stays short and a lost executor costs little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..index import Index
from ..plans.frames import first_per, numbered, released, unsent, written
from .lookup import CALLABLE, PLACE, known_kind, symbol_ids

DEPTH, FLOW_DEPTH, BRANCHING = 10, 20, 50
CUT = 4
#: Edges that a task which counts places holds at a time: some 100 MB in Python.
HELD = 1 << 19


def seeds(ix: Index, *names: str) -> DataFrame:
    return ix.symbols.sparkSession.createDataFrame([(n, n) for n in names], "source string, at string")


def _levels(start: DataFrame, step: DataFrame, depth: int, first: DataFrame) -> list[DataFrame]:
    """Names (source, at) by the least number of steps (at, name) that reaches them, from ``start`` (0) to ``depth`` - 1;
    ``first`` stands for them in the first step."""
    step = step.distinct().persist()
    queued, levels = start, [start]
    for level in range(1, depth):
        frontier = levels[-1].join(first if level == 1 else unsent(step), "at").select("source", F.col("name").alias("at")).distinct().join(unsent(queued), ["source", "at"], "left_anti")
        frontier = written(frontier, "frontier") if level == 1 or level % CUT == 0 else frontier.persist()
        if level % CUT == 0 and frontier.isEmpty():
            break
        queued = queued.unionByName(frontier)
        levels.append(frontier)
    return levels


def _walk(start: DataFrame, edges: DataFrame, depth: int, order: dict, first: DataFrame | None = None, also: DataFrame | None = None, many: bool = False) -> DataFrame:
    """Places (source, name, file) within ``depth`` steps of ``start`` (source, at), each by its first row.

    ``edges`` (at, name, file, …) are what a name leads to; ``first`` stands for them in the first step, where given, and
    ``also`` beside them. ``order`` maps further columns to the expressions that pick one of a place's rows, after depth. Names are walked first: a source and a name
    make one row however many files hold the name. Then each reached name's edges are taken once, and only what that
    finds is dealt out. ``many`` sources are dealt by ranges, so their rows need no exchange to be sorted by source."""
    row = lambda df: df.select("at", "name", "file", *(e.alias(k) for k, e in order.items()))
    least = F.min(F.struct(*order)).alias("best")
    edges = row(edges)
    if depth > 1:
        edges = written(edges.groupBy("at", "name", "file").agg(least).select("at", "name", "file", "best.*"), "edges")
    first = edges if first is None else row(first)
    if also is not None:
        first = first.unionByName(row(also))
    found = start.join(first, "at").drop("at").withColumn("depth", F.lit(1).cast("long"))
    if depth > 1:
        for level, frontier in enumerate(_levels(start, edges.select("at", "name"), depth, first)[1:], 1):
            found = found.unionByName(frontier.join(unsent(edges), "at").drop("at").withColumn("depth", F.lit(level + 1).cast("long")))
    found = found.repartitionByRange("source") if many else found.repartition("source", "name", "file")
    return found.groupBy("source", "name", "file").agg(F.min(F.struct("depth", *order)).alias("best")).select("source", "name", "file", "best.*")


class _Block:
    """The places of one block, and by ``via`` and name the places that it leads to."""

    def __init__(self, rows: pa.Table):
        at = rows["at"].combine_chunks().dictionary_encode()
        code = at.indices.to_numpy().astype(np.int64) * 2 + rows["via"].to_numpy()
        named = [rows[c].combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in ("name", "file")]
        place = np.concatenate([[0], np.cumsum((np.diff(named[0]) != 0) | (np.diff(named[1]) != 0))])  # rows come by place
        by_name = np.argsort(code, kind="stable")
        self.names, self.places = at.dictionary, place[by_name]
        self.first = np.searchsorted(code[by_name], np.arange(2 * len(self.names) + 1))
        self.mask = np.zeros(place[-1] + 1, np.uint64)

    def covered(self, rows: pa.Table) -> np.ndarray:
        """Of each of 64 sources the number of places that its names lead to; ``mask`` has the sources of a name."""
        known = pc.index_in(rows["at"].combine_chunks(), value_set=self.names)
        own = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
        code = known.drop_null().to_numpy().astype(np.int64) * 2 + rows["via"].to_numpy()[own]
        n = self.first[code + 1] - self.first[code]
        place = self.places[np.repeat(self.first[code] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        np.bitwise_or.at(self.mask, place, np.repeat(rows["mask"].to_numpy()[own].astype(np.int64).view(np.uint64), n))
        hit = np.flatnonzero(self.mask) if len(place) > len(self.mask) // 16 else np.unique(place)
        found, total = self.mask[hit], np.zeros(64, np.int64)
        self.mask[hit] = 0
        for k in range(0, len(found), 1 << 16):
            total += np.unpackbits(found[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return total


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block and word: a block's edges (word -1), then the names of 64 sources after another."""

    def runs() -> Iterator[tuple[tuple[int, int], pa.Table]]:
        key, held = None, []
        for batch in batches:
            block, word = (batch[c].to_numpy() for c in ("block", "word"))
            cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(word) != 0)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if key != (now := (int(block[a]), int(word[a]))) and held:
                        yield key, pa.Table.from_batches(held)
                        held = []
                    key = now
                    held.append(batch.slice(a, b - a))
        if held:
            yield key, pa.Table.from_batches(held)

    of = edges = None
    for (block, word), rows in runs():
        if word < 0:
            of, edges = block, _Block(rows)
        elif of == block:
            total = edges.covered(rows)
            bit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(word * 64 + bit + 1), pa.array(total[bit])], ["nth", "n"])


def _sizes(start: DataFrame, edges: DataFrame, depth: int, also: DataFrame | None = None) -> DataFrame:
    """(source, total): the number of places that ``_walk`` finds, which are not listed.

    A source's places are those that any of its names leads to. Edges are dealt out by place, ``HELD`` a block; sources
    are 64 bits of a word, and each block gets a row for each word and name. So the exchanges carry edges and reached
    names, and neither sources times places nor the rows of a join."""
    row = lambda df, via: df.select(F.lit(via).cast("long").alias("via"), "at", "name", "file").filter("at IS NOT NULL")
    both = row(edges, 0)
    if also is not None:
        both = both.unionByName(row(also, 1))  # for a source's own name alone
    both = written(both.distinct(), "edges")
    levels = _levels(start, both.filter("via = 0").select("at", "name"), depth, both)
    reached = start.withColumn("via", F.lit(1).cast("long"))
    for frontier in levels:
        reached = reached.unionByName(frontier.withColumn("via", F.lit(0).cast("long")))
    sources = numbered(start.select("source").distinct(), "source", name="nth")
    bit = (F.col("nth") - 1).bitwiseAND(F.lit(63)).cast("int")
    words = reached.filter("at IS NOT NULL").join(sources, "source").groupBy("via", "at", F.shiftright(F.col("nth") - 1, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("mask"))
    n = both.count() // HELD + 1
    none = F.lit(None).cast("string")
    cells = both.select(F.pmod(F.xxhash64("name", "file"), F.lit(n)).cast("int").alias("block"), F.lit(-1).cast("long").alias("word"), "via", "at", "name", "file", F.lit(0).cast("long").alias("mask"))
    cells = cells.unionByName(words.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), "word", "via", "at", none.alias("name"), none.alias("file"), "mask"))
    counts = cells.repartition(n, "block").sortWithinPartitions("block", "word", "name", "file").mapInArrow(_covered, "nth long, n long")
    return counts.groupBy("nth").agg(F.sum("n").alias("total")).join(sources, "nth").select("source", "total")


def _confident(ix: Index, minimum: float | None) -> DataFrame:
    return ix.refs.filter(F.col("confidence") >= X.confidence(minimum))


def callers(ix: Index, name: str, depth: int = 1, min_confidence: float | None = None, reference_file: str | None = None, callers_file: str | None = None) -> DataFrame:
    """Who calls ``name``, up to ``depth`` steps away, and files that call it outside any symbol (first step only).

    Files filter the first step. Of several rows of a (name, file) the most confident counts, then the
    first caller line. ``name`` itself may appear where it calls itself, directly or not."""
    refs = _confident(ix, min_confidence).select("name", "file", "line", "caller_id", "target_id", "confidence")
    who = ix.symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("caller"), "kind", F.col("file").alias("caller_file"), F.col("line").alias("caller_line"), "signature")
    depth = min(depth, DEPTH)
    if depth > 1:  # calls for every step, and the seed's own rows, which are all that the first reads
        refs = written(refs.filter("caller_id IS NOT NULL").unionByName(refs.filter(F.col("caller_id").isNull() & (F.col("name") == name))), "calls")
    own = refs.filter(F.col("name") == name)
    if reference_file:
        ids = symbol_ids(ix, name, reference_file)
        own = own.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")

    def named(found: DataFrame) -> DataFrame:
        return found.join(unsent(who), "caller_id").select(F.col("name").alias("at"), F.col("caller").alias("name"), known_kind().alias("kind"), F.col("caller_file").alias("file"), F.col("caller_line").alias("line"), "signature", F.col("file").alias("target_file"), "confidence")

    bare = own.filter("caller_id IS NULL").select(F.col("name").alias("at"), F.lit("<module>").alias("name"), F.lit("module").alias("kind"), "file", "line", F.concat(F.lit("<module> "), "file").alias("signature"), F.col("file").alias("target_file"), "confidence")
    first = named(own).unionByName(bare)
    if callers_file:
        first = first.filter(X.contains_ci("file", callers_file))
    order = {"less": -F.col("confidence")} | {c: F.col(c) for c in ("line", "kind", "signature", "target_file")}
    out = _walk(seeds(ix, name), named(refs), depth, order, first)
    return out.select(F.col("name").alias("caller_name"), F.col("kind").alias("caller_kind"), "file", "line", "signature", "depth", "target_file", (-F.col("less")).alias("confidence")).orderBy("depth", "file", "line", "caller_name")


def callees(ix: Index, name: str, depth: int = 1, min_confidence: float | None = None, reference_file: str | None = None, callees_file: str | None = None) -> DataFrame:
    """What ``name`` calls, as call sites, up to ``depth`` steps away."""
    who = ix.symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("at"), F.col("file").alias("source_file"))
    edges = _confident(ix, min_confidence).join(unsent(who), "caller_id").withColumn("context", F.coalesce("context", F.lit("")))
    first = edges.filter(F.col("at") == name) if reference_file or callees_file or depth == 1 else None
    if reference_file:
        first = first.filter(X.contains_ci("source_file", reference_file))
    if callees_file:
        own = ix.symbols.filter(X.contains_ci("file", callees_file)).select(F.col("id").alias("target_id"), "name")
        first = first.join(own, ["target_id", "name"], "left_semi")
    order = {"less": -F.col("confidence")} | {c: F.col(c) for c in ("line", "context", "source_file")}
    out = _walk(seeds(ix, name), edges, min(depth, DEPTH), order, first)
    return out.select(F.col("name").alias("callee_name"), "file", "line", "context", "depth", "source_file", (-F.col("less")).alias("confidence")).orderBy("depth", "file", "line", "callee_name")


def name_edges(ix: Index, min_confidence: float | None = None) -> DataFrame:
    """(caller, callee) names."""
    who = ix.symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("caller"))
    return _confident(ix, min_confidence).join(unsent(who), "caller_id").select("caller", F.col("name").alias("callee")).distinct()


def call_path(ix: Index, start: str, end: str, reference_file: str | None = None, destination_file: str | None = None, min_confidence: float | None = None, depth: int = DEPTH) -> DataFrame:
    """Shortest chain of calls: (hop, name, kind, file, line), no rows where there is none.

    Of several shortest chains, each name comes from its least predecessor by name. Hops show the
    first definition of a name."""
    spark = ix.symbols.sparkSession
    hops: list[str] = []
    known = not destination_file or not symbol_ids(ix, end, destination_file).isEmpty()
    if known and (not reference_file or not symbol_ids(ix, start, reference_file).isEmpty()):
        if start == end and not reference_file and not destination_file:
            hops = [start]
        else:
            hops = _chain(ix, start, end, reference_file, min_confidence, depth)
    listed = spark.createDataFrame([(k, n) for k, n in enumerate(hops)], "hop long, name string")
    first = first_per(ix.symbols.join(listed.select("name").distinct(), "name", "left_semi"), ["name"], *PLACE).select("name", known_kind().alias("kind"), "file", "line")
    return listed.join(first, "name", "left").select("hop", "name", F.coalesce("kind", F.lit("function")).alias("kind"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0).cast("long")).alias("line")).orderBy("hop")


def _chain(ix: Index, start: str, end: str, reference_file: str | None, min_confidence: float | None, depth: int) -> list[str]:
    edges = name_edges(ix, min_confidence).persist()
    first = edges
    if reference_file:
        first = name_edges(ix.with_(symbols=ix.symbols.filter(X.contains_ci("file", reference_file))), min_confidence)
    levels = [ix.symbols.sparkSession.createDataFrame([(start, None)], "at string, parent string")]
    seen = levels[0].select("at")
    for level in range(1, min(depth, DEPTH) + 1):
        step = (first if level == 1 else edges).join(levels[-1].select(F.col("at").alias("caller")), "caller").groupBy(F.col("callee").alias("at")).agg(F.min("caller").alias("parent"))
        new = written(step.join(seen, "at", "left_anti"), "path")
        levels.append(new)
        if not new.filter(F.col("at") == end).isEmpty():
            chain = [end]
            for back in reversed(levels[1:]):  # one row of each level
                chain.append(back.filter(F.col("at") == chain[-1]).first()["parent"])
            return chain[::-1]
        if new.isEmpty():
            break
        seen = seen.unionByName(new.select("at"))
    return []


def entry_points(ix: Index, min_confidence: float | None = None, file: str | None = None) -> DataFrame:
    """Functions and methods whose name nothing inside a symbol calls."""
    called = _confident(ix, min_confidence).filter("caller_id IS NOT NULL").select("name").distinct()
    own = ix.symbols.filter(F.col("kind").isin(*CALLABLE))
    if file:
        own = own.filter(F.col("file") == file)
    return own.join(called, "name", "left_anti").select("id", "name", "kind", "file", "line").orderBy("file", "line", "id")


def flows(ix: Index, entries: DataFrame, depth: int = 10, branching: int = 4, min_confidence: float | None = None) -> DataFrame:
    """Steps of the flow from each of ``entries`` (a column ``name``): (entry, step, name, kind, file, line, depth).

    A symbol's first ``branching`` callee rows by confidence count (a callee has a row for each of its
    definitions, by place; so no name needs more than its first ``branching``); a name is entered once, by the
    earliest step that reaches it. Flows of one step are none."""
    b = min(branching, BRANCHING)
    defs = ix.symbols.filter(F.col("kind").isin(*CALLABLE)).withColumn("which", F.row_number().over(Window.partitionBy("name").orderBy(*PLACE))).filter(F.col("which") <= max(1, b))
    defs = defs.select("name", "which", F.col("id").alias("def_id"), known_kind().alias("kind"), F.col("file").alias("def_file"), F.col("line").alias("def_line"))
    rows = _confident(ix, min_confidence).filter("caller_id IS NOT NULL").groupBy("caller_id", "name").agg(F.max("confidence").alias("confidence")).join(defs, "name", "left")
    w = Window.partitionBy("caller_id").orderBy(F.desc("confidence"), "name", "which")
    edges = written(rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= b).drop("which"), "flow-edges")
    first = defs.filter("which = 1").join(entries.select("name").distinct(), "name", "left_semi")
    level = first.select(F.col("name").alias("entry"), F.col("def_id").alias("id"), "name", "kind", F.col("def_file").alias("file"), F.col("def_line").alias("line"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("step"))
    out = seen = level = written(level, "flow")
    for d in range(1, min(depth, FLOW_DEPTH) + 1):
        found = level.filter("id IS NOT NULL").select("entry", F.col("id").alias("caller_id"), F.col("step").alias("from")).join(edges, "caller_id")
        found = found.join(seen.select("entry", "name"), ["entry", "name"], "left_anti")
        found = first_per(found, ["entry", "name"], "from", "nth")
        base = level.groupBy("entry").agg(F.max("step").alias("base"))
        found = found.join(base, "entry").withColumn("step", F.col("base") + F.row_number().over(Window.partitionBy("entry").orderBy("from", "nth")))
        level = found.select("entry", F.col("def_id").alias("id"), "name", F.coalesce("kind", F.lit("function")).alias("kind"), F.coalesce("def_file", F.lit("")).alias("file"), F.coalesce("def_line", F.lit(0).cast("long")).alias("line"), F.lit(d).cast("long").alias("depth"), F.col("step").cast("long").alias("step"))
        level = written(level, "flow")
        if level.isEmpty():
            break
        out = seen = seen.unionByName(level)
    released(edges)
    long = out.groupBy("entry").agg(F.count("*").alias("n")).filter("n > 1").select("entry")
    return out.join(long, "entry", "left_semi").select("entry", "step", "name", "kind", "file", "line", "depth").orderBy("entry", "step")


def severity(depth="depth"):
    return F.when(X.col(depth) == 1, "will_break").when(X.col(depth) == 2, "likely_affected").otherwise("may_need_testing")


def risk(count):
    return F.when(count <= 3, "low").when(count <= 10, "medium").when(count <= 25, "high").otherwise("critical")


def _blast_edges(ix: Index, names: list[str] | DataFrame, direction: str, include_tests: bool, min_confidence: float | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Where a blast starts, its edges, and those beside them in the first step."""
    start = seeds(ix, *names) if isinstance(names, list) else written(names.select(F.col("name").alias("source"), F.col("name").alias("at")).distinct(), "start")
    who = ix.symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("caller"), F.col("kind").alias("caller_kind"), F.col("file").alias("caller_file"), F.col("line").alias("caller_line"))
    edges = _confident(ix, min_confidence).join(unsent(who), "caller_id")
    if direction == "upstream":
        edges = edges.select(F.col("name").alias("at"), F.col("caller").alias("name"), F.col("caller_kind").alias("kind"), F.col("caller_file").alias("file"), F.col("caller_line").alias("line"), "confidence", F.lit(0).alias("via"))
        up = ix.symbols.select(F.col("id").alias("parent_id"), F.col("name").alias("at"))
        child = ix.symbols.select(F.col("id").alias("child_id"), "name", "kind", "file", "line")
        kids = ix.type_edges.join(unsent(up), "parent_id").join(unsent(child), "child_id").select("at", "name", "kind", "file", "line", F.lit(1.0).alias("confidence"), F.lit(1).alias("via"))
    else:
        kinds = first_per(ix.symbols, ["name"], *PLACE).select("name", "kind")
        edges = edges.join(kinds, "name", "left").select(F.col("caller").alias("at"), "name", F.coalesce("kind", F.lit("function")).alias("kind"), "file", "line", "confidence", F.lit(0).alias("via"))
        kids = None
    if not include_tests:
        edges, kids = edges.filter(~X.is_test("file")), kids and kids.filter(~X.is_test("file"))
    return start, edges, kids


def blast(ix: Index, names: list[str] | DataFrame, direction: str = "upstream", depth: int = 3, include_tests: bool = False, min_confidence: float | None = None) -> DataFrame:
    """What a change of each of ``names`` affects: (source, name, kind, file, line, depth, confidence, severity).

    Upstream: callers, and in the first step types that inherit, certain. Downstream: callees, at their call
    sites. Tests are left out and not traversed unless asked for."""
    start, edges, kids = _blast_edges(ix, names, direction, include_tests, min_confidence)
    order = {"via": F.col("via"), "less": -F.col("confidence"), "line": F.col("line"), "kind": F.col("kind")}
    out = _walk(start, edges, min(depth, DEPTH), order, also=kids, many=not isinstance(names, list))
    return out.select("source", "name", known_kind().alias("kind"), "file", "line", "depth", (-F.col("less")).alias("confidence"), severity().alias("severity")).orderBy("source", "depth", "file", "line", "name")


def blast_sizes(ix: Index, names: list[str] | DataFrame, direction: str = "upstream", depth: int = 3, include_tests: bool = False, min_confidence: float | None = None) -> DataFrame:
    """(source, total): how many rows ``blast`` has for each of ``names`` that has any, counted without listing them."""
    start, edges, kids = _blast_edges(ix, names, direction, include_tests, min_confidence)
    return _sizes(start, edges, min(depth, DEPTH), kids)


def blast_tiers(affected: DataFrame) -> DataFrame:
    return affected.groupBy("source", "severity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.min("depth").alias("least_depth")).orderBy("source", "least_depth")


def blast_risk(affected: DataFrame) -> DataFrame:
    return affected.groupBy("source").agg(F.count("*").alias("total"), F.countDistinct("file").alias("files")).withColumn("risk", risk(F.col("total")))


def dep_edges(ix: Index) -> DataFrame:
    """(src, dst): a file imports every other file whose stem its import names."""
    by = ix.files.select(X.stem("path").alias("stem"), F.col("path").alias("dst"))
    return ix.imports.select(F.col("source_file").alias("src"), X.import_stem("import_path").alias("stem")).distinct().join(by, "stem").filter("src <> dst").select("src", "dst").distinct()


def reach(edges: DataFrame | Index, start: str | DataFrame, reverse: bool = False) -> DataFrame:
    """Everything that ``start`` reaches (or that reaches it), itself included.

    Over an index, files meet at the stems that imports name: a level goes from files to stems and on to files, and
    a stem is passed once. So the walk is linear in files and imports, where edges between files would be imports
    times files of a stem. Over edges (src, dst) a level is one join."""
    if isinstance(edges, Index):
        spark = edges.files.sparkSession
        own = edges.files.select(F.col("path").alias("at"), X.stem("path").alias("stem"))
        named = edges.imports.select(F.col("source_file").alias("at"), X.import_stem("import_path").alias("stem")).distinct()
        out, back = (own, named) if reverse else (named, own)
    else:
        spark = edges.sparkSession
        src, dst = ("dst", "src") if reverse else ("src", "dst")
        out = edges.select(F.col(src).alias("at"), F.col(dst).alias("stem"))
        back = None
    out, levels = out.persist(), []
    back = back and back.persist()
    seen = frontier = spark.createDataFrame([(start,)], "at string") if isinstance(start, str) else start.select("at").distinct()
    passed = None
    while True:
        stems = out.join(frontier, "at").select("stem").distinct()
        if back is None:
            new = stems.select(F.col("stem").alias("at"))
        else:
            if passed is not None:
                stems = stems.join(passed, "stem", "left_anti")
            stems = written(stems, "reach-stems")
            levels.append(stems)
            passed = stems if passed is None else passed.unionByName(stems)
            new = back.join(stems, "stem").select("at").distinct()
        frontier = written(new.join(seen, "at", "left_anti"), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    out.unpersist()
    if back is not None:
        back.unpersist()
    released(*levels)
    return seen.select(F.col("at").alias("file")).distinct()


def reach_between(edges: DataFrame | Index, start: str, end: str) -> DataFrame:
    return reach(edges, start).intersect(reach(edges, end, reverse=True))
