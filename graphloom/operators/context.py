"""Everything about a symbol: who calls, imports and uses it, what it calls, and where it takes part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..index import Index
from ..plans.frames import written
from . import graph
from .lookup import CALLABLE, known_kind


def matching(ix: Index, name: str, file: str | None = None, kind: str | None = None, scope: str | None = None) -> DataFrame:
    out = ix.symbols.filter(F.col("name") == name)
    if file:
        out = out.filter(X.ends_ci("file", file))
    if kind:
        out = out.filter(F.col("kind") == kind)
    if scope:
        out = out.filter(F.col("scope") == scope)
    return out.select("id", "name", known_kind().alias("kind"), "file", "line", "end_line", "signature").orderBy("file", "line", "id")


def _refs(ix: Index, minimum: float | None) -> DataFrame:
    return ix.refs.filter(F.col("confidence") >= X.confidence(minimum))


def callers(ix: Index, name: str, min_confidence: float | None = None) -> DataFrame:
    who = ix.symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("caller"), known_kind().alias("kind"), F.col("file").alias("caller_file"), F.col("line").alias("caller_line"))
    return _refs(ix, min_confidence).filter(F.col("name") == name).join(who, "caller_id").select(F.col("caller").alias("name"), "kind", F.col("caller_file").alias("file"), F.col("caller_line").alias("line")).distinct().orderBy("file", "line", "name")


def importers(ix: Index, name: str) -> DataFrame:
    return ix.imports.filter(X.ends_ci("import_path", name)).select("source_file").distinct().orderBy("source_file")


def type_users(ix: Index, name: str, min_confidence: float | None = None) -> DataFrame:
    """References outside any symbol."""
    return _refs(ix, min_confidence).filter((F.col("name") == name) & F.col("caller_id").isNull()).select("file", "line", "context").distinct().orderBy("file", "line")


def callees(ix: Index, ids: DataFrame, min_confidence: float | None = None) -> DataFrame:
    """Callees of each of ``ids`` (id), a row for each definition of their names."""
    defs = ix.symbols.filter(F.col("kind").isin(*CALLABLE)).select("name", "kind", F.col("file").alias("def_file"), F.col("line").alias("def_line"))
    found = _refs(ix, min_confidence).join(ids.select(F.col("id").alias("caller_id")), "caller_id").select("caller_id", "name").distinct().join(defs, "name", "left")
    return found.select(F.col("caller_id").alias("id"), "name", F.coalesce("kind", F.lit("function")).alias("kind"), F.coalesce("def_file", F.lit("")).alias("file"), F.coalesce("def_line", F.lit(0).cast("long")).alias("line")).distinct().orderBy("id", "file", "line", "name")


def children(ix: Index, ids: DataFrame) -> DataFrame:
    child = ix.symbols.select(F.col("id").alias("child_id"), "name", "kind", "file", "line")
    return ix.type_edges.join(ids.select(F.col("id").alias("parent_id")), "parent_id").join(child, "child_id").select(F.col("parent_id").alias("id"), "name", "kind", "file", "line", "relationship").orderBy("id", "file", "line", "name")


def participation(ix: Index, name: str, min_confidence: float | None = None, entries: int = 20) -> DataFrame:
    """(entry, step) of the first entry points' flows that pass ``name``."""
    first = graph.entry_points(ix, min_confidence).limit(entries)
    return graph.flows(ix, first, 5, 4, min_confidence).filter(F.col("name") == name).groupBy("entry").agg(F.min("step").alias("step")).orderBy("entry")


def symbol_context(ix: Index, name: str, file: str | None = None, kind: str | None = None, min_confidence: float | None = None) -> DataFrame:
    """A row for each matching symbol with all of the above as arrays."""
    own = matching(ix, name, file, kind)
    calls = _refs(ix, min_confidence)  # all calls, and the name's own rows: no part below reads others
    calls = written(calls.filter("caller_id IS NOT NULL").unionByName(calls.filter(F.col("caller_id").isNull() & (F.col("name") == name))), "calls")
    ix = ix.with_(refs=calls)

    def listed(df: DataFrame, as_: str, by: str | None = None) -> DataFrame:
        cols = [c for c in df.columns if c != by]
        agg = F.array_sort(F.collect_list(F.struct(*cols))).alias(as_)
        return df.groupBy(by).agg(agg) if by else df.agg(agg)

    out = own
    for df, as_ in ((callers(ix, name, min_confidence), "callers"), (importers(ix, name), "importers"), (type_users(ix, name, min_confidence), "type_users"), (participation(ix, name, min_confidence), "flows")):
        out = out.join(listed(df, as_).withColumn("name", F.lit(name)), "name")
    imports = ix.imports.join(own.select(F.col("file").alias("source_file")).distinct(), "source_file", "left_semi").distinct()
    out = out.join(listed(callees(ix, own, min_confidence), "callees", "id"), "id", "left").join(listed(children(ix, own), "children", "id"), "id", "left")
    return out.join(listed(imports.withColumnRenamed("source_file", "file"), "imports", "file"), "file", "left").orderBy("file", "line", "id")
