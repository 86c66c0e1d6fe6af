"""Resolution of references: callers and targets by name, confidence, and counts of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..index import Index


def local_definitions(symbols: DataFrame) -> DataFrame:
    """(file, name, id) of a file's last definition of each name."""
    return symbols.groupBy("file", "name").agg(F.max_by("id", F.struct("line", "id")).alias("id"))


def targets(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """``refs`` with ``target_id``: the file's own definition, else the only one there is, else null."""
    local = local_definitions(symbols).withColumnRenamed("id", "local_id")
    unique = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("unique_id")).filter("n = 1").drop("n")
    return refs.drop("target_id").join(local, ["file", "name"], "left").join(unique, "name", "left").withColumn("target_id", F.coalesce("local_id", "unique_id")).drop("local_id", "unique_id")


def callers(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """``refs`` with ``caller_id`` of ``caller_name`` in the same file."""
    local = local_definitions(symbols).select("file", F.col("name").alias("caller_name"), F.col("id").alias("caller_id"))
    return refs.drop("caller_id").join(local, ["file", "caller_name"], "left")


def confidence(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``refs`` (name, file, kind, caller_id, …) with ``confidence``: an import, or an imported name, 0.95; a name
    that the file defines 0.85; one that the caller's scope defines 0.8; else 0.5."""
    tail = F.regexp_extract("import_path", r"([^:/.]*)$", 1)
    imported = imports.select(F.col("source_file").alias("file"), F.explode(F.array(tail, F.regexp_extract("import_path", "([^:/]*)$", 1), F.col("import_path"))).alias("name")).distinct().withColumn("imported", F.lit(True))
    own = symbols.select("file", "name").distinct().withColumn("own", F.lit(True))
    scope = symbols.select(F.col("id").alias("caller_id"), F.col("scope").alias("caller_scope"))
    scoped = symbols.filter("scope IS NOT NULL").select("file", "name", F.col("scope").alias("caller_scope")).distinct().withColumn("scoped", F.lit(True))
    out = refs.drop("confidence").join(imported, ["file", "name"], "left").join(own, ["file", "name"], "left").join(scope, "caller_id", "left").join(scoped, ["file", "name", "caller_scope"], "left")
    value = F.when((F.col("kind") == "import") | F.col("imported"), 0.95).when(F.col("own"), 0.85).when(F.col("scoped"), 0.8).otherwise(0.5)
    return out.withColumn("confidence", value).drop("imported", "own", "caller_scope", "scoped")


def parents(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(child_id, parent_id, relationship) of named inheritance: the parent in the same file, else the first of its name by place."""
    child = local_definitions(symbols).select("file", F.col("name").alias("child"), F.col("id").alias("child_id"))
    near = local_definitions(symbols).select("file", F.col("name").alias("parent"), F.col("id").alias("near_id"))
    any_ = symbols.groupBy(F.col("name").alias("parent")).agg(F.min_by("id", F.struct("file", "line", "id")).alias("any_id"))
    out = edges.join(child, ["file", "child"]).join(near, ["file", "parent"], "left").join(any_, "parent", "left")
    return out.select("child_id", F.coalesce("near_id", "any_id").alias("parent_id"), "relationship").filter("parent_id IS NOT NULL").distinct()


def status(ix: Index) -> DataFrame:
    """Counts of an index's tables in one row."""
    one = lambda df, n: df.agg(F.count("*").alias(n))
    out = one(ix.files, "files").crossJoin(one(ix.symbols, "symbols"))
    out = out.crossJoin(ix.refs.agg(F.count("*").alias("refs"), F.count("caller_id").alias("refs_with_caller"))).crossJoin(one(ix.type_edges, "type_edges"))
    return out.crossJoin(one(ix.embeddings, "embeddings")) if ix.embeddings is not None else out.withColumn("embeddings", F.lit(0).cast("long"))


def catalogue(indexes: dict[str, Index]) -> DataFrame:
    """(repo, files, symbols) of several indexes."""
    out = None
    for repo, ix in sorted(indexes.items()):
        row = status(ix).select(F.lit(repo).alias("repo"), "files", "symbols")
        out = row if out is None else out.unionByName(row)
    return out
