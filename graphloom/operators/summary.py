"""Hierarchical roll-ups: every directory's metrics from one aggregation over exploded ancestor paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..index import Index
from ..plans.frames import written


def ancestors(path="path"):
    """A path's directories and itself, and the root as '.'."""
    parts = F.split(X.col(path), "/")
    return F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def _under(df: DataFrame, path: str, column: str) -> DataFrame:
    path = X.normal_path(path)
    return df if path == "." else df.filter((F.col(column) == path) | F.col(column).startswith(path + "/"))


def languages(ix: Index, path: str = ".") -> DataFrame:
    return _under(ix.files, path, "path").groupBy("language").agg(F.count("*").alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines")).orderBy("language")


def kinds(ix: Index, path: str = ".") -> DataFrame:
    return _under(ix.symbols, path, "file").groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")


def dependencies(ix: Index, path: str = ".") -> DataFrame:
    return _under(ix.imports, path, "source_file").agg(F.countDistinct("import_path").alias("deps"))


def roll_up(ix: Index) -> DataFrame:
    """(path, parent, depth, files, lines, symbols, deps) of every file and directory, all in one pass each."""
    files = ix.files.select(F.explode(ancestors("path")).alias("path"), "line_count").groupBy("path").agg(F.count("*").alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"))
    syms = ix.symbols.groupBy("file").agg(F.count("*").alias("n")).select(F.explode(ancestors("file")).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("symbols"))
    deps = ix.imports.distinct().select(F.explode(ancestors("source_file")).alias("path"), "import_path").groupBy("path").agg(F.countDistinct("import_path").alias("deps"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    depth = F.when(F.col("path") == ".", 0).otherwise(F.size(F.split("path", "/"))).cast("long")
    parent = F.when(F.col("path") == ".", F.lit(None).cast("string")).when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    return files.join(syms, "path", "left").join(deps, "path", "left").select("path", parent.alias("parent"), depth.alias("depth"), "files", "lines", zero("symbols"), zero("deps")).orderBy("path")


def children(ix: Index, path: str) -> DataFrame:
    """Metrics of a directory's children; a level that is one directory alone is passed through."""
    tree = roll_up(ix).persist()
    at = X.normal_path(path)
    for _ in range(20):
        below = tree.filter(F.col("parent") == at)
        two = below.limit(2).collect()  # only whether there is exactly one, and whether it is a directory
        if len(two) != 1 or tree.filter(F.col("parent") == two[0]["path"]).isEmpty():
            break
        at = two[0]["path"]
    return below.orderBy("path")


def tree(ix: Index, path: str = ".", depth: int | None = 0) -> DataFrame:
    """``path`` and what lies below it to ``depth`` levels (None: all, 20 at most): (path, parent, level, type, files, lines, symbols, deps).

    A directory whose only child is a directory shows that one's children as its own. The root shows its directories,
    not its files. An unknown path is a directory with no files."""
    at, nodes = X.normal_path(path), roll_up(ix).persist()
    spark, dirs = nodes.sparkSession, nodes.select(F.col("parent").alias("dir")).filter("dir IS NOT NULL").distinct().withColumn("is_dir", F.lit(True))
    typed = nodes.join(dirs, nodes["path"] == dirs["dir"], "left").drop("dir").withColumn("type", F.when(F.col("is_dir"), "directory").otherwise("file")).drop("is_dir").persist()
    # directories that are passed through, and where each chain of them ends
    only = typed.filter("parent IS NOT NULL AND parent <> '.'").groupBy("parent").agg(F.count("*").alias("n"), F.min("path").alias("to"), F.min("type").alias("kind")).filter("n = 1 AND kind = 'directory'").select(F.col("parent").alias("dir"), "to")
    for _ in range(5):  # doubles the reach each time: chains of up to 32
        further = only.select(F.col("dir").alias("to"), F.col("to").alias("next"))
        only = only.join(further, "to", "left").select("dir", F.coalesce("next", "to").alias("to"))
    only = only.persist()
    metrics = ["files", "lines", "symbols", "deps"]
    own = spark.createDataFrame([(at,)], "path string").join(typed, "path", "left").select("path", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"), F.coalesce("type", F.lit("directory")).alias("type"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in metrics))
    out = level = own
    for k in range(1, (20 if depth is None else min(depth, 20)) + 1):
        shown = level.filter("type = 'directory'").select(F.col("path").alias("shown")).join(only, F.col("shown") == F.col("dir"), "left").select("shown", F.coalesce("to", "shown").alias("in"))
        below = typed.withColumnRenamed("parent", "in").join(shown, "in").filter("in <> '.' OR type = 'directory'")
        level = written(below.select("path", F.col("shown").alias("parent"), F.lit(k).alias("level"), "type", *metrics), "tree")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    nodes.unpersist()
    return out.orderBy("level", "path")


def detailed(ix: Index, shown: DataFrame, detail: str = "outline", most: int = 50) -> DataFrame:
    """Rows of ``tree`` with ``outline`` (a file's first top-level symbols) and ``edges`` (imports inside a directory).

    The outlines of all shown files are one aggregation, and so are the edges of all shown directories. ``light`` has neither."""
    if detail == "light":
        return shown
    top = ix.symbols.filter(F.col("scope").isNull() & (F.col("kind") != "method"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("line", "col", "id"))
    outline = top.withColumn("nth", nth).filter(F.col("nth") <= most).groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("nth", "kind", "name", "line"))).alias("outline"))
    pairs = import_edges(ix, ".")
    above = lambda c: ancestors(c)
    inside = pairs.select("from", "to", F.explode(F.array_intersect(above("from"), above("to"))).alias("path"))
    edges = inside.join(shown.filter("type = 'directory'").select("path"), "path", "left_semi").groupBy("path").agg(F.count("*").alias("edges"))
    return shown.join(outline, "path", "left").join(edges, "path", "left").orderBy("level", "path")


def root_dirs(ix: Index) -> DataFrame:
    return ix.files.filter(F.instr("path", "/") > 0).select(F.substring_index("path", "/", 1).alias("dir")).distinct().orderBy("dir")


def outline(ix: Index, file: str, most: int = 50) -> DataFrame:
    """Top-level symbols of a file that are no methods."""
    return ix.symbols.filter((F.col("file") == file) & F.col("scope").isNull() & (F.col("kind") != "method")).orderBy("line", "col", "id").limit(most).select("id", "name", "kind", "line")


def import_edges(ix: Index, directory: str) -> DataFrame:
    """(from, to) pairs of files below a directory, by the import's file stem."""
    inside = _under(ix.files, directory, "path").select(F.col("path").alias("to"), X.stem("path").alias("stem"))
    source = _under(ix.imports, directory, "source_file").select(F.col("source_file").alias("from"), X.stem("import_path").alias("stem")).distinct()
    return source.join(inside, "stem").filter(F.col("from") != F.col("to")).select("from", "to").distinct().orderBy("from", "to")


def content_hash(ix: Index, path: str = ".") -> DataFrame:
    """One digest of a subtree's symbols and file hashes: an order-free sum of row hashes, then SHA-256."""
    rows = _under(ix.symbols, path, "file").select(F.col("file").alias("path"), "id").join(ix.files.select("path", "hash"), "path")
    return rows.agg(F.sha2(F.concat_ws(":", F.count("*"), F.sum(F.xxhash64("id", "path", "hash").cast("decimal(38,0)"))), 256).alias("content_hash"))


def prompt(ix: Index, path: str, most_signatures: int = 100, most_imports: int = 50) -> DataFrame:
    """Text that describes a subtree to a model: metrics, signatures and imports."""
    sig = _under(ix.symbols, path, "file").orderBy("kind", "name", "id").limit(most_signatures).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "name", "id", "signature"))), lambda s: s["signature"]), "\n").alias("signatures"))
    imp = _under(ix.imports, path, "source_file").select("import_path").distinct().orderBy("import_path").limit(most_imports).agg(F.array_join(F.sort_array(F.collect_list("import_path")), "\n").alias("imports"))
    total = _under(ix.files, path, "path").agg(F.count("*").alias("files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"))
    return total.crossJoin(sig).crossJoin(imp).select(F.concat_ws("\n", F.format_string("%s: %d files, %d lines", F.lit(path), "files", "lines"), F.lit("Signatures:"), "signatures", F.lit("Imports:"), "imports").alias("prompt"))


def cached(ix: Index, cache: DataFrame, path: str) -> DataFrame:
    """The cached description of a subtree, if its digest is unchanged."""
    return content_hash(ix, path).withColumn("path", F.lit(path)).join(cache.select("path", "content_hash", "description"), ["path", "content_hash"], "left")


def overview(ix: Index, path: str, most: int = 10) -> DataFrame:
    """Text that describes a directory by its children: metrics, and each child's first ``most`` symbols by kind and name."""
    below = children(ix, path).select(F.col("path").alias("child"), "files", "lines", "symbols")
    held = ix.symbols.select("kind", "name", F.explode(ancestors("file")).alias("child")).join(below.select("child"), "child", "left_semi").distinct()
    nth = F.row_number().over(Window.partitionBy("child").orderBy("kind", "name"))
    names = held.withColumn("nth", nth).filter(F.col("nth") <= most).groupBy("child").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "kind", "name"))), lambda s: F.concat_ws(" ", s["kind"], s["name"])), ", ").alias("held"))
    line = F.concat_ws(": ", F.format_string("%s (%d files, %d lines, %d symbols)", "child", "files", "lines", "symbols"), "held")
    return below.join(names, "child", "left").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child", line.alias("text")))), lambda s: s["text"]), "\n").alias("prompt")).select(F.concat_ws("\n", F.lit(f"{X.normal_path(path)}:"), "prompt").alias("prompt"))


def cache_stored(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The description cache after storing ``new`` (path, content_hash, description, created_at): one row a path, the newest."""
    fresh = new.select(*cache.columns).groupBy("path").agg(*(F.max_by(c, "created_at").alias(c) for c in cache.columns if c != "path")).select(*cache.columns)
    return cache.join(fresh.select("path"), "path", "left_anti").unionByName(fresh)


def described(ix: Index, cache: DataFrame, path: str, generate, now: int) -> tuple[DataFrame, DataFrame]:
    """(row with the description, the cache): a cached description of an unchanged subtree, or one by ``generate`` (prompt -> text or None)."""
    row = cached(ix, cache, path).first()
    if row["description"] is None and (text := generate(prompt(ix, path).first()["prompt"])) is not None:
        new = ix.files.sparkSession.createDataFrame([(path, row["content_hash"], text, now)], "path string, content_hash string, description string, created_at long")
        cache = cache_stored(cache, new)
    return cached(ix, cache, path), cache
