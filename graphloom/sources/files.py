"""Source files as a DataFrame: listing, exclusions, nested repositories, ignore files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.frames import written

#: Directories that are never walked, and hidden names that are.
EXCLUDED = ("node_modules", "vendor", "target", "build", "dist", "__pycache__", ".venv")
HIDDEN_ALLOWED = (".github",)


def allowed(path="path"):
    """Whether a relative path may be indexed: no excluded part, no hidden part but the allowed ones."""
    parts = F.split(X.col(path), "/")
    return ~F.exists(parts, lambda p: p.isin(*EXCLUDED) | (p.startswith(".") & ~p.isin(*HIDDEN_ALLOWED) & ~p.isin(".", "..")))


def outside_nested(files: DataFrame, markers: DataFrame) -> DataFrame:
    """``files`` without those below a directory that holds a ``.git`` of its own (``markers``: dir)."""
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))).alias("dir"))
    inside = above.filter("dir <> path").join(markers.filter("dir <> ''").select("dir").distinct(), "dir", "left_semi").select("path").distinct()
    return files.join(inside, "path", "left_anti")


def _inside(uri: str, at: str) -> tuple[list[str], list[str]]:
    """Directories to walk and other names directly in directory ``at``, relative to ``uri``. What is never indexed is not
    entered, nor are linked directories, which can lead back; a ``.git`` directory is a name. A directory that has gone
    since is empty, but a root that is not there is an error."""
    fs, base = pafs.FileSystem.from_uri(f"{uri}/")
    dirs, names = [], []
    for f in fs.get_file_info(pafs.FileSelector(f"{base.rstrip('/')}/{at}".rstrip("/") or "/", allow_not_found=bool(at))):
        name = f"{at}/{f.base_name}".lstrip("/")
        if f.type != pafs.FileType.Directory:
            names.append(name)
        elif f.base_name == ".git":
            names.append(name)
        elif enterable(f.base_name) and not (isinstance(fs, pafs.LocalFileSystem) and os.path.islink(f.path)):
            dirs.append(name)
    return dirs, names


def enterable(name: str) -> bool:
    return name not in EXCLUDED and (not name.startswith(".") or name in HIDDEN_ALLOWED)


def _walked(uri: str, batch_rows: int = 10_000):
    """Names below the directories of a task, one directory after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for at, deep in zip(batch["dir"].to_pylist(), batch["deep"].to_pylist()):
                left = [at]
                while left:
                    dirs, names = _inside(uri, left.pop())
                    left += dirs if deep else []
                    held += names
                    while len(held) >= batch_rows:
                        yield _named(uri, held[:batch_rows])
                        held = held[batch_rows:]
        if held:
            yield _named(uri, held)

    return run


def _named(uri: str, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f"{uri}/{quote(n)}" for n in names], pa.string())], ["path", "uri"])


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, uri) of what lies below ``root``, without directories that are never indexed. Spark's own file sources pass
    over names that begin with a dot or an underscore, and those matter here.

    The driver goes down only until it has four directories a core; tasks walk from there."""
    uri = (root if "://" in root else "file://" + quote(os.path.abspath(root))).rstrip("/")
    spread = spark.sparkContext.defaultParallelism * 4
    passed, below = [], [""]
    while below and len(below) < spread:
        passed, below = passed + below, [d for at in below for d in _inside(uri, at)[0]]
    work = [(d, False) for d in passed] + [(d, True) for d in below]
    tasks = spark.createDataFrame(work, "dir string, deep boolean").repartition(min(len(work), spread))
    return tasks.mapInArrow(_walked(uri), "path string, uri string")


def _contents(most_bytes: int = 1 << 23):
    """Texts of files, passed on whenever some ``most_bytes`` are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts, size = [], [], 0
            for name, uri in zip(batch["path"].to_pylist(), batch["uri"].to_pylist()):
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_stream(path) as f:
                    data = f.read()
                names.append(name)
                texts.append(data.decode("utf-8", "replace"))
                size += len(data)
                if size >= most_bytes:
                    yield _texts(names, texts)
                    names, texts, size = [], [], 0
            yield _texts(names, texts)

    return run


def _texts(names: list[str], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["path", "content"])


def read(names: DataFrame) -> DataFrame:
    """(path, content) of listed files, read by the executors; invalid UTF-8 is replaced."""
    return names.select("path", "uri").repartition(names.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(_contents(), "path string, content string")


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pattern of each ignore file: whose, below which directory, its number and expression, and whether it takes back."""
    for batch in batches:
        out = []
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
            lines = [x.strip() for x in content.splitlines()]
            out += [(path, path.rpartition("/")[0], n, X.glob_to_regex(x.removeprefix("!")), x.startswith("!")) for n, x in enumerate(lines) if x and not x.startswith("#")]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], ["file", "dir", "n", "regex", "back"])


def unignored(names: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """``names`` that no ignore file (path, content) ignores. A file's patterns apply to paths below its own directory, relative
    to it, and the last that applies decides. Paths meet the patterns of their own directories alone; Spark broadcasts
    the patterns where their size allows."""
    rules = ignore_files.mapInArrow(_rules, "file string, dir string, n int, regex string, back boolean")
    parts = F.split("path", "/")
    above = names.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    here = F.substr("path", F.when(F.col("dir") == "", 1).otherwise(F.length("dir") + 2))
    applied = above.join(rules, "dir").filter(F.rlike(here, F.col("regex"))).groupBy("path", "file").agg(F.max_by("back", "n").alias("back"))
    return names.join(applied.filter("NOT back").select("path").distinct(), "path", "left_anti")


def walk(spark: SparkSession, root: str, ignore: list[str] | None = None, known_only: bool = True) -> DataFrame:
    """(path, content, language) of the files below ``root``, paths relative to it.

    Ignore files' patterns apply below their own directory, ``ignore`` to all paths."""
    every = written(listed(spark, root), "listing")
    found = every.filter(allowed("path"))
    git = every.filter(F.col("path").rlike(r"(^|/)\.git$")).select(F.regexp_replace("path", r"/?\.git$", "").alias("dir")).distinct()
    ignores = read(every.filter(F.col("path").rlike(r"(^|/)(\.gitignore|\.ignore)$")))
    if known_only:
        found = found.filter(X.language("path").isNotNull())
    found = unignored(outside_nested(found, git), ignores)
    if ignore:
        found = found.filter(~X.ignored("path", ignore))
    return read(found).withColumn("language", X.language("path"))
