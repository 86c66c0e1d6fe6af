"""The relational index of a code base: six DataFrames and where they are kept."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from .plans.frames import sized

POINTER = "CURRENT"
SCHEMAS = {
    "files": "path string, language string, hash string, last_indexed long, line_count long, symbols_count long",
    "symbols": "id long, name string, kind string, file string, line long, col long, end_line long, scope string, signature string, language string, doc_comment string",
    "refs": "name string, file string, line long, col long, context string, caller_id long, confidence double, target_id long",
    "imports": "source_file string, import_path string",
    "type_edges": "child_id long, parent_id long, relationship string",
    "embeddings": "symbol_id long, file string, vector array<float>, stale boolean",
}


@dataclass(frozen=True)
class Index:
    files: DataFrame
    symbols: DataFrame
    refs: DataFrame
    imports: DataFrame
    type_edges: DataFrame
    embeddings: DataFrame | None = None

    def with_(self, **tables: DataFrame) -> Index:
        return replace(self, **tables)

    def save(self, path: str, meta: dict | None = None) -> None:
        """Write every table, and ``meta`` (repository, creation time, languages), into a new folder below ``path``, then
        turn the pointer to it in one rename.

        So an index that was loaded from ``path`` can be updated and saved there, and a save that breaks off changes
        nothing. The version before stays for readers that still hold it; older ones go."""
        spark = self.symbols.sparkSession
        version = f"v{time.time_ns():020d}"
        for f in fields(self):
            table = getattr(self, f.name)
            if table is not None:
                table.write.parquet(f"{path}/{version}/{f.name}")
        if meta is None and _there(spark, f"{path}/{POINTER}"):
            meta = read_meta(spark, path)
        if meta is not None:
            spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/{version}/meta")
        fs, jvm = _fs(spark, path), spark.sparkContext._jvm
        temp, pointer = (jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in (f".{POINTER}-{version}", POINTER))
        out = fs.create(temp, True)
        out.write(bytearray(version.encode()))
        out.close()
        option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(temp), fs.makeQualified(pointer), option)
        versions = sorted(s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)) if s.isDirectory() and s.getPath().getName().startswith("v"))
        for old in versions[:-2]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        path = current(sized(spark), path)
        return cls(**{name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items() if name != "embeddings" or _there(spark, f"{path}/{name}")})

    @classmethod
    def empty(cls, spark: SparkSession) -> Index:
        return cls(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})


def _fs(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def current(spark: SparkSession, path: str) -> str:
    """The folder that the pointer of a saved index names."""
    return f"{path}/{spark.read.text(f'{path}/{POINTER}').first()[0]}"


def read_meta(spark: SparkSession, path: str) -> dict:
    where = f"{current(spark, path)}/meta"
    return json.loads(spark.read.text(where).first()[0]) if _there(spark, where) else {}


def discovered(spark: SparkSession, home: str) -> dict[str, str]:
    """Saved indexes in the folders of ``home``: repository name -> folder. Folders without a pointer or a repository are none."""
    out = {}
    if _there(spark, home):
        for s in _fs(spark, home).listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)):
            path = s.getPath().toString()
            if s.isDirectory() and _there(spark, f"{path}/{POINTER}") and (repo := read_meta(spark, path).get("repository")):
                out[repo.rstrip("/").rpartition("/")[2]] = path
    return dict(sorted(out.items()))
