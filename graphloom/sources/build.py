"""Building and updating an index from parsed files, and text chunks of its symbols."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..index import Index
from ..plans.frames import written
from . import resolve
from .parse import parsed

CHUNK_BYTES = 32_768


def symbol_id(*columns: str):
    """An id that follows from a symbol's place and name, so that no numbering spans the corpus."""
    return F.xxhash64(*columns)


def symbols_of(rows: DataFrame) -> DataFrame:
    """The symbols of parsed files; one row a place and name."""
    sym = rows.select(F.col("path").alias("file"), "language", F.explode("symbols").alias("s")).select("file", "language", "s.*")
    return sym.select(symbol_id("file", "line", "col", "name").alias("id"), "name", "kind", "file", "line", "col", "end_line", "scope", "signature", "language", "doc_comment").dropDuplicates(["file", "line", "col", "name"])


def index(files: DataFrame) -> Index:
    """Index of ``files`` (path, content, language): extraction, resolution, confidence."""
    rows = written(parsed(files), "parsed")  # a file is parsed once, whatever is lost later
    symbols = symbols_of(rows)
    imports = rows.select(F.col("path").alias("source_file"), F.explode("imports").alias("import_path")).distinct()
    refs = rows.select(F.col("path").alias("file"), F.explode("refs").alias("r")).select("file", "r.*")
    refs = resolve.confidence(resolve.targets(resolve.callers(refs, symbols), symbols), symbols, imports)
    edges = resolve.parents(rows.select(F.col("path").alias("file"), F.explode("edges").alias("e")).select("file", "e.*"), symbols)
    listed = rows.select("path", "language", "hash", F.unix_timestamp().alias("last_indexed"), "line_count", F.size("symbols").cast("long").alias("symbols_count"))
    return Index(listed, symbols, refs.select("name", "file", "line", "col", "context", "caller_id", "confidence", "target_id"), imports, edges)


def without(ix: Index, paths: DataFrame) -> Index:
    """The index without some files: their rows go, and references to or from their symbols lose the id."""
    gone = paths.select("path").distinct()
    at = lambda c: gone.select(F.col("path").alias(c))
    ids = ix.symbols.join(at("file"), "file", "left_semi").select("id")
    refs = ix.refs.join(at("file"), "file", "left_anti")
    for c in ("caller_id", "target_id"):
        refs = refs.join(ids.select(F.col("id").alias(c), F.lit(True).alias("__gone")), c, "left").withColumn(c, F.when(F.col("__gone").isNull(), F.col(c))).drop("__gone")
    edges = ix.type_edges
    for c in ("child_id", "parent_id"):
        edges = edges.join(ids.select(F.col("id").alias(c)), c, "left_anti")
    vectors = ix.embeddings.join(ids.select(F.col("id").alias("symbol_id")), "symbol_id", "left_anti") if ix.embeddings is not None else None
    return Index(ix.files.join(gone, "path", "left_anti"), ix.symbols.join(at("file"), "file", "left_anti"), refs.select(*ix.refs.columns), ix.imports.join(at("source_file"), "source_file", "left_anti"), edges.select(*ix.type_edges.columns), vectors)


def updated(ix: Index, files: DataFrame) -> Index:
    """The index after some files were written: unchanged hashes are skipped, the rest replaced and all names resolved anew."""
    hashed = files.withColumn("hash", F.md5("content"))
    changed = hashed.join(ix.files.select("path", "hash"), ["path", "hash"], "left_anti").drop("hash")
    old, new = without(ix, changed), index(changed)
    symbols = old.symbols.unionByName(new.symbols)
    imports = old.imports.unionByName(new.imports)
    refs = resolve.targets(old.refs.unionByName(new.refs), symbols).select(*ix.refs.columns)
    return Index(old.files.unionByName(new.files), symbols, refs, imports, old.type_edges.unionByName(new.type_edges).distinct(), old.embeddings)


def reconcile(ix: Index, files: DataFrame) -> Index:
    """The index brought in line with all files on disk: missing ones go, changed ones are replaced."""
    return updated(without(ix, ix.files.join(files.select("path"), "path", "left_anti")), files)


def marked_stale(embeddings: DataFrame, paths: DataFrame) -> DataFrame:
    hit = paths.select(F.col("path").alias("file")).distinct().withColumn("__hit", F.lit(True))
    return embeddings.join(hit, "file", "left").withColumn("stale", F.col("stale") | F.coalesce("__hit", F.lit(False))).select(*embeddings.columns)


def stored(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors after storing ``new`` (symbol_id, file, vector): normalised, fresh, one a symbol."""
    from ..operators.vectors import normalized

    fresh = new.select("symbol_id", "file", normalized("vector").cast("array<float>").alias("vector"), F.lit(False).alias("stale")).dropDuplicates(["symbol_id"])
    return embeddings.join(fresh.select("symbol_id"), "symbol_id", "left_anti").select(*fresh.columns).unionByName(fresh)


def missing(ix: Index) -> DataFrame:
    """Symbols without a fresh vector."""
    have = ix.embeddings.filter("NOT stale").select(F.col("symbol_id").alias("id")) if ix.embeddings is not None else None
    return ix.symbols if have is None else ix.symbols.join(have, "id", "left_anti")


def chunks(symbols: DataFrame, imports: DataFrame, files: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """(symbol_id, file, chunk): what an embedding model is shown of each symbol, at most ``most`` bytes, cut at a line."""
    head = imports.groupBy(F.col("source_file").alias("file")).agg(F.array_join(F.sort_array(F.collect_set("import_path")), ", ").alias("imports"))
    text = files.select(F.col("path").alias("file"), F.split("content", "\n").alias("all"))
    joined = symbols.join(text, "file").join(head, "file", "left")
    code = F.array_join(F.slice("all", F.col("line").cast("int"), (F.coalesce("end_line", "line") - F.col("line") + 1).cast("int")), "\n")
    header = F.concat(F.lit("File: "), "file", F.lit("\n"), F.coalesce(F.concat(F.lit("Scope: "), "scope", F.lit("\n")), F.lit("")), F.coalesce(F.concat(F.lit("Imports: "), "imports", F.lit("\n")), F.lit("")), F.lit("---\n"))
    return joined.select(F.col("id").alias("symbol_id"), "file", cut_bytes(header, code, most).alias("chunk"))


def cut_bytes(header, code, most: int):
    """Header and as many whole lines of code as fit; a first line that is too long is cut."""

    @F.pandas_udf("string")
    def cut(h: pd.Series, c: pd.Series) -> pd.Series:
        def one(h, c):
            room = max(0, most - len(h.encode()))
            raw = c.encode()
            if len(raw) <= room:
                return h + c
            at = raw.rfind(b"\n", 0, room)
            return h + raw[: at + 1 if at >= 0 else room].decode("utf-8", "ignore")

        return pd.Series([one(a, b) for a, b in zip(h, c)])

    return cut(header, code)


def reembedded(ix: Index, files: DataFrame, changed: DataFrame, embed, healthy=lambda: True) -> DataFrame:
    """Vectors after some files changed (``changed``: path). Where the model server is down, those of the files' symbols
    are marked stale; else they go, and the files' symbols are embedded anew, one that fails left out."""
    if not healthy():
        return marked_stale(ix.embeddings, changed)
    paths = changed.select(F.col("path").alias("file")).distinct()
    kept = ix.embeddings.join(paths, "file", "left_anti").select(*ix.embeddings.columns)
    own = chunks(ix.symbols.join(paths, "file", "left_semi"), ix.imports, files)
    return stored(kept, embedded(own, embed, partial=True))


def embedded(chunk: DataFrame, embed, size: int = 50, partial: bool = False) -> DataFrame:
    """(symbol_id, file, vector) by ``embed`` (texts -> vectors), ``size`` texts at a time.

    A batch that is too long for the model (``OverflowError``, or an error that speaks of a context length or of
    too many tokens; any error where ``partial``) is tried text by text; a text that fails alone is left out. A
    batch that answers with another number of vectors ends the job, unless ``partial``."""

    def passed(error: Exception) -> bool:
        said = str(error).lower()
        return partial or isinstance(error, OverflowError) or "context length" in said or "too many tokens" in said

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), size):
                part = pdf.iloc[lo : lo + size]
                try:
                    vectors = embed(list(part["chunk"]))
                    if len(vectors) != len(part):
                        raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                except Exception as error:  # noqa: BLE001
                    if not passed(error):
                        raise
                    vectors = []
                    for t in part["chunk"]:
                        try:
                            vectors.append(embed([t])[0])
                        except Exception as alone:  # noqa: BLE001
                            if not passed(alone):
                                raise
                            vectors.append(None)
                ok = [v is not None for v in vectors]
                yield pd.DataFrame({"symbol_id": part["symbol_id"][ok], "file": part["file"][ok], "vector": [list(map(float, v)) for v in vectors if v is not None]})

    return chunk.select("symbol_id", "file", "chunk").mapInPandas(run, "symbol_id long, file string, vector array<double>")
