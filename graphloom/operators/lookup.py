"""Point and substring lookups. Every result has a total order of its own; ties end at the symbol's place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..index import Index

CONTAINERS = ("class", "struct", "enum", "trait", "interface")
CALLABLE = ("function", "method")
#: Kinds that the index knows; others read as function.
KINDS = ("function", "method", "class", "struct", "enum", "trait", "interface", "module", "constant", "variable", "type")


#: The order in which an index lists symbols: by place; ids are hashes and only tell equal places apart.
PLACE = ("file", "line", "col", "id")


def known_kind(kind="kind"):
    return F.when(X.col(kind).isin(*KINDS), X.col(kind)).otherwise("function")


def symbols(ix: Index, name: str, kind: str | None = None, file: str | None = None, scope: str | None = None, exact: bool = False, limit: int | None = None) -> DataFrame:
    """Symbols by name; an inexact name and the file are patterns whose _ and % are wildcards. Tests come last."""
    out = ix.symbols.filter(F.col("name") == name if exact else X.like_ci("name", f"%{name}%"))
    if kind:
        out = out.filter(F.col("kind") == kind)
    if file:
        out = out.filter(X.like_ci("file", f"%{file}%"))
    if scope:
        out = out.filter(F.col("scope") == scope)
    out = out.withColumn("kind", known_kind()).orderBy(X.is_test_lookup("file"), *PLACE)
    return out.limit(limit) if limit else out


def references(ix: Index, name: str, paths: list[str] | None = None) -> DataFrame:
    """References to exactly this name, with the caller's name."""
    callers = ix.symbols.select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"))
    out = ix.refs.filter(F.col("name") == name).join(callers, "caller_id", "left")
    if paths:
        out = out.filter(_under(paths))
    return out.select("name", F.lit("call").alias("kind"), "file", "line", "col", F.coalesce("context", F.lit("")).alias("context"), "caller_name", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def _under(paths: list[str]):
    out = F.lit(False)
    for p in paths:
        out = out | F.col("file").startswith(p)
    return out


def subclasses(ix: Index, parent: str) -> DataFrame:
    """Symbols that extend or implement one whose name matches the pattern."""
    up = ix.symbols.filter(X.like_ci("name", f"%{parent}%")).select(F.col("id").alias("parent_id"))
    child = ix.symbols.select(F.col("id").alias("child_id"), "id", "name", "kind", "file", "line", "signature")
    return ix.type_edges.join(up, "parent_id").join(child, "child_id").select("id", "name", "kind", "file", "line", "signature").orderBy("file", "line", "id")


def references_and_subclasses(ix: Index, name: str, paths: list[str] | None = None) -> DataFrame:
    """Subclass rows, certain, beside the references."""
    sub = subclasses(ix, name).select("name", F.lit("subclass").alias("kind"), "file", "line", F.lit(0).cast("long").alias("col"), F.col("signature").alias("context"), F.lit(None).cast("string").alias("caller_name"), F.lit(1.0).alias("confidence"))
    if paths:
        sub = sub.filter(_under(paths))
    return sub.unionByName(references(ix, name, paths))


def reference_files(ix: Index, name: str, paths: list[str] | None = None) -> DataFrame:
    return references_and_subclasses(ix, name, paths).select("file").distinct().orderBy("file")


def signatures(ix: Index, name: str) -> DataFrame:
    return ix.symbols.filter(X.like_ci("name", f"%{name}%") & F.col("kind").isin(*CALLABLE)).orderBy(*PLACE).select("id", "name", "kind", "file", "line", "signature")


def file_symbols(ix: Index, file: str) -> DataFrame:
    return ix.symbols.filter(F.col("file") == file).select("id", "name", "kind", "line", "scope", "signature").orderBy("line", "id")


def deps(ix: Index, file: str) -> DataFrame:
    return ix.imports.filter(F.col("source_file") == file).select("import_path").distinct().orderBy("import_path")


def rdeps(ix: Index, file: str) -> DataFrame:
    """Files with an import that ends in this file's stem (as a pattern)."""
    name = file.rpartition("/")[2]
    stem = name[: name.rfind(".")] if "." in name[1:] else name
    return ix.imports.filter(X.like_ci("import_path", f"%{stem}") & (F.col("source_file") != file)).select("source_file").distinct().orderBy("source_file")


def show_symbol(ix: Index, name: str, exact: bool = False, kind: str | None = None, file: str | None = None, scope: str | None = None) -> DataFrame:
    """Symbols to display: exact names first, tests last; the name is literal here."""
    out = ix.symbols.filter(F.col("name") == name if exact else X.contains_ci("name", name))
    if kind:
        out = out.filter(F.col("kind") == kind)
    if file:
        out = out.filter(X.contains_ci("file", file))
    if scope:
        out = out.filter(F.col("scope") == scope)
    return out.select("id", "name", "kind", "file", "line", "end_line", "scope", "signature").orderBy(F.col("name") != name, X.is_test_shown("file"), "file", "line", "id")


def show_file(ix: Index, path: str) -> DataFrame:
    """Top-level symbols of a file, or of all files below a path that ends in /."""
    at = F.lower("file").startswith(path.lower()) if path.endswith("/") else F.lower("file") == path.lower()
    return ix.symbols.filter(at & F.col("scope").isNull()).select("id", "name", "kind", "file", "line", "end_line", "signature").orderBy("file", "line", "id")


def bodies(shown: DataFrame, ix: Index, contents: DataFrame, mode: str = "full", most: int = 80) -> DataFrame:
    """``shown`` with ``body``: its signature, a container's first line and its children's (``shallow``), or the
    source, cut to ``most`` lines with a marker. A long container is shown shallow."""
    if mode == "signatures":
        return shown.withColumn("body", F.col("signature"))
    first = lambda c: F.element_at(F.split(c, "\n"), 1)
    text = contents.select(F.col("path").alias("file"), F.split("content", "\n").alias("all"))
    out = shown.join(text, "file", "left")
    own = F.slice("all", F.col("line").cast("int"), (F.coalesce("end_line", "line") - F.col("line") + 1).cast("int"))
    kids = ix.symbols.filter("scope IS NOT NULL").groupBy(F.col("scope").alias("k_scope"), F.col("file").alias("k_file")).agg(F.array_sort(F.collect_list(F.struct("line", "id", "signature"))).alias("kids"))
    out = out.join(kids, (F.col("name") == F.col("k_scope")) & (F.col("file") == F.col("k_file")), "left")
    children = F.transform(F.coalesce("kids", F.array().cast("array<struct<line:bigint,id:bigint,signature:string>>")), lambda k: F.concat(F.lit("    "), first(k["signature"])))
    shallow = F.array_join(F.concat(F.array(first(F.col("signature"))), children), "\n")
    cut = F.when(F.size(own) > most, F.concat(F.array_join(F.slice(own, 1, most), "\n"), F.format_string("\n... (%d more lines)", F.size(own) - most))).otherwise(F.array_join(own, "\n"))
    is_container = F.col("kind").isin(*CONTAINERS)
    body = F.when(is_container & (F.lit(mode == "shallow") | (F.size(own) > most)), shallow).when(F.lit(mode == "shallow"), first(F.col("signature"))).otherwise(cut)
    return out.withColumn("body", body).select(*shown.columns, "body")


def near_names(ix: Index, name: str, k: int = 5) -> DataFrame:
    """Distinct names that match the pattern, shortest first."""
    return ix.symbols.filter(X.like_ci("name", f"%{name}%")).select("name").distinct().orderBy(F.length("name"), "name").limit(k)


def phrase_count(ix: Index, phrase: str) -> DataFrame:
    return ix.symbols.agg(F.count_if(X.has_phrase("name", phrase)).alias("n"))


def search_mode(ix: Index, phrase: str, raw: bool = False, smart: bool = False) -> str:
    """plain, or ranked where asked for or where the index knows the phrase."""
    if raw:
        return "plain"
    return "smart" if smart or phrase_count(ix, phrase).first()[0] else "plain"


def has_file(ix: Index, path: str) -> bool:
    return not ix.files.filter(F.col("path") == path).isEmpty()


def scope_file(ix: Index, name: str, scope: str) -> str | None:
    """File of the first symbol of this name in this scope."""
    row = ix.symbols.filter((F.col("name") == name) & (F.col("scope") == scope)).orderBy(*PLACE).select("file").first()
    return row and row[0]


def symbol_ids(ix: Index, name: str, file: str | None = None, scope: str | None = None) -> DataFrame:
    out = ix.symbols.filter(F.col("name") == name)
    if file:
        out = out.filter(X.contains_ci("file", file))
    if scope:
        out = out.filter(F.col("scope") == scope)
    return out.select("id")


def has_call_graph(ix: Index) -> bool:
    return not ix.refs.filter("caller_id IS NOT NULL").isEmpty()


def with_source(found: DataFrame, text: DataFrame, around: int = 1) -> DataFrame:
    """``found`` (file, line, …) with ``context``: numbered source lines around each row."""
    from pyspark.sql.window import Window

    near = F.explode(F.sequence(F.col("line") - around, F.col("line") + around))
    keyed = found.withColumn("__id", F.row_number().over(Window.partitionBy("file", "line").orderBy(*[c for c in found.columns if c not in ("file", "line")])))
    source = text.select("file", F.col("line").alias("__at"), F.format_string("%d: %s", "line", "content").alias("__text"))
    got = keyed.select("file", "line", "__id", near.alias("__at")).join(source, ["file", "__at"]).groupBy("file", "line", "__id").agg(F.array_sort(F.collect_list(F.struct("__at", "__text"))).alias("__all"))
    return keyed.join(got, ["file", "line", "__id"], "left").withColumn("context", F.array_join(F.col("__all.__text"), "\n")).select(*[c for c in found.columns if c != "context"], "context")


# --- without an index: the same questions put to the text ---------------------

#: Words that introduce a definition, by kind.
DEFINING = {
    "function": "fn|def|function|func", "method": "fn|def|function|func", "class": "class", "struct": "struct", "interface": "interface", "enum": "enum", "trait": "trait",
    "type_alias": "type|delegate", "constant": "const", "variable": "let|var|val", "module": "module|mod",
}
ANY_DEFINING = "fn|def|function|func|class|struct|enum|trait|interface|module|type|const|let|var|val|delegate"
IMPORTING = "import|from|require|use|using|include"


def _literal(name: str) -> str:
    import re

    return re.sub(r"([^\w])", r"\\\1", name)


def grep_symbols(text: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    return X.grep(text, rf"(?:{DEFINING.get(kind, ANY_DEFINING)})\s+{_literal(name)}\b", regex=True)


def grep_references(text: DataFrame, name: str) -> DataFrame:
    return X.grep(text, rf"\b{_literal(name)}\b", regex=True).withColumn("confidence", F.lit(0.5))


def grep_signatures(text: DataFrame, name: str) -> DataFrame:
    return X.grep(text, rf"(?:{DEFINING['function']})\s+{_literal(name)}\s*\(", regex=True)


def grep_file_symbols(text: DataFrame, file: str) -> DataFrame:
    pattern = rf"\b(?:{ANY_DEFINING})\s+(\w+)"
    return X.grep(text.filter(F.col("file") == file), pattern, regex=True).withColumn("name", F.regexp_extract("content", pattern, 1))


def grep_deps(text: DataFrame, file: str) -> DataFrame:
    return X.grep(text.filter(F.col("file") == file), rf"\b(?:{IMPORTING})\s+", regex=True)


def grep_rdeps(text: DataFrame, stem: str) -> DataFrame:
    return X.grep(text, rf"(?:{IMPORTING})\s+.*{_literal(stem)}", regex=True)
