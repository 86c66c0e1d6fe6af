"""The driver's tables seen as an index: parts are symbols, line items are references, documents are text.

A line item of up to four pieces is a call from the part before it in its order; the others name their part as
a type, outside any symbol, as type references have no caller. A file imports the files that it calls into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import stem
from ..index import Index
from .frames import sized, unsent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sized(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _file(key: str, size: str):
    return F.concat(F.lit("src/m"), F.col(size) % 10, F.lit("/f"), F.col(key) % 97, F.when(F.col(key) % 11 == 0, "_test").otherwise(""), F.lit(".rs"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = (
        F.when(F.col("p_type").isin("STANDARD", "PROMO"), "function").when(F.col("p_type") == "ECONOMY", "method").when(F.col("p_type") == "MEDIUM", "class")
        .when(F.col("p_type") == "SMALL", "struct").otherwise("interface")
    )
    line = (F.col("p_partkey") % 400 + 1).cast("long")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.substring("p_brand", 7, 10)).alias("name"),
        kind.alias("kind"),
        _file("p_partkey", "p_size").alias("file"),
        line.alias("line"),
        F.lit(0).cast("long").alias("col"),
        (line + F.col("p_size")).cast("long").alias("end_line"),
        F.when(F.col("p_type") == "ECONOMY", F.col("p_brand")).alias("scope"),
        F.concat_ws(" ", "p_name", "p_type").alias("signature"),
        F.when(F.col("p_partkey") % 3 == 0, "rust").when(F.col("p_partkey") % 3 == 1, "python").otherwise("go").alias("language"),
        F.lit(None).cast("string").alias("doc_comment"),
    )


def refs(spark: SparkSession, sf_dir: str, syms: DataFrame) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    calls = table(spark, sf_dir, "lineitem").withColumn("before", F.lag("l_partkey").over(order))
    conf = F.when(F.col("l_discount") < 0.025, 0.95).when(F.col("l_discount") < 0.055, 0.85).when(F.col("l_discount") < 0.075, 0.8).otherwise(0.5)
    target = syms.select(F.col("id").alias("l_partkey"), "name")
    # grouped, so that Spark knows a row a key, and drops the join and the window where a query reads no file or caller
    caller = table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("before")).agg(F.min("p_size").alias("caller_size"))
    called = F.col("l_quantity") <= 4
    return calls.join(unsent(target), "l_partkey").join(unsent(caller), "before", "left").select(
        "name", F.coalesce(_file("before", "caller_size"), F.lit("src/main.rs")).alias("file"), F.col("l_linenumber").cast("long").alias("line"), F.lit(0).cast("long").alias("col"),
        F.concat(F.when(called, "call ").otherwise("type "), "name").alias("context"), F.when(called, F.col("before")).alias("caller_id"), conf.alias("confidence"), F.col("l_partkey").alias("target_id"), called.alias("called"),
    )


#: Indexes that a caller has built and saved before (the bench does), by folder of the tables.
SAVED: dict[str, Index] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    if sf_dir in SAVED:
        return SAVED[sf_dir]
    syms = symbols(spark, sf_dir)
    calls = refs(spark, sf_dir, syms)
    targets = syms.select(F.col("id").alias("target_id"), stem("file").alias("to"))
    imports = calls.filter("called").join(unsent(targets), "target_id").select(F.col("file").alias("source_file"), F.concat(F.lit("./"), "to").alias("import_path")).distinct()
    edges = syms.filter(F.col("kind").isin("class", "struct", "interface")).select(F.col("id").alias("child_id"), F.floor(F.col("id") / 3).cast("long").alias("parent_id"), F.when(F.col("id") % 2 == 0, "extends").otherwise("implements").alias("relationship"))
    files = syms.groupBy(F.col("file").alias("path")).agg(F.min("language").alias("language"), F.max("end_line").alias("line_count"), F.count("*").alias("symbols_count"))
    files = files.select("path", "language", F.md5("path").alias("hash"), F.lit(0).cast("long").alias("last_indexed"), "line_count", "symbols_count")
    vectors = table(spark, sf_dir, "embeddings").join(syms.select(F.col("id").alias("vec_id"), "file"), "vec_id", "left").select(F.col("vec_id").alias("symbol_id"), "file", F.col("embedding").alias("vector"), (F.col("vec_id") % 10 == 9).alias("stale"))
    return Index(files, syms, calls.drop("called"), imports, edges, vectors)


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import lines

    docs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), F.col("text").alias("content"))
    return lines(docs)


def code_lines(ix: Index) -> DataFrame:
    """Source lines made of the index: definitions, comments, calls and imports."""
    defs = ix.symbols.select("file", "line", F.concat(F.lit("fn "), "name").alias("content"))
    calls = ix.refs.select("file", (F.col("line") + 500).alias("line"), F.concat(F.lit("    "), "name", F.lit("();")).alias("content"))
    uses = ix.refs.filter("caller_id IS NULL").select("file", (F.col("line") + 900).alias("line"), F.concat(F.lit("use crate::"), "name", F.lit(";")).alias("content"))
    notes = ix.symbols.select("file", (F.col("line") + 1300).alias("line"), F.concat(F.lit("// see "), "name").alias("content"))
    return defs.unionByName(calls).unionByName(uses).unionByName(notes).distinct()
