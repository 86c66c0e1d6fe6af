"""Search results: categories, order, folding of re-exports, groups, and fusion of two ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..index import Index
from ..plans.frames import numbered

#: Category -> tier and heading.
TIERS = {"definition": 0, "call_site": 1, "import": 2, "other": 3, "comment": 4, "test": 5}
HEADINGS = {"definition": "definitions", "call_site": "usages", "other": "usages", "import": "imports", "comment": "comments", "test": "tests"}


def classify(hits: DataFrame, ix: Index | None = None) -> DataFrame:
    """``hits`` (file, line, content) with ``category`` and ``tier``. Places that the index knows are joined by
    (file, line); Spark broadcasts the smaller side where its size allows."""
    out = hits
    for flag, table in (("__def", ix.symbols if ix else None), ("__ref", ix.refs if ix else None)):
        out = out.withColumn(flag, F.lit(None).cast("boolean")) if table is None else out.join(table.select("file", "line").distinct().withColumn(flag, F.lit(True)), ["file", "line"], "left")
    category = (
        F.when(X.is_test("file"), "test").when(F.col("__def"), "definition").when(X.is_import_line("content"), "import")
        .when(X.is_comment_line("content"), "comment").when(F.col("__ref"), "call_site").otherwise("other")
    )
    tiers = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    return out.withColumn("category", category).withColumn("tier", F.element_at(tiers, F.col("category"))).drop("__def", "__ref")


def rank(classified: DataFrame) -> DataFrame:
    return classified.orderBy("tier", "file", "line", "content")


def fold_reexports(classified: DataFrame) -> DataFrame:
    """Where both definitions and imports were found, imports go and each definition says how many there were."""
    counts = classified.agg(F.count_if(F.col("category") == "definition").alias("__defs"), F.count_if(F.col("category") == "import").alias("__imports"))
    out = classified.crossJoin(F.broadcast(counts))  # one row
    both = (F.col("__defs") > 0) & (F.col("__imports") > 0)
    label = F.format_string("(+%d other location%s)", "__imports", F.when(F.col("__imports") == 1, "").otherwise("s"))
    out = out.filter(~(both & (F.col("category") == "import")))
    return out.withColumn("annotation", F.when(both & (F.col("category") == "definition"), label)).drop("__defs", "__imports")


def grouped(ranked: DataFrame) -> DataFrame:
    """A row for each category in tier order: heading, number of hits, first and last place."""
    place = F.struct("file", "line")
    heading = F.element_at(F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv]), F.col("category"))
    return (
        ranked.groupBy("tier", "category").agg(F.count("*").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi"))
        .select("tier", "category", heading.alias("heading"), "n", F.col("lo.file").alias("first_file"), F.col("hi.file").alias("last_file")).orderBy("tier")
    )


def search(text: DataFrame, ix: Index, pattern: str, regex: bool = False, ignore_case: bool = False) -> DataFrame:
    """Grep, classify, rank, fold."""
    return rank(fold_reexports(classify(X.grep(text, pattern, regex, ignore_case), ix)))


def fuse(structural: DataFrame, semantic: DataFrame, k: float = 60) -> DataFrame:
    """Reciprocal rank fusion of two lists with ``rank`` (1-based), ``file``, ``line`` and ``content``.

    A place scores 1/(k+rank) for each row of either list; its content is the structural one where
    there is one. Equal scores are ordered by place."""
    a = structural.select("file", "line", "rank", "content", F.lit(0).alias("list"), F.lit(None).cast("string").alias("annotation"))
    b = semantic.select("file", "line", "rank", F.format_string("%s (%s)", "name", "kind").alias("content"), F.lit(1).alias("list"), F.format_string("[semantic: %.2f]", "score").alias("annotation"))
    first = F.min(F.struct("list", "rank", "content", "annotation"))
    out = a.unionByName(b).groupBy("file", "line").agg(F.sum(1 / (F.col("rank") + k)).alias("score"), F.count("*").alias("n"), first.alias("f"))
    source = F.when(F.col("n") > 1, "both").when(F.col("f.list") == 0, "structural").otherwise("semantic")
    return out.select("file", "line", F.col("f.content").alias("content"), "score", source.alias("source"), F.col("f.annotation").alias("annotation")).orderBy(F.desc("score"), "file", "line")


def ranked_rows(df: DataFrame, *order) -> DataFrame:
    """``rank`` by a total order, over ranges of it."""
    return numbered(df, *order, name="rank")
