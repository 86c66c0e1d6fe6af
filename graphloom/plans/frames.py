"""Helpers on DataFrames that several operators need."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A symbol takes some 6 bytes in a file, which repeats few values, and 80 to 200 in a broadcast; Spark's size check
#: goes by files. So a table that grows with the input is not sent through the driver; small sides still are, as they run.
PACKED = 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def sized(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.sources.fileCompressionFactor", PACKED)
    return spark


def unsent(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: neither it nor the other side goes through the driver, however small
    its file or its exchange seems and however high the session's threshold is."""
    return df.hint("merge")


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it has none, a new folder on a single machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that lineage ends there. What the write has shuffled goes
    with it, rather than when the driver next collects its garbage."""
    conf, path = df.sparkSession.conf, f"{shared_dir(df.sparkSession)}/graphloom/{name}-{uuid.uuid4().hex}"
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/graphloom/" in f}:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """``df`` with the rows' numbers from 1 by a total order. Ranges of the order are numbered apart and written;
    only the ranges' sizes, a row each, meet in one place."""
    sorted_ = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    out = sorted_.withColumn("__part", part).join(F.broadcast(before), "__part")  # a row a partition
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__before")


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row of each key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
