"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import discard, stash


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (u, root): ``root`` is the least node of u's component; roots themselves have no row.

    Each round connects every node's larger neighbours to its least one (large star), then every
    node and its smaller neighbours to the least of them (small star). Rounds grow with the
    logarithm of a component's size. Minima are aggregated before the exchange and a node with
    very many neighbours only meets one row in a join, which Spark can split. Each round is
    written to the shared folder and read again; nothing is collected but two sums.
    """
    now = stash(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The join has one key more than the aggregation. So neither side comes as the aggregation left it: both are
        # plain exchanges, which Spark can split where a node has very many neighbours.
        salt = F.pmod(F.xxhash64("v"), F.lit(2)).cast("int").alias("salt")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.explode(F.array(F.lit(0), F.lit(1))).alias("salt"))
        large = both.filter("v > u").select("u", "v", salt).join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is its own least neighbour keeps its edges; the others pass theirs on
        large = large.filter("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_min.select("u", F.col("m").alias("v")))
        new = stash(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        new_mark = _mark(new)
        discard(now)
        now = new
        if new_mark == mark:
            break
        mark = new_mark
    return now.select("u", F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Rows and a checksum: equal marks mean that a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
