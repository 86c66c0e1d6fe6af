"""File events: debouncing, and an index state that follows them.

An event is (path, op, ts, hash). A burst of events of one path is one change, that of its last
event. Batches are applied as a whole: of a path's events the last counts, unchanged hashes are
skipped, deletions remove; events without a path, a time or a known op are set aside and do not
hold up the rest.

All that a follower knows lies in one folder of the shared storage: the stream's checkpoint, the
state after each batch, the paths that the batch changed, and a status row. A state's version is
its batch's number, and it counts once it is whole. So a driver that starts again goes on from the
state that belongs to the offsets in the checkpoint, and a batch that runs again does no harm. A
second stream reads the changed paths and does what takes longer, such as embedding, on its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.frames import first_per, shared_dir

OPS = ("created", "modified", "deleted")
STATE = "path string, op string, ts timestamp, hash string"


def classified(events: DataFrame, existing: DataFrame) -> DataFrame:
    """Op of each event by whether its path exists now: modified or deleted."""
    return events.join(existing.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").withColumn("op", F.when(F.col("there"), "modified").otherwise("deleted")).drop("there")


def debounced(events: DataFrame, gap: str = "6 hours", order: str = "event_id") -> DataFrame:
    """(path, first, last, events, op) of each burst: events of a path no further apart than ``gap``."""
    w = Window.partitionBy("path").orderBy("ts", order)
    new = F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.expr(f"INTERVAL {gap}"), F.lit(True))
    burst = events.withColumn("burst", F.sum(new.cast("long")).over(w))
    return burst.groupBy("path", "burst").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events"), F.max_by("op", F.struct("ts", order)).alias("op")).drop("burst")


def debounced_stream(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """The same on a stream with event time: session windows that close ``late`` after their gap."""
    return events.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap)).agg(F.count("*").alias("events"), F.max_by("op", F.struct("ts", "event_id")).alias("op")).select("path", F.col("session_window.start").alias("first"), "events", "op")


def latest(events: DataFrame, order: str = "event_id") -> DataFrame:
    return first_per(events, ["path"], F.desc("ts"), F.desc(order))


def applied(state: DataFrame, batch: DataFrame, order: str = "event_id") -> DataFrame:
    """State after a batch: the last event of each path, deleted paths gone, unchanged ones as they were."""
    last = latest(batch, order)
    same = last.filter("op <> 'deleted'").join(state.select("path", "hash"), ["path", "hash"], "left_semi").select("path")
    change = last.join(same, "path", "left_anti")
    kept = state.join(change.select("path"), "path", "left_anti")
    return kept.unionByName(change.filter("op <> 'deleted'").select("path", "op", "ts", "hash"))


class Follower:
    """Applies micro-batches to a state table below ``folder`` (default: a new one)."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_dir(spark)}/graphloom/stream-{uuid.uuid4().hex}"

    def _versions(self) -> list[int]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state/*/_SUCCESS")
        found = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(int(s.getPath().getParent().getName()) for s in found or ())

    def _read(self, version: int | None) -> DataFrame:
        return self.spark.createDataFrame([], STATE) if version is None else self.spark.read.schema(STATE).parquet(f"{self.folder}/state/{version}")

    @property
    def state(self) -> DataFrame:
        return self._read(max(self._versions(), default=None))

    @property
    def status(self) -> DataFrame:
        """A row a batch: its number, files in the state, changed files, events set aside."""
        return self.spark.read.schema("batch long, files long, updated long, rejected long").parquet(f"{self.folder}/status/*")

    @property
    def batches(self) -> int:
        return self.status.count()

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number in (versions := self._versions()):
            return
        before = self._read(max((v for v in versions if v < number), default=None))
        sound = F.col("path").isNotNull() & F.col("ts").isNotNull() & F.coalesce(F.col("op").isin(*OPS), F.lit(False))
        batch = batch.persist()
        after = applied(before, batch.filter(sound))
        # the paths first: a batch that breaks off behind them runs again and finds the same ones
        changed = differing(before, after)
        changed.write.mode("overwrite").parquet(f"{self.folder}/changed/{number}")
        batch.filter(~sound).write.mode("overwrite").parquet(f"{self.folder}/rejected/{number}")
        after.write.mode("overwrite").parquet(f"{self.folder}/state/{number}")
        row = (number, self._read(number).count(), self.spark.read.parquet(f"{self.folder}/changed/{number}").count(), batch.filter(~sound).count())
        self.spark.createDataFrame([row], "batch long, files long, updated long, rejected long").write.mode("overwrite").parquet(f"{self.folder}/status/{number}")
        batch.unpersist()
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for old in versions[:-1]:  # the state before this one stays for its readers
            where(f"{self.folder}/state/{old}").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where(f"{self.folder}/state/{old}"), True)

    def run(self, stream: DataFrame, **trigger) -> DataFrame:
        """Take everything that is there, then stop; returns the state. With ``processingTime="500 milliseconds"`` the query
        runs on, in batches of that length, and is returned itself."""
        writer = stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.folder}/checkpoint")
        query = writer.trigger(**(trigger or {"availableNow": True})).start()
        if trigger:
            return query
        query.awaitTermination()
        return self.state

    def second_stage(self, work, **trigger):
        """A stream of its own over the changed paths: ``work`` (paths and ops, batch number) follows each batch of them."""
        changed = self.spark.readStream.schema("path string, op string").option("recursiveFileLookup", "true").parquet(f"{self.folder}/changed")
        query = changed.writeStream.foreachBatch(work).option("checkpointLocation", f"{self.folder}/second").trigger(**(trigger or {"availableNow": True})).start()
        if not trigger:
            query.awaitTermination()
        return query


def differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, op) of what a batch changed: deleted, created or modified."""
    a, b = before.select("path", F.col("hash").alias("old"), F.lit(True).alias("was")), after.select("path", F.col("hash").alias("new"), F.lit(True).alias("is"))
    op = F.when(F.col("is").isNull(), "deleted").when(F.col("was").isNull(), "created").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return a.join(b, "path", "full_outer").select("path", op.alias("op")).filter("op IS NOT NULL")


def reconciled(indexed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(path, action) that bring an index of (path, hash) up to date with what is on disk."""
    a, b = indexed.select("path", F.col("hash").alias("old")), on_disk.select("path", F.col("hash").alias("new"))
    both = a.join(b, "path", "full_outer")
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "add").when(F.col("old") != F.col("new"), "update").otherwise("keep")
    return both.select("path", action.alias("action")).orderBy("path")


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as file events."""
    return as_file_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_file_events(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return events.select(F.concat(F.lit("src/f"), "user_id", F.lit(".rs")).alias("path"), op.alias("op"), F.col("ts").cast("timestamp").alias("ts"), F.md5("props").alias("hash"), "event_id")


def file_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return as_file_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*"))
