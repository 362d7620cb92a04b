"""Keyed job tracking as streams: counts, latest update, joins of updates, fan-out and watching.

A stream runs with ``availableNow`` and an exactly-once file sink or a complete-mode overwrite under
the shared folder; the result is what a late subscriber would be replayed.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from rallylake.sources.scratch import scratch

TERMINAL = ("purchase", "error")


def updates(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """The update log as a stream of files; timestamps without a zone become UTC instants."""
    schema = spark.read.parquet(path).schema
    # a pattern that matches the path alone: a stream's plain path would have to be a folder
    pattern = f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "complete", target: str = "", log: str = "") -> DataFrame:
    """Run a stream over all that is there and return what its sink holds.

    Complete mode overwrites the sink with each batch; append mode adds to it. A later run with the
    same ``target`` and ``log`` goes on where the one before ended.
    """
    spark = stream.sparkSession
    target, log = target or scratch(spark, name), log or scratch(spark, f"{name}-log")

    def put(batch: DataFrame, batch_id: int) -> None:
        # a repeated batch overwrites its own folder, so a replay adds nothing
        batch.write.mode("overwrite").parquet(target if mode == "complete" else f"{target}/batch={batch_id}")

    run = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", log).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target).select(*stream.columns)


def counts(stream: DataFrame, key: str = "user_id") -> DataFrame:
    return stream.groupBy(key).agg(F.count("*").alias("updates"))


def latest(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """The last update of each key by time and id: what is replayed to a late subscriber."""
    return stream.groupBy(key).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


def matched(stream: DataFrame, first: str = "signup", then: str = "purchase", within: str = "24 hours", early: str = "3 seconds", delay: str = "10 minutes") -> DataFrame:
    """(first_id, then_id): updates ``then`` with the updates ``first`` of their key that came up to ``within``
    before, or up to ``early`` after them, as payments and checkouts do. A stream join: each side waits for the
    other as long as the watermark says that it still may come.
    """
    side = lambda kind, name: stream.where(F.col("event_type") == kind).select(F.col("user_id").alias(f"{name}_user"), F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts")).withWatermark(f"{name}_ts", delay)
    near = F.expr(f"first_user = then_user AND first_ts >= then_ts - INTERVAL {within} AND first_ts <= then_ts + INTERVAL {early}")
    return side(first, "first").join(side(then, "then"), near).select("first_id", "then_id")


def fan_out(stream: DataFrame, listeners: dict[str, Callable[[DataFrame], DataFrame]], name: str) -> DataFrame:
    """(listener, batch, rows, error): each batch is given to every listener, whose result is written to a folder
    of its own; a listener that fails is noted and keeps none of the others from the batch."""
    spark, target, log = stream.sparkSession, scratch(stream.sparkSession, name), scratch(stream.sparkSession, f"{name}-log")

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        told = []
        for who, listen in listeners.items():
            try:
                out = listen(batch)
                path = f"{target}/{who}/batch={batch_id}"
                out.write.mode("overwrite").parquet(path)
                told.append((who, batch_id, spark.read.schema(out.schema).parquet(path).count(), None))
            except Exception as e:  # noqa: BLE001  whatever a listener raises is its own
                told.append((who, batch_id, 0, type(e).__name__))
        batch.unpersist()
        spark.createDataFrame(told, "listener string, batch long, rows long, error string").write.mode("overwrite").parquet(f"{target}/told/batch={batch_id}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("listener string, batch long, rows long, error string").parquet(f"{target}/told")


class Watch(StreamingQueryListener):
    """Hears of a query's batches: when the last one with rows came, and when one ended."""

    def __init__(self):
        self.progressed, self.ended, self.rows, self.heard = threading.Event(), threading.Event(), 0, time.monotonic()
        self.id = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) == self.id:
            if event.progress.numInputRows:
                self.rows, self.heard = self.rows + event.progress.numInputRows, time.monotonic()
            self.progressed.set()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.id:
            self.ended.set()
            self.progressed.set()


def watched(push: DataFrame, done: Callable[[DataFrame], bool], name: str, poll: Callable[[], DataFrame] | None = None, every: str = "3 seconds", quiet_s: float = 60, timeout_s: float = 1200) -> tuple[DataFrame, str]:
    """Follow a stream until ``done`` says so of what came: what came, and how it ended.

    A listener hears of each batch, and only then is ``done`` asked; a look that fails does not end the watch. If the stream
    ends, fails, or brings nothing for ``quiet_s``, ``poll()`` gives another stream of the same columns that is
    followed in its place. Ends with "done", "polled" (done by the second stream), "ended" (no stream is left) or "late" after ``timeout_s``.
    """
    spark, target, until = push.sparkSession, scratch(push.sparkSession, name), time.monotonic() + timeout_s
    read = lambda: spark.read.schema(push.schema).option("recursiveFileLookup", True).parquet(target)
    spark.createDataFrame([], push.schema).write.parquet(f"{target}/none")

    def finished() -> bool:
        try:
            return bool(done(read()))
        except Exception:  # noqa: BLE001
            logging.getLogger(__name__).warning("a look at %s failed", name, exc_info=True)
            return False

    def follow(stream: DataFrame, part: str, patience: float) -> str:
        def put(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{target}/{part}/batch={batch_id}")

        watch, seen = Watch(), 0
        spark.streams.addListener(watch)
        query = stream.select(push.columns).writeStream.foreachBatch(put).option("checkpointLocation", scratch(spark, f"{name}-log")).trigger(processingTime=every).start()
        watch.id = str(query.id)
        try:
            while time.monotonic() < until:
                watch.progressed.wait(max(0.0, min(until, watch.heard + patience) - time.monotonic()))
                watch.progressed.clear()
                if watch.rows > seen:
                    seen = watch.rows
                    if finished():
                        return "done"
                if watch.ended.is_set() or not query.isActive:
                    return "ended"
                if time.monotonic() >= watch.heard + patience:
                    # a batch that takes longer than the patience is no silence
                    if not query.status["isDataAvailable"]:
                        return "quiet"
                    watch.heard = time.monotonic()
            return "late"
        finally:
            query.stop()
            spark.streams.removeListener(watch)

    how = follow(push, "push", quiet_s)
    if how in ("ended", "quiet") and poll is not None:
        how = {"done": "polled", "quiet": "late"}.get(how := follow(poll(), "poll", timeout_s), how)
    return read(), how
