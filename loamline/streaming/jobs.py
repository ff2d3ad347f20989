"""Job states in a stream: each job's newest state, dropped some time after it has finished, in Spark's state store.

`job_changes` keeps a job's state under its key with an event-time timer; no batch reads or writes the state of other jobs. What comes out
are changes, which `appended` logs by batch and `current` folds into the table of jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.buckets import Buckets
from ..operators.catalog import latest_state
from .events import job_progress, upsert_each_batch

#: Changes as the processor gives them; times are microseconds, so that no time zone comes between.
CHANGE = "job_id string, status string, us long, gone boolean"


class JobState(StatefulProcessor):
    """Per job: value state (status, at) of the newest row, ties by status; a finished job has a timer at its time and the TTL, and
    goes when the watermark is past it. Rows older than the state change nothing; a job that runs again loses its timer."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", "status string, us long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = self.state.get() if self.state.exists() else None
        newest = max(((r["us"], r["status"] or "") for r in rows if r["us"] is not None), default=None)
        if newest is None or (old is not None and (old[1], old[0]) >= newest):
            return
        us, status = newest
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status != "running":
            # a timer is due when the watermark has reached it, and a job stays through its last millisecond
            self.handle.registerTimer(us // 1000 + self.ttl + 1)
        self.state.update((status, us))
        yield Row(job_id=key[0], status=status, us=us, gone=False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        status, us = self.state.get()
        self.state.clear()
        yield Row(job_id=key[0], status=status, us=us, gone=True)

    def close(self) -> None:
        pass


def job_changes(jobs: DataFrame, ttl_seconds: int = 3600, late: str = "0 seconds") -> DataFrame:
    """Changes (job_id, status, at, gone) of a stream of jobs (job_id, status, at): a row when a job's newest state changes, and one with gone when a finished
    job is older than the TTL against the newest time seen, less `late`. Rows without a job go, and so do rows that come more than `late`
    after newer ones of an earlier batch."""
    jobs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = jobs.select(F.col("job_id").cast("string").alias("job_id"), "status", F.col("at").cast("timestamp").alias("at")).where("job_id is not null")
    rows = rows.withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    found = rows.groupBy("job_id").transformWithState(JobState(ttl_seconds), CHANGE, "Update", "EventTime")
    return found.select("job_id", "status", F.timestamp_micros("us").alias("at"), "gone")


def appended(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Logs changes in a folder for each batch; a batch that comes twice takes its own place."""
    return upsert_each_batch(changes, lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/batch={n}"), checkpoint)


def current(log: DataFrame, newest: int | None = 50) -> DataFrame:
    """The jobs (job_id, status, at) that a log of changes (and batch) leaves: all running ones, and the newest so many finished."""
    last = latest_state(log, ["job_id"], at="batch", tie="gone").where("not gone").select("job_id", "status", "at")
    if newest is None:
        return last
    return last.where("status = 'running'").unionByName(last.where("status <> 'running'").orderBy(F.desc("at"), F.desc("job_id")).limit(newest))


def merged_each_batch(stream: DataFrame, table: Buckets, checkpoint: str, order: list | None = None) -> StreamingQuery:
    """Upserts each batch into a bucketed table. The newest row of a key wins by `order` against the batch and the table, so a batch that
    comes twice or late changes nothing more."""

    def write(rows: DataFrame, n: int) -> None:
        if order:
            touched = table.touched(rows)
            rows = rows.unionByName(table.rows(rows.sparkSession).join(rows.select(*table.keys).distinct(), list(table.keys), "left_semi")) if touched else rows
        table.upserted(rows, order)

    return upsert_each_batch(stream, write, checkpoint)


def invalidated_each_batch(pages: DataFrame, store: Buckets, caches: list[Buckets], status: Buckets, checkpoint: str) -> StreamingQuery:
    """Files whose pages come in a stream are re-indexed batch by batch (`buckets.reindexed_store`): what caches have of them goes, their
    pages are replaced, their status is set. A batch that comes twice ends in the same tables."""
    from ..operators.buckets import reindexed_store

    return upsert_each_batch(pages, lambda rows, n: reindexed_store(store, caches, status, rows) and None, checkpoint)


def progress_each_batch(log: DataFrame, keys: list[str], table: Buckets, checkpoint: str) -> StreamingQuery:
    """Counters of jobs (total, processed, failed) from a log of states, upserted as they change: a batch writes whole counters, not
    differences, so it may come twice."""
    counters = job_progress(log, keys)
    write = lambda rows, n: table.upserted(rows) and None
    return counters.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_jobs(spark: SparkSession, source: DataFrame, path: str, ttl_seconds: int, newest: int | None) -> DataFrame:
    """The table of jobs after a stream has been read to its end."""
    appended(job_changes(source, ttl_seconds), f"{path}/log", f"{path}/checkpoint").awaitTermination()
    return current(spark.read.parquet(f"{path}/log"), newest)
