"""Structured Streaming over files and events; each job is the batch plan with a stream at its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Events with a time that can carry a watermark (timestamps without a zone cannot)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def session_metrics(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n_events, total) of sessions that end after a gap. The same for a batch and a stream; a stream
    in append mode holds the last open sessions back."""
    e = timed(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return g.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_events", "total")


def tumbling_metrics(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    e = timed(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n_events", "total")


def job_progress(events: DataFrame, keys: list[str]) -> DataFrame:
    """Running counters of jobs from a log of (status); for update or complete mode."""
    s = F.col("status")
    return events.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(s == "completed").alias("processed"), F.count_if(s == "failed").alias("failed"))


def new_only(files: DataFrame, at: str = "modified_time", late: str = "1 hour") -> DataFrame:
    """Each (tenant_id, file_id) once; state older than the watermark is dropped."""
    return files.withWatermark(at, late).dropDuplicatesWithinWatermark(["tenant_id", "file_id"])


def ingest(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, prepare=None) -> StreamingQuery:
    """Files that appear in a folder are prepared and appended once each, whatever restarts there are: the sink's
    transaction log and the checkpoint agree on the batches done."""
    rows = spark.readStream.schema(schema).parquet(source)
    rows = prepare(rows) if prepare else rows
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_each_batch(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:
    """Calls write(rows, batch_id) for each micro-batch; write must give the same table when a batch comes twice."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def evict_each_batch(jobs: DataFrame, path: str, checkpoint: str, ttl_seconds: int = 3600, newest: int = 50) -> StreamingQuery:
    """The newest state of each job of a stream (job_id, status, at), without finished ones older than the TTL (against the
    newest time seen) and beyond the newest so many. Batch n writes the folder n under path from the folder n - 1, so a
    batch that comes twice gives the same table."""
    from ..operators.catalog import kept_jobs, latest_state

    def write(rows: DataFrame, n: int) -> None:
        spark, rows = rows.sparkSession, rows.select("job_id", "status", "at")
        if n:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/{n - 1}"))
        newest_at = rows.agg(F.max("at")).first()[0]
        kept = rows if newest_at is None else kept_jobs(latest_state(rows, ["job_id"], tie="status"), F.lit(newest_at), ttl_seconds, newest)
        kept.write.mode("overwrite").parquet(f"{path}/{n}")

    return upsert_each_batch(jobs, write, checkpoint)
