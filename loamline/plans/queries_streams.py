"""Queries over listings and streams of the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.buckets import Buckets, deleted_files, reindexed_store
from ..session import new_path, table
from ..sources import listing
from ..streaming import jobs as J
from . import views as V

TTL, NEWEST = 20 * 86_400, 50


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf}/events.parquet*")


def jobs_by_state(spark: SparkSession, sf: str) -> DataFrame:
    """The newest state of each task of the event stream, kept by its state and timer."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    source = _events(spark, sf).select(F.col("user_id").alias("job_id"), status.alias("status"), F.col("ts").alias("at"))
    found = J.streamed_jobs(spark, source, new_path(spark), TTL, NEWEST)
    return found.select(F.col("job_id").cast("long").alias("job_id"), "status", F.unix_micros("at").alias("at"))


JOBS_SQL = f"""WITH {V.JOBS}, n AS (SELECT task AS job_id, status, "at" FROM kb_jobs QUALIFY row_number() OVER (PARTITION BY task ORDER BY "at" DESC, status DESC) = 1),
d AS (SELECT * FROM n WHERE status <> 'running' AND "at" >= (SELECT max("at") FROM kb_jobs) - INTERVAL {TTL} SECOND ORDER BY "at" DESC, job_id::VARCHAR DESC LIMIT {NEWEST})
SELECT job_id, status, epoch_us("at") AS "at" FROM (SELECT * FROM n WHERE status = 'running' UNION ALL SELECT * FROM d)"""


def progress_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of each tenant's jobs, upserted by an update-mode stream."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    log = _events(spark, sf).select((F.col("user_id") % 10).alias("tenant"), status.alias("status"))
    path = new_path(spark)
    empty = spark.createDataFrame([], "tenant long, total long, processed long, failed long")
    counters = Buckets(f"{path}/table", ("tenant",), 4).created(empty)
    J.progress_each_batch(log, ["tenant"], counters, f"{path}/checkpoint").awaitTermination()
    return counters.rows(spark)


PROGRESS_SQL = f"WITH {V.JOBS} SELECT tenant, count(*) AS total, count(*) FILTER (status = 'completed') AS processed, count(*) FILTER (status = 'failed') AS failed FROM kb_jobs GROUP BY tenant"


def listed(spark: SparkSession, sf: str) -> DataFrame:
    """Files of some folders and one type, out of a listing in pages."""
    listing.register(spark)
    path = new_path(spark)
    files = V.files(spark, sf).select(F.concat_ws("/", "folder_path", "source_ref", "file_name").alias("path"), F.col("folder_path").alias("folder"), F.concat("file_name", F.when(F.col("doc_id") % 4 == 0, ".PDF").otherwise("")).alias("file_name"), "size_bytes", F.concat("modified_time", F.lit("T00:00:00")).alias("modified_time"))
    files.repartition(5, "path").write.json(path)
    found = spark.read.format("listing").option("path", path).option("kind", "manifest").load()
    return found.where(F.col("folder").isin("src0/0", "src4/1", "src8/2") & (F.col("file_type") == "pdf")).select("path", "folder", "file_name", "size_bytes", F.unix_seconds("modified_time").alias("modified"))


LISTED_SQL = f"""WITH {V.FILES} SELECT folder_path || '/' || source_ref || '/' || file_name AS path, folder_path AS folder, file_name || '.PDF' AS file_name, size_bytes, epoch(modified_time::TIMESTAMP)::BIGINT AS modified
FROM kb_files WHERE folder_path IN ('src0/0', 'src4/1', 'src8/2') AND doc_id % 4 = 0"""


def reindexed_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one tenant read again: pages and caches as they are afterwards, after a second run of the same change."""
    path, pages = new_path(spark), V.pages(spark, sf)
    keys = ("tenant_id", "file_id")
    store = Buckets(f"{path}/pages", keys, 16).created(pages)
    cache = Buckets(f"{path}/cache", keys, 16).created(pages.groupBy(*keys).agg(F.count("*").alias("n")))
    status = Buckets(f"{path}/status", keys, 16).created(pages.select(*keys).distinct().withColumn("status", F.lit("pending")))
    new = pages.where("tenant_id = 't1' and page_number <= 2").withColumn("content", F.concat("content", F.lit(" again")))
    for _ in range(2):
        reindexed_store(store, [cache], status, new)
    n = store.rows(spark).groupBy(*keys).agg(F.count("*").alias("pages"), F.sum(F.length("content")).alias("chars"))
    return n.join(cache.rows(spark).select(*keys, "n"), list(keys), "left").join(status.rows(spark), list(keys)).select(*keys, "pages", "chars", F.col("n").alias("cached"), "status")


REINDEXED_SQL = f"""WITH {V.PAGES}, again AS (SELECT DISTINCT tenant_id, file_id FROM kb_pages WHERE tenant_id = 't1' AND page_number <= 2),
p AS (SELECT tenant_id, file_id, content FROM kb_pages ANTI JOIN again USING (tenant_id, file_id) UNION ALL SELECT tenant_id, file_id, content || ' again' FROM kb_pages WHERE tenant_id = 't1' AND page_number <= 2),
c AS (SELECT tenant_id, file_id, count(*) AS n FROM kb_pages ANTI JOIN again USING (tenant_id, file_id) GROUP BY ALL)
SELECT p.tenant_id, p.file_id, count(*) AS pages, sum(length(content))::BIGINT AS chars, any_value(c.n) AS cached, CASE WHEN bool_or(a.file_id IS NOT NULL) THEN 'indexed' ELSE 'pending' END AS status
FROM p LEFT JOIN c USING (tenant_id, file_id) LEFT JOIN again a USING (tenant_id, file_id) GROUP BY p.tenant_id, p.file_id"""

def deleted_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth file out of its chunks, captions, vectors, pages, images, ledger and catalog: rows that each table lost."""
    path, keys = new_path(spark), ("tenant_id", "file_id")
    c = V.chunks(spark, sf).select("tenant_id", "file_id", F.concat_ws("/", "file_id", "chunk_index").alias("id"))
    captions = c.where("id like '%/0'").select(F.concat("id", F.lit("-img")).alias("id"), F.col("id").alias("document_id"))
    vectors = c.select(F.col("id").alias("document_id")).unionByName(captions.select(F.col("id").alias("document_id")))
    files = V.files(spark, sf).select("tenant_id", F.col("source_ref").alias("file_id"))
    tables = {
        "documents": (c, keys),
        "image_analysis_documents": (captions, ("document_id",)),
        "chroma": (vectors, ("document_id",)),
        "pages": (files.withColumn("page_number", F.explode(F.array(F.lit(1), F.lit(2)))), keys),
        "document_images": (captions.select("document_id", F.col("id").alias("image_id")), ("document_id",)),
        "processed_files": (V.ledger(spark, sf), keys),
        "knowledge_row": (files, keys),
    }
    stores = {name: Buckets(f"{path}/{name}", k, 16).created(df) for name, (df, k) in tables.items()}
    done = deleted_files(files.where("cast(file_id AS long) % 50 = 0"), stores)
    left = [s.rows(spark).agg(F.count("*").alias("n_left")).withColumn("target", F.lit(name)) for name, s in stores.items()]
    return done.join(reduce(DataFrame.unionByName, left), "target").select("target", "deleted", F.col("n").alias("n_deleted"), "n_left")


_C = f"{V.chunks_sql()}, kc AS (SELECT file_id, file_id || '/' || chunk_index AS id, chunk_index, file_id::BIGINT % 50 = 0 AS gone FROM kb_chunks)"
DELETED_SQL = f"""WITH {V.FILES}, {V.LEDGER}, {_C},
t AS (SELECT 'documents' AS target, gone FROM kc UNION ALL SELECT 'image_analysis_documents', gone FROM kc WHERE chunk_index = 0 UNION ALL SELECT 'chroma', gone FROM kc UNION ALL SELECT 'chroma', gone FROM kc WHERE chunk_index = 0
  UNION ALL SELECT 'document_images', gone FROM kc WHERE chunk_index = 0 UNION ALL SELECT 'pages', source_ref::BIGINT % 50 = 0 FROM kb_files, range(2) UNION ALL SELECT 'processed_files', file_id::BIGINT % 50 = 0 FROM kb_ledger UNION ALL SELECT 'knowledge_row', source_ref::BIGINT % 50 = 0 FROM kb_files)
SELECT target, true AS deleted, count(*) FILTER (gone) AS n_deleted, count(*) FILTER (NOT gone) AS n_left FROM t GROUP BY target"""

QUERIES = {
    "delete_targets": (deleted_targets, DELETED_SQL),
    "jobs_by_state": (jobs_by_state, JOBS_SQL),
    "job_progress_stream": (progress_stream, PROGRESS_SQL),
    "listing_source": (listed, LISTED_SQL),
    "reindexed_buckets": (reindexed_buckets, REINDEXED_SQL),
}
