"""Views of the test tables in the engine's own shapes, as DataFrames and as the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import fixed_token_chunks
from ..session import table

ROLES = ("content", "glossary", "template", "reference", "dataset")
STATES = ("pending", "processing", "indexed", "failed")


def _pick(values: tuple, n) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        F.col("lang").alias("tenant_id"),
        F.when(i % 2 == 0, "upload").otherwise("drive").alias("source_type"),
        i.cast("string").alias("source_ref"),
        F.concat(F.lit("doc_"), (i % 300).cast("string"), F.lit(".txt")).alias("file_name"),
        F.concat("source", F.lit("/"), (i % 3).cast("string")).alias("folder_path"),
        F.when(i % 10 == 0, "image/png").otherwise("text/plain").alias("mime_type"),
        F.col("n_chars").alias("size_bytes"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int")), "yyyy-MM-dd").alias("modified_time"),
        F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"),
        _pick(ROLES, i % 5).alias("doc_role"),
        _pick(STATES, i % 4).alias("index_status"),
        i,
    )


FILES = """kb_files AS (SELECT lang AS tenant_id, CASE WHEN doc_id % 2 = 0 THEN 'upload' ELSE 'drive' END AS source_type, doc_id::VARCHAR AS source_ref,
  'doc_' || (doc_id % 300) || '.txt' AS file_name, source || '/' || (doc_id % 3) AS folder_path, CASE WHEN doc_id % 10 = 0 THEN 'image/png' ELSE 'text/plain' END AS mime_type,
  n_chars AS size_bytes, strftime(DATE '2024-01-01' + (doc_id % 30)::INT, '%Y-%m-%d') AS modified_time, sha256(text) AS file_hash,
  (['content', 'glossary', 'template', 'reference', 'dataset'])[(doc_id % 5 + 1)::INT] AS doc_role, (['pending', 'processing', 'indexed', 'failed'])[(doc_id % 4 + 1)::INT] AS index_status, doc_id FROM documents)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    return d.select(F.col("lang").alias("tenant_id"), F.col("doc_id").cast("string").alias("file_id"))


LEDGER = "kb_ledger AS (SELECT lang AS tenant_id, doc_id::VARCHAR AS file_id FROM documents WHERE doc_id % 2 = 0)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("t"), (F.col("conv_id") % 4).cast("string")).alias("tenant_id"), F.col("conv_id").cast("string").alias("file_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.col("text").alias("content"))


PAGES = "kb_pages AS (SELECT 't' || (conv_id % 4) AS tenant_id, conv_id::VARCHAR AS file_id, (turn + 1)::INT AS page_number, text AS content FROM conversations)"


def chunks(spark: SparkSession, sf_dir: str, size: int = 50, overlap: int = 10) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("tenant_id"), F.col("doc_id").cast("string").alias("file_id"), "doc_id", F.col("text").alias("content"))
    return fixed_token_chunks(d, "content", size, overlap)


def chunks_sql(size: int = 50, overlap: int = 10) -> str:
    step = max(1, size - overlap)
    return f"""kb_words AS (SELECT lang AS tenant_id, doc_id::VARCHAR AS file_id, doc_id, string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s+') AS w FROM documents),
kb_windows AS (SELECT *, CASE WHEN len(w) = 0 OR (len(w) = 1 AND w[1] = '') THEN 0 ELSE 1 + ceil(greatest(len(w) - {size}, 0) / {step})::BIGINT END AS m FROM kb_words),
kb_chunks AS (SELECT tenant_id, file_id, doc_id, i AS chunk_index, m AS total_chunks, array_to_string(w[(i * {step} + 1):(i * {step} + {size})], ' ') AS content
  FROM (SELECT *, unnest(range(m)) AS i FROM kb_windows))"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("chunk_id"), F.col("label").alias("file_id"), F.when(F.col("label") % 2 == 1, "room").otherwise("global").alias("scope"), "embedding")


INDEX = "kb_index AS (SELECT vec_id AS id, vec_id AS chunk_id, label AS file_id, CASE WHEN label % 2 = 1 THEN 'room' ELSE 'global' END AS scope, embedding::DOUBLE[] AS embedding FROM embeddings)"


def queries(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Query vectors: the first n of the index. n is a request's size."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < n)
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return e.select(F.col("event_id").alias("job_id"), (F.col("user_id") % 10).alias("tenant"), F.col("user_id").alias("task"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"))


JOBS = "kb_jobs AS (SELECT event_id AS job_id, user_id % 10 AS tenant, user_id AS task, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, ts AS \"at\" FROM events)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return s.select(F.concat(F.lit("c"), (F.col("doc_id") % 5).cast("string")).alias("chunker"), F.concat(F.lit("r"), (F.floor(F.col("doc_id") / 5) % 5).cast("string")).alias("retriever"), (F.col("quality") * 5).cast("double").alias("score"), (1 - F.col("toxic")).cast("double").alias("recall"))


SCORES = "kb_scores AS (SELECT 'c' || (doc_id % 5) AS chunker, 'r' || ((doc_id // 5) % 5) AS retriever, (quality * 5)::DOUBLE AS score, (1 - toxic)::DOUBLE AS recall FROM labels JOIN documents USING (doc_id))"
