"""Queries that call the SQL table functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.tablefunctions import register
from . import views as V
from .queries_text import MATCHES_SQL


def _sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    register(spark)
    return spark.sql(text, **tables)


def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 50 words of every document."""
    call = "SELECT file_id, chunk_index, total_chunks, content FROM chunk_text(TABLE(SELECT * FROM {docs}), strategy => 'fixed_token', size => 50, overlap => 10)"
    return _sql(spark, call, docs=spark.read.parquet(f"{sf}/documents.parquet").selectExpr("cast(doc_id AS string) AS file_id", "text AS content"))


CHUNK_SQL = f"WITH {V.chunks_sql()} SELECT file_id, chunk_index, total_chunks, content FROM kb_chunks"


def grep_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 places of a term in each conversation, with a line of context."""
    call = "SELECT file_id, page_number, line, match, snippet, context, seq FROM grep_pages(TABLE(SELECT * FROM {pages}) PARTITION BY (tenant_id, file_id) ORDER BY page_number, pattern => 'th', context => 1, limit => 20)"
    return _sql(spark, call, pages=V.pages(spark, sf))


GREP_SQL = f"SELECT file_id, page_number, line, match, snippet, context, seq FROM ({MATCHES_SQL})"


def nearest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The three vectors of each file that are most similar to one vector."""
    call = "SELECT file_id, id, score, rank FROM nearest_rows(TABLE(SELECT id, file_id, embedding FROM {index}) PARTITION BY file_id, query => (SELECT query FROM {asked}), k => 3)"
    return _sql(spark, call, index=V.index(spark, sf), asked=V.queries(spark, sf, 1))


NEAREST_SQL = f"""WITH {V.INDEX} SELECT file_id, id, score, rank::INT AS rank FROM (SELECT i.file_id, i.id, round(list_cosine_similarity(i.embedding, q.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY i.file_id ORDER BY round(list_cosine_similarity(i.embedding, q.embedding::DOUBLE[]), 6) DESC, i.id) AS rank FROM kb_index i, embeddings q WHERE q.vec_id = 0) WHERE rank <= 3"""

QUERIES = {"table_chunk_text": (chunk_text, CHUNK_SQL), "table_grep_pages": (grep_pages, GREP_SQL), "table_nearest_rows": (nearest_rows, NEAREST_SQL)}
