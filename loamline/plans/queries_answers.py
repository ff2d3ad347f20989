"""Queries of whole requests over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import chunking as C
from ..operators import search as S
from ..operators.store import HashEmbedder
from ..session import table
from . import views as V
from .queries_search import _hits_sql

K = 3


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item as a question: the vectors nearest to that of its number, their documents as context, an answer."""
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).join(questions.select("query_id"), "query_id")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("file_name"))
    hits = S.block_top_k(V.index(spark, sf), vectors, K).join(docs, "id").select("query_id", "rank", "file_name", (F.col("id") % 5).alias("chunk_index"), "content", "id")
    ask = lambda lang, context, question: F.concat_ws("|", lang, F.length(context).cast("string"), F.length(question).cast("string"))
    found = A.answered(questions.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("query_id"), F.lit("왜?").alias("question"))), hits, ask)
    return found.select("query_id", "lang", "answer", F.array_join(F.array_sort(F.map_keys("sources")), ",").alias("sources"), F.length("context").alias("context_chars"))


ANSWERS_SQL = (
    _hits_sql("SELECT item_id FROM benchmark", K)
    + """, d AS (SELECT h.query_id, h.rank, d.source AS file_name, d.doc_id % 5 AS chunk_index, d.text AS content FROM hits h JOIN documents d ON d.doc_id = h.id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM d),
c AS (SELECT query_id, trim(string_agg(trim('문서 ' || n || ' | 파일: ' || file_name || ' | 청크: ' || chunk_index || chr(10) || coalesce(content, ''), ' ' || chr(9) || chr(10) || chr(13)), chr(10) || chr(10) ORDER BY n), ' ' || chr(9) || chr(10) || chr(13)) AS context,
  string_agg(DISTINCT file_name || '#' || chunk_index, ',' ORDER BY file_name || '#' || chunk_index) AS sources FROM n GROUP BY query_id),
q AS (SELECT item_id AS query_id, text AS question FROM benchmark UNION ALL SELECT -1, '왜?')
SELECT q.query_id, CASE WHEN regexp_matches(question, '[가-힣]') THEN 'ko' ELSE 'en' END AS lang,
  CASE WHEN context IS NOT NULL THEN (CASE WHEN regexp_matches(question, '[가-힣]') THEN 'ko' ELSE 'en' END) || '|' || length(context) || '|' || length(question)
    WHEN regexp_matches(question, '[가-힣]') THEN '질문에 답변하기에 충분한 정보가 없습니다.' ELSE 'I don''t have enough information to answer that question.' END AS answer,
  coalesce(sources, '') AS sources, coalesce(length(context), 0)::INT AS context_chars FROM q LEFT JOIN c USING (query_id)"""
)


def _files(spark: SparkSession, sf: str) -> DataFrame:
    f = V.files(spark, sf)
    return f.select("tenant_id", F.col("source_ref").alias("file_id"), F.concat("folder_path", F.lit("/"), "file_name").alias("file_path"), "file_name", "doc_id")


def chunk_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh file asked for, by its id, its path or its name in turn; the first five chunks of each."""
    f = _files(spark, sf)
    chunks = V.chunks(spark, sf).join(f.select("tenant_id", "file_id", "file_path", "file_name"), ["tenant_id", "file_id"]).withColumns({"id": F.concat_ws("/", "file_id", "chunk_index"), "room_id": F.lit(None).cast("string")})
    one = lambda i, c: F.when(F.col("doc_id") % 3 == i, c)
    r = f.where("doc_id % 7 = 0").select(F.col("doc_id").alias("request"), "tenant_id", one(0, F.col("file_id")).alias("file_id"), one(1, F.concat(F.lit("files/"), "file_path", F.lit("?"))).alias("file_path"), one(2, F.col("file_name")).alias("file_name"), F.lit(None).cast("string").alias("room_id"))
    return A.requested_chunks(chunks, r, 5).select("request", "via", "seq", "truncated", "file_id", "chunk_index", "content")


REQUESTS_SQL = f"""WITH {V.FILES}, {V.chunks_sql()}, c AS (SELECT k.*, folder_path || '/' || file_name AS file_path, file_name FROM kb_chunks k JOIN kb_files f ON f.source_ref = k.file_id AND f.tenant_id = k.tenant_id),
r AS (SELECT doc_id AS request, tenant_id, source_ref, folder_path || '/' || file_name AS file_path, file_name, doc_id % 3 AS kind FROM kb_files WHERE doc_id % 7 = 0),
m AS (SELECT r.request, CASE kind WHEN 0 THEN 'file_id' WHEN 1 THEN 'file_path' ELSE 'file_name' END AS via, c.* FROM r JOIN c ON c.tenant_id = r.tenant_id AND ((kind = 0 AND c.file_id = r.source_ref) OR (kind = 1 AND c.file_path = r.file_path) OR (kind = 2 AND c.file_name = r.file_name)))
SELECT request, via, (row_number() OVER (PARTITION BY request ORDER BY chunk_index, file_id || '/' || chunk_index))::INT AS seq, count(*) OVER (PARTITION BY request) > 5 AS truncated, file_id, chunk_index, content FROM m QUALIFY seq <= 5"""


def semantic_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of every document, as semantic chunking sees them."""
    d = table(spark, sf, "documents").select("doc_id", C.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\u0001").cast("binary")).alias("digest"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SENTENCES_SQL = rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\x0B\f\r]+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, {_WS})), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s)::INT AS n_sentences, md5(array_to_string(s, chr(1))) AS digest FROM s"""


def semantic(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in groups of sentences that are alike by their vectors."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.col("text").alias("content"))
    return C.semantic_chunks(d, make=HashEmbedder, threshold=0.2).select("file_id", "chunk_index", "total_chunks", "start_index", "content")


QUERIES = {
    "answers": (answers, ANSWERS_SQL),
    "chunk_requests": (chunk_requests, REQUESTS_SQL),
    "semantic_sentences": (semantic_sentences, SENTENCES_SQL),
    "chunk_semantic_vectors": (semantic, None),
}
