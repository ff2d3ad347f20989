"""Queries of vector search and retrieval over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from ..session import table
from . import views as V

K, LABELS = 5, [1, 3, 5]
_COS = "round(list_cosine_similarity({a}, {b}), 6)"
#: Hits of the variants (query vectors 0 to 3) among the index, ranked.
_HITS = """{index}, hits AS (SELECT query_id, id, file_id, scope, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT q.vec_id AS query_id, i.*, round(list_cosine_similarity(i.embedding, q.embedding::DOUBLE[]), 6) AS score FROM kb_index i, embeddings q WHERE q.vec_id IN ({ids}) AND {where}) QUALIFY rank <= {k})"""


def _hits_sql(ids: str, k: int, where: str = "true") -> str:
    return "WITH " + _HITS.format(index=V.INDEX, ids=ids, k=k, where=where)


def _one(spark: SparkSession, sf: str) -> DataFrame:
    return V.queries(spark, sf, 1).select("query")


def topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """In some files, without the chunks already seen, the k chunks most similar to a query vector."""
    where = S.metadata_filter({"file_id": LABELS, "room_id": None, "other": []}, [0])
    return S.top_k(V.index(spark, sf), _one(spark, sf), K, where).select("id", "file_id", "score")


TOPK_SQL = f"WITH {V.INDEX} SELECT i.id, i.file_id, {_COS.format(a='i.embedding', b='q.embedding::DOUBLE[]')} AS score FROM kb_index i, embeddings q WHERE q.vec_id = 0 AND i.file_id IN (1, 3, 5) AND i.id <> 0 ORDER BY score DESC, i.id LIMIT {K}"


def exclude_ids(spark: SparkSession, sf: str) -> DataFrame:
    where = S.metadata_filter({}, list(range(10)))
    return S.top_k(V.index(spark, sf), _one(spark, sf), 10, where).select("id", "score")


EXCLUDE_SQL = f"WITH {V.INDEX} SELECT i.id, {_COS.format(a='i.embedding', b='q.embedding::DOUBLE[]')} AS score FROM kb_index i, embeddings q WHERE q.vec_id = 0 AND i.id >= 10 ORDER BY score DESC, i.id LIMIT 10"


def batch_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all."""
    e = table(spark, sf, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return S.block_top_k(V.index(spark, sf), queries, K).select("query_id", "rank", "id", "score")


BATCH_SQL = _hits_sql("SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0", K) + " SELECT query_id, rank, id, score FROM hits"


def distance(spark: SparkSession, sf: str) -> DataFrame:
    hits = S.top_k(V.index(spark, sf), _one(spark, sf), 10, S.metadata_filter({"scope": "room"}))
    return hits.select("id", "score", F.round(1 - F.col("score"), 6).alias("distance"))


DISTANCE_SQL = f"WITH {V.INDEX} SELECT id, score, round(1 - score, 6) AS distance FROM (SELECT i.id, {_COS.format(a='i.embedding', b='q.embedding::DOUBLE[]')} AS score FROM kb_index i, embeddings q WHERE q.vec_id = 0 AND i.scope = 'room' ORDER BY score DESC, i.id LIMIT 10)"


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    return V.queries(spark, sf, 4)


def multi_query(spark: SparkSession, sf: str) -> DataFrame:
    found = S.retrieved(V.index(spark, sf), _variants(spark, sf), 10, "multi_query")
    return found.select("id", "score", F.col("query_id").alias("source_query"), "rank")


MULTI_SQL = _hits_sql("0, 1, 2, 3", 10) + " SELECT id, score, query_id AS source_query, rank FROM (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY query_id, rank) = 1) ORDER BY query_id, rank LIMIT 10"


def rag_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return S.retrieved(V.index(spark, sf), _variants(spark, sf), K, "rag_fusion")


FUSION_SQL = (
    _hits_sql("0, 1, 2, 3", S.fusion_fetch(K))
    + """ SELECT id, round(sum(1.0::DOUBLE / (60 + rank) ORDER BY query_id), 6) AS score, string_agg(query_id::VARCHAR, ' | ' ORDER BY query_id, rank) AS source_query, min((query_id, rank))[1] AS first_variant, min((query_id, rank))[2] AS first_rank
FROM hits GROUP BY id ORDER BY score DESC, min((query_id, rank)) LIMIT 5"""
)


def hyde_merge(spark: SparkSession, sf: str) -> DataFrame:
    found = S.retrieved(V.index(spark, sf), _variants(spark, sf), 8, "hyde", include_original=True)
    return found.select("seq", "source", "id", "score")


HYDE_SQL = (
    _hits_sql("0, 1", 8)
    + " SELECT row_number() OVER (ORDER BY source, rank, id) AS seq, source, id, score FROM (SELECT *, CASE query_id WHEN 1 THEN 0 ELSE 1 END AS source FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE query_id WHEN 1 THEN 0 ELSE 1 END, rank) = 1) ORDER BY source, rank, id LIMIT 8"
)


def rewrite(spark: SparkSession, sf: str) -> DataFrame:
    found = S.retrieved(V.index(spark, sf), _variants(spark, sf), K, "rewrite")
    return found.select("rank", "id", "score", F.lit(0).alias("original_query"))


REWRITE_SQL = _hits_sql("3", K) + " SELECT rank, id, score, 0 AS original_query FROM hits"


def room_global(spark: SparkSession, sf: str) -> DataFrame:
    """A room's results after the global ones, each document once."""
    index, q = V.index(spark, sf), V.queries(spark, sf, 1)
    parts = [S.batch_top_k(index, q, 10, S.metadata_filter({"scope": s}), ["file_id", "scope"]) for s in ("global", "room")]
    return S.merged(parts, ["file_id", "id"], 15).select("seq", "scope", "id", "file_id", "score")


ROOM_SQL = (
    f"WITH {V.INDEX}, s AS (SELECT i.scope, i.id, i.file_id, {_COS.format(a='i.embedding', b='q.embedding::DOUBLE[]')} AS score FROM kb_index i, embeddings q WHERE q.vec_id = 0),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10)"
    " SELECT row_number() OVER (ORDER BY scope, rank) AS seq, scope, id, file_id, score FROM r ORDER BY seq LIMIT 15"
)


def glossary_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Glossary terms before documents, capped at max(k, min(2 k, 20))."""
    k = 5
    b = table(spark, sf, "benchmark").orderBy("item_id").limit(k)  # what the term search returns
    terms = b.select(F.concat(F.lit("term_"), F.col("item_id").cast("string")).alias("id"), (F.col("item_id") + 1).cast("int").alias("rank"), F.split("text", " ")[0].alias("title"))
    hits = S.batch_top_k(V.index(spark, sf), V.queries(spark, sf, 1), k).select(F.col("id").cast("string").alias("id"), F.col("rank").cast("int").alias("rank"), F.lit(None).cast("string").alias("title"))
    return S.merged([terms, hits], ["id"], max(k, min(2 * k, 20))).select("seq", "id", F.coalesce("title", F.lit("")).alias("title"))


GLOSSARY_SQL = (
    _hits_sql("0", 5)
    + ", u AS (SELECT 0 AS source, 'term_' || item_id AS id, item_id + 1 AS rank, string_split(text, ' ')[1] AS title FROM benchmark WHERE item_id < 5 UNION ALL SELECT 1, id::VARCHAR, rank, '' FROM hits) SELECT row_number() OVER (ORDER BY source, rank) AS seq, id, title FROM u ORDER BY seq LIMIT 10"
)


def small_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks of small documents; of large ones only those that were hit (each vector stands for a chunk)."""
    chunks = V.chunks(spark, sf).select("file_id", "chunk_index", "content")
    e = V.index(spark, sf)
    hits = e.select((F.col("id")).cast("string").alias("file_id"), F.col("file_id").cast("long").alias("chunk_index"))
    return S.with_small_documents(chunks, hits, ["file_id"], 8).groupBy("file_id", "via").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))


SMALL_SQL = (
    f"WITH {V.chunks_sql()}, {V.INDEX}, s AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM kb_chunks)"
    " SELECT file_id, CASE WHEN n <= 8 THEN 'all' ELSE 'hit' END AS via, count(*) AS n_chunks, sum(length(content))::BIGINT AS n_chars FROM s"
    " WHERE n <= 8 OR EXISTS (SELECT 1 FROM kb_index i WHERE i.id::VARCHAR = s.file_id AND i.file_id = s.chunk_index) GROUP BY ALL"
)


def hydrate(spark: SparkSession, sf: str) -> DataFrame:
    hits = S.batch_top_k(V.index(spark, sf), V.queries(spark, sf, 1), 20)
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    return S.hydrated(hits, rows).select("rank", "id", "score", "source", "n_chars")


HYDRATE_SQL = _hits_sql("0", 20) + " SELECT rank, id, score, d.source, d.n_chars FROM hits JOIN documents d ON d.doc_id = hits.id"


def with_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each file with how many have an embedding (a chunk's number stands for its vector)."""
    c = V.chunks(spark, sf).withColumn("vec", F.col("doc_id") * 3 + F.col("chunk_index"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("vec"), "embedding")
    has = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return c.join(e, "vec", "left").groupBy("file_id").agg(F.count("*").alias("n_chunks"), F.count_if(has).alias("n_embedded"))


EMBEDDED_SQL = f"WITH {V.chunks_sql()} SELECT file_id, count(*) AS n_chunks, count(e.vec_id) AS n_embedded FROM kb_chunks c LEFT JOIN embeddings e ON e.vec_id = c.doc_id * 3 + c.chunk_index AND len(e.embedding) > 0 GROUP BY file_id"


def retrieve_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every retriever over the same variants."""
    index, variants = V.index(spark, sf), _variants(spark, sf)
    parts = [S.retrieved(index, variants, K, name).select(F.lit(name).alias("retriever"), "id", "score") for name in sorted(S.RETRIEVERS)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


GRID_SQL = (
    _hits_sql("0, 1, 2, 3", S.fusion_fetch(K))
    + """ (SELECT 'hyde' AS retriever, id, score FROM hits WHERE query_id = 1 AND rank <= 5) UNION ALL (SELECT 'plain', id, score FROM hits WHERE query_id = 0 AND rank <= 5) UNION ALL (SELECT 'rewrite', id, score FROM hits WHERE query_id = 3 AND rank <= 5)
UNION ALL (SELECT 'multi_query', id, score FROM (SELECT * FROM hits WHERE rank <= 5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY query_id, rank) = 1) ORDER BY query_id, rank LIMIT 5)
UNION ALL (SELECT 'rag_fusion', id, round(sum(1.0::DOUBLE / (60 + rank) ORDER BY query_id), 6) AS score FROM hits GROUP BY id ORDER BY score DESC, min((query_id, rank)) LIMIT 5)"""
)


QUERIES = {
    "search_topk_filtered": (topk_filtered, TOPK_SQL),
    "search_exclude_ids": (exclude_ids, EXCLUDE_SQL),
    "search_batch_topk": (batch_topk, BATCH_SQL),
    "search_distance": (distance, DISTANCE_SQL),
    "retrieve_multi_query": (multi_query, MULTI_SQL),
    "retrieve_rag_fusion": (rag_fusion, FUSION_SQL),
    "retrieve_hyde_merge": (hyde_merge, HYDE_SQL),
    "retrieve_rewrite": (rewrite, REWRITE_SQL),
    "retrieve_room_global_merge": (room_global, ROOM_SQL),
    "retrieve_glossary_merge": (glossary_merge, GLOSSARY_SQL),
    "retrieve_files_small_doc": (small_documents, SMALL_SQL),
    "retrieve_strategies": (retrieve_grid, GRID_SQL),
    "hydrate_hits": (hydrate, HYDRATE_SQL),
    "chunks_with_embeddings": (with_embeddings, EMBEDDED_SQL),
}
