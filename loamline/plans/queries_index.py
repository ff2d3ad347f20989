"""Queries of the vector index over the test tables: every vector whose id is divisible by 100 is asked for, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import vectorindex as X
from ..session import new_path, table
from . import views as V
from .queries_search import BATCH_SQL, K, _hits_sql


def _index(spark: SparkSession, sf: str) -> X.VectorIndex:
    return X.built(V.index(spark, sf), new_path(spark))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").where("vec_id % 100 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def all_lists(spark: SparkSession, sf: str) -> DataFrame:
    """With all lists asked: what the codes' bounds leave is the exact answer."""
    found = X.nearest(spark, _index(spark, sf), _queries(spark, sf), K, lists=None)
    return found.select("query_id", "rank", "id", "score")


def all_lists_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """With a filter on columns of the index, which holds before rows are ranked."""
    found = X.nearest(spark, _index(spark, sf), _queries(spark, sf), K, lists=None, where=S.metadata_filter({"scope": "room", "file_id": [1, 3, 5]}), keep=["file_id"])
    return found.select("query_id", "rank", "id", "file_id", "score")


FILTERED_SQL = _hits_sql("SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0", K, "scope = 'room' AND file_id IN (1, 3, 5)") + " SELECT query_id, rank, id, file_id, score FROM hits"


def _recall(spark: SparkSession, sf: str, where: F.Column | None) -> DataFrame:
    rows, queries = V.index(spark, sf), _queries(spark, sf)
    index = _index(spark, sf)
    found = X.nearest(spark, index, queries, 10, lists=X.lists_for(spark, index, 10), where=where).select("query_id", "id", "rank", "score")
    exact = S.block_top_k(rows if where is None else rows.where(where), queries, 10).select("query_id", "id", F.lit(1).alias("exact"))
    both = found.join(exact, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("exact").alias("common"), F.count("*").alias("found"))
    return both.join(exact.groupBy("query_id").agg(F.count("*").alias("exact")), "query_id").select("query_id", "found", "exact", (F.col("common") / F.col("exact")).alias("recall"))


def recall(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest by as many lists as a sample asks for, held against the exact ones."""
    return _recall(spark, sf, None)


def recall_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(spark, sf, S.metadata_filter({"file_id": 3}))


QUERIES = {
    "index_all_lists": (all_lists, BATCH_SQL),
    "index_all_lists_filtered": (all_lists_filtered, FILTERED_SQL),
    "index_recall": (recall, None),
    "index_recall_filtered": (recall_filtered, None),
}
