"""Vector top-k with metadata predicates, and the retrieval strategies on top of it.

Hits are rows (query_id, rank from 1, id, score, ...). Every predicate is applied before top-k, scores are rounded to 6
decimals and ties go to the smaller id. An index is a DataFrame (id, embedding array<float>, metadata columns).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import cosine, key_text

DIGITS, RRF = 6, 60
#: Scores that a task holds at once.
CELLS = 1 << 21


def metadata_filter(where: Mapping[str, Any], exclude: list | None = None, exclude_col: str = "chunk_id") -> Column:
    """All clauses of a filter: a value is equality, a list is IN (an empty one no constraint), None and other types are
    no clause. Rows to exclude are dropped by exclude_col; rows without one stay."""
    clauses = [F.lit(True)]
    for key, value in where.items():
        if isinstance(value, (list, tuple)):
            values = [v for v in value if isinstance(v, (str, int, float, bool))]
            if values:
                clauses.append(F.col(key).isin(values) if len(values) > 1 else F.col(key) == values[0])
        elif isinstance(value, (str, int, float, bool)):
            clauses.append(F.col(key) == value)
    if exclude:
        clauses.append(F.col(exclude_col).isNull() | ~F.col(exclude_col).isin(exclude))
    return reduce(lambda a, b: a & b, clauses)


def top_k(index: DataFrame, query: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """The k rows most similar to one query vector: query has a single row with column `query`. Plans as
    TakeOrderedAndProject, so each partition keeps k rows."""
    rows = index if where is None else index.where(where)
    hits = rows.join(F.broadcast(query.limit(1)), how="cross")
    hits = hits.withColumn("score", F.round(cosine(F.col("embedding"), F.col("query")), DIGITS)).drop("query", "embedding")
    return hits.orderBy(F.desc("score"), "id").limit(k)


def by_size(vectors: pd.Series, wanted: set[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each wanted length the places of the vectors that have it, these as a matrix, and their norms."""
    sizes, out = vectors.map(lambda v: 0 if v is None else len(v)).to_numpy(), {}
    for n in wanted - {0}:
        at = np.flatnonzero(sizes == n)
        if len(at):
            m = np.stack(vectors.iloc[at].to_numpy()).astype(float)
            out[n] = at, m, np.linalg.norm(m, axis=1)
    return out


def _best(batch: pd.DataFrame, asked: list[tuple[int, np.ndarray]], k: int, cells: int = CELLS) -> pd.DataFrame:
    """The k best rows of a batch (id, embedding, ...) for each query, by matrix products of at most `cells` scores."""
    batch, ids, held = batch.drop(columns="embedding"), batch["id"].to_numpy(), by_size(batch["embedding"], {len(q) for _, q in asked})
    best, got, step = [], [], max(1, cells // max(1, len(batch)))
    for low in range(0, len(asked), step):
        some = asked[low : low + step]
        scores = np.zeros((len(some), len(batch)))
        for n in {len(q) for _, q in some} & set(held):
            at, m, own = held[n]
            mine = [i for i, (_, q) in enumerate(some) if len(q) == n]
            q = np.stack([some[i][1] for i in mine])
            norms = np.outer(np.linalg.norm(q, axis=1), own)
            scores[np.ix_(mine, at)] = np.round(np.divide(q @ m.T, norms, out=np.zeros_like(norms), where=norms > 0), DIGITS)
        best += [lowest(ids, s, k) for s in scores]
        got += [s[b] for s, b in zip(scores, best[low:])]
    out = batch.iloc[np.concatenate(best)].copy()
    out.insert(0, "query_id", np.repeat([i for i, _ in asked], [len(b) for b in best]))
    return out.assign(score=np.concatenate(got))


def lowest(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores; of equal ones those of the lowest ids."""
    if len(scores) <= 4 * k:
        return np.lexsort((ids, -scores))[:k]
    some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def block_top_k(index: DataFrame, queries: DataFrame, k: int, keep: list[str] | None = None, tile: int = 1 << 14, block: int = 1 << 12) -> DataFrame:
    """`batch_top_k` for a table of queries: tiles of the index and blocks of the queries meet in tasks of bounded size, each of
    which gives k rows for a query. Nothing passes the driver but the two counts."""
    rows = index.select("id", "embedding", *(keep or []))
    tiles, blocks = (max(1, -(-df.count() // n)) for df, n in ((rows, tile), (queries, block)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = rows.withColumns({"_t": place("id", tiles), "_b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    right = queries.select("query_id", "query", place("query_id", blocks).alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("_t"))
    schema = StructType([StructField("query_id", LongType()), *rows.drop("embedding").schema.fields, StructField("score", DoubleType())])

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame(columns=schema.names)
        return _best(own.drop(columns=["_t", "_b"]), [(i, np.array(q, float)) for i, q in zip(asked["query_id"], asked["query"])], k)

    found = left.groupBy("_t", "_b").cogroup(right.groupBy("_t", "_b")).applyInPandas(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def batch_top_k(index: DataFrame, queries: DataFrame, k: int, where: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """The k rows most similar to each of a request's query vectors (query_id long, query): a matrix product per Arrow batch
    keeps k rows for each query there, and a window keeps k of those. keep: index columns to carry. The queries go to all
    tasks: they are a request, not a table. A query of another length than a vector has score 0 with it."""
    rows = (index if where is None else index.where(where)).select("id", "embedding", *(keep or []))
    asked = [(r[0], np.array(r[1], float)) for r in queries.select("query_id", "query").collect()]
    schema = StructType([StructField("query_id", LongType()), *rows.drop("embedding").schema.fields, StructField("score", DoubleType())])

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in stream:
            yield _best(batch, asked, k)

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.mapInPandas(run, schema).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_of_each(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order (not dropDuplicates, whose choice is open)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merged(parts: list[DataFrame], keys: list, k: int, order: list | None = None) -> DataFrame:
    """Results joined in the order given, the first of each key kept, k in all; columns seq (1..) and source (0..)."""
    tagged = [p.withColumn("source", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    order = ["source", *(order or ["rank", "id"])]
    rows = first_of_each(rows, keys, order)
    return rows.orderBy(*order).limit(k).withColumn("seq", F.row_number().over(Window.orderBy(*order)))


def document_key() -> Column:
    """What makes a hit the same document: file, chunk number (0 counts as none), chunk and id."""
    cols = [key_text(F.col("file_id")), key_text(F.col("chunk_index"), numeric=True), key_text(F.col("chunk_id")), key_text(F.col("id"))]
    return F.concat_ws("\u0001", *cols)


def multi_query(hits: DataFrame, k: int, keys: list | None = None) -> DataFrame:
    """Hits of a query's variants (query_id is the variant's number) in variant order, first of each key, k in all."""
    rows = first_of_each(hits, keys or ["id"], ["query_id", "rank"])
    return rows.orderBy("query_id", "rank").limit(k)


def rank_fusion(hits: DataFrame, k: int, keys: list | None = None, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of the variants' hits: score is the sum of 1 / (constant + rank), ties go to the key seen
    first; source_query names all variants that found it."""
    keys = keys or ["id"]
    seen = F.struct("query_id", "rank")
    g = hits.groupBy(*keys).agg(
        F.round(F.aggregate(F.array_sort(F.collect_list(seen)), F.lit(0.0), lambda s, x: s + 1 / (F.lit(constant) + x["rank"])), DIGITS).alias("score"),
        F.min(seen).alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(seen)), lambda x: x["query_id"].cast("string")), " | ").alias("source_query"),
    )
    return g.orderBy(F.desc("score"), "first").limit(k).withColumns({"first_variant": F.col("first.query_id"), "first_rank": F.col("first.rank")}).drop("first")


def fusion_fetch(k: int) -> int:
    return max(2 * k, k + 5)


def hydrated(hits: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Hits with their source rows; hits without one go, repeated ids count once, rank is kept."""
    return first_of_each(hits, [key], ["rank"]).join(rows, key)


def with_small_documents(chunks: DataFrame, hits: DataFrame, file_cols: list[str], limit: int = 15) -> DataFrame:
    """All chunks of files that have at most `limit`, and the hits among the chunks of the others."""
    sized = chunks.withColumn("_n", F.count("*").over(Window.partitionBy(*file_cols)))
    keys = [*file_cols, "chunk_index"]
    small = sized.where(F.col("_n") <= limit).drop("_n").withColumn("via", F.lit("all"))
    large = sized.where(F.col("_n") > limit).drop("_n").join(hits.select(*keys).distinct(), keys, "left_semi").withColumn("via", F.lit("hit"))
    return small.unionByName(large)


def plain(index: DataFrame, variants: DataFrame, k: int, **_) -> DataFrame:
    return batch_top_k(index, variants.where("query_id = 0"), k)


def hyde(index: DataFrame, variants: DataFrame, k: int, include_original: bool = False, **_) -> DataFrame:
    """Search by a hypothetical answer (variant 1), with the original query's hits after it if wanted."""
    found = batch_top_k(index, variants.where("query_id = 1"), k)
    return merged([found, plain(index, variants, k)], ["id"], k) if include_original else found


RETRIEVERS: dict[str, Callable[..., DataFrame]] = {
    "plain": plain,
    "multi_query": lambda index, variants, k, **_: multi_query(batch_top_k(index, variants, k), k),
    "hyde": hyde,
    "rag_fusion": lambda index, variants, k, **_: rank_fusion(batch_top_k(index, variants, fusion_fetch(k)), k),
    "rewrite": lambda index, variants, k, **_: batch_top_k(index, variants.orderBy(F.desc("query_id")).limit(1), k),
}


def retrieved(index: DataFrame, variants: DataFrame, k: int, strategy: str = "plain", **options) -> DataFrame:
    """By strategy name, plain for an unknown one. variants: (query_id, query), 0 being the query itself."""
    return RETRIEVERS.get(strategy, plain)(index, variants, k, **options)
