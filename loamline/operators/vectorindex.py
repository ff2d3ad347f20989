"""An inverted-file vector index: top-k reads some lists of an index instead of all vectors.

Centroids are fitted on a bounded sample of unit vectors, and every row goes to the list of its nearest one. Of the rest (vector less
centroid) a product code of a byte a part is kept, with the length of what the code misses. A search asks the lists whose centroids
are nearest to the query, among those in which rows pass its filter; codes give each row's cosine to within that length, and only rows
that can be among the k best are compared in full. So what a search can miss lies in lists that it does not ask: with all lists its
rows are those of `search.block_top_k`.

A folder holds `lists` (Parquet, a folder a list, so lists not asked are pruned as partitions), `centroids` and `books`.
Rows that have no direction (null, zero, undefined components, or another length than most) are in list -1, which every search asks.
Centroids, books and row counts of lists are bounded by LISTS and go through the driver; rows and queries do not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .search import CELLS, DIGITS, block_top_k, by_size, lowest

#: Lists at most, vectors of the fitting sample at most, parts of a code, entries of a part, rounds of fitting.
LISTS, SAMPLE, PARTS, ENTRIES, ROUNDS = 1 << 14, 1 << 16, 16, 256, 8
#: Half of the last digit of scores, and the errors of sums: bounds are compared with it, so that equal scores all stay.
SLACK = 2e-6
#: Queries that are given their lists at once.
AT_ONCE = 1 << 8


def unit(vectors: pd.Series, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zeros for rows without a direction) and which rows have one."""
    out, sound = np.zeros((len(vectors), dims)), np.zeros(len(vectors), bool)
    sizes = vectors.map(lambda v: 0 if v is None else len(v)).to_numpy()
    at = np.flatnonzero(sizes == dims)
    if dims and len(at):
        m = np.stack([np.asarray(vectors.iloc[i], dtype=float) for i in at])
        norms = np.linalg.norm(m, axis=1)
        good = np.isfinite(norms) & (norms > 0)
        out[at[good]], sound[at[good]] = m[good] / norms[good, None], True
    return out, sound


def _means(points: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; an empty cluster takes the point farthest from its centre."""
    n = min(n, len(points))
    centres = points[np.sort(rng.choice(len(points), n, replace=False))] if n else np.zeros((0, points.shape[1]))
    for _ in range(rounds if n else 0):
        near, least = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=n)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        centres[empty] = points[np.argsort(-least, kind="stable")[: len(empty)]]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    near, least = np.empty(len(points), np.int64), np.empty(len(points))
    norms = (centres**2).sum(axis=1)
    for low in range(0, len(points), block):
        x = points[low : low + block]
        d = norms - 2 * (x @ centres.T)
        near[low : low + block] = d.argmin(axis=1)
        least[low : low + block] = d.min(axis=1) + (x**2).sum(axis=1)
    return near, least


@dataclass(frozen=True)
class VectorIndex:
    """path of the folder; centroids (lists x dims); books (parts x entries x components of a part)."""

    path: str
    centroids: np.ndarray
    books: np.ndarray

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lists")


def _coded(vectors: pd.Series, centroids: np.ndarray, books: np.ndarray) -> pd.DataFrame:
    """List, code and what the code misses (the length of vector less centroid less code) of each vector."""
    x, sound = unit(vectors, centroids.shape[1])
    parts, m = books.shape[0], books.shape[2]
    lists, miss, codes = np.full(len(x), -1), np.full(len(x), 2.0), np.zeros((len(x), parts), np.uint8)
    if sound.any():
        lists[sound] = _nearest(x[sound], centroids)[0]
        rest = np.zeros((int(sound.sum()), parts * m))
        rest[:, : x.shape[1]] = x[sound] - centroids[lists[sound]]
        missed = np.zeros(len(rest))
        for p, book in enumerate(books):
            near, _ = _nearest(rest[:, p * m : (p + 1) * m], book)
            codes[sound, p] = near
            missed += ((rest[:, p * m : (p + 1) * m] - book[near]) ** 2).sum(axis=1)
        miss[sound] = np.sqrt(missed)
    return pd.DataFrame({"_code": [c.tobytes() for c in codes], "_miss": miss, "list": lists})


def fitted(rows: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, seed: int = 7) -> VectorIndex:
    """Centroids and books for rows (id, embedding), from `sample` rows at most, those of the lowest hash of their ids. lists: about
    the square root of the rows if none are named. The length of vectors is the most frequent one of the sample."""
    lists = min(LISTS, lists or max(1, round(rows.count() ** 0.5)))
    held = rows.select("id", "embedding").where("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toPandas()["embedding"]
    sizes = held.map(len)
    dims = int(sizes.mode().iloc[0]) if len(sizes) else 0
    x, sound = unit(held, dims)
    x, rng = x[sound], np.random.default_rng(seed)
    centroids = _means(x, lists, rounds, rng)
    m = -(-dims // parts)
    rest = np.zeros((len(x), parts * m))
    if len(x):
        rest[:, :dims] = x - centroids[_nearest(x, centroids)[0]]
    books = np.stack([_means(rest[:, p * m : (p + 1) * m], entries, rounds, rng) for p in range(parts)])
    return VectorIndex(path, centroids, books)


def built(rows: DataFrame, path: str, **options) -> VectorIndex:
    """An index of rows (id, embedding and columns to filter by or to carry) in a folder. Options are those of `fitted`."""
    index = fitted(rows, path, **options)
    spark = rows.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    spark.createDataFrame([(p, index.books.shape[1], b.ravel().tolist()) for p, b in enumerate(index.books)], "part int, entries int, book array<double>").coalesce(1).write.parquet(f"{path}/books")
    added(index, rows)
    return index


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """The index in a folder."""
    centroids = [r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()]
    books = spark.read.parquet(f"{path}/books").orderBy("part").collect()
    dims = len(centroids[0]) if centroids else 0
    return VectorIndex(path, np.array(centroids).reshape(len(centroids), dims), np.array([np.reshape(b["book"], (b["entries"], -1) if b["entries"] else (0, 0)) for b in books]))


def added(index: VectorIndex, rows: DataFrame) -> None:
    """Appends rows to the lists of their nearest centroids, with as many files a list as its rows ask for. Rows that are there
    already are for the caller to leave out."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((index.centroids, index.books))
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("_code binary, _miss double, list int").fields])

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in stream:
            yield pd.concat([batch.reset_index(drop=True), _coded(batch["embedding"], *shared.value)], axis=1)

    coded = rows.mapInPandas(run, schema).withColumn("_key", F.xxhash64("id", "embedding"))
    coded.hint("rebalance", "list").sortWithinPartitions("list", "id").write.mode("append").partitionBy("list").parquet(f"{index.path}/lists")


def _choice(centroids: np.ndarray, counts: dict[int, int], n: int | None, rows_wanted: int) -> Callable[[pd.Series], list[list[int]]]:
    """Queries to the lists that each asks, as of `probes`."""
    held = [(i, c) for i, c in sorted(counts.items()) if i >= 0]
    lists, sizes = np.array([i for i, _ in held], np.int64), np.array([c for _, c in held], np.int64)
    centroids = centroids[lists] if len(lists) else centroids[:0]

    def asked(queries: pd.Series) -> list[list[int]]:
        q, sound = unit(queries, centroids.shape[1])
        order = np.argsort(-(q @ centroids.T), axis=1, kind="stable")
        out = []
        for i in range(len(queries)):
            upto = len(lists)
            if n is not None and sound[i]:
                upto = max(n, int(np.searchsorted(np.cumsum(sizes[order[i]]), rows_wanted)) + 1)
            out.append([-1, *lists[order[i, :upto]].tolist()])
        return out

    return asked


def probes(index: VectorIndex, queries: DataFrame, counts: dict[int, int], n: int | None, rows_wanted: int) -> DataFrame:
    """queries (query_id, query) with the lists to ask: list -1, and the n nearest of the others that have rows, or more until they have
    rows_wanted; all of them if n is None or the query has no direction."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, counts))

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        choose = _choice(*shared.value, n, rows_wanted)
        for batch in stream:
            for low in range(0, len(batch), AT_ONCE):
                some = batch.iloc[low : low + AT_ONCE]
                yield some.assign(lists=choose(some["query"]))

    found = queries.select("query_id", "query").mapInPandas(run, "query_id long, query array<double>, lists array<int>")
    return found.select("query_id", "query", F.explode("lists").alias("list"))


def lists_for(spark: SparkSession, index: VectorIndex, k: int, recall: float = 0.95, sample: int = 256) -> int:
    """How many lists a search has to ask so that this share of the k nearest rows is found, as measured on `sample` rows of the index at
    most (those of the lowest hash of their ids), each held against all rows. A row is its own nearest, so k + 1 are taken."""
    rows = index.rows(spark)
    held = rows.where("list >= 0").orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toPandas()["embedding"]
    if not len(held):
        return 1
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(held)], "query_id long, query array<double>")
    true = block_top_k(rows.select("id", "embedding", "list"), queries, k + 1, keep=["list"]).where("list >= 0").select("query_id", "list").collect()
    lists = np.array(sorted(r["list"] for r in rows.where("list >= 0").select("list").distinct().collect()))
    order = np.argsort(-(unit(held, index.dims)[0] @ index.centroids[lists].T), axis=1, kind="stable")
    place = {(q, int(lists[i])): n for q, row in enumerate(order) for n, i in enumerate(row)}
    found = np.sort([place[r["query_id"], r["list"]] for r in true])
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)]) + 1


def _decoded(codes: np.ndarray, lists: np.ndarray, centroids: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for; zeros in list -1."""
    parts, entries, m = books.shape
    out = np.zeros((len(lists), parts * m))
    at = np.flatnonzero(lists >= 0)
    if entries and len(at):
        for p, book in enumerate(books):
            out[at, p * m : (p + 1) * m] = book[codes[at, p]]
    out = out[:, : centroids.shape[1]]
    out[at] += centroids[lists[at]]
    return out


def _bounds(codes: np.ndarray, miss: np.ndarray, lists: np.ndarray, queries: pd.Series, centroids: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cosine of each query with each row by the row's code, and how far off it can be."""
    q, sound = unit(queries, centroids.shape[1])
    return q @ _decoded(codes, lists, centroids, books).T, np.where(sound[:, None], miss[None, :], 2.0)


def nearest(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int, lists: int | None = 8, where: Column | None = None, keep: list[str] | None = None, refine: int | None = None, tile: int = 1 << 14, block: int = 1 << 12) -> DataFrame:
    """The k rows most similar to each of queries (query_id long, query): query_id, id, keep, score, rank, as of `search.block_top_k`.

    lists: how many are asked for a query (None: all, which is exact). where: a filter of the index's columns that holds before anything
    is ranked; lists without rows that pass do not count, and more lists are asked until 4 k such rows are there. refine: compare only the
    refine x k rows that are best by code, instead of all that the codes leave open.

    Lists meet queries twice, in tiles of at most `tile` rows (a longer list in pieces) and blocks of queries: once without vectors, for
    the score that k rows of a query reach at least, then to compare in full the rows whose codes leave it open. A task gives k rows for
    a query each time, so pairs of rows and queries are never written."""
    rows = index.rows(spark) if where is None else index.rows(spark).where(where)
    counts = {r["list"]: r["count"] for r in rows.groupBy("list").count().collect()}  # LISTS + 1 rows at most
    wanted = sorted({r["list"] for r in probes(index, queries, counts, lists, 4 * k).select("list").distinct().collect()} & set(counts))
    if set(counts) - set(wanted):
        rows = rows.where(F.col("list").isin(wanted))
    blocks = max(1, -(-queries.select("query_id").distinct().count() // block))
    tiles, place = _tiles({i: counts[i] for i in wanted}, tile), lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    lay = spark.createDataFrame([(i, *t) for i, t in tiles.items()], "list int, first int, pieces int")
    dealt = rows.join(F.broadcast(lay), "list").withColumn("_tile", F.col("first") + place("_key", F.col("pieces")))
    dealt = dealt.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shared = spark.sparkContext.broadcast((index.centroids, index.books, counts, tiles))
    best = k if refine is None else refine * k

    def expanded(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        choose = _choice(shared.value[0], shared.value[2], lists, 4 * k)
        for batch in stream:
            for low in range(0, len(batch), AT_ONCE):
                some = batch.iloc[low : low + AT_ONCE]
                own = [_tiles_of(asked, shared.value[3]) for asked in choose(some["query"])]
                out = some.loc[some.index.repeat([len(t) for t in own])]
                yield out.assign(_tile=[i for t in own for i in t], lists=pd.Series([x for t in own for x in t.values()], index=out.index, dtype=object))

    def asked(some: DataFrame) -> DataFrame:
        """query_id, query, bound and whether the query has a null component, with each tile to ask and its lists."""
        some = some.select("query_id", F.col("query").cast("array<double>").alias("query"), "bound", _holed("query"))
        out = some.mapInPandas(expanded, "query_id long, query array<double>, bound double, _hole boolean, _tile int, lists array<int>")
        return out.withColumn("_block", place("query_id", F.lit(blocks)))

    def seen(own: pd.DataFrame, asked: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """By slices of the queries: the cosines by code, and how far off they can be (not a number in lists that are not asked)."""
        centroids, books = shared.value[:2]
        held = own["list"].to_numpy()
        decoded = _decoded(np.frombuffer(b"".join(own["_code"]), np.uint8).reshape(len(own), -1), held, centroids, books)
        (q, sound), miss = unit(asked["query"], centroids.shape[1]), own["_miss"].to_numpy()
        names, number = np.unique(held, return_inverse=True)
        step = max(1, CELLS // len(own))
        for low in range(0, len(asked), step):
            mine = slice(low, low + step)
            open_ = np.array([np.isin(names, x) for x in asked["lists"].iloc[mine]])[:, number]
            off = 0.0 if refine is not None else np.where(sound[mine, None], miss[None, :], 2.0)
            yield mine, q[mine] @ decoded.T, np.where(open_, off, np.nan)

    def lows(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "low": []})]
        for mine, near, off in seen(own, asked) if len(own) and len(asked) else ():
            low = np.where(np.isnan(off), -np.inf, near - off)
            low = np.partition(low, len(own) - best, axis=1)[:, -best:] if len(own) > best else low
            out = pd.DataFrame({"query_id": np.repeat(asked["query_id"].to_numpy()[mine], low.shape[1]), "low": low.ravel()})
            found.append(out[out["low"] > -np.inf])
        return pd.concat(found)

    schema = StructType([StructField("query_id", LongType()), *rows.select("id", *(keep or [])).schema.fields, StructField("score", DoubleType())])

    def full(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame(columns=schema.names)
        ids, hole, kept, query_ids, scores = own["id"].to_numpy(), own["_hole"].to_numpy(bool), [], [], []
        sizes = asked["query"].map(lambda v: 0 if v is None else len(v)).to_numpy()
        held, empty = by_size(own["embedding"], set(sizes.tolist())), asked["_hole"].to_numpy(bool)
        bound = asked["bound"].to_numpy(float)
        for mine, near, off in seen(own, asked):
            least = np.where(np.isnan(bound[mine]), -np.inf, bound[mine])[:, None] - SLACK
            open_ = near + off >= least
            score = np.zeros(near.shape)
            for n in set(sizes[mine].tolist()) & set(held):
                at, m, norms = held[n]
                some = np.flatnonzero(sizes[mine] == n)
                in_full = open_[np.ix_(some, at)].any(axis=0)  # rows that the codes leave open to some query
                at, m, norms = at[in_full], m[in_full], norms[in_full]
                q = np.stack(asked["query"].iloc[mine].iloc[some].to_numpy()).astype(float)
                both = np.outer(np.linalg.norm(q, axis=1), norms)
                with np.errstate(invalid="ignore"):
                    score[np.ix_(some, at)] = np.round(np.divide(q @ m.T, both, out=np.zeros_like(both), where=both != 0), DIGITS)
            score[:, hole], score[empty[mine]] = 0.0, 0.0
            rank = np.where(open_, np.where(np.isnan(score), np.inf, score), -np.inf)
            for i, r in enumerate(rank):
                top = lowest(ids, r, k)
                top = top[r[top] > -np.inf]
                kept.append(top)
                scores.append(score[i, top])
                query_ids.append(np.full(len(top), asked["query_id"].iloc[mine.start + i]))
        out = own[["id", *(keep or [])]].iloc[np.concatenate(kept)].copy()
        out.insert(0, "query_id", np.concatenate(query_ids))
        return out.assign(score=np.concatenate(scores))

    keys = ["_tile", "_block"]
    codes = dealt.select(*keys, "list", "_code", "_miss")
    first = codes.groupBy(*keys).cogroup(asked(queries.withColumn("bound", F.lit(None).cast("double"))).groupBy(*keys)).applyInPandas(lows, "query_id long, low double")
    w = Window.partitionBy("query_id")
    bound = first.withColumn("n", F.row_number().over(w.orderBy(F.desc("low")))).where(F.col("n") == best).select("query_id", F.col("low").alias("bound"))
    vectors = dealt.select(*keys, "list", "_code", "_miss", _holed("embedding"), "id", "embedding", *(c for c in keep or [] if c not in ("id", "list")))
    found = vectors.groupBy(*keys).cogroup(asked(queries.join(bound, "query_id", "left")).groupBy(*keys)).applyInPandas(full, schema)
    return found.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def _holed(name: str) -> Column:
    """Whether a vector has a null component, which Arrow's arrays in tasks show as one that is not a number."""
    return F.coalesce(F.exists(name, lambda x: x.isNull()), F.lit(False)).alias("_hole")


def _tiles(counts: dict[int, int], tile: int) -> dict[int, tuple[int, int]]:
    """The first tile and the number of tiles of each list: short ones share a tile, one of over `tile` rows has tiles of its own."""
    out, at, held = {}, 0, 0
    for i, n in sorted(counts.items()):
        if held and held + n > tile:
            at, held = at + 1, 0
        pieces = max(1, -(-n // tile))
        out[i] = at, pieces
        at, held = (at, held + n) if pieces == 1 else (at + pieces, 0)
    return out


def _tiles_of(lists: list[int], tiles: dict[int, tuple[int, int]]) -> dict[int, list[int]]:
    """The tiles of some lists, and which of the lists each has."""
    out: dict[int, list[int]] = {}
    for i in lists:
        first, pieces = tiles.get(i, (0, 0))
        for t in range(first, first + pieces):
            out.setdefault(t, []).append(i)
    return out
