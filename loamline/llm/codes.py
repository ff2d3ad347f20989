"""Vector codes: product quantisation in integers, with partial-distance search for the nearest entries.

A component x becomes floor(256 x); a vector is cut into PARTS equal parts, and each part position has a codebook of ENTRIES
entries, which begins as that part of the vectors of the smallest ids. A round assigns every part to its nearest entry and
replaces each entry by the floor of its parts' mean. Sums are integers, so neither order nor split of the input matters.

Codebooks are PARTS x ENTRIES integer vectors: their sums (added up in the tasks, then on the cluster) are all that comes to the
driver, and they go to the tasks as a broadcast variable.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components stop here, so that squared distances of 4096 components fit 64 bits.
MOST = 1 << 24
RESULTS = ["pq_code", "pq_error", "pq_label_error", "pq_codebooks_sha256"]


def usable(vector: Column) -> Column:
    """True if a vector is neither null nor holds null, infinite or undefined components."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(sound(x.cast("double")), F.lit(False)))


def components(vectors: pa.Array, width: int) -> np.ndarray:
    """Scaled integer components; a shorter vector ends in zeros, and what a longer one has beyond `width` is left out."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    values, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    scaled = np.clip(np.floor(values * SCALE), -MOST, MOST).astype(np.int64)
    if len(values) == len(lists) * width and (np.diff(offsets) == width).all():
        return scaled.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], np.minimum(offsets[1:], offsets[:-1] + width))):
        out[i, : b - a] = scaled[a:b]
    return out


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of a codebook for each point, the lowest of equally near ones, and its squared distance.

    Partial-distance search: dimensions come by falling variance of the codebook. The entry nearest in the first of them gives
    each point a complete distance; then every entry's distance grows dimension by dimension, and a mask drops it as soon as it
    strictly exceeds the best complete one, so equally near entries stay. The last dimension completes what is left."""
    n, m = points.shape
    dims = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    first = (points[:, dims[0], None] - book[None, :, dims[0]]) ** 2 if m else np.zeros((n, len(book)), np.int64)
    best = ((points - book[first.argmin(axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= best[:, None])
    distance = first[row, entry]
    for d in dims[1:]:
        distance = distance + (points[row, d] - book[entry, d]) ** 2
        stay = distance <= best[row]
        row, entry, distance = row[stay], entry[stay], distance[stay]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(distance, starts) if len(starts) else distance
    winner = np.minimum.reduceat(np.where(distance == least[row], entry, len(book)), starts) if len(starts) else entry
    return winner, least


def _assigned(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries (vectors x parts) and summed squared distances."""
    m = books.shape[2]
    codes, error = np.empty((len(vectors), len(books)), np.int64), np.zeros(len(vectors), np.int64)
    for p, book in enumerate(books):
        codes[:, p], distance = nearest(vectors[:, p * m : (p + 1) * m], book)
        error += distance
    return codes, error


def _sums(vectors: DataFrame, shared, width: int) -> np.ndarray:
    """For each part and entry, the count of its parts and their sum: (parts, entries, 1 + part length). Each task adds up its own."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, entries, m = books.shape
        total = np.zeros((parts, entries, m + 1), np.int64)
        for whole in stream:
            for low in range(0, whole.num_rows, 2048):
                x = components(whole.column(0).slice(low, 2048), width)
                codes, _ = _assigned(x, books)
                for p in range(parts):
                    np.add.at(total[p], codes[:, p], np.concatenate([np.ones((len(x), 1), np.int64), x[:, p * m : (p + 1) * m]], axis=1))
        p, e = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "sums"])

    parts, entries, m = shared.value.shape
    found = vectors.mapInArrow(run, "part int, entry int, sums array<long>")
    # PARTS x ENTRIES rows at most, whatever the input
    rows = found.groupBy("part", "entry").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(m + 1))).collect()
    out = np.zeros((parts, entries, m + 1), np.int64)
    for part, entry, *sums in rows:
        out[part, entry] = sums
    return out


def codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The fitted codebooks (parts, entries, components of a part) of usable vectors. Their length is that of the first vector, with
    zeros up to a multiple of `parts`; there are as many entries as vectors if these are fewer. Empty without vectors."""
    spark = vectors.sparkSession
    # equal ids are ordered by their vectors; vectors without an id come last
    first = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).toArrow()
    if not first.num_rows:
        return np.zeros((parts, 0, 0), np.int64)
    m = -(-len(first.column("v")[0]) // parts)
    books = components(first.column("v"), parts * m).reshape(first.num_rows, parts, m).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = _sums(vectors.select(vector_col), shared := spark.sparkContext.broadcast(books), parts * m)
        shared.unpersist()
        used = sums[:, :, 0] > 0
        books = books.copy()
        books[used] = sums[used][:, 1:] // sums[used][:, :1]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """rows with usable vectors, with columns prefixed pq_: code (two hex digits for each part), error (squared distance of the
    vector from what the code stands for), label_error (errors summed over equal labels, nulls together) and codebooks_sha256.

    Rows whose vector is null or has null or non-finite components go, as there is nothing to encode; all others stay, copies and
    rows with null or equal ids too. The first vector's length is that of all: shorter ones end in zeros, longer ones are cut.
    An empty vector is one of zeros. Components beyond 65536 stop there. Columns of rows keep their names and values, unless
    they are named like a result, which takes their place. An empty table gives an empty one."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part, so 256 entries at most")
    own = [c for c in rows.columns if c not in RESULTS]
    kept = rows.select(*(F.col(f"`{c}`") for c in own)).where(usable(F.col(f"`{vector_col}`")))
    packed = kept.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own))).alias("own"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"), F.col(f"`{id_col}`").alias("id"))
    books = codebooks(packed, "id", "v", parts, entries, rounds)
    shared, width, sha = rows.sparkSession.sparkContext.broadcast(books), books.shape[0] * books.shape[2], digest(books)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for whole in stream:
            for low in range(0, whole.num_rows, 2048):
                batch = whole.slice(low, 2048)
                codes, error = _assigned(components(batch.column(2), width), books)
                text = codes.astype(np.uint8).tobytes().hex()
                hexed = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hexed, pa.array(error)], names=["own", "label", "code", "error"])

    coded = written(packed.select("own", "label", "v").mapInArrow(run, extended(packed.select("own", "label"), "code string, error long")), "codes")
    of_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    found = coded.join(of_label, F.col("label").eqNullSafe(F.col("of")))
    return found.select(*(F.col("own")[f"c{i}"].alias(c) for i, c in enumerate(own)), F.col("code").alias(RESULTS[0]), F.col("error").alias(RESULTS[1]), F.col("label_error").alias(RESULTS[2]), F.lit(sha).alias(RESULTS[3]))


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The vector (of integer components) that a code stands for."""
    return np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(code))])


def _nearest(k: int) -> str:
    return f"""SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT x.id, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM x JOIN b{k} b USING (part)) GROUP BY ALL"""


def _round(k: int) -> str:
    """Codebooks k + 1 from codebooks k."""
    return f"""a{k} AS MATERIALIZED ({_nearest(k)}),
m{k} AS (SELECT part, entry, i, (s - ((s % n) + n) % n) // n AS c FROM (SELECT part, entry, i, sum(x.v[i])::BIGINT AS s, count(*) AS n FROM a{k} JOIN x USING (id, part),
  (SELECT unnest(range(1, (SELECT max(len(v)) FROM x) + 1)) AS i) GROUP BY ALL)),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS v FROM m{k} GROUP BY ALL) n ON b.part = n.part AND b.entry = n.entry)"""


#: DuckDB SQL for the codes, with distances to all entries.
SQL = f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT id, part, v[(part * (len(v) // {PARTS}) + 1):((part + 1) * (len(v) // {PARTS}))] AS v FROM (SELECT *, unnest(range({PARTS})) AS part FROM e)),
b0 AS MATERIALIZED (SELECT part, id - 1 AS entry, v FROM x WHERE id <= {ENTRIES}),
{", ".join(_round(k) for k in range(ROUNDS))},
a{ROUNDS} AS MATERIALIZED ({_nearest(ROUNDS)}),
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS c, unnest(range(len(v))) AS i FROM b{ROUNDS})),
c AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e JOIN c USING (id), h
"""
