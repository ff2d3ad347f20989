"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

A unit vector u is stored as int8 q and a step s with u = s q + e. For two vectors the cosine differs from
s1 s2 <q1, q2> by at most |e1| |s2 q2| + |e2| |s1 q1| + |e1| |e2|, whatever the vectors are; the norms are measured per
vector. A tile is a block of vectors of one label, and each two tiles of a label meet once. Vectors are coded once, and
only codes go to the tiles. There the integer product gives every cosine with its bound: pairs surely above the threshold
are links, and only the vectors of pairs that may be go to their tiles once more, in double precision, where those pairs
are computed again. Equal vectors collapse to one row with a count before, and a task returns counts and a spanning
forest of its links, so neither copies nor dense groups become pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, local_labels, written

TILE = 1024
#: Added to the bounds for the rounding of the double arithmetic itself.
SLACK = 1e-9


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x (double, not zero): int8 codes, step, norm of the error of the unit vector, norm of the coded vector."""
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    step = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / step[:, None]).astype(np.int8)
    coded = codes * step[:, None]
    return codes, step, np.linalg.norm(unit - coded, axis=1) + 1e-12, np.linalg.norm(coded, axis=1) + 1e-12


def bounded(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The cosines of two sets of coded vectors (as of `quantised`) and how far the true ones may be from them."""
    (a, sa, ea, na), (b, sb, eb, nb) = x, y
    # products of int8 summed over d components stay below 2**24 for d up to 1040, so float32 holds them exactly
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    product = a.astype(kind) @ b.astype(kind).T
    return product * np.outer(sa, sb), np.outer(ea, nb) + np.outer(na, eb) + np.outer(ea, eb) + SLACK


def checked(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether cosine(x[i], y[j]) >= threshold, in double precision."""
    nx, ny, keep = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1), [np.zeros(0, bool)]
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        keep.append(np.einsum("ij,ij->i", x[p], y[q]) / (nx[p] * ny[q]) >= threshold)
    return np.concatenate(keep)


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with cosine(x[i], y[j]) >= threshold."""
    value, bound = bounded(quantised(x), quantised(y))
    sure = value - bound >= threshold
    i, j = np.nonzero(~sure & (value + bound >= threshold))
    sure[i, j] = checked(x, y, i, j, threshold)
    return np.nonzero(sure)


def coded(nodes: DataFrame) -> DataFrame:
    """(label, node, n, d, codes, step, off, size) of nodes (label, node, n, v): the int8 codes as bytes, the step, and the
    norms of the error and of the coded vector."""

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in stream:
            for d, same in batch.groupby(batch["v"].map(len)):
                q, step, off, size = quantised(_scaled(same["v"]))
                yield pd.DataFrame({"label": same["label"], "node": same["node"], "n": same["n"], "d": d, "codes": [r.tobytes() for r in q], "step": step, "off": off, "size": size})

    label = nodes.schema["label"].dataType.simpleString()
    return nodes.select("label", "node", "n", "v").mapInPandas(run, f"label {label}, node long, n long, d int, codes binary, step double, off double, size double")


def _scaled(v: pd.Series) -> np.ndarray:
    """Vectors as rows, by their largest components, lest a norm overflow or vanish."""
    x = np.stack(v.to_numpy())
    return x / np.abs(x).max(axis=1)[:, None]


def _quads(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    codes = np.frombuffer(b"".join(rows["codes"]), np.int8).reshape(len(rows), -1)
    return codes, *(rows[c].to_numpy() for c in ("step", "off", "size"))


def _tile(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of one tile's vectors of one length: each node with its links (repeats counted), the root of its tree, and whether it
    is in a pair that may be a link. With column v those pairs alone are decided, in double precision; without it the
    others are."""
    rows = rows.sort_values("node")
    left, right = rows[rows["own"] == rows["a"]], rows[rows["own"] == rows["b"]]
    if not len(left) or not len(right):
        return pd.DataFrame()
    diagonal, exact, m = rows["a"].iloc[0] == rows["b"].iloc[0], "v" in rows, len(left)
    x, y = _quads(left), _quads(right)
    ids = left["node"].to_numpy() if diagonal else np.concatenate([left["node"].to_numpy(), right["node"].to_numpy()])
    lab, count, maybe = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    nx, ny, base = left["n"].to_numpy(), right["n"].to_numpy(), 0 if diagonal else m
    vx, vy = (_scaled(left["v"]), _scaled(right["v"])) if exact else (None, None)
    for at in range(0, m, 256):
        value, bound = bounded(tuple(c[at : at + 256] for c in x), y)
        sure = value - bound >= threshold
        open_ = ~sure & (value + bound >= threshold)
        if diagonal:
            own = np.arange(len(value))
            sure[own, own + at] = open_[own, own + at] = False
        i, j = np.nonzero(open_ if exact else sure)
        i += at
        if exact:
            keep = checked(vx, vy, i, j, threshold)
            i, j = i[keep], j[keep]
        else:
            p, q = np.nonzero(open_)
            maybe[p + at] = maybe[q + base] = True
        np.add.at(count, i, ny[j])
        if not diagonal:
            np.add.at(count, j + m, nx[i])
        lab = local_labels(len(lab), i, j + base, lab)
    return pd.DataFrame({"node": ids, "links": count, "root": ids[lab], "maybe": maybe})


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """(id_col, n_links, component_id, kept) per row: the number of other rows of the same label with cosine of at least
    threshold, the smallest id that links reach, and whether the row has that id.

    Rows with a null label, or whose vector is null, empty, zero or holds null or non-finite components, link with
    nothing; so do vectors of different lengths. Repeated rows link with each other. A row with a null id counts as a
    link of others and is itself not kept; a component without any id is null. Further columns are not looked at."""
    v = vectors.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0)).alias("v"), F.col(label_col).alias("label"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull()
    v = written(v.withColumn("v", F.when(sound, F.col("v"))), "vectors")
    # equal vectors (0.0 was added, so that -0.0 equals 0.0) are one node; node ids number them
    nodes = v.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    tiles = nodes.groupBy("label").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    t = written(coded(nodes), "coded").join(tiles, "label").withColumn("own", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    t = t.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    t = t.select("label", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "n", "d", "codes", "step", "off", "size")
    label, kept = nodes.schema["label"].dataType.simpleString(), ["label", "a", "b", "node", "links", "root", "maybe"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key, out = rows.iloc[0], []
        for _, same in rows.groupby("d"):
            found = _tile(same, threshold)
            out.append(found[(found["links"] > 0) | found["maybe"]] if len(found) else found)
        found = pd.concat(out)
        if not len(found):
            return pd.DataFrame(columns=kept)
        return found.assign(label=key["label"], a=key["a"], b=key["b"])[kept]

    schema = f"label {label}, a int, b int, node long, links long, root long, maybe boolean"
    first = written(t.groupBy("label", "a", "b").applyInPandas(run, schema), "found")
    again = t.join(first.where("maybe").select("label", "a", "b", "node"), ["label", "a", "b", "node"], "left_semi").join(nodes.select("node", "v"), "node")
    second = again.groupBy("label", "a", "b").applyInPandas(run, schema)
    found = written(first.unionByName(second).where("links > 0").select("node", "links", "root"), "found")
    joined = components(found.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    n = nodes.join(joined, "node", "left").join(counts, "node", "left")
    n = n.select("label", "v", "low", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    least = n.groupBy("component").agg(F.min("low").alias("component_id"))
    n = n.join(least, "component").select("label", "v", "n_links", "component_id")
    out = v.join(n, ["label", "v"], "left").withColumn("component_id", F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


#: DuckDB SQL over all pairs of a label.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON e.vec_id = r.a
"""
