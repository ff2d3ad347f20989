"""A Merkle manifest of a dataset: DuckDB computes the levels of aligned buckets in the tasks, Spark combines the buckets.

A row's leaf is the SHA-256 (lowercase hex) of its fields, each `-` if null, else its length in UTF-8 bytes, a colon and its value.
The leaves of a tree (a language) lie in the order of their ids; every two consecutive nodes (the last run: fewer, even one) become
the SHA-256 of their hex digests, until one node is left. The trees' roots, in the order of their names, null first, are the leaves
of the outer tree, whose root stands for the dataset.

Places in a tree come from ranges: leaves are sorted over all tasks, each task numbers its own, and what comes before a task is one
number a task. A bucket has 2^LEVELS aligned places. In it, one DuckDB query a level takes ordered pairs (string_agg) to
their SHA-256. The buckets' roots are the leaves of a tree that is 2^LEVELS times smaller and goes the same way. Then the
siblings of a bucket's root come to its leaves' own ones by a cogroup, so no row carries a long proof through a shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping

import duckdb
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

LEVELS = 10
#: A range has no more leaves than this, about.
RANGE = 1 << 18


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def one_in_seven(id_col: str) -> Column:
    """True where 7 divides the CRC-32 of the id as decimal text; a null id never."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 7 == 0, F.lit(False))


def tree_name(column: Column) -> Column:
    """A name that is never null; names in order are the values in order, null first."""
    return F.coalesce(F.concat(F.lit("1"), column.cast("string")), F.lit("0"))


def leaves(docs: DataFrame, fields: list[str], id_col: str, tree_col: str, tampered: Column | None, change: Mapping[str, Column]) -> DataFrame:
    """(tree, id, leaf, changed): changed is the leaf after the change of the tampered rows, null for the others."""
    was = hashed(*(field(F.col(f"`{c}`")) for c in fields))
    now = hashed(*(field(change.get(c, F.col(f"`{c}`"))) for c in fields))
    never = F.lit(None).cast("string")
    return docs.select(tree_name(F.col(f"`{tree_col}`")).alias("tree"), F.col(f"`{id_col}`").alias("id"), was.alias("leaf"), (never if tampered is None else F.when(tampered, now)).alias("changed"))


def placed(rows: DataFrame) -> DataFrame:
    """rows (tree, id, leaf, changed) of a written table, with their place i in the tree, by id (null first) and leaf. Equal rows are
    ordered by where they lie in the table, so many of them still make several ranges."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, n = TaskContext.get().partitionId(), None, 0
        for batch in stream:
            numbers = []
            for name in batch.column(0).to_pylist():
                tree, n = (tree, n + 1) if name == tree else (name, 0)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array([part] * len(numbers), pa.int32())], names=["tree", "id", "leaf", "changed", "n", "part"])

    kind = rows.schema["id"].dataType.simpleString()
    order = ["tree", F.col("id").asc_nulls_first(), "leaf", "at"]
    ranges = rows.select("tree", "id", "leaf", "changed", F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("at")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = written(ranges.drop("at").mapInArrow(run, f"tree string, id {kind}, leaf string, changed string, n long, part int"), "leaves")
    # a row a range: its first and last tree with the last number of each; of a range's trees only the first may have begun before
    ends = numbered.groupBy("part").agg(F.min("tree").alias("first"), F.max(F.struct("tree", "n")).alias("last")).orderBy("part").collect()
    before, held, tree = [], 0, None
    for r in ends:
        start = held if r["first"] == tree else 0
        before.append((r["part"], r["first"], start))
        held = r["last"]["n"] + 1 + (start if r["first"] == r["last"]["tree"] else 0)
        tree = r["last"]["tree"]
    start = F.broadcast(spark.createDataFrame(before, "part int, first string, start long"))
    i = F.col("n") + F.when(F.col("tree") == F.col("first"), F.col("start")).otherwise(0)
    return numbered.join(start, "part").select("tree", "id", "leaf", "changed", i.alias("i"))


@functools.cache
def _engine() -> duckdb.DuckDBPyConnection:
    """One in-memory DuckDB a Python worker, with one thread."""
    return duckdb.connect(config={"threads": "1", "memory_limit": "512MB"})


def _height(rows: int, bucket: int, levels: int) -> int:
    """Levels that a bucket climbs: all of them, unless it is the only one of its tree."""
    return levels if bucket or rows >= 1 << levels else (rows - 1).bit_length()


def _climb(nodes: pa.Table, bucket: int, levels: int) -> list[str]:
    """Tables of the levels of one bucket, from its nodes (i, h) to its root."""
    con = _engine()
    con.register("arrived", nodes)
    con.execute("CREATE OR REPLACE TEMP TABLE level0 AS SELECT i, h FROM arrived")
    height = _height(nodes.num_rows, bucket, levels)
    for k in range(height):
        con.execute(f"CREATE OR REPLACE TEMP TABLE level{k + 1} AS SELECT i >> 1 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM level{k} GROUP BY i >> 1")
    return [f"level{k}" for k in range(height + 1)]


def bucket_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, i, h) of the buckets of nodes (tree, i, h)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tree, bucket = (x.as_py() for x in key)
        top = _climb(table.select(["i", "h"]), bucket, levels)[-1]
        h = _engine().execute(f"SELECT h FROM {top}").fetchall()
        return pa.table({"tree": pa.array([tree], pa.string()), "i": pa.array([bucket], pa.int64()), "h": pa.array([x for (x,) in h], pa.string())})

    return nodes.groupBy("tree", F.shiftright("i", levels).alias("bucket")).applyInArrow(run, "tree string, i long, h string")


#: What stands above a bucket's root: each sibling up to the root, as its side (l or r) and digest; r alone where there is none.
OUTER = "tree string, i long, subroot string, path array<string>"


def _sibling(k: int) -> str:
    """SQL for the sibling at level k of a node n with its left join s{k}, coded as in OUTER."""
    return f"CASE WHEN (n.i >> {k}) & 1 = 1 THEN 'l' ELSE 'r' END || coalesce(s{k}.h, '')"


def _siblings(height: int) -> str:
    return " ".join(f"LEFT JOIN level{k} s{k} ON s{k}.i = xor(n.i >> {k}, 1)" for k in range(height))


def paths(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """OUTER rows of nodes (tree, i, h), from those of their buckets."""

    def run(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        tree, bucket = (x.as_py() for x in key)
        height = len(_climb(table.select(["i", "h"]), bucket, levels)) - 1
        own = ", ".join(_sibling(k) for k in range(height))
        rows = _engine().execute(f"SELECT n.i, [{own}]::VARCHAR[] FROM level0 n {_siblings(height)}").fetchall()
        subroot, path = above.column("subroot")[0].as_py(), above.column("path")[0].as_py()
        return pa.table({"tree": pa.array([tree] * len(rows), pa.string()), "i": pa.array([i for i, _ in rows], pa.int64()), "subroot": pa.array([subroot] * len(rows), pa.string()), "path": pa.array([x + path for _, x in rows], pa.list_(pa.string()))})

    return _with_buckets(nodes, outer, levels).applyInArrow(run, OUTER)


def _with_buckets(nodes: DataFrame, outer: DataFrame, levels: int):
    return nodes.groupBy("tree", F.shiftright("i", levels).alias("bucket")).cogroup(outer.groupBy("tree", F.col("i").alias("bucket")))


def proofs(rows: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """(id, leaf, subroot, proof, folded, path) of leaves as of `placed`: the SHA-256 of the siblings from the leaf to the root, and the
    root that the changed leaf (the leaf itself where none is changed) gives with them."""

    def run(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        nodes = table.select(["i", "leaf"]).rename_columns(["i", "h"])
        height = len(_climb(nodes, key[1].as_py(), levels)) - 1
        path = above.column("path")[0].as_py()
        con = _engine()
        con.register("asked", table.select(["i", "leaf", "changed"]).append_column("row", pa.array(range(table.num_rows), pa.int64())))
        steps = ["p0 AS (SELECT row, i, coalesce(changed, leaf) AS cur, []::VARCHAR[] AS path FROM asked)"]
        fold = "sha256(CASE WHEN {s}[1] = 'l' THEN {s}[2:] || cur ELSE cur || {s}[2:] END) AS cur, list_append(path, {s}) AS path"
        for k in range(height):
            steps.append(f"q{k} AS (SELECT n.*, {_sibling(k)} AS s FROM p{k} n LEFT JOIN level{k} s{k} ON s{k}.i = xor(n.i >> {k}, 1)), p{k + 1} AS (SELECT row, i, {fold.format(s='s')} FROM q{k})")
        for k in range(len(path)):  # one sibling for the whole bucket
            steps.append(f"p{height + k + 1} AS (SELECT row, i, {fold.format(s=f'$s{k}')} FROM p{height + k})")
        query = f"WITH {', '.join(steps)} SELECT sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof, cur, path FROM p{height + len(path)} ORDER BY row"
        proof, folded, paths = zip(*con.execute(query, {f"s{k}": s for k, s in enumerate(path)}).fetchall())
        subroot = above.column("subroot")[0].as_py()
        columns = [table.column("id"), table.column("leaf"), pa.array([subroot] * table.num_rows, pa.string()), *(pa.array(x, pa.string()) for x in (proof, folded)), pa.array(paths, pa.list_(pa.string()))]
        return pa.Table.from_arrays(columns, names=["id", "leaf", "subroot", "proof", "folded", "path"])

    return _with_buckets(rows, outer, levels).applyInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, leaf string, subroot string, proof string, folded string, path array<string>")


def climbed(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """nodes (tree, i, h) and above them the roots of buckets, of buckets of buckets and so on, to a single node for each tree."""
    found = [nodes]
    while found[-1].agg(F.max("i")).first()[0]:
        found.append(written(bucket_roots(found[-1], levels), "nodes"))
    return found


def descended(stack: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """OUTER rows of the lowest nodes of a stack of `climbed`, from those of its single nodes."""
    for nodes in reversed(stack[:-1]):
        outer = written(paths(nodes, outer, levels), "paths")
    return outer


RESULTS = [f"merkle_{x}" for x in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "path")]


def proved(docs: DataFrame, fields: list[str], id_col: str = "doc_id", tree_col: str = "lang", tampered: Column | None = None, change: Mapping[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """One row for each of docs: its id and, in columns prefixed merkle_, leaf, subroot (of its tree), root (of all), proof_sha256 (of the
    siblings' digests, from the leaf up), folded_root (from the leaf after tampering, with the siblings as they were), verified
    (folded_root is root) and path (the siblings: side l or r, then the digest, none for a run of one).

    tampered: which rows are changed before the proof is checked; change: the changed columns. Null fields are coded apart from
    every value; a null tree is a tree of its own, the first. Leaves of equal ids lie in the order of their digests, null ids first,
    so equal rows have leaves side by side and proofs of their own. Other columns of docs play no part. An empty table gives an
    empty one."""
    found = written(leaves(docs, fields, id_col, tree_col, tampered, change or {}), "leaves")
    rows = placed(found)
    dropped(found)
    inner = climbed(written(bucket_roots(rows.select("tree", "i", F.col("leaf").alias("h")), levels), "nodes"), levels)
    trees = placed(inner[-1].select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("h").alias("leaf"), F.lit(None).cast("string").alias("changed")))
    outermost = climbed(trees.select("tree", "i", F.col("leaf").alias("h")), levels)
    top = outermost[-1].select("tree", "i", F.col("h").alias("subroot"), F.array().cast("array<string>").alias("path"))
    above = descended(outermost, top, levels).join(trees.select("i", "id", "leaf"), "i")
    above = written(above.select(F.col("id").alias("tree"), F.lit(0).cast("long").alias("i"), F.col("leaf").alias("subroot"), "path"), "paths")
    root = F.lit(next((r[0] for r in outermost[-1].select("h").take(1)), None)).cast("string")
    p = proofs(rows, descended(inner, above, levels), levels)
    values = [F.col("leaf"), F.col("subroot"), root, F.col("proof"), F.col("folded"), F.col("folded") == root, F.col("path")]
    return p.select(F.col("id").alias(id_col), *(x.alias(c) for x, c in zip(values, RESULTS)))


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")) + ")"


def _tree_sql(name: str, nodes: str) -> str:
    """name(tree, height, level, i, h): all nodes above nodes(tree, i, h)."""
    return f"""{name} AS (SELECT tree, CASE WHEN n > 1 THEN len(bin(n - 1)) ELSE 0 END AS height, 0 AS level, i, h FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {nodes})
  UNION ALL SELECT tree, height, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE level < height GROUP BY tree, height, level, i // 2)"""


def _path_sql(name: str, nodes: str) -> str:
    """name(tree, i, path): the siblings of each node, coded as in OUTER."""
    return f"""{name} AS (SELECT n.tree, n.i, list(CASE WHEN (n.i >> k) & 1 = 1 THEN 'l' ELSE 'r' END || coalesce(s.h, '') ORDER BY k) FILTER (k < n.height) AS path
  FROM (SELECT *, unnest(range(greatest(height, 1))) AS k FROM {nodes} WHERE level = 0) n LEFT JOIN {nodes} s ON s.tree = n.tree AND s.level = k AND s.i = xor(n.i >> k, 1::BIGINT) GROUP BY n.tree, n.i)"""


_CRC32 = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"

#: DuckDB SQL for the manifest: levels by recursion, CRC-32 bit by bit, folds along the siblings.
SQL = f"""
WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {_leaf_sql("n_chars")} AS leaf, CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS changed FROM documents),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
{_tree_sql("a", "(SELECT tree, i, leaf AS h FROM n)")},
u AS MATERIALIZED (SELECT tree AS name, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS j FROM a WHERE level = height),
{_tree_sql("b", "(SELECT '' AS tree, j AS i, subroot AS h FROM u)")},
{_path_sql("pa", "a")},
{_path_sql("pb", "b")},
x AS (SELECT n.doc_id, n.leaf, n.changed, u.subroot, (SELECT h FROM b WHERE level = height) AS root, list_concat(coalesce(pa.path, []), coalesce(pb.path, [])) AS path
  FROM n JOIN u ON n.tree = u.name JOIN pa ON pa.tree = n.tree AND pa.i = n.i JOIN pb ON pb.i = u.j),
y AS (SELECT *, list_reduce(list_concat([coalesce(changed, leaf)], path), lambda c, s: sha256(CASE WHEN s[1] = 'l' THEN s[2:] || c ELSE c || s[2:] END)) AS folded_root FROM x)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM y
"""
