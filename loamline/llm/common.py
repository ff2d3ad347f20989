"""What several operators of this subpackage share: the shared folder, written tables, distributed components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: With this setting Spark deletes the shuffle files of a query when the query ends. No later one of ours reads them.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the cluster's ``spark.checkpoint.dir``.
    Only where that is unset one is made and set, and only where all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="loamline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as a table in the shared folder and read back. It cuts the
    lineage: a lost executor costs a read, and an expensive or side-effecting stage runs once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which goes when this driver program ends."""
    path = f"{shared_dir(spark)}/loamline/{name}-{uuid.uuid4().hex}"
    atexit.register(_deleted, spark, path)
    return path


def _deleted(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def packed(docs: DataFrame) -> F.Column:
    """All columns of docs as one, called own, so that none of their names meets one of ours."""
    return F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("own")


def unpacked(docs: DataFrame, but: tuple = ()) -> list[F.Column]:
    """The columns of docs out of own, without those named."""
    return [F.col("own")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns) if c not in but]


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of df with further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def dropped(df: DataFrame) -> None:
    """Deletes a table of `written` that nothing will read again."""
    files = df.inputFiles()
    if files:
        _deleted(df.sparkSession, files[0].rsplit("/", 1)[0])


def held_out(doc_id) -> F.Column:
    """True for the fifth of documents that no model may learn from: crc32(doc_id as text) mod 5 = 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def local_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Labels of 0..n-1 joined by the links (a, b): the smallest index of each component."""
    lab = np.arange(n) if labels is None else labels
    while len(a):
        low = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, lab[a], low)
        np.minimum.at(lab, lab[b], low)
        while True:
            jumped = lab[lab]
            if np.array_equal(jumped, lab):
                break
            lab = jumped
        open_ = lab[a] != lab[b]
        a, b = a[open_], b[open_]
    return lab


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected links (src, dst: long, neither null) as (node, component), component
    being the smallest node reachable; nodes without a link are absent.

    Alternating large-star and small-star rounds: each is a grouped minimum, combined before the shuffle, and a join
    back that adaptive execution can split at a hub. Only a count and a checksum of the links reach the driver."""
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    e = written(e, "links")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = written(small.select("x.u", "x.v").where("u <> v").distinct(), "links")


def grouped(stream: Iterable[pa.RecordBatch], key: str, at_least: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by key: a group is never cut, and a table ends
    with the group that takes it to at_least rows. The groups must be bounded."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in stream:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        keys = batch.column(key)
        last = keys[len(keys) - 1]
        same = np.flatnonzero(keys.to_numpy(zero_copy_only=False) != last.as_py())
        cut = int(same[-1]) + 1 if len(same) else 0
        if cut == 0:
            continue  # one group fills the batch; wait for its end
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
        held, rows = [batch.slice(cut)], batch.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)
