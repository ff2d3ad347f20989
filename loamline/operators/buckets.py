"""Tables in buckets of their keys, so that a change rewrites the buckets it touches and no others.

A row lies in the partition folder `bucket` = hash of its keys modulo the number of buckets. A change reads the folders of its own keys,
and Spark's dynamic partition overwrite puts the new folders in their place when all of them are written. Each change is a function of the
keys it names (replace, remove, upsert), so one that failed half-way or comes twice ends in the same table.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..session import written
from .search import first_of_each

BUCKETS = 64


@dataclass(frozen=True)
class Buckets:
    """A table in a folder, by the hash of `keys`. The number of buckets is fixed when it is created; take one that keeps a bucket's files
    near 128 MB."""

    path: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def created(self, rows: DataFrame) -> Buckets:
        """The columns are kept beside the buckets, as a table without rows has no files that would tell them."""
        self._write(rows, "errorifexists")
        rows.sparkSession.createDataFrame([(rows.schema.json(),)], "value string").coalesce(1).write.text(f"{self.path}/_schema")
        return self

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._all(spark).drop("bucket")

    def _all(self, spark: SparkSession) -> DataFrame:
        schema = StructType.fromJson(json.loads(spark.read.text(f"{self.path}/_schema").first()[0]))
        return spark.read.schema(schema.add("bucket", IntegerType())).parquet(self.path)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys: `buckets` numbers at most."""
        return sorted(r[0] for r in keys.select(self._bucket().alias("bucket")).distinct().collect())

    def _write(self, rows: DataFrame, mode: str) -> None:
        # one task a bucket, more where a bucket is large
        dealt = rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def _old(self, spark: SparkSession, touched: list[int]) -> DataFrame:
        return self._all(spark).where(F.col("bucket").isin(touched)).drop("bucket")

    def replaced(self, new: DataFrame) -> list[int]:
        """All rows of the keys that new has give way to those of new. Returns the buckets rewritten."""
        touched = self.touched(new)
        if touched:
            old = self._old(new.sparkSession, touched).join(new.select(*self.keys).distinct(), list(self.keys), "left_anti")
            self._write(old.unionByName(new), "overwrite")
        return touched

    def upserted(self, new: DataFrame, order: list | None = None) -> list[int]:
        """One row a key: that of new, the first by `order` where it has several (by default the largest hash)."""
        return self.replaced(first_of_each(new, list(self.keys), order or [F.xxhash64(*new.columns).desc()]))

    def removed(self, gone: DataFrame) -> list[int]:
        """Rows with the keys of gone go. A bucket of which nothing is left is emptied by a write of its own, as an overwrite leaves
        folders alone that it has no rows for."""
        spark, touched = gone.sparkSession, self.touched(gone)
        if not touched:
            return []
        left = self._old(spark, touched).join(gone.select(*self.keys).distinct(), list(self.keys), "left_anti")
        full = self.touched(left)
        self._write(left, "overwrite")
        for n in set(touched) - set(full):
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={n}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        return touched


def reindexed_store(pages: Buckets, caches: list[Buckets], status: Buckets, new: DataFrame, state: str = "indexed") -> dict[str, list[int]]:
    """Files that were read again (new: pages with tenant_id, file_id). First what was made of the old pages goes from the caches, then
    the pages are replaced, and last the files' status is set: a run that stops between leaves files without the status, no cache is
    ever beside pages it was not made of, and running it again ends in the same tables. Returns the buckets rewritten by table."""
    keys = new.select("tenant_id", "file_id").distinct()
    done = {c.path: c.removed(keys) for c in caches}
    done[pages.path] = pages.replaced(new)
    done[status.path] = status.upserted(keys.withColumn("status", F.lit(state)))
    return done


#: What a deleted file leaves in no place (fixed values: the names of the flags), in the order in which it goes.
TARGETS = ("documents", "image_analysis_documents", "chroma", "pages", "document_images", "processed_files", "storage", "extracted_images", "knowledge_row")


def deleted_files(gone: DataFrame, stores: dict[str, Buckets], folders: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Files (gone: tenant_id, file_id) out of all their places: (target, deleted, n, error), a row for each of TARGETS that is given. A step that
    fails is told and does not keep the others from going on; running it again ends in the same tables.

    stores: tables by target. Those with a column document_id (rows of images, vectors, image captions) lose what belongs to the
    chunks of these files, which are found before anything goes; the others lose the keys themselves. folders: for storage and
    extracted_images, a function from gone to the paths (path) to delete, files or folders; n counts those that were there."""
    spark, keys = gone.sparkSession, gone.select("tenant_id", "file_id").distinct()
    chunks = stores.get("documents")
    ids = written(chunks.rows(spark).join(keys, ["tenant_id", "file_id"], "left_semi").select(F.col("id").alias("document_id")).distinct()) if chunks else None
    captions = stores.get("image_analysis_documents")
    if ids is not None and captions is not None:  # a caption has a vector of its own
        more = captions.rows(spark).join(ids, "document_id", "left_semi").select(F.col("id").alias("document_id"))
        ids = written(ids.unionByName(more).distinct())

    def emptied(store: Buckets) -> int:
        wanted = ids if store.keys == ("document_id",) else keys
        n = store.rows(spark).join(wanted, list(store.keys), "left_semi").count()
        store.removed(wanted)
        return n

    def unlinked(paths: DataFrame) -> int:
        def run(stream):
            for batch in stream:
                yield batch.assign(there=[_delete(p) for p in batch["path"]])

        return paths.select("path").distinct().mapInPandas(run, "path string, there boolean").where("there").count()

    done = []
    for target in TARGETS:
        step = (lambda t=target: emptied(stores[t])) if target in stores else (lambda t=target: unlinked(folders[t](keys))) if target in (folders or {}) else None
        if step is None:
            continue
        try:
            done.append((target, True, step(), None))
        except Exception as e:
            done.append((target, False, 0, f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(done, "target string, deleted boolean, n long, error string")


def _delete(path: str) -> bool:
    """Deletes a file or folder; whether it was there."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.Directory:
        store.delete_dir(place)
    elif info.type == fs.FileType.File:
        store.delete_file(place)
    return info.type != fs.FileType.NotFound


def delete_totals(done: DataFrame) -> DataFrame:
    """How many targets were emptied, how many failed, and all."""
    return done.agg(F.count_if("deleted").alias("deleted"), F.count_if(~F.col("deleted")).alias("failed"), F.count("*").alias("total"))
