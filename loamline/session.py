"""Session defaults shared by the bench, the tests and applications."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Characters of text that a task works on at once.
CHARS = 1 << 18

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("loamline")
    for key, value in (DEFAULTS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder (spark.checkpoint.dir; one of its own where all tasks run on this machine), which goes
    when this driver program ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        shared = "file://" + tempfile.mkdtemp(prefix="loamline-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/loamline/{uuid.uuid4().hex}"
    atexit.register(_deleted, spark, path)
    return path


def _deleted(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read back, which cuts the lineage."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(stream: Iterator[pd.DataFrame], text_col: str, chars: int = CHARS) -> Iterator[pd.DataFrame]:
    """The rows of Arrow batches in frames of about `chars` characters of text (one row at least), so that what a task makes of a frame does
    not grow with the rows of a batch."""
    for batch in stream:
        sizes = batch[text_col].map(lambda t: 1 + len(t) if isinstance(t, str) else 1).to_numpy()
        at = (np.cumsum(sizes) - sizes) // chars
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(batch)]
        yield from (batch.iloc[a:b] for a, b in zip(edges, edges[1:]) if a < b)
