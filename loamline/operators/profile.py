"""Tabular profiles and retrieval-quality evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType
from pyspark.sql.window import Window

from ..functions.text import coerced

COLUMNS, TOP, DISTINCT_GUARD = 50, 10, 100_000


def numeric_profile(df: DataFrame) -> DataFrame:
    """(column, dtype, n_rows, null_pct, min, max, mean) of numeric and boolean columns, the first 50 columns; NaN and
    infinities count as null. One pass: all columns in one aggregate."""
    cols = [f for f in df.schema.fields[:COLUMNS] if isinstance(f.dataType, (NumericType, BooleanType))]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(cols):
        v = coerced(F.col(f"`{f.name}`"))
        aggs += [F.count(v).alias(f"_c{i}"), F.min(v).alias(f"_l{i}"), F.max(v).alias(f"_h{i}"), F.avg(v).alias(f"_m{i}")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col("_n").alias("n_rows"), F.round(F.when(F.col("_n") > 0, 1 - F.col(f"_c{i}") / F.col("_n")).otherwise(0.0), 4).alias("null_pct"), *(F.round(F.col(f"_{k}{i}"), 6).alias(n) for k, n in (("l", "min"), ("h", "max"), ("m", "mean")))) for i, f in enumerate(cols)))
    return one.select(F.inline(rows))


def categorical_profile(df: DataFrame, top: int = TOP) -> DataFrame:
    """(column, n_unique, value, n, rank) of the other columns: the most frequent values, ties by value. The columns are
    stacked so that one shuffle counts them all; columns with more than 100 000 filled rows are still counted exactly."""
    cols = [f.name for f in df.schema.fields[:COLUMNS] if not isinstance(f.dataType, (NumericType, BooleanType))]
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols)))).where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    n_unique = counts.groupBy("column").agg(F.count("*").alias("n_unique"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).join(n_unique, "column")


def recall(got, wanted) -> F.Column:
    """The share of the wanted pages that were retrieved, repeats counted; null without any."""
    return F.try_divide(F.size(F.filter(wanted, lambda p: F.array_contains(got, p))), F.size(wanted))


def evaluation(scores: DataFrame) -> DataFrame:
    """(chunker, retriever, num_qa, avg_score, avg_recall), 3 decimals."""
    return scores.groupBy("chunker", "retriever").agg(F.count("*").alias("num_qa"), F.round(F.avg("score"), 3).alias("avg_score"), F.round(F.avg("recall"), 3).alias("avg_recall"))


def ranking(results: DataFrame, top: int = 5) -> DataFrame:
    return results.orderBy(F.desc("avg_score"), F.desc("avg_recall"), "chunker", "retriever").limit(top)


def matrix(results: DataFrame, retrievers: list[str]) -> DataFrame:
    """Chunkers by retrievers, '-' where there is no result."""
    p = results.groupBy("chunker").pivot("retriever", retrievers).agg(F.first("avg_score"))
    return p.select("chunker", *(F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%.3f", F.col(c))).alias(c) for c in retrievers))


def grid(*strategies: DataFrame) -> DataFrame:
    """All combinations of strategy tables, each a handful of names."""
    out = strategies[0]
    for s in strategies[1:]:
        out = out.crossJoin(F.broadcast(s))
    return out


def qa_windows(pages: DataFrame, keys: list[str], size: int = 3) -> DataFrame:
    """Windows of `size` pages in page order: window_index, pages and text."""
    w = Window.partitionBy(*keys).orderBy("page_number")
    p = pages.withColumn("window_index", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    g = p.groupBy(*keys, "window_index").agg(F.array_sort(F.collect_list(F.struct("page_number", "content"))).alias("p"))
    return g.select(*keys, "window_index", F.transform("p", lambda x: x["page_number"]).alias("source_pages"), F.array_join(F.transform("p", lambda x: x["content"]), "\n\n").alias("text"))


def text_windows(docs: DataFrame, text_col: str, size: int = 6000) -> DataFrame:
    """Windows of `size` characters of texts without pages."""
    n = F.ceil(F.length(text_col) / size).cast("int")
    d = docs.where(F.length(text_col) > 0).withColumn("window_index", F.explode(F.sequence(F.lit(0), n - 1)))
    return d.withColumn(text_col, F.substring(F.col(text_col), F.col("window_index") * size + 1, F.lit(size)))
