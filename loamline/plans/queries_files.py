"""Queries over files that Spark makes of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources import pdf as P
from . import made

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+')"


def _pdfs(spark: SparkSession, sf: str) -> DataFrame:
    # making and reading a file costs far more than moving a text; several tasks a core, so that none is left waiting for the largest
    c = table(spark, sf, "conversations").repartition(4 * spark.sparkContext.defaultParallelism, "conv_id", "turn")
    return made.pdf_files(c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.concat(F.col("turn").cast("string"), F.lit(".pdf"))).alias("path"), "role", "text"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn of a conversation as a PDF, read back as a page with its text block and its table."""
    found = P.pdf_pages(P.pdf_items(_pdfs(spark, sf)))
    return found.select("path", "page", "content", F.size("blocks").alias("n_blocks"), F.col("blocks")[0]["offset"].alias("first_offset"))


PAGES_SQL = rf"""WITH w AS (SELECT conv_id || '/' || turn || '.pdf' AS path, role, {_WORDS} AS w FROM conversations),
l AS (SELECT path, role, len(w) AS n, array_to_string(list_transform(range((len(w) + {made.LINE - 1}) // {made.LINE}), lambda i: array_to_string(w[(i * {made.LINE} + 1):((i + 1) * {made.LINE})], ' ')), chr(10)) AS text FROM w)
SELECT path, 0 AS page, '# 페이지 1' || chr(10) || chr(10) || CASE WHEN n > 0 THEN text || chr(10) || chr(10) ELSE '' END || '| role | words |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || coalesce(role, '') || ' | ' || n || ' |' AS content,
  CASE WHEN n > 0 THEN 2 ELSE 1 END AS n_blocks, (length('# 페이지 1') + 2)::INT AS first_offset FROM l"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    """How many words a page has, and how far they reach."""
    of = lambda name: F.transform("words", lambda w: w[name])
    return P.pdf_items(_pdfs(spark, sf)).select("path", F.size("words").cast("long").alias("n_words"), F.array_min(of("x0")).alias("x0"), F.array_min(of("top")).alias("top"), F.array_max(of("x1")).alias("x1"))


WORDS_SQL = rf"""WITH w AS (SELECT conv_id || '/' || turn || '.pdf' AS path, role, {_WORDS} AS w FROM conversations),
t AS (SELECT path, len(w) AS n, list_transform(range((len(w) + {made.LINE - 1}) // {made.LINE}), lambda i: w[(i * {made.LINE} + 1):((i + 1) * {made.LINE})]) AS ls FROM w),
x AS (SELECT path, n, list_max(list_concat([145 + 5 * 5], list_transform(ls, lambda l: 20 + 5 * (list_sum(list_transform(l, lambda s: len(s) + 1))::BIGINT - 1)))) AS x1 FROM t)
SELECT path, n + 4 AS n_words, CASE WHEN n > 0 THEN 20.0::DOUBLE ELSE 25.0::DOUBLE END AS x0, CASE WHEN n > 0 THEN 32.5::DOUBLE ELSE 96.5::DOUBLE END AS top, x1::DOUBLE AS x1 FROM x"""

QUERIES = {"pdf_pages": (pages, PAGES_SQL), "pdf_words": (words, WORDS_SQL)}
