"""A training corpus from raw documents: five stages, each a DataFrame of documents to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, linededup, mixing, pieces, simhash
from .common import read, written

#: Pooled probability of its language below which a document is rejected.
SURE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter (or text), or of no clear language, go. Repeated rows stay or go
    together, columns stay as they are, and an empty table stays empty."""
    prefix = _unused(docs, "_id_")
    found = langid.identified(docs, langid.fit(docs), prefix=prefix)
    return found.where((F.col(f"{prefix}lang_pred") != "und") & (F.col(f"{prefix}score") >= SURE)).select(*(F.col(f"`{c}`") for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are near an earlier line; documents of which nothing else is left go. n_chars follows.
    Null and empty texts stay as they are; equal rows keep the same lines."""
    prefix = _unused(docs, "_own_")
    found = linededup.line_dedup(docs.withColumnsRenamed({c: prefix + c for c in linededup.COUNTS}))
    emptied = (F.col("dedup_n_removed") > 0) & (F.trim(F.translate("text", "\n\r\t", "   ")) == "")
    found = found.where(~F.coalesce(emptied, F.lit(False))).drop(*linededup.COUNTS).withColumnsRenamed({prefix + c: c for c in linededup.COUNTS})
    return _counted(found.select(*(F.col(f"`{c}`") for c in docs.columns)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id (null last; equal ids by a hash of the text).
    Null, empty and blank texts are one group; rows equal in id and text stay or go together. An empty table stays empty."""
    return simhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights; n_chars follows. A null source is a source, a document without words
    stays as it is, equal rows are taken alike, and documents of which nothing is taken go."""
    return _counted(mixing.mixed_texts(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, row by row: repeated rows stay; a null text has null ids and 0 of them, an empty one none."""
    found = pieces.encoded(docs.select("doc_id", "lang", "source", "text"))
    return found.select("doc_id", "lang", "source", F.col("piece_ids").alias("ids"), F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_tokens"))


def _unused(docs: DataFrame, prefix: str) -> str:
    """A prefix that no column has."""
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("source_mix", mix), ("piece_encoding", tokens)]

#: Language ID and SimHash have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
