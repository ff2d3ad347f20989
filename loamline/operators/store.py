"""Writing chunks, vectors, pages and image rows: one DataFrame, so the stores cannot disagree."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalised, nul_free, strip
from .search import first_of_each

PRIMITIVES = ("string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


class Embedder(Protocol):
    """Made once in each task; gives a vector for each text."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """An offline stand-in: signed counts of hashed words, at unit length; empty texts are zero."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in zip(out, texts):
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                row[h % self.size] += 1 if h >> 31 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


def embedded(chunks: DataFrame, make=HashEmbedder, content: str = "content") -> DataFrame:
    """(id, embedding) of chunks. make: builds the embedder, once for each task."""

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for batch in stream:
            yield pd.DataFrame({"id": batch["id"], "embedding": list(embed(batch[content].fillna("").tolist()))})

    id_type = chunks.schema["id"].dataType.simpleString()
    return chunks.select("id", content).mapInPandas(run, f"id {id_type}, embedding array<float>")


def prepared(chunks: DataFrame) -> DataFrame:
    """Chunk rows ready to store: normalised names, NUL-free text, a source."""
    out = {c: normalised(F.col(c)) for c in ("file_name", "file_path", "drive_folder_name") if c in chunks.columns}
    out["content"] = nul_free(F.col("content"))
    out["source"] = F.coalesce("source", F.lit("Unknown")) if "source" in chunks.columns else F.lit("Unknown")
    return chunks.withColumns(out)


def flat_metadata(chunks: DataFrame) -> DataFrame:
    """The columns an index may hold (primitive ones), with the row's id and a type."""
    keep = [c for c, t in chunks.dtypes if t in PRIMITIVES and c not in ("id", "type")]
    kind = F.coalesce("type", F.lit("document")) if "type" in chunks.columns else F.lit("document")
    return chunks.select(F.col("id").alias("document_row_id"), *keep, kind.alias("type"))


def merged_by_id(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """An upsert: old rows without a new one, and the new ones; of new rows with one id, that of the largest hash."""
    one = first_of_each(new, [key], [F.xxhash64(*new.columns).desc()])
    return old.join(one.select(key), key, "left_anti").unionByName(one)


def replaced_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages with those of the files in new replaced: a file that is read again leaves no page behind."""
    return old.join(new.select("tenant_id", "file_id").distinct(), ["tenant_id", "file_id"], "left_anti").unionByName(new)


def page_rows(pages: DataFrame, meta: list[str] | None = None) -> DataFrame:
    """Pages (tenant_id, file_id, content, in the order of `seq`) ready to store: numbered from 1, without NULs and outer
    white space; blank ones go but keep their numbers. meta: the columns kept as page_meta."""
    w = Window.partitionBy("tenant_id", "file_id").orderBy("seq")
    p = pages.withColumns({"page_number": F.row_number().over(w), "content": strip(nul_free(F.col("content")))})
    kept = F.struct(*(F.col(c) for c in meta if c in pages.columns)) if meta else F.lit(None)
    return p.where("content <> ''").select("tenant_id", "file_id", "page_number", "content", kept.alias("page_meta"))


def invalidated(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """Cached results (tenant_id, file_id, ...) of files that were not read again (changed: tenant_id, file_id)."""
    return cache.join(changed.select("tenant_id", "file_id").distinct(), ["tenant_id", "file_id"], "left_anti")


def reindexed(pages: DataFrame, caches: dict[str, DataFrame], new: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Pages with those of the files in new replaced, and every cache without what was made from the old pages."""
    return replaced_pages(pages, new), {name: invalidated(c, new) for name, c in caches.items()}


def image_rows(chunks: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From chunks (id, chunk_index, image_analysis array of struct image_id, analysis, image_url) and extracted images
    (image_id): a caption row for each image of its first chunk, and a link for each chunk and image."""
    a = chunks.select("tenant_id", F.col("id").alias("document_id"), "chunk_index", F.inline("image_analysis")).join(images.select("image_id").distinct(), "image_id")
    first = first_of_each(a, ["image_id"], ["chunk_index", "document_id"])
    captions = first.select("tenant_id", F.sha2(F.concat_ws("\u0001", "tenant_id", "image_id"), 256).alias("id"), "document_id", "image_id", "image_url", F.trim("analysis").alias("content"), F.lit("image_analysis").alias("type"))
    return captions, a.select("tenant_id", "document_id", "image_id", "image_url")
