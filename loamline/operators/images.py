"""Images of documents: which rows they are, their captions, and where the captions go.

An image row is a chunk of type image_analysis whose content is the caption. Caption models are an interface; without one
images stay undescribed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import IMAGE_PLACEHOLDER, strip
from .search import first_of_each, top_k

IMAGE = "image_analysis"


def without_images(rows: DataFrame, kind: str = "type") -> DataFrame:
    """Rows that are no image rows; those without a type stay."""
    return rows.where(~F.col(kind).eqNullSafe(IMAGE))


def only_images(rows: DataFrame, kind: str = "type") -> DataFrame:
    return rows.where(F.col(kind) == IMAGE)


def image_hits(index: DataFrame, query: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """The k image rows most similar to a query vector, with the caption trimmed; absent names are empty."""
    hits = top_k(only_images(index), query, k, where)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c) if c in hits.columns else F.lit("").alias(c)
    return hits.select("id", *map(text, ("image_id", "image_url", "file_name", "source_file_name", "drive_folder_name")), strip(F.coalesce("content", F.lit(""))).alias("caption"), "score")


def unique_images(chunks: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Each image once, as its first chunk in the order has it. chunks: keys, image_url, file_id, file_name and
    extracted_images (array of struct image_id, image_url); a chunk without such images whose own image_url is set is
    itself an image, called by its file's id or else name."""
    own = F.coalesce("file_id", "file_name", F.lit("unknown"))
    listed = F.filter(F.coalesce("extracted_images", F.array()), lambda x: F.coalesce(x["image_id"], F.lit("")) != "")
    single = (F.size(F.coalesce("extracted_images", F.array())) == 0) & (F.coalesce("image_url", F.lit("")) != "")
    images = F.when(single, F.array(F.struct(own.alias("image_id"), F.col("image_url").alias("image_url")))).otherwise(listed)
    rows = chunks.withColumns({"_images": images}).select("*", F.posexplode("_images").alias("_at", "_image"))
    rows = first_of_each(rows, [*keys, F.col("_image.image_id")], [*order, "_at"])
    return rows.select(*keys, "_image.image_id", "_image.image_url")


def single_images(images: DataFrame, chunks: DataFrame) -> DataFrame:
    """Images with the chunk that is the image itself: its id, or its file's, is the image's."""
    c = chunks.select("tenant_id", F.coalesce("file_id", "id").alias("image_id"), F.col("id").alias("chunk_id"))
    return images.join(c, ["tenant_id", "image_id"])


def with_captions(chunks: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """chunks with each placeholder of their content replaced by '[이미지: Np page image]' and the caption, or by nothing
    where there is none. images: keys, page, image_index, analysis; one caption a place, the first by text."""
    place = F.concat(F.lit("__IMAGE_PLACEHOLDER_p"), F.col("page").cast("string"), F.lit("_i"), F.col("image_index").cast("string"), F.lit("__"))
    head = F.concat(F.lit("[이미지: "), F.col("page").cast("string"), F.lit("페이지 이미지"), (F.col("image_index") + 1).cast("string"), F.lit("]\n"), F.col("analysis"))
    one = images.where("analysis is not null").groupBy(*keys, place.alias("place")).agg(F.min(head).alias("text"))
    known = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("place", "text"))).alias("_known"))
    found = F.array_distinct(F.regexp_extract_all("content", F.lit(IMAGE_PLACEHOLDER), F.lit(0)))
    text = F.aggregate(found, F.col("content"), lambda t, p: F.replace(t, p, F.coalesce(F.try_element_at("_known", p), F.lit(""))))
    return chunks.join(known, keys, "left").withColumn("content", text).drop("_known")


def described(images: DataFrame, make: Callable[[], Callable[[list[bytes]], list[str | None]]] | None = None, size: int = 10) -> DataFrame:
    """images (image_data binary) with analysis, from a model built once in each task and asked `size` images at a time, and
    analysis_error; without a model both are null, and where it fails on a batch, or gives another number of answers, analysis is null."""
    if make is None:
        return images.withColumns({c: F.lit(None).cast("string") for c in ("analysis", "analysis_error")})
    schema = StructType([*images.schema.fields, StructField("analysis", StringType()), StructField("analysis_error", StringType())])

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in stream:
            out: list[str | None] = []
            errors: list[str | None] = []
            for low in range(0, len(batch), size):
                some = batch["image_data"].iloc[low : low + size].tolist()
                try:
                    answers, error = list(model(some)), None
                    if len(answers) != len(some):
                        answers, error = [None] * len(some), f"{len(answers)} answers for {len(some)} images"
                except Exception as e:  # a model's failure costs its batch, not the job
                    answers, error = [None] * len(some), f"{type(e).__name__}: {e}"
                out += answers
                errors += [error] * len(some)
            yield batch.assign(analysis=out, analysis_error=errors)

    return images.mapInPandas(run, schema)
