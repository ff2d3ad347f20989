"""Whole requests as plans: answers to questions from retrieved chunks, and chunks of the files that requests name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import language, strip
from ..session import written

# What a question without sources gets, by its language.
NO_SOURCES = {"en": "I don't have enough information to answer that question.", "ko": "질문에 답변하기에 충분한 정보가 없습니다."}

#: By what a request names a file, in the order in which they are tried.
KINDS = ("file_id", "file_path", "file_name")


def source_block(number: Column, file_name: Column, section: Column, page: Column, chunk: Column, content: Column) -> Column:
    """One source of a prompt: its number and file, section, page and chunk where they are known, on a line above its content."""
    part = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label), c.cast("string")))
    head = F.concat_ws(" | ", F.concat(F.lit("문서 "), number.cast("string")), F.concat(F.lit("파일: "), F.coalesce(F.nullif(file_name, F.lit("")), F.lit("unknown"))), part("섹션: ", F.nullif(section, F.lit(""))), part("페이지: ", page), part("청크: ", chunk))
    return strip(F.concat(head, F.lit("\n"), F.coalesce(content, F.lit(""))))


def answered(questions: DataFrame, hits: DataFrame, ask: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """questions (query_id, question) with lang, context, answer and sources, in one plan.

    hits: query_id, rank, file_name, chunk_index, content, and section_title and page_number where the index has them. The context is
    the hits in rank order; ask(lang, context, question) is the model's column. A question without hits gets the fixed sentence
    of its language and the model is not asked. sources maps file#chunk (the hit's number from 0 where it has no chunk number) to the
    hit's other columns as JSON; of hits with one key the later one counts."""
    col = lambda name: F.col(name) if name in hits.columns else F.lit(None).cast("string")
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    block = source_block(number, F.col("file_name"), col("section_title"), col("page_number"), F.col("chunk_index"), F.col("content"))
    key = F.concat(F.coalesce("file_name", F.lit("unknown")), F.lit("#"), F.coalesce(F.col("chunk_index").cast("string"), (number - 1).cast("string")))
    meta = F.to_json(F.struct(*(c for c in hits.columns if c not in ("query_id", "rank", "content"))))
    found = hits.select("query_id", F.struct("rank", block.alias("block"), key.alias("key"), meta.alias("meta")).alias("h"))
    found = found.groupBy("query_id").agg(F.array_sort(F.collect_list("h")).alias("h"))
    # entries that no later one repeats
    last = F.filter("h", lambda x, i: ~F.exists(F.slice(F.col("h"), i + 2, F.size("h")), lambda y: y["key"] == x["key"]))
    context = F.array_join(F.transform("h", lambda x: x["block"]), "\n\n")
    found = found.select("query_id", strip(context).alias("context"), F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], x["meta"]))).alias("sources"))
    q = questions.withColumn("lang", language(F.col("question"))).join(found, "query_id", "left")
    none = F.when(F.col("lang") == "en", NO_SOURCES["en"]).otherwise(NO_SOURCES["ko"])
    answer = F.when(F.col("context").isNull(), none).otherwise(ask(F.col("lang"), F.col("context"), F.col("question")))
    return q.select("query_id", "question", "lang", F.coalesce("context", F.lit("")).alias("context"), answer.alias("answer"), F.coalesce("sources", F.create_map().cast("map<string,string>")).alias("sources"))


def path_candidates(path: Column, prefix: str = "files/") -> Column:
    """A path as it may have been stored: as it is (without outer white space and question marks at its end), and with or without the
    prefix. None for a blank one."""
    raw = F.regexp_replace(strip(F.coalesce(path, F.lit(""))), r"\?+$", "")
    other = F.when(raw.startswith(prefix), F.substring(raw, len(prefix) + 1, 1 << 30)).otherwise(F.concat(F.lit(prefix), F.regexp_replace(raw, "^/+", "")))
    return F.when(raw == "", F.array().cast("array<string>")).otherwise(F.filter(F.array_distinct(F.array(raw, other)), lambda p: p != ""))


def _first_of_keys(chunks: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """The first `most` chunks of each of keys (_t, _kind, _value, _r), by number and id. A chunk offers its id, path and name, to keys of
    its room and to those of any (_r null)."""
    by = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in KINDS))
    offered = chunks.withColumn("_by", F.explode(by)).withColumn("_room", F.explode(F.array_distinct(F.array(F.lit(None), F.col("room_id")))))
    on = (F.col("tenant_id") == F.col("_t")) & (F.col("_by.kind") == F.col("_kind")) & (F.col("_by.value") == F.col("_value")) & F.col("_room").eqNullSafe(F.col("_r"))
    w = Window.partitionBy("_t", "_kind", "_value", "_r").orderBy("chunk_index", "id")
    return offered.join(keys, on).drop("_by", "_room").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def requested_chunks(chunks: DataFrame, requests: DataFrame, limit: int = 200) -> DataFrame:
    """The chunks of the files that requests (request, tenant_id, and file_id, file_path, file_name and room_id, each maybe null) name.

    A request is answered by the first of these that has chunks: its file_id, its path as given, its path with or without the prefix,
    its file name; a room narrows all of them. The first `limit` chunks by number come back, with request, via (what answered),
    seq from 1 and truncated, whether there are more. Rows of images (type image_analysis) are no chunks. Requests that nothing answers
    have no rows."""
    if "type" in chunks.columns:
        chunks = chunks.where(~F.col("type").eqNullSafe(F.lit("image_analysis")))
    asked = requests.select("request", F.col("tenant_id").alias("_t"), F.col("room_id").alias("_r"), F.posexplode(F.array(F.struct(F.lit("file_id").alias("kind"), F.array("file_id").alias("value")), F.struct(F.lit("file_path").alias("kind"), path_candidates(F.col("file_path")).alias("value")), F.struct(F.lit("file_name").alias("kind"), F.array("file_name").alias("value")))).alias("_k", "_by"))
    asked = asked.select("request", "_t", "_r", (F.col("_k") * 10).alias("_k"), F.col("_by.kind").alias("_kind"), F.posexplode("_by.value").alias("_n", "_value")).where(F.coalesce("_value", F.lit("")) != "")
    asked = asked.withColumn("_k", F.col("_k") + F.col("_n")).drop("_n")
    # many requests may name one file and many files may have one name: what each asked key can give (the first chunks, and one more that
    # tells there are more) is picked without texts, then only these chunks take their texts along
    keys = written(asked.select("_t", "_kind", "_value", "_r").distinct())
    ref = ["tenant_id", "file_id", "chunk_index", "id"]
    chosen = _first_of_keys(chunks.select(*dict.fromkeys([*ref, "room_id", *KINDS])), keys, limit + 1).select(*(F.col(c).alias(f"_{c}") for c in ref)).distinct()
    kept = chunks.join(written(chosen), reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ref)), "left_semi")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("_t", "_kind", "_value", "_r")]
    found = _first_of_keys(kept, keys, limit + 1).alias("f").join(asked.alias("a"), reduce(and_, same)).select("request", "_k", "a._kind", *(F.col(f"f.{c}").alias(c) for c in chunks.columns))
    w = Window.partitionBy("request")
    found = found.withColumn("_first", F.min("_k").over(w)).where("_k = _first")
    found = found.withColumns({"seq": F.row_number().over(w.orderBy("chunk_index", "id")), "truncated": F.count("*").over(w) > limit}).where(F.col("seq") <= limit)
    return found.select("request", F.col("_kind").alias("via"), "seq", "truncated", *chunks.columns)
