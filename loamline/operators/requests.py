"""Whole requests as plans: retrieval with its branches, summaries with their cache, reports of an evaluation."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_text
from .navigate import assembled, cached, mapped_batches, page_batches
from .search import merged, metadata_filter, top_k, with_small_documents

#: What a hit is the same as, in each branch (fixed values of the semantics).
ROOM_KEY = ("id", "chunk_id", "file_id", "chunk_index")
TERM_KEY = ("source_type", "term_id", "id", "chunk_id", "file_id", "chunk_index", "content")


def same(names: tuple[str, ...], columns: list[str]) -> Column:
    """One text of the named columns; absent ones and nulls are empty, and so is the number 0."""
    parts = [key_text(F.col(n), numeric=n == "chunk_index") if n != "content" else F.trim(F.coalesce(n, F.lit(""))) for n in names if n in columns]
    return F.concat_ws("\u0001", *parts)


def json_equals(meta: Column, key: str, value: Any) -> Column:
    """Whether a JSON object's value under a key is a value: a Boolean, a number or a text, each as JSON writes it, and a text is also
    equal to the number or Boolean of its spelling. False for null and for what is no JSON. Any key may be asked for."""
    held = F.try_element_at(F.from_json(meta, "map<string,string>"), F.lit(key))
    if isinstance(value, bool):
        equal = held == str(value).lower()
    elif isinstance(value, (int, float)):
        equal = held.try_cast("double") == float(value)
    else:
        equal = held == str(value)
    return F.coalesce(equal, F.lit(False))


def retrieve(index: DataFrame, query: DataFrame, k: int, tenant: str, file_ids: list | None = None, room: str | None = None, process: str | None = None, all_docs: bool = False, folder: str | None = None, terms: DataFrame | None = None, small: int = 15) -> DataFrame:
    """The chunks for a query (a row with `query`): those of the files asked for (small files whole); else of a room, after
    the tenant's global ones; else of a process; else of all documents; else of process outputs. A folder narrows all
    but files. Glossary terms (id, content, rank) come first, then at most max(k, min(2k, 20)) in all.
    Returns seq (1..) and the index's columns without the vector."""
    within: Mapping[str, Any] = {"tenant_id": tenant} | ({"drive_folder_id": folder} if folder and not file_ids else {})
    hits = lambda more: ranked(top_k(index, query, k, metadata_filter({**within, **more})))
    if file_ids:
        wanted = index.where(metadata_filter({"tenant_id": tenant, "file_id": list(dict.fromkeys(file_ids))}))
        per_file = best_of_each(wanted, query, k)
        found = with_small_documents(wanted.drop("embedding"), per_file, ["file_id"], small).withColumn("rank", F.col("chunk_index"))
        parts, most, order = [found], None, ["file_id", "rank", "id"]
    elif room:
        parts, most, order = [hits({"knowledge_scope": "global"}), hits({"room_id": room})], k, ["rank", "id"]
    else:
        parts, most, order = [hits({"proc_inst_id": process} if process else {} if all_docs else {"source_type": "process_output"})], k, ["rank", "id"]
    parts = [p.withColumn("_key", same(ROOM_KEY, p.columns)) for p in parts]
    if terms is not None:
        parts = [terms.withColumn("_key", same(TERM_KEY, terms.columns)), *parts]
        most = max(k, min(2 * k, 20))
    elif most is None:
        return merged_all(parts[0], order)
    return merged(parts, ["_key"], most, order).drop("_key")


def ranked(hits: DataFrame) -> DataFrame:
    """A top-k's rows with rank 1.. by score and id: k rows, whatever the index."""
    from pyspark.sql.window import Window

    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def best_of_each(rows: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k rows of each file most similar to a query."""
    from pyspark.sql.window import Window

    from ..functions.text import cosine

    r = rows.join(F.broadcast(query.limit(1)), how="cross").withColumn("score", F.round(cosine(F.col("embedding"), F.col("query")), 6)).drop("embedding", "query")
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def merged_all(rows: DataFrame, order: list) -> DataFrame:
    """All rows of a request's files, numbered within each file, so no task sorts them all."""
    from pyspark.sql.window import Window

    return rows.drop("_key").withColumn("seq", F.row_number().over(Window.partitionBy("file_id").orderBy(*order)))


def summarised(pages: DataFrame, cache: DataFrame, model: Column, batch_size: int = 5, smallest: int = 1, largest: int = 20) -> tuple[DataFrame, DataFrame]:
    """Summaries of the files of pages, and the rows to add to the cache (tenant_id, file_id, batch_size, text).

    The batch size is held between its limits. A cached summary counts only if it was made with that size; the other
    files go through the model, batch by batch, and are saved only if every batch was answered."""
    size = max(smallest, min(largest, batch_size))
    hit, miss = cached(pages.select("tenant_id", "file_id").distinct(), cache, size)
    batches = page_batches(pages.join(miss, ["tenant_id", "file_id"], "left_semi"), size)
    made = assembled(mapped_batches(batches, model)).withColumn("batch_size", F.lit(size))
    columns = ["tenant_id", "file_id", "batch_size", "text"]
    out = hit.select(*columns, F.lit(True).alias("from_cache")).unionByName(made.select(*columns, F.lit(False).alias("from_cache")))
    return out, made.where("complete").select(*columns)


def extracted(pages: DataFrame, model: Column, batch_size: int = 5, limit: int = 200_000) -> DataFrame:
    """Glossaries distilled batch by batch under '## name — 정제본': text, truncated, failed, and ok, true if any batch was answered."""
    made = assembled(mapped_batches(page_batches(pages, batch_size), model, "glossary"), "file_id", limit)
    head = F.concat(F.lit("## "), F.col("file_id"), F.lit("\n\n"))
    body = F.concat(F.lit("## "), F.col("file_id"), F.lit(" — 정제본\n\n"), F.substring("text", F.length(head) + 1, F.lit(1 << 30)))
    return made.withColumns({"text": F.substring(body, 1, limit), "truncated": F.col("truncated") | (F.length(body) > limit), "ok": F.col("ok_batches") > 0})


def prompt(template: str, **parts: Column) -> Column:
    """A prompt from a template with {names}; unknown names are an error, nulls are empty."""
    import string

    out: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        out += [F.lit(text)] if text else []
        out += [F.coalesce(parts[name].cast("string"), F.lit(""))] if name is not None else []
    return F.concat(*out) if out else F.lit("")


def write_reports(path: str, questions: DataFrame, results: DataFrame) -> None:
    """An evaluation's questions, results and summary as JSON lines in folders under path, the first two by file."""
    questions.write.mode("overwrite").partitionBy("file").json(f"{path}/qa")
    results.write.mode("overwrite").partitionBy("file").json(f"{path}/report")
    summary = results.groupBy("file").agg(F.count("*").alias("combinations"), F.max("avg_score").alias("best_score"), F.max("avg_recall").alias("best_recall"))
    summary.write.mode("overwrite").json(f"{path}/summary")
