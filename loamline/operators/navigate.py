"""Reading inside documents: pages, full text, search with context, glossaries within a budget, page batches.

Pages are rows (tenant_id, file_id, page_number from 1, content).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.text import CLIP_MARK, CUT_MARK, clipped, lenient_int, strip
from ..session import sliced

FILE = ["tenant_id", "file_id"]


def page_set(spec: str, most: int = 10) -> list[int]:
    """Sorted page numbers of '5', '5-8' or '3-5,9'; anything else is an error, and so are more than `most` pages."""
    found: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        low, high = (int(m[1]), int(m[2] or m[1])) if m else (0, 0)
        if not 1 <= low <= high:
            raise ValueError(f"bad pages: {part!r}")
        found |= set(range(low, min(high, low + most) + 1))
    if not 1 <= len(found) <= most:
        raise ValueError(f"1 to {most} pages are read at once")
    return sorted(found)


def page_range(pages: DataFrame, spec: str) -> DataFrame:
    return pages.where(F.col("page_number").isin(page_set(spec)))


def full_text(chunks: DataFrame, keys: list[str], index: str = "chunk_index", content: str = "content", most: int | None = 2000) -> DataFrame:
    """Each file's text from its chunks in number order, with chunk_count and total_chars; empty chunks are left out. Of
    a file the first `most` chunks are read (None: all), and truncated says whether there are more."""
    part = F.struct(lenient_int(F.col(index), 0).alias("n"), F.col(content).alias("t"))
    g = chunks.where(F.coalesce(F.col(content), F.lit("")) != "").groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("all"))
    g = g.withColumn("p", F.slice("all", 1, most) if most is not None else F.col("all"))
    g = g.withColumns({"chunk_count": F.size("p").cast("long"), "full_text": strip(F.array_join(F.transform("p", lambda x: x["t"]), "\n"))})
    return g.withColumns({"total_chars": F.length("full_text").cast("long"), "truncated": F.size("all") > F.size("p")}).drop("p", "all")


def literal(pattern: str) -> str:
    """A regular expression for the text itself, in Java's and Python's dialect."""
    return re.sub(r"([^\w\s]|_)", r"\\\1", pattern) if not re.search(r"[^\x00-\x7f]", pattern) else re.escape(pattern)


def match_counts(pages: DataFrame, pattern: str, regex: bool = False, case_sensitive: bool = False, limit: int = 20) -> DataFrame:
    """Pages with n_matches and `scanned`: whether a search that stops at 5 times the limit gets to the page."""
    java = ("" if case_sensitive else "(?iu)") + (pattern if regex else literal(pattern))
    p = pages.withColumn("n_matches", F.coalesce(F.regexp_count("content", F.lit(java)), F.lit(0)).cast("long"))
    before = Window.partitionBy(*FILE).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("scanned", F.coalesce(F.sum("n_matches").over(before), F.lit(0)) < 5 * limit)


_MATCH = "line int, match string, snippet string, context string, n_in_page int"


def found_in(compiled: re.Pattern, text: str, context: int = 0, radius: int = 80) -> Iterator[tuple]:
    """Line from 1, match, snippet, lines around and number of each place of a pattern in a text."""
    lines, n, line, at = text.split("\n"), 0, 1, 0
    for m in compiled.finditer(text):
        n += 1
        line, at = line + text.count("\n", at, m.start()), m.start()
        left, right = max(0, m.start() - radius), min(len(text), m.end() + radius)
        snippet = ("…" if left else "") + text[left:right].replace("\n", " ").strip() + ("…" if right < len(text) else "")
        yield line, m[0], snippet, "\n".join(lines[max(0, line - 1 - context) : line + context]) if context else "", n


def matches(pages: DataFrame, pattern: str, regex: bool = False, case_sensitive: bool = False, context: int = 0, limit: int = 20, radius: int = 80) -> DataFrame:
    """Where a pattern occurs: page, line from 1 (lines end at line feeds), match, snippet and `context` lines around; of
    each file the first `limit`, in order, and `total`, the count up to where the search stops at 5 times the limit."""
    compiled = re.compile(pattern if regex else re.escape(pattern), 0 if case_sensitive else re.IGNORECASE)
    rest = [c for c in pages.columns if c != "content"]
    schema = StructType([*pages.select(*rest).schema.fields, *StructType.fromDDL(_MATCH).fields])

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(stream, "content"):
            hits = [list(found_in(compiled, t, context, radius)) if isinstance(t, str) else [] for t in batch["content"]]
            rows = batch[rest].loc[batch.index.repeat([len(h) for h in hits])].reset_index(drop=True)
            yield pd.concat([rows, pd.DataFrame([x for h in hits for x in h], columns=["line", "match", "snippet", "context", "n_in_page"], index=rows.index)], axis=1)

    rows = pages.select(*rest, "content").mapInPandas(run, schema)
    per = Window.partitionBy(*FILE).orderBy("page_number", "n_in_page")
    rows = rows.withColumn("seq", F.row_number().over(per))
    # the page on which the count passes 5 times the limit is counted whole, those after it not at all
    first = F.min("seq").over(Window.partitionBy(*FILE, "page_number"))
    rows = rows.withColumn("_before", first - 1).where(F.col("_before") < 5 * limit)
    return rows.withColumn("total", F.count("*").over(Window.partitionBy(*FILE))).where(F.col("seq") <= limit).drop("_before", "n_in_page")


def within_budget(rows: DataFrame, group: list[str], order: list[str], content: str, budget: int) -> DataFrame:
    """Texts of a group in order, cut where their running length (cut marks included, as they count) passes the budget.

    What is used before a text depends on the texts before it only through their lengths: up to the first text that does
    not fit all are whole; that one is cut, and then nothing is left. So running sums do, without a fold."""
    w = Window.partitionBy(*group).orderBy(*order)
    n = F.length(content)
    r = rows.withColumn("_used", F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = F.lit(budget) - F.col("_used")
    text = F.when(left <= 0, "").when(n > left, F.concat(F.substring(F.col(content), F.lit(1), left.cast("int")), F.lit(CUT_MARK))).otherwise(F.col(content))
    return r.withColumns({"truncated": (left <= 0) | (n > left), content: text}).drop("_used")


def glossaries(files: DataFrame, pages: DataFrame, budget: int = 30_000) -> DataFrame:
    """Each tenant's glossary files by name, with their compact text if there is one (column glossary_compact) and else
    their pages, within a budget of characters."""
    f = files.where(F.col("doc_role") == "glossary").select("tenant_id", F.col("source_ref").alias("file_id"), "file_name", *([c for c in ("glossary_compact",) if c in files.columns]))
    body = strip(F.col("content"))
    p = pages.groupBy(*FILE).agg(F.count("*").alias("n_pages"), F.array_sort(F.collect_list(F.when(body != "", F.struct("page_number", body.alias("t"))))).alias("p"))
    j = f.join(p, FILE, "left")
    raw = F.coalesce(F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"), F.lit(""))
    compact = F.nullif(strip(F.col("glossary_compact")), F.lit("")) if "glossary_compact" in files.columns else F.lit(None).cast("string")
    j = j.withColumns({"content": F.coalesce(compact, raw), "source": F.when(compact.isNotNull(), "compact").otherwise("raw_pages"), "n_pages": F.coalesce("n_pages", F.lit(0))})
    return within_budget(j.drop("p", "glossary_compact"), ["tenant_id"], ["file_name", "file_id"], "content", budget)


def page_batches(pages: DataFrame, size: int = 5, limit: int = 8000) -> DataFrame:
    """Batches of `size` pages of each file in page order: first and last page, label, count and the text for a model,
    each page clipped and under a heading, blank ones left out."""
    w = Window.partitionBy(*FILE).orderBy("page_number")
    p = pages.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    body = clipped(F.col("content"), limit, CLIP_MARK)
    part = F.when(strip(body) != "", F.struct("page_number", F.concat(F.lit("## p."), F.col("page_number").cast("string"), F.lit("\n\n"), body).alias("t")))
    g = p.groupBy(*FILE, "batch").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count("*").alias("n_pages"), F.array_sort(F.collect_list(part)).alias("p"))
    label = F.when(F.col("n_pages") > 1, F.concat(F.col("first_page").cast("string"), F.lit("-"), F.col("last_page").cast("string"))).otherwise(F.col("first_page").cast("string"))
    return g.withColumns({"label": label, "batch_text": F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")}).drop("p")


def abstract_pages(pages: DataFrame, first: int = 3, last: int = 1) -> DataFrame:
    """The first and last pages of each file, all if there are no more than that, with n_pages, the pages not blank."""
    by = Window.partitionBy(*FILE)
    p = pages.withColumns({"_r": F.row_number().over(by.orderBy("page_number")), "_n": F.count("*").over(by), "n_pages": F.count_if(strip(F.col("content")) != "").over(by)})
    return p.where((F.col("_r") <= first) | (F.col("_r") > F.col("_n") - last)).drop("_r", "_n")


def mapped_batches(batches: DataFrame, model: Column, kind: str = "summary") -> DataFrame:
    """Batches with a model's cleaned answer and whether there is one. model: a column over batch_text."""
    from ..functions.text import cleaned_output

    return batches.withColumn("answer", cleaned_output(model, kind)).withColumn("ok", F.col("answer") != "")


def assembled(batches: DataFrame, title: str = "file_id", limit: int = 200_000) -> DataFrame:
    """Each file's answers under headings, in batch order: text, ok_batches, n_batches, failed (the labels of batches
    without an answer), complete (whether all were answered) and truncated (whether text was cut at `limit` characters)."""
    part = F.when(F.col("ok"), F.struct("batch", F.concat(F.lit("### p."), "label", F.lit("\n\n"), "answer").alias("t")))
    g = batches.groupBy(*FILE).agg(F.count("*").alias("n_batches"), F.count_if("ok").alias("ok_batches"), F.array_sort(F.collect_list(part)).alias("p"), F.transform(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("batch", "label")))), lambda x: x["label"]).alias("failed"))
    text = F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"))
    return g.withColumns({"text": F.substring(text, 1, limit), "truncated": F.length(text) > limit, "complete": F.col("ok_batches") == F.col("n_batches")}).drop("p")


def cached(wanted: DataFrame, cache: DataFrame, batch_size: int) -> tuple[DataFrame, DataFrame]:
    """Files whose cached result (tenant_id, file_id, batch_size, ...) was made with this batch size, and the others."""
    hit = cache.where(F.col("batch_size") == batch_size)
    return wanted.join(hit, FILE), wanted.join(hit, FILE, "left_anti")
