"""Queries of chunking, navigation, page batches and text functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import navigate as N
from ..operators import profile as P
from ..session import table
from . import views as V

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))


def fixed_token(spark: SparkSession, sf: str) -> DataFrame:
    return V.chunks(spark, sf).select("file_id", "chunk_index", "total_chunks", "content")


FIXED_SQL = f"WITH {V.chunks_sql()} SELECT file_id, chunk_index, total_chunks, content FROM kb_chunks"


def recursive(spark: SparkSession, sf: str) -> DataFrame:
    return C.recursive_chunks(_docs(spark, sf)).select("file_id", "chunk_index", "total_chunks", "start_index", "content")


def semantic(spark: SparkSession, sf: str) -> DataFrame:
    return C.semantic_chunks(_docs(spark, sf)).select("file_id", "chunk_index", "total_chunks", "start_index", "content")


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a heading before every line: level by the line's number."""
    line = F.transform(F.split("content", "\n"), lambda x, i: F.concat(F.repeat(F.lit("#"), (i % 4 + 1).cast("int")), F.lit(" Part "), i.cast("string"), F.lit("\n"), x))
    return _docs(spark, sf).withColumn("content", F.array_join(line, "\n"))


def markdown_header(spark: SparkSession, sf: str) -> DataFrame:
    return C.header_chunks(_markdown(spark, sf)).select("file_id", "chunk_index", "section_path", "start_index", "content")


def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return C.hybrid_chunks(_markdown(spark, sf)).select("file_id", "chunk_index", "section_path", "start_index", "content")


def bbox_union(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of chunks of 150 characters over blocks of 60."""
    d = table(spark, sf, "documents").where("n_chars > 0").select("doc_id", "n_chars")
    i = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_chars") / 60).cast("int") - 1))
    blocks = d.select("doc_id", i.alias("i")).select("doc_id", (F.col("i") * 60).alias("offset"), F.lit(60).alias("length"), (F.col("i") % 7).cast("double").alias("x0"), F.col("i").cast("double").alias("y0"), (F.col("i") % 7 + 10).cast("double").alias("x1"), (F.col("i") + 1).cast("double").alias("y1"))
    chunks = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_chars") / 150).cast("int") - 1)).alias("chunk_index"))
    chunks = chunks.withColumns({"start": F.col("chunk_index") * 150, "end": (F.col("chunk_index") + 1) * 150})
    return C.boxes_by_join(chunks, blocks, ["doc_id"]).drop("n_blocks")


BBOX_SQL = """WITH b AS (SELECT doc_id, i, i * 60 AS o FROM (SELECT doc_id, unnest(range(ceil(n_chars / 60.0)::BIGINT)) AS i FROM documents)),
c AS (SELECT doc_id, unnest(range(ceil(n_chars / 150.0)::BIGINT)) AS chunk_index FROM documents)
SELECT c.doc_id, chunk_index::INT AS chunk_index, min(i % 7)::DOUBLE AS x0, min(i)::DOUBLE AS y0, max(i % 7 + 10)::DOUBLE AS x1, max(i + 1)::DOUBLE AS y1
FROM c JOIN b ON b.doc_id = c.doc_id AND b.o < (chunk_index + 1) * 150 AND b.o + 60 > chunk_index * 150 GROUP BY c.doc_id, chunk_index"""


def by_indices(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of every file by number, given as text; what is no number matches none."""
    wanted = [T.lenient_int(F.lit(x), -1) for x in ("0", "2", "x", "10")]
    return V.chunks(spark, sf).where(F.col("chunk_index").cast("int").isin(*wanted)).select("file_id", "chunk_index", "content")


INDICES_SQL = f"WITH {V.chunks_sql()} SELECT file_id, chunk_index, content FROM kb_chunks WHERE chunk_index IN (0, 2, 10)"


def chunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with a title (its section or else its first 50 characters) and page."""
    c = V.chunks(spark, sf).withColumn("section_title", F.when(F.col("chunk_index") % 2 == 0, F.concat(F.lit("s"), F.col("chunk_index").cast("string"))).otherwise(""))
    title = F.coalesce(F.nullif("section_title", F.lit("")), F.substring("content", 1, 50))
    return c.select("file_id", "chunk_index", title.alias("title"), (F.col("chunk_index") + 1).alias("page_number"))


METADATA_SQL = f"WITH {V.chunks_sql()} SELECT file_id, chunk_index, CASE WHEN chunk_index % 2 = 0 THEN 's' || chunk_index ELSE substr(content, 1, 50) END AS title, chunk_index + 1 AS page_number FROM kb_chunks"


def rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    p = V.pages(spark, sf).withColumn("chunk_index", (F.col("page_number") - 1).cast("string"))
    return N.full_text(p, ["file_id"], most=None).select("file_id", "chunk_count", "total_chars", "full_text")


REBUILT_SQL = f"""WITH {V.PAGES}, g AS (SELECT file_id, count(*) AS chunk_count, trim(string_agg(content, chr(10) ORDER BY page_number), {_WS}) AS full_text FROM kb_pages WHERE content <> '' GROUP BY file_id)
SELECT file_id, chunk_count, length(full_text)::BIGINT AS total_chars, full_text FROM g"""


def grep_counts(spark: SparkSession, sf: str) -> DataFrame:
    return N.match_counts(V.pages(spark, sf), "th", limit=5).where("n_matches > 0").select("file_id", "page_number", "n_matches", "scanned")


GREP_SQL = f"""WITH {V.PAGES}, n AS (SELECT file_id, page_number, (length(lower(content)) - length(replace(lower(content), 'th', '')))::BIGINT // 2 AS n_matches FROM kb_pages),
s AS (SELECT *, coalesce(sum(n_matches) OVER (PARTITION BY file_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 25 AS scanned FROM n)
SELECT file_id, page_number, n_matches, scanned FROM s WHERE n_matches > 0"""


def grep_matches(spark: SparkSession, sf: str) -> DataFrame:
    return N.matches(V.pages(spark, sf), "th", context=1, limit=20).select("file_id", "page_number", "line", "seq", "total", "match", "snippet", "context")


MATCHES_SQL = f"""WITH {V.PAGES}, p AS (SELECT *, string_split(lower(content), 'th') AS parts, string_split(content, chr(10)) AS lines FROM kb_pages),
m AS (SELECT *, unnest(range(1, len(parts))) AS i FROM p),
h AS (SELECT *, list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + 2 * (i - 1) AS "at" FROM m),
n AS (SELECT *, 1 + length(substr(content, 1, "at")) - length(replace(substr(content, 1, "at"), chr(10), '')) AS line, row_number() OVER (PARTITION BY tenant_id, file_id ORDER BY page_number, i) AS seq FROM h),
b AS (SELECT *, min(seq) OVER (PARTITION BY tenant_id, file_id, page_number) - 1 AS before FROM n),
t AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, file_id) AS total, greatest(0, "at" - 80) AS lo FROM b WHERE before < 100)
SELECT file_id, page_number, line::INT AS line, seq::INT AS seq, total, substr(content, "at" + 1, 2) AS "match",
CASE WHEN lo > 0 THEN '…' ELSE '' END || trim(replace(substr(content, lo + 1, "at" + 82 - lo), chr(10), ' '), {_WS}) || CASE WHEN "at" + 82 < length(content) THEN '…' ELSE '' END AS snippet,
array_to_string(lines[greatest(1, line - 1):line + 1], chr(10)) AS context FROM t WHERE seq <= 20"""


def page_read(spark: SparkSession, sf: str) -> DataFrame:
    return N.page_range(V.pages(spark, sf), "1-2, 4").select("file_id", "page_number", "content")


READ_SQL = f"WITH {V.PAGES} SELECT file_id, page_number, content FROM kb_pages WHERE page_number IN (1, 2, 4)"


def glossary_inline(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as glossaries, each tenant within 20 000 characters."""
    p = V.pages(spark, sf)
    files = p.select("tenant_id", F.col("file_id").alias("source_ref"), F.concat(F.lit("g"), F.lpad("file_id", 6, "0")).alias("file_name"), F.lit("glossary").alias("doc_role")).distinct()
    return N.glossaries(files, p, 20_000).select("tenant_id", "file_name", "n_pages", "truncated", "content")


GLOSSARY_SQL = f"""WITH {V.PAGES}, g AS (SELECT tenant_id, 'g' || lpad(file_id, 6, '0') AS file_name, count(*) AS n_pages, coalesce(string_agg(trim(content, {_WS}), chr(10) || chr(10) ORDER BY page_number) FILTER (WHERE trim(content, {_WS}) <> ''), '') AS c FROM kb_pages GROUP BY tenant_id, file_id),
r AS (SELECT *, 20000 - coalesce(sum(length(c)) OVER (PARTITION BY tenant_id ORDER BY file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM g)
SELECT tenant_id, file_name, n_pages, remaining <= 0 OR length(c) > remaining AS truncated, CASE WHEN remaining <= 0 THEN '' WHEN length(c) > remaining THEN substr(c, 1, remaining::BIGINT) || chr(10) || '…(truncated)' ELSE c END AS content FROM r"""


def batches(spark: SparkSession, sf: str) -> DataFrame:
    return N.page_batches(V.pages(spark, sf), 5).select("file_id", "batch", "first_page", "last_page", "n_pages", "label", "batch_text")


BATCHES_SQL = f"""WITH {V.PAGES}, n AS (SELECT *, ((row_number() OVER (PARTITION BY tenant_id, file_id ORDER BY page_number) - 1) // 5)::INT AS batch, CASE WHEN length(content) > 8000 THEN substr(content, 1, 8000) || chr(10) || '[...해당 페이지 본문 길이 초과로 일부 생략...]' ELSE content END AS body FROM kb_pages)
SELECT file_id, batch, min(page_number) AS first_page, max(page_number) AS last_page, count(*) AS n_pages, CASE WHEN count(*) > 1 THEN min(page_number) || '-' || max(page_number) ELSE min(page_number)::VARCHAR END AS label,
coalesce(string_agg('## p.' || page_number || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY page_number) FILTER (WHERE trim(body, {_WS}) <> ''), '') AS batch_text FROM n GROUP BY file_id, batch"""


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Batches through a stand-in model (the whole batch on one line, behind a label), cleaned and assembled."""
    b = N.page_batches(V.pages(spark, sf), 3)
    b = N.mapped_batches(b, F.concat(F.lit("Summary: "), F.regexp_replace("batch_text", r"\s+", " ")))
    return N.assembled(b).select("file_id", "n_batches", "ok_batches", "complete", "truncated", "text")


SUMMARY_SQL = f"""WITH {V.PAGES}, n AS (SELECT *, ((row_number() OVER (PARTITION BY tenant_id, file_id ORDER BY page_number) - 1) // 3)::INT AS batch FROM kb_pages),
b AS (SELECT file_id, batch, count(*) AS c, min(page_number) AS lo, max(page_number) AS hi, trim(regexp_replace(string_agg('## p.' || page_number || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY page_number) FILTER (WHERE trim(content, {_WS}) <> ''), '\\s+', ' ', 'g')) AS answer FROM n GROUP BY file_id, batch)
SELECT file_id, count(*) AS n_batches, count(*) FILTER (WHERE answer <> '') AS ok_batches, count(*) = count(*) FILTER (WHERE answer <> '') AS complete, false AS truncated,
'## ' || file_id || chr(10) || chr(10) || string_agg('### p.' || CASE WHEN c > 1 THEN lo || '-' || hi ELSE lo::VARCHAR END || chr(10) || chr(10) || answer, chr(10) || chr(10) ORDER BY batch) AS text FROM b GROUP BY file_id"""


def abstracts(spark: SparkSession, sf: str) -> DataFrame:
    return N.abstract_pages(V.pages(spark, sf)).select("file_id", "page_number", "n_pages")


ABSTRACT_SQL = f"""WITH {V.PAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY page_number) AS r, count(*) OVER (PARTITION BY file_id) AS m, count(*) FILTER (WHERE trim(content, {_WS}) <> '') OVER (PARTITION BY file_id) AS n_pages FROM kb_pages)
SELECT file_id, page_number, n_pages FROM n WHERE r <= 3 OR r > m - 1"""


def languages(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.lit("document").alias("kind"), T.language(F.col("text")).alias("language"))
    c = table(spark, sf, "conversations").select(F.lit("turn").alias("kind"), T.language(F.concat(F.when(F.col("turn") == 0, "안녕 ").otherwise(""), "text")).alias("language"))
    return d.unionByName(c).groupBy("kind", "language").agg(F.count("*").alias("n"))


LANGUAGE_SQL = "SELECT kind, CASE WHEN regexp_matches(t, '[가-힣]') THEN 'ko' ELSE 'en' END AS language, count(*) AS n FROM (SELECT 'document' AS kind, text AS t FROM documents UNION ALL SELECT 'turn', CASE WHEN turn = 0 THEN '안녕 ' ELSE '' END || text FROM conversations) GROUP BY ALL"


def clean_output(spark: SparkSession, sf: str) -> DataFrame:
    """Turns dressed as model answers, cleaned, and their lines as a list of at most three items."""
    c = table(spark, sf, "conversations")
    body = F.regexp_replace("text", r"\s+", " ")
    dressed = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("turn") % 4 == 1, F.concat(F.lit('"'), body, F.lit('"'))).when(F.col("turn") % 4 == 2, F.concat(F.lit("요약: "), body)).otherwise(F.concat(F.lit("1. "), body, F.lit("\n- two\n\n* three\n4) four")))
    out = T.cleaned_output(dressed, "abstract")
    return c.select("conv_id", "turn", out.alias("cleaned"), F.array_join(T.numbered_list(out, 3), "|").alias("items"))


CLEAN_SQL = """WITH b AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations),
c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN '1. ' || t || chr(10) || '- two' || chr(10) || chr(10) || '* three' || chr(10) || '4) four' ELSE t END AS cleaned, t FROM b)
SELECT conv_id, turn, cleaned, CASE turn % 4 WHEN 3 THEN CASE WHEN t = '' THEN '' ELSE t || '|' END || 'two|three' ELSE t END AS items FROM c"""


def sanitized(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "pages").select(F.col("url").alias("path"))
    return d.select("path", T.safe_path(F.col("path")).alias("safe"))


SANITIZE_SQL = r"""SELECT url AS path, array_to_string(list_transform(list_filter(string_split(url, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_full_match(x, '[a-zA-Z0-9._\-]+') THEN x
  WHEN regexp_full_match(x, '[\x00-\x7f]*') AND trim(regexp_replace(x, '[^a-zA-Z0-9._\-]+', '-', 'g'), '-') <> '' THEN trim(regexp_replace(x, '[^a-zA-Z0-9._\-]+', '-', 'g'), '-') ELSE 'f-' || substr(sha1(x), 1, 10) END), '/') AS safe FROM pages"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    m = F.from_json("props", "map<string,string>")
    return e.where("props is not null").select("event_id", T.key_value_lines(m).alias("content"))


RECORD_SQL = "SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS content FROM events WHERE props IS NOT NULL"


def windows(spark: SparkSession, sf: str) -> DataFrame:
    p = P.qa_windows(V.pages(spark, sf), ["file_id"]).select(F.concat(F.lit("p"), "file_id").alias("file"), "window_index", F.array_join(F.transform("source_pages", lambda x: x.cast("string")), ",").alias("source_pages"), F.length("text").cast("long").alias("n_chars"))
    d = P.text_windows(table(spark, sf, "documents").select("doc_id", "text"), "text").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), "window_index", F.lit("").alias("source_pages"), F.length("text").cast("long").alias("n_chars"))
    return p.unionByName(d)


WINDOW_SQL = f"""WITH {V.PAGES}, n AS (SELECT *, ((row_number() OVER (PARTITION BY file_id ORDER BY page_number) - 1) // 3)::INT AS w FROM kb_pages)
SELECT 'p' || file_id AS file, w AS window_index, string_agg(page_number::VARCHAR, ',' ORDER BY page_number) AS source_pages, length(string_agg(content, chr(10) || chr(10) ORDER BY page_number))::BIGINT AS n_chars FROM n GROUP BY file_id, w
UNION ALL SELECT 'd' || doc_id, i::INT, '', length(substr(text, i * 6000 + 1, 6000))::BIGINT FROM (SELECT doc_id, text, unnest(range(ceil(length(text) / 6000.0)::BIGINT)) AS i FROM documents)"""


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    """A prompt's context from all chunks of each file, whole."""
    c = V.chunks(spark, sf)
    block = T.context_block(F.col("chunk_index") + 1, F.col("file_id"), F.lit(None), F.lit(None), F.col("chunk_index"), F.col("content"))
    g = c.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", block.alias("t")))).alias("p"))
    return g.select("file_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("context"))


CONTEXT_SQL = f"""WITH {V.chunks_sql()} SELECT file_id, string_agg('[문서 ' || (chunk_index + 1) || ' | 파일: ' || file_id || ' | 청크: ' || chunk_index || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY chunk_index) AS context
FROM kb_chunks GROUP BY file_id"""

QUERIES = {
    "chunk_fixed_token": (fixed_token, FIXED_SQL),
    "chunk_recursive": (recursive, None),
    "chunk_semantic_fallback": (semantic, None),
    "chunk_markdown_header": (markdown_header, None),
    "chunk_hybrid": (hybrid, None),
    "chunk_bbox_union": (bbox_union, BBOX_SQL),
    "chunks_by_indices": (by_indices, INDICES_SQL),
    "chunks_metadata": (chunk_metadata, METADATA_SQL),
    "full_text_rebuild": (rebuilt, REBUILT_SQL),
    "grep_literal_counts": (grep_counts, GREP_SQL),
    "grep_matches": (grep_matches, MATCHES_SQL),
    "page_range_read": (page_read, READ_SQL),
    "glossary_inline_budget": (glossary_inline, GLOSSARY_SQL),
    "page_batches": (batches, BATCHES_SQL),
    "batch_summaries": (summaries, SUMMARY_SQL),
    "abstract_pages": (abstracts, ABSTRACT_SQL),
    "detect_language": (languages, LANGUAGE_SQL),
    "clean_llm_output": (clean_output, CLEAN_SQL),
    "sanitize_paths": (sanitized, SANITIZE_SQL),
    "record_to_text": (records, RECORD_SQL),
    "qa_windows": (windows, WINDOW_SQL),
    "context_blocks": (contexts, CONTEXT_SQL),
}
