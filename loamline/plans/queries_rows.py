"""Queries that hold the row helpers (catalog rules, text formats, answers of models, image rows, upserts) to SQL over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import profile as P
from ..operators import store as W
from ..session import table
from ..sources import files as S
from . import views as V



def _i() -> F.Column:
    return F.col("doc_id")


def supported_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a known type, and those of an unknown one with a known extension."""
    f = V.files(spark, sf).withColumns({"mime_type": F.when(_i() % 7 == 0, "application/octet-stream").otherwise(F.col("mime_type")), "file_name": F.when(_i() % 14 == 0, F.concat("file_name", F.lit(".PDF"))).otherwise(F.col("file_name"))})
    return C.supported(f, ["text/plain", "text/csv"], ["pdf", "docx"]).select("source_ref", "file_name", "mime_type")


SUPPORTED_SQL = f"""WITH {V.FILES} SELECT source_ref, CASE WHEN doc_id % 14 = 0 THEN file_name || '.PDF' ELSE file_name END AS file_name, CASE WHEN doc_id % 7 = 0 THEN 'application/octet-stream' ELSE mime_type END AS mime_type
FROM kb_files WHERE (doc_id % 7 <> 0 AND mime_type = 'text/plain') OR doc_id % 14 = 0"""


def deletable_files(spark: SparkSession, sf: str) -> DataFrame:
    """Who may delete what: administrators all, others the uploads of their own."""
    f = V.files(spark, sf)
    may = C.may_delete(F.when(_i() % 3 > 0, _i() % 11 == 0), F.col("source_type"), F.when(_i() % 5 > 0, F.col("tenant_id")), "en")
    return f.select("source_ref", may.alias("may"))


DELETABLE_SQL = f"WITH {V.FILES} SELECT source_ref, (doc_id % 3 > 0 AND doc_id % 11 = 0) OR (source_type = 'upload' AND doc_id % 5 > 0 AND tenant_id = 'en') AS may FROM kb_files"


def renamed_file(spark: SparkSession, sf: str) -> DataFrame:
    """A file with another id and name, in every table that names it."""
    tables = {"files": V.files(spark, sf).select("source_ref", "file_name"), "ledger": V.ledger(spark, sf).select(F.col("file_id"), F.lit("old.txt").alias("file_name")), "chunks": V.chunks(spark, sf).select("file_id")}
    found = C.renamed_file(tables, "4", "n4", "new.txt")
    rows = [df.select(F.lit(name).alias("target"), F.col(df.columns[0]).alias("id"), (F.col("file_name") if "file_name" in df.columns else F.lit("")).alias("file_name")) for name, df in found.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("target", "id", "file_name").agg(F.count("*").alias("n"))


RENAMED_SQL = f"""WITH {V.FILES}, {V.LEDGER}, {V.chunks_sql()}, r AS (SELECT 'files' AS target, source_ref AS id, file_name FROM kb_files UNION ALL SELECT 'ledger', file_id, 'old.txt' FROM kb_ledger UNION ALL SELECT 'chunks', file_id, '' FROM kb_chunks)
SELECT target, CASE WHEN id = '4' THEN 'n4' ELSE id END AS id, CASE WHEN id = '4' AND target <> 'chunks' THEN 'new.txt' ELSE file_name END AS file_name, count(*) AS n FROM r GROUP BY ALL"""


def form_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The report and slide fields of work items by their forms."""
    c = table(spark, sf, "customer")
    items = c.select("c_custkey", F.col("c_nationkey").alias("form_id"), F.lower("c_mktsegment").alias("tenant_id"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("balance"), F.col("c_acctbal").cast("string"), F.lit("note"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))).alias("output"))
    field = lambda key, kind: F.struct(F.lit(key).alias("key"), F.lit(kind).alias("type"))
    forms = table(spark, sf, "nation").where("n_nationkey % 4 <> 3").select(F.col("n_nationkey").alias("form_id"), F.lit("building").alias("tenant_id"), F.when(F.col("n_nationkey") % 2 == 0, F.array(field("name", "report"), field("balance", "text"))).otherwise(F.array(field("note", "slide"), field("gone", "report"))).alias("fields"))
    return S.report_fields(items, forms).select("c_custkey", F.col("field.key").alias("key"), "content")


FORMS_SQL = """SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'name' ELSE 'note' END AS "key", CASE WHEN c_nationkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS content
FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 4 <> 3 AND (c_nationkey % 2 = 0 OR c_custkey % 2 = 0)"""


def strategy_grid(spark: SparkSession, sf: str) -> DataFrame:
    """All combinations of the strategies that have scores."""
    s = V.scores(spark, sf)
    return P.grid(s.select("chunker").distinct(), s.select("retriever").distinct())


GRID_SQL = f"WITH {V.SCORES} SELECT * FROM (SELECT DISTINCT chunker FROM kb_scores), (SELECT DISTINCT retriever FROM kb_scores)"


def text_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Texts on one line, masked, as collection and download names, with bracketed formulas, and keys."""
    d = table(spark, sf, "documents")
    name = F.concat_ws(" ", "lang", "source", _i().cast("string"))
    page, image = T.image_numbers(F.concat(F.lit("f_page"), (_i() % 9).cast("string"), F.when(_i() % 2 == 0, "_img").otherwise("_x"), (_i() % 7).cast("string")))
    ascii_name, encoded = T.download_name(F.concat(name, F.lit(' "é".txt')))
    return d.select(
        "doc_id", F.md5(T.one_line(F.col("text"), 120).cast("binary")).alias("line"), T.masked(F.substring(F.col("source"), 1, (_i() % 5).cast("int"))).alias("short"), T.masked(F.concat("lang", "source", F.lit("-secret"))).alias("long"),
        T.collection_name(name).alias("collection"), T.highlight_key(name, F.col("lang")).alias("key"), ascii_name.alias("ascii_name"), encoded.alias("encoded"), T.bracketed_math(F.concat(name, F.lit(" $x+1$ and $"))).alias("math"), page.alias("page"), image.alias("image"),
    )


FORMATS_SQL = r"""WITH n AS (SELECT *, lang || ' ' || source || ' ' || doc_id AS name, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS l, substr(source, 1, (doc_id % 5)::INT) AS s FROM documents)
SELECT doc_id, md5(CASE WHEN length(l) > 120 THEN substr(l, 1, 120) || '…' ELSE l END) AS line, CASE WHEN s = '' THEN '' WHEN length(s) <= 8 THEN '***' ELSE left(s, 4) || '***' || right(s, 4) END AS short, left(lang || source, 4) || '***' || 'cret' AS long,
  replace(name, ' ', '_') AS collection, sha1(name || '|' || lang) AS "key", name || ' ___.txt' AS ascii_name, replace(name, ' ', '%20') || '%20%22%C3%A9%22.txt' AS encoded, name || ' [x+1] and $' AS math,
  (doc_id % 9)::INT AS page, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 7)::INT END AS image FROM n"""


def judged_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Scores and reasons in a judge's noisy answers, and scores without NaN."""
    d = table(spark, sf, "documents")
    body = F.to_json(F.struct((_i() % 9 - 1).alias("score"), F.col("source").alias("reason")))
    said = F.when(_i() % 4 == 0, "no answer").otherwise(F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n``` done")))
    score, reason = T.judged(said)
    number = F.when(_i() % 3 == 0, F.lit(float("nan"))).when(_i() % 3 == 1, F.lit(float("-inf"))).otherwise(_i() / 2)
    return d.select("doc_id", score.alias("score"), reason.alias("reason"), T.coerced(number).alias("number"))


JUDGED_SQL = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE greatest(0, least(5, doc_id % 9 - 1)) END::INT AS score, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS reason,
  CASE WHEN doc_id % 3 = 2 THEN doc_id / 2 END::DOUBLE AS number FROM documents"""


def question_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Questions and answers in noisy lists; those without either go."""
    d = table(spark, sf, "documents")
    one = lambda q, a, e: F.struct(q.alias("question"), a.alias("answer"), e.alias("expected_answer"))
    text = F.coalesce(F.substring(F.col("text"), 1, 40), F.lit(""))
    items = F.array(one(F.col("source"), text, F.lit("x")), one(F.lit(" why? "), F.lit(""), F.col("lang")), one(F.lit(""), F.lit("lost"), F.lit("lost")))
    said = F.when(_i() % 6 == 0, "none").otherwise(F.concat(F.lit("Here: "), F.to_json(items), F.lit(" ok")))
    return d.select("doc_id", F.posexplode(T.question_answers(said)).alias("n", "p")).select("doc_id", "n", "p.question", F.md5(F.col("p.answer").cast("binary")).alias("answer"))


PAIRS_SQL = """WITH a AS (SELECT *, trim(substr(coalesce(text, ''), 1, 40), ' ') AS t FROM documents WHERE doc_id % 6 <> 0),
p AS (SELECT doc_id, 0 AS i, source AS question, CASE WHEN coalesce(text, '') = '' THEN 'x' ELSE t END AS answer FROM a UNION ALL SELECT doc_id, 1, 'why?', lang FROM a)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS n, question, md5(answer) AS answer FROM p WHERE answer <> ''"""


def _image_chunks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    one = lambda image, said: F.struct(F.concat(F.lit("i"), image.cast("string")).alias("image_id"), said.alias("analysis"), F.concat(F.lit("u"), image.cast("string")).alias("image_url"))
    chunks = table(spark, sf, "documents").select(F.col("lang").alias("tenant_id"), _i().cast("string").alias("id"), (_i() % 4).cast("int").alias("chunk_index"), F.array(one(F.floor(_i() / 4), F.concat(F.lit(" said of "), _i().cast("string"))), one(-_i() - 1, F.lit("not stored"))).alias("image_analysis"))
    n = F.floor(_i() / 4)
    return chunks, table(spark, sf, "documents").where(n % 5 != 4).select(F.concat(F.lit("i"), n.cast("string")).alias("image_id"))


def image_captions(spark: SparkSession, sf: str) -> DataFrame:
    """A caption row for each stored image, from the first chunk that shows it."""
    return W.image_rows(*_image_chunks(spark, sf))[0].select("tenant_id", "document_id", "image_id", "content", "image_url")


def image_links(spark: SparkSession, sf: str) -> DataFrame:
    """A link for each chunk and stored image."""
    return W.image_rows(*_image_chunks(spark, sf))[1]


_IMAGES = "x AS (SELECT lang AS tenant_id, doc_id::VARCHAR AS document_id, doc_id % 4 AS k, 'i' || (doc_id // 4) AS image_id, 'said of ' || doc_id AS content, 'u' || (doc_id // 4) AS image_url, doc_id FROM documents WHERE (doc_id // 4) % 5 <> 4)"
CAPTIONS_SQL = f"""WITH {_IMAGES} SELECT tenant_id, document_id, image_id, content, image_url FROM x QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY k, document_id) = 1"""
LINKS_SQL = f"WITH {_IMAGES} SELECT tenant_id, document_id, image_id, image_url FROM x"


def merged_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk rows after an upsert: prepared new rows in the place of the old ones of their id."""
    d = table(spark, sf, "documents").select(_i().cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.concat("source", F.lit(".txt")).alias("file_name"), F.col("source").alias("source"), _i())
    old = W.prepared(d.where("doc_id % 3 > 0"))
    new = W.prepared(d.where("doc_id % 4 = 0").withColumns({"content": F.concat(F.lit("new\u0000 "), "id"), "source": F.lit(None).cast("string"), "file_name": F.lit("ﬁle.txt")}))
    return W.merged_by_id(old, new).select("id", F.md5(F.col("content").cast("binary")).alias("content"), "file_name", "source")


MERGED_SQL = """SELECT doc_id::VARCHAR AS id, md5(CASE WHEN doc_id % 4 = 0 THEN 'new ' || doc_id ELSE coalesce(text, '') END) AS content, CASE WHEN doc_id % 4 = 0 THEN 'file.txt' ELSE source || '.txt' END AS file_name,
  CASE WHEN doc_id % 4 = 0 THEN 'Unknown' ELSE source END AS source FROM documents WHERE doc_id % 3 > 0 OR doc_id % 4 = 0"""

QUERIES = {
    "supported_files": (supported_files, SUPPORTED_SQL),
    "deletable_files": (deletable_files, DELETABLE_SQL),
    "renamed_file": (renamed_file, RENAMED_SQL),
    "form_fields": (form_fields, FORMS_SQL),
    "strategy_grid": (strategy_grid, GRID_SQL),
    "text_formats": (text_formats, FORMATS_SQL),
    "judged_answers": (judged_answers, JUDGED_SQL),
    "question_pairs": (question_pairs, PAIRS_SQL),
    "image_captions": (image_captions, CAPTIONS_SQL),
    "image_links": (image_links, LINKS_SQL),
    "merged_chunks": (merged_chunks, MERGED_SQL),
}
