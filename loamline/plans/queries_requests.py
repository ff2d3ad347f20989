"""Queries of whole requests, images and catalog changes over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key_value_lines
from ..operators import catalog as C
from ..operators import images as I
from ..operators import requests as R
from ..operators import search as S
from ..operators import store
from ..session import table
from ..sources import files as files_
from . import views as V

_F = f"WITH {V.FILES}"
_NEAR = "round(list_cosine_similarity(i.embedding, q.embedding::DOUBLE[]), 6)"


# --- images ---
def _typed(spark: SparkSession, sf: str) -> DataFrame:
    """The index with types: every third row an image, every third of no type."""
    kind = F.when(F.col("id") % 3 == 0, "image_analysis").when(F.col("id") % 3 == 1, "document")
    return V.index(spark, sf).withColumns({"type": kind, "content": F.concat(F.lit("  caption "), F.col("id").cast("string"), F.lit(" ")), "image_id": F.concat(F.lit("img"), F.col("id").cast("string"))})


def _query(spark: SparkSession, sf: str) -> DataFrame:
    return V.queries(spark, sf, 1).select("query")


def retrieve_images(spark: SparkSession, sf: str) -> DataFrame:
    return I.image_hits(_typed(spark, sf), _query(spark, sf), 10).select("id", "image_id", "image_url", "caption", "score")


IMAGES_SQL = f"WITH {V.INDEX} SELECT i.id, 'img' || i.id AS image_id, '' AS image_url, 'caption ' || i.id AS caption, {_NEAR} AS score FROM kb_index i, embeddings q WHERE q.vec_id = 0 AND i.id % 3 = 0 ORDER BY score DESC, i.id LIMIT 10"


def without_images(spark: SparkSession, sf: str) -> DataFrame:
    return S.top_k(I.without_images(_typed(spark, sf)), _query(spark, sf), 10).select("id", "type", "score")


WITHOUT_SQL = f"WITH {V.INDEX} SELECT i.id, CASE WHEN i.id % 3 = 1 THEN 'document' END AS type, {_NEAR} AS score FROM kb_index i, embeddings q WHERE q.vec_id = 0 AND i.id % 3 <> 0 ORDER BY score DESC, i.id LIMIT 10"


def caption_substitution(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with two image places before its text, one of which has a caption in two documents of three."""
    d = table(spark, sf, "documents")
    content = F.concat(F.lit("__IMAGE_PLACEHOLDER_p1_i0__\n"), F.coalesce("text", F.lit("")), F.lit("\n__IMAGE_PLACEHOLDER_p2_i1__"))
    images = d.where("doc_id % 3 <> 0").select("doc_id", F.lit(2).alias("page"), F.lit(1).alias("image_index"), F.concat(F.lit("a picture of "), F.coalesce("source", F.lit("?"))).alias("analysis"))
    return I.with_captions(d.select("doc_id", content.alias("content")), images, ["doc_id"])


CAPTION_SQL = "SELECT doc_id, chr(10) || coalesce(text, '') || chr(10) || CASE WHEN doc_id % 3 <> 0 THEN '[이미지: 2페이지 이미지2]' || chr(10) || 'a picture of ' || coalesce(source, '?') ELSE '' END AS content FROM documents"


def unique_images(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as chunks: two images each, shared by neighbours, but for every fourth turn, which is an image itself."""
    c = table(spark, sf, "conversations")
    image = lambda n: F.struct(F.concat(F.lit("i"), n.cast("string")).alias("image_id"), F.concat(F.lit("u"), F.col("turn").cast("string")).alias("image_url"))
    own = F.col("turn") % 4 == 3
    c = c.select("conv_id", "turn", F.when(own, F.concat(F.lit("f"), F.col("turn").cast("string"))).alias("file_id"), F.lit(None).cast("string").alias("file_name"), F.when(own, "single").alias("image_url"), F.when(~own, F.array(image(F.floor(F.col("turn") / 2)), image(F.col("turn")))).alias("extracted_images"))
    return I.unique_images(c, ["conv_id"], ["turn"])


UNIQUE_SQL = """WITH i AS (SELECT conv_id, turn, 0 AS p, 'i' || turn // 2 AS image_id, 'u' || turn AS image_url FROM conversations WHERE turn % 4 <> 3 UNION ALL SELECT conv_id, turn, 1, 'i' || turn, 'u' || turn FROM conversations WHERE turn % 4 <> 3
UNION ALL SELECT conv_id, turn, 0, 'f' || turn, 'single' FROM conversations WHERE turn % 4 = 3)
SELECT conv_id, image_id, image_url FROM i QUALIFY row_number() OVER (PARTITION BY conv_id, image_id ORDER BY turn, p) = 1"""


# --- requests ---
def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """The index as a tenant's chunks: of files (vec_id div 10, 10 chunks each, or 40 for every fifth), rooms, processes and scopes."""
    i = F.col("id")
    size = F.when(F.floor(i / 40) % 5 == 0, 40).otherwise(10)
    return V.index(spark, sf).withColumns({"tenant_id": F.lit("t"), "chunk_index": i % size, "file_id": F.floor(i / size) * size, "room_id": F.when(i % 4 == 1, "r1"), "knowledge_scope": F.when(i % 4 == 2, "global"), "proc_inst_id": F.when(i % 4 == 3, "p1"), "source_type": F.when(i % 2 == 0, "process_output"), "drive_folder_id": F.when(i % 3 == 0, "d1")})


_ROWS = f"""{V.INDEX}, r0 AS (SELECT *, CASE WHEN (id // 40) % 5 = 0 THEN 40 ELSE 10 END AS size FROM kb_index),
rows_ AS (SELECT id, chunk_id, embedding, id % size AS chunk_index, (id // size) * size AS file_id, CASE WHEN id % 4 = 1 THEN 'r1' END AS room_id, CASE WHEN id % 4 = 2 THEN 'global' END AS knowledge_scope, CASE WHEN id % 4 = 3 THEN 'p1' END AS proc_inst_id, CASE WHEN id % 2 = 0 THEN 'process_output' END AS source_type, CASE WHEN id % 3 = 0 THEN 'd1' END AS drive_folder_id FROM r0),
h AS (SELECT i.*, {_NEAR} AS score FROM rows_ i, embeddings q WHERE q.vec_id = 0)"""


def retrieve_branches(spark: SparkSession, sf: str) -> DataFrame:
    """One query by each branch of a request; what has precedence is given together with what it overrides."""
    index, query = _rows(spark, sf), _query(spark, sf)
    asked = {
        "files": {"file_ids": [0, 40, 50, 0], "room": "r1", "folder": "d1"},
        "room": {"room": "r1", "process": "p1"},
        "process": {"process": "p1", "all_docs": True},
        "all": {"all_docs": True, "folder": "d1"},
        "outputs": {},
    }
    parts = [R.retrieve(index, query, 5, "t", **options).select(F.lit(name).alias("branch"), F.col("seq").cast("int").alias("seq"), "id") for name, options in asked.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


BRANCHES_SQL = f"""WITH {_ROWS},
f AS (SELECT id, file_id, chunk_index, count(*) OVER (PARTITION BY file_id) AS n, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, id) AS r FROM h WHERE file_id IN (0, 40, 50)),
g AS (SELECT id, 0 AS s, score FROM h WHERE knowledge_scope = 'global' ORDER BY score DESC, id LIMIT 5), m AS (SELECT id, 1 AS s, score FROM h WHERE room_id = 'r1' ORDER BY score DESC, id LIMIT 5),
gm AS (SELECT * FROM (SELECT * FROM g UNION ALL SELECT * FROM m) ORDER BY s, score DESC, id LIMIT 5)
SELECT 'files' AS branch, row_number() OVER (PARTITION BY file_id ORDER BY chunk_index, id)::INT AS seq, id FROM f WHERE n <= 15 OR r <= 5
UNION ALL SELECT 'room', row_number() OVER (ORDER BY s, score DESC, id)::INT, id FROM gm
UNION ALL (SELECT 'process', row_number() OVER (ORDER BY score DESC, id)::INT AS seq, id FROM h WHERE proc_inst_id = 'p1' QUALIFY seq <= 5)
UNION ALL (SELECT 'all', row_number() OVER (ORDER BY score DESC, id)::INT AS seq, id FROM h WHERE drive_folder_id = 'd1' QUALIFY seq <= 5)
UNION ALL (SELECT 'outputs', row_number() OVER (ORDER BY score DESC, id)::INT AS seq, id FROM h WHERE source_type = 'process_output' QUALIFY seq <= 5)"""


def json_path(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where(R.json_equals(F.col("props"), "k", 7)).select("event_id", "event_type")


def summary_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries in batches of 3; half the files have one in the cache, a third of these of another batch size. A batch of a
    page with 'the' is answered by its length."""
    pages = V.pages(spark, sf)
    id_ = F.col("file_id").cast("long")
    cache = pages.select("tenant_id", "file_id").distinct().where(id_ % 2 == 0).withColumns({"batch_size": F.when(id_ % 3 == 0, 4).otherwise(3), "text": F.concat(F.lit("old "), "file_id")})
    model = F.when(F.col("batch_text").contains("the"), F.length("batch_text").cast("string")).otherwise("")
    out, saved = R.summarised(pages, cache, model, 3)
    kept = saved.select("tenant_id", "file_id", F.lit(True).alias("saved"))
    return out.join(kept, ["tenant_id", "file_id"], "left").select("file_id", "from_cache", F.coalesce("saved", F.lit(False)).alias("saved"), "text")


CACHE_SQL = f"""WITH {V.PAGES}, n AS (SELECT *, ((row_number() OVER (PARTITION BY tenant_id, file_id ORDER BY page_number) - 1) // 3)::INT AS batch FROM kb_pages),
b AS (SELECT file_id, batch, count(*) AS c, min(page_number) AS lo, max(page_number) AS hi, coalesce(string_agg('## p.' || page_number || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY page_number) FILTER (WHERE trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''), '') AS t FROM n GROUP BY file_id, batch),
a AS (SELECT *, CASE WHEN contains(t, 'the') THEN length(t)::VARCHAR ELSE '' END AS answer FROM b),
s AS (SELECT file_id, bool_and(answer <> '') AS complete, '## ' || file_id || chr(10) || chr(10) || coalesce(string_agg('### p.' || CASE WHEN c > 1 THEN lo || '-' || hi ELSE lo::VARCHAR END || chr(10) || chr(10) || answer, chr(10) || chr(10) ORDER BY batch) FILTER (WHERE answer <> ''), '') AS text FROM a GROUP BY file_id)
SELECT file_id, file_id::BIGINT % 2 = 0 AND file_id::BIGINT % 3 <> 0 AS from_cache, complete AND NOT (file_id::BIGINT % 2 = 0 AND file_id::BIGINT % 3 <> 0) AS saved, CASE WHEN file_id::BIGINT % 2 = 0 AND file_id::BIGINT % 3 <> 0 THEN 'old ' || file_id ELSE text END AS text FROM s"""


def reindexed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth file read again with one page: its old pages go, and what caches had of it."""
    pages = V.pages(spark, sf)
    files = pages.select("tenant_id", "file_id").distinct()
    new = files.where(F.col("file_id").cast("long") % 5 == 0).select("*", F.lit(1).alias("page_number"), F.lit("new").alias("content"))
    left, caches = store.reindexed(pages, {"summaries": files}, new)
    n = left.groupBy("file_id").agg(F.count("*").alias("n_pages"), F.max(F.col("content") == "new").alias("fresh"))
    return n.join(caches["summaries"].select("file_id", F.lit(True).alias("cached")), "file_id", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


REINDEX_SQL = "SELECT conv_id::VARCHAR AS file_id, CASE WHEN conv_id % 5 = 0 THEN 1 ELSE count(*) END AS n_pages, conv_id % 5 = 0 AS fresh, conv_id % 5 <> 0 AS cached FROM conversations GROUP BY conv_id"


# --- catalog ---
def upsert_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Files without every fifth; every third is uploaded anew, which replaces its row, status and all."""
    f = V.files(spark, sf)
    new = f.where("doc_id % 3 = 0").withColumns({"file_name": F.concat(F.lit("u_"), "file_name"), "index_status": F.lit("pending")})
    return C.upserted(f.where("doc_id % 5 <> 0"), new, ["file_name", "size_bytes"], ["index_status"], whole=True)


UPLOAD_SQL = _F + """ SELECT tenant_id, source_type, source_ref, CASE WHEN doc_id % 3 = 0 THEN 'u_' || file_name ELSE file_name END AS file_name, size_bytes, CASE WHEN doc_id % 3 = 0 THEN 'pending' ELSE index_status END AS index_status FROM kb_files WHERE doc_id % 5 <> 0 OR doc_id % 3 = 0"""


def status_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Every second file becomes processing and then indexed, every third of the others failed."""
    f = V.files(spark, sf).withColumns({"index_error": F.lit("old").cast("string")})
    k = f.select(*C.KEY, "doc_id")
    one = lambda where, status, error, at: k.where(where).select(*C.KEY, F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"), F.lit(at).alias("at"))
    changes = one("doc_id % 2 = 0", "processing", None, 1).unionByName(one("doc_id % 2 = 0", "indexed", None, 2)).unionByName(one("doc_id % 2 = 1 and doc_id % 3 = 0", "failed", "broken", 1))
    return C.with_status(f, changes).select("source_ref", "index_status", "index_error")


CHANGES_SQL = _F + """ SELECT source_ref, CASE WHEN doc_id % 2 = 0 THEN 'indexed' WHEN doc_id % 3 = 0 THEN 'failed' ELSE index_status END AS index_status, CASE WHEN doc_id % 2 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'broken' ELSE 'old' END AS index_error FROM kb_files"""


def listing_by_names(spark: SparkSession, sf: str) -> DataFrame:
    return C.listing(V.files(spark, sf), "en", names=["doc_1.txt", "doc_22.txt", "doc_250.txt"]).select("source_ref", "file_name", "doc_role")


def resolved_paths(spark: SparkSession, sf: str) -> DataFrame:
    """For each name the first folder of three that has it."""
    f = V.files(spark, sf).select("source_ref", "file_name", F.concat("folder_path", F.lit("/"), "file_name").alias("file_path"))
    names = f.select(F.col("file_name").alias("request")).distinct()
    c = names.select("request", F.posexplode(F.array(*map(F.lit, ("src1/0", "src2/1", "src3/2")))).alias("priority", "folder"))
    return C.resolved(f, c.select("request", "priority", F.concat("folder", F.lit("/"), "request").alias("path"))).select("request", "priority", "source_ref")


RESOLVED_SQL = _F + """, c AS (SELECT file_name AS request, list_position(['src1/0', 'src2/1', 'src3/2'], folder_path) - 1 AS priority, source_ref FROM kb_files WHERE folder_path IN ('src1/0', 'src2/1', 'src3/2'))
SELECT request, priority::INT AS priority, source_ref FROM c QUALIFY rank() OVER (PARTITION BY request ORDER BY priority) = 1"""


def folder_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Folders made, moved and deleted, with the files in each."""
    f = V.files(spark, sf)
    new = f.select("tenant_id", "doc_role", F.concat(F.lit("/"), "folder_path", F.lit("/sub/")).alias("folder_path"))
    none = spark.createDataFrame([], "tenant_id string, doc_role string, folder_path string")
    folders = C.without_folder(C.renamed_folders(C.with_folders(none, new), "src1", "archive/one"), "src2", "glossary")
    return C.folder_listing(f, folders)


FOLDERS_SQL = _F + """, n AS (SELECT DISTINCT tenant_id, doc_role, folder_path || '/sub' AS folder_path FROM kb_files),
m AS (SELECT tenant_id, doc_role, CASE WHEN starts_with(folder_path, 'src1/') THEN 'archive/one' || substr(folder_path, 5) ELSE folder_path END AS folder_path FROM n WHERE NOT (doc_role = 'glossary' AND (folder_path = 'src2' OR starts_with(folder_path, 'src2/')))),
c AS (SELECT tenant_id, doc_role, folder_path, count(*) AS n_files FROM kb_files GROUP BY ALL)
SELECT * FROM c UNION ALL SELECT m.*, 0 FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.tenant_id = m.tenant_id AND c.doc_role = m.doc_role AND c.folder_path = m.folder_path)"""


def ledger_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger after every third file was recorded and every fifth deleted."""
    f = V.files(spark, sf).select("tenant_id", F.col("source_ref").alias("file_id"), "file_name", "doc_id")
    done = V.ledger(spark, sf).join(f, ["tenant_id", "file_id"]).select("tenant_id", "file_id", "file_name")
    return C.unrecorded(C.recorded(done, f.where("doc_id % 3 = 0")), f.where("doc_id % 5 = 0"))


LEDGER_SQL = _F + " SELECT tenant_id, source_ref AS file_id, file_name FROM kb_files WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND doc_id % 5 <> 0"


def admin_users(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as users: those of one segment are superAdmin, and rich ones are marked."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("tenant_id"), F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 9000, True).alias("is_admin"), F.when(F.col("c_mktsegment") == "BUILDING", "superAdmin").alias("role"))
    return C.admins(c)


def uploads_with_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Even orders as uploads and lines as reports, joined by name; of several the first."""
    uploads = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("upload"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("file_name"))
    reports = table(spark, sf, "lineitem").select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("file_name"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("report_no"), F.col("l_partkey").alias("file_content"))
    return C.report_uploads(uploads, reports)


REPORTS_SQL = """SELECT o_orderkey AS upload, 'r' || o_orderkey AS file_name, l_partkey AS file_content FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1"""


def word_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every page (turn) on lines of eight, five lines a block."""
    c = table(spark, sf, "conversations").where("text <> ''")
    w = c.select("conv_id", "turn", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("i", "text"))
    line = F.floor(F.col("i") / 8)
    w = w.select("conv_id", "turn", (line * 12 + F.floor(line / 5) * 30).cast("double").alias("top"), ((F.col("i") % 8) * 50).cast("double").alias("x0"), "text")
    return files_.page_blocks(w, ["conv_id", "turn"])


BLOCKS_SQL = r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
b AS (SELECT conv_id, turn, w, unnest(range(ceil(len(w) / 40.0)::BIGINT)) AS b FROM w)
SELECT conv_id, turn, (b * 90)::DOUBLE AS y, array_to_string(list_transform(range((least(len(w) - b * 40, 40) + 7) // 8), lambda l: array_to_string(w[(b * 40 + l * 8 + 1):least(b * 40 + l * 8 + 8, len(w))], ' ')), chr(10)) AS content FROM b"""


def metadata_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every inspected hit of one kind of event, with its properties as lines."""
    e = table(spark, sf, "events").withColumnRenamed("event_id", "id")
    return C.inspected(e, {"event_type": "purchase", "user_id": None}).select("id", key_value_lines(F.from_json("props", "map<string,string>")).alias("content"))


QUERIES = {
    "retrieve_images": (retrieve_images, IMAGES_SQL),
    "search_without_images": (without_images, WITHOUT_SQL),
    "caption_substitution": (caption_substitution, CAPTION_SQL),
    "unique_images": (unique_images, UNIQUE_SQL),
    "retrieve_branches": (retrieve_branches, BRANCHES_SQL),
    "filter_json_path": (json_path, "SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '7'"),
    "summary_cache": (summary_cache, CACHE_SQL),
    "reindexed_pages": (reindexed_pages, REINDEX_SQL),
    "upsert_uploads": (upsert_uploads, UPLOAD_SQL),
    "status_changes": (status_changes, CHANGES_SQL),
    "listing_by_names": (listing_by_names, _F + " SELECT source_ref, file_name, doc_role FROM kb_files WHERE tenant_id = 'en' AND file_name IN ('doc_1.txt', 'doc_22.txt', 'doc_250.txt')"),
    "resolved_paths": (resolved_paths, RESOLVED_SQL),
    "folder_rows": (folder_rows, FOLDERS_SQL),
    "ledger_changes": (ledger_changes, LEDGER_SQL),
    "admin_users": (admin_users, "SELECT c_nationkey AS tenant_id, c_custkey AS id FROM customer WHERE c_acctbal > 9000 OR c_mktsegment = 'BUILDING'"),
    "uploads_with_reports": (uploads_with_reports, REPORTS_SQL),
    "word_blocks": (word_blocks, BLOCKS_SQL),
    "inspect_rows": (metadata_lines, "SELECT event_id AS id, 'k: ' || json_extract_string(props, '$.k') AS content FROM events WHERE event_type = 'purchase'"),
}
