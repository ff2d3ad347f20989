"""Queries of the catalog, profiles and evaluation over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import profile as P
from ..session import table, written
from . import views as V

_F = f"WITH {V.FILES}"


def catalog_listing(spark: SparkSession, sf: str) -> DataFrame:
    return C.listing(V.files(spark, sf), "fr").select("source_ref", "file_name", "folder_path", "doc_role", "index_status")


def documents_list(spark: SparkSession, sf: str) -> DataFrame:
    return C.visible(C.listing(V.files(spark, sf), "en", doc_role="content")).select("source_ref", "file_name", "mime_type", "size_bytes")


def latest_file(spark: SparkSession, sf: str) -> DataFrame:
    return C.latest(V.files(spark, sf), ["tenant_id", "file_name"]).select("tenant_id", "file_name", "source_ref", "modified_time")


def subtree(spark: SparkSession, sf: str) -> DataFrame:
    return V.files(spark, sf).where(C.in_tree(F.col("folder_path"), "src1")).select("source_ref", "folder_path")


def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return C.duplicate_hashes(V.files(spark, sf))


def new_files(spark: SparkSession, sf: str) -> DataFrame:
    return C.new_files(V.files(spark, sf), V.ledger(spark, sf)).select("tenant_id", "source_ref")


def processed(spark: SparkSession, sf: str) -> DataFrame:
    return C.processed_files(V.files(spark, sf), V.ledger(spark, sf)).select("tenant_id", "source_ref", "index_status")


def listings(spark: SparkSession, sf: str) -> DataFrame:
    f = V.files(spark, sf).select("source_ref", "file_name", "doc_id")
    main, extra = f.where("doc_id % 3 <> 0").drop("doc_id"), f.where("doc_id % 2 = 0").withColumn("file_name", F.concat(F.lit("x_"), "file_name")).drop("doc_id")
    return C.merged_listings(main, extra, ["source_ref"])


LISTINGS_SQL = _F + " SELECT source_ref, CASE WHEN doc_id % 2 = 0 THEN 'x_' || file_name ELSE file_name END AS file_name FROM kb_files WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0"


def upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Files without every fifth, upserted with every third under another name and size."""
    f = V.files(spark, sf)
    new = f.where("doc_id % 3 = 0").withColumns({"file_name": F.concat(F.lit("n_"), "file_name"), "size_bytes": F.col("size_bytes") + 1})
    return C.upserted(f.where("doc_id % 5 <> 0"), new, ["file_name", "size_bytes"], ["index_status"])


UPSERT_SQL = _F + """ SELECT tenant_id, source_type, source_ref, CASE WHEN doc_id % 3 = 0 THEN 'n_' || file_name ELSE file_name END AS file_name, CASE WHEN doc_id % 3 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes,
CASE WHEN doc_id % 5 = 0 THEN 'pending' ELSE index_status END AS index_status FROM kb_files WHERE doc_id % 5 <> 0 OR doc_id % 3 = 0"""


def status(spark: SparkSession, sf: str) -> DataFrame:
    """Each tenant's job counters with its current job."""
    jobs = V.jobs(spark, sf)
    return C.job_counters(jobs, ["tenant"]).join(C.current_job(jobs).select("tenant", F.col("job_id").alias("current_job"), F.col("status").alias("current_status")), "tenant")


STATUS_SQL = f"""WITH {V.JOBS}, c AS (SELECT tenant, job_id, status, row_number() OVER (PARTITION BY tenant ORDER BY status <> 'running', "at" DESC, job_id DESC) AS r FROM kb_jobs)
SELECT j.*, c.job_id AS current_job, c.status AS current_status FROM (SELECT tenant, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS processed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running FROM kb_jobs GROUP BY tenant) j JOIN c ON c.tenant = j.tenant AND c.r = 1"""


def job_eviction(spark: SparkSession, sf: str) -> DataFrame:
    """Newest state of each task; finished tasks older than ten days go, and of the rest 50 stay."""
    jobs = C.latest_state(V.jobs(spark, sf), ["task"])
    return C.kept_jobs(jobs, F.to_timestamp(F.lit("2024-01-30 00:00:00")), 10 * 86_400).select("task", "job_id", "status")


EVICT_SQL = f"""WITH {V.JOBS}, l AS (SELECT * FROM kb_jobs QUALIFY row_number() OVER (PARTITION BY task ORDER BY "at" DESC, job_id DESC) = 1)
SELECT task, job_id, status FROM l WHERE status = 'running' UNION ALL
(SELECT task, job_id, status FROM l WHERE status <> 'running' AND "at" >= TIMESTAMP '2024-01-20' ORDER BY "at" DESC, job_id DESC LIMIT 50)"""


def rename(spark: SparkSession, sf: str) -> DataFrame:
    return C.renamed_folder(V.files(spark, sf), "src1", "archive/one").select("source_ref", "folder_path")


RENAME_SQL = _F + " SELECT source_ref, CASE WHEN folder_path = 'src1' OR starts_with(folder_path, 'src1/') THEN 'archive/one' || substr(folder_path, 5) ELSE folder_path END AS folder_path FROM kb_files"


def cascade(spark: SparkSession, sf: str) -> DataFrame:
    """What goes with every seventh file: files, chunks (with an image row on each file's first chunk), ledger."""
    f = V.files(spark, sf)
    c = written(V.chunks(spark, sf).select("tenant_id", "file_id", "chunk_index"))  # a table, as chunks are
    c = c.select("tenant_id", "file_id", F.concat("file_id", F.lit("#"), F.col("chunk_index").cast("string")).alias("id"), F.lit("document").alias("type"), F.lit(None).cast("string").alias("document_id"))
    images = c.where(F.col("id").endswith("#0")).select("tenant_id", F.lit(None).cast("string").alias("file_id"), F.concat(F.lit("img"), "id").alias("id"), F.lit("image_analysis").alias("type"), F.col("id").alias("document_id"))
    gone = f.where("doc_id % 7 = 0").select("tenant_id", F.col("source_ref").alias("file_id"))
    return C.cascaded_delete({"files": f, "chunks": c.unionByName(images), "ledger": V.ledger(spark, sf)}, gone)[1]


CASCADE_SQL = f"""WITH {V.FILES}, {V.LEDGER}, {V.chunks_sql()} SELECT 'files' AS target, count(*) AS n_deleted FROM kb_files WHERE doc_id % 7 = 0
UNION ALL SELECT 'chunks', count(*) + count(*) FILTER (WHERE chunk_index = 0) FROM kb_chunks WHERE doc_id % 7 = 0 UNION ALL SELECT 'ledger', count(*) FROM kb_ledger WHERE file_id::BIGINT % 7 = 0"""


def numeric(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    return P.numeric_profile(d)


NUMERIC_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS n_rows, 0.0::DOUBLE AS null_pct, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean FROM lineitem" for c, t in (("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_linenumber", "int")))


def categorical(spark: SparkSession, sf: str) -> DataFrame:
    return P.categorical_profile(table(spark, sf, "part").select("p_brand", "p_type", "p_size", "p_name"))


CATEGORICAL_SQL = "WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM part" for c in ("p_brand", "p_type", "p_name")) + """), n AS (SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL)
SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, count(*) OVER (PARTITION BY "column") AS n_unique FROM n QUALIFY rank <= 10"""


def eval_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Results of every chunker and retriever, best first."""
    return P.ranking(P.evaluation(V.scores(spark, sf)), 10)


RECALL_SQL = f"WITH {V.SCORES} SELECT chunker, retriever, count(*) AS num_qa, round(avg(score), 3) AS avg_score, round(avg(recall), 3) AS avg_recall FROM kb_scores GROUP BY ALL ORDER BY avg_score DESC, avg_recall DESC, chunker, retriever LIMIT 10"


def eval_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return P.matrix(P.evaluation(V.scores(spark, sf).where("chunker <> 'c1' or retriever <> 'r2'")), [f"r{i}" for i in range(5)])


MATRIX_SQL = f"WITH {V.SCORES} SELECT chunker, " + ", ".join(f"coalesce(printf('%.3f', round(avg(score) FILTER (WHERE retriever = 'r{i}' AND NOT (chunker = 'c1' AND retriever = 'r2')), 3)), '-') AS r{i}" for i in range(5)) + " FROM kb_scores GROUP BY chunker"


def page_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Of the pages a question came from (each vector's neighbours), the share that was retrieved."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    got, wanted = F.array(F.col("label"), F.col("label") + 1), F.array((F.col("vec_id") % 10).cast("int"), ((F.col("vec_id") + 1) % 10).cast("int"), (F.col("vec_id") % 10).cast("int"))
    return e.select("vec_id", F.round(P.recall(got, wanted), 6).alias("recall"))


PAGE_RECALL_SQL = "SELECT vec_id, round(len(list_filter([vec_id % 10, (vec_id + 1) % 10, vec_id % 10], lambda p: p = label OR p = label + 1)) / 3.0::DOUBLE, 6) AS recall FROM embeddings"


def routing(spark: SparkSession, sf: str) -> DataFrame:
    f = C.routes(V.files(spark, sf).withColumn("doc_role", F.when(F.col("doc_id") % 11 == 0, " Unknown").otherwise(F.upper("doc_role"))))
    return f.groupBy("doc_role").agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in ("to_chunks", "to_pages", "to_card", "to_glossary", "to_profile")))


ROUTING_SQL = _F + """, r AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'content' ELSE doc_role END AS doc_role FROM kb_files)
SELECT doc_role, count(*) AS n, count(*) FILTER (WHERE doc_role IN ('content', 'reference')) AS to_chunks, count(*) FILTER (WHERE doc_role <> 'dataset') AS to_pages, count(*) FILTER (WHERE doc_role IN ('content', 'reference')) AS to_card,
count(*) FILTER (WHERE doc_role = 'glossary') AS to_glossary, count(*) FILTER (WHERE doc_role = 'dataset') AS to_profile FROM r GROUP BY doc_role"""


def folder_walk(spark: SparkSession, sf: str) -> DataFrame:
    root = spark.range(1).select(F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("name"))
    regions = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("root").alias("parent_id"), F.col("r_name").alias("name"))
    nations = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_name").alias("name"))
    return C.folder_tree(root.unionByName(regions).unionByName(nations))


WALK_SQL = """SELECT 'root' AS id, 'root' AS path, 0 AS level UNION ALL SELECT 'r' || r_regionkey, 'root/' || r_name, 1 FROM region
UNION ALL SELECT 'n' || n_nationkey, 'root/' || r_name || '/' || n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey"""


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user's events, ten minutes apart."""
    from ..streaming.events import session_metrics

    s = session_metrics(table(spark, sf, "events"))
    return s.select("user_id", F.unix_timestamp("start").alias("start_s"), "n_events", F.round("total", 6).alias("total"))


SESSION_SQL = """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_s, count(*) AS n_events, round(sum(value), 6) AS total FROM s GROUP BY user_id, n"""

QUERIES = {
    "catalog_listing": (catalog_listing, _F + " SELECT source_ref, file_name, folder_path, doc_role, index_status FROM kb_files WHERE tenant_id = 'fr'"),
    "documents_list": (documents_list, _F + " SELECT source_ref, file_name, mime_type, size_bytes FROM kb_files WHERE tenant_id = 'en' AND doc_role = 'content' AND mime_type NOT LIKE 'image/%'"),
    "resolve_latest_file": (latest_file, _F + " SELECT tenant_id, file_name, source_ref, modified_time FROM kb_files QUALIFY row_number() OVER (PARTITION BY tenant_id, file_name ORDER BY modified_time DESC, source_ref) = 1"),
    "subtree_listing": (subtree, _F + " SELECT source_ref, folder_path FROM kb_files WHERE folder_path = 'src1' OR starts_with(folder_path, 'src1/')"),
    "find_duplicates_by_hash": (duplicates, _F + " SELECT tenant_id, file_hash, count(*) AS n_files, min(doc_id)::VARCHAR AS first_ref FROM kb_files GROUP BY ALL HAVING count(*) > 1"),
    "incremental_new_files": (new_files, "SELECT lang AS tenant_id, doc_id::VARCHAR AS source_ref FROM documents WHERE doc_id % 2 = 1"),
    "already_processed": (processed, "SELECT lang AS tenant_id, doc_id::VARCHAR AS source_ref, 'indexed' AS index_status FROM documents WHERE doc_id % 2 = 0"),
    "merge_listings": (listings, LISTINGS_SQL),
    "upsert_files": (upserts, UPSERT_SQL),
    "status_transitions": (status, STATUS_SQL),
    "job_eviction": (job_eviction, EVICT_SQL),
    "rename_prefix": (rename, RENAME_SQL),
    "cascade_delete": (cascade, CASCADE_SQL),
    "workbook_numeric": (numeric, NUMERIC_SQL),
    "workbook_categorical": (categorical, CATEGORICAL_SQL),
    "eval_recall": (eval_recall, RECALL_SQL),
    "eval_matrix": (eval_matrix, MATRIX_SQL),
    "eval_page_recall": (page_recall, PAGE_RECALL_SQL),
    "role_routing": (routing, ROUTING_SQL),
    "recursive_folder_walk": (folder_walk, WALK_SQL),
    "event_sessions": (sessions, SESSION_SQL),
}
