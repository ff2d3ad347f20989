"""The file catalog: listings, look-ups, upserts, status, renames and deletes, each DataFrame to DataFrame.

Plain files have no MERGE, so a change returns the new table; the caller writes it. The natural key of a file is
(tenant_id, source_type, source_ref).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import falsy_to, file_extension, moved_path, role
from ..session import written
from .search import first_of_each

KEY = ["tenant_id", "source_type", "source_ref"]
STATUSES = ("pending", "processing", "indexed", "failed", "excluded")


def in_tree(path: Column, folder: str) -> Column:
    """The folder itself and all below it; names are no patterns."""
    return (path == folder) | path.startswith(folder + "/")


def listing(files: DataFrame, tenant: str, ids: list[str] | None = None, names: list[str] | None = None, doc_role: str | None = None) -> DataFrame:
    """A tenant's files by name; ids take precedence over names, and a null role or folder gets its default."""
    f = files.where(F.col("tenant_id") == tenant)
    if ids:
        f = f.where(F.col("source_ref").isin(ids))
    elif names:
        f = f.where(F.col("file_name").isin(names))
    f = f.withColumns({"folder_path": F.coalesce("folder_path", F.lit("")), "doc_role": falsy_to(F.col("doc_role"), F.lit("content"))})
    return (f.where(F.col("doc_role") == doc_role) if doc_role else f).orderBy("file_name", "source_ref")


def visible(files: DataFrame, include_images: bool = False) -> DataFrame:
    return files if include_images else files.where(~F.coalesce("mime_type", F.lit("")).startswith("image/"))


def supported(files: DataFrame, mime_types: list[str], extensions: list[str]) -> DataFrame:
    """By type, and by extension where the type says nothing."""
    unknown = F.col("mime_type") == "application/octet-stream"
    return files.where(F.col("mime_type").isin(mime_types) | (unknown & file_extension(F.col("file_name")).isin(extensions)))


def latest(files: DataFrame, keys: list[str]) -> DataFrame:
    """The newest file of each key; files without a time come last, ties go to the smaller source_ref."""
    return first_of_each(files, keys, [F.col("modified_time").desc_nulls_last(), "source_ref"])


def resolved(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """The first of each request's candidate paths (request, priority, path) that files have, with all its rows."""
    found = candidates.join(files, F.col("path") == F.col("file_path"))
    return found.withColumn("_r", F.rank().over(Window.partitionBy("request").orderBy("priority"))).where("_r = 1").drop("_r")


def new_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that the ledger (tenant_id, file_id) does not have."""
    return files.join(done, (files["tenant_id"] == done["tenant_id"]) & (files["source_ref"] == done["file_id"]), "left_anti")


def processed_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that the ledger has; they are indexed, whatever their status said."""
    f = files.join(done, (files["tenant_id"] == done["tenant_id"]) & (files["source_ref"] == done["file_id"]), "left_semi")
    return f.withColumn("index_status", F.lit("indexed"))


def merged_listings(main: DataFrame, extra: DataFrame, key: list[str]) -> DataFrame:
    """Both listings; what both have comes from the extra one."""
    both = main.withColumn("_o", F.lit(1)).unionByName(extra.withColumn("_o", F.lit(0)))
    return first_of_each(both, key, ["_o"]).drop("_o")


def duplicate_hashes(files: DataFrame) -> DataFrame:
    """Content that a tenant has more than once: the hash, how often, and the first file with it."""
    g = files.groupBy("tenant_id", "file_hash").agg(F.count("*").alias("n_files"), F.min_by("source_ref", F.struct(F.length("source_ref"), "source_ref")).alias("first_ref"))
    return g.where("n_files > 1")


def upserted(old: DataFrame, new: DataFrame, metadata: list[str], states: list[str], whole: bool = False) -> DataFrame:
    """old with the rows of new by natural key. A listed file (whole=False) is added as pending or changes metadata
    only; an upload (whole=True) replaces the row."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in KEY]
    j = o.join(n, on[0] & on[1] & on[2], "full_outer").withColumn("_new", F.coalesce(*(F.col(f"n.{k}").isNotNull() for k in KEY[:1]), F.lit(False)))
    pick = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in KEY]
    pick += [F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in metadata]
    for c in states:
        fresh = F.col(f"n.{c}") if whole else F.coalesce(F.col(f"o.{c}"), F.lit("pending") if c == "index_status" else F.lit(None))
        pick.append(F.when(F.col("_new"), fresh).otherwise(F.col(f"o.{c}")).alias(c))
    return j.select(*pick)


def with_status(files: DataFrame, changes: DataFrame, at: Column | None = None) -> DataFrame:
    """files after changes (natural key, status, error and, where there may be several of a file, at): the newest change
    of each counts. indexed sets indexed_at and clears the error."""
    c = first_of_each(changes, KEY, [*([F.desc("at")] if "at" in changes.columns else []), "status"]).drop("at")
    f = files.join(c, KEY, "left")
    hit, now = F.col("status").isNotNull(), at if at is not None else F.current_timestamp()
    out = {"index_status": F.when(hit, F.col("status")).otherwise(F.col("index_status")), "index_error": F.when(F.col("status") == "indexed", F.lit(None)).when(hit, F.col("error")).otherwise(F.col("index_error"))}
    if "indexed_at" in files.columns:
        out["indexed_at"] = F.when(F.col("status") == "indexed", now).otherwise(F.col("indexed_at"))
    return f.withColumns(out).select(*files.columns)


def renamed_folder(files: DataFrame, old: str, new: str) -> DataFrame:
    return files.withColumn("folder_path", moved_path(F.col("folder_path"), old, new))


def renamed_file(tables: dict[str, DataFrame], old_id: str, new_id: str, new_name: str) -> dict[str, DataFrame]:
    """Every table that names a file, with its new id and name."""
    out = {}
    for name, df in tables.items():
        col = "source_ref" if "source_ref" in df.columns else "file_id"
        hit = F.col(col) == old_id
        if "file_name" in df.columns:
            df = df.withColumn("file_name", F.when(hit, new_name).otherwise(F.col("file_name")))
        out[name] = df.withColumn(col, F.when(hit, new_id).otherwise(F.col(col)))
    return out


def cascaded_delete(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """tables without all that belongs to the files gone (tenant_id, file_id), and how many rows each lost. Image rows
    (chunks of type image_analysis without a file) go with the chunk they name in document_id. Only the rows that go
    are counted."""
    left, lost = {}, []
    g = gone.select(F.col("tenant_id").alias("_t"), F.col("file_id").alias("_f")).distinct()
    for name, df in tables.items():
        key = "source_ref" if "source_ref" in df.columns else "file_id"
        cond = (F.col("tenant_id") == F.col("_t")) & (F.col(key) == F.col("_f"))
        keep, going = df.join(g, cond, "left_anti"), [df.join(g, cond, "left_semi")]
        if name == "chunks" and "document_id" in df.columns:
            parents = going[0].select(F.col("id").alias("_p"))
            child = (F.col("type") == "image_analysis") & (F.col("document_id") == F.col("_p"))
            going.append(keep.where("document_id is not null").join(parents, child, "left_semi"))
            keep = keep.join(parents, child, "left_anti")
        left[name] = keep
        lost += [x.select(F.lit(name).alias("target")) for x in going]
    none = gone.sparkSession.createDataFrame([(n,) for n in tables], "target string")
    some = reduce(DataFrame.unionByName, lost).groupBy("target").agg(F.count("*").alias("n_deleted"))
    return left, none.join(some, "target", "left").select("target", F.coalesce("n_deleted", F.lit(0)).alias("n_deleted"))


def routes(files: DataFrame) -> DataFrame:
    """What ingest does with a file by its role: content and references are chunked, paged and carded; glossaries are
    paged and extracted; templates are paged; datasets are profiled."""
    r = role(F.col("doc_role"))
    full = r.isin("content", "reference")
    return files.withColumns({"doc_role": r, "to_chunks": full, "to_pages": r != "dataset", "to_card": full, "to_glossary": r == "glossary", "to_profile": r == "dataset"})


def may_delete(is_admin: Column, source_type: Column, uploaded_by: Column, user: str) -> Column:
    return F.coalesce(is_admin, F.lit(False)) | ((source_type == "upload") & F.coalesce(uploaded_by == user, F.lit(False)))


def folder_tree(nodes: DataFrame) -> DataFrame:
    """(id, path, level) of a table (id, parent_id, name) from its roots down, however deep, in as many rounds as the depth has binary
    digits: each row points to an ancestor and holds the path below it, and a round takes the pointer and path of that ancestor,
    which lies twice as far up each time. Folders below a missing one go; an id that is its own ancestor is an error."""
    is_root = F.col("parent_id").isNull()
    t = written(nodes.select("id", F.col("parent_id").alias("up"), F.col("name").alias("path"), F.when(is_root, 0).otherwise(1).alias("level")))
    most, rounds = t.count(), 0
    while not t.where("up is not null").isEmpty():
        if 1 << rounds > 2 * most:
            raise ValueError("the folders form a cycle")
        rounds += 1
        above = t.select(F.col("id").alias("a_id"), F.col("up").alias("a_up"), F.col("path").alias("a_path"), F.col("level").alias("a_level"))
        further = t.where("up is not null").join(above, F.col("up") == F.col("a_id"))
        further = further.select("id", F.col("a_up").alias("up"), F.concat("a_path", F.lit("/"), "path").alias("path"), (F.col("level") + F.col("a_level")).alias("level"))
        t = written(t.where("up is null").unionByName(further))
    return t.select("id", "path", "level")


def job_counters(jobs: DataFrame, keys: list[str]) -> DataFrame:
    s = F.col("status")
    return jobs.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(s == "completed").alias("processed"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "running").alias("running"))


def latest_state(log: DataFrame, keys: list[str], at: str = "at", tie: str = "job_id") -> DataFrame:
    """The newest row of an append-only log for each key."""
    return first_of_each(log, keys, [F.desc(at), F.desc(tie)])


def current_job(jobs: DataFrame, tenant: str = "tenant") -> DataFrame:
    """Each tenant's running job, else its newest finished one."""
    return first_of_each(jobs, [tenant], [(F.col("status") != "running").cast("int"), F.desc("at"), F.desc("job_id")])


def kept_jobs(jobs: DataFrame, now: Column, ttl_seconds: int = 3600, newest: int = 50) -> DataFrame:
    """Running jobs, and of the finished ones those not older than the TTL, at most the newest so many. The limit is a
    top-k, not a window, so no task sorts all jobs."""
    done = jobs.where("status <> 'running'").where(F.col("at") >= now - F.make_interval(secs=F.lit(ttl_seconds)))
    return jobs.where("status = 'running'").unionByName(done.orderBy(F.desc("at"), F.desc("job_id")).limit(newest))


def recorded(done: DataFrame, files: DataFrame) -> DataFrame:
    """The ledger (tenant_id, file_id, file_name) with files recorded; one entry a file, the name it has now."""
    one = first_of_each(files.select("tenant_id", "file_id", "file_name"), ["tenant_id", "file_id"], ["file_name"])
    return done.join(one, ["tenant_id", "file_id"], "left_anti").unionByName(one)


def unrecorded(done: DataFrame, files: DataFrame) -> DataFrame:
    """The ledger without these files, which are new again."""
    return done.join(files.select("tenant_id", "file_id").distinct(), ["tenant_id", "file_id"], "left_anti")


def with_folders(folders: DataFrame, new: DataFrame) -> DataFrame:
    """Folder rows (tenant_id, doc_role, folder_path) with new ones: paths without outer slashes, unknown roles become the
    default, empty paths and those there already go."""
    path = F.regexp_replace(F.trim("folder_path"), "^/+|/+$", "")
    n = new.select("tenant_id", role(F.col("doc_role")).alias("doc_role"), path.alias("folder_path")).where("folder_path <> ''")
    return folders.select("tenant_id", "doc_role", "folder_path").unionByName(n).distinct()


def renamed_folders(folders: DataFrame, old: str, new: str, doc_role: str | None = None) -> DataFrame:
    """Folder rows after a folder, and all below it, moved; of one role or of all."""
    mine = F.lit(True) if doc_role is None else F.col("doc_role") == doc_role
    path = F.when(mine, moved_path(F.col("folder_path"), old, new)).otherwise(F.col("folder_path"))
    return folders.withColumn("folder_path", path).distinct()


def without_folder(folders: DataFrame, folder: str, doc_role: str | None = None) -> DataFrame:
    mine = F.lit(True) if doc_role is None else F.col("doc_role") == doc_role
    return folders.where(~(mine & in_tree(F.col("folder_path"), folder)))


def folder_listing(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(tenant_id, doc_role, folder_path, n_files) of all folders that files lie in or that have a row of their own."""
    n = files.groupBy("tenant_id", "doc_role", "folder_path").agg(F.count("*").alias("n_files"))
    keys = ["tenant_id", "doc_role", "folder_path"]
    return n.join(folders.select(*keys).distinct(), keys, "full_outer").select(*keys, F.coalesce("n_files", F.lit(0)).alias("n_files"))


def admins(users: DataFrame) -> DataFrame:
    """Users (tenant_id, id) who may administer: is_admin or the role superAdmin."""
    return users.where(F.coalesce("is_admin", F.lit(False)) | (F.coalesce("role", F.lit("")) == "superAdmin")).select("tenant_id", "id")


def report_uploads(uploads: DataFrame, reports: DataFrame) -> DataFrame:
    """Uploads with the content of the report of their name, the first by its number; uploads without one go."""
    r = first_of_each(reports, ["file_name"], ["report_no"]).select("file_name", "file_content")
    return uploads.join(r, "file_name")


def inspected(rows: DataFrame, where: dict, limit: int | None = None) -> DataFrame:
    """Rows under all clauses given, by id, at most `limit`."""
    f = rows
    for name, value in where.items():
        f = f.where(F.col(name) == value) if value is not None else f
    f = f.orderBy("id")
    return f.limit(limit) if limit else f
