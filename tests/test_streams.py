import os
import time

import pytest
from pyspark.sql import functions as F

from loamline.operators import catalog as K
from loamline.operators.buckets import Buckets, delete_totals, deleted_files, reindexed_store
from loamline.sources import listing
from loamline.streaming import jobs as J

KEYS = ("tenant_id", "file_id")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


# --- buckets ---
def pages(spark, n=200, text="old"):
    return spark.range(n).selectExpr("concat('t', id % 3) as tenant_id", "cast(id % 40 as string) as file_id", "cast(id as int) as page_number", f"concat('{text} ', id) as content")


def test_changes_rewrite_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "pages")
    store = Buckets(path, KEYS, 16).created(pages(spark))
    before = files_of(path)
    new = pages(spark, text="new").where("file_id = '7' and tenant_id = 't1' and page_number < 100")
    touched = store.replaced(new)
    assert len(touched) == 1
    changed = before ^ files_of(path)
    assert changed and all(f"bucket={touched[0]}/" in f for f in changed)
    gone = new.select(*KEYS).distinct()
    want = pages(spark).join(gone, list(KEYS), "left_anti").unionByName(new)
    assert rows(store.rows(spark)) == rows(want.select(store.rows(spark).columns))
    again = rows(store.rows(spark))
    assert store.replaced(new) == touched and rows(store.rows(spark)) == again


def test_removal_empties_buckets_and_upserts_keep_one_row(spark, tmp_path):
    store = Buckets(str(tmp_path / "s"), ("k",), 8).created(spark.range(20).selectExpr("id as k", "0 as v"))
    new = spark.createDataFrame([(3, 1), (3, 2), (99, 5)], "k long, v int")
    store.upserted(new, [F.desc("v")])
    want = {i: 0 for i in range(20)} | {3: 2, 99: 5}
    assert {r.k: r.v for r in store.rows(spark).collect()} == want
    assert store.removed(spark.range(7).selectExpr("id as k")) and {r.k for r in store.rows(spark).collect()} == set(want) - set(range(7))
    store.removed(spark.range(200).selectExpr("id as k").where("k <> 15"))
    assert [r.k for r in store.rows(spark).collect()] == [15]
    store.removed(spark.range(200).selectExpr("id as k"))
    assert store.rows(spark).collect() == [] and store.upserted(new) and store.rows(spark).count() == 2
    store.removed(new)
    assert store.removed(spark.range(0).selectExpr("id as k")) == [] and store.replaced(new.limit(0)) == []


def test_reindexing_can_be_run_again_after_a_failure(spark, tmp_path, monkeypatch):
    old, new = pages(spark), pages(spark, text="new").where("tenant_id = 't2' and page_number < 60")
    make = lambda name, df: Buckets(str(tmp_path / name), KEYS, 8).created(df)
    store, cache, status = make("p", old), make("c", old.groupBy(*KEYS).count()), make("s", old.select(*KEYS).distinct().withColumn("status", F.lit("pending")))
    gone = new.select(*KEYS).distinct()
    monkeypatch.setattr(Buckets, "upserted", lambda *a, **b: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        reindexed_store(store, [cache], status, new)
    assert status.rows(spark).where("status = 'indexed'").count() == 0 and cache.rows(spark).join(gone, list(KEYS)).count() == 0
    monkeypatch.undo()
    reindexed_store(store, [cache], status, new)
    assert rows(store.rows(spark)) == rows(old.join(gone, list(KEYS), "left_anti").unionByName(new).select(store.rows(spark).columns))
    assert status.rows(spark).where("status = 'indexed'").count() == gone.count() == status.rows(spark).join(gone, list(KEYS)).where("status = 'indexed'").count()


def test_deletes_go_on_after_a_failure_and_are_counted(spark, tmp_path, monkeypatch):
    make = lambda name, df, keys: Buckets(str(tmp_path / name), keys, 4).created(df)
    chunks = spark.createDataFrame([("t", "1", "c1"), ("t", "1", "c2"), ("t", "2", "c3")], "tenant_id string, file_id string, id string")
    stores = {
        "documents": make("d", chunks, KEYS),
        "image_analysis_documents": make("a", spark.createDataFrame([("i1", "c1"), ("i3", "c3")], "id string, document_id string"), ("document_id",)),
        "chroma": make("v", spark.createDataFrame([("c1",), ("c2",), ("c3",), ("i1",), ("i3",)], "document_id string"), ("document_id",)),
        "pages": make("p", chunks.select(*KEYS), KEYS),
    }
    stored = tmp_path / "files"
    (stored / "t" / "1").mkdir(parents=True)
    (stored / "t" / "1" / "x.png").write_text("x")
    folders = {"extracted_images": lambda gone: gone.select(F.concat(F.lit(f"{stored}/"), "tenant_id", F.lit("/"), "file_id").alias("path"))}
    gone = spark.createDataFrame([("t", "1"), ("t", "9")], "tenant_id string, file_id string")
    real = Buckets.removed
    monkeypatch.setattr(Buckets, "removed", lambda self, x: 1 / 0 if self.path.endswith("/p") else real(self, x))
    done = deleted_files(gone, stores, folders)
    got = {r.target: (r.deleted, r.n) for r in done.collect()}
    assert got == {"documents": (True, 2), "image_analysis_documents": (True, 1), "chroma": (True, 3), "pages": (False, 0), "extracted_images": (True, 1)}
    assert tuple(delete_totals(done).first()) == (4, 1, 5) and not (stored / "t" / "1").exists()
    assert [r[0] for r in stores["chroma"].rows(spark).orderBy("document_id").collect()] == ["c3", "i3"]
    monkeypatch.undo()
    again = {r.target: (r.deleted, r.n) for r in deleted_files(gone, stores, folders).collect()}
    assert again["pages"] == (True, 2) and again["documents"] == (True, 0)


# --- streams ---
def arrive(spark, tmp_path, values, schema):
    spark.createDataFrame(values, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


JOB = "job_id string, status string, at timestamp"


def at(spark, minutes):
    return spark.sql(f"select timestamp'2024-01-01 00:00:00' + interval {minutes} minutes").first()[0]


def test_job_states_equal_the_batch_plan_across_restarts(spark, tmp_path):
    log, seen, ttl = str(tmp_path / "log"), [], 3600
    batches = [
        [("a", "running", 0), ("b", "completed", 0), ("c", "failed", 10)],
        [("a", "completed", 30), ("d", "running", 40), ("d", "completed", 40), (None, "failed", 41)],
        [("b", "running", 5), ("e", "running", 75)],
        [("a", "running", 31), ("c", "running", 80), ("f", "completed", 100)],
        [("g", "running", 200), ("f", "completed", 20)],
        [("h", "failed", 205)],
    ]
    for batch in batches:
        values = [(j, s, at(spark, m)) for j, s, m in batch]
        newest_before = max((v[2] for v in seen), default=None)
        seen += [v for v in values if v[0] and (newest_before is None or v[2] >= newest_before)]  # the watermark drops late rows
        J.appended(J.job_changes(arrive(spark, tmp_path, values, JOB), ttl), log, str(tmp_path / "check")).awaitTermination(90)
        got = J.current(spark.read.parquet(log), 50)
        all_ = spark.createDataFrame(seen, JOB)
        newest = K.latest_state(all_, ["job_id"], tie="status")
        want = K.kept_jobs(newest, F.lit(all_.agg(F.max("at")).first()[0]), ttl, 50)
        assert {(r.job_id, r.status) for r in got.collect()} == {(r.job_id, r.status) for r in want.collect()}, batch


def test_repeated_batches_change_nothing(spark, tmp_path):
    table = Buckets(str(tmp_path / "t"), ("k",), 4).created(spark.createDataFrame([(0, 0, 0)], "k long, v long, n long"))
    schema = "k long, v long, n long"
    source = arrive(spark, tmp_path, [(1, 1, 1), (2, 5, 1), (1, 2, 2)], schema)
    J.merged_each_batch(source, table, str(tmp_path / "c1"), [F.desc("n"), F.desc("v")]).awaitTermination(90)
    first = rows(table.rows(spark))
    assert first == [(0, 0, 0), (1, 2, 2), (2, 5, 1)]
    source = arrive(spark, tmp_path, [(1, 9, 1), (3, 3, 1)], schema)  # a late row of 1
    J.merged_each_batch(source, table, str(tmp_path / "c2"), [F.desc("n"), F.desc("v")]).awaitTermination(90)  # all rows again
    assert rows(table.rows(spark)) == [*first, (3, 3, 1)]


def test_streamed_invalidation_and_progress(spark, tmp_path):
    old = pages(spark)
    make = lambda name, df, keys=KEYS: Buckets(str(tmp_path / name), keys, 8).created(df)
    store, cache, status = make("p", old), make("c", old.groupBy(*KEYS).count()), make("s", old.select(*KEYS).distinct().withColumn("status", F.lit("pending")))
    new = [tuple(r) for r in pages(spark, text="new").where("tenant_id = 't0' and file_id in ('0', '3')").collect()]
    for check in ("k1", "k2"):  # the second run gives the same batch again
        source = arrive(spark, tmp_path, new if check == "k1" else new[:0], "tenant_id string, file_id string, page_number int, content string")
        J.invalidated_each_batch(source, store, [cache], status, str(tmp_path / check)).awaitTermination(90)
        assert store.rows(spark).where("content like 'new%'").count() == len(new) and store.rows(spark).count() == 200
        assert cache.rows(spark).where("tenant_id = 't0' and file_id in ('0', '3')").count() == 0
    counters = make("n", spark.createDataFrame([], "tenant long, total long, processed long, failed long"), ("tenant",))
    (tmp_path / "two").mkdir()
    for part in ([(1, "completed"), (1, "failed"), (2, "running")], [(1, "completed")]):
        log = arrive(spark, tmp_path / "two", part, "tenant long, status string")
        J.progress_each_batch(log, ["tenant"], counters, str(tmp_path / "k3")).awaitTermination(90)
    got = rows(counters.rows(spark))
    assert got == [(1, 3, 2, 1), (2, 1, 0, 0)]


# --- listings ---
@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name in ("a.txt", "x/b.PDF", "x/c.txt", "x/y/d.pdf", "z/e", "xx/f.pdf"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    return root


def read(spark, path, kind="folder"):
    listing.register(spark)
    return spark.read.format("listing").option("path", str(path)).option("kind", kind).load()


def test_folders_are_partitions_and_filters_are_answered(spark, tree):
    found = read(spark, tree)
    assert {(r.folder, r.file_name, r.file_type, r.size_bytes) for r in found.collect()} == {("", "a.txt", "txt", 5), ("x", "b.PDF", "pdf", 7), ("x", "c.txt", "txt", 7), ("x/y", "d.pdf", "pdf", 9), ("z", "e", "", 3), ("xx", "f.pdf", "pdf", 8)}
    assert found.rdd.getNumPartitions() == 5
    for where, names, folders in (("folder = 'x'", {"b.PDF", "c.txt"}, 1), ("folder in ('x/y', 'z') and file_type = 'pdf'", {"d.pdf"}, 2), ("folder like 'x%' and file_type in ('pdf')", {"b.PDF", "d.pdf", "f.pdf"}, 3), ("file_type = 'txt' and size_bytes > 5", {"c.txt"}, 5), ("folder = 'x' and folder in ('z', 'y')", set(), 1)):
        some = found.where(where)
        assert {r.file_name for r in some.collect()} == names, where
        assert some.rdd.getNumPartitions() == folders, where
        left = [x for x in some._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter (" in x or "Filter isnot" in x]
        assert not any("folder" in x or "file_type" in x for x in left) and bool(left) == ("size" in where), where


def test_only_wanted_folders_are_walked():
    wanted = listing.Wanted()
    wanted.add(listing.EqualTo(("folder",), "x/y"))
    assert [n for n in ("", "x", "x/y", "xx", "z", "x/y/w") if wanted.below(n)] == ["", "x", "x/y"] and not wanted.folder("x")
    prefix = listing.Wanted()
    prefix.add(listing.StringStartsWith(("folder",), "x/y"))
    assert [n for n in ("", "x", "x/y", "x/yes", "z", "x/y/w") if prefix.below(n)] == ["", "x", "x/y", "x/yes", "x/y/w"]


def test_streams_give_what_is_new(spark, tree, tmp_path):
    listing.register(spark)
    manifest = tmp_path / "pages"
    manifest.mkdir()
    for n in range(2):
        (manifest / f"p{n}.json").write_text(f'{{"path": "d/{n}", "folder": "d", "file_name": "{n}.pdf", "size_bytes": {n}}}\n')

    def run(path, kind, name):
        s = spark.readStream.format("listing").option("path", str(path)).option("kind", kind).option("settle", "0.2").load()
        s.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(once=True).start().awaitTermination(90)
        return sorted(r.file_name for r in spark.read.parquet(str(tmp_path / name)).collect())

    assert run(manifest, "manifest", "m") == ["0.pdf", "1.pdf"] == [r.file_name for r in read(spark, manifest, "manifest").orderBy("path").collect()]
    (manifest / "p2.json").write_text('{"file_name": "2.pdf", "modified_time": "2024-01-01T00:00:00"}\n')
    assert run(manifest, "manifest", "m") == ["0.pdf", "1.pdf", "2.pdf"]
    time.sleep(0.3)
    assert len(run(tree, "folder", "f")) == 6
    (tree / "x" / "new.txt").write_text("n")
    time.sleep(0.3)
    assert run(tree, "folder", "f").count("new.txt") == 1 and len(run(tree, "folder", "f")) == 7


def test_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert read(spark, tmp_path / "none").count() == 0 and read(spark, tmp_path / "none", "manifest").count() == 0
