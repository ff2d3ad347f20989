import json

import pytest
from pyspark.sql import functions as F

from loamline.operators import catalog as K
from loamline.operators import images as I
from loamline.operators import navigate as N
from loamline.operators import requests as R
from loamline.operators import store as W
from loamline.sources import files as S
from loamline.streaming import events as E


def test_folder_tree_has_no_depth_limit_and_cycles_are_errors(spark):
    n = spark.createDataFrame([(i, i - 1 if i else None, f"f{i}") for i in range(40)], "id int, parent_id int, name string")
    got = {r.id: (r.level, r.path) for r in K.folder_tree(n).collect()}
    assert len(got) == 40 and got[39] == (39, "/".join(f"f{i}" for i in range(40)))
    cycle = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (2, 1, "c")], "id int, parent_id int, name string")
    with pytest.raises(ValueError):
        K.folder_tree(cycle)


def test_folder_tree_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(K, "written", lambda df, f=K.written: rounds.append(1) or f(df))
    chain = spark.range(1000).selectExpr("id", "nullif(id - 1, -1) as parent_id", "'x' as name").unionByName(spark.createDataFrame([(5000, 4999, "lost"), (5001, 5000, "lost")], "id long, parent_id long, name string"))
    got = {r.id: r.level for r in K.folder_tree(chain).select("id", "level").collect()}
    assert got == {i: i for i in range(1000)} and len(rounds) <= 12


def test_cut_results_say_so(spark):
    c = spark.createDataFrame([("f", i, f"t{i}") for i in range(5)], "file_id string, chunk_index int, content string")
    some, all_ = N.full_text(c, ["file_id"], most=3).first(), N.full_text(c, ["file_id"], most=None).first()
    assert (some.truncated, some.chunk_count, some.full_text) == (True, 3, "t0\nt1\nt2") and (all_.truncated, all_.chunk_count) == (False, 5)
    b = spark.createDataFrame([("t", "f", 0, "1", "answer", True), ("t", "f", 1, "2", "", False)], "tenant_id string, file_id string, batch int, label string, answer string, ok boolean")
    r = N.assembled(b, limit=10).first()
    assert r.truncated and len(r.text) == 10 and r.failed == ["2"] and not r.complete and not N.assembled(b).first().truncated


def test_upserts_keep_one_row_an_id(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, n int")
    got = W.merged_by_id(old, spark.createDataFrame([("a", 2), ("a", 2), ("c", 3)], "id string, n int")).collect()
    assert sorted(map(tuple, got)) == [("a", 2), ("b", 1), ("c", 3)]


def test_pages_keep_their_numbers(spark):
    p = spark.createDataFrame([("t", "f", 0, " a\x00 ", "x"), ("t", "f", 1, " ", "y"), ("t", "f", 2, "c", "z")], "tenant_id string, file_id string, seq int, content string, source string")
    assert [(r.page_number, r.content, r.page_meta.source) for r in W.page_rows(p, ["source", "absent"]).orderBy("page_number").collect()] == [(1, "a", "x"), (3, "c", "z")]


def test_captions(spark):
    images = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("c", bytearray(b"3"))], "image_id string, image_data binary")

    def make():
        def model(batch):
            if bytes(batch[0]) == b"3":
                raise RuntimeError("down")
            return [f"picture {bytes(x).decode()}" for x in batch]

        return model

    assert {r.image_id: r.analysis for r in I.described(images, make, 1).collect()} == {"a": "picture 1", "b": "picture 2", "c": None}
    assert {r.analysis for r in I.described(images).collect()} == {None}
    chunks = spark.createDataFrame([("f", "x __IMAGE_PLACEHOLDER_p1_i0__ y __IMAGE_PLACEHOLDER_p1_i0__ __IMAGE_PLACEHOLDER_p9_i9__"), ("g", None)], "file_id string, content string")
    known = spark.createDataFrame([("f", 1, 0, "a cat"), ("f", 2, 0, None)], "file_id string, page int, image_index int, analysis string")
    got = {r.file_id: r.content for r in I.with_captions(chunks, known, ["file_id"]).collect()}
    assert got == {"f": "x [이미지: 1페이지 이미지1]\na cat y [이미지: 1페이지 이미지1]\na cat ", "g": None}
    own = I.single_images(spark.createDataFrame([("t", "f1")], "tenant_id string, image_id string"), spark.createDataFrame([("t", "c1", "f1"), ("t", "c2", "f2")], "tenant_id string, id string, file_id string"))
    assert [r.chunk_id for r in own.collect()] == ["c1"]


def test_prompts_and_extraction(spark):
    d = spark.createDataFrame([("Title", None)], "a string, b string")
    assert d.select(R.prompt("Sum up {name}: {{{text}}}.", name=F.col("a"), text=F.col("b"))).first()[0] == "Sum up Title: {}."
    with pytest.raises(KeyError):
        R.prompt("{missing}")
    pages = spark.createDataFrame([("t", "f", 1, "alpha"), ("t", "f", 2, "beta")], "tenant_id string, file_id string, page_number int, content string")
    r = R.extracted(pages, F.lit("term"), 1).first()
    assert r.text.startswith("## f — 정제본\n\n### p.1\n\nterm") and r.ok and not r.truncated


def test_reports(spark, tmp_path):
    q = spark.createDataFrame([("a.txt", "q?", "yes")], "file string, question string, expected_answer string")
    r = spark.createDataFrame([("a.txt", "c", "r", 4.0, 0.5), ("a.txt", "c", "s", 5.0, 0.25)], "file string, chunker string, retriever string, avg_score double, avg_recall double")
    R.write_reports(str(tmp_path), q, r)
    lines = [json.loads(x) for f in (tmp_path / "summary").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == [{"file": "a.txt", "combinations": 2, "best_score": 5.0, "best_recall": 0.5}] and spark.read.json(str(tmp_path / "report")).count() == 2


def test_json_path(spark):
    d = spark.createDataFrame([('{"k": "a", "n": 1}',), ("no json",), (None,)], "meta string")
    assert [r[0] for r in d.select(R.json_equals(F.col("meta"), "k", "a")).collect()] == [True, False, False]
    assert d.where(R.json_equals(F.col("meta"), "n", 1)).count() == 1
    typed = spark.createDataFrame([('{"b": true, "it\'s": "x", "n": 1.0, "o": {"k": 2}}',), ('{"b": "true"}',), ('{"b": false}',), ("[1]",)], "meta string")
    asked = [("b", True, [True, True, False, False]), ("b", False, [False, False, True, False]), ("it's", "x", [True, False, False, False]), ("n", 1, [True, False, False, False]), ("o", '{"k":2}', [True, False, False, False]), ("none", "", [False] * 4)]
    for key, value, want in asked:
        assert [r[0] for r in typed.select(R.json_equals(F.col("meta"), key, value)).collect()] == want, key


def test_delimited_cp949_is_read_in_splits(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("이름,n\n".encode("cp949") + b"".join(f"한글 {i},{i}\n".encode("cp949") for i in range(20_000)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "32k")
        got = S.delimited(spark, str(tmp_path / "x.csv"))
        assert got.columns == ["이름", "n"] and got.groupBy(F.spark_partition_id()).count().count() >= 5
        assert got.where("`이름` = concat('한글 ', n)").count() == 20_000 and got.schema["n"].dataType.simpleString() == "int"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_failures_of_a_model_are_told(spark):
    images = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("c", b"3")], "image_id string, image_data binary").coalesce(1)

    def make():
        def model(some):
            if b"2" in map(bytes, some):
                raise RuntimeError("no")
            return ["x"] * (2 if b"3" in map(bytes, some) else 1)

        return model

    got = {r.image_id: (r.analysis, r.analysis_error) for r in I.described(images, make, 1).collect()}
    assert got == {"a": ("x", None), "b": (None, "RuntimeError: no"), "c": (None, "2 answers for 1 images")}


def test_names_with_a_line_feed_are_not_safe(spark):
    from loamline.functions import text as T

    got = spark.createDataFrame([("abc",), ("abc\n",)], "n string").select(T.safe_segment(F.col("n"))).collect()
    assert [r[0] for r in got] == ["abc", "abc"]


@pytest.mark.parametrize(("encoding", "word"), [("utf-8", "é漢"), ("utf-8-sig", "é"), ("cp949", "한글"), ("latin-1", "caf\xe9 \xff")])
def test_encodings_of_delimited_files(spark, tmp_path, encoding, word):
    (tmp_path / "x.csv").write_bytes(f"name,n\n{word},1\n".encode(encoding))
    got = S.delimited(spark, str(tmp_path / "x.csv"))
    assert got.columns == ["name", "n"] and [tuple(r) for r in got.collect()] == [(word, 1)]


def test_extraction_stats(spark):
    kind = S._BLOCK.split(", ")
    assert kind[0] == "type string"
    blocks = spark.sql("select 'a' as path, t.type, t.index, t.text, t.markdown, cast(null as array<string>) as comments, t.placeholders, t.images, 2 as n_comments, cast(null as string) as error from values ('paragraph', 0, 'abc', 'abc', array(1), array('m')), ('table', 1, '', '', array(), array('n', 'o')) as t(type, index, text, markdown, placeholders, images)")
    (got,) = S.extraction_stats(blocks).collect()
    assert got.asDict() == {"path": "a", "paragraph_count": 1, "table_count": 1, "comment_count": 2, "placeholder_count": 1, "image_count": 3, "flat_text_chars": 3}


def test_eviction_by_batches(spark, tmp_path):
    schema = "job_id int, status string, at timestamp"
    for n, rows in enumerate(["(1, 'running', timestamp'2024-01-01 00:00:00'), (2, 'completed', timestamp'2024-01-01 00:00:00')", "(1, 'completed', timestamp'2024-01-01 00:30:00'), (3, 'running', timestamp'2024-01-01 02:00:00')"]):
        spark.sql(f"select * from values {rows} as t(job_id, status, at)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        E.evict_each_batch(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "check"), 2 * 3600).awaitTermination(60)
        want = [{(1, "running"), (2, "completed")}, {(1, "completed"), (3, "running"), (2, "completed")}][n]
        assert {(r.job_id, r.status) for r in spark.read.parquet(str(tmp_path / "state" / str(n))).collect()} == want
