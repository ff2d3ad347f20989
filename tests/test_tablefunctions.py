import random

import pytest

from loamline.operators import chunking as C
from loamline.operators import navigate as N
from loamline.operators import search as S
from loamline.operators import tablefunctions as T


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    T.register(spark)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    texts = ["# A\n\n" + " ".join(rng.choices(["one", "two.", "three\n", "# B\n", "", "ünïcode"], k=rng.randrange(300))) for _ in range(30)] + [None, "", "  ", "a " * 51]
    return spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "file_id int, tenant_id string, content string")


@pytest.mark.parametrize("strategy, size, overlap", [("recursive", 100, 20), ("markdown_header", 80, 10), ("fixed_token", 7, 3), ("fixed_token", 3, 9)])
def test_chunk_text(spark, docs, strategy, size, overlap):
    got = spark.sql(f"SELECT file_id, chunk_index, total_chunks, content FROM chunk_text(TABLE(SELECT * FROM {{d}}), strategy => '{strategy}', size => {size}, overlap => {overlap})", d=docs)
    assert rows(got) == rows(C.chunked(docs, strategy, size=size, overlap=overlap).select("file_id", "chunk_index", "total_chunks", "content"))


def test_chunk_text_offsets_and_columns(spark, docs):
    got = spark.sql("SELECT * FROM chunk_text(TABLE(SELECT *, 'kept' AS section_path, 5 AS extra FROM {d}), strategy => 'recursive', size => 60, overlap => 0)", d=docs)
    assert got.columns == ["file_id", "tenant_id", "extra", "chunk_index", "total_chunks", "start_index", "section_path", "content"]
    texts = {r["file_id"]: r["content"] for r in docs.collect()}
    assert all(r["extra"] == 5 and texts[r["file_id"]][r["start_index"] :].startswith(r["content"]) for r in got.collect())


def test_grep_pages(spark, docs):
    pages = docs.selectExpr("tenant_id", "file_id % 3 AS file_id", "file_id AS page_number", "content")
    for pattern, regex, limit in (("ONE", False, 20), ("t.o|three", True, 5), ("nothing", False, 3)):
        got = spark.sql(f"SELECT file_id, page_number, line, match, snippet, context, seq FROM grep_pages(TABLE(SELECT * FROM {{p}}) PARTITION BY (tenant_id, file_id) ORDER BY page_number, pattern => '{pattern}', regex => {regex}, context => 1, limit => {limit})", p=pages)
        want = N.matches(pages, pattern, regex=regex, context=1, limit=limit)
        assert rows(got) == rows(want.select("file_id", "page_number", "line", "match", "snippet", "context", "seq"))


def test_nearest_rows(spark):
    rng = random.Random(2)
    data = [(i, i % 3, [rng.gauss(0, 1) for _ in range(4)]) for i in range(3000)] + [(4000, 0, None), (4001, 1, []), (4002, 2, [0.0] * 4)]
    data += [(5000 + i, 0, data[0][2]) for i in range(5)]
    index = spark.createDataFrame(data, "id long, part int, embedding array<double>")
    got = spark.sql("SELECT part, rank, id, score FROM nearest_rows(TABLE(SELECT * FROM {i}) PARTITION BY part, query => array(0.5D, -1D, 0.25D, 2D), k => 7)", i=index)
    query = spark.createDataFrame([([0.5, -1.0, 0.25, 2.0],)], "query array<double>")
    for part in range(3):
        want = [(r["id"], r["score"]) for r in S.top_k(index.where(f"part = {part}"), query, 7).collect()]
        assert [(r["id"], r["score"]) for r in got.where(f"part = {part}").orderBy("rank").collect()] == want


def test_parse_files(spark, tmp_path):
    from loamline.plans import made
    from loamline.sources import files as F_

    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.pdf").write_bytes(made.made_pdf([made.page_of("two words", [["x", "y"]])]))
    (tmp_path / "c.docx").write_bytes(b"junk")
    (tmp_path / "d.odd").write_bytes(b"junk")
    files = F_.binary_files(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in spark.sql("SELECT * FROM parse_files(TABLE(SELECT * FROM {f}))", f=files).collect()}
    assert got["a.txt"]["content"] == "plain" and got["b.pdf"]["content"] == "two words\nx y"
    assert "BadZipFile" in got["c.docx"]["error"] and got["d.odd"]["error"] == "unsupported: odd"


@pytest.mark.parametrize("call, why", [
    ("chunk_text(TABLE(SELECT 1 AS x))", "content"),
    ("chunk_text(TABLE(SELECT 'a' AS content), strategy => 'odd')", "strategy"),
    ("chunk_text(TABLE(SELECT 'a' AS content), size => 0)", "size"),
    ("grep_pages(TABLE(SELECT 'a' AS content), pattern => 'a', limit => 0)", "limit"),
    ("nearest_rows(TABLE(SELECT 1L AS id), query => array(1D))", "embedding"),
    ("nearest_rows(TABLE(SELECT 1L AS id, array(1D) AS embedding), query => array(1D), k => 0)", "k is"),
])
def test_calls_that_cannot_be_answered(spark, call, why):
    with pytest.raises(Exception, match=why):
        spark.sql(f"SELECT * FROM {call}").collect()
