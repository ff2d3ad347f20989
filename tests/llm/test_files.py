import base64
import hashlib
import io
import uuid
import zipfile
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamline.llm import tokenfiles as T
from loamline.llm import warczip as Z
from loamline.llm.common import shared_dir

PAGES = "page_id long, url string, html string, key string, response string"


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(Z, "PACKAGE", 2000)
    rows = [(i, f"http://x/{i}\r\ny", f"<p>{i % 5}</p>" * (i % 9), "k", "r") for i in range(60)] + [(60, None, None, "", ""), (61, "u", "", "", ""), (62, "u", "é漢" * 40_000, "", ""), (None, "u", "<p>1</p>", "", ""), (59, "again", "<p>4</p>" * 5, "", "")]
    got = sorted((tuple(r) for r in Z.archived(spark, spark.createDataFrame(rows, PAGES)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    by = {}
    for i, _, h, *_ in rows:
        by.setdefault(h or "", []).append(i)
    want = []
    for i, _, h, *_ in rows:
        body = (h or "").encode()
        last = max((x for x in by[h or ""] if x is not None), default=None)
        first = last is None or i == last
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else last))
    assert got == sorted(want, key=str)
    assert Z.archived(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_payloads_and_packages(spark):
    rows = [(1, "u", "same", "", ""), (2, "u", "same", "", ""), (3, "v", "é\r\n\r\nrest", "", "")]
    packages = Z.write(spark.createDataFrame(rows, PAGES), f"{shared_dir(spark)}/loamline/{uuid.uuid4().hex}")
    got = {r.page_id: r for r in Z.scan(packages, payloads=True).collect()}
    assert got["3"].payload.decode() == "é\r\n\r\nrest" and got["2"].payload == b"same" and got["1"].payload is None and got["1"].refers_to == "2"
    path = packages.first().path.removeprefix("file://")
    with zipfile.ZipFile(path) as z:  # the packages are plain ZIP files
        assert z.testzip() is None and sorted(z.namelist()) == [Z.INDEX, Z.RECORDS]
    small = Z.scan(Z.write(spark.createDataFrame(rows, PAGES), f"{shared_dir(spark)}/loamline/{uuid.uuid4().hex}", least=5)).collect()
    assert {r.record_type for r in small} == {"response"}


@pytest.mark.parametrize("zip64", [False, True])
def test_directories_with_and_without_zip64(zip64):
    out = io.BytesIO()
    w = Z.ZipWriter(out, zip64)
    w.member("a", [b"xy", b"z"])
    w.member("b.txt", [b""])
    w.close()
    data = out.getvalue()
    found = Z.members(pa.PythonFile(io.BytesIO(data), mode="r"))
    assert {n: data[at : at + size] for n, (at, size) in found.items()} == {"a": b"xyz", "b.txt": b""}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.read("a") == b"xyz" and z.testzip() is None


def test_damaged_packages_are_errors():
    with pytest.raises(ValueError):
        Z.members(pa.PythonFile(io.BytesIO(b"nothing"), mode="r"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 100)
    with pytest.raises(ValueError):
        Z.members(pa.PythonFile(out, mode="r"))


DOCS = "doc_id long, text string, part string, ids string"


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.vocabulary())


def plain(text):
    return library().encode(text, add_special_tokens=False).ids


def each(encoder, texts):
    ids, n = encoder.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []


def test_token_files(spark):
    rows = [(5, "Hello, WORLD's end"), (2, None), (9, ""), (1, "é é 漢字 😀 a\x1fb\x85c　d <|endoftext|> x<|endoftext|>y"), (7, "word " * 30_000), (3, " \n\t"), (4, "The. the, THE! 123 don't"), (4, "The. the, THE! 123 don't")]
    got = T.token_files(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)).orderBy("doc_id", "start").collect()
    at = 0
    for r, (i, text) in zip(got, sorted(rows, key=lambda r: r[0])):
        ids = np.array([*plain(text or ""), 2], "<u4")
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert T.token_files(spark.createDataFrame([], DOCS)).count() == 0
    null = T.token_files(spark.createDataFrame([(None, "a", "", ""), (1, "b", "", "")], DOCS)).orderBy("start").collect()
    assert [r.doc_id for r in null] == [None, 1]


def test_many_rows_without_an_id_make_several_parts(spark):
    df = spark.createDataFrame([(None, f"text {i}", "", "") for i in range(3000)] + [(7, f"more {i}", "", "") for i in range(1000)], DOCS)
    path = T.new_path(spark, "tokens")
    T.write(df, path)
    parts = {r.part: r["count"] for r in spark.read.parquet(path).groupBy("part").count().collect()}
    assert len(parts) >= 3 and max(parts.values()) < 2500
    got = T.read_back(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 3000 + [7] * 1000
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=4))
def test_word_lookups_equal_the_library(texts):
    assert each(T.Encoder.of(T.vocabulary()), texts) == [plain(t) for t in texts]


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 3)
    encoder, texts = T.Encoder(T.vocabulary()), ["a b c d, e. f! g", "a b h i j, k"]
    for _ in range(2):
        assert each(encoder, texts) == [plain(t) for t in texts]
    assert len(encoder.words) <= 3


@settings(max_examples=80, deadline=None)
@given(st.text("aBsStTvVeElLdDmMéÉßµªº²½×÷' \t\n\x1c\x85\xa0.,;<|>09\u0327\u0301āΣσς漢\u200dİı٠\xad", max_size=60))
def test_parts_of_mixed_scripts_equal_the_library(text):
    assert each(T.Encoder.of(T.vocabulary()), [text, text[::-1]]) == [plain(text), plain(text[::-1])]


def test_another_vocabulary_encodes_whole_texts():
    from tokenizers import Tokenizer

    path, texts = T.vocabulary("byte_bpe_50k.json"), ["Hello  World", "", "don't"]
    assert each(T.Encoder(path), texts) == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_file_format(spark):
    path = f"{shared_dir(spark)}/loamline/{uuid.uuid4().hex}"
    T.write(spark.createDataFrame([(i, "some words here " * (i % 50), "", "") for i in range(300)], DOCS), path)
    import glob

    for f in glob.glob(path.removeprefix("file://") + "/*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings) and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert columns["doc_id"].has_column_index and columns["ids.list.element"].has_offset_index
