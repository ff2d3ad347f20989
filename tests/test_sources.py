import io
import zipfile

from pyspark.sql import functions as F

from loamline.sources import files as S
from loamline.streaming import events as E

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


def docx():
    body = (
        f'<w:document {W}><w:body><w:p><w:r><w:t>Dear </w:t></w:r><w:commentRangeStart w:id="0"/><w:r><w:t>[name]</w:t></w:r><w:commentRangeEnd w:id="0"/><w:r><w:tab/><w:t>hi</w:t><w:commentReference w:id="1"/></w:r>'
        '<w:r><a:blip r:embed="rId1"/></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/comments.xml", f'<w:comments {W}><w:comment w:id="0" w:author="me"><w:p><w:r><w:t>who?</w:t></w:r></w:p></w:comment></w:comments>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId1" Type="x/image" Target="media/p.png"/></Relationships>')
        z.writestr("word/media/p.png", b"\x89PNG....")
    return out.getvalue()


def xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {X}><sheets><sheet name="S1" sheetId="1"/></sheets><definedNames><definedName name="all">S1!A1:C2</definedName></definedNames></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {X}><si><t>head</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {X}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="B2"><f>1+1</f><v>2</v></c></row></sheetData><mergeCells/></worksheet>')
    return out.getvalue()


def test_docx_blocks():
    p, t = S.docx_blocks(docx())
    assert p["text"] == "Dear [name]\thi" and p["placeholders"] == [{"marker": "[name]", "offset": 5}] and p["images"] == ["word/media/p.png"]
    assert [(c["id"], c["anchor"], c["text"]) for c in p["comments"]] == [("0", "[name]", "who?"), ("1", "", "")]
    assert t["markdown"] == "| a\\|b |  |\n| --- | --- |\n| c |  |"


def test_xlsx_sheets():
    (s,) = S.xlsx_sheets(xlsx())
    assert s["name"] == "S1" and s["rows"] == [["head", "", "3"], ["", "2"]] and s["has_formulas"] and s["has_merged"] and s["ranges"] == {"all": "S1!A1:C2"}


def test_folder_to_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a b.txt").write_bytes("﻿plain\x00 text ".encode())
    (tmp_path / "sub" / "d.docx").write_bytes(docx())
    (tmp_path / "x.xlsx").write_bytes(xlsx())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "y.odd").write_bytes(b"?")
    (tmp_path / "y.hwp").write_bytes(b"?")
    (tmp_path / "i.png").write_bytes(b"\x89PNG")
    (tmp_path / "h.hwpx").write_bytes(packed(**{"Contents__section0_dot_xml": "<s><p><t>one</t></p><p><tbl><tr><tc><t>x</t></tc></tr></tbl></p></s>"}))
    files = S.binary_files(spark, str(tmp_path))
    docs = S.documents(files)
    rows = {r.file_name: r for r in docs.collect()}
    assert rows["a b.txt"].content == "plain text " and rows["i.png"].content == "" and rows["y.odd"].error == "unsupported: odd" and rows["y.hwp"].error == "Damaged: not a compound file"
    assert rows["bad.docx"].content is None and rows["bad.docx"].error.startswith("BadZipFile")
    assert rows["d.docx"].content.startswith("Dear [name]") and rows["x.xlsx"].content.startswith("# S1\n\n| head |  | 3 |")
    assert rows["h.hwpx"].content == "one\n\n| x |\n| --- |"
    pages = {r.file_name: r for r in S.stored_pages(docs).collect()}
    assert pages["a b.txt"].content == "plain text" and pages["a b.txt"].page_number == 1 and "i.png" not in pages
    image = S.embedded_images(files).first()
    assert (image.image_id, image.image_name, image.format) == ("d.docx_img0", "p.png", "png")


def test_delimited(spark, tmp_path):
    (tmp_path / "k.csv").write_bytes("이름,n\n가,1\n".encode("cp949"))
    (tmp_path / "u.tsv").write_bytes("a\tb\nx\t2\n".encode("utf-8"))
    assert [tuple(r) for r in S.delimited(spark, str(tmp_path / "k.csv")).collect()] == [("가", 1)]
    assert S.delimited(spark, str(tmp_path / "u.tsv")).columns == ["a", "b"]


def test_records_and_terms(spark):
    d = spark.createDataFrame([("p", {"b": "2", "a": None}), ("p", None), ("q", {"x": "1"})], "proc string, output map<string,string>")
    assert [r.content for r in S.records(d, {"proc": "p"}).collect()] == ["a: None\nb: 2"]
    t = spark.createDataFrame([("n", " "), (" ", "x")], "name string, description string")
    assert [r.content for r in S.glossary_terms(t, 5).collect()] == ["용어: n\n설명: -"]


def test_page_layout(spark):
    b = spark.createDataFrame([("f", 0, 9.0, "low", [0.0] * 4), ("f", 0, 1.0, "top", [1.0] * 4)], "file string, page int, y double, text string, bbox array<double>")
    r = S.page_layout(b, ["file"]).first()
    assert r.content == "# 페이지 1\n\ntop\nlow" and [r.content[x.offset : x.offset + x.length] for x in r.blocks] == ["top", "low"]


def test_stream_of_files_is_ingested_once(spark, tmp_path):
    src, sink, mark = (str(tmp_path / x) for x in ("src", "sink", "mark"))
    rows = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id int, text string").coalesce(1).write.mode("append").parquet(src)
    rows(1, 2)
    for _ in range(2):
        E.ingest(spark, src, spark.read.parquet(src).schema, sink, mark, lambda d: d.withColumn("n", F.length("text"))).awaitTermination()
    rows(3)
    E.ingest(spark, src, spark.read.parquet(src).schema, sink, mark, lambda d: d.withColumn("n", F.length("text"))).awaitTermination()
    assert sorted((r.id, r.n) for r in spark.read.parquet(sink).collect()) == [(1, 2), (2, 2), (3, 2)]


def test_stream_sessions_equal_the_batch(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.sql("select * from values (1, timestamp_ntz'2024-01-01 00:00:00', 1.0), (1, timestamp_ntz'2024-01-01 00:05:00', 2.0), (1, timestamp_ntz'2024-01-01 02:00:00', 4.0), (2, timestamp_ntz'2024-01-01 00:00:00', 8.0) as t(user_id, ts, value)").coalesce(1).write.parquet(src)
    batch = {tuple(r) for r in E.session_metrics(spark.read.parquet(src)).collect()}
    stream = E.session_metrics(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src))
    stream.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("sessions").collect()} == batch and len(batch) == 3
    assert E.tumbling_metrics(spark.read.parquet(src).withColumn("event_type", F.lit("x"))).count() == 2


def docx_of(body, comments="", rels=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/comments.xml", f"<w:comments {W}>{comments}</w:comments>")
        z.writestr("word/_rels/document.xml.rels", f"<Relationships>{rels}</Relationships>")
    return out.getvalue()


CELL = '<w:tc><w:p><w:commentRangeStart w:id="7"/><w:r><w:t>price</w:t></w:r><w:commentRangeEnd w:id="7"/><w:r><w:t> now</w:t></w:r><w:r><a:blip r:embed="rId9"/></w:r></w:p></w:tc>'
IN_CELLS = docx_of(
    f"<w:p><w:r><w:t>top [x]</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc>{CELL}</w:tr></w:tbl>",
    '<w:comment w:id="7" w:author="me"><w:p><w:r><w:t>too high</w:t></w:r></w:p></w:comment><w:comment w:id="8" w:author="you"><w:p/></w:comment>',
    '<Relationship Id="rId9" Type="x/image" Target="media/q.png"/>',
)


def test_comments_and_images_in_cells():
    p, t = S.docx_blocks(IN_CELLS)
    assert t["images"] == ["word/media/q.png"] and p["comments"] == []
    assert t["comments"] == [{"id": "7", "author": "me", "date": "", "text": "too high", "start": 0, "end": 5, "anchor": "price", "row": 0, "column": 1}]


def test_structure_statistics_and_errors(spark):
    inner = docx_of("<w:sdt><w:sdtContent><w:p><w:r><w:t>inside</w:t></w:r></w:p><w:p/></w:sdtContent></w:sdt>")
    files = spark.createDataFrame([("a", "docx", IN_CELLS), ("b", "docx", b"junk"), ("c", "docx", inner), ("d", "docx", docx_of("")), ("e", "txt", b"no")], "path string, file_type string, content binary")
    blocks = S.docx_structure(files)
    got = {r["path"]: tuple(r)[1:] for r in S.extraction_stats(blocks).collect()}
    assert got == {"a": (1, 1, 2, 1, 1, len("top [x]\n\n| a | price now |\n| --- | --- |")), "c": (1, 0, 0, 0, 0, 6), "d": (0, 0, 0, 0, 0, 0)}
    assert [r["path"] for r in blocks.where("error is not null").collect()] == ["b"]
    assert S._docx(inner) == [(0, "inside")]
