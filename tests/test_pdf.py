import random
import zlib

import pytest
from pyspark.sql import functions as F

from loamline.plans import made
from loamline.sources import pdf as P


def items(data):
    return list(P.rows_of(data))


def words(data):
    return [(r[0], w[4], *(round(x, 2) for x in w[:4])) for r in items(data) for w in r[3] or ()]


def plain(content, fonts="", extra=b"", page=""):
    """A small file with one page in WinAnsi, without a cross-reference table."""
    return (
        b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n"
        + f"3 0 obj << /Type /Page /MediaBox [0 0 200 100] {page} /Contents 4 0 R /Resources << /Font << /F 5 0 R >> /XObject << /X 6 0 R >> >> >> endobj 5 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Courier {fonts} >> endobj\n".encode()
        + b"4 0 obj << /Length %d >>\nstream\n" % len(content) + content + b"\nendstream endobj\n" + extra + b"trailer << /Root 1 0 R >>"
    )


@pytest.mark.parametrize("streams", [True, False])
def test_words_and_boxes_come_back(streams):
    rng = random.Random(4)
    chars = "abcdefghij페이지äöüß()\\<>[]/%😀"
    pages = [{"width": 500, "height": 700, "words": [(10 + 100 * c, 20 + 30 * r, "".join(rng.choices(chars, k=rng.randrange(1, 9)))) for r in range(20) for c in range(4)], "rules": []} for _ in range(5)]
    got = words(made.made_pdf(pages, streams))
    want = [(i, t, x, y - 7.5, x + 5 * len(t), y + 2.5) for i, p in enumerate(pages) for x, y, t in p["words"]]
    assert got == want


def test_updates_win_and_lost_tables_are_scanned():
    data = made.made_pdf([made.page_of("old words here", [["a"]])], False)
    at, start = len(data), data.rindex(b"xref\n0")
    new = b"BT /F1 10 Tf 10 20 Td <0001> Tj ET"
    data += b"8 0 obj << /Length %d >>\nstream\n" % len(new) + new + b"\nendstream endobj\n"
    table = len(data)
    data += b"xref\n8 1\n%010d 00000 n \ntrailer << /Size 9 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, start, table)
    assert len(words(data)) == 1
    assert words(data.replace(b"startxref", b"startyref")) == words(data)


def test_text_state_and_operators():
    content = b"q 1 0 0 1 10 0 cm BT /F 10 Tf 14 TL 0 80 Td (A\\(b\\) \\101) Tj T* [(c) -2000 (d)] TJ (e) ' 5 Ts (f) Tj ET Q BT /F 10 Tf 2 Tc 50 Tz 100 10 Td (gh) Tj ET BI /W 1 /H 1 ID (xx) EI BT 3 Tr /F 10 Tf (hidden) Tj ET"
    got = [(t, x0, x1) for _, t, x0, _, x1, _ in words(plain(content))]
    assert got == [("A(b)", 10, 34), ("A", 40, 46), ("c", 10, 16), ("d", 36, 42), ("e", 10, 16), ("f", 16, 22), ("gh", 100, 107)]


def test_encodings_forms_and_turned_pages():
    diff = plain(b"BT /F 10 Tf 10 50 Td <01024103> Tj ET", "/Encoding << /Differences [1 /eacute /uni20AC 3 /germandbls] >>")
    assert [w[1] for w in words(diff)] == ["é€Aß"]
    form = b"6 0 obj << /Type /XObject /Subtype /Form /Matrix [1 0 0 1 50 0] /Length 35 >>\nstream\nBT /F 10 Tf 10 50 Td (in form) Tj ET \nendstream endobj\n"
    assert [(w[1], w[2]) for w in words(plain(b"/X Do", extra=form))] == [("in", 60), ("form", 78)]
    loop = form.replace(b"BT /F 10 Tf 10 50 Td (in form) Tj ET ", b"/X Do BT /F 10 Tf (a) Tj ET          ")
    assert len(words(plain(b"/X Do", extra=loop))) == 12
    turned = items(plain(b"BT /F 10 Tf 10 50 Td (a) Tj ET", page="/Rotate 90"))
    assert turned[0][1:3] == (100, 200) and turned[0][3][0][0] < 60


@pytest.mark.parametrize("predictor, colors", [(2, 1), (2, 3), (10, 1), (11, 3), (12, 1), (13, 3), (14, 1), (15, 3)])
def test_predictors(predictor, colors):
    rng = random.Random(predictor)
    columns, rows = 7, 9
    raw = [[rng.randrange(256) for _ in range(columns * colors)] for _ in range(rows)]
    coded, before = b"", [0] * columns * colors
    for line in raw:
        kind = 2 if predictor == 2 else rng.randrange(5) if predictor == 15 else predictor - 10
        out = []
        for i, x in enumerate(line):
            left, up, corner = (line[i - colors] if i >= colors else 0), before[i], (before[i - colors] if i >= colors else 0)
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            guess = left if predictor == 2 else (0, left, up, (left + up) // 2, paeth)[kind]
            out.append((x - guess) & 255)
        coded += (b"" if predictor == 2 else bytes([kind])) + bytes(out)
        before = line
    assert P._predicted(coded, {"Predictor": predictor, "Colors": colors, "Columns": columns}) == bytes(sum(raw, []))


def test_damaged_files_are_error_rows():
    good = made.made_pdf([made.page_of("some words", [["a"]])])
    locked = plain(b"").replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")
    for data, why in ((b"", "not a PDF"), (b"%PDF-1.4", "no pages"), (good[:80], "no pages"), (locked, "encrypted"), (plain(b"").replace(b"/Length 0", b"/Length 0 /Filter /LZWDecode"), "unsupported filter")):
        (row,) = items(data)
        assert row[3] is None and why in row[5]
    rng = random.Random(0)
    for _ in range(300):
        data = bytearray(made.made_pdf([made.page_of("some words", [["a"]])], rng.random() < 0.5))
        for _ in range(rng.randrange(1, 30)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        assert items(bytes(data[: rng.randrange(len(data))] if rng.random() < 0.3 else data))


def test_bombs_are_errors(monkeypatch):
    monkeypatch.setattr(P, "MOST_BYTES", 10_000)
    packed = zlib.compress(b" " * 20_000)
    data = plain(b"").replace(b"/Length 0 >>\nstream\n", b"/Filter /FlateDecode /Length %d >>\nstream\n" % len(packed) + packed)
    assert len(items(data)) == 1 and "too large" in items(data)[0][5]


def test_pages_tables_and_errors(spark):
    one = made.page_of("first block of words that is long enough for two lines", [["h|1", "h2"], ["", "x"]])
    one["words"].append((20, 40 + 14 * 1 + 40, "later"))
    two = {"width": 300, "height": 200, "words": [], "rules": [(0, 0, 100, 0)]}
    files = [("a", made.made_pdf([one, two, made.page_of("last", [["t"]])])), ("b", b"junk"), ("c", None)]
    got = {(r["path"], r["page"]): r for r in P.pdf_pages(P.pdf_items(spark.createDataFrame(files, "path string, content binary"))).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0)}
    a = got["a", 0]
    parts = ["first block of words that is long enough\nfor two lines", "later", "| h\\|1 | h2 |\n| --- | --- |\n|  | x |"]
    assert a["content"] == "# 페이지 1\n\n" + "\n\n".join(parts) and a["error"] is None
    assert [a["content"][b["offset"] : b["offset"] + b["length"]] for b in a["blocks"]] == parts
    assert a["blocks"][2]["box"] == [20.0, 118.0, 260.0, 158.0] and a["width"] == made.WIDTH
    assert got["a", 1]["content"] == "" and got["a", 1]["blocks"] == [] and got["a", 2]["content"].startswith("# 페이지 3\n\nlast")
    assert got["b", 0]["content"] is None and "not a PDF" in got["b", 0]["error"]


def test_images(spark):
    raw = bytes(range(12))
    image = b"6 0 obj << /Type /XObject /Subtype /Image /Width 2 /Height 2 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Length 12 >>\nstream\n" + raw + b"\nendstream endobj\n"
    jpeg = image.replace(b"/ColorSpace", b"/Filter /DCTDecode /ColorSpace")
    df = spark.createDataFrame([("p", plain(b"q 50 0 0 50 0 0 cm /X Do Q", extra=image)), ("j", plain(b"/X Do", extra=jpeg)), ("none", plain(b"")), ("bad", b"x")], "path string, content binary")
    got = {r["path"]: r for r in P.pdf_images(df).collect()}
    assert set(got) == {"p", "j"} and got["j"]["format"] == "jpeg" and bytes(got["j"]["image_data"]) == raw
    png = bytes(got["p"]["image_data"])
    assert png.startswith(b"\x89PNG") and zlib.decompress(png[png.index(b"IDAT") + 4 : png.index(b"IEND") - 8]) == b"\0" + raw[:6] + b"\0" + raw[6:]


def test_reader_takes_pdfs(spark, tmp_path):
    from loamline.sources import files as S

    (tmp_path / "x.pdf").write_bytes(made.made_pdf([made.page_of("some words", [["a", "b"]])]))
    got = S.documents(S.binary_files(spark, str(tmp_path)))
    (row,) = got.collect()
    assert row["error"] is None and row["content"].startswith("# 페이지 1\n\nsome words") and "| a | b |" in row["content"]
    assert got.select(F.col("page")).first()[0] == 0


@pytest.mark.parametrize("text", ["BT /F1 10 Tf 1 0 0 1 20 -3.5 Tm <0001 02>Tj ET", "0.5 .5 5. +1 -2 m/Im1 Do", "/A#20B gs true null x", "1.2.3 l 4-5 l", "(a) Tj", "[<00> 3] TJ", "/P <</MCID 0>> BDC", "1 0 R x", "<0 a", "q % c\nQ", "/ gs", "<0a1> Tj", "q BI /W 1 ID x EI Q", ""])
def test_plain_streams_are_read_by_one_search(text):
    data, at, want = text.encode(), 0, []
    while at < len(data):
        x, at = P.parsed(data, at)
        want.append(x)
    got = P.plain_tokens(data)
    assert P.plain_tokens(data, len(data) - 1) is None
    plain = not set("([%") & set(text) and "<<" not in text
    assert got is None or (got, [type(x) for x in got]) == (want, [type(x) for x in want])
    assert (got is not None) or not plain or text in ("1.2.3 l 4-5 l", "1 0 R x", "<0 a", "/ gs", "q BI /W 1 ID x EI Q")
