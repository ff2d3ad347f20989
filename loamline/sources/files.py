"""Readers: folders of files to parsed rows, tables in files, listings, and records of other systems.

Binary formats are parsed per row in Arrow-batched maps over Spark's `binaryFile` source, so reading parallelises over
files; what cannot be parsed becomes a row with its error. Formats without a reader here go to a parser that the caller
registers.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions.text import file_extension, key_value_lines, markdown_table, page_text
from . import hwp, pdf

IMAGES = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_PLACEHOLDER = re.compile(r"\[[^\[\]\n]+\]")

#: bytes to (page from 0, text) pairs, by extension.
PARSERS: dict[str, Callable[[bytes], list[tuple[int, str]]]] = {}


def parser(*extensions: str):
    """Registers a parser for extensions; a later one takes the place of an earlier."""

    def add(f: Callable[[bytes], list[tuple[int, str]]]):
        PARSERS.update(dict.fromkeys(extensions, f))
        return f

    return add


@parser("txt", "md")
def _text(data: bytes) -> list[tuple[int, str]]:
    return [(0, data.decode("utf-8-sig"))]


def _paragraph(p: ElementTree.Element) -> str:
    marks = {_W + "tab": "\t", _W + "br": "\n"}
    return "".join(x.text or "" if x.tag == _W + "t" else marks.get(x.tag, "") for x in p.iter())


def _table(rows: list[list[str]]) -> str:
    """As `markdown_table`, in Python."""
    if not rows:
        return "(empty table)"
    width = max(map(len, rows))
    cells = [[c.strip().replace("\n", " / ").replace("|", r"\|") for c in r] + [""] * (width - len(r)) for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [cells[0], ["---"] * width, *cells[1:]])


def _marked(p: ElementTree.Element, notes: dict[str, dict], media: dict[str, str], row: int | None = None, column: int | None = None) -> tuple[str, list[dict], list[str]]:
    """A paragraph's text, its comments (with the text they are about, by offsets in the paragraph, and the table cell) and its images."""
    at, starts, anchors, length = {}, {}, {}, 0
    for x in p.iter():
        if x.tag == _W + "t":
            length += len(x.text or "")
        elif x.tag in (_W + "tab", _W + "br"):
            length += 1
        elif x.tag == _W + "commentRangeStart":
            starts[x.get(_W + "id")] = length
        elif x.tag == _W + "commentRangeEnd":
            anchors[x.get(_W + "id")] = (starts.get(x.get(_W + "id"), 0), length)
        elif x.tag == _W + "commentReference":
            at[x.get(_W + "id")] = length
    text, comments = _paragraph(p), []
    for i in sorted({*anchors, *at}, key=str):
        start, end = anchors.get(i, (at.get(i, 0),) * 2)
        comments.append({"id": i, **notes.get(i, {"author": "", "date": "", "text": ""}), "start": start, "end": end, "anchor": text[start:end], "row": row, "column": column})
    return text, comments, [media[i] for x in p.iter() for i in (x.get(_R + "embed"), x.get(_R + "id")) if i in media]


def docx_blocks(data: bytes) -> list[dict]:
    """Paragraphs and tables of a DOCX in order: type, index, text, Markdown, comments, [placeholders] with offsets, and the media its
    images point at. Of a table, comments and images are those of its cells, comments with their row and column (from 0). A body
    without any such text (all of it in content controls, say) gives the paragraphs that lie anywhere in it."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
        names = z.namelist()
        notes = {}
        if "word/comments.xml" in names:
            for c in ElementTree.fromstring(z.read("word/comments.xml")).iter(_W + "comment"):
                notes[c.get(_W + "id")] = {"author": c.get(_W + "author") or "", "date": c.get(_W + "date") or "", "text": "\n".join(map(_paragraph, c.iter(_W + "p")))}
        media = {}
        if "word/_rels/document.xml.rels" in names:
            for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")):
                if "image" in r.get("Type", ""):
                    media[r.get("Id")] = posixpath.normpath(posixpath.join("word", r.get("Target", "")))
    out: list[dict] = []

    def add(kind: str, text: str, comments: list[dict], images: list[str]) -> None:
        out.append({"type": kind, "index": len(out), "text": text, "markdown": text, "comments": comments, "placeholders": [{"marker": m[0], "offset": m.start()} for m in _PLACEHOLDER.finditer(text)], "images": images, "n_comments": len(notes)})

    for child in body if body is not None else []:
        if child.tag == _W + "p":
            add("paragraph", *_marked(child, notes, media))
        elif child.tag == _W + "tbl":
            cells = [[[_marked(p, notes, media, i, j) for p in c.iter(_W + "p")] for j, c in enumerate(r.iter(_W + "tc"))] for i, r in enumerate(child.iter(_W + "tr"))]
            parts = [x for r in cells for c in r for x in c]
            add("table", _table([["\n".join(t for t, _, _ in c) for c in r] for r in cells]), [n for _, ns, _ in parts for n in ns], [i for _, _, images in parts for i in images])
    if body is not None and not any(b["text"].strip() for b in out):
        out.clear()
        for p in body.iter(_W + "p"):
            if _paragraph(p).strip():
                add("paragraph", *_marked(p, notes, media))
    return out


@parser("docx")
def _docx(data: bytes) -> list[tuple[int, str]]:
    return [(0, "\n\n".join(b["markdown"] for b in docx_blocks(data) if b["markdown"].strip()))]


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


@parser("pptx")
def _pptx(data: bytes) -> list[tuple[int, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = [ElementTree.fromstring(z.read(n)) for n in _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml")]
    return [(i, "\n".join("".join(t.text or "" for t in p.iter(_A + "t")) for p in s.iter(_A + "p"))) for i, s in enumerate(slides)]


def xlsx_sheets(data: bytes, formula_rows: int = 200) -> list[dict]:
    """Name, rows of text, and whether there are formulas (in the first rows) and merged cells, of each sheet; named ranges."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(_S + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        titles = [s.get("name") for s in book.iter(_S + "sheet")]
        ranges = {d.get("name"): d.text for d in book.iter(_S + "definedName")}
        out = []
        for title, n in zip(titles, _numbered(names, r"xl/worksheets/sheet(\d+)\.xml")):
            sheet, rows, formulas = ElementTree.fromstring(z.read(n)), [], False
            for r in sheet.iter(_S + "row"):
                cells: dict[int, str] = {}
                for c in r.iter(_S + "c"):
                    letters = re.match("[A-Z]*", c.get("r") or "")[0]
                    col = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
                    v = c.find(_S + "v")
                    value = "".join(t.text or "" for t in c.iter(_S + "t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                    cells[col] = shared[int(value)] if c.get("t") == "s" and value else value
                    formulas |= len(rows) < formula_rows and c.find(_S + "f") is not None
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            out.append({"name": title, "rows": rows, "has_formulas": formulas, "has_merged": sheet.find(_S + "mergeCells") is not None, "ranges": ranges})
        return out


@parser("xlsx")
def _xlsx(data: bytes) -> list[tuple[int, str]]:
    return [(i, f"# {s['name']}\n\n{_table(s['rows'])}") for i, s in enumerate(xlsx_sheets(data))]


@parser("hwpx")
def _hwpx(data: bytes) -> list[tuple[int, str]]:
    """Paragraph text of each section; text in tables comes as its cells."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sections = [ElementTree.fromstring(z.read(n)) for n in _numbered(z.namelist(), r"Contents/section(\d+)\.xml")]
    out = []
    for i, s in enumerate(sections):
        parts = []
        for p in s:
            for t in (x for x in p.iter() if local(x) == "tbl"):
                parts.append(_table([["".join(y.text or "" for y in c.iter() if local(y) == "t") for c in r if local(c) == "tc"] for r in t if local(r) == "tr"]))
            inside = {id(y) for t in p.iter() if local(t) == "tbl" for y in t.iter()}
            text = "".join(x.text or "" for x in p.iter() if local(x) == "t" and id(x) not in inside)
            parts += [text] if text.strip() else []
        out.append((i, "\n\n".join(parts)))
    return out


@parser("hwp")
def _hwp(data: bytes) -> list[tuple[int, str]]:
    return hwp.pages(data, _table)


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, file_name, file_type, size_bytes, modified_time, content) of all files below a folder."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.url_decode(F.substring_index("path", "/", -1))
    return b.select("path", name.alias("file_name"), file_extension(name).alias("file_type"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_time"), "content")


def documents(files: DataFrame, parsers: dict[str, Callable] | None = None) -> DataFrame:
    """One row for each page: path, file_name, file_type, page, content, error. Unknown types and unreadable files
    give one row with an error; images have empty content. parsers: added to those registered; a registered parser for PDF
    takes the place of the reader in `sources.pdf`, whose pages are laid out by columns in the same pass."""
    known = PARSERS | (parsers or {})
    names = ["path", "file_name", "file_type", "page", "content", "words", "tables", "error"]
    kinds = dict(zip(("page", "width", "height", "words", "tables", "error"), pdf.ITEMS.split(", ")))
    schema = f"path string, file_name string, file_type string, page int, content string, {kinds['words']}, {kinds['tables']}, error string"

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in stream:
            rows = []
            for path, name, kind, data in batch.itertuples(index=False):
                if kind == "pdf" and kind not in known:
                    rows += [(path, name, kind, page, None, words, tables, error) for page, _, _, words, tables, error in pdf.rows_of(bytes(data))]
                    continue
                try:
                    pages = [(0, "")] if kind in IMAGES else known[kind](bytes(data))
                    rows += [(path, name, kind, p, t.replace("\x00", ""), None, None, None) for p, t in pages]
                except KeyError if kind not in known else Exception as e:
                    rows.append((path, name, kind, 0, None, None, None, f"unsupported: {kind}" if kind not in known else f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names)

    found = files.select("path", "file_name", "file_type", "content").mapInPandas(run, schema)
    found = found.withColumn("parts", pdf.page_parts(F.col("words"), F.col("tables")))
    content = F.when(F.col("parts").isNotNull(), pdf.page_content(F.col("page"), F.col("parts"))[0]).otherwise(F.col("content"))
    return found.select("path", "file_name", "file_type", "page", content.alias("content"), "error")


def stored_pages(docs: DataFrame) -> DataFrame:
    """Page rows to store: numbers from 1, cleaned text, blank pages left out without renumbering."""
    p = docs.where("error is null").withColumns({"page_number": F.col("page") + 1, "content": page_text(F.col("content"))})
    return p.where("content <> ''").drop("page", "error")


def embedded_images(files: DataFrame) -> DataFrame:
    """One row for each image in DOCX, PPTX and PDF files: image_id, image_name, image_index, format (by magic bytes), image_data."""
    schema = "path string, image_id string, image_name string, image_index int, image_data binary"

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in stream:
            rows = []
            for path, name, kind, data in batch.itertuples(index=False):
                if kind == "pdf":
                    rows += [(path, f"{name}_img{i}", f"p{page}_i{i}.{form}", i, image) for i, (page, form, image) in enumerate(pdf.images_of(bytes(data)))]
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                        media = [n for n in z.namelist() if re.match(r"(word|ppt)/media/.", n)]
                        rows += [(path, f"{name}_img{i}", posixpath.basename(n), i, z.read(n)) for i, n in enumerate(media)]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["path", "image_id", "image_name", "image_index", "image_data"])

    images = files.where(F.col("file_type").isin("docx", "pptx", "pdf")).select("path", "file_name", "file_type", "content").mapInPandas(run, schema)
    return images.withColumn("format", image_format(F.col("image_data"), F.col("image_name")))


def image_format(data: Column, name: Column) -> Column:
    """By the file's first bytes, else its extension."""
    head = F.hex(F.substring(data, 1, 4))
    return F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("47494638"), "gif").when(head.startswith("424D"), "bmp").when(head.startswith("52494646"), "webp").otherwise(file_extension(name))


def delimited(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV or TSV (by extension) with a header: UTF-8 if all its lines are, else CP949 if they are that, else Latin-1.
    Lines are checked where they lie, and Spark's reader splits the file over tasks, unless multi_line says that quoted
    cells hold line feeds."""
    options = {"sep": "\t" if path.lower().endswith(".tsv") else ",", "header": True, "inferSchema": True}

    def sound(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ok = {"utf-8": True, "cp949": True}
        for batch in stream:
            for line in batch["line"]:
                for encoding in [e for e in ok if ok[e]]:
                    try:
                        bytes(line).decode(encoding)
                    except UnicodeDecodeError:
                        ok[encoding] = False
        yield pd.DataFrame({"utf8": [ok["utf-8"]], "cp949": [ok["cp949"]]})

    utf8, cp949 = spark.read.text(path).select(F.col("value").cast("binary").alias("line")).mapInPandas(sound, "utf8 boolean, cp949 boolean").agg(F.min("utf8"), F.min("cp949")).first()
    if utf8 is not False or cp949 is False:
        return spark.read.csv(path, encoding="ISO-8859-1" if utf8 is False else "UTF-8", multiLine=multi_line, **options)

    # in CP949 no byte of a double-byte character is a delimiter, a quote or a line feed, so Spark's reader may take the file as Latin-1,
    # a character a byte, in as many splits as it likes; then the cells that are text get their characters
    rows = spark.read.csv(path, encoding="ISO-8859-1", multiLine=multi_line, **options)
    name = lambda c: c.encode("latin-1").decode("cp949", "replace")
    return rows.select(*((_cp949(F.col(f"`{c}`")) if t == "string" else F.col(f"`{c}`")).alias(name(c)) for c, t in rows.dtypes))


@F.pandas_udf(StringType())
def _cp949(cells: pd.Series) -> pd.Series:
    return cells.map(lambda x: None if x is None else x.encode("latin-1").decode("cp949", "replace"))


def records(rows: DataFrame, options: dict[str, str], output: str = "output") -> DataFrame:
    """Documents of business records: those that have every value of options and an output (map), as 'key: value' lines."""
    for k, v in options.items():
        rows = rows.where(F.col(k) == v)
    return rows.where(F.col(output).isNotNull()).withColumn("content", key_value_lines(F.col(output)))


def report_fields(items: DataFrame, forms: DataFrame) -> DataFrame:
    """The report and slide fields of work items (form_id, tenant_id, output map) by their forms (fields array of struct key, type)."""
    f = items.join(forms, ["form_id", "tenant_id"]).withColumn("field", F.explode("fields")).where(F.col("field.type").isin("report", "slide"))
    return f.withColumn("content", F.try_element_at("output", F.col("field.key"))).where("content is not null")


def glossary_terms(terms: DataFrame, top_k: int) -> DataFrame:
    """Documents of glossary terms (name, description), the first by name: blank names left out, a blank description is a dash."""
    t = terms.where(F.trim(F.coalesce("name", F.lit(""))) != "").orderBy("name", "description").limit(max(1, min(20, top_k)))
    return t.withColumn("content", F.concat_ws("\n", F.concat(F.lit("용어: "), "name"), F.concat(F.lit("설명: "), F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.lit("-")))))


def page_layout(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """A page's text from layout blocks (keys, y, text): from top to bottom under its heading, with each block's offset."""
    parts = F.array_sort(F.collect_list(F.struct("y", "text", "bbox")))
    g = blocks.groupBy(*keys, "page").agg(parts.alias("b"))
    head = F.concat(F.lit("# 페이지 "), (F.col("page") + 1).cast("string"), F.lit("\n\n"))
    at = F.aggregate("b", F.struct(F.length(head).alias("n"), F.array().cast("array<struct<offset:int,length:int,bbox:array<double>>>").alias("out")), lambda s, x: F.struct((s["n"] + F.length(x["text"]) + 1).alias("n"), F.concat(s["out"], F.array(F.struct(s["n"].alias("offset"), F.length(x["text"]).alias("length"), x["bbox"].alias("bbox")))).alias("out")), lambda s: s["out"])
    return g.select(*keys, "page", F.concat(head, F.array_join(F.transform("b", lambda x: x["text"]), "\n")).alias("content"), at.alias("blocks"))


def tables_as_markdown(df: DataFrame, rows_col: str) -> DataFrame:
    return df.withColumn("markdown", markdown_table(F.col(rows_col)))


def page_blocks(words: DataFrame, keys: list[str], gap: float = 20.0) -> DataFrame:
    """Text blocks of words (keys, top, x0, text): words at one height (1 decimal) are a line, from left to right; lines
    more than `gap` apart start a new block. Returns keys, y (of the first line) and content."""
    y = F.round("top", 1)
    lines = words.groupBy(*keys, y.alias("y")).agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("w"))
    w = Window.partitionBy(*keys).orderBy("y")
    new = F.coalesce((F.col("y") - F.lag("y").over(w) > gap).cast("int"), F.lit(1))
    lines = lines.withColumn("new", new).withColumn("block", F.sum("new").over(w))
    line = F.array_join(F.transform("w", lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    g = lines.groupBy(*keys, "block").agg(F.min("y").alias("y"), F.array_sort(F.collect_list(F.struct("y", line.alias("t")))).alias("l"))
    return g.select(*keys, "y", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("content"))


_COMMENT = "struct<id:string,author:string,date:string,text:string,start:int,end:int,anchor:string,row:int,column:int>"
_BLOCK = f"type string, index int, text string, markdown string, comments array<{_COMMENT}>, placeholders array<struct<marker:string,offset:int>>, images array<string>, n_comments int"


def docx_structure(files: DataFrame) -> DataFrame:
    """A row for each block of DOCX files (path, file_type, content), as of `docx_blocks`, with path and error; n_comments counts all
    comments of the file. What cannot be read is a row with an error, and a file without blocks one without a type."""
    names = [x.split()[0] for x in _BLOCK.split(", ")]

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in stream:
            rows = []
            for path, data in batch.itertuples(index=False):
                try:
                    blocks = docx_blocks(bytes(data))
                    rows += [(path, *(b[n] for n in names), None) for b in blocks] or [(path, *[None] * len(names), None)]
                except Exception as e:
                    rows.append((path, *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", *names, "error"])

    return files.where("file_type = 'docx'").select("path", "content").mapInPandas(run, f"path string, {_BLOCK}, error string")


def extraction_stats(blocks: DataFrame) -> DataFrame:
    """What was found in each file of `docx_structure`: path, paragraph_count, table_count, comment_count, placeholder_count (of paragraphs),
    image_count and flat_text_chars (blocks with text, a blank line between). Files with an error have none."""
    sizes = lambda c: F.coalesce(F.sum(F.size(F.coalesce(c, F.array()))), F.lit(0))
    text = F.trim(F.regexp_replace(F.coalesce("markdown", F.lit("")), r"\s+", " ")) != ""
    chars = F.sum(F.when(text, F.length("markdown") + 2).otherwise(0))
    return blocks.where("error is null").groupBy("path").agg(
        F.count_if(F.col("type") == "paragraph").alias("paragraph_count"),
        F.count_if(F.col("type") == "table").alias("table_count"),
        F.coalesce(F.max("n_comments"), F.lit(0)).cast("long").alias("comment_count"),
        sizes(F.when(F.col("type") == "paragraph", F.col("placeholders"))).alias("placeholder_count"),
        sizes(F.col("images")).alias("image_count"),
        F.greatest(chars - 2, F.lit(0)).alias("flat_text_chars"),
    )
