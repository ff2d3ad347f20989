"""Files that queries read back, made of rows of the test tables."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

WIDTH, STEP, LINE, SIZE = 600, 14, 8, 10


def made_pdf(pages: list[dict], streams: bool = True) -> bytes:
    """A PDF of pages: width, height, words (x, y from the top, text), rules (x0, y0, x1, y1). One composite font with a ToUnicode map. With
    `streams`, objects lie packed in an object stream under a cross-reference stream, else plain under a table."""
    chars = sorted({c for p in pages for _, _, t in p["words"] for c in t})
    code = {c: i + 1 for i, c in enumerate(chars)}
    maps = "\n".join(f"<{i:04X}> <{c.encode('utf-16-be').hex()}>" for c, i in code.items())
    cmap = f"1 begincodespacerange <0000> <FFFF> endcodespacerange {len(code)} beginbfchar\n{maps}\nendbfchar".encode()
    packed = lambda data, more="": f"<< /Length {len(z := zlib.compress(data))} /Filter /FlateDecode {more}>>\nstream\n".encode() + z + b"\nendstream"
    kids = [7 + 2 * i for i in range(len(pages))]
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Resources << /Font << /F1 3 0 R >> >> >>".encode(), 3: b"<< /Type /Font /Subtype /Type0 /BaseFont /Made /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>", 4: b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Made /DW 500 >>"}
    held = {5: packed(cmap)}
    for k, p in zip(kids, pages):
        draw = [f"BT /F1 {SIZE} Tf 1 0 0 1 {x} {p['height'] - y} Tm <{''.join(f'{code[c]:04X}' for c in t)}> Tj ET" for x, y, t in p["words"]]
        draw += [f"{a} {p['height'] - b} m {c} {p['height'] - d} l S" for a, b, c, d in p["rules"]]
        plain[k] = f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {p['width']} {p['height']}] /Contents {k + 1} 0 R >>".encode()
        held[k + 1] = packed("\n".join(draw).encode())
    out, where = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    if streams:
        heads, body = [], b""
        for n, o in plain.items():
            heads.append(f"{n} {len(body)}")
            body += o + b" "
        first = " ".join(heads) + " "
        held[6] = packed(first.encode() + body, f"/Type /ObjStm /N {len(plain)} /First {len(first)} ")
    else:
        held |= plain
    for n, o in sorted(held.items()):
        where[n] = len(out)
        out += f"{n} 0 obj\n".encode() + o + b"\nendobj\n"
    start, size = len(out), max([*held, *plain]) + 2
    if streams:
        place = {n: i for i, n in enumerate(plain)}
        where[size - 1] = start
        rows = [(2, 6, place[n]) if n in place else (1, where[n], 0) if n in where else (0, 0, 0) for n in range(size)]
        lines = [bytes([t]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for t, a, b in rows]
        up = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(line, before)) for line, before in zip(lines, [bytes(7), *lines]))
        out += f"{size - 1} 0 obj\n".encode() + packed(up, f"/Type /XRef /Size {size} /W [1 4 2] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 7 >> ") + b"\nendobj\n"
    else:
        out += f"xref\n0 {size - 1}\n".encode() + b"".join(f"{where[n]:010d} 00000 n \n".encode() if n in where else b"0000000000 65535 f \n" for n in range(size - 1)) + f"trailer << /Size {size - 1} /Root 1 0 R >>\n".encode()
    return bytes(out + f"startxref\n{start}\n%%EOF\n".encode())


def page_of(text: str, cells: list[list[str]]) -> dict:
    """Words of a text in lines of LINE words, and a ruled table of single-word cells 50 points below."""
    words, at = [], 40
    tokens = re.findall(r"[^\x09-\x0d ]+", text or "")
    for i in range(0, len(tokens), LINE):
        x = 20
        for t in tokens[i : i + LINE]:
            words.append((x, at, t))
            x += SIZE / 2 * (len(t) + 1)
        at += STEP
    top, wide = at + 50, 120
    for r, row in enumerate(cells):
        words += [(25 + wide * c, top + 20 * r + 14, t) for c, t in enumerate(row) if t]
    right, bottom = 20 + wide * len(cells[0]), top + 20 * len(cells)
    rules = [(20, top + 20 * r, right, top + 20 * r) for r in range(len(cells) + 1)] + [(20 + wide * c, top, 20 + wide * c, bottom) for c in range(len(cells[0]) + 1)]
    return {"width": WIDTH, "height": bottom + 40, "words": words, "rules": rules}


def pdf_files(turns: DataFrame) -> DataFrame:
    """(path, content): a PDF of one page for each of turns (path, role, text), with its text and a table of its role and length."""

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in stream:
            files = [made_pdf([page_of(t, [["role", "words"], [r or "", str(len(re.findall(r"[^\x09-\x0d ]+", t or "")))]])]) for r, t in zip(batch["role"], batch["text"])]
            yield pd.DataFrame({"path": batch["path"], "content": files})

    return turns.select("path", "role", "text").mapInPandas(run, "path string, content binary")
