"""Chunkers: one row of text to many chunk rows, with chunk_index and total_chunks for each file.

`fixed_token_chunks` and the sentence split are built-in expressions. Splitters whose next cut depends on the last one
(recursive, Markdown headers, semantic) run as Arrow-batched maps over rows; a row is a page or a document, and rows
parallelise freely. Every chunker carries true offsets, so repeated text cannot move a chunk.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..session import sliced

SIZE, OVERLAP = 800, 100
SEPARATORS = ("\n\n", "\n", ".", "!", "?", " ", "")
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9])"


def fixed_token_chunks(docs: DataFrame, text_col: str = "content", size: int = 50, overlap: int = 10) -> DataFrame:
    """Windows of `size` words, each `size - overlap` (at least 1) words on from the last, until one reaches the end.
    Texts without words have no chunks."""
    step = max(1, size - overlap)
    words = F.array_remove(F.split(F.col(text_col), r"\s+"), "")

    def windows(w: Column) -> Column:
        m = 1 + F.ceil(F.greatest(F.size(w) - size, F.lit(0)) / step).cast("int")
        some = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(size)), " "))
        return F.when(F.size(w) > 0, some)

    # the words are bound once, and a document's rows carry its chunks only; from an inner explode the optimizer would
    # infer a filter that makes the chunks a second time
    chunks = F.transform(F.array(words), windows)[0]
    d = docs.select(*[c for c in docs.columns if c != text_col], chunks.alias("_chunks"))
    d = d.select("*", F.size("_chunks").cast("long").alias("total_chunks"), F.posexplode_outer("_chunks").alias("chunk_index", text_col)).where("chunk_index is not null")
    return d.select(*[c for c in docs.columns if c != text_col], F.col("chunk_index").cast("long").alias("chunk_index"), "total_chunks", text_col)


def fixed_split(text: str, size: int = 50, overlap: int = 10) -> list[tuple[int, str]]:
    """The same windows of one text, each with the offset of its first word."""
    words = [(m.start(), m[0]) for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text)]
    step = max(1, size - overlap)
    starts = range(0, max(len(words) - size, 0) + step, step) if words else ()
    return [(words[i][0], " ".join(w for _, w in words[i : i + size])) for i in starts]


# --- splitters on one text: (start, text) pieces in order ---
def _parts(text: str, start: int, separator: str) -> list[tuple[int, str]]:
    """Pieces that each begin with the separator, but for the first."""
    if not separator:
        return [(start + i, c) for i, c in enumerate(text)]
    cuts = [m.start() for m in re.finditer(re.escape(separator), text)]
    edges = sorted({0, *cuts, len(text)})
    return [(start + a, text[a:b]) for a, b in zip(edges, edges[1:])]


def _packed(parts: list[tuple[int, str]], size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """Neighbouring parts joined to at most `size` characters; a chunk begins with up to `overlap` of the last one's."""
    held: list[tuple[int, str]] = []
    length = 0
    for at, part in parts:
        if held and length + len(part) > size:
            yield held[0][0], "".join(p for _, p in held)
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0)[1])
        held.append((at, part))
        length += len(part)
    if held:
        yield held[0][0], "".join(p for _, p in held)


def recursive_split(text: str, size: int = SIZE, overlap: int = OVERLAP, start: int = 0, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, str]]:
    """Split by the first separator the text has; what is still too long by the ones after it. Chunks are stripped and
    empty ones dropped; each comes with its offset."""
    n = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    rest = separators[n + 1 :]
    out: list[tuple[int, str]] = []
    small: list[tuple[int, str]] = []

    def flush() -> None:
        for at, chunk in _packed(small, size, overlap):
            body = chunk.strip()
            if body:
                out.append((at + len(chunk) - len(chunk.lstrip()), body))
        small.clear()

    for at, part in _parts(text, start, separators[n]):
        if len(part) < size:
            small.append((at, part))
            continue
        flush()
        if rest:
            out.extend(recursive_split(part, size, overlap, at, rest))
        elif part.strip():
            out.append((at, part.strip()))
    flush()
    return out


def header_sections(text: str) -> list[tuple[int, str, list[str]]]:
    """(start, section, titles of levels 1 to 4) of a Markdown text, cut before each header of those levels."""
    titles, sections, at, begin, fenced = [""] * 4, [], 0, 0, False
    kept = list(titles)
    for line in text.splitlines(keepends=True):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        m = None if fenced else re.match(r"(#{1,4})[ \t]+(.+)", line)
        if m:
            if text[begin:at].strip():
                sections.append((begin, text[begin:at], kept))
            level = len(m[1])
            titles[level - 1 :] = [m[2].strip(), *[""] * (4 - level)]
            kept, begin = list(titles), at
        at += len(line)
    if text[begin:].strip():
        sections.append((begin, text[begin:], kept))
    return sections


def header_split(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, str, list[str]]]:
    """Sections with their headers; one longer than size in recursive pieces."""
    out = []
    for at, body, titles in header_sections(text):
        lead = len(body) - len(body.lstrip())
        whole = body.strip()
        pieces = [(at + lead, whole)] if len(whole) <= size else recursive_split(body, size, overlap, at)
        out += [(a, p, titles) for a, p in pieces]
    return out


def semantic_split(text: str, similar: Callable[[list[str]], list[float]] | None = None, threshold: float = 0.78, least: int = 2, size: int = SIZE) -> list[tuple[int, str]]:
    """Sentences grouped until the next one is unlike the last (and the group has `least`) or would make it too long.
    similar: cosines of neighbours; without an embedder all are 0, which gives groups of `least`."""
    spans, at = [], 0
    for m in re.finditer(SENTENCE_END, text):
        spans.append((at, text[at : m.start()]))
        at = m.end()
    spans = [(a + len(s) - len(s.lstrip()), s.strip()) for a, s in [*spans, (at, text[at:])] if s.strip()]
    if len(spans) <= least:
        return [(spans[0][0], text.strip())] if spans else []
    near = similar([s for _, s in spans]) if similar else [0.0] * (len(spans) - 1)
    out, group = [], [spans[0]]
    for (a, s), cos in zip(spans[1:], near):
        length = sum(len(g) + 1 for _, g in group) - 1
        if (cos < threshold and len(group) >= least) or length + 1 + len(s) > size:
            out.append((group[0][0], " ".join(g for _, g in group)))
            group = []
        group.append((a, s))
    return [*out, (group[0][0], " ".join(g for _, g in group))]


_FIELDS = "chunk_index int, total_chunks int, start_index int, section_path string, h1 string, h2 string, h3 string, h4 string, chunker_name string, chunk string"


def _chunked(docs: DataFrame, text_col: str, name: str, split: Callable[[str], list[tuple]] | None, batches: Callable[[], Callable[[list], list]] | None = None) -> DataFrame:
    """split: the pieces of a text. batches: built once for each task, the pieces of each of some texts (those of a frame of `sliced`)."""
    rest = [c for c in docs.columns if c != text_col]
    schema = StructType([*docs.select(*rest).schema.fields, *StructType.fromDDL(_FIELDS).fields])

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = batches() if batches else lambda texts: [split(t) if isinstance(t, str) else [] for t in texts]
        for batch in sliced(stream, text_col):
            found = [[(*p, [""] * 4) if len(p) == 2 else p for p in some] for some in pieces(batch[text_col].tolist())]
            rows = batch[rest].loc[batch.index.repeat([len(f) for f in found])].reset_index(drop=True)
            parts = [(i, len(f), a, " / ".join(t for t in titles if t), *titles, name, text) for f in found for i, (a, text, titles) in enumerate(f)]
            yield pd.concat([rows, pd.DataFrame(parts, columns=[x.split()[0] for x in _FIELDS.split(", ")], index=rows.index)], axis=1)

    return docs.select(*rest, text_col).mapInPandas(run, schema).withColumnRenamed("chunk", text_col)


def recursive_chunks(docs: DataFrame, text_col: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    return _chunked(docs, text_col, "recursive", lambda t: recursive_split(t, size, overlap))


def header_chunks(docs: DataFrame, text_col: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    return _chunked(docs, text_col, "markdown_header", lambda t: header_split(t, size, overlap))


def hybrid_chunks(docs: DataFrame, text_col: str = "content", size: int = SIZE, overlap: int = OVERLAP, late: bool = False) -> DataFrame:
    """Sections, the long ones in recursive pieces, in document order; late: pieces of long sections after all others."""

    def split(text: str) -> list[tuple]:
        parts = header_split(text, size, overlap)
        whole = {at + len(b) - len(b.lstrip()) for at, b, _ in header_sections(text) if len(b.strip()) <= size}
        return [p for p in parts if p[0] in whole] + [p for p in parts if p[0] not in whole] if late else parts

    return _chunked(docs, text_col, "hybrid", split)


def sentences(text: Column) -> Column:
    """The sentences of a text, without outer white space; those that are blank go."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_END), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def semantic_chunks(docs: DataFrame, text_col: str = "content", similar=None, threshold: float = 0.78, least: int = 2, size: int = SIZE, make: Callable[[], Callable] | None = None, at_once: int = 4096) -> DataFrame:
    """Groups of sentences that are alike. make builds an embedder (texts to an array of vectors), once for each task; the sentences of
    the texts of a frame of `sliced` are embedded together, `at_once` at a time, each distinct one once. similar is for cosines from
    elsewhere; without either, groups have `least` sentences."""
    if make is None:
        return _chunked(docs, text_col, "semantic", lambda t: semantic_split(t, similar, threshold, least, size))
    return _chunked(docs, text_col, "semantic", None, lambda: _semantic_batch(make(), threshold, least, size, at_once))


def _semantic_batch(embed: Callable, threshold: float, least: int, size: int, at_once: int) -> Callable[[list], list]:
    def split(texts: list) -> list:
        asked: dict[str, int] = {}

        def noted(some: list[str]) -> list[float]:
            for s in some:
                asked.setdefault(s, len(asked))
            return [0.0] * (len(some) - 1)

        for t in texts:
            if isinstance(t, str):
                semantic_split(t, noted, threshold, least, size)
        known, parts = list(asked), []
        for low in range(0, len(known), at_once):
            parts.append(np.asarray(embed(known[low : low + at_once]), dtype=float))
        m = np.concatenate(parts) if parts else np.zeros((0, 1))
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)

        def near(some: list[str]) -> list[float]:
            v = m[[asked[s] for s in some]]
            return (v[:-1] * v[1:]).sum(axis=1).tolist()

        return [semantic_split(t, near, threshold, least, size) if isinstance(t, str) else [] for t in texts]

    return split


CHUNKERS: dict[str, Callable[..., DataFrame]] = {"recursive": recursive_chunks, "fixed_token": fixed_token_chunks, "markdown_header": header_chunks, "semantic": semantic_chunks, "hybrid": hybrid_chunks}


def chunked(docs: DataFrame, strategy: str = "recursive", **options) -> DataFrame:
    """By strategy name; an unknown one is recursive."""
    return CHUNKERS.get(strategy, recursive_chunks)(docs, **options)


def numbered(chunks: DataFrame, file_cols: list[str], order: list) -> DataFrame:
    """chunk_index and total_chunks over all chunks of a file, a deterministic row id, length and page number (page
    counts from 0, page_number from 1)."""
    w = Window.partitionBy(*file_cols)
    c = chunks.withColumns({"chunk_index": F.row_number().over(w.orderBy(*order)) - 1, "total_chunks": F.count("*").over(w).cast("int")})
    c = c.withColumn("id", F.sha2(F.concat_ws("\u0001", *file_cols, F.col("chunk_index").cast("string")), 256))
    own = [F.col(x).try_cast("int") + int(x == "page") for x in ("page_number", "page") if x in chunks.columns]
    return c.withColumns({"content_length": F.length("content"), "page_number": F.coalesce(*own, F.col("chunk_index") + 1)})


def box_union(blocks, start, end) -> F.Column:
    """The smallest box (x0, y0, x1, y1; 2 decimals) of the layout blocks (offset, length, bbox) that overlap a chunk's
    half-open range; null if none does."""
    hit = F.filter(blocks, lambda b: (b["offset"] < end) & (b["offset"] + b["length"] > start) & (F.size(b["bbox"]) == 4))
    side = lambda i: F.transform(hit, lambda b: F.element_at(b["bbox"], i))
    box = F.array(F.array_min(side(1)), F.array_min(side(2)), F.array_max(side(3)), F.array_max(side(4)))
    return F.when(F.size(hit) > 0, F.transform(box, lambda x: F.round(x, 2)))


def boxes_by_join(chunks: DataFrame, blocks: DataFrame, keys: list[str], cell: int = 1024) -> DataFrame:
    """The same for blocks in a table. chunks: keys, chunk_index, start, end; blocks: keys, offset, length, x0, y0, x1, y1.
    Both are dealt to cells of `cell` characters and meet in the first cell they share, so the work grows with the
    overlaps of a file, not with the square of its length."""
    c = chunks.withColumn("_low", F.floor(F.col("start") / cell)).where(F.col("end") > F.col("start"))
    c = c.withColumn("_cell", F.explode(F.sequence("_low", F.floor((F.col("end") - 1) / cell)))).alias("c")
    b = blocks.withColumn("_low", F.floor(F.col("offset") / cell)).where(F.col("length") > 0)
    b = b.withColumn("_cell", F.explode(F.sequence("_low", F.floor((F.col("offset") + F.col("length") - 1) / cell)))).alias("b")
    cond = (F.col("b.offset") < F.col("c.end")) & (F.col("b.offset") + F.col("b.length") > F.col("c.start")) & (F.col("c._cell") == F.greatest("c._low", "b._low"))
    for k in [*keys, "_cell"]:
        cond &= F.col(f"c.{k}") == F.col(f"b.{k}")
    sides = [F.round(f(F.col(f"b.{s}")), 2).alias(s) for s, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))]
    return c.join(b, cond).groupBy(*[F.col(f"c.{k}") for k in keys], F.col("c.chunk_index")).agg(*sides, F.count("*").alias("n_blocks"))
