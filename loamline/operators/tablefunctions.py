"""Table functions for SQL: chunking, search inside pages, vector top-k and parsing, over any table with the columns they name.

    register(spark)
    SELECT * FROM chunk_text(TABLE(docs), strategy => 'recursive', size => 800)
    SELECT * FROM grep_pages(TABLE(pages) PARTITION BY tenant_id, file_id ORDER BY page_number, pattern => 'term')
    SELECT * FROM nearest_rows(TABLE(chunks) PARTITION BY tenant_id, query => array(0.1, 0.2), k => 5)
    SELECT * FROM parse_files(TABLE(files))

`analyze` gives each call its result type from its input's, so columns of the input come along, and refuses calls it cannot answer
before anything runs. chunk_text and parse_files read row by row and may run on any split; the other two need the rows of a partition
together: without PARTITION BY a call is refused, as one task would hold the table. They keep `limit` or `k` rows of it.
"""

from __future__ import annotations

import heapq
import math
import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import chunking
from .navigate import found_in
from ..sources.files import IMAGES, PARSERS
from ..sources.pdf import rows_of

DIGITS = 6


def _input(table: AnalyzeArgument, needed: dict[str, str]) -> StructType:
    """The fields of a table argument, which must have columns of these types."""
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(...)")
    types = {f.name: f.dataType.simpleString() for f in table.dataType.fields}
    for name, kind in needed.items():
        if not re.fullmatch(kind, types.get(name, "")):
            raise ValueError(f"the table needs a column {name} of type {kind.replace('|', ' or ')}")
    return table.dataType


def _constant(name: str, argument: AnalyzeArgument | None, kind: type, default):
    if argument is None:
        return default
    if argument.value is None or not isinstance(argument.value, kind):
        raise ValueError(f"{name} must be a constant {kind.__name__}")
    return argument.value


def _rest(fields: StructType, *names: str) -> list[StructField]:
    return [f for f in fields.fields if f.name not in names]


class ChunkText:
    """chunk_text(TABLE(rows with content), strategy, size, overlap): chunks as of `operators.chunking`, with the input's other columns."""

    SPLITTERS = {"recursive": chunking.recursive_split, "markdown_header": chunking.header_split, "fixed_token": chunking.fixed_split}

    @staticmethod
    def analyze(table: AnalyzeArgument, strategy: AnalyzeArgument = None, size: AnalyzeArgument = None, overlap: AnalyzeArgument = None) -> AnalyzeResult:
        name = _constant("strategy", strategy, str, "recursive")
        if name not in ChunkText.SPLITTERS:
            raise ValueError(f"strategy is one of {', '.join(ChunkText.SPLITTERS)}")
        if _constant("size", size, int, 1) < 1 or _constant("overlap", overlap, int, 0) < 0:
            raise ValueError("size is 1 at least, overlap 0 at least")
        own = [StructField("chunk_index", LongType()), StructField("total_chunks", LongType()), StructField("start_index", LongType()), StructField("section_path", StringType()), StructField("content", StringType())]
        return AnalyzeResult(StructType([*_rest(_input(table, {"content": "string"}), "content", *(f.name for f in own)), *own]))

    def eval(self, row, strategy: str = "recursive", size: int = chunking.SIZE, overlap: int = chunking.OVERLAP):
        values = row.asDict(recursive=False)
        text = values.pop("content")
        if not isinstance(text, str):
            return
        kept = [v for k, v in values.items() if k not in ("chunk_index", "total_chunks", "start_index", "section_path")]
        pieces = self.SPLITTERS[strategy](text, size, overlap)
        for i, (start, piece, *titles) in enumerate(pieces):
            yield (*kept, i, len(pieces), start, " / ".join(t for t in titles[0] if t) if titles else "", piece)


class GrepPages:
    """grep_pages(TABLE(pages with content) PARTITION BY ... ORDER BY ..., pattern, regex, case_sensitive, context, limit): the first
    `limit` places of a pattern in each partition, in its order, with seq from 1. As of `operators.navigate.matches`."""

    @staticmethod
    def analyze(table: AnalyzeArgument, pattern: AnalyzeArgument, regex: AnalyzeArgument = None, case_sensitive: AnalyzeArgument = None, context: AnalyzeArgument = None, limit: AnalyzeArgument = None) -> AnalyzeResult:
        text = _constant("pattern", pattern, str, "")
        if _constant("regex", regex, bool, False):
            re.compile(text)
        if _constant("limit", limit, int, 1) < 1 or _constant("context", context, int, 0) < 0:
            raise ValueError("limit is 1 at least, context 0 at least")
        own = [StructField("line", IntegerType()), StructField("match", StringType()), StructField("snippet", StringType()), StructField("context", StringType()), StructField("seq", IntegerType())]
        return AnalyzeResult(StructType([*_rest(_input(table, {"content": "string"}), "content", *(f.name for f in own)), *own]))

    def __init__(self):
        self.seen = 0

    def eval(self, row, pattern: str, regex: bool = False, case_sensitive: bool = False, context: int = 0, limit: int = 20):
        values = row.asDict(recursive=False)
        text = values.pop("content")
        if self.seen >= limit or not isinstance(text, str):
            return
        compiled = re.compile(pattern if regex else re.escape(pattern), 0 if case_sensitive else re.IGNORECASE)
        kept = [v for k, v in values.items() if k not in ("line", "match", "snippet", "context", "seq")]
        for line, match, snippet, around, _ in found_in(compiled, text, context):
            self.seen += 1
            yield (*kept, line, match, snippet, around, self.seen)
            if self.seen >= limit:
                return

    def terminate(self):
        return iter(())


class NearestRows:
    """nearest_rows(TABLE(rows with id and embedding) PARTITION BY ..., query, k): the k rows of each partition that are most similar to
    a query vector, with score (6 decimals) and rank; ties go to the smaller id. As of `operators.search.top_k`."""

    @staticmethod
    def analyze(table: AnalyzeArgument, query: AnalyzeArgument, k: AnalyzeArgument = None) -> AnalyzeResult:
        if _constant("k", k, int, 1) < 1:
            raise ValueError("k is 1 at least")
        own = [StructField("score", DoubleType()), StructField("rank", IntegerType())]
        return AnalyzeResult(StructType([*_rest(_input(table, {"id": "bigint|int|string", "embedding": "array<(float|double)>"}), "embedding", "score", "rank"), *own]))

    def __init__(self):
        self.best: list = []
        self.rows: dict = {}
        self.n = 0

    def eval(self, row, query: list, k: int = 5):
        values = row.asDict(recursive=False)
        vector = values.pop("embedding")
        self.best.append((-self._score(vector, query), values["id"], self.n, [v for key, v in values.items() if key not in ("score", "rank")]))
        self.n, self.k = self.n + 1, k
        if len(self.best) >= 2 * k + 1000:
            self.best = heapq.nsmallest(k, self.best, key=lambda x: x[:3])
        return iter(())

    @staticmethod
    def _score(vector: list | None, query: list | None) -> float:
        if not vector or not query or len(vector) != len(query):
            return 0.0
        dot = lambda a, b: math.fsum(float(x) * float(y) for x, y in zip(a, b))
        norms = math.sqrt(dot(vector, vector)) * math.sqrt(dot(query, query))
        return round(dot(vector, query) / norms, DIGITS) + 0.0 if norms > 0 else 0.0

    def terminate(self):
        for rank, (score, _, _, kept) in enumerate(heapq.nsmallest(self.k, self.best, key=lambda x: x[:3]) if self.n else (), 1):
            yield (*kept, -score, rank)


class ParseFiles:
    """parse_files(TABLE(files with path, file_type and content)): path, page, content and error of each page, as of
    `sources.files.documents`; of a PDF the words of each line, as its layout is columns of `sources.pdf`."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        _input(table, {"path": "string", "file_type": "string", "content": "binary"})
        return AnalyzeResult(StructType([StructField("path", StringType()), StructField("page", IntegerType()), StructField("content", StringType()), StructField("error", StringType())]))

    def eval(self, row):
        path, kind, data = row["path"], row["file_type"], bytes(row["content"] or b"")
        if kind == "pdf" and kind not in PARSERS:
            for page, _, _, words, _, error in rows_of(data):
                lines: dict[float, list] = {}
                for x0, top, _, _, text in words or ():
                    lines.setdefault(round(top, 1), []).append((x0, text))
                yield path, page, None if error else "\n".join(" ".join(t for _, t in sorted(lines[y])) for y in sorted(lines)), error
            return
        try:
            for page, text in [(0, "")] if kind in IMAGES else PARSERS[kind](data):
                yield path, page, text.replace("\x00", ""), None
        except Exception as e:
            yield path, 0, None, f"{type(e).__name__}: {e}" if kind in PARSERS else f"unsupported: {kind}"


FUNCTIONS = {"chunk_text": ChunkText, "grep_pages": GrepPages, "nearest_rows": NearestRows, "parse_files": ParseFiles}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL."""
    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler))
