"""Column helpers: cleaning, parsing and formatting of text. All are built-in expressions but `normalised`."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Fixed values of the formats that are read and written.
CLIP_MARK = "\n[...해당 페이지 본문 길이 초과로 일부 생략...]"
CUT_MARK = "\n…(truncated)"
ROLES = ("content", "glossary", "template", "reference", "dataset")
PREFIXES = {
    "abstract": ("요약:", "Abstract:", "abstract:", "Summary:"),
    "summary": ("[정리]", "정리:", "요약:", "Summary:", "summary:"),
    "glossary": (),
}
IMAGE_PLACEHOLDER = r"__IMAGE_PLACEHOLDER_p(\d+)_i(\d+)__"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def falsy_to(c: Column, default: Column) -> Column:
    """default where c is null or empty."""
    return F.coalesce(F.when(c != "", c), default)


def lenient_int(c: Column, default: int | None = None) -> Column:
    """The integer, or default (null) where there is none."""
    found = c.cast("string").try_cast("int")
    return found if default is None else F.coalesce(found, F.lit(default))


def nul_free(c: Column) -> Column:
    return F.translate(c, "\u0000", "")


def page_text(c: Column) -> Column:
    """A page's text as it is stored: no NUL, no outer white space, empty for null."""
    return F.coalesce(strip(nul_free(c)), F.lit(""))


@pandas_udf(StringType())
def normalised(s: pd.Series) -> pd.Series:
    """Compatibility-composed, then composed, Unicode."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", unicodedata.normalize("NFKC", x)))


def clipped(c: Column, limit: int, mark: str) -> Column:
    """At most limit characters, and the mark if it was longer."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(F.coalesce(c, F.lit("")))


def role(c: Column) -> Column:
    """A known document role, content for any other."""
    r = F.lower(F.trim(c))
    return F.when(r.isin(*ROLES), r).otherwise("content")


def language(c: Column) -> Column:
    """ko if there is a Hangul syllable, else en."""
    return F.when(c.rlike("[가-힣]"), "ko").otherwise("en")


def let(c: Column, then) -> Column:
    """then(c) with c computed once, however often `then` uses it."""
    return F.element_at(F.transform(F.array(c), then), 1)


def _unfenced(t: Column) -> Column:
    body = F.when(F.instr(t, "\n") > 0, F.substring(t, F.instr(t, "\n") + 1, F.length(t))).otherwise(t)
    return F.when(t.startswith("```"), strip(F.regexp_replace(body, "```$", ""))).otherwise(t)


def _unquoted(t: Column) -> Column:
    ends = F.substring(t, 1, 1)
    quoted = (F.length(t) >= 2) & ends.isin('"', "'") & (F.substring(t, -1, 1) == ends)
    return F.when(quoted, strip(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def cleaned_output(c: Column, kind: str = "summary") -> Column:
    """A model's answer without code fence, outer quotes (abstracts only) and one leading label."""

    def unlabelled(t: Column) -> Column:
        out = t
        for p in reversed(PREFIXES[kind]):
            out = F.when(t.startswith(p), strip(F.substring(t, len(p) + 1, 1 << 30))).otherwise(out)
        return out

    t = let(strip(F.coalesce(c, F.lit(""))), _unfenced)
    return let(let(t, _unquoted) if kind == "abstract" else t, unlabelled)


def numbered_list(c: Column, most: int = 10) -> Column:
    """The first items of a list of lines, without numbers and bullets."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), lambda x: strip(F.regexp_replace(strip(x), r"^\s*(?:\d+[.)]|[-*•])\s*", "")))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, most)


def safe_segment(c: Column) -> Column:
    """A folder name fit for a storage key: as it is, with runs of other ASCII as one dash, or a stable hash."""
    dashed = F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9._\-]+", "-"), "^-+|-+$", "")
    hashed = F.concat(F.lit("f-"), F.substring(F.sha1(c.cast("binary")), 1, 10))
    return F.when(c.rlike(r"^[a-zA-Z0-9._\-]+\z"), c).when(c.rlike(r"^\p{ASCII}*\z") & (dashed != ""), dashed).otherwise(hashed)


def safe_path(c: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), "/"), lambda x: x != "")
    return F.array_join(F.transform(parts, safe_segment), "/")


def snippet(content: Column, start: Column, end: Column, radius: int = 80) -> Column:
    """The text around a match (0-based start, end), on one line, with an ellipsis where it goes on."""
    left, right = F.greatest(F.lit(0), start - radius), F.least(F.length(content), end + radius)
    body = F.trim(F.translate(F.substring(content, left + 1, right - left), "\n", " "))
    return F.concat(F.when(left > 0, "…").otherwise(""), body, F.when(right < F.length(content), "…").otherwise(""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for empty vectors, unlike lengths and zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0))).otherwise(0.0)


def key_value_lines(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"].cast("string"), F.lit("None")))), "\n")


def key_text(c: Column, numeric: bool = False) -> Column:
    """A part of a deduplication key: null, empty and (if numeric) zero are the empty text."""
    t = c.cast("string")
    return F.coalesce(F.when(t != "0", t) if numeric else t, F.lit(""))


def file_extension(c: Column) -> Column:
    return F.when(F.instr(c, ".") > 0, F.lower(F.substring_index(c, ".", -1))).otherwise("")


def one_line(c: Column, most: int = 200) -> Column:
    """Text on one line of at most `most` characters and an ellipsis."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def context_block(number: Column, file_name: Column, section: Column, page: Column, chunk: Column, content: Column) -> Column:
    """One source of a prompt: a heading of the parts that are known, then the content."""
    part = lambda label, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(label), c.cast("string")))
    head = F.concat_ws(" | ", F.concat(F.lit("문서 "), number.cast("string")), part("파일: ", file_name), part("섹션: ", section), part("페이지: ", page), part("청크: ", chunk))
    return F.concat(F.lit("["), head, F.lit("]\n"), F.coalesce(content, F.lit("")))


def image_numbers(c: Column) -> tuple[Column, Column]:
    """Page and image number in an image's id, null where there is none."""
    return F.regexp_extract(c, r"_page(\d+)_", 1).try_cast("int"), F.regexp_extract(c, r"_img(\d+)", 1).try_cast("int")


def without_placeholders(c: Column) -> Column:
    return F.regexp_replace(c, IMAGE_PLACEHOLDER, "")


def judged(c: Column) -> tuple[Column, Column]:
    """Score (0 to 5) and reason (at most 200 characters) in a judge's answer; 0 and empty where there is none."""
    body = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    score = F.coalesce(F.try_to_number(F.get_json_object(body, "$.score"), F.lit("9999")).try_cast("int"), F.get_json_object(body, "$.score").try_cast("double").cast("int"), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(5), score)), F.substring(F.coalesce(F.get_json_object(body, "$.reason"), F.lit("")), 1, 200)


def question_answers(c: Column) -> Column:
    """(question, answer) of the JSON list in a noisy answer; items without either go. An answer may be called expected_answer."""
    items = F.from_json(F.regexp_extract(c, r"(?s)\[.*\]", 0), "array<struct<question:string,answer:string,expected_answer:string>>")
    pairs = F.transform(items, lambda x: F.struct(F.trim(x["question"]).alias("question"), F.trim(F.coalesce(F.nullif(x["answer"], F.lit("")), x["expected_answer"])).alias("answer")))
    return F.coalesce(F.filter(pairs, lambda x: (x["question"] != "") & (x["answer"] != "")), F.array().cast("array<struct<question:string,answer:string>>"))


def questions_per_window(windows: Column) -> Column:
    return F.when(windows <= 2, 3).when(windows <= 10, 2).otherwise(1)


def masked(c: Column) -> Column:
    """A secret's ends."""
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(F.length(c) <= 8, "***").otherwise(F.concat(F.substring(c, 1, 4), F.lit("***"), F.substring(c, -4, 4)))


def collection_name(c: Column) -> Column:
    """3 to 63 characters of letters, digits, dots, dashes and underscores."""
    return F.substring(F.rpad(F.regexp_replace(c, "[^a-zA-Z0-9._-]", "_"), F.greatest(F.lit(3), F.length(c)), F.lit("x")), 1, 63)


def highlight_key(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *parts).cast("binary"))


def download_name(c: Column) -> tuple[Column, Column]:
    """An ASCII file name, and the whole name percent-encoded."""
    return F.regexp_replace(c, r'[^\x20-\x7e]|["\\]', "_"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def bracketed_math(c: Column) -> Column:
    return F.regexp_replace(c, r"\$([^$\n]+)\$", "[$1]")


def moved_path(path: Column, old: str, new: str) -> Column:
    """The path of a file after its folder old, or one above, is called new."""
    return F.when((path == old) | path.startswith(old + "/"), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table, the first row its head; short rows are filled, line breaks become
    ' / ' and bars are escaped."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda x: F.replace(F.replace(F.trim(F.coalesce(x, F.lit(""))), F.lit("\n"), F.lit(" / ")), F.lit("|"), F.lit(r"\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.concat_ws("\n", line(F.element_at(rows, 1)), rule, F.array_join(F.nullif(F.transform(F.slice(rows, 2, 1 << 30), line), F.array().cast("array<string>")), "\n"))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, "(empty table)").otherwise(body)


def coerced(c: Column) -> Column:
    """A number as it goes into JSON: null for NaN and infinities."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)
