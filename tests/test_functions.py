import hashlib

import pytest
from pyspark.sql import functions as F

from loamline.functions import text as T


@pytest.fixture(scope="module")
def one(spark):
    def run(make, **cols):
        row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {t}" for k, t in ((k, "string" if v is None or isinstance(v, str) else "int") for k, v in cols.items())))
        return row.select(make(*(F.col(k) for k in cols)).alias("x")).first()[0]

    return run


@pytest.mark.parametrize(
    ("given", "kind", "want"),
    [
        ("```json\nbody\n```", "summary", "body"),
        ("```no newline", "summary", "```no newline"),
        ('  "quoted"  ', "abstract", "quoted"),
        ('"quoted"', "summary", '"quoted"'),
        ("요약: text", "abstract", "text"),
        ("[정리] 정리: text", "summary", "정리: text"),
        ("Summary:   x ", "glossary", "Summary:   x"),
        ("", "abstract", ""),
        (None, "abstract", ""),
        ('"', "abstract", '"'),
    ],
)
def test_cleaned_output(one, given, kind, want):
    assert one(lambda c: T.cleaned_output(c, kind), c=given) == want


def test_numbered_list(one):
    assert one(lambda c: T.numbered_list(c, 3), c="1. foo\n\n2) bar\n- baz\n* four") == ["foo", "bar", "baz"]
    assert one(lambda c: T.numbered_list(c, 3), c="") == []


@pytest.mark.parametrize(("given", "want"), [("a/b-c_d.txt", "a/b-c_d.txt"), ("a b/!!", "a-b/f-" + hashlib.sha1(b"!!").hexdigest()[:10]), ("", ""), ("/x//y/", "x/y")])
def test_safe_path(one, given, want):
    assert one(T.safe_path, c=given) == want


def test_safe_path_of_other_letters_is_stable(one):
    a = one(T.safe_path, c="한글/x")
    assert a == one(T.safe_path, c="한글/x") and a.startswith("f-") and a.endswith("/x") and len(a) == 14


def test_normalised(one):
    assert one(T.normalised, c="Ａｂ①") == "Ab1"
    assert one(T.normalised, c="한") == "한"
    assert one(T.normalised, c=None) is None


def test_page_text(one):
    assert one(T.page_text, c="\t a\x00b \n") == "ab"
    assert one(T.page_text, c=None) == ""


def test_lenient_int(one):
    assert [one(lambda c: T.lenient_int(c, -1), c=x) for x in ("10", "x", None)] == [10, -1, -1]


def test_snippet(one):
    text = "a" * 100 + "HIT" + "b" * 100
    got = one(lambda c: T.snippet(c, F.lit(100), F.lit(103), 5), c=text)
    assert got == "…aaaaaHITbbbbb…"
    assert one(lambda c: T.snippet(c, F.lit(0), F.lit(1), 5), c="a\nb") == "a b"


def test_judged(one):
    assert one(lambda c: F.struct(*T.judged(c)), c='noise {"score": 7, "reason": "r"} end') == (5, "r")
    assert one(lambda c: F.struct(*T.judged(c)), c="nothing") == (0, "")


def test_question_answers(one):
    got = one(T.question_answers, c='here: [{"question": "q", "expected_answer": "a"}, {"question": "", "answer": "x"}] done')
    assert [tuple(x) for x in got] == [("q", "a")]
    assert one(T.question_answers, c="none") == []


def test_markdown_table(spark):
    rows = spark.createDataFrame([([["a", "b"], ["x\ny"], ["p|q", "r"]],), ([],)], "rows array<array<string>>")
    got = [r[0] for r in rows.select(T.markdown_table(F.col("rows"))).collect()]
    assert got == ["| a | b |\n| --- | --- |\n| x / y |  |\n| p\\|q | r |", "(empty table)"]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([], [])], "a array<float>, b array<float>")
    got = [round(r[0], 6) for r in rows.select(T.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [0.707107, 0.0, 0.0, 0.0]


def test_small_formats(one):
    assert one(T.masked, c="abcdefghij") == "abcd***ghij"
    assert one(T.collection_name, c="a") == "axx"
    assert one(T.one_line, c=" a\n b ") == "a b"
    assert one(T.bracketed_math, c="so $x+1$ is") == "so [x+1] is"
    assert one(lambda c: T.moved_path(c, "a_b", "n"), c="a_b/c") == "n/c"
    assert one(lambda c: T.moved_path(c, "a_b", "n"), c="aXb/c") == "aXb/c"
    assert one(T.language, c="안녕") == "ko"
    assert one(T.role, c=" Glossary ") == "glossary" and one(T.role, c="x") == "content" and one(T.role, c=None) == "content"
