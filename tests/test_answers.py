import random
import re

import numpy as np
from pyspark.sql import functions as F

from loamline.operators import answers as A
from loamline.operators import chunking as C
from loamline.operators.store import HashEmbedder


def test_answers_contexts_and_sources(spark):
    q = spark.createDataFrame([(1, "why?"), (2, "왜?"), (3, "none")], "query_id long, question string")
    hits = spark.createDataFrame(
        [(1, 1, "f.txt", 0, "first ", None, 3), (1, 2, "", None, None, "part", None), (1, 3, "f.txt", 0, "again", None, 4), (2, 1, "g", 7, "x", "", 0)],
        "query_id long, rank int, file_name string, chunk_index int, content string, section_title string, page_number int",
    )
    asked = lambda lang, context, question: F.concat(lang, F.lit(":"), question, F.lit(":"), F.length(context).cast("string"))
    got = {r.query_id: r for r in A.answered(q, hits, asked).collect()}
    one = "문서 1 | 파일: f.txt | 페이지: 3 | 청크: 0\nfirst\n\n문서 2 | 파일: unknown | 섹션: part\n\n문서 3 | 파일: f.txt | 페이지: 4 | 청크: 0\nagain"
    assert got[1].context == one and got[1].answer == f"en:why?:{len(one)}"
    assert set(got[1].sources) == {"f.txt#0", "#1"} and '"page_number":4' in got[1].sources["f.txt#0"]
    assert got[2].answer.startswith("ko:") and "섹션" not in got[2].context
    assert got[3].answer == A.NO_SOURCES["en"] and got[3].sources == {} and got[3].context == ""


def test_requested_chunks_fall_back_and_say_when_cut(spark):
    chunks = spark.createDataFrame(
        [("t", f"{f}/{i}", f, p, n, r, i, "document") for f, p, n, r in (("1", "files/a.pdf", "a.pdf", "r1"), ("2", "b.pdf", "same.pdf", None), ("3", "c.pdf", "same.pdf", "r2")) for i in range(4)] + [("t", "x", "1", "files/a.pdf", "a.pdf", None, 9, "image_analysis"), ("u", "y", "1", "files/a.pdf", "a.pdf", None, 0, "document")],
        "tenant_id string, id string, file_id string, file_path string, file_name string, room_id string, chunk_index int, type string",
    )
    asked = [(1, "t", "1", None, None, None), (2, "t", None, " a.pdf? ", None, None), (3, "t", None, "/files/none.pdf", "same.pdf", None), (4, "t", None, None, "same.pdf", "r2"), (5, "t", "9", "", "", None), (6, "t", "9", "files/b.pdf", "a.pdf", None)]
    r = spark.createDataFrame(asked, "request int, tenant_id string, file_id string, file_path string, file_name string, room_id string")
    got = {}
    for x in A.requested_chunks(chunks, r, 5).orderBy("request", "seq").collect():
        got.setdefault(x.request, []).append((x.via, x.id, x.truncated))
    each = lambda via, f: [(via, f"{f}/{i}", False) for i in range(4)]
    assert got[1] == each("file_id", "1") and got[2] == each("file_path", "1") and got[4] == each("file_name", "3") and got[6] == each("file_path", "2")
    assert [x[1] for x in got[3]] == ["2/0", "3/0", "2/1", "3/1", "2/2"] and all(x[2] for x in got[3]) and 5 not in got


def test_semantic_chunks_with_vectors_equal_a_plain_loop(spark):
    rng = random.Random(3)
    texts = [" ".join(" ".join(rng.choices("alpha beta gamma delta Epsilon".split(), k=rng.randrange(1, 6))).capitalize() + rng.choice(".!?") for _ in range(rng.randrange(12))) for _ in range(60)] + [None, "", "One. Two."]
    df = spark.createDataFrame(list(enumerate(texts)), "file_id int, content string").repartition(3)

    def cosines(some):
        v = [np.asarray(HashEmbedder()([s])[0], float) for s in some]
        unit = lambda x: x / n if (n := np.linalg.norm(x)) else x
        return [float(unit(a) @ unit(b)) for a, b in zip(v, v[1:])]

    want = sorted((i, n, start, t) for i, text in enumerate(texts) if text is not None for n, (start, t) in enumerate(C.semantic_split(text, cosines, 0.45)))
    got = sorted((r.file_id, r.chunk_index, r.start_index, r.content) for r in C.semantic_chunks(df, make=HashEmbedder, threshold=0.45, at_once=7).collect())
    assert got == want and any(len(re.findall(r"[.!?]", t)) != 2 for *_, t in got)


def test_sentences(spark):
    texts = ["One. Two! three? 4 is a number.\n\nFive", "", None, "no end", " A.  B. C "]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.sentences(F.col("t")).alias("s")).collect()]
    assert got == [["One.", "Two! three?", "4 is a number.", "Five"], [], [], ["no end"], ["A.", "B.", "C"]]


def most_rows(plan):
    """The most rows that an operator of a plan has put out."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return most_rows(plan.executedPlan())
    inner = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, inner)])


def test_requests_by_a_common_name_do_not_meet_all_its_chunks(spark):
    n = 200
    chunks = spark.range(n).select(F.lit("t").alias("tenant_id"), F.col("id").cast("string").alias("file_id"), F.concat(F.lit("p"), "id").alias("file_path"), F.lit("same").alias("file_name"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("chunk_index"))
    chunks = chunks.select("*", F.concat_ws("/", "file_id", "chunk_index").alias("id"), F.when(F.col("file_id") == "7", "r").alias("room_id"), F.lit("text").alias("content"))
    none = F.lit(None).cast("string")
    asked = spark.range(n).select(F.col("id").alias("request"), F.lit("t").alias("tenant_id"), none.alias("file_id"), none.alias("file_path"), F.lit("same").alias("file_name"), F.when(F.col("id") == 1, "r").alias("room_id"))
    found = A.requested_chunks(chunks, asked, 3)
    got = {}
    for x in found.collect():
        got.setdefault(x.request, []).append((x.seq, x.id, x.truncated))
    first = sorted(f"{i}/0" for i in range(n))[:3]
    assert {k: sorted(v) for k, v in got.items()} == {i: [(s + 1, f"7/{s}" if i == 1 else first[s], True) for s in range(3)] for i in range(n)}
    assert most_rows(found._jdf.queryExecution().executedPlan()) <= 6 * 10 * n < n * 10 * n
