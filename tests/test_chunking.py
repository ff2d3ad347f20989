import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamline.operators import chunking as C

LONG = "First part. Second one! Third? " * 60 + "\n\n" + "x" * 2000 + "\nlast line."


@pytest.mark.parametrize(("size", "overlap"), [(50, 10), (7, 7), (5, 9), (1000, 0)])
def test_fixed_token_matches_the_loop(spark, size, overlap):
    texts = ["", "  ", "one", " ".join(map(str, range(123))), "a\tb\nc " * 20, None]
    got = C.fixed_token_chunks(spark.createDataFrame(list(enumerate(texts)), "i int, content string"), "content", size, overlap).collect()
    want = []
    for i, t in enumerate(texts):
        words, at, k = (t or "").split(), 0, 0
        while words:
            want.append((i, k, " ".join(words[at : at + size])))
            if at + size >= len(words):
                break
            at, k = at + max(1, size - overlap), k + 1
    assert sorted((r.i, r.chunk_index, r.content) for r in got) == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_recursive_chunks_keep_size_offsets_and_all_text(text, size, overlap):
    chunks = C.recursive_split(text, size, overlap)
    covered = set()
    for at, body in chunks:
        assert len(body) <= size and text[at : at + len(body)] == body
        covered |= set(range(at, at + len(body)))
    assert {i for i, c in enumerate(text) if not c.isspace()} <= covered


def test_recursive_splits_an_unbroken_word():
    chunks = C.recursive_split(LONG, 800, 100)
    assert max(len(b) for _, b in chunks) <= 800 and all(LONG[a : a + len(b)] == b for a, b in chunks)


def test_headers():
    text = "intro\n# A\nx\n## B\ny\n```\n# no header\n```\n# C\nz"
    got = C.header_split(text)
    assert [(b.split("\n")[0], "/".join(t for t in ts if t)) for _, b, ts in got] == [("intro", ""), ("# A", "A"), ("## B", "A/B"), ("# C", "C")]
    assert C.header_split("") == [] and len(C.header_split("# H\n" + "word " * 400)) > 1


def test_hybrid_can_put_long_sections_last(spark):
    text = "# A\n" + "word " * 300 + "\n# B\nshort"
    d = spark.createDataFrame([(1, text)], "i int, content string")
    now = [r.section_path for r in C.hybrid_chunks(d).orderBy("chunk_index").collect()]
    late = [r.section_path for r in C.hybrid_chunks(d, late=True).orderBy("chunk_index").collect()]
    assert now[-1] == "B" and late[0] == "B" and set(now) == set(late) == {"A", "B"}


def test_semantic_sentences():
    import re

    assert re.split(C.SENTENCE_END, "Ab. Cd! ef? 9x") == ["Ab.", "Cd! ef?", "9x"]
    assert C.semantic_split("One. Two. Three. Four. Five.") == [(0, "One. Two."), (10, "Three. Four."), (23, "Five.")]
    assert C.semantic_split("One. Two. Three.", lambda s: [0.9] * (len(s) - 1)) == [(0, "One. Two. Three.")]
    assert C.semantic_split("") == []


def test_unknown_strategy_is_recursive(spark):
    d = spark.createDataFrame([(1, "a b", None)], "i int, content string, other string")
    assert C.chunked(d, "nothing").first().chunker_name == "recursive"


def test_boxes_by_array_and_by_join_agree(spark):
    from pyspark.sql import functions as F

    blocks = [(1, 0, 5, [0.0, 1.0, 2.0, 3.0]), (1, 5, 5, [1.0, 0.5, 9.123, 2.0]), (1, 20, 5, [7.0, 7.0, 8.0, 8.0])]
    chunks = [(1, 0, 0, 6), (1, 1, 6, 20), (1, 2, 10, 20), (1, 3, 24, 30)]
    b = spark.createDataFrame(blocks, "page int, offset int, length int, bbox array<double>")
    c = spark.createDataFrame(chunks, "page int, chunk_index int, start int, end int")
    joined = C.boxes_by_join(c, b.select("page", "offset", "length", *(F.col("bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1")))), ["page"])
    got = {r.chunk_index: [r.x0, r.y0, r.x1, r.y1] for r in joined.collect()}
    arrays = b.groupBy("page").agg(F.collect_list(F.struct("offset", "length", "bbox")).alias("blocks"))
    same = c.join(arrays, "page").select("chunk_index", C.box_union(F.col("blocks"), F.col("start"), F.col("end")).alias("box")).collect()
    assert {r.chunk_index: r.box for r in same if r.box} == got == {0: [0.0, 0.5, 9.12, 3.0], 1: [1.0, 0.5, 9.12, 2.0], 3: [7.0, 7.0, 8.0, 8.0]}


def test_numbered(spark):
    c = spark.createDataFrame([("f", 0, "x"), ("f", 1, "yy")], "file_id string, page int, content string")
    got = C.numbered(c, ["file_id"], ["page"]).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.total_chunks, r.content_length, r.page_number) for r in got] == [(0, 2, 1, 1), (1, 2, 2, 2)]
    assert got[0].id != got[1].id


def test_frames_of_a_batch_are_bounded_by_their_text():
    import pandas as pd

    from loamline.session import sliced

    batch = pd.DataFrame({"n": range(6), "t": ["a" * 30, None, "", "b" * 500, "c" * 60, "d" * 60]})
    got = [f["n"].tolist() for f in sliced(iter([batch, batch[:0]]), "t", 100)]
    assert got == [[0, 1, 2, 3], [4, 5]]
    assert [f["n"].tolist() for f in sliced(iter([batch]), "t", 1)] == [[i] for i in range(6)]


def test_sentences_embedded_together_do_not_grow_with_a_batch(spark):
    class Embedder:
        def __call__(self, texts):
            assert len(texts) <= 8000
            return [[1.0]] * len(texts)

    texts = spark.range(400, numPartitions=1).selectExpr("id AS file_id", "array_join(transform(sequence(1, 40), i -> concat('Sentence ', i, ' of text number ', id, ', which is its own.')), ' ') AS content")
    found = C.semantic_chunks(texts, make=Embedder, at_once=1 << 30)
    assert found.select("file_id").distinct().count() == 400
