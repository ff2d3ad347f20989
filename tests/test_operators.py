import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.operators import catalog as K
from loamline.operators import navigate as N
from loamline.operators import profile as P
from loamline.operators import search as S
from loamline.operators import store as W


def test_filter_compiler(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "a", 6)], "id int, k string, chunk_id int")
    ids = lambda where, exclude=None: [r.id for r in d.where(S.metadata_filter(where, exclude)).orderBy("id").collect()]
    assert ids({}) == [1, 2, 3] and ids({"k": None}) == [1, 2, 3] and ids({"k": []}) == [1, 2, 3]
    assert ids({"k": ["a"]}) == [1, 3] and ids({"k": ["a", "b"]}) == [1, 2, 3] and ids({"k": {"x": 1}}) == [1, 2, 3]
    assert ids({"k": "a"}, [5, 6]) == [1]  # a row without chunk_id stays


def _index(spark, n=300, d=8):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(d).round(2).tolist()) for i in range(n)] + [(n, [0.0] * d), (n + 1, [1.0]), (n + 2, None)]
    return rows, spark.createDataFrame(rows, "id long, embedding array<double>")


@pytest.mark.parametrize("blocks", [False, True])
def test_batch_top_k_is_exact(spark, blocks):
    rows, index = _index(spark)
    q = [(i, rows[i][1]) for i in (0, 7)] + [(9, [2.0])]
    queries = spark.createDataFrame(q, "query_id long, query array<double>")
    found = S.block_top_k(index, queries, 4, tile=50, block=2) if blocks else S.batch_top_k(index, queries, 4)
    got = [tuple(r) for r in found.select("query_id", "rank", "id", "score").orderBy("query_id", "rank").collect()]
    want = []
    for i, v in q:
        score = lambda w: round(float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), 6) if w and len(w) == len(v) and any(w) else 0.0  # noqa: B023, E731
        best = sorted((-score(w), j) for j, w in rows)[:4]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert [g[:3] for g in got] == [w[:3] for w in want]


def test_merge_keeps_the_first_of_ties(spark):
    a = spark.createDataFrame([(1, 10, 0.9), (2, 11, 0.8)], "rank int, id int, score double")
    b = spark.createDataFrame([(1, 11, 0.99), (2, 12, 0.1)], "rank int, id int, score double")
    got = S.merged([a, b], ["id"], 3).orderBy("seq").collect()
    assert [(r.id, r.source, r.score) for r in got] == [(10, 0, 0.9), (11, 0, 0.8), (12, 1, 0.1)]


def test_rank_fusion_ties_go_to_the_first_seen(spark):
    h = spark.createDataFrame([(0, 1, 5), (1, 1, 3), (0, 2, 3), (1, 2, 5), (1, 3, 1)], "query_id long, rank int, id int")
    got = [(r.id, r.source_query) for r in S.rank_fusion(h, 3).collect()]
    assert got == [(5, "0 | 1"), (3, "0 | 1"), (1, "1")]


@pytest.mark.parametrize(("spec", "want"), [("5", [5]), ("5-8", [5, 6, 7, 8]), ("5,7,12", [5, 7, 12]), ("3-5,9", [3, 4, 5, 9])])
def test_page_set(spec, want):
    assert N.page_set(spec) == want


@pytest.mark.parametrize("spec", ["8-5", "0", "x", "1-11", "", "-3"])
def test_page_set_rejects(spec):
    with pytest.raises(ValueError):
        N.page_set(spec)


def _pages(spark, texts, file="f"):
    return spark.createDataFrame([("t", file, i + 1, x) for i, x in enumerate(texts)], "tenant_id string, file_id string, page_number int, content string")


def test_grep_stops_after_five_times_the_limit(spark):
    pages = _pages(spark, ["hit " * 12, "Hit\nno\nHIT here", None, ""])
    got = N.matches(pages, "hit", limit=2, context=1).orderBy("seq").collect()
    assert [(r.page_number, r.line, r.match, r.total) for r in got] == [(1, 1, "hit", 12), (1, 1, "hit", 12)]
    counts = N.match_counts(pages, "hit", limit=2).orderBy("page_number").collect()
    assert [(r.n_matches, r.scanned) for r in counts] == [(12, True), (2, False), (0, False), (0, False)]
    more = N.matches(pages, "hit", limit=20, context=1).orderBy("seq").collect()
    assert [(r.line, r.match, r.context) for r in more[-2:]] == [(1, "Hit", "Hit\nno"), (3, "HIT", "no\nHIT here")] and more[0].total == 14
    assert N.matches(pages, "a.c", limit=5).count() == 0


def test_budget_runs_out(spark):
    rows = spark.createDataFrame([("t", str(i), "x" * n) for i, n in enumerate((5, 10, 3))], "tenant_id string, file string, content string")
    got = N.within_budget(rows, ["tenant_id"], ["file"], "content", 9).orderBy("file").collect()
    assert [(r.content, r.truncated) for r in got] == [("xxxxx", False), ("xxxx\n…(truncated)", True), ("", True)]


@pytest.mark.parametrize(("n", "want"), [(0, []), (1, [1]), (4, [1, 2, 3, 4]), (5, [1, 2, 3, 5]), (20, [1, 2, 3, 20])])
def test_abstract_pages(spark, n, want):
    pages = _pages(spark, ["a"] * n) if n else _pages(spark, ["a"]).limit(0)
    assert sorted(r.page_number for r in N.abstract_pages(pages).collect()) == want


def test_batches_and_cache(spark):
    b = N.page_batches(_pages(spark, ["one", " ", "three", "four"]), 2)
    got = b.orderBy("batch").collect()
    assert [(r.label, r.batch_text) for r in got] == [("1-2", "## p.1\n\none"), ("3-4", "## p.3\n\nthree\n\n## p.4\n\nfour")]
    done = N.assembled(N.mapped_batches(b, F.when(F.col("batch") == 0, "Summary: s0").otherwise(""))).first()
    assert (done.ok_batches, done.n_batches, done.complete) == (1, 2, False) and done.text.endswith("### p.1-2\n\ns0")
    files = spark.createDataFrame([("t", "f"), ("t", "g")], "tenant_id string, file_id string")
    cache = spark.createDataFrame([("t", "f", 2), ("t", "g", 5)], "tenant_id string, file_id string, batch_size int")
    hit, miss = N.cached(files, cache, 2)
    assert [r.file_id for r in hit.collect()] == ["f"] and [r.file_id for r in miss.collect()] == ["g"]


def test_full_text_orders_by_number(spark):
    c = spark.createDataFrame([("f", "10", "c"), ("f", "2", "b"), ("f", "x", "a"), ("f", "3", "")], "file_id string, chunk_index string, content string")
    r = N.full_text(c, ["file_id"]).first()
    assert (r.full_text, r.chunk_count, r.total_chars) == ("a\nb\nc", 3, 5)


FILE = "tenant_id string, source_type string, source_ref string, file_name string, index_status string"


def test_upserts(spark):
    old = spark.createDataFrame([("t", "u", "1", "a", "indexed"), ("t", "u", "2", "b", "failed")], FILE)
    new = spark.createDataFrame([("t", "u", "2", "B", "processing"), ("t", "u", "3", "c", "processing")], FILE)
    run = lambda whole: {r.source_ref: (r.file_name, r.index_status) for r in K.upserted(old, new, ["file_name"], ["index_status"], whole).collect()}
    assert run(False) == {"1": ("a", "indexed"), "2": ("B", "failed"), "3": ("c", "pending")}
    assert run(True) == {"1": ("a", "indexed"), "2": ("B", "processing"), "3": ("c", "processing")}


def test_status(spark):
    f = spark.createDataFrame([("t", "u", "1", "pending", "old"), ("t", "u", "2", "pending", "old")], "tenant_id string, source_type string, source_ref string, index_status string, index_error string")
    c = spark.createDataFrame([("t", "u", "1", "indexed", None)], "tenant_id string, source_type string, source_ref string, status string, error string")
    assert [(r.index_status, r.index_error) for r in K.with_status(f, c).orderBy("source_ref").collect()] == [("indexed", None), ("pending", "old")]


def test_subtree_takes_names_literally(spark):
    d = spark.createDataFrame([(x,) for x in ("a_b", "aXb", "a_b/c", "a_bc")], "p string")
    assert sorted(r.p for r in d.where(K.in_tree(F.col("p"), "a_b")).collect()) == ["a_b", "a_b/c"]


def test_cascade_leaves_no_orphan(spark):
    files = spark.createDataFrame([("t", "1"), ("t", "2")], "tenant_id string, source_ref string")
    chunks = spark.createDataFrame([("t", "1", "c1", "document", None), ("t", None, "i1", "image_analysis", "c1"), ("t", "2", "c2", "document", None), ("t", None, "i2", "image_analysis", "c2")], "tenant_id string, file_id string, id string, type string, document_id string")
    left, lost = K.cascaded_delete({"files": files, "chunks": chunks}, spark.createDataFrame([("t", "1")], "tenant_id string, file_id string"))
    assert sorted(r.id for r in left["chunks"].collect()) == ["c2", "i2"]
    assert {r.target: r.n_deleted for r in lost.collect()} == {"files": 1, "chunks": 2}


def test_listing_and_latest(spark):
    f = spark.createDataFrame([("t", "1", "x", None, "", None), ("t", "2", "x", "2024-01-01", "glossary", "p"), ("s", "3", "x", "2025-01-01", None, "p")], "tenant_id string, source_ref string, file_name string, modified_time string, doc_role string, folder_path string")
    assert [(r.source_ref, r.doc_role, r.folder_path) for r in K.listing(f, "t").collect()] == [("1", "content", ""), ("2", "glossary", "p")]
    assert {r.tenant_id: r.source_ref for r in K.latest(f, ["tenant_id", "file_name"]).collect()} == {"t": "2", "s": "3"}


def test_folder_tree_stops_at_the_leaves(spark):
    n = spark.createDataFrame([("r", None, "root"), ("a", "r", "A"), ("b", "a", "B"), ("lost", "nowhere", "L")], "id string, parent_id string, name string")
    assert {r.id: r.path for r in K.folder_tree(n).collect()} == {"r": "root", "a": "root/A", "b": "root/A/B"}


def test_profiles(spark):
    d = spark.createDataFrame([(1.0, True, None, "a"), (float("nan"), False, None, "b"), (None, None, None, "b"), (3.0, True, None, None)], "x double, flag boolean, empty double, s string")
    got = {r["column"]: (r.null_pct, r.min, r.max, r["mean"]) for r in P.numeric_profile(d).collect()}
    assert got == {"x": (0.5, 1.0, 3.0, 2.0), "flag": (0.25, 0.0, 1.0, 0.666667), "empty": (1.0, None, None, None)}
    assert [(r.value, r.n, r["rank"], r.n_unique) for r in P.categorical_profile(d).orderBy("rank").collect()] == [("b", 2, 1, 2), ("a", 1, 2, 2)]


def test_recall_counts_repeats(spark):
    d = spark.createDataFrame([([1, 2], [1, 1, 3]), ([1], [])], "got array<int>, wanted array<int>")
    assert [r[0] for r in d.select(P.recall(F.col("got"), F.col("wanted"))).collect()] == [pytest.approx(2 / 3), None]


def test_store(spark):
    c = spark.createDataFrame([("t", "c1", 0, [("i", " cap ", "u")]), ("t", "c2", 1, [("i", "later", "u"), ("none", "x", "u")])], "tenant_id string, id string, chunk_index int, image_analysis array<struct<image_id:string,analysis:string,image_url:string>>")
    captions, links = W.image_rows(c, spark.createDataFrame([("i",)], "image_id string"))
    assert [(r.document_id, r.content) for r in captions.collect()] == [("c1", "cap")] and links.count() == 2
    e = W.embedded(spark.createDataFrame([("a", "x y"), ("b", None)], "id string, content string")).orderBy("id").collect()
    assert abs(sum(v * v for v in e[0].embedding) - 1) < 1e-6 and not any(e[1].embedding)
    flat = W.flat_metadata(spark.createDataFrame([("a", 1, ["x"])], "id string, n int, tags array<string>"))
    assert flat.columns == ["document_row_id", "n", "type"]


def test_scores_are_held_for_a_few_queries_at_once():
    import tracemalloc

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    m, q = rng.normal(size=(4000, 8)), rng.normal(size=(3000, 8))
    batch = pd.DataFrame({"id": np.arange(len(m)), "embedding": list(m)})
    tracemalloc.start()
    found = S._best(batch, list(enumerate(q)), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.1 * 8 * S.CELLS * 5 < 8 * len(m) * len(q)  # which are all scores at once
    scores = np.round((q @ m.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(m, axis=1)), 6)
    assert found["id"].tolist() == [i for s in scores for i in np.lexsort((np.arange(len(m)), -s))[:3]]
