import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline import registry
from loamline.operators import search as S
from loamline.operators import vectorindex as X

SF = "/root/testdata/sf0.1"


def clustered(n=3000, dims=32, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    x = centres[rng.integers(40, size=n)] + 0.3 * rng.normal(size=(n, dims))
    return [(i, x[i].tolist(), int(rng.integers(6)), "x") for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    odd = [(5000, None, 1, "odd"), (5001, [0.0] * 32, 1, "odd"), (5002, [1.0, 2.0], 1, "odd"), (5003, [float("nan")] * 32, 2, "odd"), (5004, [], 2, "odd")]
    copies = [(6000 + i, clustered(1)[0][1], 3, "copy") for i in range(50)]
    return spark.createDataFrame(clustered() + odd + copies, "id long, embedding array<double>, label int, kind string").repartition(4)


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return X.built(rows, f"file://{tmp_path_factory.mktemp('index')}/i", lists=50)


def hits(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())


def asked(rows, n=40):
    return rows.where(f"id % {3000 // n} = 0 or id = 6001").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


def test_all_lists_are_exact_with_ties_filters_and_odd_rows(spark, rows, index):
    queries = asked(rows).unionByName(spark.createDataFrame([(-1, [1.0, 2.0]), (-2, [0.0] * 32), (-3, None)], "query_id long, query array<double>"))
    sound = rows.where("id <> 5003")  # a score of an undefined vector is undefined
    for where in (None, F.col("label") == 2, F.col("kind") == "odd", F.col("label") == 99):
        flt = F.col("id") != 5003 if where is None else where & (F.col("id") != 5003)
        got = hits(X.nearest(spark, index, queries.where("query is not null"), 7, lists=None, where=flt, tile=64, block=16))
        want = hits(S.block_top_k(sound if where is None else sound.where(where), queries.where("query is not null"), 7))
        assert got == want


def recall_of(found, want):
    want = {(q, i) for q, _, i, _ in want}
    return len(want & {(q, i) for q, _, i, _ in found}) / len(want)


def test_few_lists_find_most_and_read_few(spark, rows, index):
    queries = asked(rows)
    exact = hits(S.block_top_k(rows.where("kind = 'x'"), queries, 10))
    few = X.nearest(spark, index, queries, 10, lists=4, where=F.col("kind") == "x")
    assert recall_of(hits(few), exact) >= 0.9
    coarse = X.nearest(spark, index, queries, 10, lists=4, where=F.col("kind") == "x", refine=8)
    assert recall_of(hits(coarse), exact) >= 0.9
    rare = F.col("label") == 1
    assert recall_of(hits(X.nearest(spark, index, queries, 10, lists=8, where=rare)), hits(S.block_top_k(rows.where(rare), queries, 10))) >= 0.9


def test_lists_not_asked_are_pruned(spark, rows, index):
    one = asked(rows).where("query_id = 75")
    lists = X.probes(index, one, {i: 60 for i in range(50)}, 3, 1)
    assert lists.where("list >= 0").count() == 3
    found = X.nearest(spark, index, one, 5, lists=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and " IN (" in plan
    # the scan that finds candidates reads the files of four lists, and no vectors
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x]
    assert any("embedding" not in x.split("Batched")[0] for x in scans)
    mine = index.rows(spark).where(F.col("list").isin([r["list"] for r in lists.collect()])).select(F.input_file_name()).distinct().count()
    assert mine <= 4 < index.rows(spark).select(F.input_file_name()).distinct().count()


def test_lists_for_reaches_its_recall(spark, rows, index):
    n = X.lists_for(spark, index, 10, recall=0.9, sample=100)
    queries = asked(rows)
    exact = hits(S.block_top_k(rows.where("kind = 'x'"), queries, 10))
    assert 1 <= n < 50 and recall_of(hits(X.nearest(spark, index, queries, 10, lists=n, where=F.col("kind") == "x")), exact) >= 0.85


def test_codes_stay_within_their_bounds(rows, index):
    pdf = rows.where("kind = 'x' and id < 500").toPandas()
    coded = X._coded(pdf["embedding"], index.centroids, index.books)
    codes = np.frombuffer(b"".join(coded["_code"]), np.uint8).reshape(len(pdf), -1)
    near, off = X._bounds(codes, coded["_miss"].to_numpy(), coded["list"].to_numpy(), pdf["embedding"], index.centroids, index.books)
    x, _ = X.unit(pdf["embedding"], index.dims)
    assert (np.abs(x @ x.T - near) <= off + 1e-9).all() and off.mean() < 0.7


def test_opened_and_added(spark, rows, tmp_path):
    path = f"file://{tmp_path}/i"
    first = X.built(rows.where("id < 2000"), path, lists=20)
    X.added(first, rows.where("id >= 2000 and kind <> 'odd'"))
    again = X.opened(spark, path)
    assert np.array_equal(again.centroids, first.centroids) and np.array_equal(again.books, first.books)
    queries = asked(rows)
    assert hits(X.nearest(spark, again, queries, 5, lists=None)) == hits(S.block_top_k(rows.where("kind <> 'odd'"), queries, 5))


def test_empty_index(spark, rows, tmp_path):
    index = X.built(rows.limit(0), f"file://{tmp_path}/i")
    assert X.opened(spark, index.path).centroids.size == 0
    spark.createDataFrame([], "id long").count()


def test_registered_recall(spark):
    for name in ("index_recall", "index_recall_filtered"):
        r = registry.QUERIES[name](spark, SF).agg(F.avg("recall"), F.count("*")).first()
        assert r[0] >= 0.9 and r[1] == 20


def test_rows_and_queries_are_not_written_in_pairs(spark, tmp_path):
    from test_answers import most_rows

    x = np.random.default_rng(4).normal(size=(2000, 32))  # without clusters the codes leave most rows open
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(4)
    index = X.built(rows, f"file://{tmp_path}/i", lists=20)
    queries = rows.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    found = X.nearest(spark, index, queries, 5, lists=None, tile=500)
    assert hits(found) == hits(S.block_top_k(rows, queries, 5))
    found.collect()
    assert most_rows(found._jdf.queryExecution().executedPlan()) <= 400 * 7 * 5 < 400 * 2000 / 8


def test_tiles_hold_short_lists_together_and_long_ones_in_pieces():
    tiles = X._tiles({-1: 3, 0: 5, 1: 4, 2: 25, 3: 1, 4: 9}, 10)
    assert tiles == {-1: (0, 1), 0: (0, 1), 1: (1, 1), 2: (2, 3), 3: (5, 1), 4: (5, 1)}
    assert X._tiles_of([0, 2, 9], tiles) == {0: [0], 2: [2], 3: [2], 4: [2]}
