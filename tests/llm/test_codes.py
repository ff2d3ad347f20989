import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from loamline.llm import codes as C


def brute_nearest(points, book):
    d = ((points[:, None, :] - book[None]) ** 2).sum(-1)
    return d.argmin(1), d.min(1)


def expected(rows, parts, entries, rounds):
    """rows: (id, vector, label). Plain loops over Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    m = -(-len(kept[0][1]) // parts)
    x = [[(v + [0] * parts * m)[p * m : (p + 1) * m] for p in range(parts)] for _, v, _ in kept]
    books = [[x[e][p] for e in range(min(entries, len(x)))] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], entry)), e) for e, entry in enumerate(books[p])) for p in range(parts)] for v in x]

    for _ in range(rounds):
        a = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, y in zip(x, a) if y[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [(i, "".join(f"{e:02x}" for _, e in y), sum(d for d, _ in y), label) for (i, _, label), y in zip(kept, assign())]
    of = {}
    for _, _, error, label in out:
        of[label] = of.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, of[label], sha) for i, c, e, label in out), key=str)


def result(df):
    return sorted(((r["vec_id"], *(r[c] for c in C.RESULTS)) for r in df.collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5).flatmap(lambda m: st.tuples(arrays(np.int64, st.tuples(st.integers(1, 20), st.just(m)), elements=st.integers(-4, 4)), arrays(np.int64, st.tuples(st.integers(1, 9), st.just(m)), elements=st.integers(-4, 4)))))
def test_partial_distance_search_is_exact_with_ties(x):
    for got, want in zip(C.nearest(*x), brute_nearest(*x)):
        assert np.array_equal(got, want)


def test_equals_plain_loops(spark):
    rng = random.Random(5)
    vector = lambda n: [rng.gauss(0, 0.2) for _ in range(n)]
    rows = [(i, vector(8), rng.choice([None, 1, 1, 1, 2])) for i in range(150)]
    rows += [(None, vector(8), 3), (7, vector(8), 1), (7, rows[7][1], 1), (200, None, 1), (201, [0.1, None] + vector(6), 1), (202, [float("nan")] + vector(7), 2), (203, [float("-inf")] + vector(7), 2), (-4, [0.0] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    for parts, entries, rounds in ((4, 16, 2), (16, 64, 1), (3, 200, 2)):
        assert result(C.compressed(df, parts=parts, entries=entries, rounds=rounds)) == expected(rows, parts, entries, rounds)


def test_few_short_and_no_vectors_and_clashing_names(spark):
    rows = [(2, [0.5, -0.5], None, "a", "x"), (1, [1.0], None, "b", "y"), (3, [1.0, 1.0, 9.0], 4, "c", "z"), (4, [], 4, "d", "z"), (5, [1e30, -1e30], 4, "e", "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, own string, pq_code string").withColumnRenamed("own", "error")
    out = C.compressed(df)
    assert out.columns == ["vec_id", "embedding", "label", "error", *C.RESULTS]
    got = {r["vec_id"]: r for r in out.collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[3]["error"] == "c" and got[1][C.RESULTS[1]] == 0 and all(len(r[C.RESULTS[0]]) == 32 for r in got.values())
    assert got[1][C.RESULTS[2]] == got[1][C.RESULTS[1]] + got[2][C.RESULTS[1]]
    assert C.compressed(df.where("vec_id > 9")).count() == 0


def test_codes_decode_to_their_error(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=32).tolist(), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    books = C.codebooks(df)
    for r in C.compressed(df).collect():
        x = np.floor(np.array(r["embedding"]) * 256).astype(int)
        assert ((x - C.decoded(r[C.RESULTS[0]], books)) ** 2).sum() == r[C.RESULTS[1]] and C.digest(books) == r[C.RESULTS[3]]
