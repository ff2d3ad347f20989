import heapq
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, shard string, size string"


def water(sizes):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    left, budget = set(names), Fraction(3, 2) * sum(sizes.values())
    while left:
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        capped = {s for s in left if share[s] > 2 * sizes[s]}
        if not capped:
            return target | share
        for s in capped:
            target[s] = Fraction(2 * sizes[s])
            budget -= target[s]
            left.discard(s)
    return target


def docs(spark, n=240):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 400))), "big" if i % 3 == 0 else f"s{i % 7}", "x", "y") for i in range(n)]
    rows += [(500, None, "s1", "", ""), (501, "", None, "", ""), (502, "a b\tc\n", None, "", ""), (503, "tiny", "only", "", ""), (None, "w " * 50, "s2", "", ""), (504, "v " * 30_000, "s3", "", ""), (1, rows[1][1], rows[1][2], "x", "y")]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("shard", [1 << 16, 40])
def test_targets_and_taken_words(spark, monkeypatch, shard):
    monkeypatch.setattr(M, "SHARD", shard)  # 40: sources have many shards
    rows, df = docs(spark)
    got = M.mixed(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = water(sizes)
    for r in got:
        assert r.mix_size == size(r.text) and r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(float(want[r.source])) and 0 <= r.mix_taken <= 2 * r.mix_size
    for s in sizes:
        taken = sum(r.mix_taken for r in got if r.source == s)
        assert abs(taken - want[s]) <= 2 * M.BLOCK + 0.01 * sizes[s], (s, taken, float(want[s]))
    again = M.mixed(df.repartition(7)).collect()
    key = lambda rs: sorted((str(r.doc_id), r.text or "", r.mix_taken) for r in rs)
    assert key(got) == key(again)


def test_apportionment_equals_the_highest_quotients(spark):
    rng = np.random.default_rng(1)
    cases = [(g, u, float(w)) for g, n in (("a", 1), ("b", 9), ("c", 40)) for u, w in enumerate(np.concatenate([rng.integers(0, 50, n - 1), [2000]]))]
    seats = {"a": 7, "b": 113, "c": 500}
    df = spark.createDataFrame([(g, u, w, seats[g]) for g, u, w in cases], "g string, u int, w double, seats long")
    got = {(r.g, r.u): r.quota for r in M.apportioned(df, ["g"], "u", "w", "seats").collect()}
    for g, n in seats.items():
        units = [(u, w) for h, u, w in cases if h == g]
        heap, quota = [(-w, u, 1, w) for u, w in units if w], dict.fromkeys((u for u, _ in units), 0)
        heapq.heapify(heap)
        for _ in range(n):
            _, u, k, w = heapq.heappop(heap)
            quota[u] += 1
            heapq.heappush(heap, (-w / (2 * k + 1), u, k + 1, w))
        assert {u: got[g, u] for u, _ in units} == quota


def test_texts_hold_what_is_taken(spark):
    _, df = docs(spark)
    df = df.where("doc_id is null or doc_id <> 1")
    taken = {r.doc_id: r.mix_taken for r in M.mixed(df).collect()}
    got = {r.doc_id: r.text for r in M.mixed_texts(df).collect()}
    for i, n in taken.items():
        assert len((got.get(i) or "").split()) == n if n else not (got.get(i) or "").split()
    assert M.mixed_texts(df).columns == df.columns and got[502].count("a b\tc") >= 1


def test_no_python_in_the_plan_and_empty_tables(spark):
    empty = M.mixed(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    _, df = docs(spark, 6)
    plan = M.mixed_texts(df.withColumn("n", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
