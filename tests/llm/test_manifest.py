import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loamline.llm import manifest as M

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root and the path of each node as (left sibling, digest)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            if i ^ 1 < len(nodes):
                path.append((i % 2 == 1, nodes[i ^ 1]))
            else:
                path.append((False, ""))
        at = [i // 2 for i in at]
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def expected(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    inner = {t: climb([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in names}
    root, outer = climb([inner[t][0] for t in names])
    out = []
    for t, above in zip(names, outer):
        for (_, _, was, r), path in zip(sorted(trees[t], key=lambda x: x[:3]), inner[t][1]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf((*r[:3], r[3] + 1 if r[3] is not None else None, r[4])) if changed else was
            for left, s in path + above:
                now = H(s, now) if left else H(now, s)
            out.append((r[0], was, inner[t][0], root, H(*(s for _, s in path + above)), now, now == root))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[:-1]) for r in df.collect()), key=str)


def run(df, levels):
    return M.proved(df, FIELDS, tampered=M.one_in_seven("doc_id"), change={"n_chars": F.col("n_chars") + 1}, levels=levels)


def rows_of(n, langs, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([i, i, i, i - 3, None]), rng.choice(["a", "b", None]), rng.choice(langs), rng.choice([None, 5, 77]), rng.choice([None, "", "ä ö", "x" * rng.randrange(99)])) for i in range(n)]


@pytest.mark.parametrize("levels, n, langs", [(1, 21, ["en"]), (2, 33, ["en", "de", None]), (2, 16, ["en"]), (3, 150, ["en", "en", "en", "é", "z", None, "a", "b", "c"]), (10, 40, ["en", None])])
def test_equals_plain_tree(spark, levels, n, langs):
    rows = rows_of(n, langs)
    rows += rows[:3]  # equal rows
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert result(run(df, levels)) == expected(rows)


def test_ranges_that_cut_trees(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE", 7)
    rows = [(i, None, "ab"[i > 60], i, "t") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert result(run(df, 2)) == expected(rows)


def test_one_row_no_rows_and_other_columns(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree int, leaf int, i int"
    df = spark.createDataFrame([(1, None, None, None, None, 1, 2, 3)], schema)
    (r,) = run(df, 4).collect()
    assert r["merkle_leaf"] == r["merkle_subroot"] == r["merkle_root"] == r["merkle_folded_root"] == leaf((1, None, None, None, None)) and r["merkle_proof_sha256"] == H() and r["merkle_path"] == []
    assert run(df.where("doc_id > 1"), 4).count() == 0


def test_many_equal_rows_make_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE", 50)
    rows = [(1, "s", "en", 3, "same")] * 400 + [(2, "s", "en", 3, "other")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    found = M.placed(M.written(M.leaves(df, FIELDS, "doc_id", "lang", None, {}), "leaves"))
    tasks = found.groupBy(F.spark_partition_id()).count()
    assert tasks.count() >= 2 and tasks.agg(F.max("count")).first()[0] < 300
    assert sorted(r["i"] for r in found.collect()) == list(range(401))
    assert result(run(df, 3)) == expected(rows)
