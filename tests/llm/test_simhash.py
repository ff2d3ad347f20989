import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loamline.llm import simhash as S
from loamline.llm.common import components, local_labels

DOCS = "doc_id long, text string, fp string, component string"  # columns whose names the operator uses itself


def plain_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def texts():
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 60, n))
    base = [word(300) for _ in range(25)]
    near = [b.replace(b.split()[k], "new", 1) for b in base[:10] for k in (3, 50, 200)]
    return [*base, *near, *base[:4], "", " \n", "one", "ONE", "one two", word(20_000), "É x y z q", "é x y z q"]


def test_components_equal_brute_force(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(900, None, None, None), (None, "one", None, None), (3, texts()[3], None, None)]
    got = S.simhash_components(spark.createDataFrame(rows, DOCS)).collect()
    prints = {i: plain_fingerprint(t) for i, t, *_ in rows if i is not None}
    want = groups(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {r.doc_id: r.fp % 2**64 for r in got if r.doc_id is not None} == prints
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert len(got) == len(rows) and next(r for r in got if r.doc_id is None).component_id == want[texts().index("one")]
    assert len(set(want.values())) < len(prints)


def test_empty_table(spark):
    assert S.simhash_components(spark.createDataFrame([], DOCS)).count() == 0
    assert S.deduplicated(spark.createDataFrame([], DOCS)).columns == ["doc_id", "text", "fp", "component"]


def test_links_of_close_fingerprints_with_small_trees(spark, monkeypatch):
    """A dense ball of fingerprints larger than a tree is cut into pieces and still linked whole."""
    rng = np.random.default_rng(5)
    center = int(rng.integers(1 << 62))
    ball = {center ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (1, 2, 3) for _ in range(120)}
    far = {int(x) for x in rng.integers(0, 1 << 63, 150)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in ball | far)
    monkeypatch.setattr(S, "TREE", 40)
    found = components(S.links(spark.createDataFrame([(v,) for v in values], "fp long"), 4)).collect()
    got = {v: v for v in values} | {r.node: r.component for r in found}
    parts = groups(values, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 4)
    same = lambda m: {frozenset(k for k in values if m[k] == c) for c in set(m.values())}
    assert same(got) == same(parts)


@pytest.mark.parametrize("radius", [0, 4, 20])
def test_bk_search_finds_all_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    fp = np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64) & np.uint64(0xFFFF0000FF))
    t = pa.table({"shard": np.zeros(len(fp), np.int64), "fp": fp.view(np.int64), "asks": np.ones(len(fp), bool), "in_tree": np.ones(len(fp), bool)})
    got = {(int(a), int(b)) for x, y in S.near_pairs(t, radius) for a, b in zip(x, y)}
    assert got == {(i, j) for i in range(len(fp)) for j in range(len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= radius}


def test_one_document_of_each_near_duplicate_group_stays(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(900, None, None, None), (None, "one", None, None)]
    got = sorted((r.doc_id for r in S.deduplicated(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    sets = {i: set(S.shingle_hashes(t, 5).tolist()) for i, t, *_ in rows if i is not None}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return x == y or len(x & y) >= 0.8 * len(x | y) > 0

    want = groups(list(sets), linked)
    assert got == sorted({c for c in want.values()}, key=str)


def test_near_duplicates_with_repeated_phrases_and_short_texts(spark):
    """Pairs of like sets whose fingerprints may be far apart: a phrase repeated in one, or 5 shingles against 4."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    rows = []
    for n in range(30):
        long, phrase, short = word(504), word(6), word(9)
        rows += [(6 * n, " ".join(long)), (6 * n + 1, " ".join(long + phrase * (50 + 5 * n)))]
        rows += [(6 * n + 2, " ".join(short)), (6 * n + 3, " ".join(short[:-1])), (6 * n + 4, " ".join(word(9))), (6 * n + 5, " ".join(short[:-2]))]
    got = {r.doc_id for r in S.deduplicated(spark.createDataFrame([(*r, "", "") for r in rows], DOCS)).collect()}
    sets = {i: set(S.shingle_hashes(t, 5).tolist()) for i, t in rows}
    want = groups(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert got == set(want.values()) and len(got) == 120


def test_all_pairs_of_like_sets_are_given():
    rng = np.random.default_rng(9)
    sets = []
    for n in [*rng.integers(4, 40, 30), *rng.integers(300, 2000, 10)]:
        base = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        sets += [np.unique(base), np.unique(base[: -max(1, n // 6)]), np.unique(base[n // 8 :])]
    t = pa.table({"shard": np.arange(len(sets)) % 2, "n": [len(x) for x in sets], "sig": pa.array(map(S.parity, sets), pa.binary()), "asks": np.ones(len(sets), bool), "in_tree": np.ones(len(sets), bool)})
    got = {frozenset((int(a), int(b))) for x, y in S.similar_pairs(t, 0.8) for a, b in zip(x, y)}
    like = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if (i - j) % 2 == 0 and like(sets[i], sets[j])}
    assert want <= got and len(want) > 10


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 700)}
    assert list(local_labels(5, np.array([1, 3]), np.array([2, 4]))) == [0, 1, 1, 3, 3]
