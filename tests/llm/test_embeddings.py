import numpy as np

from loamline.llm import embeddings as E

from .test_simhash import groups

SCHEMA = "vec_id long, embedding array<float>, label int, n int, node string, low string"


def rows():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    out = [(i, base[i % 40] + rng.standard_normal(16) * (0.35 if i >= 40 else 0), int(i % 3 if i < 40 else (i % 40) % 3)) for i in range(160)]
    out = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in out]
    odd = [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, [None] + [1.0] * 15, 1), (205, [float("inf")] * 16, 1), (206, out[0][1], None), (207, [1.0, 2.0], 1), (208, [2.0, 4.0], 1)]
    copies = [(300 + i, out[1][1], out[1][2]) for i in range(5)] + [(1, out[1][1], out[1][2]), (310, [-0.0 if x == 0 else x for x in out[1][1]], out[1][2])]
    return [(*r, 1, "a", "b") for r in out + odd + copies]


def test_links_and_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "TILE", 16)
    data = rows()
    got = E.embedding_components(spark.createDataFrame(data, SCHEMA)).collect()
    sound = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        (_, v, x, *_), (_, w, y, *_) = data[a], data[b]
        if x is None or x != y or not sound(v) or not sound(w) or len(v) != len(w):
            return False
        v, w = np.array(v), np.array(w)
        return v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93

    n = len(data)
    links = [sum(linked(a, b) for b in range(n) if b != a) for a in range(n)]
    part = groups(list(range(n)), linked)
    low = {c: min(data[k][0] for k in range(n) if part[k] == c) for c in set(part.values())}
    want = sorted((data[k][0], links[k], low[part[k]], data[k][0] == low[part[k]]) for k in range(n))
    assert sorted(tuple(r) for r in got) == want and max(links) > 5


def test_bounds_hold_and_nothing_below_the_threshold_is_linked():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 24)) * rng.uniform(1e-6, 1e6, (200, 1))
    q, s, e, n = E.quantised(x)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    exact, coded = unit @ unit.T, (q.astype(float) @ q.astype(float).T) * np.outer(s, s)
    assert (np.abs(exact - coded) <= np.outer(e, n) + np.outer(n, e) + np.outer(e, e) + 1e-12).all()
    i, j = E.linked(x, x, 0.4)
    assert {(a, b) for a, b in zip(i, j)} == {(a, b) for a, b in zip(*np.nonzero(exact >= 0.4))}


def test_empty_and_unlinked(spark):
    assert E.embedding_components(spark.createDataFrame([], SCHEMA)).count() == 0
    r = E.embedding_components(spark.createDataFrame([(7, [1.0], 1, 1, "", "")], SCHEMA)).first()
    assert (r.vec_id, r.n_links, r.component_id, r.kept) == (7, 0, 7, True)
