import zlib

import numpy as np
import pytest

from loamline.llm import langid as L
from loamline.llm import toxicity as T

WORDS = {"aa": "the and with house tree over", "bb": "der und mit haus baum über", "cc": "le et avec maison arbre été"}


def corpus(n=240):
    rng = np.random.default_rng(0)
    return [(i, " ".join(rng.choice(w.split(), int(rng.integers(3, 60)))), lang) for i in range(n) for lang, w in [list(WORDS.items())[i % 3]]]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def net(spark):
    L_steps, L.STEPS = L.STEPS, 120
    yield L.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    L.STEPS = L_steps


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    h, n = 3, 2
    net = L.Network(["a", "b"], *(rng.standard_normal(s) * 0.5 for s in ((2, 256, 3 * h), (2, h, 3 * h), (2 * h, n), (n,))))
    windows, y = rng.integers(0, 256, (4, 7)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        p = L._positions(net, L._forward(net, L._both(windows)).astype(float))
        return -np.log(p[:, np.arange(4), y]).mean()

    g = L._gradients(net, windows, y)
    for k in ("u", "v", "b", "e"):
        w = getattr(net, k)
        for at in [np.unravel_index(i, w.shape) for i in rng.integers(0, w.size, 4)] + ([(0, int(windows[0, 0]), 1)] if k == "e" else []):
            old, d = w[at], 1e-3
            w[at] = old + d
            up = loss()
            w[at] = old - d
            down = loss()
            w[at] = old
            assert g[k][at] == pytest.approx((up - down) / (2 * d), abs=2e-4)


def test_prediction_reads_as_training_does(net):
    w = np.frombuffer("der und mit the house été".encode()[:24], np.uint8)[None, :].repeat(3, 0)
    assert np.allclose(L._read(net, w), L._positions(net, L._forward(net, L._both(w))), atol=1e-5)


def test_held_out_accuracy(spark, net):
    rows = corpus()
    found = L.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), net).collect()
    right = [r.lang_pred == r.lang for r in found if held(r.doc_id)]
    assert len(right) > 20 and np.mean(right) >= 0.95 and all(0 <= r.score <= 1 for r in found)


def test_language_edge_cases(spark, net):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !!", None), (4, "the house", None), (4, "the house", None), (5, "the and " * 40_000, "q")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identified(d, net).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] == got[5][0] == "aa" and len(got) == 5
    assert L.identified(d.limit(0), net).count() == 0
    none = L.fit(d.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert none is None and {r.lang_pred for r in L.identified(d, None).collect()} == {"und"}


def test_pooling_covers_the_whole_text(net):
    a, b = "the house and " * 200, "der baum und " * 200
    p = L.document_probabilities(net, [(a + b).encode(), a.encode(), b.encode(), b"the"])
    assert p.sum(axis=1) == pytest.approx(np.ones(4), abs=1e-4)
    n = np.array([len(a.encode()), len(b.encode())])
    assert p[0] == pytest.approx((p[1] * n[0] + p[2] * n[1]) / n.sum(), abs=0.03)


def toxic_rows(n=600):
    rng = np.random.default_rng(3)
    plain = "tree house river sun walk bread light stone garden music".split()
    rows, labels = [], []
    for i in range(n):
        s = [" ".join(rng.choice(plain, 6)) for _ in range(int(rng.integers(1, 8)))]
        y = int(rng.random() < 0.3)
        if y:
            k = int(rng.integers(len(s)))
            s[k] += " " + rng.choice(["vile", "scum"])
        rows.append((i, ". ".join(s) + "."))
        labels.append((i, y))
    return rows, labels


def test_toxicity_learns_sentences_from_document_labels(spark):
    rows, labels = toxic_rows()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(0, labels[0][1]), (5, None), (None, 1)], "doc_id long, toxic int")
    model = T.fit(docs, known)
    y = dict(labels)
    found = T.scored(docs, model).collect()
    right = [r.predicted == y[r.doc_id] for r in found if held(r.doc_id)]
    assert len(right) > 60 and np.mean(right) >= 0.97
    for r in found:
        if y[r.doc_id] and r.predicted:
            assert len(r.offending) == 1 and any(w in r.text[r.offending[0].start : r.offending[0].end] for w in ("vile", "scum"))
        assert r.score == pytest.approx(1 - (1 - model.leak) * np.prod([1 - _sentence(model, ws) for _, _, ws in T.sentences(r.text)]), abs=1e-9)


def _sentence(model, words):
    known = [model.weights[w] for w in words if w in model.weights]
    return 1 / (1 + np.exp(-(sum(known) + model.bias))) if known else 0.0


def test_toxicity_sample_is_bounded_in_rows_and_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(40)] + [(50, "x" * 500)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    taken = lambda: {r.id: len(r.text) for r in T._sample(docs, known, "doc_id", "text", "toxic").collect()}
    every = taken()
    assert set(every) == {i for i in [*range(40), 50] if not held(i)}
    monkeypatch.setattr(T, "LONGEST", 200)
    monkeypatch.setattr(T, "CHARS", 1000)
    some = taken()
    assert some and max(some.values()) <= 200 and 800 <= sum(some.values()) <= 1000


def test_toxicity_edge_cases(spark):
    model = T.Model({"vile": 6.0}, -2.0, 0.1)
    d = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "So vile! Good.\nvile", None), (3, "So vile! Good.\nvile", None), (4, "good " * 50_000 + "vile", None)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in T.scored(d, model).collect()}
    assert got[1].score == got[2].score == pytest.approx(0.1) and got[1].predicted == 0
    assert [(s.start, s.end) for s in got[3].offending] == [(0, 8), (15, 19)] and got[4].predicted == 1
    assert T.scored(d.limit(0), model).count() == 0
    empty = T.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.predicted == 0 for r in T.scored(d, empty).collect())
    one_class = T.fit(d, spark.createDataFrame([(3, 1), (4, 1), (2, 1)], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in T.scored(d, one_class).collect())
