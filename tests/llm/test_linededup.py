import numpy as np
import pytest

from loamline.llm import linededup as L

SCHEMA = "doc_id long, text string, line string, cls string, id string"


def texts():
    rng = np.random.default_rng(6)
    pool = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choice(pool, n))
    base = [line(int(n)) for n in rng.integers(5, 60, 60)]
    docs = []
    for _ in range(60):
        parts = []
        for k in rng.integers(0, 60, 5):
            words = base[k].split()
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = str(rng.choice(pool))
            parts.append(" ".join(rng.permutation(words) if rng.random() < 0.3 else words))
        docs.append("\n".join([*parts, "", "short line", line(12)]))
    return docs


def brute(rows, t=0.8, least=5):
    """(doc_id, text) to the lines that stay; rows with one id must be equal."""
    seen, gone, out = [], {}, {}
    for i in sorted({r[0] for r in rows}):
        lines = (next(x for j, x in rows if j == i) or "").split("\n")
        gone[i] = set()
        for k, s in enumerate(lines):
            w = set(s.encode().split())
            if len(w) < least:
                continue
            if any(len(w & v) >= t * len(w | v) - 1e-9 for v in seen):
                gone[i].add(k)
            seen.append(w)
        out[i] = ("\n".join(s for k, s in enumerate(lines) if k not in gone[i]), len(lines), len(gone[i]))
    return out


@pytest.mark.parametrize("piece", [4096, 6])
def test_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE", piece)  # 6: most blocks are cut
    rows = list(enumerate(texts())) + [(100, ""), (101, " "), (102, "a b c d e"), (103, "e d c b a\na b c d e"), (102, "a b c d e"), (104, "w1 w2 w3 w4 w5 " * 3000)]
    got = L.line_dedup(spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA)).collect()
    want = brute(rows)
    assert {r.doc_id: (r.text, r.dedup_n_lines, r.dedup_n_removed) for r in got} == want
    assert len(got) == len(rows) and sum(w[2] for w in want.values()) > 50 and {r.line for r in got} == {"x"}


def test_nulls_come_last_and_empty_tables_pass(spark):
    line = "one two three four five six"
    rows = [(None, line, "x", "", ""), (7, line, "x", "", ""), (8, None, "x", "", "")]
    got = {r.doc_id: (r.text, r.dedup_n_removed) for r in L.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {None: ("", 1), 7: (line, 0), 8: (None, 0)}
    assert L.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert L.line_dedup(spark.createDataFrame([(1, "no pairs here", "", "", "")], SCHEMA)).first().text == "no pairs here"


def test_equal_ids_with_unlike_texts_keep_their_own_lines(spark):
    rows = [(1, "a b c d e\nv w x y z", "", "", ""), (1, "v w x y z\nf g h i j", "", "", "")]
    got = L.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.text.count("v w x y z") for r in got) == 1 and sum(r.dedup_n_removed for r in got) == 1


def test_a_large_group_stays_cut_into_pieces(spark, monkeypatch):
    """Lines with one number changed in each: no shard that is compared in one task exceeds two pieces."""
    monkeypatch.setattr(L, "PIECE", 16)
    rows = [(i, f"the same long footer of each page stands here with number n{i}") for i in range(400)]
    sizes, kept = [], {n: getattr(L, n) for n in ("_involved", "_refined")}

    def watched(name):
        def run(*args):
            found = kept[name](*args)
            sizes.append(max(r["count"] for r in found.groupBy("shard").count().collect()))
            return found

        return run

    for name in kept:
        monkeypatch.setattr(L, name, watched(name))
    got = L.line_dedup(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)).collect()
    assert {r.doc_id for r in got if r.dedup_n_removed == 0} == {0} and len(got) == 400
    assert len(sizes) == 2 and max(sizes) <= 4 * 16  # pieces are dealt by hash: some are over their mean


def test_other_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "gone", "parts", "doc", "tie", "_doc", "dedup_n_lines", "a.b"]
    got = L.line_dedup(spark.createDataFrame([(1, "a b c d e", *"stuvwxy"), (2, "a b c d e\nx", *"stuvwxy")], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names)))
    assert got.columns == [n for n in names if n != "dedup_n_lines"] + ["dedup_n_lines", "dedup_n_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, "a b c d e", *"stuvw", "y", 1, 0), (2, "x", *"stuvw", "y", 2, 1)]
