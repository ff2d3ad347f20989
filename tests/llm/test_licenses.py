import math
import random
import re

from loamline.llm import licenses as L

LOWER = str.maketrans(L._UPPER, L._LOWER)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expected(text, templates, threshold, phrases):
    w = words(text)
    at = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    blocks = set()
    for n, (label, keys, t) in enumerate(templates):
        keys, tokens = set(keys.split()), {*t.split(), *keys.split()}
        half = max(4, len(t.split()))
        for first in range(0, len(w), half):
            block = set(w[first : first + 2 * half])
            if len(block & tokens) >= math.ceil(threshold * len(tokens) - 1e-9) and keys <= block:
                blocks.add((first, len(w[first : first + 2 * half]), label, n, round(len(block & tokens) / len(tokens), 9)))
    base = {label for _, label in at}
    score = 1.0 if base else max((b[4] for b in blocks), default=0.0)
    starts = [i for i, _ in at]
    return (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {b[2] for b in blocks})), round(score, 9), sorted(blocks))


def found(rows):
    return {r["doc_id"]: (*(round(r[c], 9) if c == "license_score" else r[c] for c in L.RESULTS[:-1]), [(b["first"], b["words"], b["label"], b["template"], round(b["containment"], 9)) for b in r["license_blocks"]]) for r in rows}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    templates = [("one", "", "a b c d e f g h i j"), ("two", "x", "x y z x y"), ("three", "q", "q"), ("one", "a b", "b a n m l"), ("long", "k", " ".join("k a b c d e f g h l m n o p q r s t u v".split() * 2))]
    phrases = {"p": "a b", "q": "a b a", "r": "z"}
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", weights=[9, 9, 5, 5, 5, *[2] * 22], k=rng.randrange(200))) for _ in range(300)]
    texts += [None, "", " . ", "A, B; a.b\ta\nB-A", "Ä B a b", "É z Z", "K a b", "a b a b a b a", "x y z" * 3, "x.y.z " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for threshold in (0.5, 0.8, 1.0):
        got = found(L.scanned(df, phrases=phrases, templates=templates, threshold=threshold).collect())
        assert got == {i: expected(t, templates, threshold, phrases) for i, t in enumerate(texts)}


def test_notices_are_found_and_clean_texts_left(spark):
    clean = "the license to print version 2 of the general plan was released under public pressure by the mit or cc group " * 5
    mit = dict((t[0] + str(n), t[2]) for n, t in enumerate(L.TEMPLATES))["mit2"]
    rows = [(0, clean), (1, "intro\n" + mit.upper() + "\nend"), (2, clean + mit.replace("free of charge", "") + clean), (3, "Licensed under the Apache License, Version 2.0."), (4, "licensed under the Mozilla license version 2 0")]
    got = found(L.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [got[i][5] for i in range(5)] == ["", "mit", "mit", "apache-2.0", ""]


def test_clashing_names_nulls_copies_and_empty_tables(spark):
    rows = [(None, "cc by", 1, "x", 2), (None, "cc by", 1, "x", 2), (7, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int, license_score string, `a.b` int")
    out = L.scanned(df)
    assert out.columns == ["doc_id", "text", "digest", "a.b", *L.RESULTS]
    assert sorted((r["doc_id"] is None, r["digest"], r["a.b"], r["license_n_base"], r["license_score"]) for r in out.collect()) == sorted([(True, 1, 2, 1, 1.0)] * 2 + [(False, None, None, 0, 0.0)], key=str)
    assert L.scanned(df.limit(0)).count() == 0
    assert found(L.scanned(df, templates=[], phrases={}).collect())[7][:2] == (0, 0)
