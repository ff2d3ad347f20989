import hashlib
import math

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loamline.llm import pieces as P
from loamline.llm import syncmers as S

DOCS = "doc_id long, text string, bucket string, tie string, piece_ids string"


def plain_syncmers(text, k, s):
    """Positions whose k-mer has its least s-mer (by the operator's hash) first or last."""
    codes = np.array([ord(c) for c in text], np.uint64)
    runs = lambda n: [tuple(codes[i : i + n]) for i in range(len(codes) - n + 1)]
    order = {}
    for r in set(runs(s)):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in r:
                h = h * S._B + c * S._B
        order[r] = int(S._mixed(np.array([h]))[0])
    out = []
    for i in range(len(codes) - k + 1):
        inner = [order[tuple(codes[i + j : i + j + s])] for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


@pytest.mark.parametrize(("k", "s"), [(24, 8), (8, 4), (4, 4)])
def test_closed_syncmers_equal_brute_force(k, s):
    rng = np.random.default_rng(k)
    text = "".join(rng.choice(list("abcdé漢 "), 500))
    at, h = S.closed(np.array([ord(c) for c in text], np.uint64), k, s)
    assert at.tolist() == plain_syncmers(text, k, s)
    hashes = {}
    for a, b in zip(at, h):
        assert hashes.setdefault(text[a : a + k], b) == b  # the k-mer alone decides


def test_blocks_do_not_change_a_fingerprint(monkeypatch):
    text = "".join(np.random.default_rng(1).choice(list("abcdefgh "), 5000))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "BLOCK", 137)
    assert S.fingerprint(text) == whole and len(whole) == S.SIZE * 16


def test_likeness_has_no_cliff_at_brief_texts():
    """A text and its edit on the two sides of BRIEF, and all lengths about it, keep a likeness of about two thirds."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    for n in [60, 90, 120, 160, 240, 400, 500, 511, 512, 513, 514, 520, 600, 700]:
        a, b = (" ".join(word() for _ in range(300))[:n] for _ in range(2))
        for other in (b, b[: n // 6]):  # the edit is as long, or shorter
            edited = a[: n - n // 3] + other[: n // 3]
            assert S.likeness(S.fingerprint(a, None), S.fingerprint(edited, None), None) > 0.45, n


def test_likeness():
    rng = np.random.default_rng(2)
    make = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    a, b = make(20_000), make(20_000)
    assert S.likeness(S.fingerprint(a), S.fingerprint(a)) == 1 and S.likeness(S.fingerprint(a), S.fingerprint(b)) < 0.05
    edited = S.likeness(S.fingerprint(a), S.fingerprint(a[:14_000] + b[:6000]))
    assert 0.45 < edited < 0.9
    assert S.likeness(S.fingerprint(a), S.fingerprint("xx " + a)) > 0.9
    swapped = a[10_000:] + a[:10_000]  # the same anchors in another order
    assert S.likeness(S.fingerprint(a), S.fingerprint(swapped)) < 0.8
    assert S.likeness("", "") == 1 and S.likeness("", S.fingerprint("x")) == 0


def test_a_shared_passage_is_found_in_very_long_texts(spark, tmp_path):
    from loamline.llm.registry import op8_syncmers

    rng = np.random.default_rng(4)
    make = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    passages = [make(300) for _ in range(7)]
    rows = [(i, make(100_000) + (passages[i - 1] if i else "") + make(50_000) + (passages[i] if i < 7 else "") + make(60_000)) for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op8_syncmers(spark, str(tmp_path)).collect()}
    share = 277 / 210_000
    assert all(0.25 * share < got[i].near_next < 2 * share for i in range(1, 8))  # next by descending id
    for i, text in rows:
        codes = np.array([ord(c) for c in text], np.uint64)
        assert len(got[i].fingerprint) == 16 * len(np.unique(S.closed(codes, *S.LONG)[1]))


def test_next_documents_and_edits(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), "".join(rng.choice(list("abc é漢"), int(n)))) for i, n in zip(rng.permutation(60), rng.integers(0, 90, 60))]
    rows += [(100, None), (101, "z" * 50_000), (None, "last"), (7, dict(rows)[7])]
    got = S.edited_fingerprints(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)).collect()
    order = sorted((r for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), S.fingerprint(t), S.fingerprint(edited), S.likeness(S.fingerprint(t), S.fingerprint(edited)), S.likeness(S.fingerprint(t), S.fingerprint(after))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("known", [0, 20])
def test_many_null_ids_follow_by_hash_of_text(spark, known):
    rows = [(i, f"known {i} " * 3) for i in range(known)] + [(None, f"text {i} " * 4) for i in range(60)]
    tie = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -tie(r[1])))
    want = {}
    for (_, t), (_, after) in zip(order, [*order[1:], order[0]]):
        want[S.fingerprint(t)] = hashlib.sha256((t[: len(t) - len(t) // 3] + after[: len(t) // 3]).encode()).hexdigest()
    got = S.edited_fingerprints(spark.createDataFrame([(*r, "", "", "") for r in rows], DOCS)).collect()
    assert len(got) == len(rows) and {r.fingerprint: r.edited_sha256 for r in got} == want


@pytest.mark.parametrize("rows", [[], [(1, "only one here")], [(None, None), (None, "x")]])
def test_few_documents(spark, rows):
    got = S.edited_fingerprints(spark.createDataFrame([(*r, "", "", "") for r in rows], DOCS)).collect()
    assert len(got) == len(rows)


@pytest.fixture(scope="module")
def as_unigram():
    """The library's own Viterbi over the same pieces and scores."""
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path(P.MODEL), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for x in m.pieces:
        if x.type == 1:
            x.score = -math.log(P.RANK - x.score)
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00▁"), max_size=60) | st.text("the of and inre.,\n 漢é", max_size=60))
def test_best_segmentation_equals_the_library(as_unigram, text):
    model = P.Pieces.of(P.MODEL)
    ids = np.frombuffer(model.encode(text), "<i4")
    score = lambda ids: sum(as_unigram.get_score(int(i)) for i in ids if not as_unigram.is_byte(int(i)))
    theirs = as_unigram.encode(text)
    assert ids.tolist() == theirs or score(ids) == pytest.approx(score(theirs), rel=1e-5)
    assert model.decode(ids) == text


@given(st.text(st.sampled_from("ab ▁é漢\n"), max_size=30))
def test_decoding_gives_back_word_marks(text):
    model = P.Pieces.of(P.MODEL)
    assert model.decode(np.frombuffer(model.encode(text), "<i4")) == text


def test_ids_are_about_as_few_as_the_library_has():
    import public_tokenizers
    import sentencepiece

    text = "The quick brown fox jumps over the lazy dog. Dies ist ein kurzer deutscher Satz über Sprache."
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.MODEL)).encode(text)
    assert len(P.Pieces.of(P.MODEL).encode(text)) // 4 <= 1.05 * len(library)


def test_round_trip_and_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "  two  spaces "), (4, "漢字 😀\x00\n\t"), (5, "a▁b"), (5, "a▁b"), (6, "x" * 20_000), (None, "word " * 50_000)]
    d = spark.createDataFrame([(*r, "b", "t", "p") for r in rows], DOCS)
    got = P.round_trip(d).collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    both = {r.doc_id: r for r in P.decoded(P.encoded(d)).collect()}
    assert both[1].piece_ids is None and both[1].decoded is None and both[2].piece_ids == [] and both[3].decoded == "  two  spaces " and both[5].decoded == "a▁b" and both[4].bucket == "b"
    assert P.encoded(d.limit(0)).count() == 0


def test_a_full_cache_changes_nothing(monkeypatch):
    text = "the same words again and again the same"
    want = P.Pieces.of(P.MODEL).encode(text)
    monkeypatch.setattr(P, "CACHE", 2)
    model = P.Pieces(__import__("public_tokenizers").path(P.MODEL))
    assert model.encode(text) == model.encode(text) == want and len(model.words) == 2
