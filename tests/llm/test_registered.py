"""The registered queries themselves, over the smallest test tables, against plain versions of their contracts."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from loamline.llm import registry, tokenfiles
from loamline.llm.common import read

from .test_linededup import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return [r.asDict() for r in read(spark, SF, "documents").orderBy("doc_id").collect()]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_op1(spark, docs):
    def print_(text):
        words = bytes(text.encode()).lower().split()
        runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {d["doc_id"]: print_(d["text"] or "") for d in docs}
    component = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints.items():
            for j, b in prints.items():
                if (a ^ b).bit_count() <= 4 and component[i] > component[j]:
                    component[i], changed = component[j], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op1_simhash(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", component[i]) for i, p in prints.items()}


def test_op3_and_op4(spark, docs):
    labels = {d["doc_id"]: d["lang"] for d in docs}
    got = registry.op3_langid(spark, SF).collect()
    assert len(got) == len(docs) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.held_out and labels[r.doc_id]]
    assert sum(r.lang_pred == labels[r.doc_id] for r in tested) >= 0.9 * len(tested)
    got = registry.op4_toxicity(spark, SF).collect()
    assert len(got) == len(docs) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_op5_and_op9(spark, docs):
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in registry.op5_pieces(spark, SF).collect())
    from tokenizers import Tokenizer

    library, at, want = Tokenizer.from_file(tokenfiles.vocabulary()), 0, []
    for d in docs:
        ids = np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, registry.op9_token_files(spark, SF).collect())) == want


def test_op7_and_op8(spark, docs):
    want = brute([(d["doc_id"], d["text"] or "") for d in docs])
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in registry.op7_line_dedup(spark, SF).collect()} == want
    got = {r.doc_id: r for r in registry.op8_syncmers(spark, SF).collect()}
    for d, after in zip(docs, [docs[-1], *docs]):
        text, r = d["text"] or "", got[d["doc_id"]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + (after["text"] or "")[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest()) and 0 <= r.near_next <= 1
        assert len(text) < 60 or len(edited) < 0.9 * len(text) or r.near_edited > 0.3


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    df = registry.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.SQL[name]})").fetchall()
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert plain(map(tuple, df.collect())) == plain(want)


def test_pipeline(spark, docs):
    got = corpus_pipeline.run(spark, SF).collect()
    assert len({r.doc_id for r in got}) == len(got) and 0.5 * len(docs) < len(got) <= len(docs) and all(r.n_tokens == len(r.ids) for r in got)
