import subprocess
import sys

import numpy as np
import pytest

import corpus_pipeline as C
from loamline.llm import langid

from .test_linededup import brute
from .test_models import WORDS
from .test_simhash import S, groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = np.random.default_rng(9)
    rows = []
    for i in range(150):
        lang = list(WORDS)[i % 3]
        vocabulary = [w + str(k) for w in WORDS[lang].split() for k in ("", *"abcdefghijklmnop")]
        rows.append((i, "\n".join(" ".join(rng.choice(vocabulary, 30)) for _ in range(4)), lang, f"s{i % 4}" if i % 2 else "hot", 0))
    copies = [(200 + i, rows[i][1], rows[i][2], "s1", 0) for i in range(10)]
    near = [(300 + i, rows[i][1].replace("\n", " "), rows[i][2], "s2", 0) for i in range(10)]
    return [*rows, *copies, *near, (400, None, "aa", "s1", 0), (401, "", None, None, 0), (402, "12 34", "aa", "s1", 0)]


@pytest.fixture(scope="module")
def stages(spark):
    steps, langid.STEPS = langid.STEPS, 120
    df, out = spark.createDataFrame(documents(), SCHEMA), []
    for name, stage in C.STAGES:
        rows = stage(spark, df, "").collect()
        out.append((name, [tuple(r) for r in df.collect()], rows))
        df = spark.createDataFrame(rows, stage(spark, df, "").schema) if rows else df.limit(0)
    langid.STEPS = steps
    return {name: (before, after) for name, before, after in out}


def test_language_keeps_documents_and_rejects_the_rest(stages):
    before, after = stages["language_id"]
    assert {r.doc_id for r in after} == {r[0] for r in before} - {400, 401, 402}


def test_lines_equal_brute_force(stages):
    before, after = stages["line_dedup"]
    want = brute([(r[0], r[1]) for r in before])
    assert {r.doc_id: r.text for r in after} == {i: t for i, (t, _, gone) in want.items() if t.strip() or not gone}
    assert not {r.doc_id for r in after} & set(range(200, 210)) and all(r.n_chars == len(r.text) for r in after)


def test_near_duplicates_equal_brute_force(stages):
    before, after = stages["simhash_near_dedup"]
    sets = {r[0]: set(S.shingle_hashes(r[1], 5).tolist()) for r in before}
    want = groups(list(sets), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0)
    assert {r.doc_id for r in after} == set(want.values())


def test_mix_and_ids(stages, spark):
    before, after = stages["source_mix"]
    sizes = sum(len(r[1].split()) for r in before)
    assert 1.3 * sizes < sum(len(r.text.split()) for r in after) < 1.6 * sizes
    given, out = stages["piece_encoding"]
    assert len(out) == len(given) and all(r.n_tokens == len(r.ids) > 0 for r in out)


def test_stages_pass_empty_tables_and_the_order_is_the_documented_one(spark):
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "source_mix", "piece_encoding"]
    df = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        assert stage(spark, df, "").count() == 0


def test_nothing_else_imports_the_subpackage():
    code = "import sys; sys.modules['loamline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q), q; print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=C.__file__.rsplit("/", 1)[0])
    assert done.returncode == 0, done.stderr
