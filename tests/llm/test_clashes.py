"""Columns whose names meet those of the operators keep their names and values."""

from pyspark.sql import functions as F

from loamline.llm import mixing, simhash, stages

WORDS = "the quick brown fox jumps over a lazy dog and runs far away from the old barn near the river"
NAMES = ["doc", "tie", "_doc", "_tie", "_ix", "_upto", "_source", "_shard", "_digest", "_blocks", "ix", "shard", "of", "own", "words", "digest", "cls", "a.b"]


def docs(spark, *names):
    rows = [(i, f"{WORDS} number {i % 7} {WORDS if i % 2 else ''}\nline {i}", "en", "ab"[i % 2], 5) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})


def same(before, after, names):
    was = {r["doc_id"]: r.asDict() for r in before.collect()}
    for r in after.collect():
        assert all(r[n] == was[r["doc_id"]][n] for n in names)


def test_mixing(spark):
    d = docs(spark, *NAMES, "mix_size")
    m = mixing.mixed(d)
    assert m.columns == [*(c for c in d.columns if c != "mix_size"), *mixing.RESULTS] and m.count() == 40
    same(d, m, NAMES)
    plain = mixing.mixed(docs(spark)).select("doc_id", *mixing.RESULTS)
    assert sorted(map(tuple, m.select("doc_id", *mixing.RESULTS).collect())) == sorted(map(tuple, plain.collect()))
    t = mixing.mixed_texts(d)
    assert t.columns == d.columns
    same(d, t, [*NAMES, "mix_size"])
    assert sorted(map(tuple, t.select("doc_id", "text").collect())) == sorted(map(tuple, mixing.mixed_texts(docs(spark)).select("doc_id", "text").collect()))


def test_near_duplicates(spark):
    d = docs(spark, *NAMES)
    kept = simhash.deduplicated(d)
    assert kept.columns == d.columns and 0 < kept.count() < 40
    same(d, kept, NAMES)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in simhash.deduplicated(docs(spark)).collect()}


def test_line_stage(spark):
    names = [*NAMES, "dedup_n_lines", "dedup_n_removed", "_own_x"]
    d = docs(spark, *names)
    kept = stages.lines(spark, d, "")
    assert kept.columns == d.columns and kept.count() > 0
    same(d, kept, names)


def test_language_stage(spark):
    names = [*NAMES, "_id_lang_pred", "_id_score"]
    d = docs(spark, *names)
    kept = stages.language(spark, d, "")
    assert kept.columns == d.columns and kept.count() > 0
    same(d, kept, names)
