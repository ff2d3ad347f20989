"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's score is a logistic function of the words in it; a document's is the noisy-or of its sentences' scores with
a leak: 1 - (1 - leak) * prod(1 - sentence). Both are trained together from document labels, which makes the sentences
that explain them stand out; those are located. A sentence without any word of the vocabulary scores 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import extended, held_out, written

#: Labelled documents that training may use, their characters in all and of one, words that may have a weight, and
#: documents a word must be in.
SAMPLE, CHARS, LONGEST, WORDS, LEAST = 20_000, 64_000_000, 640_000, 2048, 5
STEPS, RATE, DECAY, BIAS = 300, 0.05, 1e-3, -2.0
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"\w+")


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    leak: float


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and words (lower case) of each sentence."""
    for m in _SENTENCE.finditer(text):
        yield m.start(), m.end(), set(_WORD.findall(m[0].lower()))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, y) of labelled documents outside the held-out fifth, those of lowest hash: at most SAMPLE, none longer
    than LONGEST characters, and CHARS in all, so that what the driver fits is bounded in rows and in text. A document
    labelled more than once counts by its highest label, an id of several texts by the sum of their lengths."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    known = known.withColumn("h", F.xxhash64(F.col("id").cast("string"))).orderBy("h", "id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sized = texts.select("id", F.length("text").cast("long").alias("n")).join(F.broadcast(known), "id").groupBy("id", "y", "h").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.orderBy("h", "id"))  # over SAMPLE rows at most
    taken = sized.where(F.col("n") <= LONGEST).withColumn("total", total).where(F.col("total") <= CHARS)
    return texts.join(F.broadcast(written(taken.select("id", "y"), "labelled")), "id")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Words are chosen by how much likelier they make either label, then sentence weights and leak are fitted by Adam
    on the noisy-or likelihood. Without labelled documents every score is a half less a little."""
    sample = _sample(docs, labels, id_col, text_col, label_col)

    def words(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for text, y in zip(batch.column(1), batch.column(2)):
                found = set(_WORD.findall(text.as_py().lower()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(found)), pa.array([int(y.as_py())] * len(found), pa.int32())], names=["word", "y"])

    totals = sample.agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("pos")).first()
    n, pos = totals[0] or 0, totals[1] or 0
    if not n or pos in (0, n):
        return Model({}, 0.0, min(0.49, max(0.01, pos / n)) if n else 0.49)
    counts = sample.mapInArrow(words, "word string, y int").groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).where(F.col("n") >= LEAST)
    p = F.lit(pos / n)
    gain = (F.col("pos") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    chosen = [r[0] for r in counts.orderBy(F.abs(gain).desc(), "word").limit(WORDS).collect()]
    number = {w: i for i, w in enumerate(sorted(chosen))}

    def bags(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = [[[number[w] for w in sorted(ws) if w in number] for _, _, ws in sentences(t.as_py())] for t in batch.column(1)]
            rows = [[s for s in r if s] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(rows, pa.list_(pa.list_(pa.int32())))], names=["id", "y", "bags"])

    id_type = sample.schema["id"].dataType.simpleString()
    data = sorted(sample.mapInArrow(bags, f"id {id_type}, y int, bags array<array<int>>").collect(), key=lambda r: r[0])
    weights, bias, leak = _fitted([r[2] for r in data], np.array([r[1] for r in data], float), len(number))
    return Model({w: float(weights[i]) for w, i in number.items() if abs(weights[i]) > 1e-3}, float(bias), float(leak))


def _fitted(bags: list[list[list[int]]], y: np.ndarray, size: int) -> tuple[np.ndarray, float, float]:
    words = np.array([w for d in bags for s in d for w in s], np.int64)
    sentence = np.repeat(np.arange(sum(map(len, bags))), [len(s) for d in bags for s in d])
    doc = np.repeat(np.arange(len(bags)), [len(d) for d in bags])
    x = np.zeros(size + 2)  # weights, bias, leak as a logit
    x[size], x[size + 1] = BIAS, -3.0
    first, second = np.zeros_like(x), np.zeros_like(x)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    for step in range(1, STEPS + 1):
        s = sigmoid(np.bincount(sentence, x[words], len(doc)) + x[size])
        leak = sigmoid(x[size + 1])
        miss = np.log1p(-leak) + np.bincount(doc, np.log1p(-np.minimum(s, 1 - 1e-9)), len(y))
        p = np.clip(-np.expm1(miss), 1e-9, 1 - 1e-9)
        outer = y * (1 - p) / p - (1 - y)
        ds = outer[doc] * s
        grad = np.concatenate([np.bincount(words, ds[sentence], size), [ds.sum(), (outer * leak).sum()]]) / len(y)
        grad[:size] -= DECAY / 10 * x[:size]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        x += RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return x[:size], x[size], sigmoid(x[size + 1])


def scored(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "", locate: float = 0.5) -> DataFrame:
    """docs with score (0 to 1; null and empty texts have the leak), predicted (1 if score >= 0.5) and offending, the
    (start, end, score) in characters of the sentences that score `locate` or more, under the prefix given. Columns of
    these names are replaced; every sentence of a whole text counts."""
    names = [f"{prefix}{x}" for x in ("score", "predicted", "offending")]
    kept = docs.drop(*names)
    schema = extended(kept, f"`{names[0]}` double, `{names[1]}` int, `{names[2]}` array<struct<start:int,end:int,score:double>>")
    where = kept.columns.index(text_col)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, get = model.weights.keys(), model.weights.__getitem__
        for batch in stream:
            scores, spans = [], []
            for text in batch.column(where).to_pylist():
                miss, found = 1 - model.leak, []
                for start, end, words in sentences(text or ""):
                    known = vocabulary & words
                    if known:
                        s = float(1 / (1 + np.exp(-min(30.0, max(-30.0, sum(map(get, sorted(known))) + model.bias)))))
                        miss *= 1 - s
                        if s >= locate:
                            found.append({"start": start, "end": end, "score": s})
                scores.append(min(1.0, max(0.0, 1 - miss)))
                spans.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, spans_type)], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)
