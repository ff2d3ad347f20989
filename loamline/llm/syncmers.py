"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least of its inner s-mers (by hash) stands first or last. Whether it
is one depends on the k-mer alone, so an edit changes only the anchors it touches. A fingerprint holds all long
anchors of the text, or those of the `size` lowest hashes, each with its position; a text of at most BRIEF code points
gives short ones besides. Two fingerprints are compared by the anchors they share in the same order: the longest chain
of rising positions, as a share of the lowest hashes of both. Both sides of a comparison have one kind: the short anchors
if both texts have them, the long ones otherwise, so a likeness never falls because one text alone passes BRIEF.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

SIZE, BRIEF = 64, 512
#: k, s of the anchors, and of the shorter ones of brief texts.
LONG, SHORT = (24, 8), (8, 4)
BLOCK = 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(h: np.ndarray, have: int, n: int) -> np.ndarray:
    """Hashes of runs of n from hashes of runs of `have`, which divides n."""
    step = np.uint64(pow(int(_B), have, 1 << 64))
    out = h[: len(h) - (n - have)]
    for i in range(have, n, have):
        out = out * step + h[i : len(h) - (n - have) + i]
    return out


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of n."""
    have = 1
    while have * 2 <= n:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (n - have)], h[n - have :]) if n > have else h


def closed(codes: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of the closed syncmers among code points (k a multiple of s, s of 4)."""
    if len(codes) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    base = _rolled(_rolled(codes * _B, 1, 2), 2, 4)
    inner = base if s == 4 else _rolled(base, 4, s)
    order, w = _mixed(inner), k - s + 1
    low = _least(order, w)
    at = np.flatnonzero((order[: len(low)] == low) | (order[w - 1 :] == low))
    whole = inner[at]
    step = np.uint64(pow(int(_B), s, 1 << 64))
    for i in range(s, k, s):
        whole = whole * step + inner[at + i]
    return at, (_mixed(whole ^ np.uint64(k)) >> np.uint64(32)).astype(np.uint32)


def _anchors(codes: np.ndarray, k: int, s: int, size: int | None) -> str:
    h, position = np.empty(0, np.uint32), np.empty(0, np.int64)
    for at in range(0, max(1, len(codes) - k + 1), BLOCK):
        place, more = closed(codes[at : at + BLOCK + k - 1], k, s)
        h, first = np.unique(np.concatenate([h, more]), return_index=True)
        h, position = h[:size], np.concatenate([position, place + at])[first][:size]
    return np.stack([h.astype(">u4"), position.astype(">u4")], axis=1).tobytes().hex()


def fingerprint(text: str, size: int | None = SIZE) -> str:
    """Hash and position of each long anchor, 8 hexadecimal digits each, by rising hash; of repeated anchors the first.
    A text of at most BRIEF code points has a dot and its short anchors after them (of less than 8 code points: its own
    hash). Empty for an empty text. size: how many of each at most; None for all, without which a passage leaves no trace
    in a long text."""
    if not text:
        return ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    long = _anchors(codes, *LONG, size)
    if len(codes) > BRIEF:
        return long
    short = _anchors(codes, *SHORT, size) if len(codes) >= SHORT[0] else hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:8] + "0" * 8
    return f"{long}.{short}"


def anchors(part: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(bytes.fromhex(part), ">u4").reshape(-1, 2)
    return pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)


def likeness(a: str, b: str, size: int | None = SIZE) -> float:
    """0 to 1: the share of the two texts' content that is common and in the same order, as 2 J / (1 + J) of the
    Jaccard similarity of their anchors, estimated where size limits the fingerprints; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    part = -1 if "." in a and "." in b else 0
    (ha, pa_), (hb, pb) = (anchors(x.split(".")[part]) for x in (a, b))
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    union = np.union1d(ha, hb)[:size]
    inside = ha[i] <= union[-1]
    tails: list[int] = []
    for p in pb[j[inside]][np.argsort(pa_[i[inside]], kind="stable")].tolist():
        t = bisect_left(tails, p)
        tails[t : t + 1] = [p]
    jaccard = len(tails) / len(union)
    return 2 * jaccard / (1 + jaccard)


def _with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows (bucket, extra, id, text) so that a partition sorted by them has after each document the next one by
    descending id: the documents in ranges of ids, each range followed by the first document of the range after it."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    ranges = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda x: x > F.col("id"))) if cuts else F.lit(0)
    # null ids are ordered by their texts' hashes alone, so their rows go to ranges of these
    bucket = F.when(F.col("id").isNull(), len(cuts) + 1 + 7 - F.shiftright("tie", 60)).otherwise(ranges)
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie")).withColumn("bucket", bucket.cast("int"))
    heads = sorted(tuple(r) for r in d.groupBy("bucket").agg(F.max(F.struct("id", "tie")).alias("h")).select("bucket", "h.id", "h.tie").collect())  # one row for each range
    before = [(b, i, t, heads[n - 1][0]) for n, (b, i, t) in enumerate(heads)]
    h = spark.createDataFrame(before, "b int, i long, t long, before int")
    d = d.join(F.broadcast(h), (F.col("bucket") == F.col("b")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct("bucket", F.lit(0).alias("extra")))).otherwise(F.array(F.struct("bucket", F.lit(0).alias("extra")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("extra"))))
    d = d.withColumn("p", F.explode(places)).select("p.bucket", "p.extra", "id", "text", "tie")
    return d, len(cuts) + 17


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int | None = SIZE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of docs.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document by descending id, after the last the first. Null texts are empty. Rows with a null id come last; rows that
    share an id are ordered by a hash of the text; equal rows follow each other. A single document is its own next. Ids
    are integers; further columns are not looked at; an empty table gives an empty one. size: as of `fingerprint`."""
    rows, parts = _with_next(docs, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def compared(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in stream:
            for bucket, extra, id_, text in zip(*(batch.column(i) for i in range(4))):
                bucket, extra, id_, text = bucket.as_py(), extra.as_py(), id_.as_py(), text.as_py()
                print_ = fingerprint(text, size)
                if held is not None and held[0] == bucket and not held[1]:
                    _, _, own_id, own, own_print = held
                    cut = len(own) // 3
                    edited = own[: len(own) - cut] + text[:cut]
                    edited_print = own_print if edited == own else fingerprint(edited, size)
                    sha = hashlib.sha256(edited.encode()).hexdigest()
                    yield own_id, len(own), sha, own_print, edited_print, likeness(own_print, edited_print, size), likeness(own_print, print_, size)
                held = (bucket, extra, id_, text, print_)

    run = lambda stream: batches(compared(stream), schema, 256)
    order = ["bucket", "extra", F.col("id").desc_nulls_last(), F.col("tie").desc()]
    return rows.repartitionById(parts, F.col("bucket")).sortWithinPartitions(*order).drop("tie").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
