"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Lines with equal sets collapse to one class, whose first occurrence stands for it. The
tokens of a class are ordered by rarity (how many lines hold them, in BUCKETS buckets of token hashes). Two sets of
Jaccard similarity t or more share a token among the first n - ceil(t n) + 1 of each, so classes meet in blocks of one
prefix token, in order of size. There the length filter, the positional filter (what is left after
the shared token must reach the overlap) and a bitmap filter (differing bits bound differing tokens) leave few pairs,
whose members' token sets are then fetched and verified. What matches an earlier line is removed. Blocks of common
tokens are cut into pieces that meet two by two, and no pair leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, grouped, local_labels, written

SIMILARITY, LEAST = 0.8, 5
BUCKETS, CHUNK, PIECE, BITMAP, LONG = 1 << 20, 1 << 12, 4096, 1 << 26, 96
WIDE = ("w0", "w1", "w2", "w3")
LAST = (1 << 63) - 1
COUNTS = ("dedup_n_lines", "dedup_n_removed")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: ASCII white space; what a byte counts; powers of an odd number by place, and their inverses.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTE, TURN, SHORT = _mixed(np.arange(1, 257, dtype=np.uint64)), 1 << 16, 64
POWER, UNDO = (np.multiply.accumulate(np.full(TURN, x % (1 << 64), np.uint64)) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes start, and their 64-bit hashes: polynomials of their bytes, or xxHash for the longest.
    A polynomial is a difference of running sums, made in turns of TURN bytes."""
    space = np.concatenate([[True], SPACE[data], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    h = np.empty(len(start), np.uint64)
    turns = np.searchsorted(start, np.arange(0, len(data) + TURN, TURN))
    for turn, (low, high) in enumerate(zip(turns[:-1].tolist(), turns[1:].tolist())):
        if low == high:
            continue
        at = turn * TURN
        part = BYTE[data[at : at + TURN]]
        part *= POWER[: len(part)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
        s, e = start[low:high] - at, end[low:high] - at
        h[low:high] = (sums[np.minimum(e, len(part))] - sums[s]) * UNDO[s]
        if e[-1] > TURN:  # the last word goes on in the next turn
            word = BYTE[data[start[high - 1] : end[high - 1]][:SHORT]]
            h[high - 1 : high] = (word * POWER[: len(word)]).sum(keepdims=True) * UNDO[:1]
    h = _mixed(h + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > SHORT).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return start, h


class Lines:
    """The lines of some texts that have at least `least` distinct words (ASCII white space parts words; a line ends at
    a line feed): owner, number, size n, and the 64-bit hashes of the words, line after line."""

    def __init__(self, texts: list[str | None], least: int):
        coded = [(t or "").encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"\n".join(coded), np.uint8)
        feeds = data == 10
        start, h = words(data)
        line = np.cumsum(feeds, dtype=np.int32)[start].astype(np.uint64)  # numbered through all texts
        order = np.argsort((line << np.uint64(44)) | (h >> np.uint64(20)))
        line, h = line[order], h[order]
        same = (line[1:] == line[:-1]) & (h[1:] >> np.uint64(20) == h[:-1] >> np.uint64(20))
        if (len(line) and line[-1] >> np.uint64(20)) or (same & (h[1:] != h[:-1])).any():  # the key is too short to tell all apart
            order = np.lexsort((h, line))
            line, h = line[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
        line, h = line[new].astype(np.int64), h[new]
        n = np.bincount(line)
        kept = np.flatnonzero(n >= least)
        ends = np.cumsum([t.count(b"\n") + 1 for t in coded])
        self.owner = np.searchsorted(ends, kept, "right")
        self.number = kept - np.concatenate([[0], ends])[self.owner]
        self.n, self.h = n[kept], h[n[line] >= least]
        self.start = np.cumsum(self.n) - self.n
        self.line = np.repeat(np.arange(len(self.n)), self.n)

    def classes(self) -> np.ndarray:
        """A 64-bit hash of each line's set."""
        return _mixed(np.add.reduceat(_mixed(self.h), self.start) + self.n.astype(np.uint64)).view(np.int64)

    def bitmaps(self) -> np.ndarray:
        """For each line a bit for each 64th of the hashes: the parity of its tokens there. What two lines share cancels
        out, so their bitmaps differ in no more bits than the lines do in tokens."""
        return np.bitwise_xor.reduceat(np.uint64(1) << (self.h >> np.uint64(58)), self.start).view(np.int64)

    def wide(self) -> list[pa.Array]:
        """Such bitmaps of 256 bits, as four columns, of the lines of more than LONG tokens; null for others."""
        long = self.n > LONG
        where, sizes, out = (self.h[long[self.line]] >> np.uint64(48)) & np.uint64(255), self.n[long], []
        for k in range(4):
            found = np.zeros(len(self.n), np.int64)
            if len(sizes):
                bits = np.where(where >> np.uint64(6) == k, np.uint64(1) << (where & np.uint64(63)), np.uint64(0))
                found[long] = np.bitwise_xor.reduceat(bits, np.cumsum(sizes) - sizes).view(np.int64)
            out.append(pa.array(found, mask=~long))
        return out

    def prefixes(self, rank: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        """The low 32 bits of the rarest tokens of each line, in order of rarity, and their offsets."""
        place = rank[(self.h & np.uint64(BUCKETS - 1)).astype(np.int64)]
        key = (self.line.astype(np.uint64) << np.uint64(44)) | (place.astype(np.uint64) << np.uint64(24)) | (self.h >> np.uint64(40))
        order = np.argsort(key)
        if len(self.n) >= 1 << 20 or (np.diff(key[order]) == 0).any():  # the key is too short to tell all apart
            order = np.lexsort((self.h, place, self.line))
        place = np.arange(len(order)) - self.start[self.line]
        size = self.n - np.ceil(t * self.n - 1e-9).astype(np.int64) + 1
        kept = order[place < size[self.line]]
        return self.h[kept], np.concatenate([[0], np.cumsum(size)])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))


def token_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often words of each bucket occur: tasks send the counts of each CHUNK buckets as one row, and others add them."""

    def counted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for whole in stream:
            for low in range(0, whole.num_rows, 256):
                coded = b"\n".join((t or "").encode("utf-8", "replace") for t in whole.column(0).slice(low, 256).to_pylist())
                counts += np.bincount((words(np.frombuffer(coded, np.uint8))[1] & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        found = np.flatnonzero(counts.reshape(-1, CHUNK).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([counts[i * CHUNK : (i + 1) * CHUNK].tobytes() for i in found.tolist()], pa.binary())], names=["chunk", "n"])

    def added(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in stream:
            for chunk, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(n.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n.tobytes() for n in sums.values()], pa.binary())], names=["chunk", "n"])

    parts = docs.select(text_col).mapInArrow(counted, "chunk int, n binary").repartition("chunk")
    counts = np.zeros(BUCKETS, np.int64)
    for chunk, n in parts.mapInArrow(added, "chunk int, n binary").collect():  # BUCKETS numbers, whatever the input
        counts[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(n, np.int64)
    return counts


def _lines(source: DataFrame, counts: np.ndarray, t: float, least: int) -> DataFrame:
    rank = np.empty(BUCKETS, np.int32)
    rank[np.lexsort((np.arange(BUCKETS), counts))] = np.arange(BUCKETS)
    common = counts >= PIECE  # no fewer than the lines that hold such a word

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                lines = Lines(batch.column(2).to_pylist(), least)
                if not len(lines.n):
                    continue
                tokens, offsets = lines.prefixes(rank, t)
                hot = common[(tokens & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.int64) << 32
                where = pa.array(lines.owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(where), batch.column(1).take(where), pa.array(lines.number, pa.int32()), pa.array(lines.classes()), pa.array(lines.n, pa.int32()), pa.array(lines.bitmaps()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((tokens & np.uint64(0xFFFFFFFF)).view(np.int64) | hot)), *lines.wide()],
                    names=["doc", "tie", "line", "cls", "n", "sig", "prefix", *WIDE],
                )

    return source.mapInArrow(run, "doc long, tie long, line int, cls long, n int, sig long, prefix array<long>, w0 long, w1 long, w2 long, w3 long")


def _blocks(classes: DataFrame, t: float) -> DataFrame:
    """Rows (key, id, pos, sig): a class in each block of a prefix token. key holds shard and size, in one column that
    sorts fast; pos holds position and side: 2 meets all of its shard; 0 and 1, the pieces of a large block, meet each
    other. Shards whose hashes collide only share a few more pairs that the filters see."""
    p = classes.select("id", "n", "sig", F.posexplode("prefix").alias("i", "x"))
    bucket = F.col("x").bitwiseAND(BUCKETS - 1).cast("int")
    large = p.where(F.col("x") >= 1 << 32).groupBy(bucket.alias("bucket")).count().where(F.col("count") > PIECE)
    large = F.broadcast(large.select("bucket", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces")))  # at most BUCKETS rows
    p = p.join(large, bucket == F.col("bucket"), "left").withColumn("own", F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))).cast("int"))
    p = p.withColumn("prefix", F.col("x").bitwiseAND((1 << 32) - 1)).withColumn("other", F.explode(F.expr("sequence(0, coalesce(pieces, 1) - 1)")))
    a, b = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(a == b, 2).when(F.col("own") == a, 0).otherwise(1)
    shard = F.when(F.col("pieces").isNull(), F.col("prefix")).otherwise(F.hash("prefix", a, b).cast("long"))
    key = F.shiftleft(shard, 32) + F.col("n")
    return p.select(key.alias("key"), "id", (F.shiftleft(F.col("i").cast("long"), 2) + side).alias("pos"), "sig")


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    c = {k: t.column(k).to_numpy() for k in ("shard", "id", "sig", "meta")}
    c["sig"] = c["sig"].view(np.uint64)
    c |= {k: t.column(k).fill_null(0).to_numpy().view(np.uint64) for k in WIDE if k in t.column_names}
    return c | {"n": c["meta"] >> 32, "i": (c["meta"] >> 2) & ((1 << 30) - 1), "side": c["meta"] & 3}


def candidates(c: dict[str, np.ndarray], t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one shard (sorted by shard and size) that pass the length, positional and bitmap filters."""
    rows, d = np.arange(len(c["shard"])), 1
    while True:
        rows = rows[rows + d < len(c["shard"])]
        # sizes rise, so a row whose partner is too long has no further one
        rows = rows[(c["shard"][rows] == c["shard"][rows + d]) & (c["n"][rows] >= t * c["n"][rows + d] - 1e-9)]
        if not len(rows):
            return
        x, y = rows, rows + d
        both = c["n"][x] + c["n"][y]
        need = np.ceil(t / (1 + t) * both - 1e-9).astype(np.int64)
        ok = np.minimum(c["n"][x] - c["i"][x], c["n"][y] - c["i"][y]) >= need
        sides = c["side"][x] + c["side"][y]
        ok &= ((sides == 4) | ((sides == 1) & (c["side"][x] != 2) & (c["side"][y] != 2))) & (c["id"][x] != c["id"][y])
        x, y, slack = x[ok], y[ok], (both - 2 * need)[ok]
        near = np.bitwise_count(c["sig"][x] ^ c["sig"][y]) <= slack
        if "w0" in c:
            far = sum(np.bitwise_count(c[k][x] ^ c[k][y]).astype(np.int64) for k in WIDE)
            near &= (far <= slack) | (c["n"][x] <= LONG) | (c["n"][y] <= LONG)
        yield x[near], y[near]
        d += 1


def _involved(blocks: DataFrame, t: float) -> DataFrame:
    """Rows (shard, id, meta, sig) of the classes that are in a candidate pair; here a shard is a cluster of pairs within a
    shard of _blocks, called by a hash of its members and their sides. So it is never larger than that one, and where it
    comes out of several blocks, once remains."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(stream, "shard", 50_000):
            c = _columns(table)
            lab, held, many = np.arange(len(c["shard"])), [], 0
            for pair in candidates(c, t):
                held.append(pair)
                many += len(pair[0])
                if many > 1 << 20:
                    lab, held, many = local_labels(len(lab), *map(np.concatenate, zip(*held)), lab), [], 0
            if many:
                lab = local_labels(len(lab), *map(np.concatenate, zip(*held)), lab)
            found = np.flatnonzero(np.bincount(lab, minlength=len(lab))[lab] > 1)
            if not len(found):
                continue
            rows = np.unique(np.stack([lab[found], c["id"][found], (c["n"][found] << 32) + c["side"][found], c["sig"][found].view(np.int64)], axis=1), axis=0)
            cluster = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
            member = _mixed(_mixed(rows[:, 1].astype(np.uint64)) + rows[:, 2].astype(np.uint64))
            name = _mixed(np.add.reduceat(member, cluster)).view(np.int64)
            rows[:, 0] = np.repeat(name, np.diff(cluster, append=len(rows)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows.T.copy()], names=["shard", "id", "meta", "sig"])

    shard, size = F.shiftright("key", 32), F.col("key").bitwiseAND((1 << 32) - 1)
    rows = blocks.repartition(shard).sortWithinPartitions("key").select(shard.alias("shard"), "id", (F.shiftleft(size, 32) + F.col("pos")).alias("meta"), "sig")
    found = rows.mapInArrow(run, "shard long, id long, meta long, sig long")
    return found.distinct()


def _refined(involved: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    """The rows of involved that are still in a candidate pair when the wide bitmaps of long lines are compared too."""
    rows = involved.join(classes.where("w0 is not null").select("id", *WIDE), "id", "left").select("shard", "id", "meta", "sig", *WIDE)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(stream, "shard", 50_000):
            found = np.zeros(table.num_rows, bool)
            for x, y in candidates(_columns(table), t):
                found[x] = found[y] = True
            yield from table.select(["shard", "id", "meta", "sig"]).filter(pa.array(found)).combine_chunks().to_batches()

    return rows.repartition("shard").sortWithinPartitions("shard", "meta").mapInArrow(run, involved.schema)


def _places(doc: np.ndarray, tie: np.ndarray, line: np.ndarray) -> np.ndarray:
    x = _mixed(doc.astype(np.int64).view(np.uint64) ^ _mixed(tie.astype(np.int64).view(np.uint64)) ^ _mixed(line.astype(np.uint64)))
    return (x & np.uint64(BITMAP - 1)).astype(np.int64)


def _tokens(source: DataFrame, need: DataFrame, least: int) -> DataFrame:
    """(id, doc, tie, line, tokens) of the lines of need (id, doc, tie, line). The documents are read once more; a
    bitmap of fixed size tells which lines may be wanted, and the join which are."""

    def mark(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            at = _places(*(b.column(i).to_numpy() for i in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6, pa.int32()), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    marked = need.mapInArrow(mark, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP >> 6, np.int64)
    bitmap[marked.column(0).to_numpy()] = marked.column(1).to_numpy()
    shared = source.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8).tobytes())

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint64)
        for whole in stream:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                docs, ties, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
                n = np.array([(t or "").count("\n") + 1 for t in texts])
                owner, line = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = _places(docs[owner], ties[owner], line)
                hit = np.flatnonzero(bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
                out, split, last = [], [], -1
                for i, k in zip(owner[hit].tolist(), line[hit].tolist()):
                    if i != last:
                        split, last = (texts[i] or "").encode("utf-8", "replace").split(b"\n"), i
                    tokens = np.unique(words(np.frombuffer(split[k], np.uint8))[1])
                    if len(tokens) >= least:
                        out.append((docs[i], ties[i], k, tokens.view(np.int64)))
                if out:
                    d, e, k, tokens = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(e, pa.int64()), pa.array(k, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], names=["doc", "tie", "line", "tokens"])

    return source.mapInArrow(run, "doc long, tie long, line int, tokens array<long>").dropDuplicates(["doc", "tie", "line"]).join(need, ["doc", "tie", "line"])


def _matched(rows: DataFrame, t: float) -> DataFrame:
    """Classes of rows (of candidate pairs, with tokens and place) whose set has Jaccard similarity t or more with that
    of an earlier line."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(stream, "shard", 10_000):
            c = _columns(table)
            order = np.lexsort(tuple(table.column(k).to_numpy() for k in ("line", "tie", "doc")))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            lists, sets, gone = table.column("tokens").combine_chunks(), {}, np.zeros(len(order), bool)
            tokens, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            for xs, ys in candidates(c, t):
                late = np.where(place[xs] > place[ys], xs, ys)
                left = ~gone[late]
                for x, y, z in zip(xs[left].tolist(), ys[left].tolist(), late[left].tolist()):
                    if gone[z]:
                        continue
                    for r in (x, y):
                        if r not in sets:
                            sets[r] = set(tokens[at[r] : at[r + 1]].tolist())
                    both = len(sets[x] & sets[y])
                    if both * (1 + t) >= t * (len(sets[x]) + len(sets[y])) - 1e-9:
                        gone[z] = True
            if gone.any():
                yield pa.RecordBatch.from_arrays([pa.array(c["id"][gone])], names=["id"])

    return rows.repartition("shard").sortWithinPartitions("shard", "meta").mapInArrow(run, "id long").distinct()


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """docs with the text less its removed lines, and n_lines and n_removed in columns prefixed dedup_.

    A line is removed if its set of words has Jaccard similarity of at least `similarity` with that of any line before
    it, by document id (integers; null last, equal ids by a hash of the text) and place. Lines of fewer than `least`
    distinct words stay, blank ones among them. A null text stays null and has no lines. Equal rows share their place
    and so are treated alike. Other columns stay, but columns with the names of the two counts are replaced; an empty
    table gives an empty one. Word and set identity is that of
    64-bit hashes."""
    source = _source(docs, id_col, text_col)
    counts = token_counts(docs, text_col)
    lines = written(_lines(source, counts, similarity, least), "lines")
    first = F.min(F.struct("doc", "tie", "line", "n", "sig", "prefix", *WIDE)).alias("f")
    classes = written(lines.groupBy("cls").agg(first).select("cls", "f.*").withColumn("id", F.monotonically_increasing_id()), "classes")
    involved = written(_involved(_blocks(classes, similarity), similarity), "involved")
    involved = written(_refined(involved, classes, similarity), "involved")
    need = written(involved.select("id").distinct().join(classes.select("id", "doc", "tie", "line"), "id"), "need")
    tokens = written(_tokens(source, need, least), "tokens")
    matched = written(_matched(involved.join(tokens, "id"), similarity), "matched")
    dropped(tokens)
    stay = classes.select("cls", "id", F.struct("doc", "tie", "line").alias("first")).join(matched, "id", "left_anti").drop("id")
    gone = lines.select("doc", "tie", "line", "cls").join(stay, "cls", "left").where(F.col("first").isNull() | (F.col("first") != F.struct("doc", "tie", "line")))
    gone = gone.groupBy("doc", "tie").agg(F.collect_set("line").alias("gone"))
    own = [c for c in docs.columns if c not in (text_col, *COUNTS)]
    doc, tie = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.xxhash64(text_col)
    d = docs.select(F.struct(F.lit(0), *(F.col(f"`{c}`") for c in own)).alias("own"), doc.alias("doc"), tie.alias("tie"), F.col(text_col).alias("text"))
    d = d.join(gone, ["doc", "tie"], "left").withColumn("parts", F.split("text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda k: F.get("parts", k)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("parts")).cast("long")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    columns = [text.alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns if c not in COUNTS]
    return d.select(*columns, *(x.alias(c) for x, c in zip((n_lines, n_removed), COUNTS)))


#: DuckDB SQL for the lines of documents that stay; the prefix filter keeps it short of all pairs.
SQL = r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM a),
s AS MATERIALIZED (SELECT doc_id, k, list_sort(list_distinct(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w FROM l),
c AS MATERIALIZED (SELECT w, len(w) AS n, min((doc_id, k)) AS f FROM s WHERE len(w) >= 5 GROUP BY w),
t AS (SELECT f, n, unnest(w) AS tok FROM c),
q AS (SELECT tok, count(*) AS df FROM t GROUP BY tok),
p AS MATERIALIZED (SELECT f, n, tok, row_number() OVER (PARTITION BY f ORDER BY df, tok) AS i FROM t JOIN q USING (tok) QUALIFY i <= n - ceil(0.8 * n - 1e-9) + 1),
m AS (SELECT DISTINCT x.f AS a, y.f AS b FROM p x JOIN p y ON x.tok = y.tok AND x.f < y.f AND x.n >= 0.8 * y.n - 1e-9 AND y.n >= 0.8 * x.n - 1e-9),
v AS (SELECT DISTINCT m.b FROM m JOIN c x ON x.f = m.a JOIN c y ON y.f = m.b WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)),
g AS (SELECT s.doc_id, s.k FROM s JOIN c ON s.w = c.w WHERE c.f <> (s.doc_id, s.k) OR c.f IN (SELECT b FROM v)),
o AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.k) FILTER (WHERE g.k IS NULL) AS text, count(*)::BIGINT AS n_lines, count(g.k)::BIGINT AS n_removed
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.k = g.k GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(o.text, '') END AS text, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""
