"""SimHash near-duplicates with BK-trees.

A document's fingerprint is the bitwise majority of the XXH64 of its word shingles. Copies collapse to one row per
distinct fingerprint. Two fingerprints that differ in at most r of 64 bits agree on at least b - r of b bit blocks, so
the distinct fingerprints are dealt to shards, one for each choice of b - r blocks and their value; no link crosses all
shards. Each shard holds BK-trees (a child hangs from its parent by their Hamming distance) of at most TREE nodes; a
query at distance d from a node follows only the edges d - r to d + r. A larger shard has several trees, and each tree
is sent to all query blocks of its shard. The trees go there by shuffle: what a driver-side broadcast would hold grows
with the corpus. A task reduces the links of its trees to a spanning forest, so copies never become all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, extended, grouped, local_labels, packed, unpacked, written

SEED, TREE = 42, 2048
#: Expected rows of a shard beyond which one more block is cut.
SHARD = 256


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of width words (ASCII white space parts words, A-Z are lower-cased), repeats included; of
    the whole sequence if it is shorter; none without words."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, as a signed integer; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id_col, fp long) per row. A null or empty text, or one of white space only, has fingerprint zero."""
    schema = extended(docs.select(id_col), "fp long")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            fp = [majority(shingle_hashes(x.as_py(), width)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def bk_forest(fp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees over rows of distinct uint64; first: the row of each row's tree root. Returns the children as
    sorted keys (parent * 65 + distance) and the child of each key."""
    parent, edge = first.copy(), np.zeros(len(fp), np.int64)
    todo = np.flatnonzero(first != np.arange(len(fp)))
    slots, kids = [], []
    while len(todo):
        edge = np.bitwise_count(fp[todo] ^ fp[parent[todo]]).astype(np.int64)
        slot = parent[todo] * 65 + edge
        keys, at, inverse = np.unique(slot, return_index=True, return_inverse=True)
        child = todo[at]
        slots.append(keys)
        kids.append(child)
        parent[todo] = child[inverse]
        todo = todo[child[inverse] != todo]
    if not slots:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    slots, kids = np.concatenate(slots), np.concatenate(kids)
    order = np.argsort(slots, kind="stable")
    return slots[order], kids[order]


def bk_search(fp: np.ndarray, forest: tuple[np.ndarray, np.ndarray], query: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (query row, tree row) within the radius, level by level; query: rows that ask, root: the tree each asks."""
    slots, kids = forest
    at = root
    while len(query):
        d = np.bitwise_count(fp[query] ^ fp[at]).astype(np.int64)
        hit = d <= radius
        yield query[hit], at[hit]
        low = np.searchsorted(slots, at * 65 + np.maximum(d - radius, 0))
        high = np.searchsorted(slots, at * 65 + np.minimum(d + radius, 64), side="right")
        n = high - low
        query = np.repeat(query, n)
        at = kids[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(query))]


def shard_keys(fp, radius: int, n: int) -> list:
    """One column for each shard a fingerprint belongs to: a choice of blocks and their bits. n: distinct
    fingerprints, from which the number of blocks follows."""
    blocks = radius + 1
    while n / 2 ** (64 * (blocks - radius) / blocks) > SHARD and blocks < radius + 4:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for c, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(c), F.col(fp).bitwiseAND(F.lit(mask).cast("long"))))
    return keys


def dealt(keyed: DataFrame, member: str) -> DataFrame:
    """keyed (k and further columns) as rows with shard, asks and in_tree, each shard of bounded size: a large k is cut
    into pieces by the member column, and each two pieces meet in a shard of their own, where one is the tree and the
    other asks."""
    large = keyed.groupBy("k").count().where(F.col("count") > TREE).select("k", F.ceil(F.col("count") / TREE).cast("int").alias("pieces"))
    cut = keyed.join(large, "k", "left").withColumn("own", F.pmod(F.xxhash64(member), F.coalesce("pieces", F.lit(1))).cast("int"))
    met = cut.withColumn("other", F.explode(F.expr("sequence(0, coalesce(pieces, 1) - 1)")))
    a, b = F.least("own", "other"), F.greatest("own", "other")
    rest = [c for c in keyed.columns if c != "k"]
    return met.select(F.xxhash64("k", a, b).alias("shard"), *rest, (F.col("own") == b).alias("asks"), (F.col("own") == a).alias("in_tree"))


def near_pairs(t: pa.Table, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius in a table of whole shards (shard, fp, asks, in_tree): a BK-tree for each shard."""
    shard, fp = t.column("shard").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
    asks, tree = (t.column(x).to_numpy(zero_copy_only=False) for x in ("asks", "in_tree"))
    _, number = np.unique(shard, return_inverse=True)
    nodes = np.flatnonzero(tree)
    root = np.full(number.max() + 1, len(fp))
    np.minimum.at(root, number[nodes], nodes)
    first = np.arange(len(fp))
    first[nodes] = root[number[nodes]]
    forest = bk_forest(fp, first)
    query = np.flatnonzero(asks & (root[number] < len(fp)))
    for some in np.array_split(query, max(1, len(query) // 4096)):
        yield from bk_search(fp, forest, some, root[number[some]], radius)


def parity(each: np.ndarray) -> bytes:
    """512 bits: the parity of the distinct hashes in each 512th. What two sets share cancels out, so their bits differ in
    no more places than the sets do in elements."""
    odd = np.bincount((each >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def similar_pairs(t: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in a table of whole shards (shard, n, sig, asks, in_tree) whose set sizes n and parities allow that
    Jaccard similarity: all that have it are among them, however far apart their fingerprints are."""
    shard, n = t.column("shard").to_numpy(), t.column("n").to_numpy()
    asks, tree = (t.column(x).to_numpy(zero_copy_only=False) for x in ("asks", "in_tree"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(-1, 8)
    order = np.lexsort((n, shard))
    rows, d = np.arange(len(order)), 1
    while True:
        rows = rows[rows + d < len(order)]
        # sizes rise, so a row whose partner is too large has no further one
        rows = rows[(shard[order[rows]] == shard[order[rows + d]]) & (n[order[rows]] >= similarity * n[order[rows + d]] - 1e-9)]
        if not len(rows):
            return
        a, b = order[rows], order[rows + d]
        meet = (asks[a] & tree[b]) | (asks[b] & tree[a])
        a, b = a[meet], b[meet]
        both = n[a] + n[b]
        slack = both - 2 * np.ceil(similarity / (1 + similarity) * both - 1e-9).astype(np.int64)
        near = np.bitwise_count(sig[a] ^ sig[b]).sum(axis=1, dtype=np.int64) <= slack
        yield a[near], b[near]
        d += 1


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (src, dst) that connect exactly those of the distinct fingerprints that a chain of links of at most radius
    differing bits connects: a spanning forest of each shard."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(stream, "shard", 20_000):
            fp = t.column("fp").to_numpy()
            lab = np.arange(len(fp))
            for a, b in near_pairs(t, radius):
                lab = local_labels(len(fp), a, b, lab)
            own = lab != np.arange(len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[lab[own]])], schema=schema)

    n = distinct.count()
    keyed = distinct.select("fp", F.explode(F.array(*shard_keys("fp", radius, n))).alias("k"))
    return dealt(keyed, "fp").repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "src long, dst long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(id_col, fp, component_id) per row of docs: component_id is the smallest id among all documents that links of
    at most radius differing fingerprint bits connect with it, itself included.

    Texts that are null, empty or white space have fingerprint zero and link like any other. Repeated rows stay, each
    with its result. A row whose id is null keeps its fingerprint and never names a component; where no id is there, the
    component is null. An empty table gives an empty one; further columns are not looked at."""
    prints = written(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = prints.groupBy("fp").agg(F.min(id_col).alias("low"))
    joined = components(links(distinct.select("fp"), radius))
    classes = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    named = classes.select("fp", "component").join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def _sketches(docs: DataFrame, width: int, keys: int) -> DataFrame:
    """(doc, tie, cls, fp, n, sig, mins) of docs (doc, tie, text), all by the set of shingles: a hash, the fingerprint,
    the size, the parity, and for each of `keys` permutations the least shingle hash."""
    odd = np.random.default_rng(SEED).integers(1, 1 << 63, keys, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for text in batch.column(2):
                each = np.unique(shingle_hashes(text.as_py(), width))
                cls = np.add.reduce(mixed(each)) + np.uint64(len(each))
                mins = [int(mixed(each * k).min().view(np.int64)) for k in odd] if len(each) else []
                rows.append((int(cls.view(np.int64)), majority(each), len(each), parity(each), mins))
            c, fp, n, sig, mins = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c, pa.int64()), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(mins, pa.list_(pa.int64()))], names=["doc", "tie", "cls", "fp", "n", "sig", "mins"])

    return docs.mapInArrow(run, "doc long, tie long, cls long, fp long, n long, sig binary, mins array<long>")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 20, keys: int = 8) -> DataFrame:
    """docs with one document of each group of near-duplicates: the one with the smallest id. Documents are linked if
    the sets of their `width`-word shingles have Jaccard similarity of at least `similarity`, and groups are what links
    connect.

    Pairs are found by BK-trees over SimHash fingerprints of the sets; a radius as wide as such pairs are apart would
    reach most of a bit-block shard, so here a shard holds the documents that share the least shingle hash of one of
    `keys` permutations (a pair at 0.8 misses all eight in 3 of a million cases). No radius bounds how far apart such
    pairs are, least of all short ones, so each shard also gives the pairs beyond it that sizes and parities allow. The
    pairs found are verified on the shingles themselves, up to a spanning forest of each shard.

    Texts that are null, empty or white space are each other's copies. Null ids come last; rows equal in id and text are
    one document, and stay or go together. Columns of docs stay as they are, whatever their names."""
    last = (1 << 63) - 1
    doc, tie = F.coalesce(F.col(id_col).cast("long"), F.lit(last)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    source = docs.select(doc.alias("doc"), tie.alias("tie"), F.col(text_col).alias("text"))
    prints = written(_sketches(source, width, keys), "sketches")
    classes = written(prints.groupBy("cls").agg(F.min(F.struct("doc", "tie", "fp", "n", "sig", "mins")).alias("f")).select("cls", "f.*"), "classes")
    keyed = classes.select("cls", "fp", "n", "sig", F.posexplode("mins").alias("i", "m")).select("cls", "fp", "n", "sig", F.xxhash64("i", "m").alias("k"))
    rows = dealt(keyed, "cls")

    def involved(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(stream, "shard", 20_000):
            found = np.zeros(t.num_rows, bool)
            for a, b in chain(near_pairs(t, radius), similar_pairs(t, similarity)):
                found[a[a != b]] = found[b[a != b]] = True
            yield from t.filter(pa.array(found)).combine_chunks().to_batches()

    pairs = written(rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(involved, rows.schema), "pairs")
    need = classes.select("cls", "doc", "tie").join(pairs.select("cls").distinct(), "cls", "left_semi")
    texts = source.join(need, ["doc", "tie"]).select("cls", "text").dropDuplicates(["cls"])

    def shingled(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for cls, text in zip(b.column(0), b.column(1)):
                each = np.unique(shingle_hashes(text.as_py(), width)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([cls.as_py()], pa.int64()), pa.array([each], pa.list_(pa.int64()))], names=["cls", "shingles"])

    sets = texts.mapInArrow(shingled, "cls long, shingles array<long>")

    def verified(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(stream, "shard", 2_000):
            lab, cls, column, got, edges = np.arange(t.num_rows), t.column("cls").to_numpy(), t.column("shingles"), {}, []
            for a, b in chain(near_pairs(t, radius), similar_pairs(t, similarity)):
                apart = lab[a] != lab[b]
                for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                    if lab[x] == lab[y]:
                        continue
                    for r in (x, y):
                        if r not in got:
                            got[r] = np.array(column[r].values)
                    both = len(np.intersect1d(got[x], got[y], assume_unique=True))
                    if both >= similarity * (len(got[x]) + len(got[y]) - both) - 1e-9:
                        lab[lab == max(lab[x], lab[y])] = min(lab[x], lab[y])
                        edges.append((cls[x], cls[y]))
            if edges:
                src, dst = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    checked = pairs.join(sets, "cls")
    joined = components(checked.repartition("shard").sortWithinPartitions("shard").mapInArrow(verified, "src long, dst long"))
    named = classes.select("cls", "doc", "tie").join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    stays = named.groupBy("component").agg(F.min(F.struct("doc", "tie")).alias("first"))
    stays = written(named.join(stays, "component").select("cls", "first"), "stays")
    gone = prints.join(stays, "cls").where(F.col("first") != F.struct("doc", "tie")).select("doc", "tie").distinct()
    return docs.select(packed(docs), doc.alias("doc"), tie.alias("tie")).join(gone, ["doc", "tie"], "left_anti").select(*unpacked(docs))


def hex16(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
