"""Token ids of documents in Parquet files made for selective reads.

Each file holds whole documents in ascending id order as (part, doc_id, local_start, n_tokens, ids list<int>). The ids
are dictionary-encoded (a vocabulary fits one dictionary page), the other columns delta-encoded; row groups are small
and carry page indexes, so metadata reads skip the ids and id ranges skip row groups. Spark's own committer writes the
files, so a lost executor leaves no half file behind.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path

TOKENIZER, END = "word_bpe_49k.json", 2
#: Distinct words whose ids a Python worker keeps; others are encoded again when they come.
CACHE = 500_000
ROW_GROUP, PAGE = 16 << 20, 256 << 10
FORMAT = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "compression": "zstd",
}
#: White space as the vocabulary's normaliser sees it (Unicode White_Space); str.split() also parts at U+001C to U+001F.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: How the vocabulary TOKENIZER normalises and parts a text (fixed values of its file), and that pattern for lower-case Latin-1.
_NORMALISER = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
_WIDE, _SPECIAL = re.compile("[^\0-\xff]"), "<|"

_encoders: dict[str, Encoder] = {}


class Words(dict):
    """Numbers of words; a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Ids of texts by the tokenizers library.

    No token of the vocabulary TOKENIZER crosses white space or the parts of its pattern. Lower case and the pattern are
    plain for Latin-1, whose letters do not compose, so there the parts are found here and the library merges each
    distinct one once; a word with another character (or what may be a special token) is encoded whole by the library,
    once too. The ids of distinct words lie one after the other in an array, from which a batch is gathered. A
    vocabulary that normalises or parts otherwise encodes whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        steps = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        special = all(x["content"].startswith(_SPECIAL) for x in parts["added_tokens"])
        self.known = special and kinds == _NORMALISER and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _PATTERN} and steps[0]["invert"]
        if self.known:
            self.merges = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": steps[1], "added_tokens": []}))
            self.last = np.zeros(self.merges.get_vocab_size(), bool)  # letters and signs are never in one part, so only its last token ends so
            self.last[[i for w, i in self.merges.get_vocab().items() if w.endswith(parts["model"]["end_of_word_suffix"])]] = True
        self.words, self.ids, self.ends = Words(), np.empty(0, np.int32), np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if not self.known:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.int32), np.array(list(map(len, found)), np.int64)
        kept, parts = len(self.words), list(map(self._parts, texts))
        n = np.array(list(map(len, parts)), np.int64)
        number = np.fromiter(map(self.words.__getitem__, chain.from_iterable(parts)), np.int64, n.sum())
        if len(self.words) > kept:
            self._add(list(islice(reversed(self.words), len(self.words) - kept))[::-1])
        start, size = self.ends[number], self.ends[number + 1] - self.ends[number]
        last = np.cumsum(size)
        ids = self.ids[np.repeat(start - last + size, size) + np.arange(size.sum())]
        if len(self.words) > CACHE:  # the first words met are kept, the frequent ones among them
            self.ids, self.ends = self.ids[: self.ends[kept]], self.ends[: kept + 1]
            while len(self.words) > kept:
                self.words.popitem()
        return ids, np.diff(np.concatenate([[0], last])[np.concatenate([[0], np.cumsum(n)])])

    @staticmethod
    def _parts(text: str) -> list[str]:
        if _SPECIAL not in text and (text.isascii() or not _WIDE.search(text)):
            return _LATIN.findall(text.lower())
        out: list[str] = []
        for w in _SPACE.split(text):
            if _WIDE.search(w) or _SPECIAL in w:
                out.append(w)
            else:
                out += _LATIN.findall(w.lower())
        return out

    def _add(self, words: list[str]) -> None:
        """Appends the ids of new words."""
        whole = [i for i, w in enumerate(words) if _WIDE.search(w) or _SPECIAL in w]
        others = set(whole)
        found = self.merges.encode_batch_fast([[w for i, w in enumerate(words) if i not in others]], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(found.ids, np.int32)
        size = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        if whole:
            wide = [x.ids for x in self.tokenizer.encode_batch_fast([words[i] for i in whole], add_special_tokens=False)]
            at = np.array(whole) - np.arange(len(whole))  # places among the others
            ids = np.insert(ids, np.repeat(np.concatenate([[0], np.cumsum(size)])[at], list(map(len, wide))), [i for x in wide for i in x])
            size = np.insert(size, at, list(map(len, wide)))
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])


def vocabulary(name: str = TOKENIZER) -> str:
    """A vocabulary file's path, looked up where it is used."""
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END) -> None:
    """Encodes every whole text, appends end_id, and writes the ids to path in ascending id order.

    A null text is empty: its ids are end_id alone. Rows whose id is null come first; rows of one id come by a hash of their texts;
    repeated rows stay. Special tokens' strings in a text become their ids, as the library has it."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([("part", pa.int32()), ("doc_id", docs.select(id_col).limit(0).toArrow().schema.field(0).type), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = Encoder.of(vocabulary(tokenizer)), TaskContext.get().partitionId(), 0
        for whole in stream:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                ids, n = encoder.encode([x or "" for x in batch.column(1).to_pylist()])
                values = pa.array(np.insert(ids, np.cumsum(n), end_id))
                n += 1
                offsets = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch.column(0), pa.array(at + offsets[:-1]), pa.array(n), lists], schema=schema)
                at += int(offsets[-1])

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of one id, or of none, are ordered by a hash of their texts, so that many of them still make several ranges
    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ids = ordered.mapInArrow(run, f"part int, doc_id {id_type}, local_start long, n_tokens long, ids array<int>")
    ids.write.options(**FORMAT).parquet(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in files of `write`: start counts the ids of all
    documents before, from each part's total and the place in the part; the checksum is of the ids as unsigned 32-bit."""
    files = spark.read.parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    id_type = files.schema["doc_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            lists = b.column(4)
            data, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            crc = [zlib.crc32(data[i:j].astype("<u4").tobytes()) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    rows = files.select("part", "doc_id", "local_start", "n_tokens", "ids").mapInArrow(run, f"part int, doc_id {id_type}, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("local_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """`write` to a new folder in the shared one, then `read_back`."""
    path = new_path(docs.sparkSession, "tokens")
    write(docs, path, **options)
    return read_back(docs.sparkSession, path)
