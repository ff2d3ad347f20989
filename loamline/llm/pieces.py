"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reports, at each position, all pieces that end there (it follows the output links); each relaxes the best
score of that position from the position where it starts. Equal scores keep the longest piece. A character that is no
piece costs UNKNOWN less than the least score and becomes its UTF-8 bytes' pieces. No piece of these vocabularies goes on
past the end of a word, so the text is cut before each run of word marks and a worker keeps the ids of words it has met.

Scores: where the file's are merge ranks (unlike integers from 0 down), whose sums mean nothing, a piece of rank r gets
-log(RANK + r), the log-probability of a Zipf-Mandelbrot law up to a constant; other files' scores are taken as they are.
A word mark that stands in the text itself becomes its bytes' pieces, so that decoding gives it back.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended

MODEL, MARK, UNKNOWN, RANK = "piece_bpe_32k.model", "▁", 10.0, 100
#: Words whose ids a worker keeps, and the longest of them.
CACHE, LONGEST = 200_000, 64
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

_models: dict[str, Pieces] = {}


class Pieces:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        # only the pieces and their scores are taken from the file
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.bytes, self.shown, least, across = {}, [], 0.0, False
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        listed = [x for x in map(model.get_score, plain) if x > -1e8]
        ranked = len(set(listed)) == len(listed) and all(x <= 0 and x == int(x) for x in listed)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.shown.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.shown.append(b"")
            else:
                score = -math.log(RANK - model.get_score(i)) if ranked else model.get_score(i)
                self.automaton.add_word(piece, (len(piece), i, score))
                self.shown.append(piece.replace(MARK, " ").encode())
                least = min(least, score) if score > -1e8 else least
                across |= MARK in piece.lstrip(MARK)
        self.automaton.make_automaton()
        self.unknown, self.across, self.words = least - UNKNOWN, across, {}
        self.mark = np.array([self.bytes[b] for b in MARK.encode()], "<i4").tobytes() if self.bytes else None

    @classmethod
    def of(cls, name: str) -> Pieces:
        """The model of a file, or of a public vocabulary by name, once for each worker."""
        if name not in _models:
            import public_tokenizers

            _models[name] = cls(name if os.path.isabs(name) else public_tokenizers.path(name))
        return _models[name]

    def best(self, text: str) -> list[int]:
        """Ids of the segmentation of highest score."""
        n = len(text)
        score, back, single = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1), [False] * (n + 1)
        done = 0  # positions up to here are final

        def finish(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                if not single[done] and score[done - 1] + self.unknown > score[done]:
                    score[done], back[done] = score[done - 1] + self.unknown, (1, -1)

        for last, (length, i, s) in self.automaton.iter(text):
            end = last + 1
            finish(last)
            single[end] |= length == 1
            if score[end - length] + s > score[end]:
                score[end], back[end] = score[end - length] + s, (length, i)
        finish(n)
        out, at = [], n
        while at:
            length, i = back[at]
            out += [i] if i >= 0 else [self.bytes[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass"))]
            at -= length
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers; none for an empty text."""
        if not text:
            return b""
        first, *rest = text.split(MARK) if self.mark else [text]
        out = self._encode(MARK + first.replace(" ", MARK))
        for part in rest:
            out += [self.mark, *self._encode(part.replace(" ", MARK))]
        return b"".join(out)

    def _encode(self, marked: str) -> list[bytes]:
        out, words = [], self.words
        for w in [marked] if self.across else _WORD.findall(marked):
            ids = words.get(w)
            if ids is None:
                ids = np.array(self.best(w), "<i4").tobytes()
                if len(w) <= LONGEST and len(words) < CACHE:
                    words[w] = ids
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def encoded(docs: DataFrame, text_col: str = "text", out_col: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """docs with out_col, the ids of each whole text; null for a null text, empty for an empty one. A column that is
    already called out_col is replaced; others stay, and so do repeated rows."""
    kept = docs.drop(out_col)
    schema = extended(kept, f"`{out_col}` array<int>")
    where = kept.columns.index(text_col)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for whole in stream:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                texts = batch.column(where).to_pylist()
                ids = [pieces.encode(t) if t else b"" for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
                mask = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")), mask=mask)
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out_col])

    return kept.mapInArrow(run, schema)


def decoded(rows: DataFrame, ids_col: str = "piece_ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """rows with out_col, the text of the ids, equal to what was encoded; null for null."""
    kept = rows.drop(out_col)
    schema = extended(kept, f"`{out_col}` string")
    where = kept.columns.index(ids_col)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in stream:
            lists = batch.column(where)
            data, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            texts = [pieces.decode(data[i:j]) if ok else None for i, j, ok in zip(at[:-1], at[1:], lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return kept.mapInArrow(run, schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) per row: the ids of the whole text (null: empty) and whether they decode to it."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = d.schema["doc_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # both ways in one worker, which holds one model
        pieces = Pieces.of(model)
        for whole in stream:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                texts = batch.column(1).to_pylist()
                ids = [np.frombuffer(pieces.encode(t), "<i4") for t in texts]
                same = [pieces.decode(i) == t for i, t in zip(ids, texts)]
                n = np.array([len(i) for i in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), lists, pa.array(same)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return d.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids array<int>, round_trip boolean")
