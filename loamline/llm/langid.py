"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions, labels every position and pools a document's probabilities over
all its positions. Its gates and states use x / (1 + |x|) for the usual sigmoid and tangent. It is trained in numpy by
backpropagation through time on windows from pieces that lie evenly over the whole texts of at most SAMPLE documents for
each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import extended, held_out, packed, unpacked

#: Labelled documents for each language that training may use, the pieces of each, and characters of a piece.
SAMPLE, PIECES, PIECE = 600, 8, 96
HIDDEN, STEPS, BATCH, SPAN, RATE, SEED = 8, 400, 128, 64, 0.01, 7
#: Bytes of a window, windows of a pass.
WINDOW, PASS = 128, 1024


@dataclass
class Network:
    """Weights: of input bytes and of the state into (update, reset, candidate), for both directions, and of the output."""

    langs: list[str]
    e: np.ndarray  # 2, 256, 3 H
    u: np.ndarray  # 2, H, 3 H
    v: np.ndarray  # 2 H, languages
    b: np.ndarray  # languages


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(x: np.ndarray) -> np.ndarray:
    return 1 / np.square(1 + np.abs(x))


def _both(windows: np.ndarray) -> np.ndarray:
    """Rows of e (as 512 rows) for each time, direction and window: the bytes forwards and backwards."""
    t = windows.T.astype(np.int64)
    return np.stack([t, t[::-1] + 256], axis=1)


def _forward(net: Network, rows: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (time, direction, window, H) of the two directions in their own time."""
    h = net.u.shape[1]
    e = net.e.reshape(512, 3 * h)
    state = np.zeros((2, rows.shape[2], h), np.float32)
    out = np.empty((len(rows), *state.shape), np.float32)
    for t, at in enumerate(rows):
        x, g = e[at], state @ net.u
        gates = x[..., : 2 * h] + g[..., : 2 * h]
        open_ = 0.5 * _soft(gates) + 0.5
        z, r = open_[..., :h], open_[..., h:]
        inner = x[..., 2 * h :] + r * g[..., 2 * h :]
        new = _soft(inner)
        if trace is not None:
            trace.append((state, g[..., 2 * h :], gates, inner, z, r, new))
        state = state + z * (new - state)
        out[t] = state
    return out


def _read(net: Network, windows: np.ndarray) -> np.ndarray:
    """What _positions gives for _forward, for prediction: each gate in arrays of its own, reused from step to step."""
    h, (n, steps) = net.u.shape[1], windows.shape
    e = np.ascontiguousarray(net.e.reshape(512, 3, h).transpose(1, 0, 2))
    u = np.ascontiguousarray(net.u.reshape(2, h, 3, h).transpose(2, 0, 1, 3))
    rows = _both(windows)
    state, (a, b, x, y) = np.zeros((2, n, h), np.float32), np.empty((4, 2, n, h), np.float32)
    ahead, behind = np.empty((2, steps, n, h), np.float32)

    def soft(v: np.ndarray) -> None:
        np.abs(v, out=y)
        np.add(y, 1, out=y)
        np.divide(v, y, out=v)

    for t, at in enumerate(rows):
        for gate, out in ((0, a), (1, b)):  # twice the update and the reset gate
            np.take(e[gate], at, axis=0, out=out, mode="clip")
            np.matmul(state, u[gate], out=x)
            np.add(out, x, out=out)
            soft(out)
            np.add(out, 1, out=out)
        np.matmul(state, u[2], out=x)
        np.multiply(x, b, out=b)
        np.multiply(b, 0.5, out=b)
        np.take(e[2], at, axis=0, out=x, mode="clip")
        np.add(x, b, out=x)
        soft(x)
        np.subtract(x, state, out=x)
        np.multiply(x, a, out=x)
        np.multiply(x, 0.5, out=x)
        np.add(state, x, out=state)
        ahead[t], behind[steps - 1 - t] = state[0], state[1]
    p = ahead.reshape(-1, h) @ net.v[:h]
    p += behind.reshape(-1, h) @ net.v[h:]
    np.exp(np.clip(p + net.b, -40, 40), out=p)
    p /= (p @ np.ones(p.shape[1], np.float32))[:, None]
    return p.reshape(steps, n, -1)


def _positions(net: Network, states: np.ndarray) -> np.ndarray:
    """Probabilities (time, window, language) at every position."""
    h = net.u.shape[1]
    logits = states[:, 0] @ net.v[:h] + states[::-1, 1] @ net.v[h:] + net.b
    p = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def _gradients(net: Network, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy over all positions, by backpropagation through time."""
    h, rows, trace = net.u.shape[1], _both(windows), []
    states = _forward(net, rows, trace)
    d = _positions(net, states)
    d[:, np.arange(len(labels)), labels] -= 1
    d /= d.shape[0] * d.shape[1]
    flat = d.reshape(-1, d.shape[2])
    ahead, behind = states[:, 0], states[::-1, 1]
    dv = np.concatenate([ahead.reshape(-1, h).T @ flat, behind.reshape(-1, h).T @ flat])
    into = np.stack([d @ net.v[:h].T, (d @ net.v[h:].T)[::-1]], axis=1)
    back, du = np.zeros_like(states[0]), np.zeros_like(net.u)
    dx = np.empty((len(rows), 2, rows.shape[2], 3 * h), np.float32)
    for t in range(len(rows) - 1, -1, -1):
        state, gn, gates, inner, z, r, new = trace[t]
        back = back + into[t]
        dn = back * z * _slope(inner)
        dg = np.concatenate([back * (new - state), dn * gn], axis=-1) * 0.5 * _slope(gates)
        dx[t] = np.concatenate([dg, dn], axis=-1)
        through = np.concatenate([dg, dn * r], axis=-1)
        du += state.transpose(0, 2, 1) @ through
        back = back * (1 - z) + through @ net.u.transpose(0, 2, 1)
    de = np.zeros((512, 3 * h), np.float32)
    np.add.at(de, rows.reshape(-1), dx.reshape(-1, 3 * h))
    return {"e": de.reshape(net.e.shape), "u": du, "v": dv, "b": flat.sum(axis=0)}


def train(texts: list[bytes], labels: list[int], langs: list[str]) -> Network:
    """Adam over seeded batches of windows, as many of each language."""
    rng, n = np.random.default_rng(SEED), len(langs)
    data = [np.frombuffer(t if len(t) >= SPAN else (t * (SPAN // len(t) + 1)), np.uint8) for t in texts]
    by = [np.flatnonzero(np.array(labels) == i) for i in range(n)]
    draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    net = Network(langs, draw(2, 256, 3 * HIDDEN), draw(2, HIDDEN, 3 * HIDDEN), draw(2 * HIDDEN, n), np.zeros(n, np.float32))
    first, second = {}, {}
    for step in range(1, STEPS + 1):
        y = rng.integers(0, n, BATCH)
        picks = [data[by[i][rng.integers(len(by[i]))]] for i in y]
        windows = np.stack([p[(a := rng.integers(len(p) - SPAN + 1)) : a + SPAN] for p in picks])
        for k, g in _gradients(net, windows, y).items():
            first[k] = 0.9 * first.get(k, 0) + 0.1 * g
            second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
            rate = RATE * (1 - step / (STEPS + 1)) / (1 - 0.9**step)
            getattr(net, k)[...] -= rate * first[k] / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """(document, language): the mean over all positions of each non-empty text. A text is read in windows, the last
    ending with it; one shorter than a window is repeated to fill it, and only its own positions count."""
    sums = np.zeros((len(texts), len(net.langs)))
    windows, owner, skip, upto = [], [], [], []

    def flush() -> None:
        if windows:
            p = _read(net, np.stack(windows))
            time = np.arange(WINDOW)[:, None]
            counts = ((time >= np.array(skip)) & (time < np.array(upto))).astype(np.float32)
            np.add.at(sums, owner, np.einsum("tnc,tn->nc", p, counts))
            for x in (windows, owner, skip, upto):
                x.clear()

    for i, text in enumerate(texts):
        b, n = np.frombuffer(text, np.uint8), len(text)
        for at in range(0, n, WINDOW):
            low = max(0, min(at, n - WINDOW))
            windows.append(b[low : low + WINDOW] if n >= WINDOW else np.resize(b, WINDOW))
            owner.append(i)
            skip.append(at - low)
            upto.append(min(WINDOW, n - low))
            if len(windows) == PASS:
                flush()
    flush()
    return sums / np.maximum(1, [len(t) for t in texts])[:, None]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network from documents outside the held-out fifth with a language and a letter: at most SAMPLE of them for each
    language, those of lowest hash, by PIECES pieces from the start to the end of the text. None without any."""
    d = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit(SEED))
    free = F.greatest(F.lit(0), F.length(text_col) - PIECE)
    pieces = F.array(*(F.substring(F.col(text_col), (free * i / (PIECES - 1)).cast("int") + 1, F.lit(PIECE)) for i in range(PIECES)))
    d = d.select(F.col(lang_col).alias("lang"), order.alias("o"), pieces.alias("pieces"))
    # hashes are even, so those below this share of them hold the SAMPLE lowest of a language, and only these are shuffled and ranked
    counts = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    upto = d.sparkSession.createDataFrame([(lang, -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 2 * SAMPLE // n)) for lang, n in counts.items()], "lang string, upto long")
    few = d.join(F.broadcast(upto), "lang").where("o <= upto")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "pieces"))
    rows = sorted(tuple(r) for r in few.withColumn("r", rank).where(F.col("r") <= SAMPLE).select("lang", "o", "pieces").collect())
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    return train([p.encode() for r in rows for p in r[2]], [langs.index(r[0]) for r in rows for _ in r[2]], langs)


def identified(docs: DataFrame, net: Network | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred (a learned language, or und if the text is null or has no letter) and score, the pooled
    probability of that language (0 for und), under the prefix given. Columns of these names are replaced."""
    names = (f"{prefix}lang_pred", f"{prefix}score")
    kept = docs.select(packed(docs), F.col(f"`{text_col}`").alias("text"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                texts = [t if t is not None and any(map(str.isalpha, t)) else "" for t in batch.column(1).to_pylist()]
                if net is None:
                    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                else:
                    p = document_probabilities(net, [t.encode() for t in texts])
                    best = p.argmax(axis=1)
                    langs = [net.langs[b] if t else "und" for b, t in zip(best, texts)]
                    scores = [min(1.0, float(x)) if t else 0.0 for x, t in zip(p.max(axis=1), texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["own", "lang", "score"])

    found = kept.mapInArrow(run, extended(kept.select("own"), "lang string, score double"))
    return found.select(*unpacked(docs, names), F.col("lang").alias(names[0]), F.col("score").alias(names[1]))
