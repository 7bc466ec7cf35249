"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction is a GRU of HIDDEN units whose input weights are one row for each
byte.  Every position's label distribution comes from the two states there, and a
text's is the mean over its positions.  Texts are cut into spans of SPAN bytes whose
states start afresh, so that all spans of a batch run side by side in numpy, and a
text of any length is read whole in bounded memory.

The network is trained on the driver by backpropagation through time, with Adam,
on WINDOWS windows of each of PER_LABEL texts a label at most: for each label the
texts of lowest hash in each of PER_LABEL buckets, windows spread over the whole
text.

Nulls: texts that are null or hold no letter are `und` with score 0, as is everything
when there is nothing to learn from. Rows of null labels aren't learned from. Repeated
rows give equal rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import id_text, slices, text_buffer

HIDDEN, SPAN, LANES = 8, 64, 1024
PER_LABEL, WINDOWS, WINDOW, STEPS, BATCH = 300, 6, 48, 260, 192
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Net:
    labels: list[str]
    x: np.ndarray  # direction, byte, 3 * HIDDEN: input weights of update, reset and candidate
    u: np.ndarray  # direction, HIDDEN, 3 * HIDDEN
    c: np.ndarray  # direction, HIDDEN: bias of the candidate's state part
    out: np.ndarray  # 2 * HIDDEN, labels
    bias: np.ndarray


def _sigmoid(v: np.ndarray) -> np.ndarray:
    np.multiply(v, np.float32(0.5), out=v)
    np.tanh(v, out=v)
    v += 1
    v *= np.float32(0.5)
    return v


def states(net: Net, d: int, seq: np.ndarray) -> np.ndarray:
    """Hidden states (time, lane, HIDDEN) of direction d for bytes (time, lane). Gates
    are taken as (1 + tanh(v / 2)) / 2, the halves going into the weights, and each has
    arrays of its own, so that every operation runs over contiguous memory."""
    k = HIDDEN
    part = lambda w, i, by: np.ascontiguousarray(w[:, i * k : (i + 1) * k] * np.float32(by))
    (xz, uz), (xr, ur), (xn, un) = ((part(net.x[d], i, 0.5 if i < 2 else 1), part(net.u[d], i, 0.5)) for i in range(3))
    c, half = net.c[d] * np.float32(0.5), np.float32(0.5)
    h = np.zeros((seq.shape[1], k), np.float32)
    out = np.empty((*seq.shape, k), np.float32)
    z, r, n, s = (np.empty_like(h) for _ in range(4))
    for t in range(len(seq)) if d == 0 else range(len(seq) - 1, -1, -1):
        at = seq[t]
        xz.take(at, axis=0, out=z, mode="clip")
        xr.take(at, axis=0, out=r, mode="clip")
        xn.take(at, axis=0, out=n, mode="clip")
        z += np.matmul(h, uz, out=s)
        np.tanh(z, out=z)
        r += np.matmul(h, ur, out=s)
        np.tanh(r, out=r)
        r += 1
        np.matmul(h, un, out=s)
        s += c
        s *= r
        n += s
        np.tanh(n, out=n)
        z += 1
        z *= half
        h = np.subtract(h, n, out=out[t])
        h *= z
        h += n
    return out


def position_probabilities(net: Net, seq: np.ndarray) -> np.ndarray:
    """(time, lane, label): the label distribution at every byte."""
    v = states(net, 0, seq) @ net.out[:HIDDEN]
    v += states(net, 1, seq) @ net.out[HIDDEN:]
    v += net.bias
    v -= v.max(-1, keepdims=True)
    np.exp(v, out=v)
    v /= v.sum(-1, keepdims=True)
    return v


def text_probabilities(net: Net, texts: pa.Array) -> np.ndarray:
    """(text, label): the mean of the distributions at all bytes of each text."""
    data, offs = text_buffer(texts)
    size = np.diff(offs)
    spans = -(-size // SPAN)
    owner = np.repeat(np.arange(len(size)), spans)
    start = (np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)) * SPAN + offs[owner]
    length = np.minimum(SPAN, offs[owner + 1] - start)
    total = np.zeros((len(size), len(net.labels)))
    order = np.argsort(length, kind="stable")  # lanes of equal length together
    for a in range(0, len(order), LANES):
        lane = order[a : a + LANES]
        longest = int(length[lane].max())
        at = start[lane][None] + np.arange(longest)[:, None]
        inside = np.arange(longest)[:, None] < length[lane][None]
        seq = np.where(inside, data[np.minimum(at, len(data) - 1)], 0)
        p = position_probabilities(net, seq)
        np.add.at(total, owner[lane], (p * inside[:, :, None]).sum(0))
    return total / np.maximum(size, 1)[:, None]


# ------------------------------------------------------------------ training


def _forward(net: Net, d: int, seq: np.ndarray) -> tuple[np.ndarray, list]:
    h = np.zeros((seq.shape[1], HIDDEN), np.float32)
    out, kept = np.empty((*seq.shape, HIDDEN), np.float32), []
    for t in range(len(seq)) if d == 0 else range(len(seq) - 1, -1, -1):
        a, s = net.x[d].take(seq[t], axis=0), h @ net.u[d]
        zr = _sigmoid(a[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        m = s[:, 2 * HIDDEN :] + net.c[d]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * m)
        kept.append((t, h, z, r, m, n))
        h = n + z * (h - n)
        out[t] = h
    return out, kept


def _backward(net: Net, d: int, seq: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the input weights, state weights and bias through time."""
    gx, gu, gc = np.zeros_like(net.x[d]), np.zeros_like(net.u[d]), np.zeros_like(net.c[d])
    back = np.zeros((seq.shape[1], HIDDEN), np.float32)
    da = np.empty((*seq.shape, 3 * HIDDEN), np.float32)
    for t, h, z, r, m, n in reversed(kept):
        dh = grad[t] + back
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dm = dn * r
        dr = dn * m * r * (1 - r)
        ds = np.concatenate([dz, dr, dm], 1)
        da[t, :, : 2 * HIDDEN] = ds[:, : 2 * HIDDEN]
        da[t, :, 2 * HIDDEN :] = dn
        gu += h.T @ ds
        gc += dm.sum(0)
        back = ds @ net.u[d].T + dh * z
    flat = seq.ravel()
    order = np.argsort(flat, kind="stable")
    which, begin = np.unique(flat[order], return_index=True)
    gx[which] = np.add.reduceat(da.reshape(-1, 3 * HIDDEN)[order], begin, axis=0)
    return gx, gu, gc


def train(windows: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 11) -> Net:
    """A network fitted to windows of texts; batches draw all labels alike."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    net = Net(
        names,
        rng.normal(0, 0.3, (2, 256, 3 * HIDDEN)).astype(np.float32),
        rng.normal(0, 0.3, (2, HIDDEN, 3 * HIDDEN)).astype(np.float32),
        np.zeros((2, HIDDEN), np.float32),
        rng.normal(0, 0.3, (2 * HIDDEN, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    data = np.zeros((len(windows), WINDOW), np.uint8)
    for i, w in enumerate(windows):
        data[i, : len(w)] = np.frombuffer(w[:WINDOW], np.uint8)
    sizes = np.array([min(len(w), WINDOW) for w in windows])
    y = np.array([names.index(x) for x in labels])
    of = [np.flatnonzero(y == k) for k in range(len(names))]
    weights = [net.x, net.u, net.c, net.out, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(k, BATCH // len(names) + 1) for k in of])
        seq, want = data[pick].T, y[pick]
        inside = (np.arange(WINDOW)[:, None] < sizes[pick][None]).astype(np.float32)
        f, kept_f = _forward(net, 0, seq)
        b, kept_b = _forward(net, 1, seq)
        v = f @ net.out[:HIDDEN] + b @ net.out[HIDDEN:] + net.bias
        v -= v.max(-1, keepdims=True)
        p = np.exp(v)
        p /= p.sum(-1, keepdims=True)
        p[:, np.arange(len(pick)), want] -= 1
        p *= (inside / inside.sum())[:, :, None]
        flat = p.reshape(-1, len(names))
        g_out = np.concatenate([f.reshape(-1, HIDDEN).T @ flat, b.reshape(-1, HIDDEN).T @ flat])
        gf = _backward(net, 0, seq, kept_f, p @ net.out[:HIDDEN].T)
        gb = _backward(net, 1, seq, kept_b, p @ net.out[HIDDEN:].T)
        grads = [np.stack([gf[0], gb[0]]), np.stack([gf[1], gb[1]]), np.stack([gf[2], gb[2]]), g_out, flat.sum(0)]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.03 * min(1.0, 2 * (1 - (step - 1) / steps))
        for w, g, m, s in zip(weights, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def fit(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Net | None:
    """Train on the rows of docs; None if none has a label and a letter."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("string").alias("y")).filter("doc_id is not null and y is not null")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(PER_LABEL))
    chosen = named.groupBy("y", bucket.alias("k")).agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(1)), "doc_id")).alias("d")).select("y", F.col("d.doc_id").alias("doc_id"))
    rows = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # PER_LABEL rows of each label
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")  # of rows that repeat an id, one

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, names, ids = [], [], []
            for i, text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                if _LETTER.search(text):
                    places = [0] if len(data) <= WINDOW else np.unique(np.linspace(0, len(data) - WINDOW, WINDOWS).astype(int)).tolist()
                    out += [data[a : a + WINDOW] for a in places]
                    names += [name] * len(places)
                    ids += [i] * len(places)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(names, pa.string())], names=["doc_id", "w", "y"])

    got = rows.mapInArrow(cut, "doc_id long, w binary, y string").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.w), r.y))
    return train([bytes(r.w) for r in got], [r.y for r in got]) if got else None


def predict(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the label's pooled probability) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            letters = np.array([_LETTER.search(t) is not None for t in batch.column(1).to_pylist()])
            if net is None or not letters.any():
                name, score = np.full(len(letters), "und", object), np.zeros(len(letters))
            else:
                p = text_probabilities(net, batch.column(1))
                name = np.where(letters, np.array(net.labels, object)[p.argmax(1)], "und")
                score = np.where(letters, np.clip(p.max(1), 0, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name.tolist(), pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
