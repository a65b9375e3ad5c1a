"""Document quality: a byte-level convolutional network in numpy.

Bytes are embedded, filters of eight bytes run over them in steps of four, and each filter is max-pooled over
overlapping chunks that cover the whole document; the mean of the chunks' maxima goes through a logistic unit.
It is fitted on a bounded labelled sample (PER_CLASS documents of either class) and applied to every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.common import bound_batches, by_slices
from itemforge.llm.labelled import fold, sample

FOLDS, HELD_OUT = 3, 1
PER_CLASS, MOST_CHARS = 1500, 60_000
EMBEDDING, FILTERS = 8, 32
STEP = 4  # bytes between windows; a window has two steps
HALF = 512  # bytes; a chunk is two halves, and starts at every half
EPOCHS, BATCH, RATE = 8, 48, 0.01
SEGMENT = 64_000  # windows convolved at once


@dataclass
class Network:
    embedding: np.ndarray  # 256 x EMBEDDING, row 0 is the padding's
    filters: np.ndarray  # 2 * STEP * EMBEDDING x FILTERS
    filter_bias: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        embedding = r.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        embedding[0] = 0
        return cls(embedding, r.normal(0, 0.15, (2 * STEP * EMBEDDING, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), r.normal(0, 0.1, FILTERS).astype(np.float32), np.zeros(1, np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.filter_bias, self.weights, self.bias]


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer, each padded to whole halves with a step of zeros at least; halves per text."""
    halves = np.array([-(-(len(t) + STEP) // HALF) for t in texts])
    return np.frombuffer(b"".join(t.ljust(h * HALF, b"\0") for t, h in zip(texts, halves.tolist(), strict=True)), dtype=np.uint8), halves


def _half_maxima(net: Network, data: np.ndarray, halves: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's maximum in each half, and the window it is at."""
    per = HALF // STEP
    total = len(data) // HALF
    out = np.empty((total, FILTERS), np.float32)
    at = np.empty((total, FILTERS), np.int64) if where else None
    last = np.zeros(total + 1, bool)
    last[np.cumsum(halves)] = True  # a text begins here
    first, second = net.filters[: STEP * EMBEDDING], net.filters[STEP * EMBEDDING :]
    step = max(1, SEGMENT // per)
    for a in range(0, total, step):
        b = min(total, a + step)
        x = net.embedding[data[a * HALF : b * HALF]].reshape(-1, STEP * EMBEDDING)
        z = x @ first
        z[:-1] += x[1:] @ second
        ends = np.flatnonzero(last[a + 1 : b + 1]) + 1
        z[ends * per - 1] = x[ends * per - 1] @ first
        if b < total and not last[b]:  # the window over the segment's edge
            z[-1] += net.embedding[data[b * HALF : b * HALF + STEP]].reshape(-1) @ second
        z = z.reshape(b - a, per, FILTERS)
        if where:
            best = z.argmax(axis=1)
            out[a:b] = np.take_along_axis(z, best[:, None], axis=1)[:, 0]
            at[a:b] = best + (np.arange(a, b) * per)[:, None]
        else:
            out[a:b] = z.max(axis=1)
    return np.maximum(out + net.filter_bias, 0), at


def _chunk_pool(maxima: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk maxima, the half each comes from, and the text of each chunk."""
    starts = np.concatenate(([0], np.cumsum(halves)))[:-1]
    chunks = np.maximum(halves - 1, 1)
    text = np.repeat(np.arange(len(halves)), chunks)
    left = np.concatenate([np.arange(s, s + c) for s, c in zip(starts.tolist(), chunks.tolist(), strict=True)])
    right = left + (np.repeat(halves, chunks) > 1)
    take_right = maxima[right] > maxima[left]
    return np.where(take_right, maxima[right], maxima[left]), np.where(take_right, right[:, None], left[:, None]), text


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.empty(0)
    data, halves = layout(texts)
    pooled, _, text = _chunk_pool(_half_maxima(net, data, halves)[0], halves)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    mean = np.add.reduceat(pooled, first, axis=0) / np.bincount(text)[:, None]
    return 1 / (1 + np.exp(-np.clip(mean @ net.weights + net.bias[0], -30, 30).astype(np.float64)))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """Adam on the class-balanced log loss; gradients follow the windows that won the pools."""
    net = Network.start(seed)
    if not len(texts):
        return net
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
    order = np.random.default_rng(seed)
    m, v, t = [np.zeros_like(a) for a in net.arrays()], [np.zeros_like(a) for a in net.arrays()], 0
    for epoch in range(EPOCHS):
        rows = order.permutation(len(texts))
        for a in range(0, len(rows), BATCH):
            pick = rows[a : a + BATCH]
            data, halves = layout([texts[i] for i in pick])
            maxima, at = _half_maxima(net, data, halves, where=True)
            pooled, source, text = _chunk_pool(maxima, halves)
            first = np.flatnonzero(np.diff(text, prepend=-1))
            count = np.bincount(text)
            mean = np.add.reduceat(pooled, first, axis=0) / count[:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ net.weights + net.bias[0], -30, 30)))
            g = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            grads = [np.zeros_like(net.embedding), np.zeros_like(net.filters), None, mean.T @ g + 1e-3 * net.weights, g.sum(keepdims=True)]
            down = (g / count)[text][:, None] * net.weights * (pooled > 0)
            grads[2] = down.sum(axis=0)
            windows = np.take_along_axis(at, source, axis=0)  # chunk x filter
            where = np.minimum(windows[:, :, None] * STEP + np.arange(2 * STEP), len(data) - 1)
            codes = data[where]
            for f in range(FILTERS):
                x = net.embedding[codes[:, f]].reshape(len(codes), -1)
                grads[1][:, f] = x.T @ down[:, f]
            back = (down[:, :, None] * net.filters.T[None]).reshape(-1, EMBEDDING)
            flat = codes.reshape(-1)
            for d in range(EMBEDDING):
                grads[0][:, d] = np.bincount(flat, weights=back[:, d], minlength=256)
            grads[0][0] = 0
            t += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for k, (array, grad) in enumerate(zip(net.arrays(), grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                array -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> Network:
    """Fit the network on the driver, on at most per_class documents of either class of at most most_chars characters."""
    rows = sample(docs, labels, "quality", FOLDS, HELD_OUT, per_class, most_chars).select("doc_id", "text", "label").collect()
    texts: dict[str, int] = {}
    for row in sorted(rows, key=lambda r: r[0]):
        texts.setdefault(row[1], row[2])  # copies count once
    return fit([t.encode("utf-8", "surrogatepass") for t in texts], np.array(list(texts.values()), dtype=np.float64))


def score_quality(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, by the text alone.

    Null text scores as the empty text. A null doc_id is not held out. Repeated rows give repeated results; other
    columns are ignored; an empty table gives no rows. A text of any length is read whole. With no labelled rows the
    network is untrained and its score says nothing.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column(2).to_pylist()
            parts = [scores(model.value, [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]]) for a, b in by_slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.empty(0), *parts]), pa.float64())], ["doc_id", "held_out", "score"])

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    scored = docs.select("doc_id", held_out, "text").mapInArrow(batches, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
