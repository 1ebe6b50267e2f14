"""Quality classifier on random-indexing word vectors.

Words are runs of letters, of one kind of sign, or of digits; runs of capitals, digits and repeats of a line have a
word of their own. Random indexing: every word has a sparse ternary index vector made from its hash, and the vector
of a word is the sum of the index vectors of its neighbours over the whole corpus. Words share a fixed number of
slots by hash, so the model has the same size for any corpus. A document is the mean of its word vectors;
a two-layer network in numpy gives its probability, and a temperature fitted on rows that the network has not seen
calibrates it.

Defined results: null and empty texts are the zero vector and get its score; rows that repeat are scored each; null
ids stay null and are not held out; labels that are null are not learned from; an empty table gives an empty one;
without labelled rows of both classes every score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstress.llm import tokens
from panelstress.llm.toxicity import training_rows

#: Bound of the sample of labelled rows that the network and the temperature are fitted on.
SAMPLE_ROWS = 20_000
SLOTS = 1 << 12
DIMENSIONS = 48
NONZERO = 2
WINDOW = 2
HIDDEN = 24
EPOCHS = 40
THRESHOLD = 0.7

_KIND = np.full(256, 3, dtype=np.uint8)  # signs
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 1
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 2
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_CAPITALS, _NUMBER, _REPEAT = 0, 1, 2


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and slot of every word."""
    kind = _KIND[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    edge[-1] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    bounds = np.flatnonzero(edge)
    start, end = bounds[:-1], bounds[1:]
    solid = kind[start] != 0 if len(start) else np.zeros(0, bool)
    start, end = start[solid], end[solid]
    if len(start) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    h = tokens.run_hash(raw, start, end)
    slot = (h % np.uint64(SLOTS - 3)).astype(np.int64) + 3
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    slot[(end - start > 1) & (upper[end] - upper[start] == end - start)] = _CAPITALS
    slot[kind[start] == 1] = _NUMBER
    # A word whose neighbourhood of four words stood in the text before counts as a repeat as well.
    n = len(h) - 3
    if n > 0:
        four = tokens.mix(h[:n] * np.uint64(3) + h[1 : n + 1] * np.uint64(5) + h[2 : n + 2] * np.uint64(7) + h[3:] * np.uint64(11))
        inside = np.flatnonzero(doc[:n] == doc[3:])
        key = tokens.mix(four[inside] + doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        again = inside[order[1:][key[order[1:]] == key[order[:-1]]]]
        doc = np.concatenate([doc, doc[again]])
        slot = np.concatenate([slot, np.full(len(again), _REPEAT)])
        if len(again):
            by = np.argsort(doc, kind="stable")
            doc, slot = doc[by], slot[by]
    return doc, slot


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of the nonzero entries of every slot's index vector."""
    h = tokens.mix(np.arange(1, SLOTS * NONZERO + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(SLOTS, NONZERO)
    return (h % np.uint64(DIMENSIONS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One matrix of summed contexts per task, of fixed size whatever the task reads."""
    dimension, sign = index_vectors()
    total = np.zeros(SLOTS * DIMENSIONS)
    for batch in batches:
        raw, offsets = tokens.utf8(batch.column("_text"))
        for lo, hi in tokens.slices(offsets):
            doc, slot = words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            for step in range(1, WINDOW + 1):
                near = np.flatnonzero(doc[step:] == doc[:-step])
                left, right = slot[near], slot[near + step]
                for k in range(NONZERO):
                    for a, b in ((left, right), (right, left)):
                        total += np.bincount(a * DIMENSIONS + dimension[b, k], weights=sign[b, k], minlength=len(total))
    used = np.flatnonzero(total.reshape(SLOTS, DIMENSIONS).any(axis=1))
    flat = pa.array(total.reshape(SLOTS, DIMENSIONS)[used].reshape(-1))
    ends = pa.array(np.arange(0, len(used) * DIMENSIONS + 1, DIMENSIONS, dtype=np.int32))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.ListArray.from_arrays(ends, flat)], ["slot", "v"])


def word_vectors(documents: DataFrame, text_col: str = "text") -> np.ndarray:
    """SLOTS x DIMENSIONS vectors of unit length, from all documents; the result has a fixed size."""
    parts = documents.select(F.col(text_col).alias("_text")).mapInArrow(_contexts, "slot int, v array<double>")
    summed = parts.groupBy("slot").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIMENSIONS)]).toArrow()
    out = np.zeros((SLOTS, DIMENSIONS))
    out[summed["slot"].to_numpy()] = np.stack([summed[f"v{i}"].to_numpy() for i in range(DIMENSIONS)], axis=1)
    index_dimension, index_sign = index_vectors()
    for k in range(NONZERO):  # a word's own index vector tells apart words with the same neighbours
        np.add.at(out, (np.arange(SLOTS), index_dimension[:, k]), 1e-9 * index_sign[:, k])
    unit = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    own = np.zeros((SLOTS, DIMENSIONS))
    for k in range(NONZERO):
        np.add.at(own, (np.arange(SLOTS), index_dimension[:, k]), index_sign[:, k] / np.sqrt(NONZERO))
    return (unit + own).astype(np.float32)


def pool(documents: DataFrame, vectors: np.ndarray, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep and ``pooled``: the mean vector of the words, and one more entry for the length."""
    shared = documents.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        width = DIMENSIONS + 1
        for batch in batches:
            raw, offsets = tokens.utf8(batch.column("_text"))
            for lo, hi in tokens.slices(offsets):
                n = hi - lo
                doc, slot = words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                out = np.zeros((n, width), dtype=np.float32)
                if len(doc):
                    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    count = np.diff(np.append(first, len(doc)))
                    out[doc[first], :DIMENSIONS] = np.add.reduceat(table[slot], first, axis=0) / count[:, None]
                    out[doc[first], DIMENSIONS] = np.log1p(count) / 10.0
                ends = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32))
                part = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))], [*keep, "pooled"]
                )

    source = documents.select(*keep, F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{kinds}, pooled array<float>")


@dataclass(frozen=True)
class Network:
    """Two layers over standardised inputs, with the temperature of the output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0.0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
    """Adam on minibatches; every fifth row is left for the temperature."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    spare = np.arange(len(z)) % 5 == 4
    zt, yt = z[~spare], y[~spare]
    p = [rng.normal(size=(z.shape[1], HIDDEN)) * np.sqrt(2 / z.shape[1]), np.zeros(HIDDEN), rng.normal(size=HIDDEN) * np.sqrt(2 / HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(zt))
        rate = 0.01 * (1 - epoch / EPOCHS) + 1e-4
        for lo in range(0, len(order), 256):
            xb, yb = zt[order[lo : lo + 256]], yt[order[lo : lo + 256]]
            h = np.maximum(xb @ p[0] + p[1], 0.0)
            d = (1.0 / (1.0 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - yb) / len(yb)
            dh = np.outer(d, p[2]) * (h > 0)
            grads = [xb.T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    out, ys = net.logits(x[spare]), y[spare]
    grid = np.exp(np.linspace(np.log(0.5), np.log(5.0), 60))
    loss = [np.sum(np.logaddexp(0, out / g) - ys * out / g) for g in grid]
    temperature = float(grid[int(np.argmin(loss))]) if len(ys) else 1.0
    return replace(net, temperature=temperature)


def learn(documents: DataFrame, labels: DataFrame, vectors: np.ndarray, rows: int = SAMPLE_ROWS, target: str = "quality") -> Network:
    """Network from a bounded sample: at most ``rows`` vectors reach the driver."""
    sample = pool(training_rows(documents, labels, target, rows), vectors, ["doc_id", "y"]).toArrow().sort_by("doc_id")
    y = sample["y"].to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        zero = np.zeros(DIMENSIONS + 1)
        return Network(zero, zero + 1, np.zeros((DIMENSIONS + 1, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))), 1.0)
    x = sample["pooled"].combine_chunks().flatten().to_numpy().reshape(len(y), DIMENSIONS + 1).astype(float)
    return fit_network(x, y)


def score(documents: DataFrame, vectors: np.ndarray, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("pooled").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS + 1).astype(float)
            p = shared.value.probability(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [id_col, "score", "predicted"]
            )

    pooled = pool(documents, vectors, [id_col], text_col)
    return pooled.mapInArrow(run, f"`{id_col}` {pooled.schema[id_col].dataType.simpleString()}, score double, predicted int")
