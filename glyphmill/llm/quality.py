"""Quality classifier: a generalised additive model with pairwise interactions, by cyclic boosting."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, held_out, labelled_sample, small_batches
from .features import NAMES, features

#: Labelled rows that the model is fitted on at most.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 48, 8, 6, 200, 80, 0.12


@dataclass
class Additive:
    """Lookup tables over binned features: score = sigmoid(base + sum of bins)."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            total += t[np.searchsorted(self.cuts[j], x[:, j], "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            total += t[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Up to bins - 1 cuts between distinct quantiles; the values on a cut go right."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(x) else np.zeros(0)


def _shallow(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values by bin of a tree of the depth over the bins, by Newton gain; g and h are sums by bin."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth and len(g) > 1:
        cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = cg**2 / (ch + 1) + (g.sum() - cg) ** 2 / (h.sum() - ch + 1)
        k = int(np.argmax(gain)) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            out = np.concatenate([_shallow(g[:k], h[:k], depth - 1), _shallow(g[k:], h[k:], depth - 1)])
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree with one cut in each of two features, and its gain over no cut."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    quads = [(cg, ch), (cg[:, -1:] - cg, ch[:, -1:] - ch), (cg[-1:] - cg, ch[-1:] - ch), (tg - cg[:, -1:] - cg[-1:] + cg, th - ch[:, -1:] - ch[-1:] + ch)]
    gain = sum(a**2 / (b + 1) for a, b in quads)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [a[i, j] / (b[i, j] + 1) for a, b in (tuple(np.broadcast_to(q, cg.shape) for q in p) for p in quads)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j] - tg**2 / (th + 1))


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Round after round, each feature in turn gets a shallow tree on the gradient; then the pairs with most gain."""
    rate = (y.sum() + 1) / (len(y) + 2)
    n = x.shape[1]
    model = Additive(float(np.log(rate / (1 - rate))), [_cuts(x[:, j], BINS) for j in range(n)], [], [], [_cuts(x[:, j], PAIR_BINS) for j in range(n)], [])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(model.cuts[j], x[:, j], "right") for j in range(n)]
    total = np.full(len(y), model.base)

    def gradient():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(n):
            g, h = gradient()
            k = len(model.tables[j])
            step = RATE * _shallow(np.bincount(bins[j], g, k), np.bincount(bins[j], h, k))
            model.tables[j] += step
            total += step[bins[j]]
    coarse = [np.searchsorted(model.pair_cuts[j], x[:, j], "right") for j in range(n)]
    shape = [len(c) + 1 for c in model.pair_cuts]

    def sums(i, j, values):
        return np.bincount(coarse[i] * shape[j] + coarse[j], values, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = gradient()
    ranked = sorted(((_shallow_pair(sums(i, j, g), sums(i, j, h))[1], i, j) for i in range(n) for j in range(i) if shape[i] > 1 and shape[j] > 1), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (i, j) in zip(model.pair_tables, model.pairs):
            g, h = gradient()
            step = RATE * _shallow_pair(sums(i, j, g), sums(i, j, h))[0]
            t += step
            total += step[coarse[i], coarse[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Additive:
    """Fit on at most ``most`` labelled rows outside the held-out part; only their features come to the driver."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = labelled_sample(docs, labels, label, most).mapInArrow(rows, f"doc_id {kind}, y int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(NAMES))
    y = np.array(got.column("y").to_pylist(), np.float64)
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order in which tasks end
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, model: Additive, threshold: float = 0.7) -> DataFrame:
    """All rows and columns with score and predicted (1 if score >= threshold).

    Whole texts; null and empty ones have all features 0 and get the score of that point.
    Ids pass through (null, repeated); columns named score or predicted are replaced; an empty table
    gives an empty result.  Without labels the model gives one half, with labels of one kind their rate.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    text = docs.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                s = model.score(features(part.column(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], [*part.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*docs.schema.fields]).add("score", DoubleType())
    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, model: Additive, threshold: float = 0.7) -> DataFrame:
    """The rows, all columns untouched whatever their names, of which the score is at least the threshold."""
    small_batches(docs.sparkSession)
    text = docs.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                yield part.filter(pa.array(model.score(features(part.column(text))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels)
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
