"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, byte_slices, held_out, labelled_sample, persisted, small_batches

#: Labelled rows that the index is fitted on at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 6_000, 64 << 20
#: Letters of a piece: a word is cut into pieces of so many, all of which are terms.
PIECE = 4
#: Neighbours that vote, and examples in a block of the index.
NEIGHBOURS, BLOCK = 24, 64
#: Terms, the most frequent ones, that have a dense list of all examples, and queries that meet those lists at once.
DENSE, BATCH = 1024, 128
#: More than single precision can be wrong by in a product of unit vectors.
SLACK = 1e-4
#: Votes, at the examples' rate, that every score starts from.
PRIOR = 0.5


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """CSR (starts, term hashes, counts) of the distinct pieces of every text, and the number of texts."""
    w = Words(column)
    at, end, word = w.pieces(PIECE)
    doc, term = w.doc[word], w.hashes(at, end)
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(new)
    return np.searchsorted(doc[first], np.arange(w.n_docs + 1)), term[first], np.diff(np.append(first, len(doc))), w.n_docs


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of start[1], and so on."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(size.sum())


@dataclass
class Index:
    """Examples as unit TF-IDF vectors, similar ones side by side."""

    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted term hashes
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # CSR of the examples
    cols: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    y: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: pa.Array = field(default_factory=lambda: pa.array([], pa.int64()))
    votes: np.ndarray = field(default_factory=lambda: np.zeros(0))  # calibration: rising votes ...
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))  # ... and the scores that they mean
    base: float = 0.5  # rate of label 1
    bare: float = 0.5  # score of a text without any known term

    def vectors(self, at: np.ndarray, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CSR of unit vectors over the vocabulary; terms of no example, or of every one, weigh nothing."""
        n_docs, doc = len(at) - 1, np.repeat(np.arange(len(at) - 1), np.diff(at))
        if not len(self.vocabulary):
            return np.zeros(n_docs + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
        col = np.minimum(np.searchsorted(self.vocabulary, term), len(self.vocabulary) - 1)
        known = (self.vocabulary[col] == term) & (self.idf[col] > 0)
        doc, col, value = doc[known], col[known], count[known] * self.idf[col[known]]
        norm = np.sqrt(np.bincount(doc, value**2, n_docs))
        return np.searchsorted(doc, np.arange(n_docs + 1)), col, value / norm[doc]

    def vote(self, example: np.ndarray, cosine: np.ndarray) -> float:
        """Share of positive neighbours, each weighing more the nearer it is, with a prior at the examples' rate."""
        weight = 1 / (1.05 - cosine)
        return float((weight @ self.y[example] + PRIOR * self.base) / (weight.sum() + PRIOR))

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, self.votes, self.levels)) if len(self.votes) else self.base


class Search:
    """Inverted lists of an index.  The most frequent terms have dense lists; each other term has its postings by blocks of
    examples, and the largest weight in each block."""

    def __init__(self, index: Index):
        self.index, n, v = index, len(index.y), len(index.vocabulary)
        self.n, self.n_blocks = n, -(-n // BLOCK)
        row = np.repeat(np.arange(n), np.diff(index.at))
        df = np.bincount(index.cols, minlength=v)
        self.slot = np.full(v, -1)  # of a frequent term: its dense list
        frequent = np.argsort(-df, kind="stable")[:DENSE]
        self.slot[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.n_blocks * BLOCK), np.float32)
        of = self.slot[index.cols]
        self.dense[of[of >= 0], row[of >= 0]] = index.weights[of >= 0]
        col, row, weight = index.cols[of < 0].astype(np.int64), row[of < 0], index.weights[of < 0]
        order = np.lexsort((row, col))
        col, self.rows, self.weights = col[order], row[order], weight[order]
        key = col * max(1, self.n_blocks) + self.rows // BLOCK
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.entry_block = key[first] % max(1, self.n_blocks)
        self.entry_max = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.entry_at = np.searchsorted(col[first], np.arange(v + 1))  # by term: its entries, one for each block
        self.post_at = np.append(first, len(key))  # by entry: its postings
        self.query = np.zeros(v)

    def nearest(self, at: np.ndarray, cols: np.ndarray, values: np.ndarray, k: int = NEIGHBOURS, without: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of the queries (CSR) the (examples, cosines) of the k nearest that share a term, ties by example: exact.

        The dense lists of a batch of queries are one product.  A block can hold no better cosine than its
        best dense part and the query's product with the largest weights of its other lists; where that is less
        than the k-th best dense part, the block's postings are not read.  What may be among the k nearest is scored
        again from its vector.  ``without`` names an example for each query that is left out.
        """
        for begin in range(0, len(at) - 1, BATCH):
            end = min(begin + BATCH, len(at) - 1)
            slots = self.slot[cols[at[begin] : at[end]]]
            of = np.repeat(np.arange(end - begin), np.diff(at[begin : end + 1]))
            heads = np.zeros((end - begin, len(self.dense)), np.float32)
            heads[of[slots >= 0], slots[slots >= 0]] = values[at[begin] : at[end]][slots >= 0]
            parts = heads @ self.dense
            for i in range(begin, end):
                skip = without[i] if without else -1
                yield self._one(parts[i - begin], cols[at[i] : at[i + 1]], values[at[i] : at[i + 1]], k, skip)

    def _one(self, part: np.ndarray, cols: np.ndarray, values: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(cols):
            return np.zeros(0, np.int64), np.zeros(0)
        if skip >= 0:
            part[skip] = 0
        rare = self.slot[cols] < 0
        size = self.entry_at[cols[rare] + 1] - self.entry_at[cols[rare]]
        entry, value = ragged(self.entry_at[cols[rare]], size), np.repeat(values[rare], size)
        block = self.entry_block[entry]
        bound = part.reshape(-1, BLOCK).max(1) + np.bincount(block, value * self.entry_max[entry], self.n_blocks)
        least = np.partition(part, -k)[-k] if len(part) > k else 0.0
        own = (bound >= least - SLACK)[block]
        entry, value = entry[own], value[own]
        n = self.post_at[entry + 1] - self.post_at[entry]
        p = ragged(self.post_at[entry], n)
        score = part + np.bincount(self.rows[p], np.repeat(value, n) * self.weights[p], len(part))
        if skip >= 0:
            score[skip] = 0
        least = max(np.partition(score, -k)[-k] - SLACK if len(score) > k else 0.0, 0.0)
        found = np.flatnonzero((score >= least) & (score > 0))
        index = self.index
        self.query[cols] = values
        size = index.at[found + 1] - index.at[found]
        p = ragged(index.at[found], size)
        cosine = np.round(np.bincount(np.repeat(np.arange(len(found)), size), self.query[index.cols[p]] * index.weights[p], len(found)), 12)
        self.query[cols] = 0
        top = np.lexsort((found, -cosine))[:k]
        return found[top], cosine[top]


_searches: list[Search] = []


def searching(index: Index) -> Search:
    """The lists of an index, made once in each worker."""
    if not _searches or _searches[0].index is not index:
        _searches[:] = [Search(index)]
    return _searches[0]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean x, level) of the rising steps through (x, y) by pooling adjacent violators; each level is drawn a little to one half."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of x, sum of y, number
    for a, b in zip(x[order], y[order]):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.maximum.accumulate([(b[1] + 0.5) / (b[2] + 1) for b in blocks]) if blocks else np.zeros(0)


def _similar_together(col: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int, v: int) -> np.ndarray:
    """New places of the examples: by the nearest of some sqrt(n) leaders, so that blocks have low bounds for unlike texts."""
    order = np.argsort(col, kind="stable")
    col, row, weight = col[order], row[order], weight[order]
    at, best, leader = np.searchsorted(col, np.arange(v + 1)), np.full(n, -1.0), np.zeros(n, np.int64)
    for i, lead in enumerate(range(0, n, max(1, int(n**0.5)))):
        own = row == lead
        c, x = col[own], weight[own]
        p = ragged(at[c], at[c + 1] - at[c])
        s = np.bincount(row[p], np.repeat(x, at[c + 1] - at[c]) * weight[p], n)
        leader[s > best] = i
        best = np.maximum(best, s)
    place = np.empty(n, np.int64)
    place[np.argsort(leader, kind="stable")] = np.arange(n)
    return place


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Index:
    """Index the labelled examples outside the held-out part: at most ``most`` of them, and ``most_bytes`` of texts.

    Every piece of an example's words is a term, weighed by its count and ln((n + 1) / (examples with it + 1)).  Pieces
    are counted where the texts are; the driver lays out their postings, which the sample bounds.
    Each example's vote by the others, found in tasks, calibrates the scores.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = persisted(labelled_sample(docs, labels, label, most, most_bytes))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch):
                at, term, count, _ = terms(part.column("text"))
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.ListArray.from_arrays(at, pa.array(term.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(count, pa.int32()))], ["doc_id", "y", "t", "n"])

    got = sample.mapInArrow(counted, f"doc_id {kind}, y int, t array<long>, n array<int>").toArrow().sort_by("doc_id").combine_chunks()
    flat = lambda c: (x := got.column(c).combine_chunks(), np.concatenate([[0], np.cumsum(np.asarray(x.value_lengths(), np.int64))]))[::-1]
    y, index = np.asarray(got.column("y"), float), Index()
    n = len(y)
    index.base = index.bare = float((y.sum() + 0.5) / (n + 1))
    if not n or y.min() == y.max():
        return index
    at, listed = flat("t")
    term, count = np.asarray(listed.flatten()).view(np.uint64), np.asarray(flat("n")[1].flatten(), np.int64)
    index.vocabulary, df = np.unique(term, return_counts=True)
    index.idf = np.log((n + 1) / (df + 1))
    at, col, value = index.vectors(at, term, count)
    size = np.diff(at)
    row = np.repeat(np.arange(n), size)
    place = _similar_together(col, row, value, n, len(index.vocabulary))
    back = np.argsort(place)
    index.y, index.ids = y[back], got.column("doc_id").combine_chunks().take(pa.array(back))
    p = ragged(at[back], size[back])
    index.at, index.cols, index.weights = np.concatenate([[0], np.cumsum(size[back])]), col[p].astype(np.int32), value[p]
    bare = size == 0
    index.bare = float((y[bare].sum() + 2 * index.base) / (bare.sum() + 2))
    shared, places = spark.sparkContext.broadcast(index), None

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal places
        index = shared.value
        places = places or {x: i for i, x in enumerate(index.ids.to_pylist())}
        for batch in batches:
            for part in byte_slices(batch):
                at, col, value = index.vectors(*terms(part.column("text"))[:3])
                own = [places[x] for x in part.column("doc_id").to_pylist()]
                near = searching(index).nearest(at, col, value, without=own)
                votes = [index.vote(*found) if b > a else None for a, b, found in zip(at[:-1], at[1:], near)]
                yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), part.column("y")], ["vote", "y"])

    voted = sample.mapInArrow(left_out, "vote double, y int").where("vote IS NOT NULL").toArrow().sort_by([("vote", "ascending"), ("y", "ascending")])
    index.votes, index.levels = isotonic(np.asarray(voted.column("vote"), float), np.asarray(voted.column("y"), float))
    return index


def score_toxicity(docs: DataFrame, index: Index, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence_ids, evidence_cosines of every document.

    Whole texts.  A text without a piece of any example (null and empty ones too) gets the rate of such examples,
    drawn to that of all.  Ids pass through (null, repeated); other columns are ignored; an empty table gives an
    empty result; without labels of both kinds every score is the smoothed rate.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(index)  # the postings of at most SAMPLE_BYTES of texts
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value, {}
        for batch in batches:
            for part in byte_slices(batch):
                at, col, value = index.vectors(*terms(part.column("text"))[:3])
                scores, taken, cosines, ends = [], [], [], [0]
                # copies are searched once; what is remembered changes no score
                keys = [hashlib.blake2b(col[a:b].tobytes() + value[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1], at[1:])]
                if len(known) > 50_000:
                    known = {}
                first: dict[bytes, int] = {}
                new = np.array([i for i, key in enumerate(keys) if key not in known and first.setdefault(key, i) == i], np.int64)
                size = np.diff(at)[new]
                p = ragged(at[new], size)
                for i, (e, s) in zip(new, searching(index).nearest(np.concatenate([[0], np.cumsum(size)]), col[p], value[p])):
                    known[keys[i]] = (index.calibrated(index.vote(e, s)) if len(e) else index.bare, e[:5], s[:5])
                for key in keys:
                    hit = known[key]
                    scores.append(hit[0])
                    taken.append(hit[1])
                    cosines.append(hit[2])
                    ends.append(ends[-1] + len(hit[1]))
                ends = pa.array(ends, pa.int32())
                ids = index.ids.take(pa.array(np.concatenate(taken), pa.int64())) if ends[-1].as_py() else pa.array([], index.ids.type)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(ends, ids),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(cosines), pa.float64()))], ["doc_id", "score", "evidence_ids", "evidence_cosines"])

    id_kind = kind if len(index.y) else "bigint"
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence_ids array<{id_kind}>, evidence_cosines array<double>")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence_ids", "evidence_cosines")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, train(docs, labels))
