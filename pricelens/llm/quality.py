"""Operator 3: document quality by a generalised additive model with pairwise interactions.

Each text becomes a fixed list of counts and ratios. Shallow trees on one feature at a time are boosted in
turn, each added into that feature's lookup table over quantile bins; then the pairs of features with the
greatest remaining gain get tables of their own the same way. A score is the logistic function of a sum of
table entries, added up for whole batches.

Labels are taken from at most ``max_rows`` labelled documents, in the order of a hash of their id; held-out folds
are never used. Null and empty texts are scored like any other, by the bins of their zeros. Without labels of
both kinds the score is the share of good labels (0.5 without labels). Rows that share a doc_id are scored
each by its own text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricelens.llm.common import crc_of_id, first_by_hash, map_batches, text_list

MAX_ROWS = 40_000
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE, LEAST_ROWS = 150, 60, 0.15, 1.0, 8
THRESHOLD = 0.3

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "bar": b"|", "bang": b"!", "dot": b".", "comma": b",",
    "symbol": b"*#$%&@^~+=<>\\/_", "bracket": b"()[]{}", "quote": b"\"'`", "other": b"?:;-", "space": b" \t\x0b\x0c\r", "line": b"\n", "high": bytes(range(128, 256)),
}
FEATURES = (
    "log_bytes", "log_words", "word_length", *_CLASSES, "distinct_words", "top_word", "repeated_next", "distinct_pairs", "distinct_lines", "words_a_line", "log_longest_word",
)


def features(text: str) -> list[float]:
    """The values of FEATURES for one whole text."""
    data = text.encode("utf-8")
    n = len(data)
    words = text.split()
    w = len(words)
    shares = [(n - len(data.translate(None, c))) / n if n else 0.0 for c in _CLASSES.values()]
    if not w:
        return [np.log1p(n), 0.0, 0.0, *shares, *[0.0] * (len(FEATURES) - 3 - len(shares))]
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    following = words[1:]
    return [
        np.log1p(n), np.log1p(w), n / w, *shares,
        len(counts) / w, max(counts.values()) / w,
        sum(map(eq, words, following)) / w,
        len(set(zip(words, following))) / max(1, w - 1),
        len(set(lines)) / max(1, len(lines)), np.log1p(w / max(1, len(lines))),
        np.log1p(max(map(len, counts))),
    ]


def _split_gain(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain of a cut behind each position along the last axis, and whether both sides have rows enough."""
    left_g, left_h, left_n = (np.cumsum(v, axis=-1)[..., :-1] for v in (g, h, n))
    all_g, all_h, all_n = (v.sum(axis=-1, keepdims=True) for v in (g, h, n))
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
    return gain, (left_n >= LEAST_ROWS) & (all_n - left_n >= LEAST_ROWS)


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(RATE * g.sum() / (h.sum() + RIDGE))


def line_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree of at most ``depth`` levels over ordered bins, as an entry for each bin."""
    if depth and len(g) > 1:
        gain, fair = _split_gain(g, h, n)
        gain = np.where(fair, gain, -1.0)
        at = int(gain.argmax())
        if gain[at] > 1e-6:
            return np.concatenate([line_tree(g[: at + 1], h[: at + 1], n[: at + 1], depth - 1), line_tree(g[at + 1 :], h[at + 1 :], n[at + 1 :], depth - 1)])
    return np.full(len(g), _leaf(g, h))


def plane_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """A cut along one axis, then one along the other on each side: the entries and the gain."""
    best, best_gain = np.full(g.shape, _leaf(g, h)), 0.0
    for turned in (False, True):
        a, b, c = (v.T for v in (g, h, n)) if turned else (g, h, n)
        for at in range(1, len(a)):
            out, total = np.empty(a.shape), 0.0
            for side in (slice(None, at), slice(at, None)):
                sg, sh, sn = a[side].sum(axis=0), b[side].sum(axis=0), c[side].sum(axis=0)
                out[side] = line_tree(sg, sh, sn, 1)
                gain, fair = _split_gain(sg, sh, sn)
                total += sg.sum() ** 2 / (sh.sum() + RIDGE) + max(0.0, float(np.where(fair, gain, 0.0).max()))
            total -= a.sum() ** 2 / (b.sum() + RIDGE)
            if total > best_gain:
                best, best_gain = out.T.copy() if turned else out, total
    return best, best_gain


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; scores whole batches by additions."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += values[np.searchsorted(edges, x[:, k], side="right")]
        for (i, j), values in zip(self.pairs, self.pair_tables, strict=True):
            out += values[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of single features, then of the pairs with the greatest gain left."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return AdditiveModel(float(np.log(share / (1 - share))))
    share = y.mean()
    model = AdditiveModel(float(np.log(share / (1 - share))))
    model.edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    rows = [np.bincount(b, minlength=len(e) + 1) for b, e in zip(bins, model.edges, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    logit = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = slopes()
            size = len(rows[k])
            step = line_tree(np.bincount(b, g, size), np.bincount(b, h, size), rows[k])
            model.tables[k] += step
            logit += step[b]

    model.pair_edges = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.pair_edges)]

    def plane(i: int, j: int, values: np.ndarray | None) -> np.ndarray:
        shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
        return np.bincount(coarse[i] * shape[1] + coarse[j], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -plane_tree(plane(*p, g), plane(*p, h), plane(*p, None))[1])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros(plane(*p, None).shape) for p in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), values in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step, _ = plane_tree(plane(i, j, g), plane(i, j, h), plane(i, j, None))
            values += step
            logit += step[coarse[i], coarse[j]]
    return model


def labelled(labels: DataFrame, column: str, modulus: int, held_out: int, max_rows: int) -> DataFrame:
    """(doc_id, y) of at most ``max_rows`` labelled ids outside the held-out fold, by a hash of the id; of repeated labels the largest."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.filter(crc_of_id("doc_id", modulus) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    return first_by_hash(known, F.xxhash64("doc_id"), max_rows, known.count())


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, modulus: int = 5, held_out: int = 0) -> AdditiveModel:
    sample = labelled(labels, "quality", modulus, held_out, max_rows)
    # at most ``max_rows`` ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": pa.array([features(t) for t in text_list(batch)], pa.list_(pa.float64()))})

    rows = map_batches(texts, run, "doc_id long, y int, x array<double>").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["y"].to_numpy(float))


def score_documents(docs: DataFrame, model: AdditiveModel, *, threshold: float = THRESHOLD, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in text_list(batch)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(model.score(x))})

    scored = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")
    return scored.select("doc_id", (crc_of_id("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AdditiveModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in text_list(batch)], float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return map_batches(docs, run, fields)
