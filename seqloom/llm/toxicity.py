"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed n-grams of lower-cased code points. From a bounded sample
of labelled texts come, for each feature, the numbers of texts of either label that have it;
the ratio of their smoothed shares, as a logarithm, scales the feature. The features that tell
the labels apart best (by likelihood ratio) enter a logistic regression with an L2 penalty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.sources.shared import discard, stored

from .common import code_points, lowest, map_batches, widened

BITS = 22
SIZES = (3, 4, 5, 6)
#: Positions that are worked on at once.
STEP = 1 << 18
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def lowered(column: pa.Array) -> pa.Array:
    return pa.array([(x or "").lower() for x in column.to_pylist()], pa.large_string())


def slots(points: np.ndarray):
    """For each n-gram size the hashed feature at every position of the code points."""
    text = points.astype(np.uint64) + np.uint64(1)
    rolled = text.copy()
    for n in range(2, max(SIZES) + 1):
        if len(text) < n:
            return
        rolled = rolled[:-1] * MULTIPLIER + text[n - 1 :]
        if n in SIZES:
            yield n, ((rolled ^ (rolled >> np.uint64(29))) * MULTIPLIER >> np.uint64(64 - BITS)).astype(np.int32)


def present(points: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, feature), each once, sorted; `keep` tells which features count.

    STEP positions are worked on at once, so memory is bounded however long the texts are.
    """
    found = []
    stops = ends[1:] - 1  # behind each text stands one zero
    for lo in range(0, len(points), STEP):
        got = []
        for n, slot in slots(points[lo : lo + STEP + max(SIZES) - 1]):
            slot = slot[:STEP]
            at = np.arange(len(slot)) if keep is None else np.flatnonzero(keep[slot])
            owner = np.searchsorted(ends, at + lo, side="right") - 1
            inside = at + lo + n <= stops[owner]
            got.append((owner[inside] << BITS) | slot[at[inside]])
        if got:
            found.append(np.unique(np.concatenate(got)))
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


class Model:
    """Weights of the kept features; score() of texts."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.bias = bias
        self.keep = np.zeros(1 << BITS, np.uint8)
        self.keep[features] = 1
        order = np.argsort(features)
        self.features, self.weights = features[order], weights[order]

    def scores(self, column: pa.Array) -> np.ndarray:
        sums = np.full(len(column), self.bias)
        points, ends = code_points(lowered(column))
        row, feature = present(points, ends, self.keep)
        if len(row):
            sums += np.bincount(row, self.weights[np.searchsorted(self.features, feature)], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(sums, -500, 500)))


def log_count_ratios(positive: np.ndarray, negative: np.ndarray, n_positive: int, n_negative: int, alpha: float = 1.0) -> np.ndarray:
    """log of the smoothed share of positive texts with a feature over that of negative texts."""
    return np.log((positive + alpha) / (n_positive + 2 * alpha)) - np.log((negative + alpha) / (n_negative + 2 * alpha))


def likelihood_ratio_column(positive: Column, negative: Column, n_positive: int, n_negative: int) -> Column:
    """G statistic of feature against label, in the JVM, so that only the best features leave it."""
    total, has = float(n_positive + n_negative), positive + negative

    def term(k: Column, of: int, margin: Column) -> Column:
        return F.when(k > 0, k * F.ln(k * total / (float(of) * margin))).otherwise(0.0)

    cells = ((positive, n_positive, has), (negative, n_negative, has), (n_positive - positive, n_positive, total - has), (n_negative - negative, n_negative, total - has))
    return sum((2 * term(*c) for c in cells), F.lit(0.0))


def fit(rows: np.ndarray, columns: np.ndarray, ratios: np.ndarray, labels: np.ndarray, *, penalty: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on presence x ratio: weights of presence (scaled back), bias."""
    n, width = len(labels), len(ratios)
    scaled = ratios[columns]
    w, bias = np.zeros(width), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    m, v, rate = np.zeros(width + 1), np.zeros(width + 1), 0.05
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, scaled * w[columns], minlength=n), -50, 50)))
        off = (p - labels) / n
        g = np.append(np.bincount(columns, scaled * off[rows], minlength=width) + penalty * w, off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
        rate = 0.05 * (1 - step / steps)
    return w * ratios, bias


def train(docs: DataFrame, labels: DataFrame, training: Column, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample: int = 8000, longest: int = 50_000, features: int = 4096) -> Model:
    """A model from a bounded sample: the `sample` training labels whose ids hash lowest.

    `training` says which labels may be learned from. Repeated labels of an id count once, as
    their maximum; null labels don't count; sampled texts over `longest` bytes are passed over.
    Without labels of both kinds the model scores every text by their share alone.
    """
    known = labels.where(training & F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("label"))
    known = lowest(known, F.col("id"), sample, "id").withColumn("h", F.xxhash64("id"))
    bound = known.agg(F.max("h").alias("h")).first().h
    if bound is None:
        return Model(np.empty(0, np.int64), np.empty(0), 0.0)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    texts = texts.where((F.xxhash64("id") <= bound) & (F.octet_length("text") <= longest))
    # `known` has at most `sample` rows of two numbers: that side is safe to broadcast.
    texts = texts.join(F.broadcast(known), "id").select("label", "text").limit(2 * sample)
    texts = stored(texts.repartition(8), name="sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            row, feature = present(*code_points(lowered(batch.column(1))))
            for k in (0, 1):
                at, times = np.unique(feature[label[row] == k], return_counts=True)
                sums[k][at] += times.astype(np.int32)
                n[k] += int((label == k).sum())
        at = np.flatnonzero(sums.any(0))
        cols = [np.append(at, -1), np.append(sums[1][at], n[1]), np.append(sums[0][at], n[0])]
        for k in range(0, len(cols[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)].astype(np.int32)) for c in cols], names=["feature", "positive", "negative"])

    counted = map_batches(texts, count, "feature int, positive int, negative int").groupBy("feature").agg(F.sum("positive").alias("p"), F.sum("negative").alias("q"))
    counted = stored(counted.where("feature < 0 or p + q >= 4"), name="features")  # fewer texts tell little
    total = counted.where("feature < 0").first()
    if total is None or not total.p or not total.q:
        share = 0.0 if total is None or not total.p else 1.0
        discard(texts)
        return Model(np.empty(0, np.int64), np.empty(0), 20.0 if share else -20.0)
    gain = likelihood_ratio_column(F.col("p"), F.col("q"), total.p, total.q)
    best = counted.where("feature >= 0").orderBy(gain.desc(), "feature").limit(features).collect()
    best = np.array(sorted((r.feature, r.p, r.q) for r in best), float).reshape(-1, 3)
    chosen, ratios = best[:, 0].astype(np.int64), log_count_ratios(best[:, 1], best[:, 2], total.p, total.q)
    discard(counted)
    keep = np.zeros(1 << BITS, np.uint8)
    keep[chosen] = 1

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature = present(*code_points(lowered(batch.column(1))), keep)
            column = np.searchsorted(chosen, feature).astype(np.int32)
            lists = np.split(column, np.searchsorted(row, np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in lists], pa.binary())], names=["label", "columns"])

    sampled = sorted((bytes(r.columns), r.label) for r in map_batches(texts, pick, "label int, columns binary").collect())
    discard(texts)
    lists = [np.frombuffer(b, np.int32) for b, _ in sampled]
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    weights, bias = fit(rows, np.concatenate(lists), ratios, np.array([y for _, y in sampled], float))
    return Model(chosen, weights, bias)


def with_scores(docs: DataFrame, model: Model, *, text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """`docs` with score and predicted behind its own columns, in one pass without a join.

    Columns of these names are replaced. Nulls, empty and repeated rows: see scored().
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("score", "predicted")
    at, names = rows.columns.index(text_column), [*rows.columns, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=names)

    return map_batches(rows, run, widened(rows, score="double", predicted="int"))


def scored(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for each input row: the score of label 1, from 0 to 1.

    A null text counts as empty; an empty text has no feature and gets the bias alone. Whole
    texts count, whatever their length. Repeated rows and null ids stay; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return with_scores(rows, model, threshold=threshold).drop("text")
