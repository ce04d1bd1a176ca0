"""Linear classifiers on TF-IDF vectors - logistic regression and linear SVM - with grids and folds.

All models of a grid - each penalty on each fold's rest, and on all rows - are fitted in step: every
pass over the rows gives the loss and the gradient of all of them, tasks send one row a model, which are
summed in two stages, and the driver holds only the models' weights (``MOST_WEIGHTS`` at most, checked). A grid so
takes as many passes as its slowest model, not the sum of all. Steps are those of L-BFGS.

Penalties follow ``C``: half the squared weights, without the intercept, and ``C`` times the losses. The
hinge of the SVM is rounded within ``ROUND`` of its corner. The radial kernel and calibrated
probabilities are not offered; the raw score serves for ROC curves.

Rows without a known term score by the intercept; rows without label do not train; an empty table gives
zero weights; ties in the folds' mean score go to the first penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paigham.storage import by_row, cut

GRID, SVM_GRID = (0.001, 0.01, 0.1, 1.0, 10.0), (0.1, 1.0, 10.0)
#: Features times models that the driver and the tasks may hold, and steps that L-BFGS remembers.
MOST_WEIGHTS, MEMORY = 50_000_000, 8
ROUND = 0.1


def vectors(rows: DataFrame, weighted: DataFrame, vocab: DataFrame, *carry: str) -> DataFrame:
    """``(row_id, label, i, v)`` and the columns to carry: places and weights of each row's terms; label 1 is Scam. Written once, for many passes."""
    entry = F.struct(F.col("idx").cast("int").alias("i"), F.col("weight").alias("v"))
    pairs = weighted.join(vocab.select("term", "idx"), "term").groupBy("row_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    entries = F.coalesce("e", F.array().cast("array<struct<i:int,v:double>>"))
    return cut(by_row(rows).join(pairs, "row_id", "left").withColumn("e", entries).select("row_id", *carry, (F.col("status") == "Scam").cast("double").alias("label"), F.col("e.i").alias("i"), F.col("e.v").alias("v")))


def _scores(batch: pa.RecordBatch, weights: np.ndarray) -> np.ndarray:
    """Rows x models; the last weight of a model is its intercept."""
    places, values = batch.column("i"), batch.column("v")
    out = np.repeat(weights[None, :, -1], batch.num_rows, axis=0)
    of = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
    flat, v = places.flatten().to_numpy(), values.flatten().to_numpy()
    for m in range(len(weights)):
        out[:, m] += np.bincount(of, weights=weights[m, flat] * v, minlength=batch.num_rows)
    return out


def _loss(margin: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its slope by the margin."""
    if kind == "logistic":
        return np.logaddexp(0, -margin), -1 / (1 + np.exp(np.clip(margin, -500, 500)))
    short = 1 - margin
    bent = np.clip(short + ROUND, 0, 2 * ROUND)
    return np.where(short > ROUND, short, bent * bent / (4 * ROUND)), -np.where(short > ROUND, 1.0, bent / (2 * ROUND))


def _pass(data: DataFrame, weights: np.ndarray, fold: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each model the sums of loss and gradient over the rows of its training set, and their number."""
    size = weights.shape[1]

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(weights), size + 2))
        for batch in batches:
            side = 2 * batch.column("label").to_numpy() - 1
            used = batch.column("fold").to_numpy()[:, None] != fold[None, :]
            loss, slope = _loss(_scores(batch, weights) * side[:, None], kind)
            slope *= used * side[:, None]
            places, v = batch.column("i"), batch.column("v").flatten().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
            flat = places.flatten().to_numpy()
            for m in range(len(weights)):
                sums[m, : size - 1] += np.bincount(flat, weights=slope[of, m] * v, minlength=size - 1)
            sums[:, size - 1] += slope.sum(0)
            sums[:, size] += (loss * used).sum(0)
            sums[:, size + 1] += used.sum(0)
        yield _rows(sums)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(weights), size + 2))
        for batch in batches:
            for m, x in zip(batch.column("m").to_pylist(), batch.column("x"), strict=True):
                sums[m] += x.values.to_numpy()
        yield _rows(sums)

    parts = data.select("label", "fold", "i", "v").mapInArrow(gradients, "m int, x array<double>")
    few = max(1, int(data.rdd.getNumPartitions() ** 0.5))
    if few > 3:
        parts = parts.repartition(few).mapInArrow(added, "m int, x array<double>")
    total = np.zeros((len(weights), size + 2))
    for r in parts.toArrow().to_batches():
        for m, x in zip(r.column("m").to_pylist(), r.column("x"), strict=True):
            total[m] += x.values.to_numpy()
    return total[:, size], total[:, :size], total[:, size + 1]


def _rows(sums: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.ListArray.from_arrays(offsets, sums.ravel())], ["m", "x"])


def _direction(g: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The step of L-BFGS for one model."""
    q, alphas = g.copy(), []
    for s, y in reversed(history):
        a = (s @ q) / (s @ y)
        alphas.append(a)
        q -= a * y
    if history:
        s, y = history[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(history, reversed(alphas), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def minimized(data: DataFrame, size: int, costs: np.ndarray, fold: np.ndarray, kind: str, iterations: int = 1000, tolerance: float = 1e-4) -> np.ndarray:
    """Weights of models in step: of each the penalty and the fold that it does not see."""
    if size * len(costs) > MOST_WEIGHTS:
        raise ValueError(f"{len(costs)} models of {size} features are too many for the driver: use max_features")
    models = len(costs)
    w = np.zeros((models, size + 1))

    def value(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        loss, gradient, n = _pass(data, at, fold[which], kind)
        n = np.maximum(n, 1)
        penalty = 1 / (costs[which] * n)
        own = at * np.append(np.ones(size), 0)
        return loss / n + penalty * (own * own).sum(1) / 2, gradient / n[:, None] + penalty[:, None] * own

    f, g = value(w, np.arange(models))
    history: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(models)]
    d = np.array([_direction(x, h) for x, h in zip(g, history, strict=True)])
    t = 1 / np.maximum(1.0, np.linalg.norm(g, axis=1))
    going = np.abs(g).max(1) > tolerance
    for _ in range(iterations):
        if not going.any():
            break
        # Models that are at their minimum take no part in the pass.
        which = np.flatnonzero(going)
        tried, f2, g2 = w.copy(), f.copy(), g.copy()
        tried[which] += t[which, None] * d[which]
        f2[which], g2[which] = value(tried[which], which)
        for m in which:
            if f2[m] > f[m] + 1e-4 * t[m] * (g[m] @ d[m]):
                t[m] /= 2
                going[m] = t[m] > 1e-8
                continue
            s, y = tried[m] - w[m], g2[m] - g[m]
            if s @ y > 1e-12:
                history[m] = [*history[m], (s, y)][-MEMORY:]
            less = f[m] - f2[m]
            w[m], f[m], g[m], t[m] = tried[m], f2[m], g2[m], 1.0
            d[m] = _direction(g[m], history[m])
            going[m] = np.abs(g[m]).max() > tolerance and less > 1e-7 * max(1.0, f[m])
    return w


@dataclass(frozen=True)
class Tuned:
    """The best penalty's model on all rows, and the folds' scores of each penalty."""

    cost: float
    weights: np.ndarray
    scores: dict[float, list[float]]


def _weighted_f1(counts: np.ndarray) -> float:
    tp, fp, fn, tn = counts
    f = lambda hit, a, b: 2 * hit / (2 * hit + a + b) if hit else 0.0
    n = tp + fp + fn + tn
    return float((f(tp, fp, fn) * (tp + fn) + f(tn, fn, fp) * (tn + fp)) / n) if n else 0.0


def _fold_counts(data: DataFrame, weights: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Of each model true and false, positive and negative, on the fold it has not seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(weights), 4))
        for batch in batches:
            yes, right = _scores(batch, weights) > 0, batch.column("label").to_numpy()[:, None] > 0
            held = batch.column("fold").to_numpy()[:, None] == fold[None, :]
            sums += np.stack([(held & a & b).sum(0) for a, b in ((yes, right), (yes, ~right), (~yes, right), (~yes, ~right))], axis=1)
        yield _rows(sums)

    long = data.select("label", "fold", "i", "v").mapInArrow(run, "m int, x array<double>").select("m", F.posexplode("x").alias("k", "x")).groupBy("m", "k").agg(F.sum("x").alias("x"))
    out = np.zeros((len(weights), 4))
    for r in long.collect():
        out[r["m"], r["k"]] = r["x"]
    return out


def tune(data: DataFrame, size: int, costs: tuple[float, ...] = GRID, k: int = 5, kind: str = "logistic", iterations: int = 1000) -> Tuned:
    """Every penalty on every fold and on all rows; ``data`` has the column ``fold`` from 0 to ``k`` - 1."""
    each = np.array([c for c in costs for _ in range(k + 1)])
    fold = np.array([f for _ in costs for f in (*range(k), -1)])
    weights = minimized(data, size, each, fold, kind, iterations)
    counts = _fold_counts(data, weights, fold)
    scores = {c: [_weighted_f1(counts[i]) for i in np.flatnonzero((each == c) & (fold >= 0))] for c in costs}
    best = max(costs, key=lambda c: float(np.mean(scores[c])))
    return Tuned(best, weights[int(np.flatnonzero((each == best) & (fold < 0))[0])], scores)


def predictions(tuned: Tuned, data: DataFrame) -> DataFrame:
    """``(row_id, status, prediction, score)`` of a fitted model; the score is the probability of Scam, or a number that orders as it does."""
    weights = tuned.weights[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("label"), pa.array(_scores(batch, weights)[:, 0])], ["row_id", "label", "z"])

    name = lambda c: F.when(c, "Scam").otherwise("Genuine")
    return data.select("row_id", "label", "i", "v").mapInArrow(run, "row_id bigint, label double, z double").select("row_id", name(F.col("label") == 1).alias("status"), name(F.col("z") > 0).alias("prediction"), (1 / (1 + F.exp(-F.col("z")))).alias("score"))
