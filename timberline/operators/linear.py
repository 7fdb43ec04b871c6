"""Generalised linear models by mini-batch gradient descent.

An iteration is one aggregation of as many sums as there are features; weights
stay on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.vectors import dot, literal, sigmoid
from timberline.operators.prep import invalid_labels


def margin(features: str, weights, intercept: float = 0.0) -> Column:
    return dot(F.col(features), literal(weights)) + float(intercept)


#: (multiplier of the features, loss) for a margin and a label.
GRADIENTS = {
    "logistic": lambda m, y: (sigmoid(m) - y, F.when(y > 0, F.log1p(F.exp(-m))).otherwise(F.log1p(F.exp(-m)) + m)),
    "squared": lambda m, y: (m - y, 0.5 * (m - y) * (m - y)),
    "hinge": lambda m, y: (F.when((2 * y - 1) * m < 1, -(2 * y - 1)).otherwise(0.0), F.greatest(F.lit(0.0), 1 - (2 * y - 1) * m)),
}


def update(kind: str, weights: np.ndarray, gradient: np.ndarray, step: float, reg: float) -> tuple[np.ndarray, float]:
    """New weights and their penalty. ``step`` is already divided by the root of the iteration."""
    moved = weights - step * gradient
    if kind == "simple":
        return moved, 0.0
    if kind == "l1":
        shrunk = np.sign(moved) * np.maximum(0.0, np.abs(moved) - reg * step)
        return shrunk, reg * float(np.abs(shrunk).sum())
    if kind == "squared_l2":
        shrunk = moved / (2.0 * step * reg + 1.0)
        return shrunk, reg * float(shrunk @ shrunk)
    raise ValueError(f"unknown updater: {kind}")


def gradient_sums(df: DataFrame, gradient: str, weights, label: str = "label", features: str = "features") -> DataFrame:
    """One row: ``n``, the loss and ``g0, g1, ...``, the summed gradient."""
    multiplier, loss = GRADIENTS[gradient](F.col("_m"), F.col("_y"))
    rows = df.select(F.col(features).alias("_x"), F.col(label).cast("double").alias("_y"), margin(features, weights).alias("_m"))
    rows = rows.select("_x", multiplier.alias("_k"), loss.alias("_l"))
    return rows.agg(F.count("*").alias("n"), F.sum("_l").alias("loss"), *[F.sum(F.col("_k") * F.get("_x", F.lit(j))).alias(f"g{j}") for j in range(len(weights))])


def descend(df: DataFrame, gradient: str, updater: str, start, iterations: int, step: float, reg: float = 0.0, fraction: float = 1.0, label: str = "label", features: str = "features", seed: int = 42) -> tuple[np.ndarray, list[float]]:
    """Weights after the iterations, and the loss of each. An empty batch is skipped."""
    weights, history = np.asarray(start, dtype=float), []
    _, penalty = update(updater, weights, np.zeros_like(weights), 0.0, reg)
    for i in range(1, iterations + 1):
        batch = df if fraction >= 1.0 else df.sample(False, fraction, seed + i)
        row = gradient_sums(batch, gradient, weights, label, features).first()
        if not row["n"]:
            continue
        history.append(row["loss"] / row["n"] + penalty)
        weights, penalty = update(updater, weights, np.array([row[f"g{j}"] for j in range(len(weights))]) / row["n"], step / i**0.5, reg)
    return weights, history


@dataclass(frozen=True)
class LinearModel:
    weights: tuple[float, ...]
    intercept: float
    kind: str
    history: tuple[float, ...] = ()

    def score(self, features: str = "features") -> Column:
        return margin(features, self.weights, self.intercept)

    def predict(self, features: str = "features") -> Column:
        """A class for classifiers, else the margin."""
        if self.kind == "logistic":
            return F.when(sigmoid(self.score(features)) >= 0.5, 1.0).otherwise(0.0)
        if self.kind == "hinge":
            return F.when(self.score(features) >= 0.0, 1.0).otherwise(0.0)
        return self.score(features)


def train_linear(df: DataFrame, gradient: str, updater: str = "simple", iterations: int = 100, step: float = 1.0, reg: float = 0.0, fraction: float = 1.0, intercept: bool = True, initial=None, standardized: bool = False, validate: bool = True, label: str = "label", features: str = "features", seed: int = 42) -> LinearModel:
    """Fit a model. Weights begin at 1; the intercept is the weight of a constant column put first.

    ``standardized`` centres and scales the features and centres the label
    first, and undoes it in the result. Classifiers refuse labels other than 0
    and 1 unless ``validate`` is off.
    """
    if gradient in ("logistic", "hinge") and validate and invalid_labels(df, label):
        raise ValueError("classification labels must be 0 or 1")
    size = df.select(F.size(features)).first()[0]
    data = df.select(F.col(label).cast("double").alias(label), F.col(features).cast("array<double>").alias(features))
    mean, sd, shift = np.zeros(size), np.ones(size), 0.0
    if standardized:
        row = data.agg(F.avg(label).alias("m"), *[f(F.get(features, F.lit(j))).alias(f"{n}{j}") for n, f in (("a", F.avg), ("d", F.stddev_pop)) for j in range(size)]).first()
        mean, sd, shift = np.array([row[f"a{j}"] for j in range(size)]), np.array([row[f"d{j}"] or 1.0 for j in range(size)]), row["m"]
        data = data.select((F.col(label) - shift).alias(label), F.zip_with(F.zip_with(features, literal(mean), lambda x, m: x - m), literal(sd), lambda x, d: x / d).alias(features))
        intercept = False
    if intercept:
        data = data.withColumn(features, F.concat(F.array(F.lit(1.0)), F.col(features)))
    start = np.ones(size) if initial is None else np.asarray(initial, dtype=float)
    start = np.concatenate(([1.0], start)) if intercept and len(start) == size else start
    data = data.persist()
    try:
        weights, history = descend(data, gradient, updater, start, iterations, step, reg, fraction, label, features, seed)
    finally:
        data.unpersist()
    if intercept:
        return LinearModel(tuple(weights[1:]), float(weights[0]), gradient, tuple(history))
    weights = weights / sd
    return LinearModel(tuple(weights), float(shift - mean @ weights) if standardized else 0.0, gradient, tuple(history))


def logistic_regression(df: DataFrame, **options) -> LinearModel:
    return train_linear(df, "logistic", "simple", **options)


def linear_svm(df: DataFrame, reg: float = 1.0, **options) -> LinearModel:
    return train_linear(df, "hinge", "squared_l2", reg=reg, **options)


def linear_regression(df: DataFrame, **options) -> LinearModel:
    return train_linear(df, "squared", "simple", **options)


def lasso(df: DataFrame, reg: float = 1.0, **options) -> LinearModel:
    return train_linear(df, "squared", "l1", reg=reg, standardized=True, **options)


def ridge(df: DataFrame, reg: float = 1.0, **options) -> LinearModel:
    return train_linear(df, "squared", "squared_l2", reg=reg, standardized=True, **options)
