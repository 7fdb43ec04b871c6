"""K-means: Lloyd iterations as aggregations, several runs at once."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.vectors import squared_distance


def nearest(point: Column, centers) -> Column:
    """``struct(cost, cluster)`` of the closest center; the first of equal ones.

    All centers are one literal, so the plan is as short for many as for few.
    """
    text = json.dumps([[float(x) for x in c] for c in centers])
    return F.array_min(F.transform(F.from_json(F.lit(text), "array<array<double>>"), lambda c, i: F.struct(squared_distance(point, c).alias("cost"), i.alias("cluster"))))


def assign(df: DataFrame, centers, features: str = "features") -> DataFrame:
    best = nearest(F.col(features).cast("array<double>"), centers)
    return df.withColumn("_best", best).withColumn("cluster", F.col("_best.cluster")).withColumn("cost", F.col("_best.cost")).drop("_best")


def cluster_sums(df: DataFrame, runs: dict[int, list], features: str = "features") -> DataFrame:
    """``(run, cluster, n, cost, s0, s1, ...)`` of one pass over the data for all runs."""
    dims = len(next(iter(runs.values()))[0])
    point = F.col("_p")
    base = df.select(F.col(features).cast("array<double>").alias("_p"))
    best = F.array(*[F.struct(F.lit(r).alias("run"), nearest(point, c).alias("best")) for r, c in runs.items()])
    rows = base.select("_p", F.inline(best))
    return rows.groupBy("run", F.col("best.cluster").alias("cluster")).agg(F.count("*").alias("n"), F.sum("best.cost").alias("cost"), *[F.sum(F.get("_p", F.lit(j))).alias(f"s{j}") for j in range(dims)])


def local_kmeans(points: np.ndarray, weights: np.ndarray, k: int, seed: int = 0, iterations: int = 30) -> np.ndarray:
    """Weighted k-means++ of a few candidate points, on the driver."""
    draw = np.random.default_rng(seed)
    cost = lambda cs: ((points[:, None, :] - cs[None, :, :]) ** 2).sum(axis=2)
    chance = weights / weights.sum() if weights.sum() > 0 else np.full(len(points), 1 / len(points))
    centers = [points[draw.choice(len(points), p=chance)]]
    while len(centers) < k:
        far = weights * cost(np.array(centers)).min(axis=1)
        centers.append(points[draw.choice(len(points), p=far / far.sum()) if far.sum() > 0 else draw.integers(len(points))])
    centers, seen = np.array(centers), None
    for _ in range(iterations):
        closest = cost(centers).argmin(axis=1)
        if seen is not None and (closest == seen).all():
            break
        seen = closest
        for i in range(k):
            own = weights * (closest == i)
            centers[i] = (own @ points) / own.sum() if own.sum() > 0 else points[draw.integers(len(points))]
    return centers


@dataclass(frozen=True)
class KMeansModel:
    centers: tuple[tuple[float, ...], ...]
    cost: float = float("nan")

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        return assign(df, self.centers, features)

    def compute_cost(self, df: DataFrame, features: str = "features") -> float:
        return assign(df, self.centers, features).agg(F.sum("cost")).first()[0] or 0.0

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, list(c)) for i, c in enumerate(self.centers)], "cluster_id int, center array<double>")


def _draw(df: DataFrame, n: int, seed: int, features: str) -> np.ndarray:
    """``n`` points at random, repeated if there are fewer: a sample of known size goes to the driver."""
    # By a hash of the point, so the draw is the same however rows are dealt.
    rows = df.select(F.col(features).cast("array<double>").alias("p")).orderBy(F.xxhash64("p", F.lit(seed)), "p").limit(n).collect()
    if not rows:
        raise ValueError("there are no points")
    points = np.array([r["p"] for r in rows])
    return points[np.arange(n) % len(points)]


def _init_parallel(df: DataFrame, k: int, runs: int, steps: int, seed: int, features: str) -> dict[int, np.ndarray]:
    """Candidates chosen with a chance in proportion to their cost, then reduced to k by local k-means++."""
    start = _draw(df, runs, seed, features)
    centers = {r: [start[r]] for r in range(runs)}
    points = df.select(F.col(features).cast("array<double>").alias("p"))
    for step in range(steps):
        costs = F.array(*[F.struct(F.lit(r).alias("run"), nearest(F.col("p"), c)["cost"].alias("cost")) for r, c in centers.items()])
        rows = points.select("p", F.inline(costs))
        total = {x["run"]: x["c"] for x in rows.groupBy("run").agg(F.sum("cost").alias("c")).collect()}
        share = F.lit(0.0)
        for r, c in total.items():
            share = F.when(F.col("run") == r, F.lit(2.0 * k / c if c else 0.0)).otherwise(share)
        # About 2k points per run and step.
        for x in rows.filter(F.rand(seed + 1 + step) < F.col("cost") * share).select("run", "p").collect():
            centers[x["run"]].append(np.array(x["p"]))
    weights = {(x["run"], x["cluster"]): x["n"] for x in cluster_sums(df, centers, features).select("run", "cluster", "n").collect()}
    return {r: local_kmeans(np.array(c), np.array([float(weights.get((r, i), 0)) for i in range(len(c))]), k, seed + r) for r, c in centers.items()}


def kmeans(df: DataFrame, k: int, iterations: int = 20, runs: int = 1, mode: str = "k-means||", steps: int = 5, epsilon: float = 1e-4, seed: int = 42, features: str = "features", initial=None) -> KMeansModel:
    """The cheapest of several runs. A run ends when no center moves by more than ``epsilon``.

    With ``initial``, a list of k centers, there is one run, which begins with them.
    """
    data = df.persist()
    try:
        if initial is not None:
            centers = {0: np.array(initial, dtype=float)}
        elif mode == "random":
            drawn = _draw(data, runs * k, seed, features)
            centers = {r: drawn[r * k : (r + 1) * k].copy() for r in range(runs)}
        elif mode == "k-means||":
            centers = _init_parallel(data, k, runs, steps, seed, features)
        else:
            raise ValueError(f"unknown initialisation: {mode}")
        active = set(centers)
        for _ in range(iterations):
            if not active:
                break
            moved = set()
            for row in cluster_sums(data, {r: centers[r] for r in active}, features).collect():
                new = np.array([row[f"s{j}"] for j in range(centers[row["run"]].shape[1])]) / row["n"]
                if ((new - centers[row["run"]][row["cluster"]]) ** 2).sum() > epsilon * epsilon:
                    moved.add(row["run"])
                centers[row["run"]][row["cluster"]] = new
            active = moved
        costs = {r["run"]: r["c"] for r in cluster_sums(data, centers, features).groupBy("run").agg(F.sum("cost").alias("c")).collect()}
    finally:
        data.unpersist()
    best = min(costs, key=lambda r: (costs[r], r))
    return KMeansModel(tuple(tuple(map(float, c)) for c in centers[best]), costs[best])
