"""Alternating least squares on explicit ratings, with the plain ridge term."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.vectors import dot
from timberline.session import materialise, ship


def normal_equations(ratings: DataFrame, factors: DataFrame, by: str, other: str, rank: int, rating: str = "rating") -> DataFrame:
    """``(by, n, a00, a01, ..., b0, ...)``: per id, the sums of x x' (upper half) and of rating times x.

    ``factors`` is ``(id, factors)`` of the other side. Sums are formed before the shuffle by ``by``. The join by ``other`` shuffles
    ratings where the factors are too large to broadcast; a popular id is split there (AQE skew join).
    """
    rows = ratings.join(factors.withColumnRenamed("id", other), other).select(F.col(by).alias("id"), F.col(rating).cast("double").alias("_r"), F.col("factors").alias("_x"))
    x = [F.get("_x", F.lit(i)) for i in range(rank)]
    upper = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(rank) for j in range(i, rank)]
    return rows.groupBy("id").agg(F.count("*").alias("n"), *upper, *[F.sum(F.col("_r") * x[i]).alias(f"b{i}") for i in range(rank)])


def solve(equations: DataFrame, rank: int, reg: float) -> DataFrame:
    """``(id, factors)``: each id's small linear system, many at a time."""
    kind = equations.schema["id"].dataType.simpleString()

    def run(batches):
        where = [(i, j) for i in range(rank) for j in range(i, rank)]
        for batch in batches:
            a = np.zeros((batch.num_rows, rank, rank))
            for i, j in where:
                a[:, i, j] = a[:, j, i] = batch.column(f"a{i}_{j}").to_numpy(zero_copy_only=False)
            a += reg * np.eye(rank)
            b = np.stack([batch.column(f"b{i}").to_numpy(zero_copy_only=False) for i in range(rank)], axis=1)
            x = np.linalg.solve(a, b[:, :, None])[:, :, 0] if reg > 0 else np.stack([np.linalg.lstsq(p, q, rcond=None)[0] for p, q in zip(a, b, strict=True)]) if batch.num_rows else b
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "factors"])

    ship(equations.sparkSession)
    return equations.drop("n").mapInArrow(run, f"id {kind}, factors array<double>")


@dataclass(frozen=True)
class FactorModel:
    users: DataFrame
    items: DataFrame

    def predict(self, pairs: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
        """``pairs`` with ``prediction``; pairs with an unknown side are left out."""
        u, i = self.users.select(F.col("id").alias(user), F.col("factors").alias("_u")), self.items.select(F.col("id").alias(item), F.col("factors").alias("_i"))
        return pairs.join(u, user).join(i, item).withColumn("prediction", dot(F.col("_u"), F.col("_i"))).drop("_u", "_i")

    def lookup(self, user, item) -> float | None:
        """One prediction."""
        row = self.users.filter(F.col("id") == user).select(F.col("factors").alias("u")).join(self.items.filter(F.col("id") == item).select(F.col("factors").alias("i"))).select(dot(F.col("u"), F.col("i"))).first()
        return row[0] if row else None


def als(ratings: DataFrame, rank: int, iterations: int = 10, reg: float = 0.01, seed: int = 42, user: str = "user", item: str = "item", rating: str = "rating", start: DataFrame | None = None) -> FactorModel:
    """Factors of users and items. Starting factors of users are ``start (id, factors)``, or follow from the ids and the seed alone."""
    data = ratings.select(user, item, rating).na.drop().persist()
    parts = F.array(*[F.abs(F.pmod(F.xxhash64(F.col("id"), F.lit(seed + j)), F.lit(1 << 20)) / float(1 << 20)) + 1e-3 for j in range(rank)])
    users = data.select(F.col(user).alias("id")).distinct().withColumn("factors", F.transform(parts, lambda x: x / (rank**0.5))) if start is None else start
    items = None
    try:
        for i in range(iterations):
            items = solve(normal_equations(data, users, item, user, rank, rating), rank, reg)
            items = materialise(items, "items") if i % 2 else items
            users = materialise(solve(normal_equations(data, items, user, item, rank, rating), rank, reg), "users")
        items = materialise(solve(normal_equations(data, users, item, user, rank, rating), rank, reg), "items") if items is None else materialise(items, "items")
    finally:
        data.unpersist()
    return FactorModel(users, items)
