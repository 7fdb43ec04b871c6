"""Generators of test data, seeded and distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.vectors import dot, literal


def _features(n: int, seed: int, normal: bool = True) -> Column:
    return F.array(*[(F.randn if normal else F.rand)(seed + 1 + j) for j in range(n)])


def known_tree(spark: SparkSession, n: int = 1000, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """``(label, x0, x1)``: the label is 1 where x0 >= 0.5 and x1 = 1; a share of labels is flipped."""
    rows = spark.range(n).select(F.rand(seed).alias("x0"), F.floor(F.rand(seed + 1) * 3).cast("double").alias("x1"), F.rand(seed + 2).alias("u"))
    label = ((F.col("x0") >= 0.5) & (F.col("x1") == 1.0)).cast("int")
    return rows.select(F.when(F.col("u") < noise, 1 - label).otherwise(label).cast("double").alias("label"), "x0", "x1")


def linear(spark: SparkSession, n: int, weights, intercept: float = 0.0, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """``(label, features)`` with Gaussian noise."""
    rows = spark.range(n).select(_features(len(weights), seed, normal=False).alias("f"), F.randn(seed).alias("e")).select(F.transform("f", lambda x: 2 * x - 1).alias("features"), "e")
    return rows.select((dot(F.col("features"), literal(weights)) + intercept + noise * F.col("e")).alias("label"), "features")


def logistic(spark: SparkSession, n: int, offset: float = 2.0, scale: float = -1.5, seed: int = 42) -> DataFrame:
    """``(label, features)``: one normal feature, logistic noise."""
    rows = spark.range(n).select(F.array(F.randn(seed)).alias("features"), F.rand(seed + 1).alias("u"))
    noisy = offset + scale * F.get("features", F.lit(0)) + F.log(F.col("u") / (1 - F.col("u")))
    return rows.select((noisy > 0).cast("double").alias("label"), "features")


def svm(spark: SparkSession, n: int, weights=(-1.5, 1.0), intercept: float = 0.01, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """``(label, features)``: the side of a plane, with Gaussian noise."""
    rows = spark.range(n).select(_features(len(weights), seed).alias("features"), F.randn(seed).alias("e"))
    return rows.select((dot(F.col("features"), literal(weights)) + intercept + noise * F.col("e") > 0).cast("double").alias("label"), "features")


def clusters(spark: SparkSession, n: int, k: int, dims: int, spread: float = 1.0, seed: int = 42) -> DataFrame:
    """``(features)``: points around k centers that lie on a lattice."""
    cluster = F.pmod(F.col("id"), F.lit(k))
    return spark.range(n).select(F.array(*[F.randn(seed + j) * spread + 10.0 * F.pmod(F.floor(cluster / 3**j), F.lit(3)) for j in range(dims)]).alias("features"))


def ratings(spark: SparkSession, users: int, items: int, rank: int, share: float = 0.7, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """``(user, item, rating)``: a share of the cells of a product of two random factors, with noise."""
    part = lambda c, s: F.array(*[F.pmod(F.xxhash64(F.col(c), F.lit(s + j)), F.lit(1 << 20)) / float(1 << 20) for j in range(rank)])
    cells = spark.range(users * items).select((F.col("id") / items).cast("int").alias("user"), (F.col("id") % items).cast("int").alias("item"), F.rand(seed).alias("u"), F.randn(seed + 1).alias("e"))
    return cells.filter(F.col("u") < share).select("user", "item", (dot(part("user", seed), part("item", seed + 1000)) + noise * F.col("e")).alias("rating"))
