"""Preparing data: labels, weights, samples, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.spec import FeatureSpec


def binarize(df: DataFrame, label: str, threshold: float) -> DataFrame:
    """The label as 1 from the threshold on, else 0."""
    return df.withColumn(label, F.when(F.col(f"`{label}`").cast("double") >= threshold, 1).otherwise(0))


def step_weight(label: Column, thresholds: list[float], weights: list[float], legacy: bool = False) -> Column:
    """A weight per interval of the label: weights[i] below thresholds[i], the last one above all.

    ``legacy``: with several thresholds, a label takes the last weight whose
    threshold is above it rather than the first.
    """
    if len(weights) != len(thresholds) + 1:
        raise ValueError("there must be one weight more than thresholds")
    y = label.cast("double")
    steps = list(zip(thresholds, weights, strict=False))
    out = F.lit(float(weights[-1]))
    for t, w in steps if legacy else reversed(steps):
        out = F.when(y < t, F.lit(float(w))).otherwise(out)
    return out


def parse_weight_steps(lines: list[str]) -> tuple[list[float], list[float]]:
    """Lines alternate between a weight and the threshold up to which it holds."""
    numbers = [float(x) for x in lines if x.strip()]
    return numbers[1::2], numbers[0::2]


def attach_weights(df: DataFrame, label: str, thresholds: list[float], weights: list[float], name: str = "sample_weight", legacy: bool = False) -> DataFrame:
    """``df`` with the step weight as its last column."""
    return df.withColumn(name, step_weight(F.col(f"`{label}`"), thresholds, weights, legacy))


def feature_weights(names: list[str], included: list[str] | None = None, excluded: list[str] | None = None) -> list[tuple[str, int]]:
    """``(name, 0 or 1)`` per header line, the label first and always 1. Without ``included`` all are."""
    inside = set(included) if included else set(names[1:])
    inside -= set(excluded or [])
    return [(n, int(i == 0 or n in inside)) for i, n in enumerate(names)]


def without_ignored(df: DataFrame, features: list[FeatureSpec]) -> DataFrame:
    """``df`` without its ignored columns, so they are not even read."""
    return df.drop(*[f.name for f in features if f.kind == -1])


def sample(df: DataFrame, fraction: float, seed: int = 42, replace: bool = False) -> DataFrame:
    """Each row independently with probability ``fraction``; with ``replace``, a Poisson number of times."""
    return df.sample(replace, fraction, seed)


def keyed_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Rows whose key hashes below the fraction: the same rows in every run and engine."""
    # Reduced first, so that the product fits 64 bits for any key.
    small = F.pmod(F.col(f"`{key}`").cast("long"), F.lit(1 << 30))
    return df.filter(F.pmod(small * F.lit(2654435761), F.lit(4294967296)) < F.lit(int(fraction * 4294967296)))


#: Copies of a row that are numbered by one task at a time.
COPIES = 4096


def fixed_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """``n`` random rows: a distributed top-n by a hash of the row and the number of its copy.

    Copies are numbered and drawn one by one, so equal rows neither come nor
    go together, and the draw does not depend on the partitioning.
    """
    columns = [F.col(f"`{c}`") for c in [*keys, *(c for c in df.columns if c not in keys)]]
    counts = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    blocks = counts.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES)))).repartition(*columns, F.col("_block"))
    copies = blocks.withColumn("_copy", F.explode(F.sequence(F.col("_block") * COPIES, F.least(F.col("_n"), (F.col("_block") + 1) * COPIES) - 1)))
    drawn = copies.orderBy(F.xxhash64(F.lit(seed), *columns, F.col("_copy")), *columns, F.col("_copy")).limit(n)
    return drawn.select(*[F.col(f"`{c}`") for c in df.columns])


def subtract(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``df`` that do not occur in ``other``; other duplicates stay. Nulls equal nulls."""
    mine, gone = df.alias("mine"), other.distinct().alias("gone")
    test = F.lit(True)
    for c in df.columns:
        test = test & F.col(f"mine.`{c}`").eqNullSafe(F.col(f"gone.`{c}`"))
    return mine.join(gone, test, "left_anti")


def train_test_split(df: DataFrame, train_fraction: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A Bernoulli sample, and all rows that do not occur in it.

    The sample is drawn by a hash of the row, so both parts agree however
    often they are computed, and copies of a row stay together.
    """
    whole = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 30))
    inside = whole < int(train_fraction * (1 << 30))
    return df.filter(inside), df.filter(~inside)


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, mean, sd)`` with the population's standard deviation."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("column").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def standardize(df: DataFrame, columns: list[str], stats: dict[str, tuple[float, float]], label: str | None = None, label_mean: float = 0.0) -> DataFrame:
    """Columns centred and scaled (only centred where the deviation is 0), the label centred."""
    out = {c: (F.col(f"`{c}`").cast("double") - stats[c][0]) / (stats[c][1] or 1.0) for c in columns}
    if label:
        out[label] = F.col(f"`{label}`").cast("double") - label_mean
    return df.withColumns(out)


def invalid_labels(df: DataFrame, label: str = "label") -> int:
    """How many labels are neither 0 nor 1."""
    return df.filter(~F.coalesce(F.col(f"`{label}`").cast("double").isin(0.0, 1.0), F.lit(False))).count()
