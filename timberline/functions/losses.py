"""Loss statistics as column expressions over ``n, w, s, ss``.

``n`` counts samples, ``w`` sums weights, ``s`` and ``ss`` sum weighted labels
and squared labels. With unit weights the weighted formulas are the plain ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.exact import Grid

#: Probabilities this near to 0 or 1 count as pure.
P_MIN = 1e-10


def terms(label: Column, weight: Column | None = None) -> dict[str, Column]:
    """What ``w``, ``s`` and ``ss`` add up; unit weights are counted instead."""
    if weight is None:
        return {"s": label, "ss": label * label}
    return {"w": weight, "s": weight * label, "ss": weight * label * label}


def moments(label: Column, weight: Column | None = None) -> list[Column]:
    """The four aggregates."""
    w = F.lit(1.0) if weight is None else weight
    return [F.count("*").alias("n"), F.sum(w).cast("double").alias("w"), F.sum(w * label).alias("s"), F.sum(w * label * label).alias("ss")]


def exact_moments(grid: Grid) -> list[Column]:
    """The four aggregates over a grid's parts: ``n`` and whole numbers for the others."""
    counted = [] if "w" in grid.exponents else [F.count("*").cast("decimal(20,0)").alias("w")]
    return [F.count("*").alias("n"), *counted, *grid.sums()]


class Loss:
    name = ""

    def centroid(self, w: Column, s: Column) -> Column:
        """The constant response with the least error."""
        return F.when(w != 0, s / w)

    def error(self, w: Column, s: Column, ss: Column) -> Column:
        raise NotImplementedError

    def point(self, y: Column, predicted: Column) -> Column:
        """Loss of one prediction."""
        raise NotImplementedError


class SquareLoss(Loss):
    name = "square"

    def error(self, w, s, ss):
        return F.when(w != 0, ss - s * s / w).otherwise(0.0)

    def point(self, y, predicted):
        return (y - predicted) * (y - predicted)


class EntropyLoss(Loss):
    """Binary entropy in bits; labels are expected to be 0 or 1."""

    name = "entropy"

    def error(self, w, s, ss):
        p = F.when(w != 0, s / w)
        bits = -(p * F.log2(p) + (1.0 - p) * F.log2(1.0 - p))
        return F.when((p > P_MIN) & (p < 1.0 - P_MIN), w * bits).otherwise(0.0)

    def point(self, y, predicted):
        p = F.when(y == 1.0, predicted).otherwise(1.0 - predicted)
        return F.when(p > P_MIN, -F.log2(p)).otherwise(-F.log2(F.lit(P_MIN)))


LOSSES = {x.name: x for x in (SquareLoss(), EntropyLoss())}
