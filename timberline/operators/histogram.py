"""Node histograms: one aggregation per level, whatever the number of nodes and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.exact import Grid
from timberline.functions.losses import exact_moments, moments, terms


def histogram(binned: DataFrame, features: list[int], node: Column | None = None, label: str = "label", weight: str | None = None, grid: Grid | None = None) -> DataFrame:
    """``(node_id, feature_id, bin, n, w, s, ss)`` of binned data.

    Rows become one short record per feature and are aggregated before the
    shuffle, so what moves is bounded by nodes x bins, not by rows. With a grid,
    ``w``, ``s`` and ``ss`` are whole numbers in its steps.
    """
    y = F.col(f"`{label}`").cast("double")
    w = F.col(f"`{weight}`").cast("double") if weight else None
    cells = F.array(*[F.struct(F.lit(i).alias("feature_id"), F.col(f"b{i}").alias("bin")) for i in features])
    carried = grid.parts(terms(y, w)) if grid else [y.alias("_y"), (F.lit(1.0) if w is None else w).alias("_w")]
    melted = binned.select((F.lit(1) if node is None else node).alias("node_id"), *carried, F.inline(cells))
    return melted.groupBy("node_id", "feature_id", "bin").agg(*(exact_moments(grid) if grid else moments(F.col("_y"), F.col("_w"))))
