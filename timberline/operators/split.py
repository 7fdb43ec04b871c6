"""Best splits of histograms, as one window query.

Empty bins are absent. Continuous bins are ordered by bin, categorical ones by
centroid and bin. Every cut between two bins is tried; the first with the least
error of both sides wins. Of the features, the greatest weighted gain wins.
Errors and gains are compared after rounding to nine significant digits, so the
order in which a distributed sum was added up decides nothing; ties go to the
first cut and to the lowest feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timberline.functions.exact import Grid
from timberline.functions.losses import Loss


def stable(x: Column) -> Column:
    """``x`` rounded to nine significant digits."""
    magnitude = F.pow(F.lit(10.0), 8 - F.floor(F.log10(F.abs(x))))
    return F.when(F.abs(x) < 1e-300, 0.0).otherwise(F.floor(x * magnitude + 0.5) / magnitude)


def cuts(hist: DataFrame, loss: Loss, categorical: list[int], grid: Grid | None = None) -> DataFrame:
    """Every bin of every (node, feature) with its place, both sides' sums and the error of a cut behind it.

    The right side has a scan of its own: a difference of sums would bring back
    the rounding that makes ties unstable. Sums of a histogram on a grid are
    added up as whole numbers and become doubles last.
    """
    value = grid.value if grid else lambda name, total: total
    kind = F.col("feature_id").isin(categorical) if categorical else F.lit(False)
    key = F.when(kind, loss.centroid(value("w", F.col("w")), value("s", F.col("s")))).otherwise(F.col("bin").cast("double"))
    keyed = hist.withColumn("key", key)
    group = W.partitionBy("node_id", "feature_id")
    forward, backward = group.orderBy("key", "bin"), group.orderBy(F.col("key").desc(), F.col("bin").desc())
    left, right = forward.rowsBetween(W.unboundedPreceding, 0), backward.rowsBetween(W.unboundedPreceding, -1)
    sums = {}
    for c in ("n", "w", "s", "ss"):
        sums[f"l_{c}"] = F.sum(c).over(left)
        sums[f"r_{c}"] = F.sum(c).over(right)
        sums[f"t_{c}"] = F.sum(c).over(group)
    out = keyed.withColumns(sums | {"pos": F.row_number().over(forward) - 1, "bins": F.count("*").over(group)})
    if grid:
        out = out.withColumns({f"{p}_{c}": grid.value(c, F.col(f"{p}_{c}")) for p in "lrt" for c in ("w", "s", "ss")})
    side = lambda p: loss.error(F.col(f"{p}_w"), F.col(f"{p}_s"), F.col(f"{p}_ss"))
    return out.withColumn("node_error", side("t")).withColumn("split_error", F.when(F.col("pos") < F.col("bins") - 1, side("l") + side("r")))


def best_per_feature(hist: DataFrame, loss: Loss, categorical: list[int], with_bins: bool = True, grid: Grid | None = None) -> DataFrame:
    """One row per (node, feature): its best cut.

    A feature with one bin has no cut: its split error is the node's error and
    its gain 0. ``left_bins`` and ``right_bins`` are given for categorical features.
    """
    tried = cuts(hist, loss, categorical, grid)
    order = W.partitionBy("node_id", "feature_id").orderBy(stable(F.coalesce("split_error", "node_error")), F.col("split_error").isNull(), "pos")
    best = tried.withColumn("rank", F.row_number().over(order))
    if with_bins and categorical:
        # Only categorical bins are gathered, and as bare integers.
        whole = W.partitionBy("node_id", "feature_id")
        item = F.when(F.col("feature_id").isin(categorical), F.struct("pos", "bin"))
        best = best.withColumn("all_bins", F.collect_list(item).over(whole))
        inside = lambda test: F.array_sort(F.transform(F.filter("all_bins", test), lambda x: x["bin"]))
        best = best.filter("rank = 1").withColumn("left_bins", inside(lambda x: x["pos"] <= F.col("pos"))).withColumn("right_bins", inside(lambda x: x["pos"] > F.col("pos"))).drop("all_bins")
    else:
        none = F.array().cast("array<int>")
        best = best.filter("rank = 1").withColumn("left_bins", none).withColumn("right_bins", none)
    best = best.withColumn("split_error", F.coalesce("split_error", "node_error"))
    return best.withColumn("gain", F.col("node_error") - F.col("split_error")).drop("rank", "key", "n", "w", "s", "ss")


def best_splits(hist: DataFrame, loss: Loss, categorical: list[int], feature_weights: dict[int, float] | None = None, grid: Grid | None = None) -> DataFrame:
    """One row per node: the feature with the greatest weighted gain, lowest id on ties. ``gain`` is unweighted."""
    per = best_per_feature(hist, loss, categorical, grid=grid)
    weight = F.lit(1.0)
    for feature, value in (feature_weights or {}).items():
        weight = F.when(F.col("feature_id") == feature, F.lit(float(value))).otherwise(weight)
    order = W.partitionBy("node_id").orderBy(stable(F.col("gain") * weight).desc(), "feature_id")
    return per.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")
