"""Gradient boosting: trees on residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.encode import bin_columns
from timberline.plans.model import Forest, binned_test, encoded_test
from timberline.plans.tree import global_quantiles, grow
from timberline.session import materialise
from timberline.spec import FeatureSpec, ForestParams


def residuals(df: DataFrame, forest: Forest, label: str = "label", raw: bool = False) -> DataFrame:
    """``df`` with the label replaced by what the forest leaves of it."""
    return df.withColumn(label, F.col(f"`{label}`").cast("double") - forest.predict(raw))


def train_forest(encoded: DataFrame, features: list[FeatureSpec], params: ForestParams | None = None, label: str = "label", weight: str | None = None, feature_weights: list[float] | None = None, quantiles: dict[str, list[float]] | None = None, dictionaries: dict[str, dict[str, int]] | None = None, init_model: Forest | None = None) -> Forest:
    """Trees fitted one after the other to what the trees before leave of the label.

    Every response of a tree is multiplied by the shrinkage. With
    ``init_model``, training goes on from its residuals, and its trees come
    first in the result. With entropy loss the residuals leave {0, 1}; nodes
    whose mean does so have error 0 and stay leaves.

    Data is binned once. Residuals are written to the shared folder every
    ``persist_interval`` trees, which bounds the length of the plan.
    """
    params = params or ForestParams()
    data = encoded.filter(F.col(f"`{label}`").isNotNull())
    q = global_quantiles(data, features, params.tree) if quantiles is None else quantiles
    if init_model is not None:
        data = data.withColumn(label, F.col(f"`{label}`").cast("double") - sum((t.predict(encoded_test) for t in init_model.trees), F.lit(0.0)))
    binned = materialise(bin_columns(data, features, q).withColumn(label, F.col(f"`{label}`").cast("double")), "binned")
    trees = list(init_model.trees) if init_model else []
    for m in range(params.num_trees):
        tree = grow(binned, features, q, params.tree, label, weight, feature_weights).scaled(params.shrinkage)
        trees.append(tree.named(dictionaries or {}))
        if m + 1 < params.num_trees:
            binned = binned.withColumn(label, F.col(f"`{label}`") - tree.predict(binned_test))
            if (m + 1) % params.persist_interval == 0:
                binned = materialise(binned, "residuals")
    return Forest(tuple(trees), tuple(features))
