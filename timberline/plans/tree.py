"""Growing trees level by level: one job per level and batch of nodes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.exact import Grid
from timberline.functions.losses import LOSSES, Loss, exact_moments, moments, terms
from timberline.operators.encode import bin_columns, collect_quantiles, quantile_table
from timberline.operators.histogram import histogram
from timberline.operators.split import best_splits
from timberline.plans.model import Forest, Node, Tree, binned_test
from timberline.spec import CATEGORICAL, CONTINUOUS, FeatureSpec, TreeParams

#: Slack of gain comparisons (fixed value).
GAIN_SLACK = 1e-7


def global_quantiles(encoded: DataFrame, features: list[FeatureSpec], params: TreeParams) -> dict[str, list[float]]:
    own = [f.name for f in features if f.kind == CONTINUOUS]
    return collect_quantiles(quantile_table(encoded, own, params.max_quantiles)) if own else {}


def _numbers(loss: Loss, w: float, s: float, ss: float) -> tuple[float, float]:
    """Response and error of one node, on the driver."""
    from math import log2

    from timberline.functions.losses import P_MIN

    if not w:
        return 0.0, 0.0
    if loss.name == "square":
        return s / w, ss - s * s / w
    p = s / w
    return p, -w * (p * log2(p) + (1 - p) * log2(1 - p)) if P_MIN < p < 1 - P_MIN else 0.0


def grow(binned: DataFrame, features: list[FeatureSpec], quantiles: dict[str, list[float]], params: TreeParams, label: str = "label", weight: str | None = None, feature_weights: list[float] | None = None) -> Tree:
    """A tree over binned data.

    The driver sees a few numbers per node. A row's node is computed from the
    tree grown so far, so the data itself is never rewritten. A child's sums
    are those of its side of the parent's split, so leaves need no pass of their own.
    Sums are exact on a grid, so a tree does not depend on how rows are dealt to tasks.
    """
    loss = LOSSES[params.loss]
    usable = [i for i, f in enumerate(features) if f.kind in (CONTINUOUS, CATEGORICAL)]
    categorical = [i for i in usable if features[i].kind == CATEGORICAL]
    weights = dict(enumerate(feature_weights)) if feature_weights else None
    y = F.col(f"`{label}`").cast("double")
    w = F.col(f"`{weight}`").cast("double") if weight else None
    grid = Grid.of(binned, terms(y, w))
    if grid:
        whole = binned.select(*grid.parts(terms(y, w))).agg(*exact_moments(grid))
        root = whole.select("n", *[grid.value(c, F.col(c)).alias(c) for c in ("w", "s", "ss")]).first()
    else:
        root = binned.agg(*moments(y, w)).first()
    response, error = _numbers(loss, root["w"] or 0.0, root["s"] or 0.0, root["ss"] or 0.0)
    nodes = {1: Node(1, 0, root["n"], root["w"] or 0.0, response, error)}
    least = params.min_gain_fraction * error
    for level in range(params.max_depth):
        open_ids = [i for i, n in nodes.items() if n.depth == level and n.count >= max(2, params.min_count) and n.weight >= params.min_weight]
        for at in range(0, len(open_ids) if usable else 0, params.batch_size):
            batch = open_ids[at : at + params.batch_size]
            place = Tree(nodes).leaf_of(binned_test)
            rows = binned.withColumn("_node", place).filter(F.col("_node").isin(batch)) if level else binned
            hist = histogram(rows, usable, F.col("_node") if level else None, label, weight, grid)
            for s in best_splits(hist, loss, categorical, weights, grid).collect():
                parent = nodes[s["node_id"]]
                f = features[s["feature_id"]]
                split_error, gain = s["split_error"], s["gain"]
                small = gain <= least + GAIN_SLACK and gain <= params.min_local_gain_fraction * parent.error + GAIN_SLACK
                if small or s["bins"] < 2:
                    nodes[parent.node_id] = replace(parent, split_error=split_error, gain=gain)
                    continue
                found = {"split_error": split_error, "gain": gain, "feature_id": s["feature_id"], "feature_type": f.kind, "feature": f.name}
                if f.kind == CONTINUOUS:
                    q = quantiles[f.name]
                    found |= {"cut_bin": s["bin"], "threshold": float(q[min(s["bin"], len(q) - 1)])}
                else:
                    found |= {"left_ids": tuple(s["left_bins"]), "right_ids": tuple(s["right_bins"])}
                nodes[parent.node_id] = replace(parent, **found)
                for side, child in (("l", 2 * parent.node_id), ("r", 2 * parent.node_id + 1)):
                    response, error = _numbers(loss, s[f"{side}_w"], s[f"{side}_s"], s[f"{side}_ss"])
                    nodes[child] = Node(child, level + 1, s[f"{side}_n"], s[f"{side}_w"], response, error)
    return Tree(nodes)


def grow_local_quantiles(encoded: DataFrame, features: list[FeatureSpec], params: TreeParams, label: str, weight: str | None, feature_weights: list[float] | None) -> Tree:
    """Node by node, with quantiles of each node's own rows."""
    from timberline.plans.model import encoded_test

    nodes: dict[int, Node] = {}
    one = replace(params, max_depth=1)
    least: float | None = None
    queue = [1]
    while queue:
        i = queue.pop(0)
        rows = encoded if i == 1 else encoded.withColumn("_at", Tree(nodes).leaf_of(encoded_test)).filter(F.col("_at") == i).drop("_at")
        # The root's error sets the least gain for all; below it, the fraction is scaled to match.
        parent = nodes.get(i)
        share = params.min_gain_fraction if parent is None else (least / parent.error if parent.error else 1.0)
        q = global_quantiles(rows, features, params)
        small = grow(bin_columns(rows, features, q), features, q, replace(one, min_gain_fraction=share), label, weight, feature_weights)
        top = small.nodes[1]
        least = params.min_gain_fraction * top.error if least is None else least
        depth = i.bit_length() - 1
        nodes[i] = replace(top, node_id=i, depth=depth)
        if not top.is_leaf:
            for side in (0, 1):
                nodes[2 * i + side] = replace(small.nodes[2 + side], node_id=2 * i + side, depth=depth + 1)
                if depth + 1 < params.max_depth:
                    queue.append(2 * i + side)
    return Tree(nodes)


def train_tree(encoded: DataFrame, features: list[FeatureSpec], params: TreeParams | None = None, label: str = "label", weight: str | None = None, feature_weights: list[float] | None = None, quantiles: dict[str, list[float]] | None = None, dictionaries: dict[str, dict[str, int]] | None = None) -> Forest:
    """A tree over encoded data, as a forest of one. Rows with a null label are left out."""
    params = params or TreeParams()
    encoded = encoded.filter(F.col(f"`{label}`").isNotNull())
    if not params.use_global_quantiles:
        tree = grow_local_quantiles(encoded, features, params, label, weight, feature_weights)
    else:
        q = global_quantiles(encoded, features, params) if quantiles is None else quantiles
        binned = bin_columns(encoded, features, q).persist()
        try:
            tree = grow(binned, features, q, params, label, weight, feature_weights)
        finally:
            binned.unpersist()
    return Forest((tree.named(dictionaries or {}),), tuple(features))
