import math
import random

import pytest
from pyspark.sql import functions as F

from timberline.operators import datagen, encode
from timberline.plans import model
from timberline.plans.boost import train_forest
from timberline.plans.model import Forest
from timberline.plans.tree import train_tree
from timberline.spec import CATEGORICAL, CONTINUOUS, IGNORED, FeatureSpec, ForestParams, TreeParams, parse_header

FEATURES = [FeatureSpec("x"), FeatureSpec("c$", CATEGORICAL), FeatureSpec("z")]


def error(loss, rows):
    w = sum(r[-1] for r in rows)
    s = sum(r[-1] * r[0] for r in rows)
    if not w:
        return 0.0, 0.0
    p = s / w
    if loss == "square":
        return p, sum(r[-1] * r[0] ** 2 for r in rows) - s * s / w
    return p, -w * (p * math.log2(p) + (1 - p) * math.log2(1 - p)) if 1e-10 < p < 1 - 1e-10 else 0.0


def brute(rows, quantiles, params, node=1, least=None):
    """The same rules, one row at a time. Rows are (label, x, c, z, weight)."""
    response, err = error(params.loss, rows)
    least = params.min_gain_fraction * err if least is None else least
    out = {node: (len(rows), round(response, 6), None)}
    weight = sum(r[-1] for r in rows)
    if node >= 2**params.max_depth or len(rows) < max(2, params.min_count) or weight < params.min_weight:
        return out
    best = None
    for i, f in enumerate(FEATURES):
        bins = {}
        for r in rows:
            b = int(r[i + 1]) if f.kind == CATEGORICAL else sum(t <= r[i + 1] for t in quantiles[f.name])
            bins.setdefault(b, []).append(r)
        order = sorted(bins, key=lambda b: (error(params.loss, bins[b])[0], b) if f.kind == CATEGORICAL else b)
        tries = []
        for p in range(len(order) - 1):
            left, right = [r for b in order[: p + 1] for r in bins[b]], [r for b in order[p + 1 :] for r in bins[b]]
            tries.append((float(f"{error(params.loss, left)[1] + error(params.loss, right)[1]:.9g}"), p, left, right))
        if tries:
            e, p, left, right = min(tries, key=lambda t: t[:2])
            cut = order[p] if f.kind == CONTINUOUS else tuple(sorted(order[: p + 1]))
            gain = float(f"{err - e:.7g}")
            if best is None or gain > best[0]:
                best = (gain, f.name, quantiles[f.name][cut] if f.kind == CONTINUOUS else cut, left, right)
    if best is None or best[0] <= least + 1e-7 and best[0] <= params.min_local_gain_fraction * err + 1e-7:
        return out
    out[node] = (len(rows), round(response, 6), (best[1], best[2]))
    return {**out, **brute(best[3], quantiles, params, 2 * node, least), **brute(best[4], quantiles, params, 2 * node + 1, least)}


def data(n, seed, binary=False):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        x, c, z = draw.randrange(40) / 2, draw.randrange(6), draw.randrange(5) * 1.0
        y = (x > 9) * 3.0 + (c in (1, 4)) * 2.0 * (x < 12) + z / 4 + draw.randrange(3) / 8
        rows.append((float(y > 3) if binary else y, x, float(c), z, float(draw.randrange(1, 4))))
    return rows


def shown(tree):
    return {n.node_id: (n.count, round(n.response, 6), None if n.is_leaf else (n.feature, n.threshold if n.feature_type == CONTINUOUS else n.left_ids)) for n in tree.preorder()}


@pytest.mark.parametrize("loss,weighted,batch", [("square", False, 128), ("square", True, 1), ("entropy", False, 2), ("entropy", True, 128)])
def test_trees_are_those_of_the_plain_rules(spark, loss, weighted, batch):
    rows = data(250, 5, loss == "entropy")
    df = spark.createDataFrame(rows, "label double, x double, `c$` double, z double, w double")
    params = TreeParams(loss=loss, max_depth=3, min_gain_fraction=0.01, batch_size=batch)
    q = encode.collect_quantiles(encode.quantile_table(df, ["x", "z"]))
    got = shown(train_tree(df, FEATURES, params, weight="w" if weighted else None).trees[0])
    assert got == brute(rows if weighted else [(*r[:-1], 1.0) for r in rows], q, params)


def test_known_tree_is_found(spark):
    df = datagen.known_tree(spark, 2000)
    features = [FeatureSpec("x0"), FeatureSpec("x1", CATEGORICAL)]
    tree = train_tree(df, features, TreeParams(loss="entropy", max_depth=2)).trees[0]
    root, right = tree.nodes[1], tree.nodes[3]
    assert root.feature == "x1" and root.left_ids == (0, 2)
    assert 0.4 < right.threshold < 0.6 and tree.nodes[6].response < 0.2 and tree.nodes[7].response > 0.8
    wrong = df.select((F.round(Forest((tree,)).predict()) != F.col("label")).cast("int").alias("e")).agg(F.avg("e")).first()[0]
    assert wrong < 0.2


def test_local_quantiles_and_methods_agree_where_they_must(spark):
    df = spark.createDataFrame(data(120, 9), "label double, x double, `c$` double, z double, w double")
    one = shown(train_tree(df, FEATURES, TreeParams(max_depth=3)).trees[0])
    for method in TreeParams.METHODS:
        assert shown(train_tree(df, FEATURES, TreeParams(max_depth=3, histograms_method=method)).trees[0]) == one
    local = train_tree(df, FEATURES, TreeParams(max_depth=3, use_global_quantiles=False)).trees[0]
    assert shown(local)[1] == one[1] and sum(n.count for n in local.preorder() if n.is_leaf) == 120


def test_feature_weights_steer_and_zero_forbids(spark):
    df = spark.createDataFrame(data(120, 9), "label double, x double, `c$` double, z double, w double")
    tree = train_tree(df, FEATURES, TreeParams(max_depth=3), feature_weights=[0.0, 1.0, 1.0]).trees[0]
    assert "x" not in {n.feature for n in tree.preorder()}


def test_boosting_lowers_the_error_and_goes_on_from_a_model(spark):
    df = spark.createDataFrame(data(200, 3), "label double, x double, `c$` double, z double, w double")
    params = ForestParams(TreeParams(max_depth=3), num_trees=4, persist_interval=2)
    four = train_forest(df, FEATURES, params)
    rmse = lambda f: df.select(F.sqrt(F.avg((f.predict() - F.col("label")) ** 2))).first()[0]
    assert rmse(four) < rmse(Forest(four.trees[:2])) < rmse(Forest(four.trees[:1]))
    two = ForestParams(TreeParams(max_depth=3), num_trees=2, persist_interval=1)
    again = train_forest(df, FEATURES, two, init_model=train_forest(df, FEATURES, two))
    assert [shown(t) for t in again.trees] == [shown(t) for t in four.trees]


@pytest.mark.parametrize("rows", [[], [(1.0, 2.0, 0.0, 1.0, 1.0)], [(1.0, 2.0, 0.0, 1.0, 1.0)] * 5, [(float(i % 2), 2.0, 0.0, 1.0, 1.0) for i in range(6)]])
def test_nothing_to_split(spark, rows):
    df = spark.createDataFrame(rows, "label double, x double, `c$` double, z double, w double")
    tree = train_tree(df, FEATURES, TreeParams()).trees[0]
    assert len(tree.nodes) == 1 and tree.nodes[1].count == len(rows)
    imp = model.feature_importances(Forest((tree,)).table(spark), ["x"]).collect()
    assert [tuple(r) for r in imp] == [("x", 0.0)]


def test_ignored_columns_and_odd_values(spark):
    label, features = parse_header(["y", "a", "b$", "c#"])
    assert label == "y" and [f.kind for f in features] == [CONTINUOUS, CATEGORICAL, IGNORED]
    raw = spark.createDataFrame([("1", "1.5", "p", "junk"), ("2", "", "q", ""), ("3", None, None, None), ("4", "nan", "", "x")], "y string, a string, `b$` string, `c#` string")
    ids = encode.collect_dictionaries(encode.build_dictionaries(raw, ["b$"]))
    assert ids == {"b$": {"": 0, "p": 1, "q": 2}}
    out = [tuple(r) for r in encode.encode(raw, features, {"b$": {"p": 0, "q": 1}}).select("a", "b$", "c#").collect()]
    assert out[:3] == [(1.5, 0.0, -1.0), (-1.0, 1.0, -1.0), (-1.0, 0.0, -1.0)] and math.isnan(out[3][0])
    bins = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (99.0,), (float("nan"),)], "v double")
    for n in (0, 1, 2, 9, 10, 50):
        t = [i + 0.5 for i in range(n)]
        got = [r[0] for r in bins.select(encode.bin_of(F.col("v"), t)).collect()]
        assert got == [sum(x <= v for x in t) for v in (0.0, 1.0, 1.5, 99.0)] + [n]


def test_raw_and_encoded_rows_score_alike(spark):
    raw = spark.createDataFrame([(float(i % 7), str(i % 11), "abc"[i % 3]) for i in range(100)], "y double, a string, `b$` string")
    features = [FeatureSpec("a"), FeatureSpec("b$", CATEGORICAL)]
    ids = encode.collect_dictionaries(encode.build_dictionaries(raw, ["b$"]))
    enc = encode.encode(raw, features, ids)
    forest = train_forest(enc, features, ForestParams(num_trees=2), label="y", dictionaries=ids)
    both = zip(raw.select(forest.predict(raw=True)).collect(), enc.select(forest.predict()).collect())
    assert all(a[0] == b[0] for a, b in both)
    again = Forest.from_table(forest.table(spark))
    assert again.rows() == forest.rows()
    unseen = spark.createDataFrame([("", "never"), (None, None)], "a string, `b$` string").select(forest.predict(raw=True)).collect()
    assert all(math.isfinite(r[0]) for r in unseen)


def test_forests_do_not_depend_on_how_rows_are_dealt(spark, tmp_path):
    """Residuals are no short binary fractions, so plain sums differ with the order of addition."""
    i = F.col("id")
    rows = spark.range(30_000).select((i % 10).cast("double").alias("x"), (i % 3).cast("double").alias("c$"), (i % 4).cast("double").alias("z"), ((i % 10 >= 6) & (i % 3 == 1)).cast("double").alias("label"), (i % 7 * 0.1 + 0.3).alias("weight"))
    params = ForestParams(TreeParams(max_depth=3), num_trees=3, persist_interval=1)
    found = []
    for parts in (1, 16):
        rows.repartition(parts, "id").write.parquet(f"{tmp_path}/{parts}") if parts > 1 else rows.coalesce(1).write.parquet(f"{tmp_path}/1")
        dealt = spark.read.parquet(f"{tmp_path}/{parts}")
        found.append([train_forest(dealt, FEATURES, params, weight=w).rows() for w in (None, "weight")])
    assert found[0] == found[1]
    first, second = found[0][0][0], next(r for r in found[0][0] if r[0] == 1)
    # Errors of the roots: 4,000 rows of 1, of which the first tree leaves a fifth.
    assert first[6] == pytest.approx(4000 - 4000**2 / 30_000, rel=1e-15)
    assert second[6] == pytest.approx((4000 - 4000**2 / 30_000) * 0.04, rel=1e-14)


@pytest.mark.parametrize("values", [[1e300, -1e-3, 3.5], [0.1, 0.2, -0.3, 1e-17, None], [0.0, 0.0], [-7e-250, 2e-251]])
def test_sums_on_a_grid(spark, values):
    """Each sum is the exact one, rounded once; parts are lost only far below the greatest magnitude."""
    from fractions import Fraction

    from timberline.functions.exact import Grid

    df = spark.createDataFrame([(v,) for v in values * 50], "v double")
    grid = Grid.of(df, {"v": F.col("v")})
    got = df.select(*grid.parts({"v": F.col("v")})).agg(*grid.sums()).select(grid.value("v", F.col("v"))).first()[0]
    known = [v for v in values if v is not None]
    assert got == pytest.approx(float(50 * sum(map(Fraction, known))), rel=1e-15, abs=max(map(abs, known)) * 1e-20)


def test_no_grid_for_values_that_are_not_finite(spark):
    from timberline.functions.exact import Grid

    for v in (float("nan"), float("inf"), 1e-300):
        assert Grid.of(spark.createDataFrame([(v,)], "v double"), {"v": F.col("v")}) is None
    odd = spark.createDataFrame([(float("nan"), 1.0), (1.0, 2.0), (0.0, 3.0)], "label double, x double")
    assert train_tree(odd, [FeatureSpec("x")], TreeParams(max_depth=1)).trees[0].nodes[1].count == 3
