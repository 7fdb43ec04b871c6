"""Published trees, forest and errors on the automobile data, node by node."""

import csv
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from timberline.operators import encode, metrics
from timberline.plans.boost import train_forest
from timberline.plans.tree import train_tree
from timberline.sources.tables import read_table
from timberline.spec import CONTINUOUS, ForestParams, TreeParams, parse_header

DATA = Path(__file__).parent / "data"
LABEL, FEATURES = parse_header(["mpg", "cylinders", "displacement", "horsepower", "weight", "acceleration", "year", "origin", "make$"])


def expected(name):
    with (DATA / "auto_mpg_trees.tsv").open() as rows:
        return {int(r["node_id"]): r for r in csv.DictReader(rows, delimiter="\t") if r["tree"] == name}


@pytest.fixture(scope="module")
def data(spark):
    train, test = (read_table(spark, str(DATA / f"auto_mpg_{part}.tsv"), LABEL, FEATURES) for part in ("train", "test"))
    ids = encode.collect_dictionaries(encode.build_dictionaries(train, ["make$"]))
    return encode.encode(train, FEATURES, ids).withColumn(LABEL, F.col(LABEL).cast("double")).cache(), test, ids


def same(tree, name, shrinkage=1.0):
    """All nodes; where features tie in gain either may be named, and nodes below such a one are not compared."""
    want, stack, tied = expected(name), [1], 0
    assert len(tree.nodes) == len(want)
    while stack:
        i = stack.pop()
        n, w = tree.nodes[i], want[i]
        assert n.count == int(w["count"]), (name, i)
        assert n.response == pytest.approx(float(w["response"]), abs=2e-6) and n.error == pytest.approx(float(w["error"]), abs=2e-5)
        assert n.is_leaf == (w["feature"] == "")
        if n.is_leaf:
            continue
        assert n.gain == pytest.approx(float(w["gain"]), abs=2e-5), (name, i)
        if n.feature != w["feature"]:
            tied += 1
            continue
        if n.feature_type == CONTINUOUS:
            assert n.threshold == pytest.approx(float(w["cut"]), abs=1e-6)
        else:
            assert set(n.left_values) == set(w["cut"].split(","))
        stack += [2 * i, 2 * i + 1]
    return tied


def errors(spark, test, forest):
    scored = forest.scored(test, raw=True).select(F.col("score"), F.col(LABEL).cast("double").alias("label"))
    return metrics.error_stats(scored, trivial=0.0).first()


def test_the_published_tree(spark, data):
    train, test, ids = data
    found = train_tree(train, FEATURES, TreeParams(max_depth=5, min_gain_fraction=0.01), LABEL, dictionaries=ids)
    assert same(found.trees[0], "tree") == 0
    row = errors(spark, test, found)
    assert (row["rmse"], row["mae"]) == (pytest.approx(8.01600, abs=1e-4), pytest.approx(6.61256, abs=1e-4))


def test_the_published_forest(spark, data):
    train, test, ids = data
    found = train_forest(train, FEATURES, ForestParams(TreeParams(max_depth=4, min_gain_fraction=0.01), num_trees=5, shrinkage=0.8), LABEL, dictionaries=ids)
    # Nodes 13, 4 and 9 of trees 2, 3 and 4 are ties, decided by the last bit of a sum.
    assert sum(same(t, f"forest{m}") for m, t in enumerate(found.trees)) <= 3
    row = errors(spark, test, found)
    # A tie decided otherwise sends unseen rows elsewhere, so the published 7.11018 and 5.63536 are met nearly.
    assert (row["rmse"], row["mae"]) == (pytest.approx(7.11018, rel=0.02), pytest.approx(5.63536, rel=0.02))
    trivial = sum(t.nodes[1].response for t in found.trees)
    assert trivial == pytest.approx(20.77086, abs=1e-4)
