import math
import random

import pytest
from pyspark.sql import functions as F

from timberline.operators import metrics, prep


def pairs(n, seed, levels):
    draw = random.Random(seed)
    return [(draw.randrange(levels) / (levels - 1), draw.randrange(2)) for _ in range(n)]


@pytest.mark.parametrize("levels", [2, 5, 1000])
def test_auc_counts_pairs(spark, levels):
    rows = pairs(120, levels, levels)
    df = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum(p > q for p in pos for q in neg) / len(pos) / len(neg)
    assert metrics.auc(df).first()[0] == pytest.approx(want)
    points = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_points(df).collect())
    assert len(points) == len(neg) + 2
    curve = {r["score"]: (r["fpr"], r["tpr"]) for r in metrics.roc(df).collect()}
    for s in {s for s, _ in rows}:
        assert curve[s] == pytest.approx((sum(q >= s for q in neg) / len(neg), sum(p >= s for p in pos) / len(pos)))


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(0.1, 1), (0.9, 1)], "score double, label int")
    assert metrics.auc(df).first()[0] is None
    assert metrics.classification_report(df).first()["fpr"] is None


def test_report(spark):
    rows = pairs(200, 1, 11)
    row = metrics.classification_report(spark.createDataFrame(rows, "score double, label int")).first()
    tp = sum(s >= 0.5 and y for s, y in rows)
    assert row["tp"] == tp and row["tn"] + row["fp"] + row["fn"] + row["tp"] == 200
    chance = [s if y else 1 - s for s, y in rows]
    ll = sum(max(math.log(c), -10.0) if c > 0 else -10.0 for c in chance)
    assert row["nll"] == pytest.approx(-ll / 200 / math.log(2)) and row["rig"] == pytest.approx(1 - row["nll"] / row["entropy"])


def test_usable_scores(spark):
    df = spark.createDataFrame([("0.5", "1"), ("", "1"), ("0.2", None), ("0.1", "0")], "SCORE string, Label string")
    assert sorted(map(tuple, metrics.usable_scores(df).collect())) == [(0.1, 0), (0.5, 1)]


def test_step_weights(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (30.0,), (99.0,)], "y double")
    plain = [r[0] for r in df.select(prep.step_weight(F.col("y"), [20, 40], [1, 2, 3])).collect()]
    legacy = [r[0] for r in df.select(prep.step_weight(F.col("y"), [20, 40], [1, 2, 3], legacy=True)).collect()]
    assert plain == [1.0, 2.0, 2.0, 3.0] and legacy == [2.0, 2.0, 2.0, 3.0]
    assert prep.parse_weight_steps(["0.5", "20", "1.0"]) == ([20.0], [0.5, 1.0])
    with pytest.raises(ValueError):
        prep.step_weight(F.col("y"), [1], [1])


def test_subtract_removes_all_copies_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c"), (3, "c")], "x int, y string")
    gone = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert sorted(map(tuple, prep.subtract(df, gone).collect())) == [(3, "c"), (3, "c")]


def test_split_and_samples(spark):
    df = spark.range(2000).withColumn("copy", F.col("id") % 100)
    train, test = prep.train_test_split(df, 0.7)
    assert train.count() + test.count() == 2000 and 1200 < train.count() < 1600
    assert train.intersect(test).count() == 0
    assert prep.fixed_sample(df, 10, ["id"]).count() == 10
    assert prep.fixed_sample(df, 10, ["id"]).collect() == prep.fixed_sample(df.repartition(7), 10, ["id"]).collect()
    assert prep.feature_weights(["y", "a", "b"], None, ["b"]) == [("y", 1), ("a", 1), ("b", 0)]
