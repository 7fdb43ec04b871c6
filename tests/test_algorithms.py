import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import clustering, datagen, factorization, linear


def test_logistic_regression_recovers_weights(spark):
    found = linear.logistic_regression(datagen.logistic(spark, 10000), iterations=25, step=10.0)
    assert -1.9 < found.weights[0] < -1.2 and 1.7 < found.intercept < 2.4
    check = datagen.logistic(spark, 4000, seed=7).select((found.predict() == F.col("label")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert check > 0.8


def test_svm_and_its_validation(spark):
    df = datagen.svm(spark, 2000)
    found = linear.linear_svm(df, reg=0.01, iterations=30, step=1.0)
    assert df.select((found.predict() == F.col("label")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0] > 0.9
    bad = df.withColumn("label", F.when(F.col("label") == 0, -1.0).otherwise(1.0))
    with pytest.raises(ValueError):
        linear.linear_svm(bad, iterations=1)
    linear.linear_svm(bad, iterations=1, validate=False)


def test_linear_lasso_ridge(spark):
    df = datagen.linear(spark, 1000, [10.0, -3.0], intercept=2.0, noise=0.1)
    plain = linear.linear_regression(df, iterations=150, step=1.0)
    assert np.allclose([*plain.weights, plain.intercept], [10.0, -3.0, 2.0], atol=0.5)
    for found in (linear.lasso(df, reg=0.01, iterations=80, step=1.0), linear.ridge(df, reg=0.001, iterations=80, step=1.0)):
        assert np.allclose([*found.weights, found.intercept], [10.0, -3.0, 2.0], atol=0.6)
    weights, penalty = linear.update("l1", np.array([1.0, -0.1]), np.array([0.0, 0.0]), 0.5, 0.4)
    assert np.allclose(weights, [0.8, 0.0]) and penalty == pytest.approx(0.32)


def test_single_cluster_is_the_mean(spark):
    df = spark.createDataFrame([([1.0, 2.0, 6.0],), ([1.0, 3.0, 0.0],), ([1.0, 4.0, 6.0],)], "features array<double>")
    for mode in ("random", "k-means||"):
        found = clustering.kmeans(df, 1, iterations=2, mode=mode)
        assert np.allclose(found.centers, [[1.0, 3.0, 4.0]])


def test_as_many_clusters_as_points(spark):
    points = [[1.0, 2.0, 6.0], [1.0, 3.0, 0.0], [1.0, 4.0, 6.0], [1.0, 0.0, 1.0], [9.0, 9.0, 9.0]]
    df = spark.createDataFrame([(p,) for p in points], "features array<double>")
    found = clustering.kmeans(df, 5, iterations=5, runs=3, steps=6)
    assert found.compute_cost(df) == pytest.approx(found.cost)
    assert found.cost < 20


def test_low_rank_ratings_are_recovered(spark):
    df = datagen.ratings(spark, 20, 30, rank=2, share=0.8)
    found = factorization.als(df, 2, iterations=8, reg=1e-4)
    worst = found.predict(df).select(F.max(F.abs(F.col("prediction") - F.col("rating")))).first()[0]
    assert worst < 0.3
    one = df.first()
    assert found.lookup(one["user"], one["item"]) == pytest.approx(one["rating"], abs=0.3)
    assert found.lookup(-1, 0) is None
