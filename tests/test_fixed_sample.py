from pyspark.sql import functions as F

from timberline.operators import metrics, prep


def test_copies_are_drawn_one_by_one(spark):
    """Six distinct pairs of score and label: every pair keeps its share of the rows."""
    df = spark.range(60_000).select((F.col("id") % 3 / 4).alias("score"), (F.col("id") % 2).cast("int").alias("label"))
    few = prep.fixed_sample(df, 6000, ["score", "label"])
    found = {(r["score"], r["label"]): r["count"] for r in few.groupBy("score", "label").count().collect()}
    assert sum(found.values()) == 6000
    assert len(found) == 6 and all(800 < n < 1200 for n in found.values())
    assert metrics.auc(few).first()[0] is not None
    assert prep.fixed_sample(df.limit(5), 10, ["score", "label"]).count() == 5
