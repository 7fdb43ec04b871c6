"""Evaluation of scores against labels; every metric is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Least natural logarithm of a probability (fixed value).
LOG_FLOOR = -10.0


def error_stats(df: DataFrame, score: str = "score", label: str = "label", trivial: float | Column | None = None) -> DataFrame:
    """One row: ``n, rmse, mae`` and, with a constant to compare with, ``trivial_rmse, trivial_mae``."""
    p, y = F.col(f"`{score}`").cast("double"), F.col(f"`{label}`").cast("double")

    def of(d: Column, prefix: str) -> list[Column]:
        return [F.sqrt(F.avg(d * d)).alias(f"{prefix}rmse"), F.avg(F.abs(d)).alias(f"{prefix}mae")]

    out = [F.count("*").alias("n"), *of(p - y, "")]
    if trivial is not None:
        base = trivial if isinstance(trivial, Column) else F.lit(float(trivial))
        out += [F.first(base).alias("trivial_response"), *of(base - y, "trivial_")]
    return df.agg(*out)


def confusion(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """One row: ``tn, fp, fn, tp`` and the log likelihood ``ll`` in natural units, floored per row."""
    p, y = F.col(f"`{score}`").cast("double"), F.col(f"`{label}`").cast("int")
    up = p >= threshold
    chance = F.when(y == 1, p).otherwise(1.0 - p)
    ll = F.when(chance > 0, F.greatest(F.log(chance), F.lit(LOG_FLOOR))).otherwise(LOG_FLOOR)
    count = lambda test: F.sum(F.when(test, 1).otherwise(0)).alias
    return df.agg(count((y == 0) & ~up)("tn"), count((y == 0) & up)("fp"), count((y == 1) & ~up)("fn"), count((y == 1) & up)("tp"), F.sum(ll).alias("ll"))


def classification_report(df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """One row: counts, rates, precision, F1, accuracy, mean loss and entropy in bits, and
    ``rig``, the share of the entropy that the scores explain. Null where a rate has no cases."""
    c = confusion(df, score, label, threshold)
    n, pos, neg = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"), F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    rate = lambda a, b: F.when(b > 0, a / b)
    out = c.withColumn("n", n).withColumn("tpr", rate(F.col("tp"), pos)).withColumn("fpr", rate(F.col("fp"), neg))
    out = out.withColumn("precision", rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("f1", rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    mean = pos / n
    bits = F.when((mean > 0) & (mean < 1), -(mean * F.log2(mean) + (1 - mean) * F.log2(1 - mean))).otherwise(0.0)
    out = out.withColumn("accuracy", rate(F.col("tp") + F.col("tn"), n)).withColumn("nll", -F.col("ll") / n / F.log(F.lit(2.0))).withColumn("entropy", bits)
    return out.withColumn("rig", F.when(F.col("entropy") > 0, 1 - F.col("nll") / F.col("entropy"))).drop("ll")


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score: what a curve needs, however many rows there are."""
    y = F.col(f"`{label}`").cast("int")
    return df.groupBy(F.col(f"`{score}`").cast("double").alias("score")).agg(F.sum(F.when(y == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(y == 0, 1).otherwise(0)).alias("neg"))


#: Ranges of the running sums over scores.
RANGES = 64
#: Points made from one row at a time.
POINTS = 10_000


def cumulative(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``(score, pos, neg, tp, fp)`` per distinct score, counted from the greatest score down, inclusive.

    Scores are dealt into ranges; each range sums itself and adds the totals of
    the ranges above, so no task sees all scores. Where ranges end is fixed
    first, so every use of the plan deals alike.
    """
    rows = _by_score(df, score, label)
    ends = rows.agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 1000).alias("ends")).first()["ends"]
    ends = F.array(*[F.lit(float(e)) for e in sorted(set(ends or ()))]).cast("array<double>")
    above_it = F.size(F.filter(ends, lambda e: e > F.col("score")))
    ranged = rows.withColumn("range", F.when(F.col("score").isNull(), RANGES).otherwise(above_it))
    inside = W.partitionBy("range").orderBy(F.col("score").desc())
    totals = ranged.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    above = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # at most RANGES rows
    base = totals.select("range", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("q").over(above), F.lit(0)).alias("bq"))
    out = ranged.withColumn("tp", F.sum("pos").over(inside)).withColumn("fp", F.sum("neg").over(inside)).join(F.broadcast(base), "range")
    return out.select("score", "pos", "neg", (F.col("tp") + F.col("bp")).alias("tp"), (F.col("fp") + F.col("bq")).alias("fp"))


def roc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``(score, fpr, tpr)``, one point per distinct score, inclusive. Null rates with one class only."""
    curve = cumulative(df, score, label)
    total = curve.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return curve.join(F.broadcast(total)).select("score", F.when(F.col("all_neg") > 0, F.col("fp") / F.col("all_neg")).alias("fpr"), F.when(F.col("all_pos") > 0, F.col("tp") / F.col("all_pos")).alias("tpr"))


def roc_points(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``(score, fpr, tpr)``, one point per negative (exclusive rate) and two end points.

    Among equal scores negatives come first, so a tie gains nothing.
    """
    curve = cumulative(df, score, label).withColumn("above", F.col("tp") - F.col("pos")).withColumn("before", F.col("fp") - F.col("neg"))
    total = F.broadcast(curve.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.max("score").alias("hi"), F.min("score").alias("lo")))
    # In blocks, dealt anew: a score may be shared by any number of negatives.
    blocks = curve.filter("neg > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(neg - 1) div {POINTS}")))).repartition("score", "block")
    inside = F.sequence(F.col("block") * POINTS, F.least(F.col("neg"), (F.col("block") + 1) * POINTS) - 1)
    rows = blocks.withColumn("k", F.explode(inside)).join(total)
    points = rows.select("score", ((F.col("before") + F.col("k")) / F.col("q")).alias("fpr"), F.when(F.col("p") > 0, F.col("above") / F.col("p")).otherwise(1.0).alias("tpr"))
    ends = curve.agg(F.max("score").alias("hi"), F.min("score").alias("lo")).select(F.inline(F.array(F.struct((F.col("hi") + 0.1).alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")), F.struct((F.col("lo") - 0.1).alias("score"), F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr")))))
    return points.unionByName(ends)


def auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row ``auc``: the share of (negative, positive) pairs in which the positive scores higher; ties count 0.

    Null with one class only.
    """
    curve = cumulative(df, score, label)
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos"))).cast("double")
    return curve.agg(F.when(F.sum("pos") * F.sum("neg") > 0, won / F.sum("pos") / F.sum("neg")).alias("auc"))


def usable_scores(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Rows whose score and label are both present; field names in any case."""
    names = {c.lower(): c for c in df.columns}
    p, y = names[score.lower()], names[label.lower()]
    keep = (F.coalesce(F.col(f"`{p}`").cast("string"), F.lit("")) != "") & (F.coalesce(F.col(f"`{y}`").cast("string"), F.lit("")) != "")
    return df.filter(keep).select(F.col(f"`{p}`").cast("double").alias("score"), F.col(f"`{y}`").cast("double").cast("int").alias("label"))
