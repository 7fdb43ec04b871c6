"""Dictionaries, quantiles and bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from timberline.spec import CATEGORICAL, CONTINUOUS, FeatureSpec

#: Dictionaries up to this many values become literals of the plan, larger ones are joined.
LITERAL_VALUES = 2_000
#: What an empty continuous field counts as (fixed value).
MISSING = -1.0


def value_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """``(feature, value, cnt)`` of the given columns in one pass; null counts as ''."""
    if not features:
        return df.sparkSession.createDataFrame([], "feature string, value string, cnt long")
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias("value")) for f in features])
    return df.select(F.inline(pairs)).groupBy("feature", "value").agg(F.count("*").alias("cnt"))


#: Ranges that the values of a dictionary are dealt into for numbering.
VALUE_RANGES = 64


def build_dictionaries(df: DataFrame, features: list[str]) -> DataFrame:
    """``(feature, value, id, cnt)``: ids count from 0, frequent values first, ties by value.

    Values of one count are dealt into ranges and numbered within these, each
    from what comes before it, so no task holds a whole feature. Where ranges
    end follows from a few values drawn by hash and only affects balance.
    """
    counts = value_counts(df, features)
    ends = sorted({row["value"] for row in counts.select("value").orderBy(F.xxhash64("value")).limit(VALUE_RANGES - 1).collect()})
    part = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("value"))) if ends else F.lit(0)
    dealt = counts.withColumn("part", part)
    before = W.partitionBy("feature").orderBy(F.col("cnt").desc(), "part").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("feature", "cnt", "part").agg(F.count("*").alias("size"))
    bases = sizes.select("feature", "cnt", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("feature", "cnt", "part").orderBy("value")
    return dealt.join(bases, ["feature", "cnt", "part"]).select("feature", "value", (F.col("base") + F.row_number().over(within) - 1).cast("int").alias("id"), "cnt")


def collect_dictionaries(dictionaries: DataFrame) -> dict[str, dict[str, int]]:
    """Dictionaries as Python maps: what models and literals need. As large as the distinct values."""
    out: dict[str, dict[str, int]] = {}
    for row in dictionaries.select("feature", "value", "id").collect():
        out.setdefault(row["feature"], {})[row["value"]] = row["id"]
    return out


def continuous(col: Column) -> Column:
    """A number; an empty or null field counts as -1."""
    text = col.cast("string")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(MISSING)).otherwise(text.cast("double"))


def encode(df: DataFrame, features: list[FeatureSpec], dictionaries: dict[str, dict[str, int]] | DataFrame) -> DataFrame:
    """All features as doubles; an unknown category has id 0, an ignored column is -1. Other columns stay.

    Dictionaries are maps, or a table ``(feature, value, id)``, which is joined
    and never comes to the driver.
    """
    out, plain = df, {}
    for f in features:
        if f.kind == CATEGORICAL:
            value = F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit(""))
            whole = isinstance(dictionaries, DataFrame)
            ids = {} if whole else dictionaries.get(f.name, {})
            if not whole and len(ids) <= LITERAL_VALUES:
                found = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])[value] if ids else F.lit(None)
                plain[f.name] = F.coalesce(found, F.lit(0)).cast("double")
            else:
                if whole:
                    table = dictionaries.filter(F.col("feature") == f.name).select(F.col("value").alias("_value"), F.col("id").alias("_id"))
                else:
                    table = df.sparkSession.createDataFrame(list(ids.items()), "_value string, _id int")
                out = out.withColumn("_value", value).join(table, "_value", "left").withColumn(f.name, F.coalesce("_id", F.lit(0)).cast("double")).drop("_value", "_id")
        else:
            plain[f.name] = continuous(F.col(f"`{f.name}`")) if f.kind == CONTINUOUS else F.lit(-1.0)
    return out.withColumns(plain) if plain else out


def cardinalities(df: DataFrame, features: list[FeatureSpec]) -> DataFrame:
    """One row: for each categorical feature of encoded data, its greatest id plus 1."""
    own = [f.name for f in features if f.kind == CATEGORICAL]
    return df.agg(*[(F.max(f"`{f}`") + 1).cast("int").alias(f) for f in own]) if own else df.sparkSession.createDataFrame([()], "")


#: Ranges that the values of a feature are dealt into for running sums.
RANGES = 64


def quantile_table(df: DataFrame, features: list[str], most: int = 1000) -> DataFrame:
    """``(feature, thresholds)``: midpoints between neighbours at the quantiles, distinct, sorted.

    Exact on all rows. With n values there are min(most, n - 1) cuts; cut q lies
    behind position q * n / (cuts + 1) - 1, rounded towards zero. Values are
    counted, dealt into ranges and summed within these, so no task holds a
    whole feature. Where ranges end is approximate and only affects balance.
    """
    spark = df.sparkSession
    shape = "feature string, thresholds array<double>"
    if not features:
        return spark.createDataFrame([], shape)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("v")) for f in features])
    counts = df.select(F.inline(pairs)).filter("v is not null").groupBy("feature", "v").agg(F.count("*").alias("cnt"))
    ends = counts.groupBy("feature").agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 1000).alias("ends")).collect()
    if not ends:
        return spark.createDataFrame([], shape)
    dealt = F.lit(0)
    for row in ends:
        dealt = F.when(F.col("feature") == row["feature"], bin_of(F.col("v"), sorted(set(row["ends"])))).otherwise(dealt)
    ranged = counts.withColumn("range", dealt)
    sums, sizes = [], {}
    for row in sorted(ranged.groupBy("feature", "range").agg(F.sum("cnt").alias("cnt")).collect()):  # at most RANGES a feature
        sums.append((row["feature"], row["range"], sizes.get(row["feature"], 0)))
        sizes[row["feature"]] = sums[-1][2] + row["cnt"]
    bases = spark.createDataFrame([(f, part, base, sizes[f], min(most, sizes[f] - 1)) for f, part, base in sums], "feature string, range int, base long, n long, cuts long")
    inside = W.partitionBy("feature", "range").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = ranged.withColumn("top", F.sum("cnt").over(inside)).join(F.broadcast(bases), ["feature", "range"]).filter("cuts > 0")
    held = held.withColumn("hi", F.col("base") + F.col("top")).withColumn("lo", F.col("base") + F.col("top") - F.col("cnt"))
    # The cuts whose two positions can be among lo .. hi - 1, one more on either side; the test is exact.
    cuts, n = F.col("cuts"), F.col("n")
    least = F.greatest(F.lit(1).cast("long"), F.floor(F.col("lo") * (cuts + 1) / n) - 1)
    greatest = F.least(cuts, F.ceil((F.col("hi") + 1) * (cuts + 1) / n) + 1)
    near = F.when(least <= greatest, F.sequence(least, greatest)).otherwise(F.array().cast("array<bigint>"))
    at = lambda q: (q * n / (cuts + 1) - 1).cast("long")
    picked = lambda step: F.filter(near, lambda q: (at(q) + step >= F.col("lo")) & (at(q) + step < F.col("hi")))
    both = held.select("feature", "v", F.explode(F.concat(picked(0), picked(1))).alias("q"))
    found = both.groupBy("feature", "q").agg((F.sum("v") / 2.0).alias("t")).groupBy("feature").agg(F.array_sort(F.collect_set("t")).alias("thresholds"))
    known = spark.createDataFrame([(f,) for f in sizes], "feature string")
    return known.join(found, "feature", "left").select("feature", F.coalesce("thresholds", F.array().cast("array<double>")).alias("thresholds"))


def collect_quantiles(table: DataFrame) -> dict[str, list[float]]:
    return {r["feature"]: list(r["thresholds"]) for r in table.collect()}


def bin_of(value: Column, thresholds: list[float]) -> Column:
    """How many thresholds are at most ``value`` (NaN is above all).

    Two short scans instead of a long one: among every k-th threshold, then
    among the k that follow, with k about the square root of their number.
    """
    if not thresholds:
        return F.lit(0)
    k = max(1, int(len(thresholds) ** 0.5))
    count = lambda array: F.size(F.filter(array, lambda t: t <= value))
    double = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    if k < 3:
        return count(double(thresholds))
    coarse = count(double(thresholds[k - 1 :: k]))
    fine = F.array(*[double(thresholds[i : i + k]) for i in range(0, len(thresholds), k)])
    rest = F.get(fine, coarse)
    return coarse * k + F.when(rest.isNull(), 0).otherwise(count(rest))


def bin_columns(df: DataFrame, features: list[FeatureSpec], quantiles: dict[str, list[float]]) -> DataFrame:
    """Encoded data with ``b0, b1, ...`` instead of its features: small integers only."""
    columns = []
    for i, f in enumerate(features):
        if f.kind == CONTINUOUS:
            columns.append(bin_of(F.col(f"`{f.name}`"), quantiles.get(f.name, [])).cast("int").alias(f"b{i}"))
        elif f.kind == CATEGORICAL:
            columns.append(F.col(f"`{f.name}`").cast("int").alias(f"b{i}"))
    names = {f.name.lower() for f in features}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names], *columns)


def rows_of_width(lines: DataFrame, width: int, column: str = "value") -> DataFrame:
    """Tab-separated lines with exactly ``width`` fields, as an array column ``fields``; others are dropped."""
    return lines.select(F.split(column, "\t", -1).alias("fields")).filter(F.size("fields") == width)


def union_values(frames: list[DataFrame]) -> DataFrame:
    """Distinct rows of several dictionaries' values."""
    return reduce(DataFrame.unionByName, frames).distinct()
