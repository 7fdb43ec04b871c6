"""Text sources and sinks: tables, headers, dictionaries, quantiles, vectors, ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.encode import rows_of_width
from timberline.spec import CATEGORICAL, CONTINUOUS, IGNORED, FeatureSpec, parse_header


def read_small(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small file, or of a folder of part files, in order."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    return [r["value"] for r in sorted(lines.collect(), key=lambda r: (r["f"], r["i"]))]


def read_header(spark: SparkSession, path: str) -> tuple[str, list[FeatureSpec]]:
    return parse_header(read_small(spark, path))


def read_table(spark: SparkSession, path: str, label: str, features: list[FeatureSpec]) -> DataFrame:
    """Tab-separated rows as string columns named by the header; rows of another width are dropped."""
    names = [label, *[f.name for f in features]]
    rows = rows_of_width(spark.read.text(path), len(names))
    return rows.select(*[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_feature_weights(spark: SparkSession, path: str) -> list[float]:
    """One number per header line; the label's is dropped."""
    return [float(x) for x in read_small(spark, path) if x.strip()][1:]


def _write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).text(path)


def write_fields(df: DataFrame, path: str, columns: list[Column] | None = None) -> None:
    """Columns as tab-separated text."""
    fields = columns or [F.col(f"`{c}`") for c in df.columns]
    _write_lines(df.select(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in fields]).alias("value")), path)


def write_encoded(df: DataFrame, path: str, label: str, features: list[FeatureSpec]) -> None:
    """Encoded data as text; categorical and ignored columns are whole numbers."""
    write_fields(df, path, [F.col(f"`{label}`"), *[F.col(f"`{f.name}`").cast("int") if f.kind in (CATEGORICAL, IGNORED) else F.col(f"`{f.name}`") for f in features]])


def read_encoded(spark: SparkSession, path: str, label: str, features: list[FeatureSpec]) -> DataFrame:
    df = read_table(spark, path, label, features)
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in df.columns])


def write_dictionaries(dictionaries: DataFrame, folder: str) -> None:
    """``<feature>_index.txt`` per feature: value and id, ordered by id."""
    for (name,) in dictionaries.select("feature").distinct().collect():
        own = dictionaries.filter(F.col("feature") == name).orderBy("id").coalesce(1)
        write_fields(own, f"{folder}/{name.removesuffix('$')}_index.txt", [F.col("value"), F.col("id")])


def read_dictionaries(spark: SparkSession, folder: str, features: list[FeatureSpec]) -> dict[str, dict[str, int]]:
    out = {}
    for f in features:
        if f.kind == CATEGORICAL:
            pairs = [x.rsplit("\t", 1) for x in read_small(spark, f"{folder}/{f.stem}_index.txt")]
            out[f.name] = {v: int(i) for v, i in pairs}
    return out


def write_quantiles(spark: SparkSession, quantiles: dict[str, list[float]], folder: str) -> None:
    """``<feature>_quantiles.txt`` per feature, five significant digits each."""
    for name, values in quantiles.items():
        df = spark.createDataFrame([(float(v),) for v in values], "q double").coalesce(1)
        _write_lines(df.select(F.format_string("%.5g", "q").alias("value")), f"{folder}/{name}_quantiles.txt")


def read_quantiles(spark: SparkSession, folder: str, features: list[FeatureSpec]) -> dict[str, list[float]]:
    """Thresholds per continuous feature, sorted again."""
    return {f.name: sorted(float(x) for x in read_small(spark, f"{folder}/{f.stem}_quantiles.txt")) for f in features if f.kind == CONTINUOUS}


def read_labeled_points(spark: SparkSession, path: str) -> DataFrame:
    """``label,f1 f2 ...`` as ``(label, features)``."""
    parts = F.split("value", ",")
    return spark.read.text(path).filter("trim(value) <> ''").select(F.get(parts, F.lit(0)).cast("double").alias("label"), F.split(F.trim(F.get(parts, F.lit(1))), r"\s+").cast("array<double>").alias("features"))


def write_labeled_points(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    _write_lines(df.select(F.concat_ws(",", F.col(label).cast("string"), F.concat_ws(" ", F.col(features).cast("array<string>"))).alias("value")), path)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """``user,item,rating``."""
    return spark.read.csv(path, schema="user int, item int, rating double")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Numbers separated by blanks, as ``features``."""
    return spark.read.text(path).filter("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").cast("array<double>").alias("features"))


def write_factors(df: DataFrame, path: str) -> None:
    """``id,v1 v2 ...``."""
    _write_lines(df.select(F.concat_ws(",", F.col("id").cast("string"), F.concat_ws(" ", F.col("factors").cast("array<string>"))).alias("value")), path)


#: Bytes that a compacted file is meant to hold at most. A task takes whole splits, so it may reach this plus one split.
FILE_BYTES = 64 << 20


def compact(spark: SparkSession, path: str, target: str, files: int = 1, most: int | None = FILE_BYTES) -> None:
    """Rewrite text part files as a given number of files, or as more where these would exceed ``most`` bytes.

    A file has one writer, so a fixed number of them would give each task a
    fixed share of the data. With ``most=None`` the number is kept at any size.
    """
    if most:
        # Of binary files only the lengths are asked for, so no contents are read.
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
        files = max(files, -(-size // most))
    _write_lines(spark.read.text(path).coalesce(files), target)


def write_scores(scored: DataFrame, path: str, columns: list[str], binary: bool = False) -> None:
    """The original fields and the score, with five decimals or as 0/1."""
    score = F.col("score").cast("string") if binary else F.format_string("%.5f", F.col("score").cast("double"))
    write_fields(scored, path, [*[F.col(f"`{c}`") for c in columns], score])


def uci_to_table(lines: DataFrame) -> DataFrame:
    """Rows of the public automobile file as tab-separated text: ``?`` is 0, and the make is the model name's first word."""
    numbers = F.split(F.trim(F.get(F.split("value", "\t"), F.lit(0))), r"\s+")
    make = F.get(F.split(F.regexp_replace(F.get(F.split("value", "\t"), F.lit(1)), '"', ""), " "), F.lit(0))
    return lines.filter("trim(value) <> ''").select(F.concat_ws("\t", F.transform(numbers, lambda x: F.when(x == "?", "0").otherwise(x)), make).alias("value"))
