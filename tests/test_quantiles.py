import random

from timberline.operators import encode


def expected(values, most):
    """Midpoints by sorting all values."""
    vs, n = sorted(values), len(values)
    cuts = min(most, n - 1)
    at = [int(q * n / (cuts + 1) - 1) for q in range(1, cuts + 1)]
    return sorted({(vs[i] + vs[i + 1]) / 2.0 for i in at})


def test_quantiles_take_all_rows(spark):
    """More rows than the former sample of 100,000: no value is lost."""
    df = spark.range(150_000).selectExpr("cast(id % 50 as double) as a", "cast(id % 7 as double) as b")
    q = encode.collect_quantiles(encode.quantile_table(df, ["a", "b"]))
    assert q["a"] == expected([i % 50 for i in range(150_000)], 1000)
    assert q["b"] == expected([i % 7 for i in range(150_000)], 1000)


def test_quantiles_agree_with_sorting(spark):
    draw = random.Random(4)
    for n, most in ((1, 20), (2, 20), (15, 20), (3000, 20), (3000, 1000)):
        x = [draw.choice((draw.random() * 9 - 3, 2.0)) for _ in range(n)]
        df = spark.createDataFrame([(v, None) for v in x] + [(None, None)], "x double, none double")
        assert encode.collect_quantiles(encode.quantile_table(df, ["x", "none"], most)) == {"x": expected(x, most)}
