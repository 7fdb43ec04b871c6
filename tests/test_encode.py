import random
from collections import Counter

from timberline.operators import encode
from timberline.spec import CATEGORICAL, FeatureSpec


def test_numbering_and_joined_dictionaries(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(i, f"v{draw.randrange(40)}" if draw.random() < 0.5 else f"rare{i}", draw.choice(("a", "", None, "é"))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, x string, y string")
    monkeypatch.setattr(encode, "VALUE_RANGES", 7)
    table = encode.build_dictionaries(df, ["x", "y"])
    got = encode.collect_dictionaries(table)
    for at, name in ((1, "x"), (2, "y")):
        counts = Counter(r[at] or "" for r in rows)
        assert got[name] == {v: i for i, v in enumerate(sorted(counts, key=lambda v: (-counts[v], v.encode())))}
    features = [FeatureSpec("x", CATEGORICAL), FeatureSpec("y", CATEGORICAL)]
    asked = spark.createDataFrame([*rows, (1000, "unknown", None)], "i int, x string, y string")
    want = sorted((i, float(got["x"].get(x, 0)), float(got["y"].get(y or "", 0))) for i, x, y in [*rows, (1000, "unknown", None)])
    assert sorted(map(tuple, encode.encode(asked, features, got).collect())) == want
    assert sorted(map(tuple, encode.encode(asked, features, table).select("i", "x", "y").collect())) == want
    monkeypatch.setattr(encode, "LITERAL_VALUES", 1)
    assert sorted(map(tuple, encode.encode(asked, features, got).select("i", "x", "y").collect())) == want
    assert encode.build_dictionaries(df.limit(0), ["x"]).count() == 0
