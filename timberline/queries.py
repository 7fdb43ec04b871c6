"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.losses import LOSSES, moments
from timberline.operators import clustering, encode, factorization, linear, metrics, prep
from timberline.operators.histogram import histogram
from timberline.operators.split import best_per_feature, best_splits
from timberline.plans import model
from timberline.plans.boost import residuals, train_forest
from timberline.plans.model import Forest, Node, Tree
from timberline.plans.tree import train_tree
from timberline.session import shared_path
from timberline.sources import models, tables
from timberline.spec import CATEGORICAL, CONTINUOUS, FeatureSpec, ForestParams, TreeParams
from timberline.tree_sql import ENTROPY, Training, significant

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(x: Column, n: int = 4) -> Column:
    """Rounded half up in binary, as any engine does it alike."""
    return F.floor(x * float(10**n) + 0.5).cast("double") / float(10**n)


def r(x: str, n: int = 4) -> str:
    return f"(floor(({x}) * {10**n}::DOUBLE + 0.5)::DOUBLE / {10**n}::DOUBLE)"


# Statistics and preparation


@query(f"SELECT count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS ss, avg(l_quantity) AS centroid, {r('sum(l_quantity * l_quantity) - sum(l_quantity) * sum(l_quantity) / count(*)', 3)} AS error FROM lineitem")
def global_stats(spark, sf):
    row = table(spark, sf, "lineitem").agg(*moments(F.col("l_quantity")))
    loss = LOSSES["square"]
    return row.select("n", "s", "ss", loss.centroid(F.col("w"), F.col("s")).alias("centroid"), places(loss.error(F.col("w"), F.col("s"), F.col("ss")), 3).alias("error"))


@query(f"SELECT 'l_quantity' AS \"column\", {r('avg(l_quantity)', 6)} AS mean, {r('stddev_pop(l_quantity)', 6)} AS sd FROM lineitem UNION ALL SELECT 'l_linenumber', {r('avg(l_linenumber)', 6)}, {r('stddev_pop(l_linenumber)', 6)} FROM lineitem")
def column_stats(spark, sf):
    return prep.column_stats(table(spark, sf, "lineitem"), ["l_quantity", "l_linenumber"]).select("column", places(F.col("mean"), 6).alias("mean"), places(F.col("sd"), 6).alias("sd"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 150000 THEN 1 ELSE 0 END AS o_totalprice FROM orders")
def label_binarize(spark, sf):
    return prep.binarize(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 150000)


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 0.5::DOUBLE WHEN o_totalprice < 200000 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS sample_weight FROM orders")
def weight_steps(spark, sf):
    return prep.attach_weights(table(spark, sf, "orders"), "o_totalprice", [50000, 200000], [0.5, 1.0, 2.0]).select("o_orderkey", "sample_weight")


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 200000 THEN 1.0::DOUBLE WHEN o_totalprice < 50000 THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END AS sample_weight FROM orders")
def weight_steps_legacy(spark, sf):
    return prep.attach_weights(table(spark, sf, "orders"), "o_totalprice", [50000, 200000], [0.5, 1.0, 2.0], legacy=True).select("o_orderkey", "sample_weight")


@query("SELECT * FROM (VALUES ('label', 1), ('l_quantity', 1), ('l_tax', 0), ('l_discount', 0)) t(name, weight)")
def feature_weights(spark, sf):
    return spark.createDataFrame(prep.feature_weights(["label", "l_quantity", "l_tax", "l_discount"], ["l_quantity", "l_tax"], ["l_tax"]), "name string, weight int")


@query("SELECT count(*) AS bad FROM events WHERE event_id % 5 NOT IN (0, 1)")
def label_validator(spark, sf):
    rows = table(spark, sf, "events").select((F.col("event_id") % 5).alias("label"))
    return spark.createDataFrame([(prep.invalid_labels(rows),)], "bad long")


@query(f"WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, {r('(l_quantity - m) / d', 6)} AS l_quantity FROM lineitem, s")
def standardize(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    stats = {x["column"]: (x["mean"], x["sd"]) for x in prep.column_stats(df, ["l_quantity"]).collect()}
    return prep.standardize(df, ["l_quantity"], stats).withColumn("l_quantity", places(F.col("l_quantity"), 6))


@query("SELECT o_orderkey FROM orders WHERE (o_orderkey * 2654435761) % 4294967296 < 429496729")
def sample(spark, sf):
    return prep.keyed_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.1)


@query("SELECT o_orderkey, CASE WHEN (o_orderkey * 2654435761) % 4294967296 < 3435973836 THEN 'train' ELSE 'test' END AS part FROM orders")
def train_test_split(spark, sf):
    whole = table(spark, sf, "orders").select("o_orderkey")
    train = prep.keyed_sample(whole, "o_orderkey", 0.8)
    return train.withColumn("part", F.lit("train")).unionByName(prep.subtract(whole, train).withColumn("part", F.lit("test")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_quantity > 45 AND b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber)")
def set_difference(spark, sf):
    rows = table(spark, sf, "lineitem")
    pair = ["l_orderkey", "l_linenumber"]
    return prep.subtract(rows.select(*pair), rows.filter("l_quantity > 45").select(*pair))


# Encoding

_DICT_SQL = """
WITH v AS (SELECT 'p_brand' AS feature, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part),
c AS (SELECT feature, value, count(*) AS cnt FROM v GROUP BY ALL),
d AS (SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, value) - 1 AS INT) AS id, cnt FROM c)
"""
_PART = [FeatureSpec("p_size"), FeatureSpec("p_brand", CATEGORICAL), FeatureSpec("p_type", CATEGORICAL)]


@query(_DICT_SQL + "SELECT * FROM d")
def dict_build(spark, sf):
    return encode.build_dictionaries(table(spark, sf, "part"), ["p_brand", "p_type"])


def _part_encoded(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    return encode.encode(part, _PART, encode.collect_dictionaries(encode.build_dictionaries(part, ["p_brand", "p_type"])))


@query(_DICT_SQL + "SELECT p_partkey, p_size::DOUBLE AS p_size, b.id::DOUBLE AS p_brand, t.id::DOUBLE AS p_type FROM part JOIN d b ON b.feature = 'p_brand' AND b.value = p_brand JOIN d t ON t.feature = 'p_type' AND t.value = p_type")
def dict_encode(spark, sf):
    return _part_encoded(spark, sf)


@query(_DICT_SQL + "SELECT CAST((SELECT max(id) + 1 FROM d WHERE feature = 'p_brand') AS INT) AS p_brand, CAST((SELECT max(id) + 1 FROM d WHERE feature = 'p_type') AS INT) AS p_type")
def cardinality(spark, sf):
    return encode.cardinalities(_part_encoded(spark, sf), _PART)


@query("WITH c AS (SELECT l_orderkey::VARCHAR AS value, count(*) AS cnt FROM lineitem GROUP BY 1), d AS (SELECT value, row_number() OVER (ORDER BY cnt DESC, value) - 1 AS id FROM c), e AS (SELECT CASE WHEN l_linenumber = 3 THEN 'strange' ELSE l_orderkey::VARCHAR END AS value, l_linenumber FROM lineitem) SELECT l_linenumber, count(*) AS n, sum(coalesce(id, 0))::DOUBLE AS ids, max(coalesce(id, 0))::DOUBLE AS most FROM e LEFT JOIN d USING (value) GROUP BY l_linenumber")
def dict_encode_large(spark, sf):
    """A dictionary of many values, joined as a table; values that it lacks have id 0."""
    rows = table(spark, sf, "lineitem").select("l_linenumber", F.col("l_orderkey").cast("string").alias("key"))
    known = encode.build_dictionaries(rows, ["key"])
    asked = rows.withColumn("key", F.when(F.col("l_linenumber") == 3, "strange").otherwise(F.col("key")))
    return encode.encode(asked, [FeatureSpec("key", CATEGORICAL)], known).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum("key").alias("ids"), F.max("key").alias("most"))


@query("SELECT DISTINCT value FROM (SELECT p_brand AS value FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT p_brand FROM part WHERE p_size > 10)")
def dict_union(spark, sf):
    part = table(spark, sf, "part")
    return encode.union_values([part.select(F.col("p_brand").alias("value")), part.select(F.col("p_type").alias("value")), part.filter("p_size > 10").select(F.col("p_brand").alias("value"))])


_Q_SQL = """
WITH v AS (SELECT list(x ORDER BY x) AS vs, count(*) AS n FROM (SELECT o_totalprice::DOUBLE AS x FROM orders)),
k AS (SELECT vs, n, least(20, n - 1) AS cuts FROM v),
q AS (SELECT DISTINCT (vs[1 + trunc(i * n / (cuts + 1) - 1)::BIGINT] + vs[2 + trunc(i * n / (cuts + 1) - 1)::BIGINT]) / 2.0 AS t FROM k, range(1, 21) r(i) WHERE i <= cuts)
"""


@query(_Q_SQL + "SELECT t FROM q")
def quantiles(spark, sf):
    return encode.quantile_table(table(spark, sf, "orders"), ["o_totalprice"], 20).select(F.explode("thresholds").alias("t"))


@query(_Q_SQL + "SELECT bin, count(*) AS cnt FROM (SELECT (SELECT count(*) FROM q WHERE t <= o_totalprice)::INT AS bin FROM orders) GROUP BY bin")
def quantile_bins(spark, sf):
    orders = table(spark, sf, "orders").select("o_totalprice")
    q = encode.collect_quantiles(encode.quantile_table(orders, ["o_totalprice"], 20))
    return orders.select(encode.bin_of(F.col("o_totalprice"), q["o_totalprice"]).alias("bin")).groupBy("bin").agg(F.count("*").alias("cnt"))


# Histograms and splits: label, weight and four features of lineitem

_FEATURES = [FeatureSpec("quantity"), FeatureSpec("linenumber"), FeatureSpec("returnflag$", CATEGORICAL), FeatureSpec("linestatus$", CATEGORICAL)]
_FLAGS = {"returnflag$": {"A": 0, "N": 1, "R": 2}, "linestatus$": {"F": 0, "O": 1}}
_THRESHOLDS = {"quantity": [i + 0.5 for i in range(1, 50)], "linenumber": [i + 0.5 for i in range(1, 7)]}


def lineitem_features(spark, sf) -> DataFrame:
    df = table(spark, sf, "lineitem")
    label = ((F.col("l_quantity") >= 25) & (F.col("l_returnflag") == "R") | (F.col("l_linenumber") == 7)).cast("double")
    return df.select(label.alias("label"), (1.0 + F.col("l_linenumber") % 3).alias("weight"), F.col("l_quantity").alias("quantity"), F.col("l_linenumber").cast("double").alias("linenumber"), F.col("l_returnflag").alias("returnflag$"), F.col("l_linestatus").alias("linestatus$"))


def _binned(spark, sf):
    return encode.bin_columns(encode.encode(lineitem_features(spark, sf), _FEATURES, _FLAGS), _FEATURES, _THRESHOLDS)


def _hist_sql(weight: str = "1.0::DOUBLE") -> str:
    cells = " UNION ALL ".join(f"SELECT {i}::INT AS feature_id, CAST({b} AS INT) AS bin, y, w FROM f" for i, b in enumerate(("l_quantity - 1", "l_linenumber - 1", "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 0 END", "CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 0 END")))
    return f"""
WITH f AS (SELECT *, CASE WHEN (l_quantity >= 25 AND l_returnflag = 'R') OR l_linenumber = 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, {weight} AS w FROM lineitem),
c AS ({cells}),
h AS (SELECT 1::INT AS node_id, feature_id, bin, count(*) AS n, sum(w)::DOUBLE AS w, sum(w * y)::DOUBLE AS s, sum(w * y * y)::DOUBLE AS ss FROM c GROUP BY feature_id, bin)
"""


_WEIGHT_SQL = "(1.0 + l_linenumber % 3)::DOUBLE"


@query(_hist_sql() + "SELECT * FROM h WHERE feature_id < 2")
def hist_numeric(spark, sf):
    return histogram(_binned(spark, sf), [0, 1])


@query(_hist_sql() + "SELECT * FROM h WHERE feature_id >= 2")
def hist_categorical(spark, sf):
    return histogram(_binned(spark, sf), [2, 3])


@query(_hist_sql(_WEIGHT_SQL) + "SELECT * FROM h")
def hist_all(spark, sf):
    return histogram(_binned(spark, sf), [0, 1, 2, 3], weight="weight")


def _split_sql(weight: str, error: str) -> str:
    """The split search in SQL. ``error`` is a formula over {w}, {s}, {ss}."""
    e = lambda p: "(" + error.replace("{w}", f"{p}w").replace("{ss}", f"{p}q").replace("{s}", f"{p}s") + ")"
    forward = "OVER (PARTITION BY feature_id ORDER BY key, bin ROWS UNBOUNDED PRECEDING)"
    backward = "OVER (PARTITION BY feature_id ORDER BY key DESC, bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return _hist_sql(weight) + f""",
k AS (SELECT *, CASE WHEN feature_id >= 2 THEN s / w ELSE bin::DOUBLE END AS key FROM h),
c2 AS (SELECT *, sum(w) {forward} AS lw, sum(s) {forward} AS ls, sum(ss) {forward} AS lq, sum(w) {backward} AS rw, sum(s) {backward} AS rs, sum(ss) {backward} AS rq,
  sum(w) OVER (PARTITION BY feature_id) AS tw, sum(s) OVER (PARTITION BY feature_id) AS ts, sum(ss) OVER (PARTITION BY feature_id) AS tq,
  row_number() OVER (PARTITION BY feature_id ORDER BY key, bin) - 1 AS pos, count(*) OVER (PARTITION BY feature_id) AS bins FROM k),
e AS (SELECT *, {e('t')} AS node_error, CASE WHEN pos < bins - 1 THEN {e('l')} + {e('r')} END AS split_error FROM c2),
b AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY {significant('coalesce(split_error, node_error)')}, split_error IS NULL, pos) AS rk FROM e),
best AS (SELECT feature_id, pos::INT AS pos, bin, node_error, coalesce(split_error, node_error) AS split_error, node_error - coalesce(split_error, node_error) AS gain FROM b WHERE rk = 1)
SELECT feature_id, pos, bin, {r('node_error')} AS node_error, {r('split_error')} AS split_error, {r('gain')} AS gain FROM best
"""


_SQUARE_SQL = "CASE WHEN {w} <> 0 THEN {ss} - {s} * {s} / {w} ELSE 0 END"
_ENTROPY_SQL = "CASE WHEN {s} / {w} > 1e-10 AND {s} / {w} < 1 - 1e-10 THEN {w} * -({s} / {w} * log2({s} / {w}) + (1 - {s} / {w}) * log2(1 - {s} / {w})) ELSE 0 END"


def _splits(spark, sf, loss: str, weight: str | None) -> DataFrame:
    hist = histogram(_binned(spark, sf), [0, 1, 2, 3], weight=weight)
    out = best_per_feature(hist, LOSSES[loss], [2, 3], with_bins=False)
    return out.select("feature_id", "pos", "bin", places(F.col("node_error")).alias("node_error"), places(F.col("split_error")).alias("split_error"), places(F.col("gain")).alias("gain"))


@query(_split_sql("1.0::DOUBLE", _SQUARE_SQL))
def split_root_square(spark, sf):
    return _splits(spark, sf, "square", None)


@query(_split_sql("1.0::DOUBLE", _ENTROPY_SQL))
def split_root_entropy(spark, sf):
    return _splits(spark, sf, "entropy", None)


@query(_split_sql(_WEIGHT_SQL, _SQUARE_SQL))
def split_root_weighted(spark, sf):
    return _splits(spark, sf, "square", "weight")


@query(_split_sql("1.0::DOUBLE", _SQUARE_SQL).replace("FROM best\n", "FROM best ORDER BY gain * CASE WHEN feature_id = 0 THEN 0.5 ELSE 1.0 END DESC, feature_id LIMIT 1"))
def split_best_weighted_feature(spark, sf):
    hist = histogram(_binned(spark, sf), [0, 1, 2, 3])
    out = best_splits(hist, LOSSES["square"], [2, 3], {0: 0.5, 1: 1.0, 2: 1.0, 3: 1.0})
    return out.select("feature_id", "pos", "bin", places(F.col("node_error")).alias("node_error"), places(F.col("split_error")).alias("split_error"), places(F.col("gain")).alias("gain"))


def _encoded(spark, sf):
    return encode.encode(lineitem_features(spark, sf), _FEATURES, _FLAGS)


def _shown(nodes: DataFrame) -> DataFrame:
    rounded = {c: places(F.col(c), 6) for c in ("response", "error", "split_error", "gain")}
    return nodes.withColumns(rounded | {c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in ("left_ids", "right_ids", "left_values", "right_values")})


_BASE_SQL = "base AS (SELECT CASE WHEN (l_quantity >= 25 AND l_returnflag = 'R') OR l_linenumber = 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, {} AS w, l_quantity AS x0, l_linenumber AS x1, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS b2, CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 0 END AS b3 FROM lineitem)"


def _training_sql(weight: str = "1.0::DOUBLE", **options) -> str:
    how = Training(("quantity", "linenumber", "returnflag$", "linestatus$"), (None, None, ("A", "N", "R"), ("F", "O")), **options)
    return how.sql(_BASE_SQL.format(weight), lambda c: r(c, 6))


@query(_training_sql(depth=4, min_gain_fraction=0.001))
def tree_nodes(spark, sf):
    return _shown(train_tree(_encoded(spark, sf), _FEATURES, TreeParams(max_depth=4, min_gain_fraction=0.001), dictionaries=_FLAGS).table(spark))


@query(_training_sql(_WEIGHT_SQL, error=ENTROPY, depth=3, min_gain_fraction=0.001))
def tree_nodes_entropy_weighted(spark, sf):
    return _shown(train_tree(_encoded(spark, sf), _FEATURES, TreeParams(loss="entropy", max_depth=3, min_gain_fraction=0.001), weight="weight", dictionaries=_FLAGS).table(spark))


@query(_training_sql(depth=2, min_gain_fraction=0.01, local=True))
def tree_nodes_simple(spark, sf):
    return _shown(train_tree(_encoded(spark, sf), _FEATURES, TreeParams(max_depth=2, use_global_quantiles=False, batch_size=1), dictionaries=_FLAGS).table(spark))


@query(_training_sql(depth=3, min_gain_fraction=0.001, trees=3, shrinkage=0.8))
def forest_nodes(spark, sf):
    params = ForestParams(TreeParams(max_depth=3, min_gain_fraction=0.001), num_trees=3, persist_interval=2)
    return _shown(train_forest(_encoded(spark, sf), _FEATURES, params, dictionaries=_FLAGS).table(spark))


@query(_training_sql(depth=2, min_gain_fraction=0.001, trees=4, shrinkage=0.8))
def forest_warm_start(spark, sf):
    params = ForestParams(TreeParams(max_depth=2, min_gain_fraction=0.001), num_trees=2)
    first = train_forest(_encoded(spark, sf), _FEATURES, params, dictionaries=_FLAGS)
    return _shown(train_forest(_encoded(spark, sf), _FEATURES, params, dictionaries=_FLAGS, init_model=first).table(spark))


# Fixed models, so that scoring and printing have SQL


def _cut(i, response, feature_id, **split) -> Node:
    f = _FEATURES[feature_id]
    return Node(i, i.bit_length() - 1, 0, 0.0, response, 10.0 / i, 5.0 / i, 5.0 / i, feature_id, f.kind, f.name, **split)


def _leaf(i, response) -> Node:
    return Node(i, i.bit_length() - 1, 0, 0.0, response)


_TREE_A = Tree({n.node_id: n for n in (_cut(1, 0.25, 0, threshold=25.5), _leaf(2, 0.125), _cut(3, 0.5, 2, left_ids=(2,), right_ids=(0, 1), left_values=("R",), right_values=("A", "N")), _leaf(6, 0.75), _cut(7, 0.25, 1, threshold=3.5), _leaf(14, 0.0625), _leaf(15, 0.375))})
_TREE_B = Tree({n.node_id: n for n in (_cut(1, 0.25, 1, threshold=5.5), _leaf(2, -0.0625), _leaf(3, 0.25))})
_FOREST = Forest((_TREE_A, _TREE_B), tuple(_FEATURES))
_A_SQL = "CASE WHEN l_quantity < 25.5 THEN 0.125 WHEN l_returnflag IN ('R') THEN 0.75 WHEN l_linenumber < 3.5 THEN 0.0625 ELSE 0.375 END"
_B_SQL = "CASE WHEN l_linenumber < 5.5 THEN -0.0625 ELSE 0.25 END"
_Y_SQL = "CASE WHEN (l_quantity >= 25 AND l_returnflag = 'R') OR l_linenumber = 7 THEN 1 ELSE 0 END"


@query(f"SELECT ({_A_SQL})::DOUBLE AS score, count(*) AS n FROM lineitem GROUP BY 1")
def tree_predict(spark, sf):
    return Forest((_TREE_A,)).scored(_encoded(spark, sf), raw=False).groupBy("score").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN l_quantity < 25.5 THEN 2 WHEN l_returnflag IN ('R') THEN 6 WHEN l_linenumber < 3.5 THEN 14 ELSE 15 END AS node_id, count(*) AS n, sum({_Y_SQL})::DOUBLE AS s FROM lineitem GROUP BY 1")
def tree_leaf_stats(spark, sf):
    return _encoded(spark, sf).groupBy(_TREE_A.leaf_of(model.encoded_test).alias("node_id")).agg(F.count("*").alias("n"), F.sum("label").alias("s"))


@query(f"SELECT (({_A_SQL}) + ({_B_SQL}))::DOUBLE AS score, CASE WHEN ({_A_SQL}) + ({_B_SQL}) >= 0.5 THEN 1 ELSE 0 END AS class, count(*) AS n FROM lineitem GROUP BY ALL")
def forest_predict(spark, sf):
    df = lineitem_features(spark, sf)
    return df.select(_FOREST.predict(raw=True).alias("score"), _FOREST.binary(0.5, raw=True).alias("class")).groupBy("score", "class").agg(F.count("*").alias("n"))


@query(f"SELECT ({_Y_SQL} - (({_A_SQL}) + ({_B_SQL})))::DOUBLE AS label, count(*) AS n FROM lineitem GROUP BY 1")
def residual_labels(spark, sf):
    return residuals(_encoded(spark, sf), _FOREST).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('quantity', 100.0::DOUBLE), ('linenumber', 100.0 * (5.0/7 + 5) / 5), ('returnflag$', 100.0 * (5.0/3) / 5)) t(feature, importance)".replace("100.0::DOUBLE", "100.0 * 5.0 / (5.0/7 + 5)").replace("100.0 * (5.0/7 + 5) / 5", "100.0::DOUBLE").replace("100.0 * (5.0/3) / 5)", "100.0 * (5.0/3) / (5.0/7 + 5))").replace("SELECT *", f"SELECT feature, {r('importance')} AS importance"))
def importances(spark, sf):
    return model.feature_importances(_FOREST.table(spark)).withColumn("importance", places(F.col("importance")))


@query(f"SELECT subset, size, {r('gain')} AS gain FROM (VALUES ('quantity', 1, 5.0::DOUBLE), ('quantity,returnflag$', 2, 5 + 5.0/3), ('returnflag$', 1, 5.0/3), ('linenumber', 1, 5.0/7 + 5), ('linenumber,returnflag$', 2, 5.0/7 + 5.0/3), ('linenumber,quantity,returnflag$', 3, 5 + 5.0/3 + 5.0/7)) t(subset, size, gain)")
def subset_gains(spark, sf):
    return model.subset_gains(_FOREST.table(spark)).withColumn("gain", places(F.col("gain")))


def _lines_sql(*lines: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(lines)) + ") t(pos, line)"


@query(
    _lines_sql(
        "m = 0", "  i = 1, y = 0.25000, n = 0, x = quantity, t = 25.500", "    i = 2, y = 0.12500, n = 0", "    i = 3, y = 0.50000, n = 0, x = returnflag$, t = {R} : {A,N}", "      i = 6, y = 0.75000, n = 0",
        "      i = 7, y = 0.25000, n = 0, x = linenumber, t = 3.5000", "        i = 14, y = 0.062500, n = 0", "        i = 15, y = 0.37500, n = 0", "m = 1", "  i = 1, y = 0.25000, n = 0, x = linenumber, t = 5.5000", "    i = 2, y = -0.062500, n = 0", "    i = 3, y = 0.25000, n = 0",
    )
)
def explain(spark, sf):
    return spark.createDataFrame(list(enumerate(models.explain_forest(_FOREST))), "pos int, line string")


@query(
    _lines_sql(
        '// Use "dot -T pdf tree.dot -o tree.pdf" to compile.', "", "digraph regression_tree {",
        '  1 [ shape=record, label="{ i = 1 | x = quantity, t =25.5 | y = 0.25 | n = 0, w = 0.0 | e = 10, e\' = 5.0 }" ];', '    2 [ shape=record, label="{ i = 2 | y = 0.12 | n = 0, w = 0.0 | e = 0.0 }" ];',
        '    3 [ shape=record, label="{ i = 3 | x = returnflag$, t =1:2 | y = 0.50 | n = 0, w = 0.0 | e = 3.3, e\' = 1.7 }" ];', '      6 [ shape=record, label="{ i = 6 | y = 0.75 | n = 0, w = 0.0 | e = 0.0 }" ];',
        '      7 [ shape=record, label="{ i = 7 | x = linenumber, t =3.5 | y = 0.25 | n = 0, w = 0.0 | e = 1.4, e\' = 0.71 }" ];', '        14 [ shape=record, label="{ i = 14 | y = 0.062 | n = 0, w = 0.0 | e = 0.0 }" ];',
        '        15 [ shape=record, label="{ i = 15 | y = 0.38 | n = 0, w = 0.0 | e = 0.0 }" ];', "", "  1 -> 2; 1 -> 3;", "    3 -> 6; 3 -> 7;", "      7 -> 14; 7 -> 15;", "}",
    )
)
def graphviz(spark, sf):
    return spark.createDataFrame(list(enumerate(models.dot_tree(_TREE_A))), "pos int, line string")


_DETAILS = {
    1: ("i = 1", "d = 0", "y = 0.25", "x = quantity", "t = 25.5", "path ="),
    2: ("i = 2", "d = 1", "y = 0.125", "x = <leaf>", "path =", "  i = 1, quantity < 25.5"),
    3: ("i = 3", "d = 1", "y = 0.5", "x = returnflag$", "t = {R} : {A,N}", "path =", "  i = 1, quantity >= 25.5"),
    6: ("i = 6", "d = 2", "y = 0.75", "x = <leaf>", "path =", "  i = 1, quantity >= 25.5", "  i = 3, returnflag$ <- {R}"),
    7: ("i = 7", "d = 2", "y = 0.25", "x = linenumber", "t = 3.5", "path =", "  i = 1, quantity >= 25.5", "  i = 3, returnflag$ <- {A,N}"),
    14: ("i = 14", "d = 3", "y = 0.0625", "x = <leaf>", "path =", "  i = 1, quantity >= 25.5", "  i = 3, returnflag$ <- {A,N}", "  i = 7, linenumber < 3.5"),
    15: ("i = 15", "d = 3", "y = 0.375", "x = <leaf>", "path =", "  i = 1, quantity >= 25.5", "  i = 3, returnflag$ <- {A,N}", "  i = 7, linenumber >= 3.5"),
}


@query(" UNION ALL ".join(f"SELECT {i} AS node_id, * FROM ({_lines_sql(*lines)})" for i, lines in _DETAILS.items()))
def node_details(spark, sf):
    rows = [(n.node_id, i, line) for n in _TREE_A.preorder() for i, line in enumerate(models.node_details(_TREE_A, n.node_id))]
    return spark.createDataFrame(rows, "node_id int, pos int, line string")


@query(f"SELECT subset, {r('importance')} AS importance FROM (VALUES ('linenumber', 100.0::DOUBLE), ('quantity,returnflag$', 100 * (5 + 5.0/3) / (5 + 5.0/3)), ('quantity', 100 * 5 / (5 + 5.0/3)), ('returnflag$', 100 * (5.0/3) / (5 + 5.0/3)), ('linenumber,returnflag$', 100 * (5.0/7 + 5.0/3) / (5 + 5.0/3))) t(subset, importance)".replace("('linenumber', 100.0::DOUBLE)", "('linenumber', 100 * (5 + 5.0/7) / (5 + 5.0/3))"))
def subset_importances(spark, sf):
    return model.subset_importances(_FOREST.table(spark), 2).withColumn("importance", places(F.col("importance")))


# Metrics: a score and a label that any engine computes alike

_SCORES_SQL = "WITH p AS (SELECT ((event_id * 2654435761) % 1000) / 1000.0::DOUBLE AS score, CASE WHEN (event_id * 40503) % 7 < 3 THEN 1 ELSE 0 END AS label FROM events)"


def _scores(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select((((e * 2654435761) % 1000) / 1000.0).alias("score"), F.when((e * 40503) % 7 < 3, 1).otherwise(0).alias("label"))


@query(_SCORES_SQL + f" SELECT count(*) AS n, {r('sqrt(avg((score - label) * (score - label)))', 6)} AS rmse, {r('avg(abs(score - label))', 6)} AS mae, 0.25::DOUBLE AS trivial_response, {r('sqrt(avg((0.25 - label) * (0.25 - label)))', 6)} AS trivial_rmse, {r('avg(abs(0.25 - label))', 6)} AS trivial_mae FROM p")
def error_stats(spark, sf):
    row = metrics.error_stats(_scores(spark, sf), trivial=0.25)
    return row.select("n", "trivial_response", *[places(F.col(c), 6).alias(c) for c in ("rmse", "mae", "trivial_rmse", "trivial_mae")])


_CONFUSION = "count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, sum(CASE WHEN CASE WHEN label = 1 THEN score ELSE 1 - score END > 0 THEN greatest(ln(CASE WHEN label = 1 THEN score ELSE 1 - score END), -10) ELSE -10 END) AS ll"


@query(_SCORES_SQL + f" SELECT tn, fp, fn, tp, {r('ll', 3)} AS ll FROM (SELECT {_CONFUSION} FROM p)")
def confusion(spark, sf):
    return metrics.confusion(_scores(spark, sf)).withColumn("ll", places(F.col("ll"), 3))


_H = "(-((tp + fn) / n * log2((tp + fn) / n) + (tn + fp) / n * log2((tn + fp) / n)))"


@query(_SCORES_SQL + f" SELECT {r('-ll / n / ln(2)', 6)} AS nll, {r(_H, 6)} AS entropy, {r(f'1 - (-ll / n / ln(2)) / {_H}', 6)} AS rig, {r('tp / (tp + fn)', 6)} AS tpr, {r('fp / (tn + fp)', 6)} AS fpr, {r('tp / (tp + fp)', 6)} AS precision, {r('2 * tp / (2 * tp + fp + fn)', 6)} AS f1, {r('(tp + tn) / n', 6)} AS accuracy FROM (SELECT tn::DOUBLE AS tn, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tp::DOUBLE AS tp, ll, (tn + fp + fn + tp)::DOUBLE AS n FROM (SELECT {_CONFUSION} FROM p))")
def nll_rig(spark, sf):
    row = metrics.classification_report(_scores(spark, sf))
    return row.select(*[places(F.col(c), 6).alias(c) for c in ("nll", "entropy", "rig", "tpr", "fpr", "precision", "f1", "accuracy")])


@query(_SCORES_SQL + f" SELECT {r('sum((label - score) * (label - score))')} AS square, {r('sum(CASE WHEN CASE WHEN label = 1 THEN score ELSE 1 - score END > 1e-10 THEN -log2(CASE WHEN label = 1 THEN score ELSE 1 - score END) ELSE -log2(1e-10) END)')} AS entropy FROM p")
def point_losses(spark, sf):
    y, p = F.col("label").cast("double"), F.col("score")
    return _scores(spark, sf).agg(*[places(F.sum(LOSSES[k].point(y, p))).alias(k) for k in ("square", "entropy")])


_CURVE_SQL = _SCORES_SQL + ", g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM p GROUP BY score), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS allp, sum(neg) OVER () AS alln FROM g)"


@query(_CURVE_SQL + f" SELECT score, {r('fp::DOUBLE / alln', 6)} AS fpr, {r('tp::DOUBLE / allp', 6)} AS tpr FROM c")
def roc(spark, sf):
    return metrics.roc(_scores(spark, sf)).select("score", places(F.col("fpr"), 6).alias("fpr"), places(F.col("tpr"), 6).alias("tpr"))


@query(_CURVE_SQL + f" SELECT {r('score', 6)} AS score, {r('(fp - neg + k)::DOUBLE / alln', 6)} AS fpr, {r('(tp - pos)::DOUBLE / allp', 6)} AS tpr FROM (SELECT *, unnest(range(0, neg::BIGINT)) AS k FROM c WHERE neg > 0) UNION ALL SELECT {r('max(score) + 0.1', 6)}, 0, 0 FROM p UNION ALL SELECT {r('min(score) - 0.1', 6)}, 1, 1 FROM p")
def roc_points(spark, sf):
    return metrics.roc_points(_scores(spark, sf)).select(*[places(F.col(c), 6).alias(c) for c in ("score", "fpr", "tpr")])


@query(_CURVE_SQL + f" SELECT {r('sum(neg * (tp - pos))::DOUBLE / max(allp) / max(alln)', 8)} AS auc FROM c")
def auc(spark, sf):
    return metrics.auc(_scores(spark, sf)).select(places(F.col("auc"), 8).alias("auc"))


# Companion algorithms

_K = 5
_KM_SQL = """
WITH c AS (SELECT vec_id AS cluster, embedding AS ce FROM embeddings WHERE vec_id < 5),
d AS (SELECT vec_id, cluster::INT AS cluster, list_sum([(embedding[i]::DOUBLE - ce[i]::DOUBLE) * (embedding[i]::DOUBLE - ce[i]::DOUBLE) FOR i IN range(1, 65)]) AS cost, embedding FROM embeddings, c),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost, cluster) AS rk FROM d) WHERE rk = 1)
"""


def _centers(spark, sf):
    rows = table(spark, sf, "embeddings").filter(F.col("vec_id") < _K).orderBy("vec_id").collect()
    return [list(map(float, x["embedding"])) for x in rows]


@query(_KM_SQL + f"SELECT vec_id, cluster, {r('cost', 6)} AS cost FROM a")
def kmeans_assign(spark, sf):
    return clustering.assign(table(spark, sf, "embeddings"), _centers(spark, sf), "embedding").select("vec_id", "cluster", places(F.col("cost"), 6).alias("cost"))


@query(_KM_SQL + f"SELECT cluster, count(*) AS n, {r('sum(embedding[1]::DOUBLE)', 6)} AS s0, {r('sum(embedding[64]::DOUBLE)', 6)} AS s63 FROM a GROUP BY cluster")
def kmeans_step(spark, sf):
    return clustering.cluster_sums(table(spark, sf, "embeddings"), {0: _centers(spark, sf)}, "embedding").select("cluster", "n", places(F.col("s0"), 6).alias("s0"), places(F.col("s63"), 6).alias("s63"))


@query(_KM_SQL + f"SELECT {r('sum(cost)', 4)} AS cost FROM a")
def kmeans_cost(spark, sf):
    return clustering.assign(table(spark, sf, "embeddings"), _centers(spark, sf), "embedding").agg(places(F.sum("cost"), 4).alias("cost"))


def _lloyd_sql(steps: int) -> str:
    """Lloyd's iterations from the first five vectors."""
    parts = ["c0 AS MATERIALIZED (SELECT vec_id::INT AS cluster, list_transform(embedding, lambda x: x::DOUBLE) AS ce FROM embeddings WHERE vec_id < 5)"]
    for k in range(steps):
        cost = "list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - ce[i]) * (embedding[i]::DOUBLE - ce[i])))"
        parts.append(f"a{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost, cluster) AS rk FROM (SELECT vec_id, embedding, cluster, {cost} AS cost FROM embeddings, c{k})) WHERE rk = 1)")
        parts.append(f"m{k} AS MATERIALIZED (SELECT cluster, i, avg(embedding[i]::DOUBLE) AS m FROM a{k}, range(1, 65) r(i) GROUP BY cluster, i)")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(list(m ORDER BY i) FILTER (m IS NOT NULL), any_value(o.ce)) AS ce FROM c{k} o LEFT JOIN m{k} n ON n.cluster = o.cluster GROUP BY o.cluster)")
    return "WITH " + ", ".join(parts) + f" SELECT cluster AS cluster_id, {r('ce[1]', 6)} AS first, {r('ce[64]', 6)} AS last, {r('list_sum(ce)', 6)} AS total FROM c{steps}"


@query(_lloyd_sql(3))
def kmeans_train(spark, sf):
    found = clustering.kmeans(table(spark, sf, "embeddings"), _K, iterations=3, features="embedding", initial=_centers(spark, sf))
    total = F.aggregate("center", F.lit(0.0), lambda x, y: x + y)
    return found.table(spark).select("cluster_id", places(F.get("center", F.lit(0)), 6).alias("first"), places(F.get("center", F.lit(63)), 6).alias("last"), places(total, 6).alias("total"))


def _points(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.select(((F.col("l_quantity") >= 25) & (F.col("l_returnflag") == "R")).cast("double").alias("label"), F.array(F.lit(1.0), F.col("l_quantity") / 50.0, F.col("l_linenumber") / 7.0).alias("features"))


_SGD_BASE = "WITH f AS (SELECT CASE WHEN l_quantity >= 25 AND l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END AS y, 1.0::DOUBLE AS x0, l_quantity / 50.0::DOUBLE AS x1, l_linenumber / 7.0::DOUBLE AS x2 FROM lineitem), m AS (SELECT *, 0.5 * x0 - 0.25 * x1 + 0.125 * x2 AS m FROM f), k AS (SELECT *, {k} AS k, {l} AS l FROM m) SELECT count(*) AS n, " + r("sum(l)", 3) + " AS loss, " + ", ".join(f"{r(f'sum(k * x{j})', 3)} AS g{j}" for j in range(3)) + " FROM k"
_START = [0.5, -0.25, 0.125]


def _sgd(spark, sf, kind):
    row = linear.gradient_sums(_points(spark, sf), kind, _START)
    return row.select("n", *[places(F.col(c), 3).alias(c) for c in ("loss", "g0", "g1", "g2")])


@query(_SGD_BASE.replace("{k}", "1 / (1 + exp(-m)) - y").replace("{l}", "ln(1 + exp(-m)) + CASE WHEN y > 0 THEN 0 ELSE m END"))
def sgd_step_logistic(spark, sf):
    return _sgd(spark, sf, "logistic")


@query(_SGD_BASE.replace("{k}", "m - y").replace("{l}", "0.5 * (m - y) * (m - y)"))
def sgd_step_linear(spark, sf):
    return _sgd(spark, sf, "squared")


@query(_SGD_BASE.replace("{k}", "CASE WHEN (2 * y - 1) * m < 1 THEN -(2 * y - 1) ELSE 0 END").replace("{l}", "greatest(0, 1 - (2 * y - 1) * m)"))
def sgd_step_svm(spark, sf):
    return _sgd(spark, sf, "hinge")


def _descent_sql(multiplier: str, steps: int) -> str:
    """Gradient steps from weights of 1; {m} is the margin, {y} the label."""
    parts = ["f AS MATERIALIZED (SELECT CASE WHEN l_quantity >= 25 AND l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END AS y, l_quantity / 50.0::DOUBLE AS x1, l_linenumber / 7.0::DOUBLE AS x2 FROM lineitem)", "w0 AS MATERIALIZED (SELECT 1.0::DOUBLE AS a, 1.0::DOUBLE AS b, 1.0::DOUBLE AS c)"]
    for k in range(steps):
        parts.append(f"g{k} AS MATERIALIZED (SELECT avg(k) AS a, avg(k * x1) AS b, avg(k * x2) AS c FROM (SELECT x1, x2, {multiplier.format(m='(a + b * x1 + c * x2)', y='y')} AS k FROM f, w{k}))")
        parts.append(f"w{k + 1} AS MATERIALIZED (SELECT " + ", ".join(f"w.{v} - g.{v} / sqrt({k + 1}) AS {v}" for v in "abc") + f" FROM w{k} w, g{k} g)")
    return "WITH " + ", ".join(parts) + f" SELECT {r('a', 6)} AS intercept, {r('b', 6)} AS w0, {r('c', 6)} AS w1 FROM w{steps}"


@query(_descent_sql("1 / (1 + exp(-{m})) - {y}", 5))
def logistic_train(spark, sf):
    rows = _points(spark, sf).select("label", F.slice("features", 2, 2).alias("features"))
    found = linear.logistic_regression(rows, iterations=5)
    return spark.createDataFrame([(float(found.intercept), *map(float, found.weights))], "intercept double, w0 double, w1 double").select(*[places(F.col(c), 6).alias(c) for c in ("intercept", "w0", "w1")])


def _ratings(spark, sf):
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 50).alias("user"), (F.col("o_orderkey") % 20).alias("item"), (F.floor("o_totalprice") % 5).cast("double").alias("rating"))


_RATING_SQL = "WITH t AS (SELECT o_custkey % 50 AS u, o_orderkey % 20 AS i, (floor(o_totalprice)::BIGINT % 5)::DOUBLE AS r FROM orders), x AS (SELECT u, r, 1.0::DOUBLE AS x0, (i % 3)::DOUBLE AS x1 FROM t)"


@query(_RATING_SQL + " SELECT u AS id, count(*) AS n, sum(x0 * x0) AS a0_0, sum(x0 * x1) AS a0_1, sum(x1 * x1) AS a1_1, sum(r * x0) AS b0, sum(r * x1) AS b1 FROM x GROUP BY u")
def als_normal_eq(spark, sf):
    data = _ratings(spark, sf)
    items = data.select(F.col("item").alias("id")).distinct().withColumn("factors", F.array(F.lit(1.0), (F.col("id") % 3).cast("double")))
    return factorization.normal_equations(data, items, "user", "item", 2)


@query(_RATING_SQL + " SELECT DISTINCT u AS \"user\", i AS item, ((u % 3) * (i % 2) + 2.0)::DOUBLE AS prediction FROM t")
def als_predict(spark, sf):
    pairs = _ratings(spark, sf).select("user", "item").distinct()
    users = pairs.select(F.col("user").alias("id")).distinct().withColumn("factors", F.array((F.col("id") % 3).cast("double"), F.lit(1.0)))
    items = pairs.select(F.col("item").alias("id")).distinct().withColumn("factors", F.array((F.col("id") % 2).cast("double"), F.lit(2.0)))
    return factorization.FactorModel(users, items).predict(pairs)


def _als_sql(iterations: int, reg: float) -> str:
    """Alternating least squares of rank 2 by Cramer's rule, from given factors of the users."""
    parts = [
        "t AS MATERIALIZED (SELECT o_custkey % 50 AS u, o_orderkey % 20 AS i, (floor(o_totalprice)::BIGINT % 5)::DOUBLE AS r FROM orders)",
        "u0 AS MATERIALIZED (SELECT DISTINCT u AS id, (u % 3 + 1)::DOUBLE AS p, (u % 2 + 0.5)::DOUBLE AS q FROM t)",
    ]
    for k in range(iterations):
        for new, by, old, other in ((f"i{k}", "i", f"u{k}", "u"), (f"u{k + 1}", "u", f"i{k}", "i")):
            sums = f"SELECT t.{by} AS id, sum(p * p) + {reg} AS a, sum(p * q) AS b, sum(q * q) + {reg} AS c, sum(r * p) AS d, sum(r * q) AS e FROM t JOIN {old} o ON o.id = t.{other} GROUP BY t.{by}"
            parts.append(f"{new} AS MATERIALIZED (SELECT id, (d * c - b * e) / (a * c - b * b) AS p, (a * e - b * d) / (a * c - b * b) AS q FROM ({sums}))")
    return "WITH " + ", ".join(parts) + f" SELECT id, {r('p', 4)} AS p, {r('q', 4)} AS q FROM u{iterations}"


@query(_als_sql(2, 0.1))
def als_train(spark, sf):
    data = _ratings(spark, sf)
    u = F.col("id")
    start = data.select(F.col("user").alias("id")).distinct().withColumn("factors", F.array((u % 3 + 1).cast("double"), (u % 2 + 0.5).cast("double")))
    found = factorization.als(data, 2, iterations=2, reg=0.1, start=start)
    return found.users.select("id", *[places(F.get("factors", F.lit(j)), 4).alias(name) for j, name in enumerate("pq")])


@query("SELECT * FROM (VALUES ('simple', 0.3::DOUBLE, -0.5::DOUBLE, 0.1::DOUBLE, 0.0::DOUBLE), ('l1', 0.2, -0.4, 0.0, 0.3), ('squared_l2', 0.25, -0.41667, 0.08333, 0.12153)) t(kind, w0, w1, w2, penalty)")
def updater_steps(spark, sf):
    """One step of 0.2 with a penalty of 0.5, from weights and gradient of few digits."""
    out = []
    for kind in ("simple", "l1", "squared_l2"):
        weights, penalty = linear.update(kind, np.array([0.5, -0.4, 0.2]), np.array([1.0, 0.5, 0.5]), 0.2, 0.5)
        out.append((kind, *[round(float(x), 5) for x in (*weights, penalty)]))
    return spark.createDataFrame(out, "kind string, w0 double, w1 double, w2 double, penalty double")


# Sources and sinks: written to the shared folder and read back


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, " + r("sum(o_totalprice)", 2) + " AS total, count(DISTINCT o_orderpriority) AS priorities FROM orders WHERE o_orderkey % 10 <> 0")
def source_table(spark, sf):
    """Tab-separated rows by a header; rows of another width are dropped."""
    path, orders = shared_path(spark, "table"), table(spark, sf, "orders")
    line = F.when(F.col("o_orderkey") % 10 == 0, F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.lit("short"))).otherwise(F.concat_ws("\t", F.col("o_totalprice").cast("string"), F.col("o_orderkey").cast("string"), "o_orderpriority"))
    orders.select(line.alias("value")).write.text(path)
    back = tables.read_table(spark, path, "total", [FeatureSpec("key"), FeatureSpec("priority$", CATEGORICAL)])
    return back.agg(F.count("*").alias("n"), F.sum(F.col("key").cast("long")).alias("keys"), places(F.sum(F.col("total").cast("double")), 2).alias("total"), F.countDistinct("priority$").alias("priorities"))


@query(f"SELECT CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 ELSE 2.0 END::DOUBLE AS flag, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity, sum(l_linenumber)::DOUBLE AS numbers, sum({_Y_SQL})::DOUBLE AS labels FROM lineitem GROUP BY 1")
def source_encoded(spark, sf):
    path = shared_path(spark, "encoded")
    tables.write_encoded(_encoded(spark, sf), path, "label", _FEATURES)
    back = tables.read_encoded(spark, path, "label", _FEATURES)
    return back.groupBy(F.col("`returnflag$`").cast("double").alias("flag")).agg(F.count("*").alias("n"), F.sum("quantity").cast("double").alias("quantity"), F.sum("linenumber").cast("double").alias("numbers"), F.sum("label").cast("double").alias("labels"))


@query(_DICT_SQL + "SELECT 'p_brand' AS feature, value, id FROM d WHERE feature = 'p_brand' UNION ALL SELECT 'p_type', value, id FROM d WHERE feature = 'p_type'")
def source_dictionaries(spark, sf):
    folder = shared_path(spark, "dictionaries")
    tables.write_dictionaries(encode.build_dictionaries(table(spark, sf, "part"), ["p_brand", "p_type"]), folder)
    back = tables.read_dictionaries(spark, folder, _PART)
    return spark.createDataFrame([(f, v, i) for f, ids in back.items() for v, i in ids.items()], "feature string, value string, id int")


@query("SELECT 'quantity' AS feature, i + 0.5::DOUBLE AS t FROM range(1, 50) r(i) UNION ALL SELECT 'linenumber', i + 0.5 FROM range(1, 7) r(i)")
def source_quantiles(spark, sf):
    folder = shared_path(spark, "quantiles")
    tables.write_quantiles(spark, _THRESHOLDS, folder)
    back = tables.read_quantiles(spark, folder, _FEATURES)
    return spark.createDataFrame([(f, t) for f, own in back.items() for t in own], "feature string, t double")


_SCORED_SQL = " UNION ALL ".join(f"SELECT '{form}' AS form, score, count(*) AS n FROM (SELECT (({_A_SQL}) + ({_B_SQL}))::DOUBLE AS score FROM lineitem) GROUP BY score" for form in ("json", "extended", "text", "parquet"))


@query(_SCORED_SQL)
def source_models(spark, sf):
    """A forest in each of its written forms, read back, scores alike."""
    folder = shared_path(spark, "model")
    models.write_model(spark, _FOREST, folder)
    forms = {
        "json": models.read_forest(spark, f"{folder}/forest.json"), "extended": models.read_forest(spark, f"{folder}/forest_ext.json"),
        "text": Forest(tuple(models.tree_from_lines(tables.read_small(spark, f"{folder}/forest_nodes/nodes_{m}.txt")) for m in range(2))),
        "parquet": Forest.from_table(spark.read.parquet(f"{folder}/nodes.parquet")),
    }
    rows = lineitem_features(spark, sf)
    scores = F.array(*[F.struct(F.lit(k).alias("form"), f.predict(raw=True).alias("score")) for k, f in forms.items()])
    return rows.select(F.inline(scores)).groupBy("form", "score").agg(F.count("*").alias("n"))


@query("SELECT 'points' AS kind, sum(CASE WHEN l_quantity >= 25 AND l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE AS a, " + r("sum(l_quantity / 50)", 3) + " AS b FROM lineitem UNION ALL SELECT 'vectors', count(*), " + r("sum(embedding[1]::DOUBLE)", 3) + " FROM embeddings UNION ALL SELECT 'ratings', sum(o_custkey % 50), sum(floor(o_totalprice)::BIGINT % 5) FROM orders UNION ALL SELECT 'factors', sum(DISTINCT o_custkey % 50), sum(DISTINCT o_custkey % 50) * 0.5 FROM orders")
def source_vectors(spark, sf):
    """Labeled points, vectors, ratings and factors as text."""
    path, out = shared_path(spark, "vectors"), []
    tables.write_labeled_points(_points(spark, sf), f"{path}/points")
    out.append(tables.read_labeled_points(spark, f"{path}/points").agg(F.lit("points").alias("kind"), F.sum("label").alias("a"), places(F.sum(F.get("features", F.lit(1))), 3).alias("b")))
    table(spark, sf, "embeddings").select(F.concat_ws(" ", F.transform("embedding", lambda x: x.cast("double").cast("string"))).alias("value")).write.text(f"{path}/vectors")
    out.append(tables.read_vectors(spark, f"{path}/vectors").agg(F.lit("vectors").alias("kind"), F.count("*").cast("double").alias("a"), places(F.sum(F.get("features", F.lit(0))), 3).alias("b")))
    _ratings(spark, sf).write.csv(f"{path}/ratings")
    out.append(tables.read_ratings(spark, f"{path}/ratings").agg(F.lit("ratings").alias("kind"), F.sum("user").cast("double").alias("a"), F.sum("rating").alias("b")))
    users = _ratings(spark, sf).select(F.col("user").alias("id")).distinct().withColumn("factors", F.array(F.col("id") * 0.5, F.lit(1.0)))
    tables.write_factors(users, f"{path}/factors")
    parts = F.split("value", "[, ]")
    back = spark.read.text(f"{path}/factors").select(F.get(parts, F.lit(0)).cast("double").alias("id"), F.get(parts, F.lit(1)).cast("double").alias("f0"))
    out.append(back.agg(F.lit("factors").alias("kind"), F.sum("id").alias("a"), F.sum("f0").alias("b")))
    return reduce(DataFrame.unionByName, out)


@query(f"SELECT printf('%.5f', ({_A_SQL}) + ({_B_SQL})) AS score, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY 1")
def source_scores(spark, sf):
    """Scored rows as text, rewritten as two files, or more where these would be large."""
    path = shared_path(spark, "scores")
    scored = _FOREST.scored(lineitem_features(spark, sf))
    tables.write_scores(scored, f"{path}/parts", ["quantity", "linenumber"])
    tables.compact(spark, f"{path}/parts", f"{path}/compact", 2)
    fields = F.split("value", "\t")
    back = spark.read.text(f"{path}/compact").select(F.get(fields, F.lit(0)).cast("double").alias("quantity"), F.get(fields, F.lit(2)).alias("score"))
    return back.groupBy("score").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))
