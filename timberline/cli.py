"""Command-line programs: ``python -m timberline.cli PROGRAM --name value ...``.

Arguments may also come as one string joined by ``^``. Each program is the same
on one machine (``--master local[*]``) and on a cluster.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators import encode, metrics, prep
from timberline.plans.boost import train_forest
from timberline.plans.tree import global_quantiles, train_tree
from timberline.sources import models, tables
from timberline.spec import CATEGORICAL, ForestParams, TreeParams

PROGRAMS: dict[str, tuple[Callable, dict[str, str | None]]] = {}


class UsageError(ValueError):
    pass


def program(name: str, **flags):
    """Register a program. A flag's default is a string; None makes the flag necessary."""

    def add(run):
        PROGRAMS[name] = (run, {"master": "", **flags})
        return run

    return add


def parse(name: str, args: list[str]) -> dict[str, str]:
    if name not in PROGRAMS:
        raise UsageError(f"unknown program: {name}; one of {', '.join(sorted(PROGRAMS))}")
    if len(args) == 1 and "^" in args[0]:
        args = args[0].split("^")
    flags = PROGRAMS[name][1]
    out = {k: v for k, v in flags.items() if v is not None}
    it = iter(args)
    for flag in it:
        key = flag.removeprefix("--").replace("-", "_")
        value = next(it, None)
        if not flag.startswith("--") or key not in flags or value is None:
            raise UsageError(f"unknown or incomplete argument: {flag}")
        out[key] = value
    if missing := [k for k in flags if k not in out]:
        raise UsageError("missing: " + ", ".join("--" + k.replace("_", "-") for k in missing))
    return out


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    try:
        if not argv:
            raise UsageError(f"programs: {', '.join(sorted(PROGRAMS))}")
        args = parse(argv[0], argv[1:])
    except UsageError as problem:
        print(problem)
        return 2
    if spark is None:
        builder = SparkSession.builder.appName(f"timberline {argv[0]}")
        spark = (builder.master(args["master"]) if args["master"] else builder).getOrCreate()
    PROGRAMS[argv[0]][0](spark, args)
    return 0


def _raw(spark, a) -> tuple[str, list, DataFrame]:
    label, features = tables.read_header(spark, a["header_file"])
    return label, features, tables.read_table(spark, a["data_file"], label, features)


@program("sample", data_file=None, sample_file=None, sampling_rate="0.1", seed="42")
def _sample(spark, a):
    prep.sample(spark.read.text(a["data_file"]), float(a["sampling_rate"]), int(a["seed"])).write.text(a["sample_file"])


@program("binarize", data_file=None, binary_data_file=None, threshold="0.5")
def _binarize(spark, a):
    label = F.substring_index("value", "\t", 1)
    bit = F.when(label.cast("double") >= float(a["threshold"]), "1").otherwise("0")
    rest = F.when(F.instr("value", "\t") > 0, F.concat(bit, F.expr("substring(value, instr(value, '\\t'))"))).otherwise(bit)
    spark.read.text(a["data_file"]).select(rest.alias("value")).write.text(a["binary_data_file"])


@program("split", data_file=None, train_data_file=None, test_data_file=None, train_fraction="0.8", seed="42")
def _split(spark, a):
    train, test = prep.train_test_split(spark.read.text(a["data_file"]), float(a["train_fraction"]), int(a["seed"]))
    train.write.text(a["train_data_file"])
    test.write.text(a["test_data_file"])


@program("weigh", header_file=None, data_file=None, weight_steps_file=None, weighted_data_header_file=None, weighted_data_file=None, legacy="0")
def _weigh(spark, a):
    label, features, df = _raw(spark, a)
    thresholds, weights = prep.parse_weight_steps(tables.read_small(spark, a["weight_steps_file"]))
    tables.write_fields(prep.attach_weights(df, label, thresholds, weights, legacy=a["legacy"] == "1"), a["weighted_data_file"])
    models.write_lines(spark, [label, *[f.name for f in features], "sample_weight"], a["weighted_data_header_file"])


@program("feature-weights", header_file=None, feature_weights_file=None, included_features_file="", excluded_features_file="")
def _feature_weights(spark, a):
    label, features = tables.read_header(spark, a["header_file"])
    names = lambda path: [x.strip() for x in tables.read_small(spark, path) if x.strip()] if path else None
    found = prep.feature_weights([label, *[f.name for f in features]], names(a["included_features_file"]), names(a["excluded_features_file"]))
    models.write_lines(spark, [str(w) for _, w in found], a["feature_weights_file"])


@program("encode", header_file=None, data_file=None, encoded_data_file=None, dicts_dir=None, generate_dicts="1", max_num_quantiles="1000", max_num_quantile_samples="100000", rng_seed="42")
def _encode(spark, a):
    label, features, df = _raw(spark, a)
    if a["generate_dicts"] == "1":
        built = encode.build_dictionaries(df, [f.name for f in features if f.kind == CATEGORICAL])
        tables.write_dictionaries(built, a["dicts_dir"])
        dictionaries = encode.collect_dictionaries(built)
    else:
        dictionaries = tables.read_dictionaries(spark, a["dicts_dir"], features)
    out = encode.encode(df, features, dictionaries)
    if a["generate_dicts"] == "1":
        params = TreeParams(max_quantiles=int(a["max_num_quantiles"]), max_quantile_samples=int(a["max_num_quantile_samples"]), seed=int(a["rng_seed"]))
        tables.write_quantiles(spark, global_quantiles(out, features, params), a["dicts_dir"])
    tables.write_encoded(out, a["encoded_data_file"], label, features)


_TREE_FLAGS = {
    "header_file": None, "data_file": None, "model_dir": None, "loss_function": "square", "max_depth": "5", "min_gain_fraction": "0.01", "min_local_gain_fraction": "1", "min_count": "2", "min_weight": "2",
    "feature_weights_file": "", "use_sample_weights": "0", "use_cache": "1", "histograms_method": "array-aggregate", "use_global_quantiles": "1", "fast_tree": "1", "batch_size": "128", "use_encoded_data": "0", "dicts_dir": "", "save_encoded_data": "0", "encoded_data_file": "", "max_num_quantiles": "1000", "max_num_quantile_samples": "100000", "rng_seed": "42",
    "min_distributed_samples": "", "num_reducers_per_node": "", "max_num_reducers": "", "wait_time_ms": "",
}


def _training(spark, a):
    """Everything both trainers need. ``use_sample_weights`` takes the last column as the weight."""
    label, features = tables.read_header(spark, a["header_file"])
    encoded = a["use_encoded_data"] == "1"
    if encoded:
        df = tables.read_encoded(spark, a["data_file"], label, features)
        dictionaries = tables.read_dictionaries(spark, a["dicts_dir"], features) if a["dicts_dir"] else {}
        quantiles = tables.read_quantiles(spark, a["dicts_dir"], features) if a["dicts_dir"] else None
    else:
        raw = tables.read_table(spark, a["data_file"], label, features)
        dictionaries = encode.collect_dictionaries(encode.build_dictionaries(raw, [f.name for f in features if f.kind == CATEGORICAL]))
        df, quantiles = encode.encode(raw, features, dictionaries).withColumn(label, F.col(f"`{label}`").cast("double")), None
        if a["save_encoded_data"] == "1":
            tables.write_encoded(df, a["encoded_data_file"], label, features)
    own = tables.read_feature_weights(spark, a["feature_weights_file"]) if a["feature_weights_file"] else None
    weight = None
    if a["use_sample_weights"] == "1":
        weight = features[-1].name
        features = features[:-1]
        own = own[:-1] if own and len(own) > len(features) else own
    params = TreeParams(
        loss=a["loss_function"], max_depth=int(a["max_depth"]), min_gain_fraction=float(a["min_gain_fraction"]), min_local_gain_fraction=float(a["min_local_gain_fraction"]), min_count=int(a["min_count"]), min_weight=float(a["min_weight"]),
        max_quantiles=int(a["max_num_quantiles"]), max_quantile_samples=int(a["max_num_quantile_samples"]), batch_size=int(a["batch_size"]) if a["fast_tree"] == "1" else 1, use_global_quantiles=a["use_global_quantiles"] == "1", histograms_method=a["histograms_method"], seed=int(a["rng_seed"]),
    )
    return df, features, params, {"label": label, "weight": weight, "feature_weights": own, "quantiles": quantiles, "dictionaries": dictionaries}


@program("train-tree", **_TREE_FLAGS)
def _train_tree(spark, a):
    df, features, params, more = _training(spark, a)
    models.write_model(spark, train_tree(df, features, params, **more), a["model_dir"])


@program("train-forest", **{**_TREE_FLAGS, "max_depth": "4", "num_trees": "5", "shrinkage": "0.8", "persist_interval": "5", "init_model_file": "", "residual_data_file": ""})
def _train_forest(spark, a):
    df, features, params, more = _training(spark, a)
    start = models.read_forest(spark, a["init_model_file"]) if a["init_model_file"] else None
    forest = train_forest(df, features, ForestParams(params, int(a["num_trees"]), float(a["shrinkage"]), int(a["persist_interval"])), init_model=start, **more)
    models.write_model(spark, forest, a["model_dir"])
    if a["residual_data_file"]:
        left = df.withColumn(more["label"], F.col(f"`{more['label']}`") - forest.predict())
        left.write.parquet(a["residual_data_file"])


_SCORE_FLAGS = {"header_file": None, "data_file": None, "model_file": None, "scores_file": None, "threshold": "", "use_encoded_data": "0"}


def _scored(spark, a):
    label, features = tables.read_header(spark, a["header_file"])
    encoded = a["use_encoded_data"] == "1"
    df = (tables.read_encoded if encoded else tables.read_table)(spark, a["data_file"], label, features)
    forest = models.read_forest(spark, a["model_file"])
    return label, df, forest, forest.scored(df, raw=not encoded)


def _score(spark, a):
    _, df, forest, scored = _scored(spark, a)
    if a["threshold"]:
        scored = forest.scored(df, a["use_encoded_data"] != "1", float(a["threshold"]))
    tables.write_scores(scored, a["scores_file"], df.columns, bool(a["threshold"]))


program("score-tree", **_SCORE_FLAGS)(_score)
program("score-forest", **_SCORE_FLAGS)(_score)

_ERROR_FLAGS = {"header_file": None, "data_file": None, "model_file": None, "error_dir": None, "binary_mode": "0", "threshold": "0.5", "compute_full_auc": "0", "max_num_roc_samples": "100000", "use_encoded_data": "0", "rng_seed": "42"}


def _report(spark, scored: DataFrame, a, trivial: float | None) -> None:
    """``error.txt``, score/label pairs and, for classes, a curve; pairs are read again as written."""
    folder = a["error_dir"]
    tables.write_fields(scored, f"{folder}/scatter_plot.txt", [F.format_string("%.5f", F.col("score").cast("double")), F.format_string("%.5f", F.col("label").cast("double"))])
    pairs = F.split("value", "\t")
    read = spark.read.text(f"{folder}/scatter_plot.txt").select(F.get(pairs, F.lit(0)).cast("double").alias("score"), F.get(pairs, F.lit(1)).cast("double").alias("label"))
    most, seed = int(a["max_num_roc_samples"]), int(a["rng_seed"])
    few = prep.fixed_sample(read, most, ["score", "label"], seed)
    tables.write_fields(few, f"{folder}/scatter_plot.txt.sample")
    if a["binary_mode"] == "1":
        row = metrics.classification_report(read, threshold=float(a["threshold"])).first().asDict()
        row["sampled_auc"] = metrics.auc(few).first()[0]
        row["auc"] = metrics.auc(read).first()[0] if a["compute_full_auc"] == "1" else -1.0
        tables.write_fields(metrics.roc_points(few), f"{folder}/roc.txt.sample")
        if a["compute_full_auc"] == "1":
            tables.write_fields(metrics.roc(read), f"{folder}/roc.txt")
    else:
        row = metrics.error_stats(read, trivial=trivial).first().asDict()
    models.write_lines(spark, [f"{k} = {v:.5f}" if isinstance(v, float) else f"{k} = {v}" for k, v in row.items()], f"{folder}/error.txt")


def _errors(spark, a):
    label, _, forest, scored = _scored(spark, a)
    trivial = sum(t.nodes[1].response for t in forest.trees)
    _report(spark, scored.select("score", F.col(f"`{label}`").cast("double").alias("label")), a, trivial)


program("tree-errors", **_ERROR_FLAGS)(_errors)
program("forest-errors", **_ERROR_FLAGS)(_errors)


@program("classification-errors", header_file="", scores_file=None, error_dir=None, score_field="score", label_field="label", threshold="0.5", compute_full_auc="0", max_num_roc_samples="100000", rng_seed="42")
def _classification(spark, a):
    names = [x for x in tables.read_small(spark, a["header_file"]) if x] if a["header_file"] else ["score", "label"]
    rows = encode.rows_of_width(spark.read.text(a["scores_file"]), len(names)).select(*[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)])
    _report(spark, metrics.usable_scores(rows, a["score_field"], a["label_field"]), {**a, "binary_mode": "1"}, None)


def _print(spark, a, show):
    for m, tree in enumerate(models.read_forest(spark, a["model_file"]).trees):
        show(m, tree)


for _kind in ("tree", "forest"):
    program(f"{_kind}-details", model_file=None, details_dir=None)(lambda spark, a: _print(spark, a, lambda m, t: models.write_lines(spark, [x for n in t.preorder() for x in (*models.node_details(t, n.node_id), "")], f"{a['details_dir']}/tree_{m}.txt")))
    program(f"{_kind}-dot", model_file=None, dot_dir=None)(lambda spark, a: _print(spark, a, lambda m, t: models.write_lines(spark, models.dot_tree(t), f"{a['dot_dir']}/tree_{m}.dot")))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
