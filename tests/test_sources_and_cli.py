import json

import pytest
from pyspark.sql import functions as F

from timberline import cli
from timberline.plans.model import Forest
from timberline.sources import models, tables
from timberline.streaming.scoring import read_scored


@pytest.mark.parametrize("x,digits,shown", [(11771.16, 5, "11771"), (123456.0, 5, "1.2346e+05"), (0.5, 5, "0.50000"), (299.0, 5, "299.00"), (0.00001234, 3, "1.23e-05"), (0.0, 5, "0.0000"), (39.0, 2, "39"), (12000.0, 2, "1.2e+04"), (-2.5, 3, "-2.50"), (float("nan"), 5, "NaN")])
def test_general_format(x, digits, shown):
    assert models.general(x, digits) == shown


@pytest.fixture(scope="module")
def cars(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cars")
    lines = [f"{10 + (i % 7) * 2 + (i % 3)}\t{i % 7}\t{'' if i % 11 == 0 else i % 5}\t{'abc'[i % 3]}\tjunk" for i in range(80)]
    (folder / "header.txt").write_text("mpg\nweight\nyear\nmake$\nnote#\n")
    (folder / "data.txt").write_text("\n".join([*lines, "too\tshort", "1\t2\t3\ta\tb\tc"]) + "\n")
    (folder / "steps.txt").write_text("0.5\n15\n2.0\n")
    (folder / "inside.txt").write_text("weight\nmake$\n")
    return folder


def run(spark, cars, *args):
    assert cli.main([a.format(d=cars) for a in args], spark) == 0


def test_programs(spark, cars):
    data = ("--header-file", "{d}/header.txt", "--data-file", "{d}/data.txt")
    run(spark, cars, "encode", *data, "--encoded-data-file", "{d}/encoded", "--dicts-dir", "{d}/dicts")
    label, features = tables.read_header(spark, f"{cars}/header.txt")
    assert tables.read_dictionaries(spark, f"{cars}/dicts", features)["make$"] == {"a": 0, "b": 1, "c": 2}
    assert tables.read_encoded(spark, f"{cars}/encoded", label, features).count() == 80
    run(spark, cars, "train-tree", *data, "--model-dir", "{d}/tree", "--max-depth", "3")
    run(spark, cars, "train-forest", *data, "--model-dir", "{d}/forest", "--num-trees", "2")
    run(spark, cars, "train-forest", "^".join([*data, "--model-dir", "{d}/more", "--num-trees", "1", "--init-model-file", "{d}/forest/forest.json"]))
    assert len(models.read_forest(spark, f"{cars}/more/forest.json").trees) == 3
    run(spark, cars, "score-forest", *data, "--model-file", "{d}/forest/forest.json", "--scores-file", "{d}/scores")
    assert all(len(r[0].split("\t")) == 6 for r in spark.read.text(f"{cars}/scores").collect())
    run(spark, cars, "forest-errors", *data, "--model-file", "{d}/forest/forest.json", "--error-dir", "{d}/errors")
    assert any(x.startswith("rmse = ") for x in tables.read_small(spark, f"{cars}/errors/error.txt"))
    run(spark, cars, "tree-dot", "--model-file", "{d}/tree/tree.json", "--dot-dir", "{d}/dot")
    run(spark, cars, "tree-details", "--model-file", "{d}/tree/tree_ext.json", "--details-dir", "{d}/details")
    run(spark, cars, "weigh", *data, "--weight-steps-file", "{d}/steps.txt", "--weighted-data-header-file", "{d}/wheader", "--weighted-data-file", "{d}/weighted")
    run(spark, cars, "train-tree", "--header-file", "{d}/wheader", "--data-file", "{d}/weighted", "--model-dir", "{d}/wtree", "--use-sample-weights", "1")
    run(spark, cars, "feature-weights", "--header-file", "{d}/header.txt", "--feature-weights-file", "{d}/fw", "--included-features-file", "{d}/inside.txt")
    assert tables.read_feature_weights(spark, f"{cars}/fw") == [1.0, 0.0, 1.0, 0.0]
    run(spark, cars, "binarize", "--data-file", "{d}/weighted", "--binary-data-file", "{d}/binary", "--threshold", "15")
    assert {r[0].split("\t")[0] for r in spark.read.text(f"{cars}/binary").collect()} == {"0", "1"}
    run(spark, cars, "split", "--data-file", "{d}/data.txt", "--train-data-file", "{d}/train", "--test-data-file", "{d}/test")
    assert spark.read.text(f"{cars}/train").count() + spark.read.text(f"{cars}/test").count() == 82
    pairs = spark.createDataFrame([("0.9\t1",), ("0.2\t0",), ("0.7\t0",), ("\t1",)], "value string")
    pairs.write.text(f"{cars}/pairs")
    run(spark, cars, "classification-errors", "--scores-file", "{d}/pairs", "--error-dir", "{d}/cerrors", "--compute-full-auc", "1")
    assert "auc = 1.00000" in tables.read_small(spark, f"{cars}/cerrors/error.txt")
    assert cli.main(["train-tree", "--nonsense", "1"], spark) == 2 and cli.main([], spark) == 2 and cli.main(["no-such"], spark) == 2


def test_model_forms_agree(spark, cars):
    tree = models.read_forest(spark, f"{cars}/tree/tree_ext.json").trees[0]
    again = models.tree_from_json(json.loads(json.dumps(models.tree_json(tree, True))))
    assert again == tree
    text = models.tree_from_lines(models.tree_lines(tree))
    assert {i: (n.feature, n.left_ids, n.count) for i, n in text.nodes.items()} == {i: (n.feature, n.left_ids, n.count) for i, n in tree.nodes.items()}
    stored = Forest.from_table(spark.read.parquet(f"{cars}/tree/nodes.parquet"))
    assert [n.node_id for n in stored.trees[0].preorder()] == [n.node_id for n in tree.preorder()]


def test_early_model_form():
    text = '{"nodes": [{"id": "1", "featureId": "0", "featureType": "0", "threshold": 2.5, "left": {"id": "2", "response": 1.5}, "right": {"id": "3", "response": 4.0}}]}'
    tree = models.early_tree_from_text(text)
    assert tree.nodes[1].threshold == 2.5 and tree.nodes[2].response == 1.5 and tree.nodes[3].is_leaf


def test_small_formats(spark, tmp_path):
    (tmp_path / "points").write_text("1,2.0 3.5\n0,-1 4\n\n")
    points = tables.read_labeled_points(spark, str(tmp_path / "points"))
    assert [tuple(r) for r in points.collect()] == [(1.0, [2.0, 3.5]), (0.0, [-1.0, 4.0])]
    tables.write_labeled_points(points, str(tmp_path / "again"))
    assert tables.read_labeled_points(spark, str(tmp_path / "again")).count() == 2
    (tmp_path / "ratings").write_text("1,2,3.5\n")
    assert tuple(tables.read_ratings(spark, str(tmp_path / "ratings")).first()) == (1, 2, 3.5)
    (tmp_path / "vectors").write_text("1 2 3\n")
    assert tables.read_vectors(spark, str(tmp_path / "vectors")).first()["features"] == [1.0, 2.0, 3.0]
    tables.write_factors(spark.createDataFrame([(1, [0.5, 2.0])], "id int, factors array<double>"), str(tmp_path / "factors"))
    assert tables.read_small(spark, str(tmp_path / "factors")) == ["1,0.5 2.0"]
    tables.compact(spark, str(tmp_path / "again"), str(tmp_path / "one"))
    raw = spark.createDataFrame([('18.0   8   307.0      ?   3504.      12.0   70  1\t"chevrolet chevelle malibu"',)], "value string")
    assert tables.uci_to_table(raw).first()[0].split("\t")[3::5] == ["0", "chevrolet"]


def test_compaction_bounds_what_a_task_takes(spark, tmp_path):
    lines = spark.range(0, 4_000, 1, 16).select(F.format_string("%019d", "id").alias("value"))
    lines.write.text(str(tmp_path / "parts"))
    for target, files, most, least, greatest in (("two", 2, 64 << 20, 2, 2), ("exact", 2, None, 2, 2), ("more", 2, 20_000, 3, 16)):
        tables.compact(spark, str(tmp_path / "parts"), str(tmp_path / target), files, most=most)
        assert least <= len(list((tmp_path / target).glob("part-*"))) <= greatest
        assert sorted(tables.read_small(spark, str(tmp_path / target))) == [f"{i:019d}" for i in range(4_000)]
    lines.filter("false").write.text(str(tmp_path / "none"))
    tables.compact(spark, str(tmp_path / "none"), str(tmp_path / "nothing"), 2)
    assert tables.read_small(spark, str(tmp_path / "nothing")) == []


def test_streams_are_scored_like_batches(spark, cars, tmp_path):
    label, features = tables.read_header(spark, f"{cars}/header.txt")
    rows = tables.read_table(spark, f"{cars}/data.txt", label, features)
    rows.write.parquet(str(tmp_path / "in"))
    forest = models.read_forest(spark, f"{cars}/forest/forest.json")
    stream = read_scored(spark, str(tmp_path / "in"), rows.schema, forest)
    query = stream.writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(r["score"] for r in spark.table("scored").collect())
    assert got == pytest.approx(sorted(r["score"] for r in forest.scored(rows).collect()))
    assert forest.scored(rows, threshold=15.0).agg(F.max("score")).first()[0] in (0, 1)
