"""Tree and forest models: node tables, scoring expressions, importances, printouts."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.encode import continuous
from timberline.spec import CATEGORICAL, CONTINUOUS, FeatureSpec

NODE_SCHEMA = (
    "tree_id int, node_id int, depth int, count long, weight double, response double, error double, split_error double, gain double, "
    "feature_id int, feature_type int, feature string, threshold double, left_ids array<int>, right_ids array<int>, left_values array<string>, right_values array<string>"
)


@dataclass(frozen=True)
class Node:
    """A node; the children of i are 2i and 2i + 1, so no links are needed. A leaf has no feature."""

    node_id: int
    depth: int = 0
    count: int = 0
    weight: float = 0.0
    response: float = 0.0
    error: float = 0.0
    split_error: float = 0.0
    gain: float = 0.0
    feature_id: int | None = None
    feature_type: int | None = None
    feature: str | None = None
    threshold: float | None = None
    cut_bin: int | None = None
    left_ids: tuple[int, ...] = ()
    right_ids: tuple[int, ...] = ()
    left_values: tuple[str, ...] = ()
    right_values: tuple[str, ...] = ()

    @property
    def is_leaf(self) -> bool:
        return self.feature_id is None


@dataclass(frozen=True)
class Tree:
    nodes: dict[int, Node]

    def preorder(self, start: int = 1):
        """Nodes from the root, left before right."""
        stack = [start]
        while stack:
            node = self.nodes[stack.pop()]
            yield node
            if not node.is_leaf:
                stack += [2 * node.node_id + 1, 2 * node.node_id]

    def ancestors(self, node_id: int) -> list[Node]:
        """From the parent up to the root."""
        return [self.nodes[node_id >> k] for k in range(1, node_id.bit_length())]

    def _expression(self, test, leaf, node_id: int = 1) -> Column:
        node = self.nodes[node_id]
        if node.is_leaf:
            return leaf(node)
        return F.when(test(node), self._expression(test, leaf, 2 * node_id)).otherwise(self._expression(test, leaf, 2 * node_id + 1))

    def leaf_of(self, test) -> Column:
        """The id of the leaf that a row falls into. ``test`` says when a row goes left."""
        return self._expression(test, lambda n: F.lit(n.node_id))

    def predict(self, test) -> Column:
        return self._expression(test, lambda n: F.lit(float(n.response)))

    def scaled(self, factor: float) -> Tree:
        return Tree({i: replace(n, response=n.response * factor) for i, n in self.nodes.items()})

    def named(self, dictionaries: dict[str, dict[str, int]]) -> Tree:
        """With category names beside category ids."""
        out = {}
        for i, n in self.nodes.items():
            if n.feature_type == CATEGORICAL:
                names = {v: k for k, v in dictionaries.get(n.feature, {}).items()}
                n = replace(n, left_values=tuple(sorted(names[x] for x in n.left_ids if x in names)), right_values=tuple(sorted(names[x] for x in n.right_ids if x in names)))
            out[i] = n
        return Tree(out)


def encoded_test(node: Node) -> Column:
    """Encoded data: below the threshold, or a left category."""
    col = F.col(f"`{node.feature}`")
    # NaN is above every threshold, as is a null.
    return F.coalesce(col < node.threshold if node.feature_type == CONTINUOUS else col.cast("int").isin(list(node.left_ids)), F.lit(False))


def raw_test(node: Node) -> Column:
    """Raw data: an empty number is -1, and a category that is not on the left goes right."""
    col = F.col(f"`{node.feature}`")
    if node.feature_type == CONTINUOUS:
        return F.coalesce(continuous(col) < node.threshold, F.lit(False))
    return F.coalesce(col.cast("string"), F.lit("")).isin(list(node.left_values))


def binned_test(node: Node) -> Column:
    """Binned training data."""
    col = F.col(f"b{node.feature_id}")
    return col <= node.cut_bin if node.feature_type == CONTINUOUS else col.isin(list(node.left_ids))


@dataclass(frozen=True)
class Forest:
    """One or more trees whose responses add up."""

    trees: tuple[Tree, ...]
    features: tuple[FeatureSpec, ...] = field(default=())

    def predict(self, raw: bool = False) -> Column:
        """The score of a row as one expression; each tree is code of its own."""
        test = raw_test if raw else encoded_test
        out = F.lit(0.0)
        for tree in self.trees:
            out = out + tree.predict(test)
        return out

    def binary(self, threshold: float = 0.5, raw: bool = False, strict: bool = False) -> Column:
        """1 from the threshold on (``strict``: above it)."""
        score = self.predict(raw)
        return F.when((score > threshold) if strict else (score >= threshold), 1).otherwise(0)

    def scored(self, df: DataFrame, raw: bool = True, threshold: float | None = None) -> DataFrame:
        """``df`` with a column ``score``: the number, or 0/1 with a threshold. Works on streams as well."""
        return df.withColumn("score", self.predict(raw) if threshold is None else self.binary(threshold, raw))

    def rows(self) -> list[tuple]:
        out = []
        for t, tree in enumerate(self.trees):
            for n in tree.preorder():
                out.append((t, n.node_id, n.depth, n.count, float(n.weight), float(n.response), float(n.error), float(n.split_error), float(n.gain), n.feature_id, n.feature_type, n.feature, n.threshold, list(n.left_ids), list(n.right_ids), list(n.left_values), list(n.right_values)))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), NODE_SCHEMA)

    @classmethod
    def from_table(cls, nodes: DataFrame, features: tuple[FeatureSpec, ...] = ()) -> Forest:
        trees: dict[int, dict[int, Node]] = {}
        for r in nodes.orderBy("tree_id", "node_id").collect():
            d = r.asDict()
            t = d.pop("tree_id")
            for k in ("left_ids", "right_ids", "left_values", "right_values"):
                d[k] = tuple(d[k] or ())
            trees.setdefault(t, {})[d["node_id"]] = Node(**d)
        return cls(tuple(Tree(trees[t]) for t in sorted(trees)), features)


def feature_gains(nodes: DataFrame, features: list[str] | None = None) -> DataFrame:
    """``(feature, gain)`` over the split nodes of all trees; of ``features``, unused ones have gain 0."""
    used = nodes.filter("feature_id is not null").select("feature", "gain")
    if features:
        used = used.unionByName(nodes.sparkSession.createDataFrame([(f, 0.0) for f in features], "feature string, gain double"))
    return used.groupBy("feature").agg(F.sum("gain").alias("gain"))


def importances(gains: DataFrame, key: str) -> DataFrame:
    """Gains as shares of the greatest, times 100; 0 where there is no gain."""
    top = gains.agg(F.max("gain").alias("top"))
    share = F.when(F.col("top") > 0, F.col("gain") * 100.0 / F.col("top")).otherwise(0.0)
    # One row against a model's few features.
    return gains.join(F.broadcast(top)).select(key, share.alias("importance")).orderBy(F.col("importance").desc(), key)


def feature_importances(nodes: DataFrame, features: list[str] | None = None) -> DataFrame:
    return importances(feature_gains(nodes, features), "feature")


def subset_gains(nodes: DataFrame) -> DataFrame:
    """``(subset, size, gain)``: for each set of features met on a path upwards, the gain of the nodes on such paths.

    A path begins at a node's parent and may stop at any ancestor. A node that
    lies on several paths with the same set counts once.
    """
    splits = nodes.filter("feature_id is not null").select("tree_id", F.col("node_id").alias("anc"), "feature", "gain")
    up = nodes.select("tree_id", "node_id", F.explode(F.sequence(F.lit(1), F.greatest(F.floor(F.log2("node_id")).cast("int"), F.lit(1)))).alias("k")).filter("node_id > 1")
    up = up.withColumn("anc", F.expr("shiftright(node_id, k)")).join(splits, ["tree_id", "anc"])
    # A path of length k holds the ancestors 1 to k.
    paths = up.select("tree_id", "node_id", F.col("k").alias("length"))
    on = paths.join(up, ["tree_id", "node_id"]).filter("k <= length")
    sets = on.groupBy("tree_id", "node_id", "length").agg(F.array_sort(F.collect_set("feature")).alias("subset"), F.collect_set(F.struct("anc", "gain")).alias("on"))
    met = sets.select("tree_id", "subset", F.inline("on")).distinct()
    return met.groupBy("subset").agg(F.sum("gain").alias("gain")).select(F.concat_ws(",", "subset").alias("subset"), F.size("subset").alias("size"), "gain")


def subset_importances(nodes: DataFrame, max_size: int | None = None) -> DataFrame:
    gains = subset_gains(nodes)
    return importances(gains if max_size is None else gains.filter(F.col("size") <= max_size), "subset")
