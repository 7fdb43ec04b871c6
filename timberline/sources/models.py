"""Model files: node tables as Parquet, and the text forms."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from timberline.plans.model import Forest, Node, Tree, feature_importances, subset_importances
from timberline.sources.tables import read_small
from timberline.spec import CATEGORICAL, CONTINUOUS


def general(x: float, digits: int) -> str:
    """Java's ``%.<digits>g``: trailing zeros stay, and numbers from 1e-4 up to 10^digits have no exponent."""
    if x != x or x in (float("inf"), float("-inf")):
        return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(x)]
    if x == 0:
        return f"{0:.{digits - 1}f}"
    mantissa, exponent = f"{x:.{digits - 1}e}".split("e")
    e = int(exponent)
    return f"{x:.{max(0, digits - 1 - e)}f}" if -4 <= e < digits else f"{mantissa}e{'-' if e < 0 else '+'}{abs(e):02d}"


def decimal(x: float) -> str:
    """A double as the JVM prints it in ordinary ranges."""
    return repr(float(x))


def explain_node(n: Node, indent: str = "") -> str:
    line = f"{indent}{'  ' * n.depth}i = {n.node_id}, y = {general(n.response, 5)}, n = {n.count}"
    if n.is_leaf:
        return line
    cut = general(n.threshold, 5) if n.feature_type == CONTINUOUS else f"{{{','.join(sorted(n.left_values))}}} : {{{','.join(sorted(n.right_values))}}}"
    return f"{line}, x = {n.feature}, t = {cut}"


def explain_tree(tree: Tree, indent: str = "") -> list[str]:
    """One indented line per node, left before right."""
    return [explain_node(n, indent) for n in tree.preorder()]


def explain_forest(forest: Forest) -> list[str]:
    return [x for m, t in enumerate(forest.trees) for x in (f"m = {m}", *explain_tree(t, "  "))]


def dot_tree(tree: Tree) -> list[str]:
    """Graphviz source."""
    nodes, edges = [], []
    for n in tree.preorder():
        pad = "  " * (n.depth + 1)
        cut = ""
        if not n.is_leaf:
            at = decimal(n.threshold) if n.feature_type == CONTINUOUS else f"{len(n.left_values)}:{len(n.right_values)}"
            cut = f" | x = {n.feature}, t ={at}"
            edges.append(f"{pad}{n.node_id} -> {2 * n.node_id}; {n.node_id} -> {2 * n.node_id + 1};")
        after = "" if n.is_leaf else f", e' = {general(n.split_error, 2)}"
        nodes.append(f'{pad}{n.node_id} [ shape=record, label="{{ i = {n.node_id}{cut} | y = {general(n.response, 2)} | n = {n.count}, w = {general(n.weight, 2)} | e = {general(n.error, 2)}{after} }}" ];')
    return ['// Use "dot -T pdf tree.dot -o tree.pdf" to compile.', "", "digraph regression_tree {", *nodes, "", *edges, "}"]


def node_details(tree: Tree, node_id: int) -> list[str]:
    """A node's numbers and the conditions on its path from the root."""
    n = tree.nodes[node_id]
    cut = lambda m, own: "{" + ",".join(own) + "}" if own else decimal(m.threshold)
    out = [f"i = {n.node_id}", f"d = {n.depth}", f"y = {decimal(n.response)}", f"x = {'<leaf>' if n.is_leaf else n.feature}"]
    if not n.is_leaf:
        out.append(f"t = {decimal(n.threshold)}" if n.feature_type == CONTINUOUS else f"t = {cut(n, sorted(n.left_values))} : {cut(n, sorted(n.right_values))}")
    out.append("path =")
    for k, a in reversed(list(enumerate(tree.ancestors(node_id), 1))):
        right = (node_id >> (k - 1)) & 1
        if a.feature_type == CONTINUOUS:
            out.append(f"  i = {a.node_id}, {a.feature} {'>=' if right else '<'} {decimal(a.threshold)}")
        else:
            out.append(f"  i = {a.node_id}, {a.feature} <- {{{','.join(a.right_values if right else a.left_values)}}}")
    return out


def _rounded(x: float) -> float:
    return float(general(x, 5)) if x == x else x


def node_json(n: Node, extended: bool = False) -> dict:
    """A node's JSON object; numbers have five significant digits."""
    out: dict = {"id": n.node_id}
    if extended:
        out |= {"depth": n.depth, "count": n.count, "weight": _rounded(n.weight)}
    out["response"] = _rounded(n.response)
    if extended:
        out |= {"error": _rounded(n.error), "split_error": _rounded(n.split_error), "gain": _rounded(n.gain)}
    out["isLeaf"] = n.is_leaf
    if not n.is_leaf:
        out |= {"featureId": n.feature_id, "featureType": n.feature_type, "feature": n.feature}
        if n.feature_type == CONTINUOUS:
            out["threshold"] = _rounded(n.threshold)
        else:
            out |= {"leftBranchValueIds": sorted(n.left_ids), "leftBranchValues": sorted(n.left_values)}
            if extended:
                out |= {"rightBranchValueIds": sorted(n.right_ids), "rightBranchValues": sorted(n.right_values)}
    return out


def tree_json(tree: Tree, extended: bool = False) -> dict:
    return {"nodes": [node_json(n, extended) for n in tree.preorder()]}


def forest_json(forest: Forest, extended: bool = False) -> dict:
    return {"numTrees": len(forest.trees), "trees": [tree_json(t, extended) for t in forest.trees]}


def _node_of(d: dict) -> Node:
    split = {} if d.get("isLeaf", "featureId" not in d) else {
        "feature_id": int(d["featureId"]), "feature_type": int(d["featureType"]), "feature": d.get("feature"), "threshold": d.get("threshold"),
        "left_ids": tuple(d.get("leftBranchValueIds", ())), "left_values": tuple(d.get("leftBranchValues", ())), "right_ids": tuple(d.get("rightBranchValueIds", ())), "right_values": tuple(d.get("rightBranchValues", ())),
    }
    i = int(d["id"])
    return Node(i, d.get("depth", i.bit_length() - 1), int(d.get("count", 0)), float(d.get("weight", 0)), float(d.get("response", 0)), float(d.get("error", 0)), float(d.get("split_error", 0)), float(d.get("gain", 0)), **split)


def tree_from_json(data: dict) -> Tree:
    return Tree({n.node_id: n for n in map(_node_of, data["nodes"])})


def forest_from_json(data: dict) -> Forest:
    """A forest file, or a tree file as a forest of one."""
    return Forest(tuple(map(tree_from_json, data["trees"])) if "trees" in data else (tree_from_json(data),))


def early_tree_from_text(text: str) -> Tree:
    """The earliest JSON form: node objects nested by branch, with quoted ids and responses on leaves only."""
    found: dict[int, Node] = {}
    pair = re.compile(r'"(\w+)"\s*:\s*("(?:[^"\\]|\\.)*"|\[[^\]]*\]|[-+\w.]+)')
    for block in re.findall(r"\{([^{}]*)", text):
        d = {k: json.loads(v) if v[0] in '"[' or re.fullmatch(r"-?\d+(\.\d+)?([eE][-+]?\d+)?|true|false|null", v) else v for k, v in pair.findall(block)}
        i = d.get("id", d.get("nodeId"))
        if i is None:
            continue
        flat = {"id": int(i), "response": float(d.get("response", d.get("prediction", 0)) or 0)}
        if (f := d.get("featureId", d.get("feature_id"))) is not None:
            kind = int(d.get("featureType", d.get("feature_type", CONTINUOUS)))
            left = d.get("leftBranchValueIds", d.get("leftBranchFeatureValues", d.get("leftBranchValues", [])))
            flat |= {"isLeaf": False, "featureId": int(f), "featureType": kind, "feature": d.get("feature", f"F_{f}"), "leftBranchValueIds": [int(float(x)) for x in left] if kind == CATEGORICAL else []}
            if "threshold" in d:
                flat["threshold"] = float(d["threshold"])
        else:
            flat["isLeaf"] = True
        found[flat["id"]] = _node_of(flat)
    return Tree(found)


#: Key of a text line, attribute of a node, how to write it (fixed names).
_FIELDS = [("id", "node_id", str), ("depth", "depth", str), ("response", "response", "{:.6f}".format), ("error", "error", "{:.6f}".format), ("split_error", "split_error", "{:.6f}".format), ("gain", "gain", "{:.6f}".format), ("count", "count", str), ("weight", "weight", decimal), ("is_leaf", "is_leaf", lambda x: str(x).lower())]
_LISTS = [("left_branch_value_ids", "left_ids"), ("left_branch_values", "left_values"), ("right_branch_value_ids", "right_ids"), ("right_branch_values", "right_values")]


def tree_lines(tree: Tree) -> list[str]:
    """The key/value text form."""
    out = []
    for n in tree.preorder():
        out += [f"{key}\t{show(getattr(n, name))}" for key, name, show in _FIELDS]
        if not n.is_leaf:
            out += [f"feature_id\t{n.feature_id}", f"feature_type\t{n.feature_type}", f"feature\t{n.feature}"]
            out += [f"threshold\t{n.threshold:.6f}"] if n.feature_type == CONTINUOUS else [f"{key}\t{','.join(map(str, sorted(getattr(n, name))))}" for key, name in _LISTS]
    return out


def tree_from_lines(lines: list[str]) -> Tree:
    """The key/value text form again; also its older variant, which says ``num_samples`` and has no names."""
    records: list[dict[str, str]] = []
    for line in lines:
        key, _, value = line.partition("\t")
        if key == "id":
            records.append({})
        if records:
            records[-1][key] = value
    out = {}
    for r in records:
        d: dict = {"id": r["id"], "depth": int(r.get("depth", 0)), "count": int(float(r.get("count", r.get("num_samples", 0)))), "isLeaf": "feature_id" not in r and r.get("is_leaf", "true") == "true"}
        d |= {k: float(r[k]) for k in ("response", "error", "split_error", "gain", "weight", "threshold") if k in r}
        if not d["isLeaf"]:
            d |= {"featureId": r["feature_id"], "featureType": r["feature_type"], "feature": r.get("feature")}
            for key, old, name in (("left_branch_value_ids", "left_values", "leftBranchValueIds"), ("right_branch_value_ids", "right_values", "rightBranchValueIds")):
                d[name] = [int(x) for x in (r.get(key) or r.get(old) or "").split(",") if x]
            for key, name in (("left_branch_values", "leftBranchValues"), ("right_branch_values", "rightBranchValues")):
                d[name] = [x for x in r.get(key, "").split(",") if x]
        out[int(r["id"])] = _node_of(d)
    return Tree(out)


def write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    """A short list of lines as one text file (a folder with one part)."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_forest(spark: SparkSession, path: str) -> Forest:
    return forest_from_json(json.loads("\n".join(read_small(spark, path))))


def write_model(spark: SparkSession, forest: Forest, folder: str) -> None:
    """All forms of a model below ``folder``; a forest of one is written as a tree."""
    one = len(forest.trees) == 1
    name = "tree" if one else "forest"
    put = lambda lines, file: write_lines(spark, lines, f"{folder}/{file}")
    put(explain_tree(forest.trees[0]) if one else explain_forest(forest), f"{name}.txt")
    for extended, suffix in ((False, ""), (True, "_ext")):
        data = tree_json(forest.trees[0], extended) if one else forest_json(forest, extended)
        put(json.dumps(data, indent=2, ensure_ascii=False).split("\n"), f"{name}{suffix}.json")
    if one:
        put(tree_lines(forest.trees[0]), "nodes.txt")
        put(dot_tree(forest.trees[0]), "tree.dot")
    else:
        for m, t in enumerate(forest.trees):
            put(tree_lines(t), f"forest_nodes/nodes_{m}.txt")
            put(dot_tree(t), f"forest_dot/tree_{m}.dot")
        for sub in ("forest_nodes", "forest_dot"):
            put([str(len(forest.trees))], f"{sub}/num_trees.txt")
    nodes = forest.table(spark)
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{folder}/nodes.parquet")
    put([f"{r[0]}\t{r[1]:.2f}" for r in feature_importances(nodes, [f.name for f in forest.features]).collect()], "feature_importances.txt")
    put([f"{r[0]}\t{r[1]:.2f}" for r in subset_importances(nodes).collect()], "feature_subset_importances.txt")
