"""Fitted outlier models as tables: one row a node, one a feature and one for the threshold."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.anomaly import Model
from . import versions

NODES = "tree int, node int, feature int, cut double, left int, right int, size int"
SCALES = "position int, name string, middle double, spread double"


def save(spark: SparkSession, model: Model, path: str) -> int:
    """Commit a model as the next version of `path`, and its number; a model is small, whatever it was fitted to."""
    nodes = [(t, n, int(f), float(c), int(a), int(b), int(s)) for t, tree in enumerate(model.trees) for n, (f, c, a, b, s) in enumerate(tree)]
    scales = [(k, name, float(m), float(r)) for k, (name, (m, r)) in enumerate(model.by.items())]
    versions.write(spark.createDataFrame(nodes, NODES), f"{path}/nodes")
    versions.write(spark.createDataFrame(scales, SCALES), f"{path}/scales")
    return versions.write(spark.createDataFrame([(float(model.cut), versions.live(spark, f"{path}/nodes")["version"], versions.live(spark, f"{path}/scales")["version"])], "cut double, nodes int, scales int"), f"{path}/model")


def load(spark: SparkSession, path: str, version: int | None = None) -> Model:
    """The live model of `path`, or the one of that number, bit for bit as it was saved. ValueError where there is none."""
    head = versions.read(spark, f"{path}/model", version).first()
    trees: list[list[tuple[int, float, int, int, int]]] = []
    for r in versions.read(spark, f"{path}/nodes", head.nodes).orderBy("tree", "node").collect():
        if r.tree == len(trees):
            trees.append([])
        trees[r.tree].append((r.feature, r.cut, r.left, r.right, r.size))
    by = {r.name: (r.middle, r.spread) for r in versions.read(spark, f"{path}/scales", head.scales).orderBy("position").collect()}
    return Model(by, trees, head.cut)
