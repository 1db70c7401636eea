"""Connected components as a sequence of joins and minima."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset, which only a local master may have."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b", keep: Callable[[DataFrame], DataFrame] = checkpoint, drop: Callable[..., None] = lambda *_: None) -> DataFrame:
    """Connected components of an undirected edge table: (node, component), component being the smallest node reached.

    Every round takes the least label among a node's neighbours, then the label of that label, so that long chains
    shorten by half. Minima are pre-aggregated before they are shuffled; nothing but one sum reaches the driver.
    Only nodes that have an edge are returned; null ends are left out. No side of a join is broadcast, as all of them
    grow with the edges and a table just under Spark's limit takes many times its size in the driver.
    `keep` cuts the lineage of what a round makes, `drop` takes what is not needed any more, but for the last labels.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    e = keep(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = keep(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    before = None
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before or now is None:
            drop(e)
            return labels.select("node", F.col("label").alias("component"))
        before = now
        near = e.join(labels.hint("merge"), e.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        step = keep(labels.join(near.hint("merge"), labels.node == near.a).select("node", F.least("label", "m").alias("label")))
        drop(labels)
        up = step.select(F.col("node").alias("up"), F.col("label").alias("top"))
        labels = keep(step.join(up.hint("merge"), step.label == up.up, "left").select("node", F.least("label", "top").alias("label")))
        drop(step)
