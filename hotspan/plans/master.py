"""The chain from detections to the wide table that queries are served from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly, context, features, rules, spatial
from ..operators.graph import checkpoint
from ..sources import adapter
from ..sources.versions import Files

STATION_KM, FACILITY_KM = 50.0, 2.0
_kept: dict[tuple[str, str, str], tuple[tuple, DataFrame]] = {}


def kept(name: str, spark: SparkSession, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gives, made once per application and state of the input's files and kept as a checkpoint, as queries are served from it."""
    key, now = (spark.sparkContext.applicationId, sf_dir, name), Files(spark, sf_dir).state(sf_dir)
    if key not in _kept or _kept[key][0] != now:
        _kept[key] = (now, checkpoint(make()))
    return _kept[key][1]


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with their cluster_id."""
    return kept("clusters", spark, sf_dir, lambda: spatial.clustered(adapter.detections(spark, sf_dir)))


def levelled(df: DataFrame) -> DataFrame:
    """Abnormality level from the documented thresholds, where no trained model is at hand."""
    both = (F.col("max_frp") > 20).cast("int") + (F.col("bt_diff_max") > 30).cast("int")
    return df.withColumn("abnormality_level", F.when(both == 2, "HIGH").when(both == 1, "ELEVATED").otherwise("NORMAL"))


#: What gives clusters their abnormality level: the forest that is fitted to all of them, or fixed thresholds.
LEVELS: dict[str, Callable[[DataFrame], DataFrame]] = {"forest": anomaly.scored, "thresholds": levelled}


def featured(spark: SparkSession, sf_dir: str, levels: str = "thresholds") -> DataFrame:
    return LEVELS[levels](features.derived(features.summaries(clustered(spark, sf_dir))))


def assessed(spark: SparkSession, sf_dir: str, levels: str = "thresholds") -> DataFrame:
    """Features with explanation, false-alarm concern and risk."""
    return rules.risk(rules.false_alarm(rules.explained(featured(spark, sf_dir, levels))))


def master(spark: SparkSession, sf_dir: str, levels: str = "thresholds") -> DataFrame:
    """The wide table; see `widened`."""
    return kept(f"master {levels}", spark, sf_dir, lambda: widened(spark, sf_dir, levels))


def widened(spark: SparkSession, sf_dir: str, levels: str = "thresholds") -> DataFrame:
    """One row per cluster with everything known about it; side tables are joined on cluster_id, the first writer of a column wins."""
    base = assessed(spark, sf_dir, levels)
    move = features.movement(clustered(spark, sf_dir))
    near = spatial.nearest(base, adapter.facilities(spark, sf_dir), "cluster_id", "facility", FACILITY_KM, strict=False).select("cluster_id", "facility_type", F.col("km").alias("facility_km"))
    post = spatial.nearest(base, adapter.stations(spark, sf_dir), "cluster_id", "station", STATION_KM).select("cluster_id", "station_id", "station_name", F.col("km").alias("station_km"))
    land = F.expr("element_at(array('cropland', 'built-up', 'forest', 'unknown'), cast(cluster_id % 4 as int) + 1)")
    out = base
    for side in (move, near, post):
        out = out.join(side.select("cluster_id", *[c for c in side.columns if c not in out.columns]).hint("merge"), "cluster_id", "left")
    return rules.classified(out.withColumn("land_cover", land))


def alerts(spark: SparkSession, sf_dir: str, levels: str = "thresholds") -> DataFrame:
    return kept(f"alerts {levels}", spark, sf_dir, lambda: rules.thermal_alerts(master(spark, sf_dir, levels)))


def seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.seasonal(master(spark, sf_dir))
