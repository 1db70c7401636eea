"""One row per cluster: activity, intensity, persistence and derived features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import bearing, compass, haversine, mean3, rounded

REPEATED_DAYS, PERSISTENT_DAYS = 2, 5


def summaries(detections: DataFrame) -> DataFrame:
    """Counts, days, means and maxima of each cluster, its persistence score (share of the days observed) and category."""
    window = detections.agg((F.date_diff(F.max("acq_date"), F.min("acq_date")) + 1).alias("window_days"))  # one row
    rank = F.when(F.col("confidence") == "l", 1).when(F.col("confidence") == "n", 2).when(F.col("confidence") == "h", 3)
    c = detections.withColumn("rank", rank).groupBy("cluster_id").agg(
        F.count("*").alias("observation_count"), F.countDistinct("acq_date").alias("active_days"), F.min("acq_date").alias("first_detection"), F.max("acq_date").alias("last_detection"),
        (F.date_diff(F.max("acq_date"), F.min("acq_date")) + 1).alias("duration_days"),
        mean3(F.col("bright_ti4")).alias("mean_bright_ti4"), rounded(F.max("bright_ti4"), 3).alias("max_bright_ti4"),
        mean3(F.col("bright_ti5")).alias("mean_bright_ti5"), rounded(F.max("bright_ti5"), 3).alias("max_bright_ti5"),
        mean3(F.col("frp")).alias("mean_frp"), rounded(F.max("frp"), 3).alias("max_frp"), mean3(F.col("rank")).alias("mean_confidence"),
        mean3(F.col("latitude")).alias("latitude"), mean3(F.col("longitude")).alias("longitude"),
    )
    c = c.join(F.broadcast(window))  # a single row beside every cluster
    category = F.when(F.col("active_days") < REPEATED_DAYS, "isolated").when(F.col("active_days") < PERSISTENT_DAYS, "short_lived_repeated").otherwise("persistent")
    return c.withColumn("persistence_score", rounded(F.col("active_days") / F.col("window_days"), 4)).withColumn("persistence_category", category).drop("window_days")


def derived(clusters: DataFrame) -> DataFrame:
    """Contrast, ratio, density and flag features beside the summaries."""
    span = F.greatest(F.col("duration_days"), F.lit(1))
    code = F.when(F.col("persistence_category") == "isolated", 0).when(F.col("persistence_category") == "short_lived_repeated", 1).when(F.col("persistence_category") == "persistent", 2).otherwise(-1)
    return clusters.withColumns(
        {
            "bt_diff_mean": rounded(F.col("mean_bright_ti4") - F.col("mean_bright_ti5"), 3), "bt_diff_max": rounded(F.col("max_bright_ti4") - F.col("max_bright_ti5"), 3),
            "frp_mean_to_max_ratio": F.when(F.col("max_frp") > 0, rounded(F.try_divide("mean_frp", "max_frp"), 4)).otherwise(1.0),
            "detection_density": rounded(F.col("observation_count") / span, 4), "active_day_ratio": rounded(F.col("active_days") / span, 4),
            "is_multi_day": (F.col("active_days") > 1).cast("int"), "is_persistent_candidate": (F.col("persistence_category") == "persistent").cast("int"), "persistence_category_code": code,
        }
    )


def daily_centroids(detections: DataFrame) -> DataFrame:
    """(cluster_id, day, lat, lon, n): mean position of each cluster's day, to six places from exact sums."""
    mean6 = lambda c: F.sum(F.rint(F.col(c) * 1e6).cast("long")) / F.count(c) / F.lit(1e6)
    return detections.groupBy("cluster_id", F.to_date("acquisition_datetime").alias("day")).agg(mean6("latitude").alias("lat"), mean6("longitude").alias("lon"), F.count("*").alias("n"))


def movement(detections: DataFrame, stationary_km: float = 0.5, step_km: float = 0.05) -> DataFrame:
    """How each cluster's daily centroid moved: distance, rate, bearing, status, and how far a direction can be trusted."""
    days = daily_centroids(detections)
    w = Window.partitionBy("cluster_id").orderBy("day")
    step = days.withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)})
    step = step.withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    turn = F.radians(bearing(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    real = F.col("km") >= step_km
    part = lambda x: F.sum(F.when(real, F.rint(x * 1e6).cast("long")))
    steps = step.groupBy("cluster_id").agg(
        F.count("*").alias("active_days"), F.min_by(F.struct("lat", "lon"), "day").alias("a"), F.max_by(F.struct("lat", "lon"), "day").alias("z"),
        F.count_if(real).alias("n_steps"), part(F.col("km")).alias("w"), part(F.col("km") * F.sin(turn)).alias("s"), part(F.col("km") * F.cos(turn)).alias("c"),
    )
    span = detections.groupBy("cluster_id").agg(F.count("*").alias("observation_count"), (F.max("acquisition_datetime").cast("double") - F.min("acquisition_datetime").cast("double")).alias("seconds"))
    m = steps.join(span.hint("merge"), "cluster_id").withColumn("time_span_days", F.greatest(rounded(F.col("seconds") / 86400.0, 3), F.lit(0.0)))
    known = (F.col("active_days") >= 2) & (F.col("time_span_days") > 0)
    m = m.withColumn("known", known)
    km = haversine(F.col("a.lat"), F.col("a.lon"), F.col("z.lat"), F.col("z.lon"))
    m = m.withColumn("raw_km", F.when(F.col("known"), rounded(km, 6)).otherwise(0.0)).withColumn("raw_bearing", bearing(F.col("a.lat"), F.col("a.lon"), F.col("z.lat"), F.col("z.lon")))
    moved, moving = F.col("raw_km") > 0.01, F.col("raw_km") >= stationary_km
    r = F.least(F.lit(1.0), rounded(F.hypot(F.col("s") / F.col("w"), F.col("c") / F.col("w")), 6))
    m = m.withColumn("r", F.when(F.col("n_steps") > 0, r)).withColumn("score", F.when(F.col("known") & moving & (F.col("n_steps") > 0), F.rint(100.0 * F.col("r") * F.least(F.lit(1.0), F.col("n_steps") / 3.0)).cast("int")).otherwise(0))
    steady = F.col("known") & moving & (F.col("n_steps") > 0) & (F.col("r") >= 0.5)
    none = F.lit("INSUFFICIENT_DATA")
    return m.select(
        "cluster_id", "observation_count", "active_days", "time_span_days", rounded(F.col("raw_km"), 3).alias("total_movement_distance_km"),
        F.when(F.col("known"), rounded(F.col("raw_km") / F.col("time_span_days"), 3)).otherwise(0.0).alias("movement_rate_km_per_day"),
        F.when(F.col("known") & moved, rounded(F.col("raw_bearing"), 2)).otherwise(0.0).alias("movement_bearing_degrees"),
        F.when(~F.col("known"), none).when(moved, compass(F.col("raw_bearing"))).otherwise("STATIONARY").alias("movement_direction"),
        F.when(~F.col("known"), none).when(~moving, "STATIONARY").otherwise("MOVING").alias("movement_status"),
        F.when(~F.col("known"), none).when((F.col("observation_count") < 4) | (F.col("raw_km") < 1.0), "LOW").when(F.col("active_days") <= 3, "MEDIUM").otherwise("HIGH").alias("movement_confidence"),
        F.when(~F.col("known"), "insufficient_evidence").when(~moving, "stationary").when(steady, "directional").otherwise("erratic").alias("movement_pattern"),
        F.when(steady, compass(F.col("raw_bearing"))).alias("direction"), steady.alias("direction_available"), F.col("score").alias("direction_confidence_score"),
        F.when(~F.col("known") | ~moving | (F.col("n_steps") == 0), "INSUFFICIENT")
        .when(steady & (F.col("score") >= 60) & (F.col("n_steps") >= 3) & (F.col("active_days") >= 4) & (F.col("r") >= 0.7), "HIGH")
        .when(steady & (F.col("score") >= 35), "MODERATE").otherwise("PRELIMINARY").alias("direction_confidence"),
    )
