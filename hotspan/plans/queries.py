"""Named queries over the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar
from ..operators import anomaly, cleaning, context, features, identity, lifecycle, quantiles, rules, spatial
from ..sources import adapter
from . import master as m

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
C = F.col
LEVELS = ("LOW", "MEDIUM", "HIGH")
#: Features whose extremes and gaps count as noise.
UNCERTAIN_FROM = ("bt_diff_mean", "bt_diff_max", "frp_mean_to_max_ratio", "detection_density", "active_day_ratio")


def noisy(x: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """`x` with its features standardised, and their names."""
    return anomaly.standardised(x, anomaly.scales(x, UNCERTAIN_FROM)), tuple(f"std_{c}" for c in UNCERTAIN_FROM)


def named(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


# --- sources, cleaning -------------------------------------------------------------------------------------------------


@named
def s3_satellite_labels(spark, d):
    """Satellite labels from file names."""
    raw = adapter.dirty_detections(spark, d)
    return raw.groupBy(cleaning.satellite_label(C("source_file")).alias("source_satellite"), "source_file").agg(F.count("*").alias("n"))


@named
def s5_date_chunks(spark, d):
    """The days of the detections cut into download windows of ten days."""
    return cleaning.range_chunks(adapter.detections(spark, d), 10)


@named
def s9_s12_nested_features(spark, d):
    """Properties of features parsed from JSON text."""
    e = adapter.read(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k int").alias("p")).where("p.k >= 90").groupBy(C("p.k").alias("k")).agg(F.count("*").alias("n"))


@named
def p1_p2_typed(spark, d):
    """Numbers, padded times and timestamps from text."""
    t = cleaning.typed(adapter.dirty_detections(spark, d))
    return t.select("row_pos", "latitude", "longitude", "acq_time", F.date_format("acquisition_datetime", "yyyy-MM-dd HH:mm").alias("stamp"), "confidence")


@named
def p3_valid_positions(spark, d):
    return cleaning.valid_positions(cleaning.typed(adapter.dirty_detections(spark, d))).groupBy("satellite").agg(F.count("*").alias("n"))


@named
def w1_without_repeats(spark, d):
    """The first of repeated observations."""
    return cleaning.clean(adapter.dirty_detections(spark, d)).select("row_pos", "detection_id", "acq_time", "confidence")


@named
def p4_observation_keys(spark, d):
    """Hash ids of observations."""
    x = adapter.detections(spark, d)
    return x.select("detection_id", scalar.detection_key(C("latitude"), C("longitude"), C("acq_date"), C("acq_time"), C("satellite")).alias("observation_key"))


@named
def p5_missing_summary(spark, d):
    return cleaning.missing_summary(adapter.dirty_detections(spark, d), ("latitude", "longitude", "acq_date", "frp"))


@named
def a12_cleaning_report(spark, d):
    return cleaning.cleaning_report(adapter.dirty_detections(spark, d))


@named
def p18_inside_boundary(spark, d):
    """Detections inside the boundary polygon, by day."""
    x = adapter.detections(spark, d)
    return x.where(spatial.inside(C("latitude"), C("longitude"), adapter.BOUNDARY)).groupBy("acq_date").agg(F.count("*").alias("n"))


@named
def a12_boundary_report(spark, d):
    x = adapter.detections(spark, d)
    return x.agg(F.count("*").alias("input_rows"), F.count_if(spatial.inside(C("latitude"), C("longitude"), adapter.BOUNDARY)).alias("inside_rows"))


# --- clusters, features ------------------------------------------------------------------------------------------------


@named
def j5_neighbour_pairs(spark, d):
    """Pairs of detections at most 1 km and 3 days apart."""
    return spatial.neighbour_pairs(adapter.detections(spark, d))


@named
def j5_neighbour_pairs_exact(spark, d):
    """The same without missing pairs beyond the neighbouring cell at high latitudes."""
    return spatial.neighbour_pairs(adapter.detections(spark, d), exact=True)


@named
def a19_clusters(spark, d):
    """The cluster of every detection."""
    return m.clustered(spark, d).select("detection_id", "cluster_id")


@named
def w8_cluster_numbers(spark, d):
    """Clusters numbered from 0 by first appearance, ranked per block of ids and shifted by the blocks before."""
    ids = m.clustered(spark, d).select("cluster_id").distinct().withColumn("block", F.expr("cluster_id div 4096"))
    before = ids.groupBy("block").count().select("block", (F.sum("count").over(Window.orderBy("block")) - C("count")).alias("before"))
    r = F.row_number().over(Window.partitionBy("block").orderBy("cluster_id"))
    return ids.withColumn("r", r).join(before, "block").select("cluster_id", (C("before") + C("r") - 1).alias("number"))


@named
def a1_cluster_summary(spark, d):
    return features.summaries(m.clustered(spark, d))


@named
def a2_a3_globals(spark, d):
    """Dataset window in days, and whether most confidence values are numbers."""
    x = adapter.detections(spark, d)
    return x.agg((F.date_diff(F.max("acq_date"), F.min("acq_date")) + 1).alias("window_days"), (F.avg(C("confidence").try_cast("double").isNotNull().cast("int")) > 0.5).alias("numeric_confidence"))


@named
def a4_centroids(spark, d):
    g = m.clustered(spark, d).groupBy("cluster_id")
    return g.agg(scalar.mean3(C("latitude")).alias("latitude"), scalar.mean3(C("longitude")).alias("longitude"), F.min("acq_date").alias("acq_date"))


@named
def a5_daily_centroids(spark, d):
    return features.daily_centroids(m.clustered(spark, d)).select("cluster_id", "day", scalar.rounded(C("lat"), 5).alias("lat"), scalar.rounded(C("lon"), 5).alias("lon"), "n")


@named
def a6_category_counts(spark, d):
    return m.featured(spark, d).groupBy("persistence_category").agg(F.count("*").alias("n"))


@named
def d1_features(spark, d):
    keep = ("cluster_id", "bt_diff_mean", "bt_diff_max", "frp_mean_to_max_ratio", "detection_density", "active_day_ratio", "is_multi_day", "is_persistent_candidate", "persistence_category_code")
    return m.featured(spark, d).select(*keep)


@named
def d4_outlier_scores(spark, d):
    return anomaly.scored(m.featured(spark, d)).select("cluster_id", "anomaly_score", "anomaly_flag", "abnormality_level")


@named
def d5_explanations(spark, d):
    return rules.explained(m.featured(spark, d)).select("cluster_id", "abnormality_level", "anomaly_characterization", "explanation", "contributing_factors")


@named
def d6_false_alarm(spark, d):
    return rules.false_alarm(m.featured(spark, d)).select("cluster_id", "false_alarm_score", "false_alarm_indicator", "false_alarm_reasons", "detection_reliability")


@named
def d7_risk(spark, d):
    return m.assessed(spark, d).select("cluster_id", "risk_score", "risk_level", "risk_factors", "risk_explanation")


@named
def d8_risk_evidence(spark, d):
    """Parts of the risk score, one row each, with the score that they add up to."""
    x = m.assessed(spark, d)
    x = x.select("cluster_id", rules.risk_evidence(x).alias("e"))
    return x.select("cluster_id", "e.base_score", "e.reliability_multiplier", "e.final_score", F.explode("e.components").alias("c")).select("cluster_id", "base_score", "reliability_multiplier", "final_score", "c.key", "c.points", "c.max_points")


@named
def d9_movement(spark, d):
    return features.movement(m.clustered(spark, d))


@named
def d10_classification(spark, d):
    return m.master(spark, d).select("cluster_id", "classification_label", "classification_score")


@named
def d11_thermal_alerts(spark, d):
    return m.alerts(spark, d).select("alert_id", "cluster_id", "severity", "status", "evidence_confidence", "suppressed", "reasons", "alert_rationale")


@named
def d12_operational_alerts(spark, d):
    return rules.operational_alerts(m.master(spark, d)).select("cluster_id", "alert_priority", "recommended_action")


@named
def d13_eligibility(spark, d):
    return rules.eligibility(m.alerts(spark, d)).select("cluster_id", "notification_eligible", "eligibility_reason")


@named
def d14_d16_seasonal(spark, d):
    return m.seasonal(spark, d).select("cluster_id", "season_region", "seasonal_label", "seasonal_score", "seasonal_risk_modifier")


@named
def d17_d18_uncertainty(spark, d):
    x = m.master(spark, d).withColumns({"completeness": C("active_day_ratio"), "cloud": (C("cluster_id") % 101) / 100.0})
    return context.uncertainty(*noisy(x)).select("cluster_id", "uncertainty", "ci_low", "ci_high", "needs_review", "risk_uncertainty", "risk_ci_low", "risk_ci_high", "risk_needs_review")


@named
def d19_d36_cloud(spark, d):
    return context.cloud_view(adapter.detections(spark, d)).select("detection_id", "cloud_probability", "cloud_type", "ir_penetration_factor", "adjusted_confidence", "cloud_review")


@named
def d20_interpolated_linear(spark, d):
    return context.interpolated(context.daily_series(m.clustered(spark, d)))


@named
def d20_interpolated_nearest(spark, d):
    return context.interpolated(context.daily_series(m.clustered(spark, d)), "nearest")


@named
def d20_interpolated_spline_cloudy(spark, d):
    """Smooth-step fills of the gaps that are cloudy on all days."""
    return context.interpolated(context.daily_series(m.clustered(spark, d)), "spline", clouds=adapter.clouds(spark, d))


@named
def d20_interpolation_quality(spark, d):
    """How far each cluster's series can be trusted when its cloudy gaps are filled."""
    x = context.interpolation_quality(context.daily_series(m.clustered(spark, d)), clouds=adapter.clouds(spark, d))
    return x.select("cluster_id", "n_original", "n_interpolated", scalar.rounded(C("quality"), 6).alias("quality"), F.array_join("warnings", " | ").alias("warnings"))


@named
def d22_d23_gap_reasons(spark, d):
    return context.gap_reasons(context.daily_series(m.clustered(spark, d)), adapter.clouds(spark, d))


@named
def d24_fire_weather(spark, d):
    e = adapter.read(spark, d, "events")
    return e.select("event_id", context.fire_weather(C("value") / 10.0, F.lit(100.0) - C("value") / 5.0, C("value") / 50.0, (C("event_id") % 7).cast("double")).alias("fire_weather_index"))


@named
def d28_event_keys(spark, d):
    return identity.summaries(m.clustered(spark, d)).select("cluster_id", "event_key", "observation_count", "last_seen")


@named
def d33_destination(spark, d):
    """Where a movement arrow of 5 km ends."""
    x = features.movement(m.clustered(spark, d)).where("direction_available").join(m.featured(spark, d).select("cluster_id", "latitude", "longitude"), "cluster_id")
    lat, lon = scalar.destination(C("latitude"), C("longitude"), C("movement_bearing_degrees"), 5.0)
    return x.select("cluster_id", scalar.rounded(lat, 4).alias("lat"), scalar.rounded(lon, 4).alias("lon"))


# --- joins -------------------------------------------------------------------------------------------------------------


@named
def j6_nearest_facility(spark, d):
    return spatial.nearest(m.featured(spark, d), adapter.facilities(spark, d), "cluster_id", "facility", m.FACILITY_KM, strict=False).select("cluster_id", "facility_id", "facility_type", "km")


@named
def j7_nearest_station(spark, d):
    return spatial.nearest(m.featured(spark, d), adapter.stations(spark, d), "cluster_id", "station", m.STATION_KM).select("cluster_id", "station_id", "station_name", "km")


@named
def j7_stations_ranked(spark, d):
    """The five nearest stations of each cluster within 100 km."""
    found = spatial.within_radius(m.featured(spark, d), adapter.stations(spark, d), "cluster_id", "station", 100.0)
    w = Window.partitionBy("cluster_id").orderBy("km", "station_id")
    return found.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("cluster_id", "rank", "station_id", scalar.rounded(C("km"), 2).alias("km"))


@named
def j9_scene_match(spark, d):
    """For each cluster the clearest scene within five days whose footprint holds it."""
    scenes = adapter.read(spark, d, "part").selectExpr("p_partkey as scene_id", "date_add(date'2024-01-01', cast(p_partkey % 30 as int)) as scene_date", "p_size * 2 as cloud", "8.0D + ((p_partkey * 53L) % 250) * 0.1D as s_lat", "70.0D + ((p_partkey * 71L) % 250) * 0.1D as s_lon").where("cloud <= 60")
    scenes = scenes.withColumn("cx", F.explode(F.expr("sequence(cast(floor(s_lat) as bigint), cast(floor(s_lat + 1) as bigint))"))).withColumn("cy", F.explode(F.expr("sequence(cast(floor(s_lon) as bigint), cast(floor(s_lon + 1) as bigint))")))
    c = m.featured(spark, d).select("cluster_id", "latitude", "longitude", "first_detection", F.floor("latitude").alias("cx"), F.floor("longitude").alias("cy"))
    holds = C("latitude").between(C("s_lat"), C("s_lat") + 1) & C("longitude").between(C("s_lon"), C("s_lon") + 1) & (F.abs(F.date_diff("scene_date", "first_detection")) <= 5)
    w = Window.partitionBy("cluster_id").orderBy("cloud", "scene_id")
    return c.join(scenes, ["cx", "cy"]).where(holds).withColumn("n", F.row_number().over(w)).where("n = 1").select("cluster_id", "scene_id", "cloud")


@named
def j1_j4_detections_with_results(spark, d):
    """Detections beside the results of their cluster, by level."""
    x = m.clustered(spark, d).join(m.assessed(spark, d).select("cluster_id", "risk_level"), "cluster_id", "left")
    return x.groupBy("risk_level", "satellite").agg(F.count("*").alias("n"))


@named
def j12_unseen(spark, d):
    """Detections of the last days whose place and satellite were not seen before."""
    x = adapter.detections(spark, d)
    key = [scalar.fixed(C("latitude"), 3).alias("a"), scalar.fixed(C("longitude"), 3).alias("o"), "satellite"]
    old = x.where("acq_date < date'2024-01-21'").select(*key)
    return x.where("acq_date >= date'2024-01-21'").select("detection_id", *key).join(old, ["a", "o", "satellite"], "left_anti").select("detection_id")


@named
def j13_cloud_join(spark, d):
    """Days with their cloud cover, 50 where none is recorded."""
    days = adapter.detections(spark, d).groupBy("acq_date").agg(F.count("*").alias("n"))
    return days.join(adapter.clouds(spark, d), "acq_date", "left").select("acq_date", "n", F.coalesce("cloud_cover", F.lit(50.0)).alias("cloud_cover"))


# --- aggregations, order, pages ----------------------------------------------------------------------------------------


@named
def a7_statistics(spark, d):
    """Counts over fixed domains, zeros included, in one row."""
    x = m.alerts(spark, d)
    of = lambda col, values: [F.count_if(C(col) == v).alias(f"{col}_{v.lower()}") for v in values]
    return x.agg(F.count("*").alias("clusters"), *of("risk_level", LEVELS), *of("false_alarm_indicator", LEVELS), *of("abnormality_level", ("NORMAL", "ELEVATED", "HIGH")), *of("movement_status", ("MOVING", "STATIONARY", "INSUFFICIENT_DATA")))


@named
def a8_crosstab(spark, d):
    """Abnormality by risk with margins."""
    x = m.assessed(spark, d).cube("abnormality_level", "risk_level").agg(F.count("*").alias("n"))
    return x.select(F.coalesce("abnormality_level", F.lit("All")).alias("abnormality_level"), F.coalesce("risk_level", F.lit("All")).alias("risk_level"), "n")


@named
def a9_ranges(spark, d):
    x = m.master(spark, d)
    return x.agg(F.min("risk_score").alias("least"), F.max("risk_score").alias("most"), scalar.mean3(C("risk_score")).alias("mean"), F.max(F.when(C("movement_status") == "MOVING", C("total_movement_distance_km"))).alias("farthest"))


@named
def a10_alert_counts(spark, d):
    x = m.alerts(spark, d)
    return x.agg(*[F.count_if(C("severity") == s).alias(s.lower()) for s in ("LOW", "MEDIUM", "HIGH", "CRITICAL")], F.count_if(C("suppressed")).alias("suppressed"), F.count_if(C("classification_label").contains("Industrial")).alias("industrial"), F.count_if(C("station_km").isNotNull()).alias("with_station"))


@named
def a11_analytics(spark, d):
    x = m.master(spark, d)
    return x.groupBy("persistence_category").agg(F.count("*").alias("n"), scalar.mean3(C("mean_frp")).alias("avg_frp"), F.max("max_frp").alias("peak_frp"), scalar.mean3(F.when(C("movement_status") == "MOVING", C("movement_rate_km_per_day"))).alias("avg_rate"))


@named
def a13_uncertainty_rollup(spark, d):
    x = m.master(spark, d).withColumns({"completeness": C("active_day_ratio"), "cloud": (C("cluster_id") % 101) / 100.0})
    return context.uncertainty(*noisy(x)).groupBy("risk_level").agg(scalar.mean3(C("uncertainty")).alias("mean"), F.max("uncertainty").alias("most"), F.count_if(C("uncertainty") > 0.3).alias("uncertain"), F.count("*").alias("n"))


@named
def a14_monthly(spark, d):
    """The seasonal report of all detections: by region and month, with what it recommends."""
    return context.seasonal_report(adapter.detections(spark, d))


@named
def a15_cloud_correlation(spark, d):
    """By cluster: cloudy and clear days, and cloudy ones without a detection."""
    return context.cloud_correlation(m.clustered(spark, d), adapter.clouds(spark, d))


@named
def a16_daily_max(spark, d):
    return context.daily_series(m.clustered(spark, d))


@named
def a17_quantiles(spark, d):
    """Exact medians and quartiles that scale the features of the outlier model."""
    x = m.featured(spark, d)
    found = quantiles.exact(x, ("max_frp", "max_bright_ti4"), (0.25, 0.5, 0.75))
    q1, median, q3 = found["max_frp"]
    row = (median, q1, q3, found["max_bright_ti4"][1])
    names = ("frp_median", "frp_q1", "frp_q3", "ti4_median")
    return spark.createDataFrame([row], ", ".join(f"{n} double" for n in names)).select(*[scalar.rounded(C(n), 6).alias(n) for n in names])


@named
def a20_a21_max_and_distinct(spark, d):
    return m.clustered(spark, d).agg(F.max("cluster_id").alias("max_id"), F.countDistinct("cluster_id").alias("clusters"))


@named
def a22_evaluation(spark, d):
    """Confusion counts of a threshold rule against labels."""
    x = adapter.read(spark, d, "labels").join(adapter.read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    p = (C("n_chars") >= 1000).cast("int")
    return x.groupBy(C("quality").alias("actual"), p.alias("predicted")).agg(F.count("*").alias("n"))


@named
def a22_scores(spark, d):
    """Accuracy, precision, recall and F1 of the same rule."""
    x = adapter.read(spark, d, "labels").join(adapter.read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(C("quality").alias("y"), (C("n_chars") >= 1000).cast("int").alias("p"))
    t = x.agg(F.count("*").alias("n"), F.count_if(F.expr("y = p")).alias("ok"), F.count_if(F.expr("y = 1 and p = 1")).alias("tp"), F.sum("y").alias("pos"), F.sum("p").alias("said"))
    pr, rc = F.try_divide(C("tp") * 1.0, C("said")), F.try_divide(C("tp") * 1.0, C("pos"))
    return t.select(scalar.rounded(C("ok") * 1.0 / C("n"), 6).alias("accuracy"), scalar.rounded(pr, 6).alias("precision"), scalar.rounded(rc, 6).alias("recall"), scalar.rounded(2.0 * pr * rc / (pr + rc), 6).alias("f1"))


@named
def a23_rate_by_type(spark, d):
    """Share of abnormal clusters by category, per mille."""
    x = m.featured(spark, d)
    return x.groupBy("persistence_category").agg(F.rint(F.count_if(C("abnormality_level") != "NORMAL") * 1000.0 / F.count("*")).cast("long").alias("per_mille"))


@named
def o1_top_risk(spark, d):
    """The ten clusters of highest risk."""
    return m.assessed(spark, d).orderBy(F.desc("risk_score"), "cluster_id").limit(10).select("cluster_id", "risk_score", "risk_level")


@named
def o1_top_movers(spark, d):
    return features.movement(m.clustered(spark, d)).where("movement_status = 'MOVING'").orderBy(F.desc("movement_rate_km_per_day"), "cluster_id").limit(10).select("cluster_id", "movement_rate_km_per_day", "movement_direction")


@named
def o2_o3_alert_order(spark, d):
    """The first fifty alerts by severity and risk."""
    x = m.alerts(spark, d)
    return x.orderBy(F.desc(lifecycle.rank(C("severity"))), F.desc(F.coalesce("risk_score", F.lit(-1.0))), "cluster_id").limit(50).select("alert_id", "severity", "risk_score")


@named
def o5_o6_page(spark, d):
    """Third page of 25 filtered clusters by id."""
    x = m.assessed(spark, d).where(C("risk_level").isin("MEDIUM", "HIGH"))
    return x.orderBy("cluster_id").offset(50).limit(25).select("cluster_id", "risk_level", "risk_score")


@named
def o7_relevance(spark, d):
    """Names that match a query: equal, then starting with it, then holding it."""
    n = adapter.read(spark, d, "nation").select("n_name", F.lower("n_name").alias("low")).where("contains(low, 'an')")
    return n.select("n_name", F.when(C("low") == "an", 0).when(C("low").startswith("an"), 1).otherwise(2).alias("relevance"))


@named
def o9_sample(spark, d):
    """Five clusters chosen by hash, the same every time."""
    return m.featured(spark, d).orderBy(F.md5(C("cluster_id").cast("string")), "cluster_id").limit(5).select("cluster_id")


# --- filters -----------------------------------------------------------------------------------------------------------


def any_of(column: str, wanted: str):
    """Case-insensitive membership in a comma-separated list; an empty list passes all."""
    values = [v.strip().upper() for v in wanted.split(",") if v.strip()]
    return F.upper(column).isin(*values) if values else F.lit(True)


@named
def p6_p8_events_filter(spark, d):
    """Clusters by lists of levels, a pattern of the class, and a range of first days."""
    x = m.master(spark, d)
    x = x.where(any_of("risk_level", "high, medium") & any_of("false_alarm_indicator", "low,medium") & F.coalesce(C("classification_label").rlike("(?i)industr|agric"), F.lit(False)))
    return x.where(C("first_detection").between("2024-01-05", "2024-01-25")).select("cluster_id", "risk_level", "classification_label", "first_detection")


@named
def p9_facets(spark, d):
    """Or within a facet, and across facets; an empty facet passes."""
    x = m.master(spark, d)
    facets = {"risk_level": "HIGH,MEDIUM", "movement_status": "", "persistence_category": "isolated,persistent"}
    for col, wanted in facets.items():
        x = x.where(any_of(col, wanted))
    return x.groupBy("risk_level", "persistence_category").agg(F.count("*").alias("n"))


@named
def p10_search(spark, d):
    """Clusters whose id, characterisation, factors or explanation hold a text."""
    x = rules.explained(m.featured(spark, d))
    hit = F.lower(F.concat_ws(" ", C("cluster_id").cast("string"), "anomaly_characterization", "contributing_factors", "explanation")).contains("persist")
    return x.where(hit).select("cluster_id", "anomaly_characterization")


@named
def p11_p12_lookup(spark, d):
    """One cluster by id, in the columns of the service."""
    first = m.clustered(spark, d).agg(F.min("cluster_id").alias("cluster_id"))
    return m.assessed(spark, d).join(F.broadcast(first), "cluster_id", "left_semi").select("cluster_id", "latitude", "longitude", "risk_score", "risk_level", "false_alarm_indicator", "persistence_category")


@named
def p13_p14_defaults(spark, d):
    """Missing values of the wide table filled with its defaults."""
    x = m.master(spark, d).select("cluster_id", "facility_type", "facility_km", "station_km")
    return x.select("cluster_id", scalar.clean(C("facility_type")).alias("facility_type"), F.coalesce("facility_km", F.lit(999.0)).alias("facility_km"), F.coalesce("station_km", F.lit(-1.0)).alias("station_km"))


@named
def p15_popups(spark, d):
    return m.alerts(spark, d).where("status = 'ACTIVE' and not suppressed and severity in ('HIGH', 'CRITICAL')").select("alert_id", "severity")


@named
def p16_reliable_directions(spark, d):
    x = features.movement(m.clustered(spark, d))
    return x.where("movement_status = 'MOVING' and direction_available and direction_confidence in ('MODERATE', 'HIGH')").select("cluster_id", "direction", "direction_confidence_score")


@named
def p17_prohibited_terms(spark, d):
    """How many rationales claim a confirmed fire: none may, apart from the disclaimer."""
    x = m.alerts(spark, d).select(F.regexp_replace("alert_rationale", "Does not constitute a confirmed fire declaration", "").alias("t"))
    return x.agg(F.count("*").alias("n"), F.count_if(C("t").rlike("(?i)confirmed fire")).alias("prohibited"))


@named
def api_map_data(spark, d):
    """Features of the map: one JSON text per cluster, with its position in degrees."""
    degrees = lambda c: scalar.rounded(C(c), 5).cast("decimal(9,5)")
    point = F.struct(F.lit("Point").alias("type"), F.array(degrees("longitude"), degrees("latitude")).alias("coordinates"))
    properties = F.struct("cluster_id", C("risk_score").cast("decimal(6,2)").alias("risk_score"), "risk_level", "abnormality_level", "false_alarm_indicator", "classification_label", "movement_status")
    return m.master(spark, d).select("cluster_id", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties"))).alias("feature"))


@named
def u5_factor_union(spark, d):
    """Two lists of factors joined, each factor once, however it is capitalised; the first way of writing it stays."""
    x = m.assessed(spark, d)
    both = F.concat(F.split("contributing_factors", ","), F.split("persistence_category", ","))
    low = F.transform(both, lambda f: F.lower(f))
    return rules.explained(x).select("cluster_id", F.array_join(F.filter(both, lambda f, i: F.array_position(low, F.lower(f)) == i + 1), ";").alias("factors"))


@named
def u1_u3_union_distinct(spark, d):
    """Places of stations and facilities in one list, each cell once."""
    a = adapter.stations(spark, d).select(F.floor("station_lat").alias("a"), F.floor("station_lon").alias("o"))
    b = adapter.facilities(spark, d).select(F.floor("facility_lat").alias("a"), F.floor("facility_lon").alias("o"))
    return a.unionByName(b).distinct()


@named
def u4_remaining(spark, d):
    """Clusters that no alert above LOW covers."""
    x = m.alerts(spark, d)
    return x.select("cluster_id").exceptAll(x.where("severity <> 'LOW'").select("cluster_id"))


@named
def masked_phones(spark, d):
    c = adapter.read(spark, d, "customer")
    return c.select("c_custkey", scalar.masked_phone(F.concat(F.lit("+91 "), F.lpad((C("c_custkey") * 7919 % 100000).cast("string"), (C("c_custkey") % 9).cast("int"), "0"))).alias("phone"))


# --- state -------------------------------------------------------------------------------------------------------------


def cycles(spark, d) -> tuple[DataFrame, DataFrame]:
    """An old snapshot and a fresh run made from one run's alerts."""
    x = m.alerts(spark, d).select("cluster_id", "severity")
    lower = F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL"))), (C("cluster_id") * 7 % 3 + 1).cast("int"))
    old = x.where("cluster_id % 5 <> 0").select("cluster_id", lower.alias("severity"), F.element_at(F.array(*map(F.lit, ("ACTIVE", "ACKNOWLEDGED", "RESOLVED"))), (C("cluster_id") % 3 + 1).cast("int")).alias("status"))
    return old.withColumn("resolved_severity", F.when(C("status") == "RESOLVED", C("severity"))), x


@named
def d30_alert_sync(spark, d):
    """The alert snapshot after a second run."""
    return lifecycle.synced(*cycles(spark, d))[0]


@named
def d30_alert_history(spark, d):
    return lifecycle.synced(*cycles(spark, d))[1]


@named
def d30_transitions(spark, d):
    """Every fourth alert acknowledged, where that is allowed."""
    old, _ = cycles(spark, d)
    return lifecycle.moved(old, old.where("cluster_id % 4 = 0"), "ACKNOWLEDGED")


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
