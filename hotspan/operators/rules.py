"""Rule engines over cluster rows: pure column expressions. NULL inputs fall through to the next rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean, fixed, rounded
from .cleaning import require_columns

C = F.col


def points(*cases: tuple[Column, float], otherwise: float = 0.0) -> Column:
    """The points of the first condition that holds."""
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


def listed(*items: Column, sep: str = "; ") -> Column:
    """The items that are not NULL, joined."""
    return F.concat_ws(sep, *items)


def explained(df: DataFrame) -> DataFrame:
    """Why a cluster is abnormal: characterisation, a sentence, the factors."""
    require_columns(df, ("abnormality_level",))
    hot, contrast = C("max_bright_ti4") >= 340, C("bt_diff_max") >= 45
    strong, mean = C("max_frp") >= 15, C("mean_frp") >= 10
    intensity, energy = F.coalesce(hot | contrast, F.lit(False)), F.coalesce(strong | mean, F.lit(False))
    lasting = F.coalesce(C("active_days") >= 4, F.lit(False))
    recurring = F.coalesce(~lasting & (C("active_days") >= 2) & (C("duration_days") > 4), F.lit(False))
    n = sum((x.cast("int") for x in (intensity, energy, lasting, recurring)), F.lit(0))
    normal = F.coalesce(C("abnormality_level"), F.lit("NORMAL")) == "NORMAL"
    label = (
        F.when(normal, "NORMAL_THERMAL_ACTIVITY").when(n > 1, "MULTI_FACTOR_ANOMALY").when(lasting, "PERSISTENT_THERMAL_ACTIVITY").when(recurring, "RECURRING_THERMAL_ACTIVITY")
        .when(intensity & (C("active_days") <= 2), "SHORT_LIVED_EXTREME_EVENT").when(intensity, "HIGH_THERMAL_INTENSITY").when(energy, "HIGH_THERMAL_ENERGY").otherwise("STATISTICAL_ANOMALY")
    )
    told = F.filter(
        F.array(
            F.when(intensity, "elevated thermal intensity"), F.when(energy, "elevated thermal energy (FRP)"), F.when(lasting, "persistent multi-day activity"),
            F.when(recurring, "recurring thermal activity over an extended duration"), F.when(n == 0, "unusual multi-variate statistical signature"),
        ),
        lambda x: x.isNotNull(),
    )
    last = F.element_at(told, -1)
    phrase = F.when(F.size(told) > 1, F.concat(F.array_join(F.slice(told, F.lit(1), F.size(told) - 1), ", "), F.lit(" and "), last)).otherwise(last)
    sentence = F.concat(F.initcap(C("abnormality_level")), F.lit(" abnormality primarily associated with "), phrase, F.lit("."))
    factors = listed(F.when(hot, "max_bright_ti4"), F.when(contrast, "bt_diff_max"), F.when(strong, "max_frp"), F.when(mean, "mean_frp"), F.when(lasting, "active_days"), F.when(recurring, "duration_days"), F.when(n == 0, "multivariate_combination"), sep=",")
    return df.withColumns({"anomaly_characterization": label, "explanation": F.when(normal, "Thermal activity falls within normal statistical bounds.").otherwise(sentence), "contributing_factors": F.when(normal, "none").otherwise(factors)})


def false_alarm(df: DataFrame) -> DataFrame:
    """Concern that a cluster is a false alarm, from added points, with reasons and reliability."""
    require_columns(df, ("observation_count", "active_days", "max_frp"))
    single, once = C("observation_count") == 1, (C("active_days") == 1) & (C("duration_days") == 1)
    unsure, weak = C("mean_confidence") < 1.5, C("max_frp") < 2
    flat = (C("bt_diff_max") < 25) | (C("max_bright_ti4") < 315)
    score = (
        points((single, 2), (C("observation_count") >= 5, -2), otherwise=0) + points((once, 1), ((C("active_days") >= 3) | (C("persistence_category") == "persistent"), -2), otherwise=0)
        + points((unsure, 2), (C("mean_confidence") >= 2.5, -1), otherwise=0) + points((weak, 1), (C("max_frp") >= 15, -2), otherwise=0)
        + points((flat, 1), ((C("max_bright_ti4") >= 340) | (C("bt_diff_max") >= 45), -1), otherwise=0)
    )
    reasons = listed(F.when(single, "single point observation"), F.when(once, "no temporal recurrence"), F.when(unsure, "low satellite confidence rating"), F.when(weak, "weak thermal power (< 2 MW)"), F.when(flat, "low spectral temperature contrast"))
    out = df.withColumn("false_alarm_score", score.cast("int"))
    s = C("false_alarm_score")
    reasons = F.when(reasons != "", reasons).otherwise(F.when(s < 1, "strong supporting evidence across thermal and temporal metrics").otherwise("strong supporting evidence"))
    return out.withColumns({"false_alarm_indicator": F.when(s >= 3, "HIGH").when(s >= 1, "MEDIUM").otherwise("LOW"), "false_alarm_reasons": reasons, "detection_reliability": F.when(s >= 3, "LOW").when(s >= 1, "MEDIUM").otherwise("HIGH")})


def risk_parts() -> dict[str, Column]:
    return {
        "abnormality_points": points((C("abnormality_level") == "HIGH", 35.0), (C("abnormality_level") == "ELEVATED", 20.0), otherwise=5.0),
        "frp_points": points((C("max_frp") >= 20, 25.0), (C("max_frp") >= 10, 18.0), (C("max_frp") >= 5, 12.0), (C("max_frp") >= 2, 6.0)),
        "persistence_points": points(((C("persistence_category") == "persistent") | (C("active_days") >= 4), 20.0), ((C("persistence_category") == "short_lived_repeated") | (C("active_days") >= 2), 12.0), otherwise=3.0),
        "intensity_points": points(((C("max_bright_ti4") >= 350) | (C("bt_diff_max") >= 50), 20.0), ((C("max_bright_ti4") >= 335) | (C("bt_diff_max") >= 35), 12.0), otherwise=4.0),
        "reliability_multiplier": points((C("false_alarm_indicator") == "LOW", 1.0), (C("false_alarm_indicator") == "MEDIUM", 0.85), (C("false_alarm_indicator") == "HIGH", 0.5), otherwise=0.85),
    }


def risk(df: DataFrame) -> DataFrame:
    """Risk index 0 to 100 with level, factors and explanation; its parts stay as columns."""
    require_columns(df, ("abnormality_level", "max_frp", "active_days", "persistence_category", "max_bright_ti4", "bt_diff_max", "false_alarm_indicator"), "columns for risk calculation")
    out = df.withColumns(risk_parts())
    base = C("abnormality_points") + C("frp_points") + C("persistence_points") + C("intensity_points")
    out = out.withColumn("risk_score", rounded(F.least(F.lit(100.0), F.greatest(F.lit(0.0), base * C("reliability_multiplier"))), 1))
    level = F.when(C("risk_score") >= 60, "HIGH").when(C("risk_score") >= 30, "MEDIUM").otherwise("LOW")
    factors = listed(
        F.when(C("abnormality_level") == "HIGH", "High statistical abnormality").when(C("abnormality_level") == "ELEVATED", "Elevated statistical abnormality"),
        F.when(C("max_frp") >= 20, "Strong thermal power (FRP >= 20 MW)").when(C("max_frp") >= 10, "Elevated thermal power (FRP >= 10 MW)"),
        F.when(C("persistence_points") == 20, "Persistent multi-day activity").when(C("persistence_points") == 12, "Recurring thermal activity"),
        F.when(C("intensity_points") == 20, "Peak thermal intensity / contrast"),
        F.when(C("false_alarm_indicator") == "HIGH", "High false-alarm concern penalty applied").when(C("false_alarm_indicator") == "LOW", "High evidence reliability"),
    )
    out = out.withColumns({"risk_level": level, "risk_factors": F.when(factors != "", factors).otherwise("Standard thermal baseline")})
    at = F.concat(F.lit(" risk index ("), fixed(C("risk_score"), 1), F.lit("/100) "))
    text = (
        F.when(C("risk_level") == "HIGH", F.concat(F.lit("High"), at, F.lit("driven by strong thermal evidence and statistical abnormality ("), C("risk_factors"), F.lit("). Ranked for priority inspection.")))
        .when(C("risk_level") == "MEDIUM", F.concat(F.lit("Moderate"), at, F.lit("based on localized thermal activity or moderated evidence reliability.")))
        .otherwise(F.concat(F.lit("Low"), at, F.lit("representing routine thermal baseline or weak unverified single-detection evidence.")))
    )
    return out.withColumn("risk_explanation", text)


def risk_evidence(df: DataFrame) -> Column:
    """The parts of a risk score as a nested value that adds up to it."""
    part = lambda key, label, most: F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), C(f"{key}_points").alias("points"), F.lit(float(most)).alias("max_points"))
    parts = F.array(part("abnormality", "Thermal Abnormality", 35), part("frp", "FRP Intensity", 25), part("persistence", "Persistence", 20), part("intensity", "Thermal Intensity / Contrast", 20))
    base = C("abnormality_points") + C("frp_points") + C("persistence_points") + C("intensity_points")
    return F.struct(parts.alias("components"), C("reliability_multiplier"), C("false_alarm_indicator").alias("false_alarm_concern"), base.alias("base_score"), C("risk_score").alias("final_score"))


def classified(df: DataFrame, least: float = 0.40) -> DataFrame:
    """Source context by added evidence for industry, farming and forest, with guard rules and the largest of 0.40 or more.

    Optional columns (facility_type, facility_km, land_cover, image_class, image_confidence) count as unknown if absent.
    """
    for name, kind in (("facility_type", "string"), ("facility_km", "double"), ("land_cover", "string"), ("image_class", "string"), ("image_confidence", "double")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    no = F.lit(False)
    is_ = lambda x: F.coalesce(x, no)
    days, km, status, cat = C("active_days"), F.coalesce("total_movement_distance_km", F.lit(0.0)), F.coalesce("movement_status", F.lit("INSUFFICIENT_DATA")), C("persistence_category")
    sure = F.coalesce("image_confidence", F.lit(0.0)) >= 0.5
    contrast = is_((C("bt_diff_max") >= 35) | (C("max_bright_ti4") >= 340))
    near = is_((C("facility_km") <= 2.0) & ~F.lower("facility_type").isin("none", "unknown", ""))
    land = F.lower(F.coalesce("land_cover", F.lit("unknown")))
    seen = F.coalesce("image_class", F.lit("UNKNOWN"))
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    industry = clip(
        points((is_((cat == "persistent") | (days >= 4)), 0.30), (is_((cat == "short_lived_repeated") | (days >= 2)), 0.15)) + points((is_((status == "STATIONARY") | ((days >= 2) & (km < 0.5))), 0.25))
        + points((contrast, 0.20)) + points((near, 0.25)) + points((land.isin("built-up", "industrial", "urban"), 0.20)) + points(((seen == "Industrial") & sure, 0.20))
    )
    farming = clip(
        points((is_((cat == "isolated") | (days <= 2)), 0.35)) + points((is_((km >= 0.05) & (km < 1.0) & (status != "MOVING")), 0.20)) + points((is_((C("max_frp") >= 5) & (C("max_frp") < 25)), 0.20))
        + points((land.isin("cropland", "agriculture", "farmland"), 0.30)) + points((seen.isin("AnnualCrop", "PermanentCrop", "Pasture") & sure, 0.20)) + points((near, -0.15))
    )
    forest = clip(
        points((is_((status == "MOVING") | (km >= 0.5)), 0.40)) + points((is_(C("max_frp") >= 20), 0.25)) + points((is_((days >= 2) & (cat != "persistent")), 0.15))
        + points((land.isin("tree_cover", "forest", "shrubland"), 0.30)) + points((seen.isin("Forest", "HerbaceousVegetation") & sure, 0.20)) + points((near, -0.20))
    )
    out = df.withColumns({"industrial_score": industry, "agricultural_score": farming, "forest_score": forest})
    guard = (near & (C("industrial_score") >= least) & ((status == "MOVING") | ((days == 1) & ~contrast))) | ((seen == "Industrial") & (status == "MOVING"))
    out = out.withColumn("industrial_score", F.when(is_(guard), F.least(C("industrial_score"), F.lit(0.35))).otherwise(C("industrial_score")))
    i, a, f = C("industrial_score"), C("agricultural_score"), C("forest_score")
    best1 = F.when(i >= least, rounded(i, 2)).otherwise(0.0)
    a_wins = (a >= least) & (a > best1)
    best2 = F.when(a_wins, rounded(a, 2)).otherwise(best1)
    f_wins = (f >= least) & (f > best2)
    label = F.when(f_wins, "Forest/Natural-context thermal event").when(a_wins, "Agricultural-context thermal event").when(i >= least, "Industrial-context thermal event").otherwise("Unknown / Insufficient Evidence")
    return out.withColumns({"classification_label": label, "classification_score": F.when(f_wins, rounded(f, 2)).otherwise(best2)})


def thermal_alerts(df: DataFrame) -> DataFrame:
    """Decision-support alerts: evidence, severity, suppression, ordered reasons and rationale. Never a confirmed fire."""
    fa, rel = F.upper(clean(C("false_alarm_indicator"))), F.upper(clean(C("detection_reliability")))
    out = df.withColumns({"fa": fa, "rel": rel, "score": F.coalesce("risk_score", F.lit(0.0))})
    fa, rel, score = C("fa"), C("rel"), C("score")
    evidence = F.when(C("risk_score").isNull() | ~fa.isin("LOW", "MEDIUM", "HIGH"), "INSUFFICIENT").when((fa == "LOW") & (rel == "HIGH"), "HIGH").when((fa == "MEDIUM") | (rel == "MEDIUM"), "MODERATE").when((fa == "HIGH") | (rel == "LOW"), "LOW").otherwise("MODERATE")
    base = F.when((C("risk_level") == "HIGH") & (score >= 85) & (fa == "LOW") & (rel == "HIGH"), "CRITICAL").when(score >= 60, "HIGH").when(score >= 30, "MEDIUM").otherwise("LOW")
    out = out.withColumns({"evidence_confidence": evidence, "base": base})
    hushed = (fa == "HIGH") & C("evidence_confidence").isin("LOW", "INSUFFICIENT")
    capped = (fa == "HIGH") & C("base").isin("CRITICAL", "HIGH")
    out = out.withColumns({"suppressed": hushed, "capped": capped, "severity": F.when(hushed, "LOW").when(capped, "MEDIUM").otherwise(C("base"))})
    cat, days = F.coalesce("persistence_category", F.lit("isolated")), F.coalesce("active_days", F.lit(1))
    many = cat.isin("persistent", "short_lived_repeated") | (days >= 2)
    cls = F.lower(F.coalesce("classification_label", F.lit("")))
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    station = F.coalesce(C("station_km").isNotNull(), F.lit(False))
    reasons = F.filter(
        F.array(
            F.when(C("risk_score").isNotNull() & (score >= 30), text("Risk score ", fixed(score, 1), "/100 (", C("severity"), " risk)")),
            F.when(fa == "LOW", "Low false-alarm concern").when(fa == "HIGH", "High false-alarm concern"), F.when(rel == "HIGH", "High evidence reliability"),
            F.when(many & ((cat == "persistent") | (days >= 4)), text("Persistent multi-day thermal activity (", days.cast("string"), " active days)"))
            .when(many, text("Recurring thermal activity (", days.cast("string"), " active days)")).when(C("observation_count") == 1, "Single observation (no temporal recurrence)"),
            F.when(C("max_frp") >= 20, text("Strong thermal power (FRP ", fixed(C("max_frp"), 1), " MW)")).when(C("max_frp") >= 10, text("Elevated thermal power (FRP ", fixed(C("max_frp"), 1), " MW)")),
            F.when((C("max_bright_ti4") >= 340) | (C("bt_diff_max") >= 45), "Peak thermal intensity / high spectral contrast"),
            F.when(cls.contains("industrial"), text("Industrial context detected (score ", fixed(C("classification_score"), 2), ")")).when(cls.contains("agricultural"), "Agricultural-context event").when(cls.contains("forest"), "Forest/Natural-context event"),
            F.when(C("direction").isNotNull(), text("Thermal activity movement ", C("direction"), " (confidence ", C("direction_confidence"), ")")),
            F.when(station, text("Verified fire station nearby: ", C("station_name"), " (", fixed(C("station_km"), 1), " km)")),
            F.when(C("suppressed"), "Suppressed for monitoring (high false-alarm concern, weak evidence)"), F.when(C("capped"), "Downgraded: high false-alarm concern caps severity at MEDIUM"),
        ),
        lambda x: x.isNotNull(),
    )
    out = out.withColumn("reasons", F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("Routine thermal baseline / informational monitoring"))
    note = F.when(C("capped"), "Downgraded: high false-alarm concern caps severity at MEDIUM. ").otherwise("")
    out = out.withColumn("alert_rationale", F.concat(F.lit("Decision-support thermal anomaly alert. "), note, C("reasons"), F.lit(". Does not constitute a confirmed fire declaration.")))
    return out.withColumns({"alert_id": F.concat(F.lit("TAL-"), F.when(F.length(C("cluster_id").cast("string")) < 5, F.lpad(C("cluster_id").cast("string"), 5, "0")).otherwise(C("cluster_id").cast("string"))), "status": F.lit("ACTIVE")}).drop("fa", "rel", "score", "base")


def operational_alerts(df: DataFrame) -> DataFrame:
    """Priority and recommended action for each cluster; a station is named only if one was found."""
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    ref = text(" Closest verified fire station: ", C("station_name"), " (", fixed(C("station_km"), 1), " km away).")
    none = "; no verified fire station identified within the search radius -- nearest district fire service should be contacted"
    place = F.when(C("station_km").isNotNull(), ref).otherwise(none)
    high, low_fa, high_fa = C("risk_level") == "HIGH", C("false_alarm_indicator") == "LOW", C("false_alarm_indicator") == "HIGH"
    return df.withColumns(
        {
            "alert_priority": F.when(high & low_fa, "HIGH PRIORITY ALERT").when(high & high_fa, "REVIEW / VERIFICATION").when(high | (C("risk_level") == "MEDIUM"), "MONITOR / REVIEW").otherwise("NO ALERT"),
            "recommended_action": F.when(high & low_fa, F.concat(F.lit("Dispatch priority ground verification unit from the nearest operational fire service."), place))
            .when(high & high_fa, "Perform remote verification before ground deployment.").when(high | (C("risk_level") == "MEDIUM"), F.concat(F.lit("Monitor thermal activity for escalation."), place)).otherwise("Routine baseline monitoring."),
        }
    )


def eligibility(df: DataFrame) -> DataFrame:
    """Whether an alert may be sent, by the first rule that forbids it."""
    reason = (
        F.when(~C("severity").isin("CRITICAL", "HIGH"), "Unsupported alert severity for prototype notification.").when(C("suppressed"), "Suppressed alerts cannot send prototype notifications.")
        .when(C("status") == "RESOLVED", "Resolved alerts cannot send prototype notifications.").when(C("false_alarm_indicator") == "HIGH", "High false-alarm-concern events require verification before notification.")
        .when(C("false_alarm_indicator") != "LOW", "Prototype notification requires LOW false-alarm concern.").when(C("evidence_confidence") != "HIGH", "Prototype notification requires HIGH evidence confidence.")
        .when(C("station_km").isNull(), "No verified fire station found within 50 km.").otherwise("Eligible for operator-confirmed prototype decision-support notification.")
    )
    return df.withColumn("eligibility_reason", reason).withColumn("notification_eligible", C("eligibility_reason").startswith("Eligible"))
