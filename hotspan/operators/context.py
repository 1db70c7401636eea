"""Season, cloud, weather, gaps in time series and uncertainty: adjustments around the rule engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import rounded

C = F.col
#: Fixed values: (region, lat from, lat to, lon from, lon to, farm burning months, forest fire months); the first box that fits counts.
SEASONS = (
    ("north_india", 28, 35, 73, 80, (10, 11), (3, 4, 5)),
    ("central_india", 20, 28, 73, 82, (3, 4), (2, 3, 4, 5)),
    ("eastern_india", 20, 27, 82, 90, (4, 5), (2, 3, 4)),
    ("south_india", 8, 20, 73, 82, (3, 4), (2, 3, 4)),
    ("western_india", 22, 30, 68, 75, (5, 6), (3, 4, 5)),
    ("northeast_india", 22, 29, 89, 98, (2, 3), (1, 2, 3, 4)),
)
#: What a seasonal report recommends, and the cover from which a day counts as cloudy.
NO_SEASON = "No regional season data available"
FARM_ADVICE = "High detection count during agricultural burning season - expect increased agricultural fire classifications"
FOREST_ADVICE = "Active fire detections during forest fire season - monitor for potential wildfire escalation"
HIGH_CLOUD = 70
#: Warnings about a filled series.
TOO_SHORT, HIGH_RATIO, LARGE_GAP = "Insufficient data for interpolation", "High interpolation ratio: %s/%s points interpolated", "Large gap between %s and %s (%s days)"
#: How much of the infrared signal passes a kind of cloud.
PENETRATION = {"clear": 1.0, "cirrus": 0.7, "cumulus": 0.5, "stratus": 0.2, "cumulonimbus": 0.1, "unknown": 0.5}


def first(*cases: tuple[Column, object], otherwise: object = None) -> Column:
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def with_season(df: DataFrame, day: str = "first_detection") -> DataFrame:
    """Region and whether the day lies in its farm burning or forest fire season; NULL outside all regions."""
    box = lambda s: C("latitude").between(s[1], s[2]) & C("longitude").between(s[3], s[4])
    month = F.month(day)
    return df.withColumns({"season_region": first(*[(box(s), s[0]) for s in SEASONS]), "farm_season": first(*[(box(s), month.isin(*s[5])) for s in SEASONS]), "forest_season": first(*[(box(s), month.isin(*s[6])) for s in SEASONS])})


def seasonal_report(detections: DataFrame) -> DataFrame:
    """Per region and month: detections, the region's seasons of that month, its detections in all and its recommendations.

    A region has `many_in_farm_season` where some month of farm burning has over 5 detections, and `any_in_forest_season`
    where some month of forest fires has one. Detections outside all regions are one row of region `Unknown` without a
    month; those without a day count in no month.
    """
    x = with_season(detections, "acq_date").withColumn("month", F.when(C("season_region").isNotNull(), F.month("acq_date")))
    monthly = x.groupBy(F.coalesce("season_region", F.lit("Unknown")).alias("region"), "month").agg(F.count("*").alias("detection_count"), F.first("farm_season").alias("is_agricultural_burning_season"), F.first("forest_season").alias("is_forest_fire_season"))
    region = Window.partitionBy("region")  # thirteen rows at most
    n, farm, forest = C("detection_count"), C("is_agricultural_burning_season"), C("is_forest_fire_season")
    many = F.coalesce(F.max(farm & (n > 5)).over(region), F.lit(False))
    some = F.coalesce(F.max(forest & (n > 0)).over(region), F.lit(False))
    out = monthly.withColumns({"total_detections": F.sum(n).over(region), "many_in_farm_season": many, "any_in_forest_season": some})
    told = F.when(C("region") == "Unknown", NO_SEASON).otherwise(F.concat_ws(" | ", F.when(C("many_in_farm_season"), FARM_ADVICE), F.when(C("any_in_forest_season"), FOREST_ADVICE)))
    return out.where("month is not null or region = 'Unknown'").withColumn("recommendations", told)


def cloud_days(days: DataFrame, clouds: DataFrame) -> DataFrame:
    """Per day of `clouds` (acq_date, cloud_cover): whether `days` (acq_date) has it, and whether clouds over 70 per cent likely hide it."""
    seen = days.select("acq_date").distinct().withColumn("has_detection", F.lit(True))
    out = clouds.select("acq_date", F.coalesce("cloud_cover", F.lit(50.0)).alias("cloud_cover")).join(seen, "acq_date", "left").withColumn("has_detection", F.coalesce("has_detection", F.lit(False)))
    return out.withColumn("cloud_obscuration_likely", (C("cloud_cover") > HIGH_CLOUD) & ~C("has_detection"))


def cloud_correlation(detections: DataFrame, clouds: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Per `key`: days of `clouds` in all, days with detections, days of high (over 70 per cent) and of low cloud, and days of high cloud without a detection.

    The days of high cloud are counted once; only those that a key has detections on are joined, never all days of all keys.
    """
    known = clouds.select("acq_date", (F.coalesce("cloud_cover", F.lit(50.0)) > HIGH_CLOUD).alias("high"))
    every = known.agg(F.count("*").alias("total_days_analyzed"), F.count_if("high").alias("high_cloud_days"))
    days = detections.select(key, "acq_date").distinct().join(known, "acq_date", "left")
    met = days.groupBy(key).agg(F.count("acq_date").alias("days_with_detections"), F.count_if("high").alias("seen"))
    x = met.join(F.broadcast(every))  # one row
    return x.select(key, "total_days_analyzed", "days_with_detections", "high_cloud_days", (C("total_days_analyzed") - C("high_cloud_days")).alias("low_cloud_days"), (C("high_cloud_days") - C("seen")).alias("potential_cloud_obscured_days"))


def seasonal(df: DataFrame) -> DataFrame:
    """Class and score adjusted by season, and a modifier of the risk; unchanged outside all regions."""
    out = with_season(df)
    cls, s, known = C("classification_label"), C("classification_score"), C("season_region").isNotNull()
    farm, forest, industry, unknown = (cls == x for x in ("Agricultural-context thermal event", "Forest/Natural-context thermal event", "Industrial-context thermal event", "Unknown / Insufficient Evidence"))
    still = F.coalesce(C("movement_status") == "STATIONARY", F.lit(False))
    as_farm = known & unknown & C("farm_season") & (C("max_frp") > 5) & ~still
    as_forest = known & unknown & C("forest_season") & (C("max_frp") > 15)
    up = lambda f: F.least(F.lit(1.0), s * f)
    score = first(
        (known & farm & C("farm_season"), up(1.2)), (known & farm, s * 0.8), (known & forest & C("forest_season"), up(1.15)), (known & forest, s * 0.85),
        (known & industry & still & (C("persistence_category") == "persistent"), up(1.1)), (as_farm, F.lit(0.5)), (as_forest, F.lit(0.45)), otherwise=s,
    )
    label = first((as_farm, F.lit("Agricultural-context thermal event")), (as_forest, F.lit("Forest/Natural-context thermal event")), otherwise=cls)
    modifier = first((known & farm & C("farm_season"), F.lit(0.75)), (known & farm, F.lit(1.2)), (known & forest & C("forest_season"), F.lit(1.0)), (known & forest, F.lit(1.3)), (known & industry, F.lit(1.15)), otherwise=F.lit(1.0))
    return out.withColumns({"seasonal_label": label, "seasonal_score": rounded(score, 4), "seasonal_risk_modifier": modifier})


def cloud_view(df: DataFrame, raw_confidence: Column | None = None) -> DataFrame:
    """Cloud probability, kind and adjusted confidence from an observation's own brightness temperatures."""
    a, b = C("bright_ti4"), C("bright_ti5")
    diff = a - b
    add = lambda cond, v: F.when(cond, v).otherwise(0.0)
    prob = F.least(add(a < 280, 0.3) + add(b < 270, 0.3) + add(diff < 15, 0.2) + add(diff < 5, 0.2), F.lit(1.0))
    kind = first(((diff > 15) & (a > 300), "clear"), ((diff > 25) & (a > 260), "cirrus"), ((diff < 10) & (a < 270), "cumulonimbus"), (diff < 10, "stratus"), (diff < 15, "cumulus"), otherwise="unknown")
    out = df.withColumns({"cloud_probability": prob, "cloud_type": kind})
    passes = first(*[(C("cloud_type") == k, v) for k, v in PENETRATION.items()], otherwise=0.5)
    rank = raw_confidence if raw_confidence is not None else first((C("confidence") == "l", 0.3), (C("confidence") == "n", 0.6), (C("confidence") == "h", 0.9))
    out = out.withColumns({"ir_penetration_factor": passes, "raw": rank})
    adjusted = rounded(F.greatest(F.lit(0.1), F.least(C("raw") * (1.0 - C("cloud_probability") * 0.5) * C("ir_penetration_factor"), F.lit(1.0))), 4)
    review = (C("cloud_probability") > 0.7) | (C("ir_penetration_factor") < 0.3) | ((C("raw") < 0.4) & (C("cloud_probability") > 0.3))
    return out.withColumns({"adjusted_confidence": adjusted, "cloud_review": review}).drop("raw")


def fire_weather(t: Column, humidity: Column, wind: Column, rain: Column) -> Column:
    """Fire-weather index 0 to 100."""
    clip = lambda x, lo, hi: F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x))
    return rounded(clip(clip((t - 10) * 1.5, 0, 30) + clip((100 - humidity) * 0.4, 0, 30) + clip(wind * 2.5, 0, 25) - clip(rain * 2, 0, 15), 0, 100), 2)


def daily_series(detections: DataFrame) -> DataFrame:
    """(cluster_id, day, value): the largest radiative power of each cluster's day."""
    return detections.groupBy("cluster_id", C("acq_date").alias("day")).agg(F.max("frp").alias("value"))


def gaps(series: DataFrame) -> DataFrame:
    """Stretches of missing days between two observed ones: the values around them and the number of days."""
    w = Window.partitionBy("cluster_id").orderBy("day")
    g = series.withColumns({"next_day": F.lead("day").over(w), "next_value": F.lead("value").over(w)})
    return g.withColumn("gap_days", F.date_diff("next_day", "day") - 1).where("gap_days > 0")


def interpolated(series: DataFrame, method: str = "linear", most: int = 3, clouds: DataFrame | None = None, cloudy: float = 70.0) -> DataFrame:
    """(cluster_id, day, value): values for the days of gaps of at most `most` days.

    linear: on the line between the values around; nearest: the earlier one for the days up to number n div 2 of n, counted from 0, then the later one;
    spline: the smooth step 3t^2 - 2t^3. With `clouds` (acq_date, cloud_cover) only gaps cloudy on all days are filled.
    """
    g = gaps(series).where(C("gap_days") <= most).withColumn("i", F.explode(F.expr("sequence(0, gap_days - 1)")))
    n, a, z = C("gap_days"), C("value"), C("next_value")
    t = (C("i") + 1) / (n + 1)
    value = {"linear": a + (z - a) * t, "nearest": F.when(C("i") <= F.floor(n / 2), a).otherwise(z), "spline": a + (z - a) * (t * t * 3.0 - t * t * t * 2.0)}[method]
    out = g.withColumns({"at": F.expr("date_add(day, i + 1)"), "filled": rounded(value, 6), "start": C("day")})
    if clouds is not None:
        c = out.join(clouds.select(C("acq_date").alias("at"), "cloud_cover"), "at", "left")
        dark = c.groupBy("cluster_id", "start").agg(F.bool_and(F.coalesce(C("cloud_cover") > cloudy, F.lit(False))).alias("dark")).where("dark").select("cluster_id", "start")
        out = out.join(dark.hint("merge"), ["cluster_id", "start"], "left_semi")
    return out.select("cluster_id", C("at").alias("day"), C("filled").alias("value"))


def interpolation_quality(series: DataFrame, most: int = 3, clouds: DataFrame | None = None, cloudy: float = 70.0) -> DataFrame:
    """Per cluster: n_original, n_interpolated, quality (0 to 1) and warnings of its series as `interpolated` fills it.

    Quality loses half of the share of filled days, and a tenth for each day of the longest gap, filled or not, up to
    0.3; it is rounded to three digits. With `clouds` it is multiplied by how cloudy the filled days are on average (a
    day without a record counts as 50 per cent): 1 over 70 per cent, 0.9 over 50, else 0.7; without filled days by 1.
    Warnings tell of over three tenths of filled days and of gaps of over two days, in their order; a series of fewer
    than two days has quality 1 and says that it is too short.
    """
    g = gaps(series).withColumn("end", F.expr("date_add(day, gap_days + 1)"))
    text = F.format_string(LARGE_GAP, C("day").cast("string"), C("end").cast("string"), C("gap_days").cast("string"))
    large = F.sort_array(F.collect_list(F.when(C("gap_days") > 2, F.struct("day", text.alias("t")))))
    longest = g.groupBy("cluster_id").agg(F.max("gap_days").alias("longest"), F.transform(large, lambda x: x["t"]).alias("large"))
    filled = interpolated(series, most=most, clouds=clouds, cloudy=cloudy)
    if clouds is not None:
        filled = filled.join(clouds.select(C("acq_date").alias("day"), "cloud_cover"), "day", "left").withColumn("cloud_cover", F.coalesce("cloud_cover", F.lit(50.0)))
    cover = F.avg("cloud_cover") if clouds is not None else F.lit(100.0)
    by = filled.groupBy("cluster_id").agg(F.count("*").alias("n_interpolated"), cover.alias("cover"))
    x = series.groupBy("cluster_id").agg(F.count("*").alias("n_original")).join(longest.hint("merge"), "cluster_id", "left").join(by.hint("merge"), "cluster_id", "left").fillna(0, ["n_interpolated", "longest"])
    total = C("n_original") + C("n_interpolated")
    share = C("n_interpolated") / total
    plain = F.greatest(F.lit(0.0), 1.0 - share * 0.5 - F.least(F.lit(0.3), C("longest") * 0.1))
    factor = F.when(C("cover").isNull() | (C("cover") > 70), 1.0).when(C("cover") > 50, 0.9).otherwise(0.7)
    high = F.when(share > 0.3, F.format_string(HIGH_RATIO, C("n_interpolated").cast("string"), total.cast("string")))
    told = F.array_compact(F.concat(F.array(high), F.coalesce("large", F.array().cast("array<string>"))))
    short = C("n_original") < 2
    return x.select("cluster_id", "n_original", "n_interpolated", F.when(short, 1.0).otherwise(rounded(plain, 3) * factor).alias("quality"), F.when(short, F.array(F.lit(TOO_SHORT))).otherwise(told).alias("warnings"))


def gap_reasons(series: DataFrame, clouds: DataFrame) -> DataFrame:
    """Every missing day of a cluster between its first and last, with a reason and a fill from the values around it.

    Above 70 per cent of cloud with an observation on the day before or after: cloud_obscured; under 30 real_gap; else
    uncertain. A day without a cloud record counts as 50 per cent.
    """
    span = series.groupBy("cluster_id").agg(F.min("day").alias("a"), F.max("day").alias("z"))
    days = span.select("cluster_id", F.explode(F.sequence("a", "z")).alias("day")).join(series, ["cluster_id", "day"], "left")
    w = Window.partitionBy("cluster_id").orderBy("day")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    d = days.withColumns({"beside": F.coalesce(F.lag("value").over(w), F.lead("value").over(w)).isNotNull(), "p": F.last("value", ignorenulls=True).over(before), "q": F.first("value", ignorenulls=True).over(after)})
    d = d.where("value is null").join(clouds.withColumnRenamed("acq_date", "day"), "day", "left").withColumn("cloud_cover", F.coalesce("cloud_cover", F.lit(50.0)))
    reason = first(((C("cloud_cover") > 70) & C("beside"), "cloud_obscured"), (C("cloud_cover") > 70, "uncertain"), (C("cloud_cover") < 30, "real_gap"), otherwise="uncertain")
    return d.select("cluster_id", "day", "cloud_cover", reason.alias("gap_type"), rounded((C("p") + C("q")) / 2.0, 6).alias("filled_value"))


def feature_noise(features: tuple[str, ...]) -> Column:
    """Of standardised features 0.3 times the share beyond 3 and 0.7 times the share missing; one half where there are none."""
    if not features:
        return F.lit(0.5)
    share = lambda test: sum((F.when(test(C(f)), 1).otherwise(0) for f in features), F.lit(0)) / float(len(features))
    missing = lambda f: f.isNull() | F.isnan(f.cast("double"))
    return share(lambda f: ~missing(f) & (F.abs(f) > 3.0)) * 0.3 + share(missing) * 0.7


def uncertainty(df: DataFrame, features: tuple[str, ...] = ()) -> DataFrame:
    """Uncertainty of class and risk with intervals and whether a person should look; `features` are standardised columns (`anomaly.standardised`).

    Needs classification_score, observation_count, completeness (share of days seen), cloud (share 0 to 1), risk and false-alarm columns.
    """
    s, n, cloud, full = C("classification_score"), C("observation_count"), C("cloud"), C("completeness")
    data = F.when(cloud > 0.5, (cloud - 0.5) * 0.8).otherwise(0.0) + F.when(n < 3, (3 - n) * 0.15).otherwise(0.0)
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    u = rounded(clip(data * 0.3 + (1.0 - s) * 0.3 + feature_noise(features) * 0.2 + (1.0 - full) * 0.2), 6)
    base = first((C("risk_level") == "HIGH", 0.2), (C("risk_level") == "MEDIUM", 0.4), otherwise=0.3)
    fa = first((C("false_alarm_indicator") == "HIGH", 0.4), (C("false_alarm_indicator") == "MEDIUM", 0.2), otherwise=0.0)
    seen = F.when(cloud > 0.5, 0.3).otherwise(0.0) + F.when(n < 3, 0.2).otherwise(0.0)
    r = rounded(clip(base * 0.3 + fa * 0.3 + seen * 0.2 + (1.0 - s) * 0.2), 6)
    out = df.withColumns({"uncertainty": u, "risk_uncertainty": r})
    u, r = C("uncertainty"), C("risk_uncertainty")
    review = (u > 0.6) | (s < 0.4) | ((u > 0.3) & (s < 0.6))
    risk_review = ((C("risk_level") == "HIGH") & ((r > 0.4) | (C("false_alarm_indicator") == "HIGH"))) | ((C("risk_level") == "MEDIUM") & (r > 0.5)) | (r > 0.6)
    return out.withColumns(
        {
            "ci_low": rounded(F.greatest(F.lit(0.0), s - u * 0.4), 3), "ci_high": rounded(F.least(F.lit(1.0), s + u * 0.4), 3), "needs_review": review,
            "risk_ci_low": rounded(F.greatest(F.lit(0.0), C("risk_score") - r * 20), 3), "risk_ci_high": rounded(F.least(F.lit(100.0), C("risk_score") + r * 20), 3), "risk_needs_review": risk_review,
        }
    )
