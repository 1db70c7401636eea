"""Named queries over what is told about clusters, and the state that runs hand on, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar
from ..operators import anomaly, reasoning, report
from ..sources import adapter
from . import master as m
from . import oracles as o
from .queries import Query, cycles
from .told import reasons_sql

C = F.col
STATUSES = ("Cloud obscured", "Search pending", "No network connection (retry)", "", "Classified", "Request timed out")
OUTCOMES = ("found", "not_found", "unavailable", "disabled", "missing_coords", "timeout", "http_error", "parse_error", "network_error")


def o4_generic_order(spark, d):
    """All clusters by their level, the highest first, then by id."""
    x = m.master(spark, d)
    return x.orderBy(*report.sort_keys(x, "abnormality_level", ascending=False), "cluster_id").select("cluster_id", "abnormality_level", report.level_order(C("abnormality_level")).alias("level_order"))


def d31_area_category(spark, d):
    """Kind of area of each cluster, told by its reasons as well."""
    return m.master(spark, d).select("cluster_id", report.area(rationale=reasoning.trimmed()).alias("a")).select("cluster_id", "a.type", "a.name", "a.description")


def d32_evidence(spark, d):
    """One row per cluster and kind of evidence, for and against it."""
    x = m.master(spark, d).select("cluster_id", F.explode(report.evidence()).alias("e"))
    return x.select("cluster_id", "e.side", "e.key", "e.label", "e.why")


def d26_attribution(spark, d):
    """What weighs most among a cluster's features, by size."""
    up, down, summary = report.attribution({k: C(k).cast("double") for k in anomaly.FEATURES})
    return m.master(spark, d).select("cluster_id", up.alias("positive"), down.alias("negative"), summary.alias("summary"))


def p14_json_safe(spark, d):
    """Rates of movement as JSON can hold them: those of no days are NaN or infinite before."""
    x = m.master(spark, d)
    none = F.when(C("observation_count") > 1, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    rate = F.when(C("duration_days") == 0, none).otherwise(scalar.rounded(C("total_movement_distance_km") / F.nullif(C("duration_days").cast("double"), F.lit(0.0)), 6))
    return scalar.json_safe(x.select("cluster_id", "direction", "facility_type", rate.alias("rate")), ("direction",))


def o7_places(spark, d):
    """Nations that each of three searches finds, by name or alias, the best first."""
    n = adapter.read(spark, d, "nation")
    x = n.withColumn("search", F.explode(F.array(*map(F.lit, (" Nation_1 ", "n1", "REGION")))))
    names = F.array(F.concat(F.lit("N"), C("n_nationkey").cast("string")), F.concat(F.lit("region "), C("n_regionkey").cast("string")))
    found = x.withColumn("relevance", report.relevance(C("n_name"), names, C("search"))).where("relevance is not null")
    w = Window.partitionBy("search").orderBy("relevance", "n_nationkey")
    return found.select("search", "n_name", "relevance", F.row_number().over(w).alias("place"))


def d27_incident_report(spark, d):
    station = F.when(C("station_km") > 0, F.concat(report.text("station_km", 2), F.lit(" km"))).otherwise(report.NONE)
    near = F.when((C("facility_type") != "") & C("facility_km").isNotNull(), F.concat("facility_type", F.lit(" ("), report.text("facility_km", 2), F.lit(" km away)"))).otherwise("No industrial facility identified in close proximity.")
    return m.alerts(spark, d).select(
        "cluster_id", "severity", "first_detection", "last_detection", station.alias("station_distance"), near.alias("industrial_context"),
        report.given(C("direction"), default=report.NONE).alias("direction"), report.why_flagged().alias("why_flagged"), F.array_join(report.recommended_actions(), " | ").alias("actions"),
    )


def d35_message(spark, d):
    return m.alerts(spark, d).select("alert_id", report.message().alias("message"), F.array_join(report.placeholders(), "|").alias("placeholders"))


def d39_bootstrap(spark, d):
    """The registry of known clusters rebuilt from their detections, with the largest id given so far."""
    g = m.clustered(spark, d).groupBy("cluster_id")
    each = g.agg(scalar.mean3(C("latitude")).alias("centroid_lat"), scalar.mean3(C("longitude")).alias("centroid_lon"), F.max("acq_date").alias("last_seen"), F.count("*").alias("observation_count"))
    return each.crossJoin(F.broadcast(each.agg(F.max("cluster_id").alias("max_ever_cluster_id"))))


def d40_formats(spark, d):
    x = m.master(spark, d)
    km = F.concat(report.text("total_movement_distance_km", 2), F.lit(" km"))
    return x.select("cluster_id", report.coordinates(C("latitude"), C("longitude")).alias("position"), F.date_format("first_detection", "MMM d, yyyy").alias("first_seen"), km.alias("moved"))


def tags(spark, d):
    """Elements of a map with the tags of part's columns; some are blank, some missing."""
    word = lambda k: f"case p_partkey % {k} when 0 then '' when 1 then null else concat('t{k}_', p_size) end"
    pairs = ", ".join(f"'{t}', {word(k)}" for t, k in (("industrial", 2), ("man_made", 3), ("power", 5), ("landuse", 7), ("city", 4), ("suburb", 6), ("county", 8), ("state", 9)))
    return adapter.read(spark, d, "part").selectExpr("p_partkey as element_id", f"map({pairs}) as tags", "cast(p_size as double) / 8 as lat", "-cast(p_partkey % 360 as double) / 4 as lon")


def d41_facility_kind(spark, d):
    return tags(spark, d).select("element_id", report.facility_kind(C("tags")).alias("facility"))


def d34_location_header(spark, d):
    return tags(spark, d).select("element_id", report.location_header(C("tags"), C("lat"), C("lon")).alias("header"))


def d42_query_status(spark, d):
    """Queries of a map by outcome; only an answered one says whether something is there."""
    x = adapter.read(spark, d, "part").select(F.element_at(F.array(*map(F.lit, OUTCOMES)), (C("p_partkey") % len(OUTCOMES) + 1).cast("int")).alias("status"))
    answered = C("status").isin("found", "not_found")
    return x.groupBy("status").agg(F.count("*").alias("n")).select("status", "n", answered.alias("answered"), (~answered & ~C("status").isin("disabled", "missing_coords")).alias("retry"))


def d43_patch_quality(spark, d):
    """Image patches, one per user, that are empty, black or flat."""
    p = adapter.read(spark, d, "events").selectExpr("user_id as patch_id", "case when user_id % 5 = 0 then 0 when user_id % 5 = 1 then 100 else event_id * 37 % 256 end as v")
    g = p.groupBy("patch_id").agg(F.count("*").alias("n"), F.count_if(C("v") == 0).alias("zeros"), F.sum("v").alias("s"), F.sum(C("v") * C("v")).alias("q"))
    return g.select("patch_id", "n", report.unusable_patch(C("n"), C("zeros"), C("s"), C("q")).alias("rejected"))


def d38_pass_statistics(spark, d):
    """Mean, variance and the 5 to 95 % range over repeated passes, here the events of one kind and day."""
    x = adapter.read(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), F.rint(C("value") * 100.0).cast("long").alias("v"))
    g = x.groupBy("event_type", "day").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(C("v") * C("v")).alias("q"), F.percentile("v", 0.05).alias("lo"), F.percentile("v", 0.95).alias("hi"))
    spread = (C("n") * C("q") - C("s") * C("s")).cast("double") / (C("n") * C("n")).cast("double")
    return g.select("event_type", "day", "n", scalar.rounded(C("s").cast("double") / C("n"), 3).alias("mean"), scalar.rounded(spread, 3).alias("variance"), scalar.rounded(C("lo"), 3).alias("p5"), scalar.rounded(C("hi"), 3).alias("p95"))


def p19_settled(spark, d):
    """Results that a resumed run keeps."""
    x = adapter.read(spark, d, "part").select(C("p_partkey").alias("cluster_id"), F.element_at(F.array(*map(F.lit, STATUSES)), (C("p_partkey") % len(STATUSES) + 1).cast("int")).alias("status"))
    return x.where(report.settled(C("status")))


def j15_first_given(spark, d):
    """Of an alert and its cluster the first value that is not blank."""
    a = m.alerts(spark, d).select("cluster_id", F.when(C("cluster_id") % 3 == 0, C("severity")).when(C("cluster_id") % 3 == 1, F.lit(" ")).alias("severity"))
    e = m.master(spark, d).select("cluster_id", F.when(C("cluster_id") % 2 == 0, C("risk_level")).alias("risk_level"))
    return e.join(a, "cluster_id", "left").select("cluster_id", report.given(C("severity"), C("risk_level"), default="LOW").alias("severity"))


def u2_history(spark, d):
    """Two runs' alerts one after the other, counted by run and severity."""
    old, new = cycles(spark, d)
    rows = old.select(F.lit(1).alias("run"), "cluster_id", "severity").unionByName(new.select(F.lit(2).alias("run"), "cluster_id", "severity"))
    return rows.groupBy("run", "severity").agg(F.count("*").alias("n"))


def u6_heads(spark, d):
    """Two clusters each of high and of low false-alarm concern."""
    x = m.assessed(spark, d).select("cluster_id", "false_alarm_indicator")
    head = lambda level: x.where(C("false_alarm_indicator") == level).orderBy("cluster_id").limit(2)
    return head("HIGH").unionByName(head("LOW"))


def s14_geocode_cache(spark, d):
    """Clusters and the places that a cache knows by their rounded position."""
    key = F.concat(report.text("latitude", 4), F.lit(","), report.text("longitude", 4)).alias("key")
    x = m.master(spark, d).select("cluster_id", key, "land_cover")
    cache = x.where("cluster_id % 3 = 0").groupBy("key").agg(F.min("land_cover").alias("place"))
    return x.join(cache, "key", "left").select("cluster_id", "key", "place", C("place").isNotNull().alias("hit"))


def r6_run_status(spark, d):
    """Days as runs, kinds of events as products, of which one fails on some days."""
    g = adapter.read(spark, d, "events").groupBy(F.to_date("ts").alias("day"), C("event_type").alias("product")).agg(F.count("*").alias("n"))
    return report.run_status(g.withColumn("error", F.when((C("n") + F.dayofmonth("day")) % 3 == 0, F.concat(F.lit("lost "), C("n").cast("string")))), "day")


def api_health(spark, d):
    """What the service holds."""
    w = m.master(spark, d).agg(F.count("*").alias("clusters"), F.max("last_detection").alias("latest"))
    return w.crossJoin(m.alerts(spark, d).agg(F.count("*").alias("alerts"))).withColumn("status", F.when(C("clusters") > 0, "ok").otherwise("empty"))


def k2_versions(spark, d):
    """Of rows written in several versions the last two of each key, the newest first."""
    x = adapter.read(spark, d, "events").select(C("user_id").alias("key"), C("event_id").alias("version"))
    w = Window.partitionBy("key").orderBy(F.desc("version"))
    return x.withColumn("generation", F.row_number().over(w)).where("generation <= 2")


def queries() -> dict[str, Query]:
    made = (o4_generic_order, d26_attribution, d27_incident_report, d31_area_category, d32_evidence, p14_json_safe, o7_places, d34_location_header, d35_message, d38_pass_statistics, d39_bootstrap, d40_formats, d41_facility_kind, d42_query_status, d43_patch_quality, p19_settled, j15_first_given, u2_history, u6_heads, s14_geocode_cache, r6_run_status, api_health, k2_versions)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    q = lambda s: "'" + s + "'"
    pick = lambda values, by: f"([{', '.join(map(q, values))}])[{by} % {len(values)} + 1]"
    has = lambda c, words: " OR ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for w in words)
    words = lambda some: " OR ".join(has({"rationale": "why"}.get(c, c), w) for c, w in some.items())
    area = lambda k: "CASE " + " ".join(f"WHEN {words(a[3])} THEN '{a[k]}'" for a in report.AREAS) + f" ELSE '{report.ELSEWHERE[k]}' END"
    frp, ti4, diff, risk = (o.fixed(c, 1) for c in ("max_frp", "max_bright_ti4", "bt_diff_max", "risk_score"))
    zero = lambda c: o.fixed(f"coalesce({c}, 0.0)", 1)
    evidence = (
        ("supporting", "intensity", "'High thermal intensity'", "max_bright_ti4 >= 340 OR bt_diff_max >= 45", f"'Peak brightness temperature ' || {zero('max_bright_ti4')} || ' K and/or spectral contrast ' || {zero('bt_diff_max')} || ' K exceed the anomaly-explainer thresholds.'"),
        ("supporting", "persistence", "'Persistent thermal activity'", "persistence_category = 'persistent' OR active_days >= 4", "'Activity spans ' || active_days || ' active day(s) with persistence category ' || chr(39) || persistence_category || chr(39) || '.'"),
        ("supporting", "frp", "'Elevated FRP'", "max_frp >= 15", f"'Peak Fire Radiative Power of ' || {frp} || ' MW meets the strong-FRP evidence threshold (>= 15 MW).'"),
        ("supporting", "abnormality", "abnormality_level || ' statistical abnormality'", "abnormality_level IN ('HIGH', 'ELEVATED')", "'The event was flagged ' || abnormality_level || ' relative to the analyzed thermal baseline.'"),
        ("supporting", "reliability", "'High detection reliability'", "detection_reliability = 'HIGH'", "'The false-alarm detector assigned HIGH detection reliability to this cluster.'"),
        ("supporting", "context", "'Strong contextual evidence'", "classification_score >= 0.6 AND NOT contains(classification_label, 'Unknown')", "'The source-classification model assigned a confidence of ' || round_even(classification_score * 100, 0)::INT || '% (' || classification_label || ').'"),
        ("limiting", "satellite", "'Limited satellite imagery'", "TRUE", "'No usable Sentinel-2 observation: imagery is unavailable or cloud-obscured. This is not negative evidence.'"),
        ("limiting", "fa", "'High false-alarm concern'", "false_alarm_indicator = 'HIGH'", "'The false-alarm detector flagged weak or single-pass evidence. HIGH concern is not a confirmed false alarm.'"),
        ("limiting", "movement", "'Insufficient movement observations'", "movement_status = 'INSUFFICIENT_DATA'", "'Too few satellite passes to infer a defensible direction for the detected thermal activity.'"),
        ("limiting", "station", "'No nearby fire station'", "station_km IS NULL", "'No verified fire station was found within the operational search radius.'"),
    )
    long = " UNION ALL ".join(f"SELECT cluster_id, '{k}' AS name, {k}::DOUBLE AS v FROM master" for k in anomaly.FEATURES)
    told = f"name || ' (' || {o.fixed('v', 3)} || ')'"
    listed = lambda sign, n: f"string_agg({told}, ', ' ORDER BY n) FILTER (v {sign} 0 AND n <= {n})"
    acts = " ".join(f"WHEN '{k}' THEN '{' | '.join(v)}'" for k, v in report.ACTIONS.items() if k)
    factors = f"""concat_ws(', ', CASE WHEN persistence_category IN ('multi_day', 'persistent', 'recurrent') THEN 'persistent thermal activity over multiple satellite passes' ELSE 'localized thermal anomaly detection' END,
        CASE WHEN max_frp > 20 THEN 'elevated Fire Radiative Power (FRP ' || {frp} || ' MW)' WHEN max_frp > 5 THEN 'moderate Fire Radiative Power (FRP ' || {frp} || ' MW)' END,
        CASE WHEN classification_label NOT IN ('Unknown', 'Not available') THEN 'supporting geospatial context (' || classification_label || ')' END, CASE WHEN false_alarm_indicator = 'LOW' THEN 'low false-alarm indicator score' END)"""
    values = ["severity", "cluster_id::VARCHAR", "round_even(risk_score, 0)::BIGINT::VARCHAR", f"{o.fixed('latitude', 5)} || ',' || {o.fixed('longitude', 5)}", "classification_label", "evidence_confidence", "observation_count::VARCHAR", "active_days::VARCHAR", "coalesce(nullif(trim(station_name), ''), 'Verified fire station')", f"coalesce({o.fixed('station_km', 1)}, '0.0')"]
    names = ("Decision-support alert. Severity ", "; cluster ", "; risk ", "/100; coordinates ", "; classification ", "; evidence ", "; detections ", ", active days ", ". Nearest verified fire station: ", " (")
    message = " || ".join(f"'{n}' || {v}" for n, v in zip(names, values, strict=True)) + " || ' km). Advisory thermal anomaly information only; not a confirmed fire or official dispatch.'"
    tag = lambda k: f"CASE p_partkey % {k} WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 't{k}_' || p_size END"
    lat, lon = o.fixed("p_size::DOUBLE / 8", 4), o.fixed("-((p_partkey % 360)::DOUBLE / 4)", 4)
    header = f"concat_ws(', ', town, CASE WHEN county IS DISTINCT FROM town THEN county END, CASE WHEN state IS DISTINCT FROM town AND state IS DISTINCT FROM county THEN state END)"
    side = lambda c, plus, minus: f"{o.fixed(f'abs({c})', 3)} || CASE WHEN {c} >= 0 THEN '°{plus}' ELSE '°{minus}' END"
    settled = " AND ".join(f"NOT contains(lower(status), '{t}')" for t in report.TRANSIENT)
    levels = " ".join(f"WHEN '{k}' THEN {v}" for k, v in report.LEVEL_ORDER.items())
    return {
        "o4_generic_order": o.sql(f"SELECT cluster_id, abnormality_level, (CASE abnormality_level {levels} ELSE 0 END)::INT AS level_order FROM master ORDER BY 3 DESC, 2 DESC, 1", "master"),
        "d31_area_category": o.sql(f"SELECT cluster_id, {area(0)} AS type, {area(1)} AS name, {area(2)} AS description FROM (SELECT *, {reasons_sql()} AS why FROM master)", "master"),
        "d32_evidence": o.sql(" UNION ALL ".join(f"SELECT cluster_id, '{side}' AS side, '{k}' AS key, {name} AS label, {why} AS why FROM master WHERE {met}" for side, k, name, met, why in evidence), "master"),
        "p14_json_safe": o.sql(f"SELECT cluster_id, coalesce(direction, '') AS direction, facility_type, CASE WHEN duration_days <> 0 THEN {o.rnd('total_movement_distance_km / duration_days::DOUBLE', 6)} END AS rate FROM master", "master"),
        "o7_places": """SELECT search, n_name, relevance, row_number() OVER (PARTITION BY search ORDER BY relevance, n_nationkey)::INT AS place FROM (
            SELECT search, n_nationkey, n_name, CASE WHEN lower(n_name) = q THEN 0 WHEN 'n' || n_nationkey = q OR 'region ' || n_regionkey = q THEN 1 WHEN starts_with(lower(n_name), q) THEN 2 ELSE 3 END AS relevance
            FROM nation, (SELECT search, lower(trim(search)) AS q FROM (SELECT unnest([' Nation_1 ', 'n1', 'REGION']) AS search)) WHERE contains(lower(n_name), q) OR contains('n' || n_nationkey, q) OR contains('region ' || n_regionkey, q))""",
        "d26_attribution": o.sql(f"""SELECT cluster_id, coalesce(p5, '') AS positive, coalesce(m5, '') AS negative, concat_ws('; ', 'Top positive factors: ' || p3, 'Top negative factors: ' || m3, CASE WHEN t > 0 THEN 'Overall positive signal dominates' ELSE 'Overall negative signal dominates' END) AS summary
            FROM (SELECT cluster_id, {listed('>', 5)} AS p5, {listed('<', 5)} AS m5, {listed('>', 3)} AS p3, {listed('<', 3)} AS m3, sum(round_even(v * 1000.0::DOUBLE, 0)::BIGINT) AS t FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, sign(v) ORDER BY abs(v) DESC, name) AS n FROM ({long})) GROUP BY 1)""", "master"),
        "d27_incident_report": o.sql(f"""SELECT cluster_id, severity, first_detection, last_detection, CASE WHEN station_km > 0 THEN {o.fixed('station_km', 2)} || ' km' ELSE 'Not available' END AS station_distance,
            CASE WHEN facility_type <> '' AND facility_km IS NOT NULL THEN facility_type || ' (' || {o.fixed('facility_km', 2)} || ' km away)' ELSE 'No industrial facility identified in close proximity.' END AS industrial_context, coalesce(nullif(trim(direction), ''), 'Not available') AS direction,
            'Cluster flagged at ' || severity || ' level (Risk Score ' || {risk} || '/100) because the anomaly exhibits ' || {factors} || ' across ' || observation_count || ' satellite observations.' AS why_flagged, CASE severity {acts} ELSE '{' | '.join(report.ACTIONS[''])}' END AS actions FROM alerts""", "alerts"),
        "d35_message": o.sql(f"SELECT alert_id, {message} AS message, concat_ws('|', {', '.join(values)}) AS placeholders FROM alerts", "alerts"),
        "d39_bootstrap": o.sql(f"SELECT cluster_id, {o.mean3('latitude')} AS centroid_lat, {o.mean3('longitude')} AS centroid_lon, max(acq_date) AS last_seen, count(*) AS observation_count, (SELECT max(cluster_id) FROM cd) AS max_ever_cluster_id FROM cd GROUP BY 1", "cd"),
        "d40_formats": o.sql(f"SELECT cluster_id, {side('latitude', 'N', 'S')} || ', ' || {side('longitude', 'E', 'W')} AS position, strftime(first_detection, '%b %-d, %Y') AS first_seen, {o.fixed('total_movement_distance_km', 2)} || ' km' AS moved FROM master", "master"),
        "d41_facility_kind": f"SELECT p_partkey AS element_id, coalesce({tag(2)}, {tag(3)}, {tag(5)}, {tag(7)}, 'industrial') AS facility FROM part",
        "d34_location_header": f"SELECT element_id, CASE WHEN {header} = '' THEN place ELSE {header} END AS header FROM (SELECT p_partkey AS element_id, coalesce({tag(4)}, {tag(6)}) AS town, {tag(8)} AS county, {tag(9)} AS state, 'Coordinates: ' || {lat} || ', ' || {lon} AS place FROM part)",
        "d42_query_status": f"SELECT status, count(*) AS n, status IN ('found', 'not_found') AS answered, status NOT IN ('found', 'not_found', 'disabled', 'missing_coords') AS retry FROM (SELECT {pick(OUTCOMES, 'p_partkey')} AS status FROM part) GROUP BY 1",
        "d43_patch_quality": "SELECT patch_id, count(*) AS n, avg((v = 0)::INT) > 0.95 OR count(*) * sum(v * v) - sum(v) * sum(v) < count(*) * count(*) AS rejected FROM (SELECT user_id AS patch_id, CASE user_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 100 ELSE event_id * 37 % 256 END AS v FROM events) GROUP BY 1",
        "d38_pass_statistics": f"SELECT event_type, day, n, {o.rnd('s::DOUBLE / n', 3)} AS mean, {o.rnd('(n * q - s * s)::DOUBLE / (n * n)::DOUBLE', 3)} AS variance, {o.rnd('lo', 3)} AS p5, {o.rnd('hi', 3)} AS p95 FROM (SELECT event_type, ts::DATE AS day, count(*) AS n, sum(v)::BIGINT AS s, sum(v * v)::BIGINT AS q, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM (SELECT *, round_even(value * 100.0::DOUBLE, 0)::BIGINT AS v FROM events) GROUP BY 1, 2)",
        "p19_settled": f"SELECT * FROM (SELECT p_partkey AS cluster_id, {pick(STATUSES, 'p_partkey')} AS status FROM part) WHERE status <> '' AND {settled}",
        "j15_first_given": o.sql("SELECT cluster_id, CASE WHEN cluster_id % 3 = 0 THEN severity WHEN cluster_id % 2 = 0 THEN risk_level ELSE 'LOW' END AS severity FROM alerts", "alerts"),
        "u2_history": o.sql("SELECT run, severity, count(*) AS n FROM (SELECT 1 AS run, severity FROM old UNION ALL SELECT 2, severity FROM alerts) GROUP BY 1, 2", "old", "alerts"),
        "u6_heads": o.sql("SELECT cluster_id, false_alarm_indicator FROM (SELECT cluster_id, false_alarm_indicator, row_number() OVER (PARTITION BY false_alarm_indicator ORDER BY cluster_id) AS n FROM risk) WHERE n <= 2 AND false_alarm_indicator IN ('HIGH', 'LOW')", "risk"),
        "s14_geocode_cache": o.sql("SELECT cluster_id, key, place, place IS NOT NULL AS hit FROM keyed4 LEFT JOIN (SELECT key, min(land_cover) AS place FROM keyed4 WHERE cluster_id % 3 = 0 GROUP BY 1) USING (key)", "master").replace("\nSELECT cluster_id, key", f",\nkeyed4 AS (SELECT cluster_id, land_cover, {o.fixed('latitude', 4)} || ',' || {o.fixed('longitude', 4)} AS key FROM master)\nSELECT cluster_id, key"),
        "r6_run_status": "SELECT day, CASE WHEN count(error) = count(*) THEN 'failed' WHEN count(error) > 0 THEN 'degraded' ELSE 'healthy' END AS status, coalesce(string_agg(product || ': ' || error, '; ' ORDER BY product || ': ' || error), '') AS error FROM (SELECT ts::DATE AS day, event_type AS product, CASE WHEN (count(*) + day(ts::DATE)) % 3 = 0 THEN 'lost ' || count(*) END AS error FROM events GROUP BY 1, 2) GROUP BY 1",
        "api_health": o.sql("SELECT (SELECT count(*) FROM master) AS clusters, (SELECT max(last_detection) FROM master) AS latest, (SELECT count(*) FROM alerts) AS alerts, CASE WHEN (SELECT count(*) FROM master) > 0 THEN 'ok' ELSE 'empty' END AS status", "master", "alerts"),
        "k2_versions": "SELECT key, version, generation::INT AS generation FROM (SELECT user_id AS key, event_id AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS generation FROM events) WHERE generation <= 2",
    }
