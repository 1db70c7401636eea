"""The named queries in DuckDB SQL over the same input tables."""

from __future__ import annotations

from ..operators.context import FARM_ADVICE, FOREST_ADVICE, NO_SEASON, TOO_SHORT
from ..sources.adapter import BOUNDARY

S3, S7 = "1000.0::DOUBLE", "1e6::DOUBLE"


def rnd(x: str, places: int) -> str:
    return f"(round_even(({x}) * {float(10**places)}::DOUBLE, 0) / {float(10**places)}::DOUBLE)"


def mean3(x: str) -> str:
    return f"(round_even(sum(round_even({x} * 1000.0::DOUBLE, 0)::BIGINT)::DOUBLE / count({x}), 0) / 1000.0::DOUBLE)"


def mean6(x: str) -> str:
    return f"(sum(round_even({x} * 1e6::DOUBLE, 0)::BIGINT)::DOUBLE / count(*) / 1e6::DOUBLE)"


def hav(a: str, b: str, c: str, d: str) -> str:
    half = lambda p, q: f"sin((radians({q}) - radians({p})) / 2.0::DOUBLE)"
    h = f"({half(a, c)} * {half(a, c)} + cos(radians({a})) * cos(radians({c})) * {half(b, d)} * {half(b, d)})"
    return f"(asin(sqrt(CASE WHEN {h} > 1.0 THEN 1.0::DOUBLE ELSE {h} END)) * {2 * 6371.0088}::DOUBLE)"


def brg(a: str, b: str, c: str, d: str) -> str:
    t = f"(radians({d}) - radians({b}))"
    return f"fmod(atan2(sin({t}) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos({t})) * (180.0::DOUBLE / pi()) + 360.0::DOUBLE, 360.0::DOUBLE)"


def compass(x: str) -> str:
    return f"(['N','NE','E','SE','S','SW','W','NW'])[(round_even({x} / 45.0::DOUBLE, 0)::INT % 8) + 1]"


def fixed(x: str, places: int) -> str:
    n, k = f"round_even({x} * {float(10**places)}::DOUBLE, 0)::BIGINT", 10**places
    return f"(CASE WHEN {n} < 0 THEN '-' ELSE '' END || (abs({n}) // {k})::VARCHAR || '.' || lpad((abs({n}) % {k})::VARCHAR, {places}, '0'))"


def place(site: str, p: int = 7919, q: int = 104729) -> tuple[str, str]:
    return f"8.0::DOUBLE + (({site} * {p}::BIGINT) % 2500) * 0.01::DOUBLE", f"70.0::DOUBLE + (({site} * {q}::BIGINT) % 2503) * 0.01::DOUBLE"


LAT, LON = place("site")
SLAT, SLON = place("s_suppkey", 6007, 99991)
FLAT, FLON = place("p_partkey", 6007, 99991)
IND, AGR, FOR, UNK = "Industrial-context thermal event", "Agricultural-context thermal event", "Forest/Natural-context thermal event", "Unknown / Insufficient Evidence"
SEASON = (("north_india", 28, 35, 73, 80, "10,11", "3,4,5"), ("central_india", 20, 28, 73, 82, "3,4", "2,3,4,5"), ("eastern_india", 20, 27, 82, 90, "4,5", "2,3,4"), ("south_india", 8, 20, 73, 82, "3,4", "2,3,4"), ("western_india", 22, 30, 68, 75, "5,6", "3,4,5"), ("northeast_india", 22, 29, 89, 98, "2,3", "1,2,3,4"))
BOX = "latitude BETWEEN {1} AND {2} AND longitude BETWEEN {3} AND {4}"


def crossings(lat: str = "latitude", lon: str = "longitude") -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(BOUNDARY, [*BOUNDARY[1:], BOUNDARY[0]], strict=True):
        parts.append(f"CASE WHEN (({y1}::DOUBLE > {lat}) <> ({y2}::DOUBLE > {lat})) AND {lon} < ({x2 - x1!r}::DOUBLE * ({lat} - {y1}::DOUBLE) / {y2 - y1!r}::DOUBLE + {x1}::DOUBLE) THEN 1 ELSE 0 END")
    ys, xs = [p[1] for p in BOUNDARY], [p[0] for p in BOUNDARY]
    return f"({lat} BETWEEN {min(ys)} AND {max(ys)} AND {lon} BETWEEN {min(xs)} AND {max(xs)} AND ({' + '.join(parts)}) % 2 = 1)"


#: Table definitions by name: (tables they need, SQL).
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "e0": ((), "SELECT event_id, ts, user_id, event_type, value, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events"),
    "e1": (("e0",), "SELECT *, CASE WHEN k < 30 THEN user_id WHEN k < 85 THEN 1000 + (event_id * 37) % 797 + 800 * (event_id // 2500) ELSE 100000 + event_id END AS site FROM e0"),
    "det": (("e1",), f"""SELECT event_id AS detection_id, {LAT} + ((event_id * 31) % 10) * 0.0012::DOUBLE AS latitude, {LON} + ((event_id * 17) % 10) * 0.0012::DOUBLE AS longitude,
        ts::DATE AS acq_date, strftime(ts, '%H%M') AS acq_time, ts AS acquisition_datetime, 295.0::DOUBLE + value * 0.2::DOUBLE AS bright_ti4, 270.0::DOUBLE + k * 0.3::DOUBLE AS bright_ti5, value / 10.0::DOUBLE AS frp,
        CASE k % 3 WHEN 0 THEN 'l' WHEN 1 THEN 'n' ELSE 'h' END AS confidence, CASE WHEN event_type IN ('view', 'click') THEN 'NOAA-20' ELSE 'NOAA-21' END AS satellite FROM e1"""),
    "dirty": (("det",), """SELECT detection_id, row_pos, CASE WHEN detection_id % 97 = 0 THEN 999.0 ELSE latitude END AS latitude, CASE WHEN detection_id % 101 = 0 THEN NULL ELSE longitude END AS longitude,
        acq_date, acq_time, bright_ti4, frp, confidence, satellite, CASE WHEN detection_id % 3 = 0 THEN 'VIIRS' ELSE 'MODIS' END AS instrument, CASE satellite WHEN 'NOAA-20' THEN 'firms_noaa20.csv' ELSE 'firms_noaa21.csv' END AS source_file, acquisition_datetime
        FROM (SELECT *, detection_id AS row_pos FROM det UNION ALL SELECT *, detection_id + 100000000 AS row_pos FROM det WHERE detection_id % 50 = 0)"""),
    "valid": (("dirty",), "SELECT * FROM dirty WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180"),
    "stations": ((), f"SELECT s_suppkey AS station_id, s_name AS station_name, {SLAT} AS station_lat, {SLON} AS station_lon FROM supplier"),
    "facilities": ((), f"SELECT p_partkey AS facility_id, (['refinery', 'works', 'plant', 'industrial', ''])[p_size % 5 + 1] AS facility_type, {FLAT} AS facility_lat, {FLON} AS facility_lon FROM part"),
    "clouds": (("det",), "SELECT acq_date, ((datediff('day', DATE '2024-01-01', acq_date) * 37 + 11) % 101)::DOUBLE AS cloud_cover FROM (SELECT DISTINCT acq_date FROM det) WHERE datediff('day', DATE '2024-01-01', acq_date) % 7 <> 6"),
    "cells": (("det",), "SELECT *, floor(latitude / (1.0::DOUBLE / 111.0::DOUBLE))::BIGINT AS cx, floor(longitude / (1.0::DOUBLE / 111.0::DOUBLE))::BIGINT AS cy FROM det"),
    "edges": (("cells",), f"""SELECT l.detection_id AS a, r.detection_id AS b FROM (SELECT * FROM cells, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)) l JOIN cells r ON l.cx + dx = r.cx AND l.cy + dy = r.cy
        AND l.detection_id < r.detection_id AND abs(datediff('day', l.acq_date, r.acq_date)) <= 3 AND {hav("l.latitude", "l.longitude", "r.latitude", "r.longitude")} <= 1.0"""),
    "links": (("edges",), "SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges"),
    "reach": (("links",), "SELECT detection_id AS id, detection_id AS l FROM det UNION SELECT b, l FROM reach JOIN links ON a = id"),
    "cd": (("reach", "det"), "SELECT det.*, c.cluster_id FROM det JOIN (SELECT id, min(l) AS cluster_id FROM reach GROUP BY id) c ON c.id = det.detection_id"),
    "summary": (("cd",), f"""SELECT *, {rnd("active_days::DOUBLE / window_days", 4)} AS persistence_score, CASE WHEN active_days < 2 THEN 'isolated' WHEN active_days < 5 THEN 'short_lived_repeated' ELSE 'persistent' END AS persistence_category FROM
        (SELECT cluster_id, count(*) AS observation_count, count(DISTINCT acq_date) AS active_days, min(acq_date) AS first_detection, max(acq_date) AS last_detection, (datediff('day', min(acq_date), max(acq_date)) + 1)::INT AS duration_days,
        {mean3("bright_ti4")} AS mean_bright_ti4, {rnd("max(bright_ti4)", 3)} AS max_bright_ti4, {mean3("bright_ti5")} AS mean_bright_ti5, {rnd("max(bright_ti5)", 3)} AS max_bright_ti5, {mean3("frp")} AS mean_frp, {rnd("max(frp)", 3)} AS max_frp,
        {mean3("(CASE confidence WHEN 'l' THEN 1 WHEN 'n' THEN 2 ELSE 3 END)")} AS mean_confidence, {mean3("latitude")} AS latitude, {mean3("longitude")} AS longitude FROM cd GROUP BY cluster_id), (SELECT datediff('day', min(acq_date), max(acq_date)) + 1 AS window_days FROM det)"""),
    "f0": (("summary",), f"""SELECT *, {rnd("mean_bright_ti4 - mean_bright_ti5", 3)} AS bt_diff_mean, {rnd("max_bright_ti4 - max_bright_ti5", 3)} AS bt_diff_max, CASE WHEN max_frp > 0 THEN {rnd("mean_frp / max_frp", 4)} ELSE 1.0 END AS frp_mean_to_max_ratio,
        {rnd("observation_count::DOUBLE / greatest(duration_days, 1)", 4)} AS detection_density, {rnd("active_days::DOUBLE / greatest(duration_days, 1)", 4)} AS active_day_ratio, (active_days > 1)::INT AS is_multi_day, (persistence_category = 'persistent')::INT AS is_persistent_candidate,
        CASE persistence_category WHEN 'isolated' THEN 0 WHEN 'short_lived_repeated' THEN 1 ELSE 2 END AS persistence_category_code FROM summary"""),
    "feat": (("f0",), "SELECT *, CASE (max_frp > 20)::INT + (bt_diff_max > 30)::INT WHEN 2 THEN 'HIGH' WHEN 1 THEN 'ELEVATED' ELSE 'NORMAL' END AS abnormality_level FROM f0"),
    "x0": (("feat",), """SELECT *, max_bright_ti4 >= 340 AS f1, bt_diff_max >= 45 AS f2, max_frp >= 15 AS f3, mean_frp >= 10 AS f4, active_days >= 4 AS lasting, active_days < 4 AND active_days >= 2 AND duration_days > 4 AS recurring FROM feat"""),
    "x1": (("x0",), "SELECT *, (f1 OR f2)::INT + (f3 OR f4)::INT + lasting::INT + recurring::INT AS groups_n, list_filter([CASE WHEN f1 OR f2 THEN 'elevated thermal intensity' END, CASE WHEN f3 OR f4 THEN 'elevated thermal energy (FRP)' END, CASE WHEN lasting THEN 'persistent multi-day activity' END, CASE WHEN recurring THEN 'recurring thermal activity over an extended duration' END, CASE WHEN NOT (f1 OR f2 OR f3 OR f4 OR lasting OR recurring) THEN 'unusual multi-variate statistical signature' END], lambda x: x IS NOT NULL) AS told FROM x0"),
    "expl": (("x1",), """SELECT *, CASE WHEN abnormality_level = 'NORMAL' THEN 'NORMAL_THERMAL_ACTIVITY' WHEN groups_n > 1 THEN 'MULTI_FACTOR_ANOMALY' WHEN lasting THEN 'PERSISTENT_THERMAL_ACTIVITY' WHEN recurring THEN 'RECURRING_THERMAL_ACTIVITY' WHEN (f1 OR f2) AND active_days <= 2 THEN 'SHORT_LIVED_EXTREME_EVENT' WHEN f1 OR f2 THEN 'HIGH_THERMAL_INTENSITY' WHEN f3 OR f4 THEN 'HIGH_THERMAL_ENERGY' ELSE 'STATISTICAL_ANOMALY' END AS anomaly_characterization,
        CASE WHEN abnormality_level = 'NORMAL' THEN 'Thermal activity falls within normal statistical bounds.' ELSE upper(abnormality_level[1]) || lower(abnormality_level[2:]) || ' abnormality primarily associated with ' || CASE WHEN len(told) > 1 THEN array_to_string(told[:-2], ', ') || ' and ' || told[-1] ELSE told[1] END || '.' END AS explanation,
        CASE WHEN abnormality_level = 'NORMAL' THEN 'none' ELSE concat_ws(',', CASE WHEN f1 THEN 'max_bright_ti4' END, CASE WHEN f2 THEN 'bt_diff_max' END, CASE WHEN f3 THEN 'max_frp' END, CASE WHEN f4 THEN 'mean_frp' END, CASE WHEN lasting THEN 'active_days' END, CASE WHEN recurring THEN 'duration_days' END, CASE WHEN groups_n = 0 THEN 'multivariate_combination' END) END AS contributing_factors FROM x1"""),
    "fa0": (("expl",), """SELECT *, (CASE WHEN observation_count = 1 THEN 2 WHEN observation_count >= 5 THEN -2 ELSE 0 END + CASE WHEN active_days = 1 AND duration_days = 1 THEN 1 WHEN active_days >= 3 OR persistence_category = 'persistent' THEN -2 ELSE 0 END
        + CASE WHEN mean_confidence < 1.5 THEN 2 WHEN mean_confidence >= 2.5 THEN -1 ELSE 0 END + CASE WHEN max_frp < 2 THEN 1 WHEN max_frp >= 15 THEN -2 ELSE 0 END + CASE WHEN bt_diff_max < 25 OR max_bright_ti4 < 315 THEN 1 WHEN max_bright_ti4 >= 340 OR bt_diff_max >= 45 THEN -1 ELSE 0 END)::INT AS false_alarm_score,
        concat_ws('; ', CASE WHEN observation_count = 1 THEN 'single point observation' END, CASE WHEN active_days = 1 AND duration_days = 1 THEN 'no temporal recurrence' END, CASE WHEN mean_confidence < 1.5 THEN 'low satellite confidence rating' END, CASE WHEN max_frp < 2 THEN 'weak thermal power (< 2 MW)' END, CASE WHEN bt_diff_max < 25 OR max_bright_ti4 < 315 THEN 'low spectral temperature contrast' END) AS why FROM expl"""),
    "fa": (("fa0",), """SELECT *, CASE WHEN false_alarm_score >= 3 THEN 'HIGH' WHEN false_alarm_score >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS false_alarm_indicator, CASE WHEN why <> '' THEN why WHEN false_alarm_score < 1 THEN 'strong supporting evidence across thermal and temporal metrics' ELSE 'strong supporting evidence' END AS false_alarm_reasons,
        CASE WHEN false_alarm_score >= 3 THEN 'LOW' WHEN false_alarm_score >= 1 THEN 'MEDIUM' ELSE 'HIGH' END AS detection_reliability FROM fa0"""),
    "r0": (("fa",), """SELECT *, CASE abnormality_level WHEN 'HIGH' THEN 35.0::DOUBLE WHEN 'ELEVATED' THEN 20.0 ELSE 5.0 END AS abnormality_points, CASE WHEN max_frp >= 20 THEN 25.0::DOUBLE WHEN max_frp >= 10 THEN 18.0 WHEN max_frp >= 5 THEN 12.0 WHEN max_frp >= 2 THEN 6.0 ELSE 0.0 END AS frp_points,
        CASE WHEN persistence_category = 'persistent' OR active_days >= 4 THEN 20.0::DOUBLE WHEN persistence_category = 'short_lived_repeated' OR active_days >= 2 THEN 12.0 ELSE 3.0 END AS persistence_points, CASE WHEN max_bright_ti4 >= 350 OR bt_diff_max >= 50 THEN 20.0::DOUBLE WHEN max_bright_ti4 >= 335 OR bt_diff_max >= 35 THEN 12.0 ELSE 4.0 END AS intensity_points,
        CASE false_alarm_indicator WHEN 'LOW' THEN 1.0::DOUBLE WHEN 'HIGH' THEN 0.5 ELSE 0.85 END AS reliability_multiplier FROM fa"""),
    "r1": (("r0",), f"SELECT *, abnormality_points + frp_points + persistence_points + intensity_points AS base_score, {rnd('least(100.0::DOUBLE, greatest(0.0::DOUBLE, (abnormality_points + frp_points + persistence_points + intensity_points) * reliability_multiplier))', 1)} AS risk_score FROM r0"),
    "r2": (("r1",), """SELECT *, CASE WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, coalesce(nullif(concat_ws('; ', CASE abnormality_level WHEN 'HIGH' THEN 'High statistical abnormality' WHEN 'ELEVATED' THEN 'Elevated statistical abnormality' END,
        CASE WHEN max_frp >= 20 THEN 'Strong thermal power (FRP >= 20 MW)' WHEN max_frp >= 10 THEN 'Elevated thermal power (FRP >= 10 MW)' END, CASE persistence_points WHEN 20 THEN 'Persistent multi-day activity' WHEN 12 THEN 'Recurring thermal activity' END, CASE WHEN intensity_points = 20 THEN 'Peak thermal intensity / contrast' END,
        CASE false_alarm_indicator WHEN 'HIGH' THEN 'High false-alarm concern penalty applied' WHEN 'LOW' THEN 'High evidence reliability' END), ''), 'Standard thermal baseline') AS risk_factors FROM r1"""),
    "risk": (("r2",), f"""SELECT *, CASE risk_level WHEN 'HIGH' THEN 'High risk index (' || {fixed("risk_score", 1)} || '/100) driven by strong thermal evidence and statistical abnormality (' || risk_factors || '). Ranked for priority inspection.'
        WHEN 'MEDIUM' THEN 'Moderate risk index (' || {fixed("risk_score", 1)} || '/100) based on localized thermal activity or moderated evidence reliability.' ELSE 'Low risk index (' || {fixed("risk_score", 1)} || '/100) representing routine thermal baseline or weak unverified single-detection evidence.' END AS risk_explanation FROM r2"""),
    "daily": (("cd",), f"SELECT cluster_id, acq_date AS day, {mean6('latitude')} AS lat, {mean6('longitude')} AS lon, count(*) AS n FROM cd GROUP BY ALL"),
    "steps": (("daily",), "SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM daily WINDOW w AS (PARTITION BY cluster_id ORDER BY day)"),
    "steps2": (("steps",), f"SELECT *, {hav('lat', 'lon', 'lat2', 'lon2')} AS km, radians({brg('lat', 'lon', 'lat2', 'lon2')}) AS turn FROM steps"),
    "m0": (("steps2", "cd"), f"""SELECT *, greatest({rnd("seconds / 86400.0::DOUBLE", 3)}, 0.0) AS time_span_days FROM (SELECT cluster_id, count(*) AS active_days, arg_min(lat, day) AS a1, arg_min(lon, day) AS a2, arg_max(lat, day) AS z1, arg_max(lon, day) AS z2, count_if(km >= 0.05)::BIGINT AS n_steps,
        sum(CASE WHEN km >= 0.05 THEN round_even(km * 1e6::DOUBLE, 0)::BIGINT END)::DOUBLE AS w, sum(CASE WHEN km >= 0.05 THEN round_even(km * sin(turn) * 1e6::DOUBLE, 0)::BIGINT END)::DOUBLE AS s, sum(CASE WHEN km >= 0.05 THEN round_even(km * cos(turn) * 1e6::DOUBLE, 0)::BIGINT END)::DOUBLE AS c FROM steps2 GROUP BY cluster_id)
        JOIN (SELECT cluster_id, count(*) AS observation_count, (epoch_us(max(acquisition_datetime)) - epoch_us(min(acquisition_datetime)))::DOUBLE / 1e6::DOUBLE AS seconds FROM cd GROUP BY cluster_id) USING (cluster_id)"""),
    "m1": (("m0",), f"SELECT *, active_days >= 2 AND time_span_days > 0 AS known, CASE WHEN active_days >= 2 AND time_span_days > 0 THEN {rnd(hav('a1', 'a2', 'z1', 'z2'), 6)} ELSE 0.0 END AS raw_km, {brg('a1', 'a2', 'z1', 'z2')} AS raw_b, CASE WHEN n_steps > 0 THEN least(1.0::DOUBLE, {rnd('sqrt((s / w) * (s / w) + (c / w) * (c / w))', 6)}) END AS r FROM m0"),
    "m2": (("m1",), "SELECT *, CASE WHEN known AND raw_km >= 0.5 AND n_steps > 0 THEN round_even(100.0::DOUBLE * r * least(1.0::DOUBLE, n_steps / 3.0::DOUBLE), 0)::INT ELSE 0 END AS score, known AND raw_km >= 0.5 AND n_steps > 0 AND coalesce(r >= 0.5, FALSE) AS steady FROM m1"),
    "move": (("m2",), f"""SELECT cluster_id, observation_count, active_days, time_span_days, {rnd("raw_km", 3)} AS total_movement_distance_km, CASE WHEN known THEN {rnd("raw_km / time_span_days", 3)} ELSE 0.0 END AS movement_rate_km_per_day, CASE WHEN known AND raw_km > 0.01 THEN {rnd("raw_b", 2)} ELSE 0.0 END AS movement_bearing_degrees,
        CASE WHEN NOT known THEN 'INSUFFICIENT_DATA' WHEN raw_km > 0.01 THEN {compass("raw_b")} ELSE 'STATIONARY' END AS movement_direction, CASE WHEN NOT known THEN 'INSUFFICIENT_DATA' WHEN raw_km < 0.5 THEN 'STATIONARY' ELSE 'MOVING' END AS movement_status,
        CASE WHEN NOT known THEN 'INSUFFICIENT_DATA' WHEN observation_count < 4 OR raw_km < 1.0 THEN 'LOW' WHEN active_days <= 3 THEN 'MEDIUM' ELSE 'HIGH' END AS movement_confidence, CASE WHEN NOT known THEN 'insufficient_evidence' WHEN raw_km < 0.5 THEN 'stationary' WHEN steady THEN 'directional' ELSE 'erratic' END AS movement_pattern,
        CASE WHEN steady THEN {compass("raw_b")} END AS direction, steady AS direction_available, score AS direction_confidence_score, CASE WHEN NOT known OR raw_km < 0.5 OR n_steps = 0 THEN 'INSUFFICIENT' WHEN steady AND score >= 60 AND n_steps >= 3 AND active_days >= 4 AND r >= 0.7 THEN 'HIGH' WHEN steady AND score >= 35 THEN 'MODERATE' ELSE 'PRELIMINARY' END AS direction_confidence FROM m2"""),
    "nf": (("feat", "facilities"), f"SELECT cluster_id, arg_min(facility_id, (km, facility_id)) AS facility_id, arg_min(facility_type, (km, facility_id)) AS facility_type, {rnd('min(km)', 2)} AS km FROM (SELECT cluster_id, f.*, {hav('latitude', 'longitude', 'facility_lat', 'facility_lon')} AS km FROM feat, facilities f WHERE abs(latitude - facility_lat) < 0.2) WHERE km <= 2.0 GROUP BY cluster_id"),
    "ns": (("feat", "stations"), f"SELECT cluster_id, arg_min(station_id, (km, station_id)) AS station_id, arg_min(station_name, (km, station_id)) AS station_name, {rnd('min(km)', 2)} AS km FROM (SELECT cluster_id, s.*, {hav('latitude', 'longitude', 'station_lat', 'station_lon')} AS km FROM feat, stations s) WHERE km < 50.0 GROUP BY cluster_id"),
    "w0": (("risk", "move", "nf", "ns"), """SELECT risk.*, move.* EXCLUDE (cluster_id, observation_count, active_days), nf.facility_type, nf.km AS facility_km, ns.station_id, ns.station_name, ns.km AS station_km, (['cropland', 'built-up', 'forest', 'unknown'])[cluster_id % 4 + 1] AS land_cover
        FROM risk LEFT JOIN move USING (cluster_id) LEFT JOIN nf USING (cluster_id) LEFT JOIN ns USING (cluster_id)"""),
    "w1": (("w0",), """SELECT *, coalesce(facility_km <= 2.0 AND facility_type NOT IN ('none', 'unknown', ''), FALSE) AS near_f, bt_diff_max >= 35 OR max_bright_ti4 >= 340 AS contrast FROM w0"""),
    "w2": (("w1",), """SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN persistence_category = 'persistent' OR active_days >= 4 THEN 0.3::DOUBLE WHEN persistence_category = 'short_lived_repeated' OR active_days >= 2 THEN 0.15 ELSE 0.0 END + CASE WHEN movement_status = 'STATIONARY' OR (active_days >= 2 AND total_movement_distance_km < 0.5) THEN 0.25::DOUBLE ELSE 0.0 END
        + CASE WHEN contrast THEN 0.2::DOUBLE ELSE 0.0 END + CASE WHEN near_f THEN 0.25::DOUBLE ELSE 0.0 END + CASE WHEN land_cover = 'built-up' THEN 0.2::DOUBLE ELSE 0.0 END + 0.0)) AS ind0,
        least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN persistence_category = 'isolated' OR active_days <= 2 THEN 0.35::DOUBLE ELSE 0.0 END + CASE WHEN total_movement_distance_km >= 0.05 AND total_movement_distance_km < 1.0 AND movement_status <> 'MOVING' THEN 0.2::DOUBLE ELSE 0.0 END + CASE WHEN max_frp >= 5 AND max_frp < 25 THEN 0.2::DOUBLE ELSE 0.0 END
        + CASE WHEN land_cover = 'cropland' THEN 0.3::DOUBLE ELSE 0.0 END + 0.0 + CASE WHEN near_f THEN -0.15::DOUBLE ELSE 0.0 END)) AS agr,
        least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN movement_status = 'MOVING' OR total_movement_distance_km >= 0.5 THEN 0.4::DOUBLE ELSE 0.0 END + CASE WHEN max_frp >= 20 THEN 0.25::DOUBLE ELSE 0.0 END + CASE WHEN active_days >= 2 AND persistence_category <> 'persistent' THEN 0.15::DOUBLE ELSE 0.0 END
        + CASE WHEN land_cover = 'forest' THEN 0.3::DOUBLE ELSE 0.0 END + 0.0 + CASE WHEN near_f THEN -0.2::DOUBLE ELSE 0.0 END)) AS fst FROM w1"""),
    "w3": (("w2",), "SELECT *, CASE WHEN near_f AND ind0 >= 0.4::DOUBLE AND (movement_status = 'MOVING' OR (active_days = 1 AND NOT contrast)) THEN least(ind0, 0.35::DOUBLE) ELSE ind0 END AS ind FROM w2"),
    "w4": (("w3",), f"SELECT *, CASE WHEN ind >= 0.4::DOUBLE THEN {rnd('ind', 2)} ELSE 0.0 END AS b1 FROM w3"),
    "w5": (("w4",), f"SELECT *, agr >= 0.4::DOUBLE AND agr > b1 AS awin, CASE WHEN agr >= 0.4::DOUBLE AND agr > b1 THEN {rnd('agr', 2)} ELSE b1 END AS b2 FROM w4"),
    "master": (("w5",), f"""SELECT *, CASE WHEN fst >= 0.4::DOUBLE AND fst > b2 THEN '{FOR}' WHEN awin THEN '{AGR}' WHEN ind >= 0.4::DOUBLE THEN '{IND}' ELSE '{UNK}' END AS classification_label, CASE WHEN fst >= 0.4::DOUBLE AND fst > b2 THEN {rnd("fst", 2)} ELSE b2 END AS classification_score FROM w5"""),
    "t0": (("master",), """SELECT *, CASE WHEN false_alarm_indicator = 'LOW' AND detection_reliability = 'HIGH' THEN 'HIGH' WHEN false_alarm_indicator = 'MEDIUM' OR detection_reliability = 'MEDIUM' THEN 'MODERATE' ELSE 'LOW' END AS evidence_confidence,
        CASE WHEN risk_level = 'HIGH' AND risk_score >= 85 AND false_alarm_indicator = 'LOW' AND detection_reliability = 'HIGH' THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS base FROM master"""),
    "t1": (("t0",), "SELECT *, false_alarm_indicator = 'HIGH' AND evidence_confidence = 'LOW' AS suppressed, false_alarm_indicator = 'HIGH' AND base IN ('CRITICAL', 'HIGH') AS capped FROM t0"),
    "t2": (("t1",), "SELECT *, CASE WHEN suppressed THEN 'LOW' WHEN capped THEN 'MEDIUM' ELSE base END AS severity FROM t1"),
    "t3": (("t2",), f"""SELECT *, list_filter([CASE WHEN risk_score >= 30 THEN 'Risk score ' || {fixed("risk_score", 1)} || '/100 (' || severity || ' risk)' END, CASE false_alarm_indicator WHEN 'LOW' THEN 'Low false-alarm concern' WHEN 'HIGH' THEN 'High false-alarm concern' END, CASE WHEN detection_reliability = 'HIGH' THEN 'High evidence reliability' END,
        CASE WHEN persistence_category = 'persistent' OR active_days >= 4 THEN 'Persistent multi-day thermal activity (' || active_days || ' active days)' WHEN active_days >= 2 THEN 'Recurring thermal activity (' || active_days || ' active days)' WHEN observation_count = 1 THEN 'Single observation (no temporal recurrence)' END,
        CASE WHEN max_frp >= 20 THEN 'Strong thermal power (FRP ' || {fixed("max_frp", 1)} || ' MW)' WHEN max_frp >= 10 THEN 'Elevated thermal power (FRP ' || {fixed("max_frp", 1)} || ' MW)' END, CASE WHEN max_bright_ti4 >= 340 OR bt_diff_max >= 45 THEN 'Peak thermal intensity / high spectral contrast' END,
        CASE classification_label WHEN '{IND}' THEN 'Industrial context detected (score ' || {fixed("classification_score", 2)} || ')' WHEN '{AGR}' THEN 'Agricultural-context event' WHEN '{FOR}' THEN 'Forest/Natural-context event' END,
        CASE WHEN direction IS NOT NULL THEN 'Thermal activity movement ' || direction || ' (confidence ' || direction_confidence || ')' END, CASE WHEN station_km IS NOT NULL THEN 'Verified fire station nearby: ' || station_name || ' (' || {fixed("station_km", 1)} || ' km)' END,
        CASE WHEN suppressed THEN 'Suppressed for monitoring (high false-alarm concern, weak evidence)' END, CASE WHEN capped THEN 'Downgraded: high false-alarm concern caps severity at MEDIUM' END], lambda x: x IS NOT NULL) AS list FROM t2"""),
    "alerts": (("t3",), """SELECT * EXCLUDE (list), CASE WHEN len(list) > 0 THEN array_to_string(list, '; ') ELSE 'Routine thermal baseline / informational monitoring' END AS reasons, 'TAL-' || CASE WHEN length(cluster_id::VARCHAR) < 5 THEN lpad(cluster_id::VARCHAR, 5, '0') ELSE cluster_id::VARCHAR END AS alert_id, 'ACTIVE' AS status FROM t3"""),
    "season": (("master",), "SELECT *, CASE " + " ".join(f"WHEN {BOX.format(*s)} THEN '{s[0]}'" for s in SEASON) + " END AS season_region, CASE " + " ".join(f"WHEN {BOX.format(*s)} THEN month(first_detection) IN ({s[5]})" for s in SEASON) + " END AS farm, CASE " + " ".join(f"WHEN {BOX.format(*s)} THEN month(first_detection) IN ({s[6]})" for s in SEASON) + " END AS wood FROM master"),
    "unc0": (("master",), f"""SELECT *, {rnd("least(1.0::DOUBLE, greatest(0.0::DOUBLE, (CASE WHEN cloud > 0.5 THEN (cloud - 0.5::DOUBLE) * 0.8::DOUBLE ELSE 0.0 END + CASE WHEN observation_count < 3 THEN (3 - observation_count) * 0.15::DOUBLE ELSE 0.0 END) * 0.3::DOUBLE + (1.0::DOUBLE - classification_score) * 0.3::DOUBLE + ((coalesce((abs((bt_diff_mean - q_bt_diff_mean[2]) / coalesce(nullif(q_bt_diff_mean[3] - q_bt_diff_mean[1], 0), 1)) > 3)::INT, 0) + coalesce((abs((bt_diff_max - q_bt_diff_max[2]) / coalesce(nullif(q_bt_diff_max[3] - q_bt_diff_max[1], 0), 1)) > 3)::INT, 0) + coalesce((abs((frp_mean_to_max_ratio - q_frp_mean_to_max_ratio[2]) / coalesce(nullif(q_frp_mean_to_max_ratio[3] - q_frp_mean_to_max_ratio[1], 0), 1)) > 3)::INT, 0) + coalesce((abs((detection_density - q_detection_density[2]) / coalesce(nullif(q_detection_density[3] - q_detection_density[1], 0), 1)) > 3)::INT, 0) + coalesce((abs((active_day_ratio - q_active_day_ratio[2]) / coalesce(nullif(q_active_day_ratio[3] - q_active_day_ratio[1], 0), 1)) > 3)::INT, 0))::DOUBLE / 5.0::DOUBLE * 0.3::DOUBLE + ((bt_diff_mean IS NULL)::INT + (bt_diff_max IS NULL)::INT + (frp_mean_to_max_ratio IS NULL)::INT + (detection_density IS NULL)::INT + (active_day_ratio IS NULL)::INT)::DOUBLE / 5.0::DOUBLE * 0.7::DOUBLE) * 0.2::DOUBLE + (1.0::DOUBLE - active_day_ratio) * 0.2::DOUBLE))", 6)} AS u,
        {rnd("least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE risk_level WHEN 'HIGH' THEN 0.2::DOUBLE WHEN 'MEDIUM' THEN 0.4 ELSE 0.3 END * 0.3::DOUBLE + CASE false_alarm_indicator WHEN 'HIGH' THEN 0.4::DOUBLE WHEN 'MEDIUM' THEN 0.2 ELSE 0.0 END * 0.3::DOUBLE + (CASE WHEN cloud > 0.5 THEN 0.3::DOUBLE ELSE 0.0 END + CASE WHEN observation_count < 3 THEN 0.2::DOUBLE ELSE 0.0 END) * 0.2::DOUBLE + (1.0::DOUBLE - classification_score) * 0.2::DOUBLE))", 6)} AS ru FROM (SELECT *, (cluster_id % 101) / 100.0::DOUBLE AS cloud FROM master), (SELECT quantile_cont(bt_diff_mean::DOUBLE, [0.25, 0.5, 0.75]) AS q_bt_diff_mean, quantile_cont(bt_diff_max::DOUBLE, [0.25, 0.5, 0.75]) AS q_bt_diff_max, quantile_cont(frp_mean_to_max_ratio::DOUBLE, [0.25, 0.5, 0.75]) AS q_frp_mean_to_max_ratio, quantile_cont(detection_density::DOUBLE, [0.25, 0.5, 0.75]) AS q_detection_density, quantile_cont(active_day_ratio::DOUBLE, [0.25, 0.5, 0.75]) AS q_active_day_ratio FROM master)"""),
    "series": (("cd",), "SELECT cluster_id, acq_date AS day, max(frp) AS value FROM cd GROUP BY ALL"),
    "gaps": (("series",), "SELECT *, datediff('day', day, nd) - 1 AS g FROM (SELECT *, lead(day) OVER w AS nd, lead(value) OVER w AS nv FROM series WINDOW w AS (PARTITION BY cluster_id ORDER BY day)) WHERE datediff('day', day, nd) > 1"),
    "fill": (("gaps",), "SELECT *, (day + (i + 1)::INT)::DATE AS d, (i + 1)::DOUBLE / (g + 1) AS t FROM (SELECT *, unnest(range(0, g)) AS i FROM gaps WHERE g <= 3)"),
    "keyed": (("cd",), f"SELECT cluster_id, arg_min({{'s': satellite, 'a': latitude, 'o': longitude}}, (acq_date, latitude, longitude, detection_id)) AS f, {mean6('latitude')} AS latitude, {mean6('longitude')} AS longitude, count(*) AS observation_count, max(acq_date) AS last_seen FROM cd GROUP BY cluster_id"),
    "old": (("alerts",), "SELECT *, CASE WHEN status = 'RESOLVED' THEN severity END AS resolved_severity FROM (SELECT cluster_id, (['LOW', 'MEDIUM', 'HIGH'])[cluster_id * 7 % 3 + 1] AS severity, (['ACTIVE', 'ACKNOWLEDGED', 'RESOLVED'])[cluster_id % 3 + 1] AS status FROM alerts WHERE cluster_id % 5 <> 0)"),
    "sync": (("old", "alerts"), "SELECT n.cluster_id, n.severity, o.severity AS was, o.status AS before, CASE WHEN o.status IS NULL OR (o.status = 'RESOLVED' AND rk(n.severity) > rk(o.resolved_severity)) THEN 'ACTIVE' ELSE o.status END AS status, coalesce(o.status = 'RESOLVED' AND rk(n.severity) > rk(o.resolved_severity), FALSE) AS again FROM alerts n LEFT JOIN old o USING (cluster_id)".replace("rk(n.severity)", "list_position(['LOW','MEDIUM','HIGH','CRITICAL'], n.severity)").replace("rk(o.resolved_severity)", "list_position(['LOW','MEDIUM','HIGH','CRITICAL'], o.resolved_severity)")),
}


#: Tables that are made once, whatever reads them.
KEPT = ("det", "edges", "cd", "feat", "risk", "move", "master", "alerts")


def sql(select: str, *tables: str) -> str:
    """`select` after the definitions of `tables` and all they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for t in PARTS[name][0]:
                add(t)
            if name == "reach":
                add("det")
            order.append(name)

    for t in tables:
        add(t)
    body = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in KEPT else ''}({PARTS[n][1]})" for n in order)
    return f"WITH RECURSIVE {body}\n{select}" if body else select


def case(k: int) -> str:
    """Of the region that holds a detection its name (0), or whether its day lies in the months listed at `k`."""
    return "CASE " + " ".join(f"WHEN {BOX.format(*r)} THEN " + (f"'{r[0]}'" if k == 0 else f"month(acq_date) IN ({r[k]})") for r in SEASON) + " END"


def any_of(col: str, values: str) -> str:
    return f"upper({col}) IN ({values})"


SEAS = f"""SELECT cluster_id, season_region, CASE WHEN k AND farm AND max_frp > 5 AND NOT still AND classification_label = '{UNK}' THEN '{AGR}' WHEN k AND wood AND max_frp > 15 AND classification_label = '{UNK}' THEN '{FOR}' ELSE classification_label END AS seasonal_label,
{rnd(f"CASE WHEN k AND classification_label = '{AGR}' AND farm THEN least(1.0::DOUBLE, classification_score * 1.2::DOUBLE) WHEN k AND classification_label = '{AGR}' THEN classification_score * 0.8::DOUBLE WHEN k AND classification_label = '{FOR}' AND wood THEN least(1.0::DOUBLE, classification_score * 1.15::DOUBLE) WHEN k AND classification_label = '{FOR}' THEN classification_score * 0.85::DOUBLE WHEN k AND classification_label = '{IND}' AND still AND persistence_category = 'persistent' THEN least(1.0::DOUBLE, classification_score * 1.1::DOUBLE) WHEN k AND farm AND max_frp > 5 AND NOT still AND classification_label = '{UNK}' THEN 0.5::DOUBLE WHEN k AND wood AND max_frp > 15 AND classification_label = '{UNK}' THEN 0.45::DOUBLE ELSE classification_score END", 4)} AS seasonal_score,
CASE WHEN k AND classification_label = '{AGR}' AND farm THEN 0.75::DOUBLE WHEN k AND classification_label = '{AGR}' THEN 1.2 WHEN k AND classification_label = '{FOR}' AND wood THEN 1.0 WHEN k AND classification_label = '{FOR}' THEN 1.3 WHEN k AND classification_label = '{IND}' THEN 1.15 ELSE 1.0 END AS seasonal_risk_modifier
FROM (SELECT *, season_region IS NOT NULL AS k, coalesce(movement_status = 'STATIONARY', FALSE) AS still FROM season)"""
CLOUD = f"""SELECT detection_id, p AS cloud_probability, t AS cloud_type, i AS ir_penetration_factor, {rnd("greatest(0.1::DOUBLE, least(raw * (1.0::DOUBLE - p * 0.5::DOUBLE) * i, 1.0::DOUBLE))", 4)} AS adjusted_confidence, p > 0.7 OR i < 0.3 OR (raw < 0.4 AND p > 0.3) AS cloud_review
FROM (SELECT *, CASE t WHEN 'clear' THEN 1.0::DOUBLE WHEN 'cirrus' THEN 0.7 WHEN 'cumulus' THEN 0.5 WHEN 'stratus' THEN 0.2 WHEN 'cumulonimbus' THEN 0.1 ELSE 0.5 END AS i, CASE confidence WHEN 'l' THEN 0.3::DOUBLE WHEN 'n' THEN 0.6 ELSE 0.9 END AS raw
FROM (SELECT *, least(CASE WHEN bright_ti4 < 280 THEN 0.3::DOUBLE ELSE 0.0 END + CASE WHEN bright_ti5 < 270 THEN 0.3::DOUBLE ELSE 0.0 END + CASE WHEN diff < 15 THEN 0.2::DOUBLE ELSE 0.0 END + CASE WHEN diff < 5 THEN 0.2::DOUBLE ELSE 0.0 END, 1.0::DOUBLE) AS p,
CASE WHEN diff > 15 AND bright_ti4 > 300 THEN 'clear' WHEN diff > 25 AND bright_ti4 > 260 THEN 'cirrus' WHEN diff < 10 AND bright_ti4 < 270 THEN 'cumulonimbus' WHEN diff < 10 THEN 'stratus' WHEN diff < 15 THEN 'cumulus' ELSE 'unknown' END AS t FROM (SELECT *, bright_ti4 - bright_ti5 AS diff FROM det)))"""
LV = ("LOW", "MEDIUM", "HIGH")


def oracle_sql() -> dict[str, str]:
    cnt = lambda col, values: ", ".join(f"count_if({col} = '{v}')::BIGINT AS {col}_{v.lower()}" for v in values)
    none = "'; no verified fire station identified within the search radius -- nearest district fire service should be contacted'"
    ref = f"CASE WHEN station_km IS NOT NULL THEN ' Closest verified fire station: ' || station_name || ' (' || {fixed('station_km', 1)} || ' km away).' ELSE {none} END"
    rank = "list_position(['LOW','MEDIUM','HIGH','CRITICAL'], severity)"
    return {
        "s3_satellite_labels": sql("SELECT CASE WHEN contains(source_file, 'noaa20') THEN 'NOAA-20' ELSE 'NOAA-21' END AS source_satellite, source_file, count(*) AS n FROM dirty GROUP BY ALL", "dirty"),
        "s5_date_chunks": sql("SELECT d::DATE AS chunk_start, least(10, datediff('day', d::DATE, z) + 1)::INT AS chunk_days FROM (SELECT unnest(generate_series(a, z, INTERVAL 10 DAY)) AS d, z FROM (SELECT min(acq_date) AS a, max(acq_date) AS z FROM det))", "det"),
        "s9_s12_nested_features": "SELECT (props->>'$.k')::INT AS k, count(*) AS n FROM events WHERE (props->>'$.k')::INT >= 90 GROUP BY 1",
        "p1_p2_typed": sql("SELECT row_pos, latitude, longitude, acq_time, strftime(date_trunc('minute', acquisition_datetime), '%Y-%m-%d %H:%M') AS stamp, confidence FROM dirty", "dirty"),
        "p3_valid_positions": sql("SELECT satellite, count(*) AS n FROM valid GROUP BY 1", "valid"),
        "w1_without_repeats": sql("SELECT row_pos, detection_id, acq_time, confidence FROM (SELECT *, row_number() OVER (PARTITION BY latitude, longitude, acq_date, acq_time, satellite, instrument ORDER BY source_file, row_pos) AS n FROM valid) WHERE n = 1", "valid"),
        "p4_observation_keys": sql(f"SELECT detection_id, md5(concat_ws('|', {fixed('latitude', 5)}, {fixed('longitude', 5)}, acq_date::VARCHAR, acq_time, satellite))[:16] AS observation_key FROM det", "det"),
        "p5_missing_summary": sql("SELECT unnest(['latitude', 'longitude', 'acq_date', 'frp']) AS \"column\", unnest([count_if(latitude IS NULL), count_if(longitude IS NULL), count_if(acq_date IS NULL), count_if(frp IS NULL)])::BIGINT AS missing FROM dirty", "dirty"),
        "a12_cleaning_report": sql("SELECT i::BIGINT AS input_rows, v::BIGINT AS valid_rows, k AS kept_rows, (i - v)::BIGINT AS invalid_removed, (v - k)::BIGINT AS repeats_removed, round_even(k * 10000.0::DOUBLE / i, 0) / 100.0::DOUBLE AS kept_pct FROM (SELECT count(*) AS i FROM dirty), (SELECT count(*) AS v FROM valid), (SELECT count(*) AS k FROM (SELECT DISTINCT latitude, longitude, acq_date, acq_time, satellite, instrument FROM valid))", "valid"),
        "p18_inside_boundary": sql(f"SELECT acq_date, count(*) AS n FROM det WHERE {crossings()} GROUP BY 1", "det"),
        "a12_boundary_report": sql(f"SELECT count(*) AS input_rows, count_if({crossings()})::BIGINT AS inside_rows FROM det", "det"),
        "j5_neighbour_pairs": sql("SELECT a, b FROM edges", "edges"),
        "j5_neighbour_pairs_exact": sql(f"SELECT l.detection_id AS a, r.detection_id AS b FROM det l JOIN det r ON l.detection_id < r.detection_id AND abs(datediff('day', l.acq_date, r.acq_date)) <= 3 AND abs(l.latitude - r.latitude) < 0.01 AND {hav('l.latitude', 'l.longitude', 'r.latitude', 'r.longitude')} <= 1.0", "det"),
        "a19_clusters": sql("SELECT detection_id, cluster_id FROM cd", "cd"),
        "w8_cluster_numbers": sql("SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS number FROM (SELECT DISTINCT cluster_id FROM cd)", "cd"),
        "a1_cluster_summary": sql("SELECT * EXCLUDE (window_days) FROM summary", "summary"),
        "a2_a3_globals": sql("SELECT (datediff('day', min(acq_date), max(acq_date)) + 1)::INT AS window_days, avg((try_cast(confidence AS DOUBLE) IS NOT NULL)::INT) > 0.5 AS numeric_confidence FROM det", "det"),
        "a4_centroids": sql("SELECT cluster_id, latitude, longitude, first_detection AS acq_date FROM summary", "summary"),
        "a5_daily_centroids": sql(f"SELECT cluster_id, day, {rnd('lat', 5)} AS lat, {rnd('lon', 5)} AS lon, n FROM daily", "daily"),
        "a6_category_counts": sql("SELECT persistence_category, count(*) AS n FROM feat GROUP BY 1", "feat"),
        "d1_features": sql("SELECT cluster_id, bt_diff_mean, bt_diff_max, frp_mean_to_max_ratio, detection_density, active_day_ratio, is_multi_day, is_persistent_candidate, persistence_category_code FROM feat", "feat"),
        "d5_explanations": sql("SELECT cluster_id, abnormality_level, anomaly_characterization, explanation, contributing_factors FROM expl", "expl"),
        "d6_false_alarm": sql("SELECT cluster_id, false_alarm_score, false_alarm_indicator, false_alarm_reasons, detection_reliability FROM fa", "fa"),
        "d7_risk": sql("SELECT cluster_id, risk_score, risk_level, risk_factors, risk_explanation FROM risk", "risk"),
        "d8_risk_evidence": sql("SELECT cluster_id, base_score, reliability_multiplier, risk_score AS final_score, unnest(['abnormality', 'frp', 'persistence', 'intensity']) AS key, unnest([abnormality_points, frp_points, persistence_points, intensity_points]) AS points, unnest([35.0::DOUBLE, 25.0, 20.0, 20.0]) AS max_points FROM risk", "risk"),
        "d9_movement": sql("SELECT * FROM move", "move"),
        "d10_classification": sql("SELECT cluster_id, classification_label, classification_score FROM master", "master"),
        "d11_thermal_alerts": sql("SELECT alert_id, cluster_id, severity, status, evidence_confidence, suppressed, reasons, 'Decision-support thermal anomaly alert. ' || CASE WHEN capped THEN 'Downgraded: high false-alarm concern caps severity at MEDIUM. ' ELSE '' END || reasons || '. Does not constitute a confirmed fire declaration.' AS alert_rationale FROM alerts", "alerts"),
        "d12_operational_alerts": sql(f"SELECT cluster_id, CASE WHEN risk_level = 'HIGH' AND false_alarm_indicator = 'LOW' THEN 'HIGH PRIORITY ALERT' WHEN risk_level = 'HIGH' AND false_alarm_indicator = 'HIGH' THEN 'REVIEW / VERIFICATION' WHEN risk_level IN ('HIGH', 'MEDIUM') THEN 'MONITOR / REVIEW' ELSE 'NO ALERT' END AS alert_priority, CASE WHEN risk_level = 'HIGH' AND false_alarm_indicator = 'LOW' THEN 'Dispatch priority ground verification unit from the nearest operational fire service.' || {ref} WHEN risk_level = 'HIGH' AND false_alarm_indicator = 'HIGH' THEN 'Perform remote verification before ground deployment.' WHEN risk_level IN ('HIGH', 'MEDIUM') THEN 'Monitor thermal activity for escalation.' || {ref} ELSE 'Routine baseline monitoring.' END AS recommended_action FROM master", "master"),
        "d13_eligibility": sql("SELECT cluster_id, starts_with(w, 'Eligible') AS notification_eligible, w AS eligibility_reason FROM (SELECT cluster_id, CASE WHEN severity NOT IN ('CRITICAL', 'HIGH') THEN 'Unsupported alert severity for prototype notification.' WHEN suppressed THEN 'Suppressed alerts cannot send prototype notifications.' WHEN false_alarm_indicator = 'HIGH' THEN 'High false-alarm-concern events require verification before notification.' WHEN false_alarm_indicator <> 'LOW' THEN 'Prototype notification requires LOW false-alarm concern.' WHEN evidence_confidence <> 'HIGH' THEN 'Prototype notification requires HIGH evidence confidence.' WHEN station_km IS NULL THEN 'No verified fire station found within 50 km.' ELSE 'Eligible for operator-confirmed prototype decision-support notification.' END AS w FROM alerts)", "alerts"),
        "d14_d16_seasonal": sql(SEAS, "season"),
        "d17_d18_uncertainty": sql(f"SELECT cluster_id, u AS uncertainty, {rnd('greatest(0.0::DOUBLE, classification_score - u * 0.4::DOUBLE)', 3)} AS ci_low, {rnd('least(1.0::DOUBLE, classification_score + u * 0.4::DOUBLE)', 3)} AS ci_high, u > 0.6 OR classification_score < 0.4 OR (u > 0.3 AND classification_score < 0.6) AS needs_review, ru AS risk_uncertainty, {rnd('greatest(0.0::DOUBLE, risk_score - ru * 20)', 3)} AS risk_ci_low, {rnd('least(100.0::DOUBLE, risk_score + ru * 20)', 3)} AS risk_ci_high, (risk_level = 'HIGH' AND (ru > 0.4 OR false_alarm_indicator = 'HIGH')) OR (risk_level = 'MEDIUM' AND ru > 0.5) OR ru > 0.6 AS risk_needs_review FROM unc0", "unc0"),
        "d19_d36_cloud": sql(CLOUD, "det"),
        "d20_interpolated_linear": sql(f"SELECT cluster_id, d AS day, {rnd('value + (nv - value) * t', 6)} AS value FROM fill", "fill"),
        "d20_interpolated_nearest": sql(f"SELECT cluster_id, d AS day, {rnd('CASE WHEN i <= g // 2 THEN value ELSE nv END', 6)} AS value FROM fill", "fill"),
        "d20_interpolated_spline_cloudy": sql(f"SELECT cluster_id, d AS day, {rnd('value + (nv - value) * (t * t * 3.0::DOUBLE - t * t * t * 2.0::DOUBLE)', 6)} AS value FROM (SELECT fill.*, bool_and(coalesce(cloud_cover > 70, FALSE)) OVER (PARTITION BY cluster_id, fill.day) AS dark FROM fill LEFT JOIN clouds ON clouds.acq_date = fill.d) WHERE dark", "fill", "clouds"),
        "d20_interpolation_quality": sql(f"""SELECT cluster_id, n_original, n_interpolated, CASE WHEN n_original < 2 THEN 1.0::DOUBLE ELSE {rnd(rnd("greatest(0.0::DOUBLE, 1.0::DOUBLE - n_interpolated / (n_original + n_interpolated)::DOUBLE * 0.5::DOUBLE - least(0.3::DOUBLE, longest * 0.1::DOUBLE))", 3) + " * CASE WHEN cover IS NULL OR cover > 70 THEN 1.0::DOUBLE WHEN cover > 50 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END", 6)} END AS quality,
            CASE WHEN n_original < 2 THEN '{TOO_SHORT}' ELSE concat_ws(' | ', CASE WHEN n_interpolated / (n_original + n_interpolated)::DOUBLE > 0.3 THEN 'High interpolation ratio: ' || n_interpolated || '/' || (n_original + n_interpolated) || ' points interpolated' END, large) END AS warnings
            FROM (SELECT cluster_id, count(*) AS n_original, coalesce(max(size), 0) AS longest, coalesce(sum(size) FILTER (dark), 0)::BIGINT AS n_interpolated, sum(covers) FILTER (dark) / sum(size) FILTER (dark) AS cover,
                    string_agg('Large gap between ' || day || ' and ' || next || ' (' || size || ' days)', ' | ' ORDER BY day) FILTER (size > 2) AS large FROM (
                SELECT cluster_id, day, next, CASE WHEN size > 0 THEN size END AS size, (SELECT sum(coalesce(cloud_cover, 50.0)) FROM clouds WHERE acq_date > day AND acq_date < next) AS covers,
                    size BETWEEN 1 AND 3 AND (SELECT count(*) FROM clouds WHERE acq_date > day AND acq_date < next AND cloud_cover > 70) = size AS dark
                FROM (SELECT *, datediff('day', day, next) - 1 AS size FROM (SELECT *, lead(day) OVER (PARTITION BY cluster_id ORDER BY day) AS next FROM series))) GROUP BY cluster_id)""", "series", "clouds"),
        "d22_d23_gap_reasons": sql(f"SELECT cluster_id, d AS day, cc AS cloud_cover, CASE WHEN cc > 70 AND (i = 0 OR i = g - 1) THEN 'cloud_obscured' WHEN cc > 70 THEN 'uncertain' WHEN cc < 30 THEN 'real_gap' ELSE 'uncertain' END AS gap_type, {rnd('(value + nv) / 2.0::DOUBLE', 6)} AS filled_value FROM (SELECT z.*, coalesce(cloud_cover, 50.0) AS cc FROM (SELECT *, (day + (i + 1)::INT)::DATE AS d FROM (SELECT *, unnest(range(0, g)) AS i FROM gaps)) z LEFT JOIN clouds ON clouds.acq_date = z.d)", "gaps", "clouds"),
        "d24_fire_weather": f"SELECT event_id, {rnd('least(100.0::DOUBLE, greatest(0.0::DOUBLE, least(30.0::DOUBLE, greatest(0.0::DOUBLE, (t - 10) * 1.5::DOUBLE)) + least(30.0::DOUBLE, greatest(0.0::DOUBLE, (100 - h) * 0.4::DOUBLE)) + least(25.0::DOUBLE, greatest(0.0::DOUBLE, w * 2.5::DOUBLE)) - least(15.0::DOUBLE, greatest(0.0::DOUBLE, p * 2))))', 2)} AS fire_weather_index FROM (SELECT event_id, value / 10.0::DOUBLE AS t, 100.0::DOUBLE - value / 5.0::DOUBLE AS h, value / 50.0::DOUBLE AS w, (event_id % 7)::DOUBLE AS p FROM events)",
        "d28_event_keys": sql(f"SELECT cluster_id, sha1(concat_ws('|', 'EVK1', upper(f.s), {fixed('f.a', 3)}, {fixed('f.o', 3)}))[:16] AS event_key, observation_count, last_seen FROM keyed", "keyed"),
        "j6_nearest_facility": sql("SELECT cluster_id, facility_id, facility_type, km FROM (SELECT cluster_id FROM feat) LEFT JOIN nf USING (cluster_id)", "nf"),
        "j7_nearest_station": sql("SELECT cluster_id, station_id, station_name, km FROM (SELECT cluster_id FROM feat) LEFT JOIN ns USING (cluster_id)", "ns"),
        "j7_stations_ranked": sql(f"SELECT cluster_id, n::INT AS rank, station_id, {rnd('km', 2)} AS km FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY km, station_id) AS n FROM (SELECT cluster_id, station_id, {hav('latitude', 'longitude', 'station_lat', 'station_lon')} AS km FROM feat, stations) WHERE km < 100.0) WHERE n <= 5", "feat", "stations"),
        "j9_scene_match": sql("SELECT cluster_id, scene_id, cloud FROM (SELECT cluster_id, scene_id, cloud, row_number() OVER (PARTITION BY cluster_id ORDER BY cloud, scene_id) AS n FROM feat JOIN (SELECT p_partkey AS scene_id, DATE '2024-01-01' + (p_partkey % 30)::INT AS scene_date, p_size * 2 AS cloud, 8.0::DOUBLE + ((p_partkey * 53) % 250) * 0.1::DOUBLE AS a, 70.0::DOUBLE + ((p_partkey * 71) % 250) * 0.1::DOUBLE AS o FROM part WHERE p_size * 2 <= 60) ON latitude BETWEEN a AND a + 1 AND longitude BETWEEN o AND o + 1 AND abs(datediff('day', first_detection, scene_date::DATE)) <= 5) WHERE n = 1", "feat"),
        "j1_j4_detections_with_results": sql("SELECT risk_level, satellite, count(*) AS n FROM cd LEFT JOIN (SELECT cluster_id, risk_level FROM risk) USING (cluster_id) GROUP BY ALL", "cd", "risk"),
        "j12_unseen": sql(f"SELECT detection_id FROM det l WHERE acq_date >= DATE '2024-01-21' AND NOT EXISTS (SELECT 1 FROM det r WHERE r.acq_date < DATE '2024-01-21' AND {fixed('r.latitude', 3)} = {fixed('l.latitude', 3)} AND {fixed('r.longitude', 3)} = {fixed('l.longitude', 3)} AND r.satellite = l.satellite)", "det"),
        "j13_cloud_join": sql("SELECT acq_date, n, coalesce(cloud_cover, 50.0) AS cloud_cover FROM (SELECT acq_date, count(*) AS n FROM det GROUP BY 1) LEFT JOIN clouds USING (acq_date)", "clouds"),
        "a7_statistics": sql(f"SELECT count(*) AS clusters, {cnt('risk_level', LV)}, {cnt('false_alarm_indicator', LV)}, {cnt('abnormality_level', ('NORMAL', 'ELEVATED', 'HIGH'))}, {cnt('movement_status', ('MOVING', 'STATIONARY', 'INSUFFICIENT_DATA'))} FROM alerts", "alerts"),
        "a8_crosstab": sql("SELECT coalesce(abnormality_level, 'All') AS abnormality_level, coalesce(risk_level, 'All') AS risk_level, count(*) AS n FROM risk GROUP BY CUBE (abnormality_level, risk_level)", "risk"),
        "a9_ranges": sql(f"SELECT min(risk_score) AS least, max(risk_score) AS most, {mean3('risk_score')} AS mean, max(CASE WHEN movement_status = 'MOVING' THEN total_movement_distance_km END) AS farthest FROM master", "master"),
        "a10_alert_counts": sql("SELECT " + ", ".join(f"count_if(severity = '{s}')::BIGINT AS {s.lower()}" for s in (*LV, "CRITICAL")) + ", count_if(suppressed)::BIGINT AS suppressed, count_if(contains(classification_label, 'Industrial'))::BIGINT AS industrial, count_if(station_km IS NOT NULL)::BIGINT AS with_station FROM alerts", "alerts"),
        "a11_analytics": sql(f"SELECT persistence_category, count(*) AS n, {mean3('mean_frp')} AS avg_frp, max(max_frp) AS peak_frp, {mean3('(CASE WHEN movement_status = ' + chr(39) + 'MOVING' + chr(39) + ' THEN movement_rate_km_per_day END)')} AS avg_rate FROM master GROUP BY 1", "master"),
        "a13_uncertainty_rollup": sql(f"SELECT risk_level, {mean3('u')} AS mean, max(u) AS most, count_if(u > 0.3)::BIGINT AS uncertain, count(*) AS n FROM unc0 GROUP BY 1", "unc0"),
        "a14_monthly": sql(f"""SELECT *, CASE WHEN region = 'Unknown' THEN '{NO_SEASON}' ELSE concat_ws(' | ', CASE WHEN many_in_farm_season THEN '{FARM_ADVICE}' END, CASE WHEN any_in_forest_season THEN '{FOREST_ADVICE}' END) END AS recommendations FROM (
            SELECT region, month, n AS detection_count, farm AS is_agricultural_burning_season, wood AS is_forest_fire_season, sum(n) OVER (PARTITION BY region)::BIGINT AS total_detections,
                coalesce(bool_or(farm AND n > 5) OVER (PARTITION BY region), FALSE) AS many_in_farm_season, coalesce(bool_or(wood AND n > 0) OVER (PARTITION BY region), FALSE) AS any_in_forest_season FROM (
                SELECT coalesce(r, 'Unknown') AS region, CASE WHEN r IS NOT NULL THEN month(acq_date)::INT END AS month, count(*) AS n, any_value(farm) AS farm, any_value(wood) AS wood FROM (SELECT *, {case(0)} AS r, {case(5)} AS farm, {case(6)} AS wood FROM det) GROUP BY 1, 2))""", "det"),
        "a15_cloud_correlation": sql("""SELECT cluster_id, (SELECT count(*) FROM clouds) AS total_days_analyzed, count(DISTINCT cd.acq_date) AS days_with_detections, (SELECT count(*) FROM clouds WHERE cloud_cover > 70) AS high_cloud_days, (SELECT count(*) FROM clouds WHERE cloud_cover <= 70) AS low_cloud_days,
            (SELECT count(*) FROM clouds WHERE cloud_cover > 70) - count(DISTINCT CASE WHEN cloud_cover > 70 THEN cd.acq_date END) AS potential_cloud_obscured_days FROM cd LEFT JOIN clouds USING (acq_date) GROUP BY cluster_id""", "cd", "clouds"),
        "a16_daily_max": sql("SELECT * FROM series", "series"),
        "a17_quantiles": sql(f"SELECT {rnd('quantile_cont(max_frp, 0.5)', 6)} AS frp_median, {rnd('quantile_cont(max_frp, 0.25)', 6)} AS frp_q1, {rnd('quantile_cont(max_frp, 0.75)', 6)} AS frp_q3, {rnd('quantile_cont(max_bright_ti4, 0.5)', 6)} AS ti4_median FROM feat", "feat"),
        "a20_a21_max_and_distinct": sql("SELECT max(cluster_id) AS max_id, count(DISTINCT cluster_id) AS clusters FROM cd", "cd"),
        "a22_evaluation": "SELECT quality AS actual, (n_chars >= 1000)::INT AS predicted, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL",
        "a22_scores": f"SELECT {rnd('ok * 1.0::DOUBLE / n', 6)} AS accuracy, {rnd('tp * 1.0::DOUBLE / said', 6)} AS \"precision\", {rnd('tp * 1.0::DOUBLE / pos', 6)} AS recall, {rnd('2.0::DOUBLE * (tp * 1.0::DOUBLE / said) * (tp * 1.0::DOUBLE / pos) / ((tp * 1.0::DOUBLE / said) + (tp * 1.0::DOUBLE / pos))', 6)} AS f1 FROM (SELECT count(*) AS n, count_if(y = p)::BIGINT AS ok, count_if(y = 1 AND p = 1)::BIGINT AS tp, sum(y) AS pos, sum(p) AS said FROM (SELECT quality AS y, (n_chars >= 1000)::INT AS p FROM labels JOIN documents USING (doc_id)))",
        "a23_rate_by_type": sql("SELECT persistence_category, round_even(count_if(abnormality_level <> 'NORMAL') * 1000.0::DOUBLE / count(*), 0)::BIGINT AS per_mille FROM feat GROUP BY 1", "feat"),
        "o1_top_risk": sql("SELECT cluster_id, risk_score, risk_level FROM risk ORDER BY risk_score DESC, cluster_id LIMIT 10", "risk"),
        "o1_top_movers": sql("SELECT cluster_id, movement_rate_km_per_day, movement_direction FROM move WHERE movement_status = 'MOVING' ORDER BY movement_rate_km_per_day DESC, cluster_id LIMIT 10", "move"),
        "o2_o3_alert_order": sql(f"SELECT alert_id, severity, risk_score FROM alerts ORDER BY {rank} DESC, coalesce(risk_score, -1) DESC, cluster_id LIMIT 50", "alerts"),
        "o5_o6_page": sql("SELECT cluster_id, risk_level, risk_score FROM risk WHERE risk_level IN ('MEDIUM', 'HIGH') ORDER BY cluster_id LIMIT 25 OFFSET 50", "risk"),
        "o7_relevance": "SELECT n_name, CASE WHEN lower(n_name) = 'an' THEN 0 WHEN starts_with(lower(n_name), 'an') THEN 1 ELSE 2 END AS relevance FROM nation WHERE contains(lower(n_name), 'an')",
        "o9_sample": sql("SELECT cluster_id FROM feat ORDER BY md5(cluster_id::VARCHAR), cluster_id LIMIT 5", "feat"),
        "p6_p8_events_filter": sql("SELECT cluster_id, risk_level, classification_label, first_detection FROM master WHERE risk_level IN ('HIGH', 'MEDIUM') AND false_alarm_indicator IN ('LOW', 'MEDIUM') AND regexp_matches(lower(classification_label), 'industr|agric') AND first_detection BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'", "master"),
        "p9_facets": sql("SELECT risk_level, persistence_category, count(*) AS n FROM master WHERE risk_level IN ('HIGH', 'MEDIUM') AND persistence_category IN ('isolated', 'persistent') GROUP BY ALL", "master"),
        "p10_search": sql("SELECT cluster_id, anomaly_characterization FROM expl WHERE contains(lower(concat_ws(' ', cluster_id::VARCHAR, anomaly_characterization, contributing_factors, explanation)), 'persist')", "expl"),
        "p11_p12_lookup": sql("SELECT cluster_id, latitude, longitude, risk_score, risk_level, false_alarm_indicator, persistence_category FROM risk ORDER BY cluster_id LIMIT 1", "risk"),
        "p13_p14_defaults": sql("SELECT cluster_id, coalesce(facility_type, '') AS facility_type, coalesce(facility_km, 999.0) AS facility_km, coalesce(station_km, -1.0) AS station_km FROM master", "master"),
        "p15_popups": sql("SELECT alert_id, severity FROM alerts WHERE NOT suppressed AND severity IN ('HIGH', 'CRITICAL')", "alerts"),
        "p16_reliable_directions": sql("SELECT cluster_id, direction, direction_confidence_score FROM move WHERE movement_status = 'MOVING' AND direction_available AND direction_confidence IN ('MODERATE', 'HIGH')", "move"),
        "p17_prohibited_terms": sql("SELECT count(*) AS n, count_if(contains(lower(reasons), 'confirmed fire'))::BIGINT AS prohibited FROM alerts", "alerts"),
        "api_map_data": sql(f"""SELECT cluster_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || ({rnd('longitude', 5)})::DECIMAL(9,5) || ',' || ({rnd('latitude', 5)})::DECIMAL(9,5) || ']}},"properties":{{"cluster_id":' || cluster_id || ',"risk_score":' || risk_score::DECIMAL(6,2) || ',"risk_level":"' || risk_level || '","abnormality_level":"' || abnormality_level || '","false_alarm_indicator":"' || false_alarm_indicator || '","classification_label":"' || classification_label || '","movement_status":"' || movement_status || '"}}}}' AS feature FROM master""", "master"),
        "u5_factor_union": sql("SELECT cluster_id, CASE WHEN list_contains(string_split(lower(contributing_factors), ','), lower(persistence_category)) THEN replace(contributing_factors, ',', ';') ELSE replace(contributing_factors, ',', ';') || ';' || persistence_category END AS factors FROM expl", "expl"),
        "u1_u3_union_distinct": sql("SELECT DISTINCT floor(station_lat)::BIGINT AS a, floor(station_lon)::BIGINT AS o FROM stations UNION SELECT floor(facility_lat)::BIGINT, floor(facility_lon)::BIGINT FROM facilities", "stations", "facilities"),
        "u4_remaining": sql("SELECT cluster_id FROM alerts WHERE severity = 'LOW'", "alerts"),
        "masked_phones": "SELECT c_custkey, CASE WHEN length(d) <= 4 THEN '****' ELSE repeat('*', length(d) - 4) || right(d, 4) END AS phone FROM (SELECT c_custkey, '+91' || CASE WHEN c_custkey % 9 < length((c_custkey * 7919 % 100000)::VARCHAR) THEN left((c_custkey * 7919 % 100000)::VARCHAR, (c_custkey % 9)::INT) ELSE lpad((c_custkey * 7919 % 100000)::VARCHAR, (c_custkey % 9)::INT, '0') END AS d FROM customer)",
        "d30_alert_sync": sql("SELECT cluster_id, severity, status, CASE WHEN status = 'RESOLVED' THEN severity END AS resolved_severity FROM sync", "sync"),
        "d30_alert_history": sql("SELECT * FROM (SELECT cluster_id, 'REOPENED' AS change, before AS old_status, status AS new_status, was AS old_severity, severity AS new_severity FROM sync WHERE again UNION ALL SELECT cluster_id, 'SEVERITY_CHANGED', before, status, was, severity FROM sync WHERE was <> severity)", "sync"),
        "d30_transitions": sql("SELECT cluster_id, severity, CASE WHEN cluster_id % 4 = 0 AND status = 'ACTIVE' THEN 'ACKNOWLEDGED' ELSE status END AS status, resolved_severity FROM old", "old"),
    }
