"""Rules and operators of the detection side, on small frames with known results."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotspan.functions import scalar
from hotspan.operators import anomaly, cleaning, context, features, graph, lifecycle, rules, spatial
from hotspan.streaming import ingest

DET = "detection_id long, latitude double, longitude double, acq_date date, acquisition_datetime timestamp, bright_ti4 double, bright_ti5 double, frp double, confidence string, satellite string"


def det(i, lat, lon, day, ti4=330.0, ti5=290.0, frp=5.0, conf="n", hour=6):
    t = dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)
    return (i, lat, lon, t.date(), t, ti4, ti5, frp, conf, "NOAA-20")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_geodesy(spark):
    assert 110 < value(spark, scalar.haversine(*map(F.lit, (0.0, 0.0, 1.0, 0.0)))) < 112
    assert abs(value(spark, scalar.haversine(*map(F.lit, (28.6139, 77.2090, 19.0760, 72.8777)))) - 1148) < 30
    assert abs(value(spark, scalar.bearing(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))) - 90) < 1e-9
    assert value(spark, scalar.compass(F.lit(359.0))) == "N" and value(spark, scalar.compass(F.lit(134.0))) == "SE"
    lat, lon = scalar.destination(F.lit(0.0), F.lit(0.0), F.lit(90.0), 111.195)
    assert abs(value(spark, lon) - 1) < 1e-4 and abs(value(spark, lat)) < 1e-9


def test_text_helpers(spark):
    assert value(spark, scalar.padded_time(F.lit("7"))) == "0007" and value(spark, scalar.padded_time(F.lit("12345"))) == "12345"
    assert value(spark, scalar.clean(F.lit(" UNKNOWN "))) == "" and value(spark, scalar.clean(F.lit(None).cast("string"))) == ""
    assert value(spark, scalar.masked_phone(F.lit("+91 98765-43210"))) == "*********3210" and value(spark, scalar.masked_phone(F.lit("12"))) == "****"
    assert value(spark, scalar.fixed(F.lit(-1.005), 2)) == "-1.00" and value(spark, scalar.number(F.lit("nan"))) is None
    assert value(spark, scalar.rounded(F.lit(0.125), 2)) == 0.12


def test_cleaning(spark):
    cols = "latitude string, longitude string, acq_date string, acq_time string, satellite string, confidence string, source_file string, row_pos long"
    rows = [("10.0", "20.0", "2024-01-01", "630", "N", "H ", "b", 1), ("10.0", "20.0", "2024-01-01", "0630", "N", "h", "a", 2), ("999", "20", "2024-01-01", "1", "N", "l", "a", 3), ("1", None, "x", "1", "N", "l", "a", 4), ("1", "-200", "2024-01-01", "1", "N", "l", "a", 5)]
    raw = spark.createDataFrame(rows, cols)
    got = cleaning.clean(raw).collect()
    assert [(r.row_pos, r.acq_time, r.confidence) for r in got] == [(2, "0630", "h")]
    assert got[0].acquisition_datetime == dt.datetime(2024, 1, 1, 6, 30)
    report = cleaning.cleaning_report(raw).first()
    assert (report.input_rows, report.valid_rows, report.kept_rows, report.repeats_removed) == (5, 2, 1, 1)
    with pytest.raises(ValueError, match="Missing required"):
        cleaning.typed(raw.drop("latitude"))
    with pytest.raises(ValueError):
        cleaning.date_chunks(spark, "2024-02-01", "2024-01-01", 5)
    assert [r.chunk_days for r in cleaning.date_chunks(spark, "2024-01-01", "2024-01-30", 10).collect()] == [10, 10, 10]


def test_clusters_are_those_of_all_pairs(spark):
    """Against all pairs in plain Python: a place with many repeats, chains over cells and days, rows without a place or day."""
    rng = np.random.default_rng(4)
    rows = [det(i, 20.0 + int(rng.integers(0, 60)) * 0.003, 75.0 + int(rng.integers(0, 60)) * 0.003, int(rng.integers(0, 20))) for i in range(300)]
    rows += [det(1000 + i, 20.05, 75.05, i % 2) for i in range(200)] + [det(1300, 64.0, -0.0, 3), det(1301, 64.0, 0.0, 5), det(1302, float("nan"), 75.0, 1), det(1303, float("nan"), 75.0, 1)]
    rows += [(1304, None, 75.0, *det(0, 0, 0, 0)[3:]), (1305, None, 75.0, *det(0, 0, 0, 0)[3:]), (1306, 20.05, 75.05, None, *det(0, 0, 0, 0)[4:])]
    got = {r.detection_id: r.cluster_id for r in spatial.clustered(spark.createDataFrame(rows, DET).repartition(5)).select("detection_id", "cluster_id").collect()}
    known = [r for r in rows if r[1] is not None and r[3] is not None and not math.isnan(r[1])]
    top = {r[0]: r[0] for r in rows}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            x1, y1, x2, y2 = map(math.radians, (a[1], a[2], b[1], b[2]))
            h = math.sin((x2 - x1) / 2) ** 2 + math.cos(x1) * math.cos(x2) * math.sin((y2 - y1) / 2) ** 2
            if abs((a[3] - b[3]).days) <= 3 and 2 * 6371.0088 * math.asin(math.sqrt(h)) <= 1.0:
                top[max(root(a[0]), root(b[0]))] = min(root(a[0]), root(b[0]))
    assert got == {r[0]: root(r[0]) for r in rows}
    assert len(set(got.values())) > 20 and got[1199] == got[1000] and got[1301] == 1300 and got[1303] == 1303 and got[1305] == 1305


def test_clusters(spark):
    chain = [det(i, 20.0, 75.0 + 0.001 * i, i) for i in range(8)]
    apart = [det(20, 21.0, 75.0, 0), det(21, 21.0, 75.0, 9), det(22, 25.0, 75.0, 0)]
    got = spatial.clustered(spark.createDataFrame(chain + apart, DET))
    ids = {r.detection_id: r.cluster_id for r in got.select("detection_id", "cluster_id").collect()}
    assert {ids[i] for i in range(8)} == {0} and ids[20] == 20 and ids[21] == 21 and ids[22] == 22
    s = {r.cluster_id: r for r in features.derived(features.summaries(got)).collect()}
    assert s[0].persistence_category == "persistent" and s[0].active_days == 8 and s[20].persistence_category == "isolated"
    assert sum(r.observation_count for r in s.values()) == 11 and s[0].bt_diff_max == 40.0 and s[0].detection_density == 1.0


def test_pairs_at_high_latitudes(spark):
    far = spark.createDataFrame([det(1, 70.0, 10.0, 0), det(2, 70.0, 10.02, 0)], DET)
    assert spatial.neighbour_pairs(far).count() == 0 and spatial.neighbour_pairs(far, exact=True).count() == 1


def test_components_do_not_depend_on_row_order(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70)]
    a = sorted(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    b = sorted(map(tuple, graph.components(spark.createDataFrame(edges[::-1], "a long, b long")).collect()))
    assert a == b and dict(a)[30] == 0 and dict(a)[100] == 50


def test_polygon(spark):
    ring = [(68.0, 6.0), (97.0, 6.0), (97.0, 36.0), (68.0, 36.0)]
    rows = spark.createDataFrame([("delhi", 28.6, 77.2), ("beijing", 39.9, 116.4), (None, None, None)], "n string, latitude double, longitude double")
    assert [r.n for r in rows.where(spatial.inside(F.col("latitude"), F.col("longitude"), ring)).collect()] == ["delhi"]


def test_nearest(spark):
    left = spark.createDataFrame([(1, 20.0, 75.0), (2, 60.0, 75.0), (3, None, None)], "cluster_id long, latitude double, longitude double")
    places = spark.createDataFrame([(7, "b", 20.1, 75.0), (5, "a", 20.1, 75.0), (9, "c", 59.9, 75.6)], "station_id long, station_name string, station_lat double, station_lon double")
    got = {r.cluster_id: (r.station_id, r.km) for r in spatial.nearest(left, places, "cluster_id", "station", 50.0).collect()}
    assert got[1] == (5, 11.12) and got[2][0] == 9 and got[3] == (None, None)


BASE = dict(cluster_id=1, abnormality_level="HIGH", max_frp=25.0, mean_frp=12.0, active_days=5, duration_days=6, persistence_category="persistent", max_bright_ti4=355.0, bt_diff_max=55.0, observation_count=9, mean_confidence=2.8, false_alarm_indicator="LOW", detection_reliability="HIGH")


def one(spark, f, **change):
    row = BASE | change
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", type(None): "double"}
    return f(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()))).first()


def test_risk(spark):
    assert one(spark, rules.risk).risk_score == 100.0
    mid = one(spark, rules.risk, abnormality_level="ELEVATED", max_frp=12.0, persistence_category="short_lived_repeated", active_days=2, max_bright_ti4=336.0, bt_diff_max=36.0, false_alarm_indicator="HIGH")
    assert mid.risk_score == 31.0 and mid.risk_level == "MEDIUM"
    low = one(spark, rules.risk, abnormality_level="NORMAL", max_frp=1.0, persistence_category="isolated", active_days=1, max_bright_ti4=300.0, bt_diff_max=10.0, false_alarm_indicator="MEDIUM")
    assert low.risk_score == 10.2 and low.risk_level == "LOW"
    with pytest.raises(ValueError, match="Missing required"):
        rules.risk(spark.range(1))
    e = one(spark, lambda d: rules.risk(d).select("*", rules.risk_evidence(d).alias("e")))
    assert sum(c.points for c in e.e.components) * e.e.reliability_multiplier == e.risk_score == e.e.final_score


def test_false_alarm_and_explanation(spark):
    bad = one(spark, lambda d: rules.false_alarm(d.drop("false_alarm_indicator", "detection_reliability")), observation_count=1, active_days=1, duration_days=1, mean_confidence=1.0, max_frp=1.0, bt_diff_max=10.0, max_bright_ti4=300.0, persistence_category="isolated")
    assert bad.false_alarm_indicator == "HIGH" and "single point observation" in bad.false_alarm_reasons
    assert one(spark, lambda d: rules.false_alarm(d.drop("false_alarm_indicator", "detection_reliability"))).false_alarm_indicator == "LOW"
    assert one(spark, rules.explained).anomaly_characterization == "MULTI_FACTOR_ANOMALY"
    assert one(spark, rules.explained, abnormality_level="NORMAL").contributing_factors == "none"
    odd = one(spark, rules.explained, max_frp=1.0, mean_frp=1.0, active_days=1, duration_days=1, max_bright_ti4=300.0, bt_diff_max=5.0)
    assert odd.anomaly_characterization == "STATISTICAL_ANOMALY" and odd.contributing_factors == "multivariate_combination"


def test_classes_and_guards(spark):
    near = dict(facility_type="refinery", facility_km=0.5, total_movement_distance_km=0.1)
    assert one(spark, rules.classified, movement_status="STATIONARY", **near).classification_label.startswith("Industrial")
    assert not one(spark, rules.classified, movement_status="MOVING", **near).classification_label.startswith("Industrial")
    assert one(spark, rules.classified, movement_status="MOVING", total_movement_distance_km=3.0, persistence_category="short_lived_repeated", active_days=3, bt_diff_max=20.0, max_bright_ti4=320.0).classification_label.startswith("Forest")


def test_alerts(spark):
    extra = dict(classification_label="Unknown / Insufficient Evidence", classification_score=0.0, direction="", direction_confidence="", station_name="", station_km=None)
    make = lambda **c: one(spark, lambda d: rules.thermal_alerts(rules.risk(d).withColumn("direction", F.lit(None).cast("string"))), **extra, **c)
    top = make()
    assert top.severity == "CRITICAL" and top.alert_id == "TAL-00001" and top.alert_rationale.endswith("Does not constitute a confirmed fire declaration.")
    hushed = make(false_alarm_indicator="HIGH", detection_reliability="LOW")
    assert hushed.suppressed and hushed.severity == "LOW"
    capped = make(false_alarm_indicator="HIGH", detection_reliability="MEDIUM")
    assert not capped.suppressed and capped.evidence_confidence == "MODERATE" and capped.severity in ("LOW", "MEDIUM")


def test_movement(spark):
    step = [det(i, 20.0 + 0.02 * i, 75.0, i) for i in range(6)]
    back = [det(10 + i, 30.0 + 0.02 * (i % 2), 80.0, i) for i in range(4)]
    rows = spark.createDataFrame([(*r, 1) for r in step] + [(*r, 2) for r in back] + [(*det(30, 10.0, 75.0, 0), 3)] + [(*det(40 + i, 40.0 + i, 75.0, 2 * i), 4) for i in range(2)], DET + ", cluster_id long")
    got = {r.cluster_id: r for r in features.movement(rows).collect()}
    assert got[1].direction == "N" and got[1].direction_confidence == "HIGH" and got[1].direction_confidence_score >= 90
    assert got[2].movement_pattern == "erratic" and got[2].direction is None
    assert got[3].movement_status == "INSUFFICIENT_DATA"
    assert abs(got[4].movement_rate_km_per_day - 55.6) < 0.1 and got[4].direction_confidence == "PRELIMINARY"


def test_alert_lifecycle(spark):
    old = spark.createDataFrame([(1, "LOW", "RESOLVED", "LOW"), (2, "LOW", "ACKNOWLEDGED", None), (3, "HIGH", "ACTIVE", None), (5, "HIGH", "RESOLVED", "HIGH")], "cluster_id long, severity string, status string, resolved_severity string")
    fresh = spark.createDataFrame([(1, "HIGH"), (2, "LOW"), (4, "LOW"), (5, "LOW")], "cluster_id long, severity string")
    snapshot, history = lifecycle.synced(old, fresh)
    got = {r.cluster_id: (r.status, r.resolved_severity) for r in snapshot.collect()}
    assert got == {1: ("ACTIVE", None), 2: ("ACKNOWLEDGED", None), 4: ("ACTIVE", None), 5: ("RESOLVED", "LOW")}
    assert sorted((r.cluster_id, r.change) for r in history.collect()) == [(1, "REOPENED"), (1, "SEVERITY_CHANGED"), (5, "SEVERITY_CHANGED")]
    again, told = lifecycle.synced(snapshot, fresh)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, snapshot.collect())) and told.count() == 0
    ids = spark.createDataFrame([(1,), (5,)], "cluster_id long")
    assert {r.cluster_id: r.status for r in lifecycle.moved(snapshot, ids, "ACKNOWLEDGED").collect()} == {1: "ACKNOWLEDGED", 2: "ACKNOWLEDGED", 4: "ACTIVE", 5: "RESOLVED"}


def test_gaps(spark):
    rows = [(1, dt.date(2024, 1, 1), 10.0), (1, dt.date(2024, 1, 3), 20.0), (1, dt.date(2024, 1, 9), 0.0)]
    series = spark.createDataFrame(rows, "cluster_id long, day date, value double")
    assert [tuple(r) for r in context.interpolated(series).collect()] == [(1, dt.date(2024, 1, 2), 15.0)]
    clouds = spark.createDataFrame([(dt.date(2024, 1, 2), 90.0), (dt.date(2024, 1, 5), 10.0)], "acq_date date, cloud_cover double")
    got = {r.day.day: r.gap_type for r in context.gap_reasons(series, clouds).collect()}
    assert got[2] == "cloud_obscured" and got[5] == "real_gap" and got[6] == "uncertain"


def test_forest_finds_outliers_and_survives_missing_values(spark):
    rows = [(i, *(float(j + i % 7) for j in range(10))) for i in range(200)] + [(1000, *[500.0] * 10), (1001, *[-400.0] * 10), (1002, math.inf, math.nan, None, *[3.0] * 7)]
    df = spark.createDataFrame(rows, "cluster_id long, " + ", ".join(f"{c} double" for c in anomaly.FEATURES))
    got = {r.cluster_id: r for r in anomaly.scored(df).collect()}
    assert len(got) == 203 and got[1000].abnormality_level == got[1001].abnormality_level == "HIGH"
    assert {r.abnormality_level for r in got.values()} <= {"HIGH", "ELEVATED", "NORMAL"}
    assert anomaly.scored(df.limit(0)).count() == 0


def plain_outliers(spark, df, most):
    """(score, flag, level) by cluster, every tree walked row by row; the threshold is that of all rows."""
    rows = anomaly.scaled(df, anomaly.scales(df)).select("cluster_id", "x").orderBy(F.xxhash64("cluster_id"), "cluster_id").collect()
    x = np.array([r.x for r in rows])
    trees = anomaly.forest(x[:most])

    def odd(v):
        total = 0.0
        for t in trees:
            at, depth = 0, 0
            while t[at][0] >= 0:
                at, depth = t[at][2] if v[t[at][0]] <= t[at][1] else t[at][3], depth + 1
            total += depth + float(anomaly.expected(np.array([t[at][4]]))[0])
        return 2.0 ** (-total / len(trees) / float(anomaly.expected(np.array([trees[0][0][4]]))[0]))

    odds = [odd(v) for v in x]
    cut = float(np.quantile(odds, 0.95))
    return {r.cluster_id: (o - cut, int(o > cut), "HIGH" if o > cut else "ELEVATED" if o - cut > -0.05 else "NORMAL") for r, o in zip(rows, odds, strict=True)}


def same_outliers(got, want):
    assert got.keys() == want.keys()
    for k, (score, flag, level) in want.items():
        assert abs(got[k].anomaly_score - score) < 1e-4
        if min(abs(score), abs(score + 0.05)) > 1e-9:
            assert (got[k].anomaly_flag, got[k].abnormality_level) == (flag, level)


def test_outlier_threshold_is_that_of_all_rows(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, *rng.normal(size=10).tolist()) for i in range(400)], "cluster_id long, " + ", ".join(f"{c} double" for c in anomaly.FEATURES))
    got = {r.cluster_id: r for r in anomaly.scored(df, most=40).collect()}
    same_outliers(got, plain_outliers(spark, df, 40))
    assert sum(r.anomaly_flag for r in got.values()) == 20


def test_a_query_runs_the_forest_over_all_clusters(spark):
    from hotspan.plans import master, queries

    d = "/root/testdata/sf0.001"
    got = {r.cluster_id: r for r in queries.queries()["d4_outlier_scores"](spark, d).collect()}
    same_outliers(got, plain_outliers(spark, master.featured(spark, d), 20_000))


def test_stream_drops_repeats_across_batches(spark, tmp_path):
    header = ",".join(ingest.RAW.fieldNames())
    line = lambda lat, time: f"{lat},75.0,330,1,1,2024-01-02,{time},N20,n,290,5"
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "firms_noaa20_a.csv").write_text("\n".join([header, line(20.0, 630), line(20.0, "0630"), line(999, 1)]))
    (folder / "other.csv").write_text("\n".join([header, line(50.0, 1)]))
    seen = []
    go = lambda: ingest.run(ingest.raw_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "state"), lambda b, n: seen.append(b.count())).awaitTermination()
    go()
    (folder / "firms_noaa20_b.csv").write_text("\n".join([header, line(20.0, 630), line(21.0, 700)]))
    go()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.latitude for r in rows) == [20.0, 21.0] and {r.source_satellite for r in rows} == {"NOAA-20"} and sum(seen) == 2


def test_repeats_are_told_by_the_instrument_and_not_by_the_confidence(spark):
    row = ("10.0", "80.0", "2024-01-05", "930", "N", "NOAA-20", "VIIRS", "a.csv", 1)
    rows = [row, (*row[:4], "H", *row[5:8], 2), (*row[:6], "MODIS", "a.csv", 3)]
    raw = spark.createDataFrame(rows, "latitude string, longitude string, acq_date string, acq_time string, confidence string, satellite string, instrument string, source_file string, row_pos long")
    assert sorted(r.row_pos for r in cleaning.clean(raw).collect()) == [1, 3]
    report = cleaning.cleaning_report(raw).first()
    assert (report.kept_rows, report.repeats_removed) == (2, 1)
    # a feed without the column: the rest tells
    assert sorted(r.row_pos for r in cleaning.clean(raw.drop("instrument")).collect()) == [1]


@pytest.mark.parametrize(("days", "early"), [(1, 1), (2, 2), (3, 2), (4, 3)])
def test_nearest_takes_the_earlier_value_up_to_the_middle_day(spark, days, early):
    series = spark.sql(f"select 1L as cluster_id, date'2024-01-01' as day, 1.0D as value union all select 1L, date_add(date'2024-01-01', {days + 1}), 9.0D")
    got = [r.value for r in context.interpolated(series, "nearest", most=9).orderBy("day").collect()]
    assert got == [1.0] * early + [9.0] * (days - early)


def test_noise_of_features_counts_in_the_uncertainty(spark):
    x = spark.sql("select 0.9D as classification_score, 5 as observation_count, 0.0D as cloud, 1.0D as completeness, 'LOW' as risk_level, 'LOW' as false_alarm_indicator, 10.0D as risk_score, 4.0D as f, cast(null as double) as g, double('nan') as h, 1.0D as i")
    base = 0.1 * 0.3
    for features, noise in (((), 0.5), (("i",), 0.0), (("f", "i"), 0.15), (("f", "g", "h", "i"), 0.3 / 4 + 0.7 / 2)):
        assert context.uncertainty(x, features).first().uncertainty == pytest.approx(base + 0.2 * noise, abs=1e-6)
