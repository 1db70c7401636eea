"""Seasonal reports, clouds, quantiles, stored models, cycle status and notices against their rules."""

import datetime as dt
import random

import numpy as np
import pytest

from hotspan.operators import anomaly, cleaning, context, quantiles
from hotspan.sources import models, versions
from hotspan.streaming import ingest, notices, status


def test_a_seasonal_report_counts_months_and_recommends(spark):
    day = lambda m: dt.date(2024, m, 3) if m else None
    north, south, outside = (30.0, 75.0), (10.0, 78.0), (50.0, 10.0)
    rows = [(*north, day(10))] * 6 + [(*north, day(1)), (*north, None)] + [(*south, day(3))] * 5 + [(*south, day(7))] + [(*outside, day(3))] * 2
    got = {(r.region, r.month): r for r in context.seasonal_report(spark.createDataFrame(rows, "latitude double, longitude double, acq_date date")).collect()}
    assert set(got) == {("north_india", 10), ("north_india", 1), ("south_india", 3), ("south_india", 7), ("Unknown", None)}
    r = got["north_india", 10]
    assert (r.detection_count, r.is_agricultural_burning_season, r.is_forest_fire_season, r.total_detections, r.recommendations) == (6, True, False, 8, context.FARM_ADVICE)
    # five in a burning month are not over five; one in a month of forest fires is enough
    assert got["south_india", 7].recommendations == context.FOREST_ADVICE and got["south_india", 3].is_agricultural_burning_season
    assert (got["Unknown", None].detection_count, got["Unknown", None].recommendations) == (2, context.NO_SEASON)


def test_cloudy_days_without_a_detection(spark):
    start = dt.date(2024, 1, 1)
    clouds = spark.createDataFrame([(start + dt.timedelta(k), c) for k, c in enumerate((90.0, 71.0, 70.0, 10.0, None))], "acq_date date, cloud_cover double")
    seen = spark.createDataFrame([(1, start), (1, start), (1, start + dt.timedelta(3)), (2, start + dt.timedelta(40))], "cluster_id long, acq_date date")
    by = {r.cluster_id: tuple(r)[1:] for r in context.cloud_correlation(seen, clouds).collect()}
    assert by == {1: (5, 2, 2, 3, 1), 2: (5, 1, 2, 3, 2)}
    days = [(r.has_detection, r.cloud_obscuration_likely, r.cloud_cover) for r in context.cloud_days(seen, clouds).orderBy("acq_date").collect()]
    assert days == [(True, False, 90.0), (False, True, 71.0), (False, False, 70.0), (True, False, 10.0), (False, False, 50.0)]


def test_noise_is_told_by_distance_from_the_median(spark):
    x = spark.createDataFrame([(float(v),) for v in (100, 101, 102, 103, 104, 300)] + [(None,)], "f double")
    got = [r.std_f for r in anomaly.standardised(x, anomaly.scales(x, ("f",))).orderBy("f").collect()]
    low, mid, high = np.quantile([100, 101, 102, 103, 104, 300], [0.25, 0.5, 0.75])
    assert got[0] is None and got[1:] == pytest.approx([(v - mid) / (high - low) for v in (100, 101, 102, 103, 104, 300)])
    assert sum(abs(v) > 3 for v in got[1:]) == 1


@pytest.mark.parametrize("buckets", [2, 1024])
def test_quantiles_are_exact(spark, monkeypatch, buckets):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    rnd = random.Random(11)
    rows = [(rnd.gauss(0, 1), float(rnd.randrange(3)), rnd.choice([1e-300, 1e300, -1e300, 5.0]), 7.0, None, rnd.choice([float("nan"), float("inf"), 1.5, None])) for _ in range(301)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = quantiles.exact(df, df.columns, shares)
    for k, c in enumerate(df.columns):
        known = [r[k] for r in rows if r[k] is not None and np.isfinite(r[k])]
        assert got[c] == ([None] * 5 if not known else pytest.approx(np.quantile(known, shares).tolist(), rel=1e-12))
    assert quantiles.exact(df.limit(0), ["a"], (0.5,)) == {"a": [None]}


def test_a_stored_model_scores_the_same_bits(spark, tmp_path):
    rnd = random.Random(12)
    rows = [(k, *[rnd.gauss(0, 1) for _ in anomaly.FEATURES]) for k in range(200)]
    df = spark.createDataFrame(rows, "cluster_id long, " + ", ".join(f"{c} double" for c in anomaly.FEATURES))
    path = str(tmp_path / "m")
    with pytest.raises(ValueError):
        models.load(spark, path)
    made = anomaly.fitted(df)
    models.save(spark, made, path)
    models.save(spark, anomaly.Model(made.by, made.trees[:1], 0.25), path)
    assert models.load(spark, path, 1) == made and models.load(spark, path).cut == 0.25
    assert sorted(map(tuple, anomaly.judged(df, models.load(spark, path, 1)).collect())) == sorted(map(tuple, anomaly.scored(df).collect()))


def test_download_windows_follow_the_days(spark):
    days = spark.createDataFrame([(dt.date(2024, 2, 27),), (dt.date(2024, 3, 9),), (None,)], "acq_date date")
    assert sorted(map(tuple, cleaning.range_chunks(days, 5).collect())) == [(dt.date(2024, 2, 27), 5), (dt.date(2024, 3, 3), 5), (dt.date(2024, 3, 8), 2)]
    assert cleaning.range_chunks(days.limit(0), 5).count() == 0


def test_a_stream_tells_how_its_cycles_went(spark, tmp_path):
    import time

    header = ",".join(ingest.RAW.fieldNames())
    line = lambda lat, day="2024-01-02": f"{lat},75.0,330,1,1,{day},0630,N20,n,290,5"
    folder, told = tmp_path / "in", status.Cycles()
    folder.mkdir()
    spark.streams.addListener(told)
    try:
        cycles = ((("noaa20", [line(20.0), line(20.0), line(999)]), ("noaa21", [line(21.0)])), (("noaa20", [line(22.0)]), ("noaa21", ["broken", "?,?"])), (("noaa20", [line(30.0, "soon")]),))
        for k, files in enumerate(cycles):
            for name, lines in files:
                (folder / f"firms_{name}_{k}.csv").write_text("\n".join([header, *lines]))
            ingest.run(status.watched(ingest.raw_stream(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        for _ in range(100):
            if len(told.records) >= 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(told)
    assert [(r["status"], r["fetched"], r["rejected"], r["new"], r["duplicates"]) for r in told.records] == [("healthy", 4, 1, 2, 1), ("degraded", 3, 2, 1, 0), ("failed", 1, 1, 0, 0)]
    assert told.records[1]["error"] == "NOAA-21: no usable row"


def test_notices_are_told_once(spark, tmp_path):
    store = str(tmp_path / "n")
    df = lambda *rows: spark.createDataFrame(list(rows), "alert_id string, severity string, status string")
    ids = lambda x: sorted(r.alert_id for r in x.collect())
    a, b, c, low = ("a", "HIGH", "ACTIVE"), ("b", "CRITICAL", "ACTIVE"), ("c", "HIGH", "RESOLVED"), ("d", "LOW", "ACTIVE")
    assert ids(notices.poll(df(a), store, 0)) == []
    assert ids(notices.poll(df(a, b, b, c, low), store, 1)) == ["b"]
    assert notices.poll(df(a, b), store, 1) is None
    # what was seen while it was not to be told stays untold
    assert ids(notices.poll(df(a, b, ("c", "HIGH", "ACTIVE"), ("e", "HIGH", "ACTIVE")), store, 2)) == ["e"]
    assert versions.live(spark, f"{store}/seen")["batch"] == 2


def test_notices_follow_a_stream_over_restarts(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "n")
    schema = "alert_id string, severity string, status string"
    for rows in ([("a", "HIGH", "ACTIVE")], [("a", "HIGH", "ACTIVE"), ("b", "HIGH", "ACTIVE")], [("b", "HIGH", "ACTIVE"), ("c", "CRITICAL", "ACTIVE")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        notices.follow(spark.readStream.schema(schema).parquet(folder), store, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.alert_id for r in spark.read.schema(schema).parquet(f"{store}/told").collect()) == ["b", "c"]


def test_the_quality_of_a_filled_series(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    series = [(1, day(0)), (1, day(2)), (1, day(3)), (2, day(0)), (3, day(0)), (3, day(4)), (3, day(5)), (4, day(0)), (4, day(2)), (4, day(4)), (5, day(0)), (5, day(1))]
    df = spark.createDataFrame([(c, d, 1.0) for c, d in series], "cluster_id long, day date, value double")
    got = {r.cluster_id: tuple(r)[1:] for r in context.interpolation_quality(df).collect()}
    assert got[1] == (3, 1, 0.775, []) and got[2] == (1, 0, 1.0, [context.TOO_SHORT]) and got[5] == (2, 0, 1.0, [])
    assert got[3] == (3, 3, 0.45, ["High interpolation ratio: 3/6 points interpolated", "Large gap between 2024-01-01 and 2024-01-05 (3 days)"])
    assert got[4] == (3, 2, 0.7, ["High interpolation ratio: 2/5 points interpolated"])
    clouds = spark.createDataFrame([(day(1), 80.0), (day(2), 100.0), (day(3), 60.0)], "acq_date date, cloud_cover double")
    dark = {r.cluster_id: tuple(r)[1:3] + (round(r.quality, 6),) for r in context.interpolation_quality(df, clouds=clouds).collect()}
    assert dark[1] == (3, 1, 0.775) and dark[4] == (3, 1, round(1 - 0.25 * 0.5 - 0.1, 3)) and dark[3] == (3, 0, 0.7)
    grey = {r.cluster_id: round(r.quality, 6) for r in context.interpolation_quality(df, clouds=clouds, cloudy=50.0).collect()}
    # the filled days of 4 have 80 and 60 per cent, so 70 on average, which is not over 70
    assert grey[4] == round(0.7 * 0.9, 6)
