"""No table that grows with the input is broadcast while clusters are made: such joins ran out of the driver's memory."""

from datetime import date, datetime

from hotspan.operators import context, features, graph, spatial


def recorded(monkeypatch, *modules):
    """The final plans of what is checkpointed from now on."""
    plans, plain = [], graph.checkpoint

    def noted(df):
        out = plain(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    for m in modules:
        monkeypatch.setattr(m, "checkpoint", noted)
    return plans


def test_components_broadcast_nothing(spark, monkeypatch):
    plans = recorded(monkeypatch, graph)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9], "a long, b long")
    got = {tuple(r) for r in graph.components(edges).collect()}
    assert got == {(i, i // 10 * 10) for i in range(40)}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_clusters_broadcast_nothing(spark, monkeypatch):
    plans = recorded(monkeypatch, graph, spatial)
    rows = [(i, 10.0 + i // 2 * 0.005, 75.0, date(2024, 1, 1)) for i in range(8)] + [(8, 20.0, 75.0, date(2024, 1, 1)), (9, None, 75.0, date(2024, 1, 1))]
    points = spark.createDataFrame(rows, "detection_id long, latitude double, longitude double, acq_date date")
    out = spatial.clustered(points)
    assert {tuple(r) for r in out.select("detection_id", "cluster_id").collect()} == {(i, 0) for i in range(8)} | {(8, 8), (9, 9)}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_nearest_places_broadcast_nothing(spark):
    points = spark.createDataFrame([(i, 10.0 + i * 0.005, 75.0) for i in range(8)], "cluster_id long, latitude double, longitude double")
    places = spark.createDataFrame([(1, 10.001, 75.0), (2, 10.031, 75.0)], "facility_id long, facility_lat double, facility_lon double")
    out = spatial.nearest(points, places, "cluster_id", "facility", 1.0)
    assert {(r.cluster_id, r.facility_id) for r in out.collect()} == {(0, 1), (1, 1), (2, None), (3, None), (4, None), (5, 2), (6, 2), (7, 2)}
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_movement_and_cloudy_gaps_broadcast_no_clusters(spark):
    at = lambda day: datetime(2024, 1, day)
    seen = spark.createDataFrame([(c, at(day), 10.0, 75.0 + 0.02 * day) for c in (1, 2) for day in (1, 3, 5)], "cluster_id long, acquisition_datetime timestamp, latitude double, longitude double")
    moved = features.movement(seen)
    assert {(r.cluster_id, r.observation_count, r.movement_status) for r in moved.collect()} == {(1, 3, "MOVING"), (2, 3, "MOVING")}
    series = spark.createDataFrame([(c, date(2024, 1, day), float(day)) for c in (1, 2) for day in (1, 3, 5)], "cluster_id long, day date, value double")
    clouds = spark.createDataFrame([(date(2024, 1, 2), 90.0), (date(2024, 1, 4), 10.0)], "acq_date date, cloud_cover double")
    filled, quality = context.interpolated(series, clouds=clouds), context.interpolation_quality(series, clouds=clouds)
    assert {tuple(r) for r in filled.collect()} == {(c, date(2024, 1, 2), 2.0) for c in (1, 2)}
    assert {(r.cluster_id, r.n_original, r.n_interpolated) for r in quality.collect()} == {(1, 3, 1), (2, 3, 1)}
    for df in (moved, filled, quality):  # the days of the clouds are few and may be broadcast
        assert not [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in line and "cluster_id" in line]
