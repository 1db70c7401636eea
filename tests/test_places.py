"""GeoJSON features, points in polygons and scenes against direct rules."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from hotspan.operators import polygons
from hotspan.sources import geojson

SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
HOLE = [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]


def shape(kind, coordinates, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


def put(tmp_path, *features, name="f.json"):
    path = tmp_path / name
    path.write_text(json.dumps({"type": "FeatureCollection", "features": list(features)}, indent=1))
    return str(path)


def box(west, south, size):
    return [[[west, south], [west + size, south], [west + size, south + size], [west, south + size], [west, south]]]


def test_features_of_files_of_any_kind(spark, tmp_path):
    path = put(tmp_path, shape("Polygon", [SQUARE, HOLE], ISO3="IND", id="a"), shape("MultiPolygon", [box(20, 0, 5), box(30, 0, 5)], ISO3="NPL"), {"type": "Feature", "id": "p", "properties": None, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "id": "n", "properties": {}, "geometry": None})
    got = geojson.features(spark, path)
    assert [(r.feature_id, r.kind) for r in got.collect()] == [("a", "Polygon"), (None, "MultiPolygon"), ("p", "Point"), ("n", None)]
    assert [r.feature_id for r in geojson.having(got, "ISO3", "IND").collect()] == ["a"]
    with pytest.raises(ValueError):
        geojson.having(got, "ISO3", "XXX")
    sizes = got.select(F.size(geojson.edges_of(F.flatten(geojson.polygons(F.col("kind"), F.col("coordinates"))))).alias("n")).collect()
    assert [r.n for r in sizes] == [4, 4, None, None] or [r.n for r in sizes] == [4, 4, -1, -1]
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join([json.dumps(shape("Polygon", [SQUARE], id=str(k))) for k in range(3)] + ["no json", "", "[]"]))
    assert sorted(r.feature_id for r in geojson.features(spark, str(lines), whole=False).collect()) == ["0", "1", "2"]


def test_points_in_holes_parts_and_overlaps(spark, tmp_path):
    path = put(tmp_path, shape("Polygon", [SQUARE, HOLE], id="a"), shape("MultiPolygon", [box(20, 0, 5), box(30, 0, 5)], id="b"), shape("Polygon", box(1, 1, 2), id="c"), shape("Polygon", [SQUARE[:-1]], id="open"))
    cut = polygons.slabs(geojson.features(spark, path))
    rows = [(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 4.0, 22.0), (4, 4.0, 27.0), (5, 4.0, 33.0), (6, None, 5.0), (7, 5.0, None), (8, 11.0, 5.0), (9, -0.1, 5.0), (1, 2.0, 2.0)]
    points = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    got = sorted((r.id, r.feature_id) for r in polygons.within(points, cut).collect())
    assert got == [(1, "a")] * 2 + [(1, "c")] * 2 + [(1, "open")] * 2 + [(2, "open"), (3, "b"), (5, "b")]
    assert sorted(r.id for r in polygons.inside(points, cut).collect()) == [1, 1, 2, 3, 5]
    assert polygons.inside(points.limit(0), cut).count() == 0 and polygons.inside(points, cut.limit(0)).count() == 0


def test_many_corners_by_the_rule_of_odd_crossings(spark, tmp_path):
    rnd = random.Random(9)
    ring = [(rnd.uniform(-3, 3), rnd.uniform(-3, 3)) for _ in range(40)]  # crosses itself
    cut = polygons.slabs(geojson.features(spark, put(tmp_path, shape("Polygon", [[list(p) for p in ring]], id="x"))), height=0.1)
    points = [(i, rnd.uniform(-3.5, 3.5), rnd.uniform(-3.5, 3.5)) for i in range(400)]

    def inside(y, x):
        out = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                out = not out
        return out

    got = polygons.inside(spark.createDataFrame(points, "id long, latitude double, longitude double"), cut, height=0.1)
    assert sorted(r.id for r in got.collect()) == [i for i, y, x in points if inside(y, x)]


def test_the_report_of_a_boundary(spark, tmp_path):
    cut = polygons.slabs(geojson.features(spark, put(tmp_path, shape("Polygon", [SQUARE], id="a"))))
    day = dt.date(2024, 1, 5)
    rows = [(1.0, 1.0, day, "NOAA-20"), (2.0, 2.0, day + dt.timedelta(1), "NOAA-21"), (50.0, 1.0, day, "NOAA-20")]
    points = spark.createDataFrame(rows, "latitude double, longitude double, acq_date date, satellite string")
    r = polygons.boundary_report(points, cut).first()
    assert (r.input_records, r.records_inside, r.records_excluded, r.percentage_retained, r.noaa20_count, r.noaa21_count, r.first_day) == (3, 2, 1, 66.67, 1, 1, day)
    none = polygons.boundary_report(points.limit(0), cut).first()
    assert (none.input_records, none.records_inside, none.percentage_retained, none.first_day) == (0, 0, 0.0, None)


def item(name, when, cloud, west, south, size):
    props = {"datetime": when} | ({} if cloud is None else {"eo:cloud_cover": cloud})
    return {"type": "Feature", "id": name, "properties": props, "geometry": {"type": "Polygon", "coordinates": box(west, south, size)}}


def test_scenes_of_every_size_are_found_within_the_window(spark, tmp_path):
    rnd = random.Random(10)
    start = dt.date(2024, 1, 1)
    items = [(f"s{k}", start + dt.timedelta(rnd.randrange(40)), rnd.choice([None, 5.0, 10.5, 30.0, 31.0, 80.0]), rnd.uniform(60, 80), rnd.uniform(0, 30), rnd.choice([0.01, 0.3, 1.0, 3.0, 20.0, 100.0])) for k in range(60)]
    path = put(tmp_path, *[item(n, f"{d}T05:00:00Z", *rest) for n, d, *rest in items], item("bad", "soon", 1.0, 0, 0, 400), {"type": "Feature", "id": "none", "properties": {"datetime": "2024-01-01"}, "geometry": None})
    found = polygons.scenes(geojson.features(spark, path))
    assert found.count() == 60
    points = [(k, rnd.uniform(0, 40), rnd.uniform(60, 90), start + dt.timedelta(rnd.randrange(40))) for k in range(80)]
    got = {r.cluster_id: r for r in polygons.matched(spark.createDataFrame(points, "cluster_id long, latitude double, longitude double, day date"), found).collect()}
    told = set()
    for k, lat, lon, day in points:
        may = [(100.0 if c is None else c, n) for n, d, c, w, s, size in items if abs((d - day).days) <= 5 and w <= lon < w + size and s <= lat < s + size]
        r = got[k]
        assert r.n_scenes == len(may)
        if not may:
            assert (r.satellite_item_id, r.cloud_cover, r.observation_status) == ("none", 100.0, polygons.NONE_FOUND)
            continue
        cloud, name = min(may)
        assert (r.satellite_item_id, r.cloud_cover) == (name, cloud)
        assert r.observation_status == (polygons.FOUND if cloud <= 30 else f"Sentinel-2 observation available but obscured by cloud cover (best: {cloud:.1f}%, threshold: 30.0%)")
        assert (r.image_date is None) == (cloud > 30)
        told.add(cloud <= 30)
    assert told == {True, False}


def test_scenes_of_one_footprint_and_day_meet_a_point_once(spark, tmp_path, monkeypatch):
    start, met = dt.date(2024, 1, 1), []
    items = [item(f"s{k:03}", f"{start + dt.timedelta(k % 3)}T05:00:00Z", float(40 - k % 40), 70, 10, 2.0) for k in range(240)]
    found = polygons.scenes(geojson.features(spark, put(tmp_path, *items, item("later", "2024-02-01", 1.0, 70, 10, 2.0))))
    covering = polygons.covering
    monkeypatch.setattr(polygons, "covering", lambda *a: met.append(covering(*a)) or met[-1])
    for most in (8 << 20, 0):  # broadcast and not
        monkeypatch.setattr(polygons, "BROADCAST", most, raising=False)
        points = spark.createDataFrame([(k, 11.0, 70.5 + k / 4, start) for k in range(8)], "cluster_id long, latitude double, longitude double, day date")
        got = {r.cluster_id: (r.satellite_item_id, r.cloud_cover, r.n_scenes, r.image_date) for r in polygons.matched(points, found).collect()}
        assert got == {k: ("s039", 1.0, 240, f"{start}T05:00:00Z") if k < 6 else ("none", 100.0, 0, None) for k in range(8)}
        assert met[-1].count() == 6 * 3
