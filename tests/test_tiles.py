"""Answers of a map service by tiles, quarters of failed tiles, and what points know from them."""

import json

from pyspark.sql import functions as F

from hotspan.operators import tiles

ANSWERS = "level int, tx long, ty long, code int, error string, body string"


def body(*places):
    return json.dumps({"elements": [{"type": "node", "id": k, "lat": lat, "lon": lon} for k, lat, lon in places]})


def test_outcomes_of_questions(spark):
    rows = [(200, None, body((1, 2.0, 3.0))), (200, None, body()), (200, None, "{}"), (200, None, "<html>"), (200, None, None), (504, None, body()), (None, None, None), (None, "Read timed out.", None), (None, "connection refused", None)]
    df = spark.createDataFrame(rows, "code int, error string, body string")
    got = [r.x for r in df.select(tiles.answer_status(F.col("code"), F.col("error"), F.col("body")).alias("x")).collect()]
    assert got == ["found", "not_found", "not_found", "parse_error", "parse_error", "http_error", "http_error", "timeout", "network_error"]


def test_a_failed_tile_has_the_outcome_of_its_quarters(spark):
    quarters = lambda tx, ty, *codes: [(1, 2 * tx + k // 2, 2 * ty + k % 2, *c) for k, c in enumerate(codes)]
    ok, fails, none = (200, None, body((5, 20.1, 75.1))), (504, None, None), (200, None, body())
    rows = [(0, 1, 1, *ok), (0, 2, 1, *none), (0, 3, 1, *fails), (0, 4, 1, *fails), (0, 5, 1, *fails), (0, 6, 1, *fails), (0, -1, -1, *fails)]
    rows += quarters(3, 1, ok, ok, fails, none) + quarters(4, 1, none, none, none, none) + quarters(5, 1, none, fails, none, none) + quarters(-1, -1, none, none, none, none) + quarters(1, 1, fails, fails, fails, fails)
    states, elements = tiles.answered(spark.createDataFrame(rows, ANSWERS))
    assert {(r.tx, r.ty): r.status for r in states.collect()} == {(1, 1): "found", (2, 1): "not_found", (3, 1): "found", (4, 1): "not_found", (5, 1): "unavailable", (6, 1): "unavailable", (-1, -1): "not_found"}
    assert sorted((r.tx, r.facility_id) for r in elements.collect()) == [(1, 5), (3, 5)]


def test_points_know_the_nearest_or_why_not(spark):
    at = lambda lat, lon: (int(lat // 0.5), int(lon // 0.5))
    rows = [(0, *at(20.1, 75.1), 200, None, body((7, 20.1, 75.1), (8, 20.105, 75.1), (9, None, 75.1))), (0, *at(21.1, 75.1), 200, None, body()), (0, *at(22.1, 75.1), 504, None, None)]
    points = [(1, 20.101, 75.1), (2, 20.3, 75.3), (3, 21.1, 75.1), (4, 22.1, 75.1), (5, 23.1, 75.1), (6, None, 75.1), (7, 20.1, float("nan"))]
    got = {r.cluster_id: (r.facility_id, r.osm_query_status) for r in tiles.context(spark.createDataFrame(points, "cluster_id long, latitude double, longitude double"), spark.createDataFrame(rows, ANSWERS)).collect()}
    assert got == {1: (7, "found"), 2: (None, "not_found"), 3: (None, "not_found"), 4: (None, "unavailable"), 5: (None, "disabled"), 6: (None, "missing_coords"), 7: (None, "missing_coords")}
