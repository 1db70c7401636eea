"""Payloads of services made into rows, on small awkward texts."""

import datetime as dt
import json

from hotspan.sources import payloads

HEAD = "latitude,longitude,acq_date,acq_time,satellite,confidence,frp"


def test_feeds_with_codes_quotes_and_missing_columns(spark):
    texts = [
        (1, f"\n{HEAD}\r\n20.5,75,2024-01-02,5, n20 ,N,1.5\n\n91,75,2024-01-02,5,N20,n,1\nx,75,2024-01-02,5,N20,n,1\n-90,180,2024-01-02,1205,\"NPP\",\"h\"\n"),
        (2, "longitude,latitude\n1,2"), (3, None), (4, "  \n "), (5, HEAD),
        (6, "frp,latitude,longitude,acq_date,acq_time,satellite,instrument\n\"1,5\",1,2,2024-01-01,12345,Other, MODIS "),
    ]
    rows, failures = payloads.feed(spark.createDataFrame(texts, "id int, text string"))
    got = sorted((r.id, r.latitude, r.longitude, r.acq_time, r.satellite, r.instrument, r.confidence, r.frp) for r in rows.collect())
    assert got == [(1, -90.0, 180.0, "1205", "SUOMI-NPP", "VIIRS", "h", None), (1, 20.5, 75.0, "0005", "NOAA-20", "VIIRS", "n", "1.5"), (6, 1.0, 2.0, "12345", "Other", "MODIS", "", "1,5")]
    assert [tuple(r) for r in failures.collect()] == [(2, "FIRMS CSV missing required columns: acq_date, acq_time, satellite")]


def test_weather_arrays_of_unlike_length(spark):
    daily = {"time": ["2024-01-01", "soon", "2024-01-03", "2024-01-04"], "cloud_cover_mean": [10.0, 1.0, None], "temperature_2m_mean": [1.5]}
    texts = [("a", json.dumps({"daily": daily})), ("b", "no json"), ("c", None), ("d", "{}"), ("e", json.dumps({"daily": {"time": ["2024-02-01"]}}))]
    got = [tuple(r) for r in payloads.weather(spark.createDataFrame(texts, "place string, text string")).orderBy("place", "day").collect()]
    day = lambda m, d: dt.date(2024, m, d)
    assert got == [("a", day(1, 1), 10.0, 1.5, None), ("a", day(1, 3), None, None, None), ("a", day(1, 4), 50.0, None, None), ("e", day(2, 1), 50.0, None, None)]


def test_stations_once_by_type_and_id(spark):
    tile = lambda *elements: json.dumps({"elements": list(elements)})
    node = {"type": "node", "id": 1, "lat": 10.12345678, "lon": 70.0, "tags": {"name": "First"}}
    texts = [
        (2, tile(node | {"tags": {"name": "Later"}}, {"type": "way", "id": 1, "center": {"lat": 5, "lon": 6}, "tags": {"short_name": "FS"}})),
        (1, tile({"type": "node", "id": 3}, node, node | {"tags": {"name": "Repeat"}}, {"id": 4, "lat": 1, "lon": 2})), (3, "broken"), (4, None),
    ]
    got = sorted(tuple(r) for r in payloads.stations(spark.createDataFrame(texts, "tile int, text string")).collect())
    assert got == [("node", 1, "First", 10.123457, 70.0), ("node", 4, payloads.UNNAMED, 1.0, 2.0), ("way", 1, "FS", 5.0, 6.0)]


def test_the_latest_row_before_a_day(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    right = [("a", day(k), float(k)) for k in (0, 5, 6, 20)] + [("a", day(5), 4.0), ("b", day(7), 7.0), (None, day(7), 1.0)]
    left = [("a", day(k), k) for k in range(25)] + [("b", day(6), 100), ("a", day(6), 6), (None, day(7), 101)]
    got = sorted(((r.k, r.day_of, r.v) for r in payloads.as_of(spark.createDataFrame(left, "place string, day date, k int"), spark.createDataFrame(right, "place string, day date, v double"), ["place"], "day", 3).collect()), key=repr)

    def want(place, d, k):
        known = [(x, v) for p, x, v in right if p == place and place is not None and 0 <= (d - x).days <= 3]
        return (k, max(x for x, _ in known), min(v for x, v in known if x == max(y for y, _ in known))) if known else (k, None, None)

    assert got == sorted((want(*x) for x in left), key=repr)
