"""Named queries over payloads of services that are written from the tables as text, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tiles
from ..sources import adapter, payloads
from . import master as m
from . import oracles as o
from .queries import Query

C = F.col


def feeds(spark, d):
    """A CSV payload for each satellite and day, with codes for satellites, quoted and broken cells; every tenth one lacks a column."""
    x = adapter.dirty_detections(spark, d).where("row_pos < 100000000")
    code = F.when(C("detection_id") % 3 == 0, F.when(C("satellite") == "NOAA-20", "n20").otherwise(" N21")).when(C("detection_id") % 3 == 1, F.when(C("satellite") == "NOAA-20", "N20").otherwise("n21 ")).otherwise(F.concat(F.lit('"'), "satellite", F.lit('"')))
    cell = lambda c: F.coalesce(C(c), F.lit(""))
    line = F.concat_ws(",", cell("latitude"), cell("longitude"), "acq_date", "acq_time", code, "confidence", "frp")
    some = x.groupBy("satellite", "acq_date").agg(F.array_join(F.sort_array(F.collect_list(line)), "\r\n").alias("rows"))
    bad = F.dayofmonth(C("acq_date").cast("date")) % 10 == 0
    head = F.when(bad, "latitude,longitude,acq_date,acq_time,code,confidence,frp").otherwise("latitude, longitude,acq_date,acq_time,satellite,confidence,frp")
    return some.select(F.concat_ws("_", "satellite", "acq_date").alias("payload"), F.concat(head, F.lit("\r\n"), C("rows"), F.lit("\r\n")).alias("text"))


def s7_feed_rows(spark, d):
    rows, _ = payloads.feed(feeds(spark, d))
    return rows.groupBy("payload", "satellite", "confidence", "instrument").agg(F.count("*").alias("n"), F.min("acq_time").alias("first_time"), F.max("latitude").alias("most_north"))


def s7_feed_failures(spark, d):
    return payloads.feed(feeds(spark, d))[1]


def forecasts(spark, d):
    """A payload of daily weather for each supplier's nation: days of the orders, arrays of unlike length."""
    x = adapter.read(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    per = x.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("(datediff(day, date'2024-01-01') + place) % 3 <> 0")
    n = F.expr("datediff(day, date'2024-01-01')")
    each = per.withColumns({"n": n, "cloud": ((n * 37 + C("place") * 11) % 101).cast("double")})
    days = each.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("day", "cloud", (C("n") * 1.5).cast("double").alias("t")))).alias("d"))
    texts = F.concat(F.transform("d", lambda r: r["day"].cast("string")), F.array(F.lit("soon")))
    return days.select("place", F.to_json(F.struct(F.struct(texts.alias("time"), F.transform(F.slice("d", F.lit(1), F.size("d") - C("place")), lambda r: r["cloud"]).alias("cloud_cover_mean"), F.transform("d", lambda r: r["t"]).alias("temperature_2m_mean")).alias("daily"))).alias("text"))


def s13_weather_days(spark, d):
    return payloads.weather(forecasts(spark, d))


def s13_weather_as_of(spark, d):
    """Detections of each place and day with the latest weather of that place, at most one day old."""
    x = adapter.detections(spark, d).select("detection_id", (C("detection_id") % 5).cast("int").alias("place"), C("acq_date").alias("day"))
    got = payloads.as_of(x, payloads.weather(forecasts(spark, d)), ["place"], "day", 1)
    return got.groupBy("place", "day", "day_of", "cloud_cover", "temperature_2m").agg(F.count("*").alias("n"))


def s11_map_stations(spark, d):
    """Stations of overlapping tiles of map elements, each once."""
    s = adapter.stations(spark, d).withColumn("k", C("station_id") % 7)
    place = F.when(C("k") == 0, F.lit("{}")).when(C("k") <= 2, F.concat(F.lit('{"center":{"lat":'), C("station_lat").cast("string"), F.lit(',"lon":'), C("station_lon").cast("string"), F.lit("}}"))).otherwise(F.concat(F.lit('{"lat":'), C("station_lat").cast("string"), F.lit(',"lon":'), C("station_lon").cast("string"), F.lit("}")))
    tags = F.when(C("k") == 3, '{"name":"","short_name":"short"}').when(C("k") == 4, "{}").otherwise(F.to_json(F.struct(C("station_name").alias("name"))))
    element = F.concat(F.expr("left(p, length(p) - 1)"), F.when(C("p") == "{}", "").otherwise(","), F.lit('"type":"'), F.when(C("k") == 6, "way").otherwise("node"), F.lit('","id":'), C("station_id").cast("string"), F.lit(',"tags":'), "t", F.lit("}"))
    rows = s.withColumn("p", place).withColumn("t", tags).withColumn("e", element).withColumn("tile", F.explode(F.array(F.floor("station_lat"), F.floor("station_lat") + 1)))
    tiles = rows.groupBy("tile").agg(F.array_join(F.sort_array(F.collect_list("e")), ",").alias("e"))
    return payloads.stations(tiles.select("tile", F.concat(F.lit('{"elements":['), "e", F.lit("]}")).alias("text")))


def tile_answers(spark, d):
    """What a map service says about the tiles that have clusters: a seventh was not asked, a seventh fails and is asked in quarters, of which a third fails."""
    size, margin = F.lit(tiles.TILE), tiles.MARGIN
    at = m.featured(spark, d).select(tiles.tile(C("latitude")).alias("tx"), tiles.tile(C("longitude")).alias("ty")).distinct().withColumn("k", (C("tx") * 31 + C("ty") * 17) % 7).where("k <> 1")
    ends = F.array(F.lit(0), F.lit(1))
    half = at.where("k = 0").withColumn("i", F.explode(ends)).withColumn("j", F.explode(ends)).select(F.lit(1).alias("level"), (C("tx") * 2 + C("i")).alias("tx"), (C("ty") * 2 + C("j")).alias("ty"), (size / 2).alias("s"))
    asked = at.select(F.lit(0).alias("level"), "tx", "ty", size.alias("s")).unionByName(half)
    bad = F.when(C("level") == 0, (C("tx") * 31 + C("ty") * 17) % 7 == 0).otherwise((C("tx") * 13 + C("ty") * 7) % 3 == 0)
    f = adapter.facilities(spark, d)
    # A facility is told by each tile and quarter whose question reaches it: those of the four corners of its surroundings.
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-margin, margin) for b in (-margin, margin)])
    near = f.withColumn("c", F.explode(corners)).withColumn("s", F.explode(F.array(size, size / 2)))
    dealt = near.select("s", F.floor((C("facility_lat") + C("c.a")) / C("s")).cast("long").alias("tx"), F.floor((C("facility_lon") + C("c.b")) / C("s")).cast("long").alias("ty"), "facility_id", "facility_lat", "facility_lon").distinct()
    element = F.format_string('{"type":"node","id":%s,"lat":%s,"lon":%s}', C("facility_id").cast("string"), C("facility_lat").cast("string"), C("facility_lon").cast("string"))
    texts = dealt.groupBy("s", "tx", "ty").agg(F.array_join(F.sort_array(F.collect_list(element)), ",").alias("t"))
    x = asked.join(texts, ["s", "tx", "ty"], "left").withColumn("bad", bad)
    return x.select("level", "tx", "ty", F.when(C("bad"), 504).otherwise(200).alias("code"), F.lit(None).cast("string").alias("error"), F.when(~C("bad"), F.concat(F.lit('{"elements":['), F.coalesce("t", F.lit("")), F.lit("]}"))).alias("body"))


def s10_facility_context(spark, d):
    """The nearest facility of each cluster, or why none is known, from the answers about its tile."""
    return tiles.context(m.featured(spark, d), tile_answers(spark, d))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (s7_feed_rows, s7_feed_failures, s13_weather_days, s13_weather_as_of, s11_map_stations, s10_facility_context)}


def oracle_sql() -> dict[str, str]:
    days = """w0 AS (SELECT *, datediff('day', DATE '2024-01-01', day) AS k FROM (SELECT DISTINCT ts::DATE AS day FROM events), (SELECT unnest([0, 1, 2, 3, 4]) AS place)),
        w AS (SELECT place::INT AS place, day, CASE WHEN row_number() OVER (PARTITION BY place ORDER BY day DESC) <= place THEN 50.0::DOUBLE ELSE ((k * 37 + place * 11) % 101)::DOUBLE END AS cloud_cover, k * 1.5::DOUBLE AS temperature_2m FROM w0 WHERE (k + place) % 3 <> 0)"""
    reach = lambda s: f"floor((facility_lat - {tiles.MARGIN}) / {s})::BIGINT <= tx AND floor((facility_lat + {tiles.MARGIN}) / {s})::BIGINT >= tx AND floor((facility_lon - {tiles.MARGIN}) / {s})::BIGINT <= ty AND floor((facility_lon + {tiles.MARGIN}) / {s})::BIGINT >= ty"
    far = o.hav("latitude", "longitude", "facility_lat", "facility_lon")
    context = f"""fac AS (SELECT p_partkey AS facility_id, {o.FLAT} AS facility_lat, {o.FLON} AS facility_lon FROM part), pts AS (SELECT cluster_id, latitude, longitude, floor(latitude / 0.5)::BIGINT AS tx, floor(longitude / 0.5)::BIGINT AS ty FROM feat),
        t AS (SELECT DISTINCT tx, ty, (tx * 31 + ty * 17) % 7 AS k FROM pts), q AS (SELECT tx * 2 + i AS tx, ty * 2 + j AS ty, tx AS px, ty AS py FROM t, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) WHERE k = 0),
        good AS (SELECT tx AS px, ty AS py, facility_id, facility_lat, facility_lon FROM t JOIN fac ON {reach('0.5')} WHERE k > 1 UNION SELECT px, py, facility_id, facility_lat, facility_lon FROM q JOIN fac ON {reach('0.25')} WHERE (tx * 13 + ty * 7) % 3 <> 0),
        state AS (SELECT tx, ty, CASE WHEN k = 1 THEN 'disabled' WHEN EXISTS (SELECT 1 FROM good WHERE px = tx AND py = ty) THEN 'found' WHEN k = 0 AND EXISTS (SELECT 1 FROM q WHERE px = t.tx AND py = t.ty AND (q.tx * 13 + q.ty * 7) % 3 = 0) THEN 'unavailable' ELSE 'not_found' END AS status FROM t),
        close AS (SELECT cluster_id, arg_min(facility_id, (km, facility_id)) AS facility_id, {o.rnd('min(km)', 2)} AS facility_km FROM (SELECT cluster_id, facility_id, {far} AS km FROM pts JOIN (SELECT DISTINCT facility_id, facility_lat, facility_lon FROM good) ON abs(latitude - facility_lat) < 0.03 AND {far} <= 2.0) GROUP BY 1)"""
    base = "dirty WHERE row_pos < 100000000"
    return {
        "s7_feed_rows": o.sql(f"""SELECT satellite || '_' || acq_date AS payload, satellite, lower(trim(confidence)) AS confidence, 'VIIRS' AS instrument, count(*) AS n, min(lpad(acq_time::VARCHAR, 4, '0')) AS first_time, max(latitude::DOUBLE) AS most_north
            FROM (SELECT * FROM {base}) WHERE latitude::DOUBLE BETWEEN -90 AND 90 AND longitude::DOUBLE BETWEEN -180 AND 180 AND day(acq_date::DATE) % 10 <> 0 GROUP BY 1, 2, 3""", "dirty"),
        "s7_feed_failures": o.sql(f"SELECT DISTINCT satellite || '_' || acq_date AS payload, 'FIRMS CSV missing required columns: satellite' AS error FROM {base} AND day(acq_date::DATE) % 10 = 0", "dirty"),
        "s13_weather_days": f"WITH {days} SELECT place, day, cloud_cover, temperature_2m, NULL::DOUBLE AS wind_speed FROM w",
        "s13_weather_as_of": o.sql(f""", {days} SELECT place, day, day_of, cloud_cover, temperature_2m, count(*) AS n FROM (
            SELECT d.place, d.day, w.day AS day_of, w.cloud_cover, w.temperature_2m, row_number() OVER (PARTITION BY d.detection_id ORDER BY w.day DESC NULLS LAST) AS r
            FROM (SELECT detection_id, (detection_id % 5)::INT AS place, acq_date AS day FROM det) d LEFT JOIN w ON w.place = d.place AND w.day <= d.day AND datediff('day', w.day, d.day) <= 1) WHERE r = 1 GROUP BY ALL""", "det"),
        "s10_facility_context": o.sql(f""", {context} SELECT cluster_id, CASE WHEN status = 'found' THEN facility_id END AS facility_id, CASE WHEN status = 'found' THEN facility_km END AS facility_km, CASE WHEN status = 'found' AND facility_id IS NULL THEN 'not_found' ELSE status END AS osm_query_status
            FROM pts JOIN state USING (tx, ty) LEFT JOIN close USING (cluster_id)""", "feat"),
        "s11_map_stations": f"""SELECT CASE WHEN k = 6 THEN 'way' ELSE 'node' END AS osm_type, station_id AS osm_id, CASE k WHEN 3 THEN 'short' WHEN 4 THEN '{payloads.UNNAMED}' ELSE s_name END AS name, round(a, 6) AS latitude, round(b, 6) AS longitude
            FROM (SELECT s_suppkey AS station_id, s_name, s_suppkey % 7 AS k, {o.SLAT} AS a, {o.SLON} AS b FROM supplier) WHERE k <> 0""",
    }
