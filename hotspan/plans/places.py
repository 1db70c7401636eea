"""Named queries over GeoJSON files that are written from the tables and read back: boundaries and catalogues of scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import polygons
from ..sources import adapter, geojson
from . import master as m
from . import oracles as o
from .queries import Query
from .told import own_folder

C = F.col
#: Centre, half height and half width of the country of a nation, as SQL of both engines; a hole has a third of both.
LAT, LON = "(10.0053D + n_nationkey * 0.8301D)", "(71.0057D + (n_nationkey * 7 % 25) * 0.9003D)"
HIGH, WIDE = "(1.3007D + n_nationkey * 0.0101D)", "(0.9003D + n_nationkey * 0.0203D)"
#: The second part of a country of an odd key lies so far to the east.
EAST = "(2.5D * " + WIDE + ")"
#: The same of a scene's footprint.
S_LAT, S_LON = "(8.0051D + ((p_partkey * 53L) % 250) * 0.1001D)", "(70.0061D + ((p_partkey * 71L) % 250) * 0.1003D)"
S_HIGH = "(0.1503D * element_at(array(1D, 2D, 5D, 12D, 30D), cast(p_partkey % 5 as int) + 1))"


def ring(lat: str, lon: str, high: str, wide: str) -> str:
    corners = ((lon, f"{lat} - {high}"), (f"{lon} + {wide}", lat), (lon, f"{lat} + {high}"), (f"{lon} - {wide}", lat), (lon, f"{lat} - {high}"))
    return "array(" + ", ".join(f"array({x}, {y})" for x, y in corners) + ")"


def boundaries(spark, d) -> str:
    """A file with a collection of one country per nation: a diamond with a hole, and a second part for odd keys."""
    main = f"array({ring(LAT, LON, HIGH, WIDE)}, {ring(LAT, LON, f'({HIGH} / 3D)', f'({WIDE} / 3D)')})"
    part = f"array({ring(LAT, f'({LON} + {EAST})', HIGH, WIDE)})"
    n = adapter.read(spark, d, "nation").withColumn("odd", F.expr("n_nationkey % 2 = 1"))
    props = F.to_json(F.struct(F.format_string("N%02d", "n_nationkey").alias("ISO3"), C("n_name").alias("name"), C("n_nationkey").cast("string").alias("id")))
    shape = F.when(C("odd"), F.to_json(F.expr(f"array({main}, {part})"))).otherwise(F.to_json(F.expr(main)))
    text = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":"'), F.when(C("odd"), "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), shape, F.lit("}}"))
    every = n.select(text.alias("t")).agg(F.array_join(F.sort_array(F.collect_list("t")), ",").alias("t"))  # one text, as the format has it
    path = f"{own_folder(spark)}/countries"
    every.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "t", F.lit("]}")).alias("value")).write.text(path)
    return path


def catalogue(spark, d) -> str:
    """A file with an item of a scene catalogue on each line."""
    p = adapter.read(spark, d, "part")
    day = F.date_format(F.expr("date_add(date'2024-01-01', cast(p_partkey % 30 as int))"), "yyyy-MM-dd")
    props = F.concat(F.lit('{"datetime":"'), day, F.lit('T05:30:00Z"'), F.when(C("p_partkey") % 11 != 0, F.concat(F.lit(',"eo:cloud_cover":'), F.expr("p_size * 2.0D").cast("string"))).otherwise(""), F.lit("}"))
    shape = F.to_json(F.expr(f"array({ring(S_LAT, S_LON, S_HIGH, S_HIGH)})"))
    text = F.concat(F.lit('{"type":"Feature","id":"S2_'), C("p_partkey").cast("string"), F.lit('","properties":'), props, F.lit(',"geometry":{"type":"Polygon","coordinates":'), shape, F.lit("}}"))
    path = f"{own_folder(spark)}/items"
    p.select(text.alias("value")).write.text(path)
    return path


def s9_boundary_features(spark, d):
    """Features of the boundary file by country: kind of geometry, polygons, rings and edges."""
    f = geojson.features(spark, boundaries(spark, d))
    shape = geojson.polygons(C("kind"), C("coordinates"))
    name = lambda k: F.get_json_object("properties", f"$.{k}")
    return f.select("feature_id", name("ISO3").alias("iso3"), name("name").alias("name"), "kind", F.size(shape).alias("n_polygons"), F.size(F.flatten(shape)).alias("n_rings"), F.size(geojson.edges_of(F.flatten(shape))).alias("n_edges"))


def p18_countries(spark, d):
    """Detections by the countries of the boundary file that hold them."""
    cut = polygons.slabs(geojson.features(spark, boundaries(spark, d)))
    return polygons.within(adapter.detections(spark, d).select("detection_id", "latitude", "longitude"), cut).groupBy("feature_id").agg(F.count("*").alias("n"), F.min("detection_id").alias("first_id"))


def p18_boundary_report(spark, d):
    """The report of the filter to one country of the boundary file."""
    cut = polygons.slabs(geojson.having(geojson.features(spark, boundaries(spark, d)), "ISO3", "N07"))
    return polygons.boundary_report(adapter.detections(spark, d), cut)


def j8_inside_any(spark, d):
    """Detections by day that lie in any country, each once."""
    cut = polygons.slabs(geojson.features(spark, boundaries(spark, d)))
    return polygons.inside(adapter.detections(spark, d), cut).groupBy("acq_date").agg(F.count("*").alias("n"))


def s12_scene_search(spark, d):
    """For each cluster the clearest scene of the catalogue that covers it within the window, and what the search says."""
    found = polygons.scenes(geojson.features(spark, catalogue(spark, d), whole=False))
    points = m.featured(spark, d).select("cluster_id", "latitude", "longitude", C("first_detection").alias("day"))
    return polygons.matched(points, found)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (s9_boundary_features, p18_countries, p18_boundary_report, j8_inside_any, s12_scene_search)}


def oracle_sql() -> dict[str, str]:
    duck = lambda x: x.replace("D ", "::DOUBLE ").replace("D)", "::DOUBLE)").replace("53L", "53").replace("71L", "71")
    in_diamond = lambda lat, lon, high, wide: f"abs(latitude - {lat}) / {high} + abs(longitude - {lon}) / {wide} < 1"
    lat, lon, high, wide = map(duck, (LAT, LON, HIGH, WIDE))
    east = f"(2.5::DOUBLE * {wide})"
    held = f"(({in_diamond(lat, lon, high, wide)} AND NOT {in_diamond(lat, lon, f'({high} / 3)', f'({wide} / 3)')}) OR (n_nationkey % 2 = 1 AND {in_diamond(lat, f'({lon} + {east})', high, wide)}))"
    size = "(0.1503::DOUBLE * ([1, 2, 5, 12, 30])[p_partkey % 5 + 1])"
    return {
        "s9_boundary_features": "SELECT n_nationkey::VARCHAR AS feature_id, 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS iso3, n_name AS name, CASE WHEN n_nationkey % 2 = 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, (1 + n_nationkey % 2)::INT AS n_polygons, (2 + n_nationkey % 2)::INT AS n_rings, (8 + 4 * (n_nationkey % 2))::INT AS n_edges FROM nation",
        "p18_countries": o.sql(f"SELECT n_nationkey::VARCHAR AS feature_id, count(*) AS n, min(detection_id) AS first_id FROM det JOIN nation ON {held} GROUP BY 1", "det"),
        "p18_boundary_report": o.sql(f"""SELECT (SELECT count(*) FROM det) AS input_records, count(*) AS records_inside, min(acq_date) AS first_day, max(acq_date) AS last_day, count_if(satellite = 'NOAA-20')::BIGINT AS noaa20_count, count_if(satellite = 'NOAA-21')::BIGINT AS noaa21_count,
            (SELECT count(*) FROM det) - count(*) AS records_excluded, round_even(count(*)::DOUBLE / (SELECT count(*) FROM det) * 10000, 0) / 100 AS percentage_retained FROM det JOIN (SELECT * FROM nation WHERE n_nationkey = 7) ON {held}""", "det"),
        "j8_inside_any": o.sql(f"SELECT acq_date, count(*) AS n FROM det WHERE EXISTS (SELECT 1 FROM nation WHERE {held}) GROUP BY 1", "det"),
        "s12_scene_search": o.sql(f"""SELECT cluster_id, coalesce(id, 'none') AS satellite_item_id, coalesce(cloud, 100.0)::DOUBLE AS cloud_cover, CASE WHEN cloud <= {polygons.CLOUD_LIMIT} THEN stamp END AS image_date, coalesce(n, 0) AS n_scenes,
            CASE WHEN id IS NULL THEN '{polygons.NONE_FOUND}' WHEN cloud > {polygons.CLOUD_LIMIT} THEN 'Sentinel-2 observation available but obscured by cloud cover (best: ' || {o.fixed('cloud', 1)} || '%, threshold: 30.0%)' ELSE '{polygons.FOUND}' END AS observation_status
            FROM feat LEFT JOIN (SELECT cluster_id, arg_min(id, (cloud, id)) AS id, min(cloud) AS cloud, arg_min(stamp, (cloud, id)) AS stamp, count(*) AS n FROM feat
                JOIN (SELECT 'S2_' || p_partkey AS id, CASE WHEN p_partkey % 11 <> 0 THEN p_size * 2.0::DOUBLE ELSE 100.0::DOUBLE END AS cloud, DATE '2024-01-01' + (p_partkey % 30)::INT AS day, strftime(DATE '2024-01-01' + (p_partkey % 30)::INT, '%Y-%m-%d') || 'T05:30:00Z' AS stamp, {duck(S_LAT)} AS a, {duck(S_LON)} AS o, {size} AS s FROM part)
                ON abs(datediff('day', first_detection, day::DATE)) <= {polygons.WINDOW_DAYS} AND abs(latitude - a) / s + abs(longitude - o) / s < 1 GROUP BY cluster_id) USING (cluster_id)""", "feat"),
    }
