"""Facilities from a map service that answers by tiles: what an answer says, tiles that are asked again in quarters, and the context of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import nearest

C = F.col
#: Size in degrees of a tile, radius in km of the search, and by how many degrees a tile's question reaches beyond it.
TILE, RADIUS_KM, MARGIN = 0.5, 2.0, 0.02
#: Outcomes of a question, and those that say whether something is there.
FOUND, NOT_FOUND, UNAVAILABLE, DISABLED, MISSING = "found", "not_found", "unavailable", "disabled", "missing_coords"
ELEMENTS = "array<struct<type: string, id: long, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"


def tile(x: Column, size: float = TILE) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def answer_status(code: Column, error: Column, body: Column) -> Column:
    """The outcome of a question: an error of the connection, an HTTP code, or the text that came. Only found and not_found are answers."""
    count = F.coalesce(F.size(F.from_json(body, f"elements {ELEMENTS}")["elements"]), F.lit(0))
    told = F.when(F.get_json_object(body, "$").isNull(), "parse_error").when(count > 0, FOUND).otherwise(NOT_FOUND)
    return F.when(F.lower(error).rlike("time(d)? ?out"), "timeout").when(error.isNotNull(), "network_error").when(~F.coalesce(code == 200, F.lit(False)), "http_error").otherwise(told)


def answered(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tiles, elements) of `answers` (level, tx, ty, code, error, body), where level 1 has quarters of the tiles of level 0.

    A tile (tx, ty, status) that was not answered has the outcome of those quarters that were asked: found where one is,
    not_found where all are, else unavailable; so a failure is never taken for an empty place. Elements (tx, ty,
    facility_id, facility_lat, facility_lon, tags) are those of answered tiles and quarters, each once a tile; those
    without a position are left out. Repeated answers of a tile: the least by outcome and text counts.
    """
    told = answers.select("level", "tx", "ty", answer_status(C("code"), C("error"), C("body")).alias("status"), "body")
    one = told.groupBy("level", "tx", "ty").agg(F.min(F.struct("status", "body")).alias("a")).select("level", "tx", "ty", "a.status", "a.body")
    ok = C("status").isin(FOUND, NOT_FOUND)
    whole = one.where("level = 0")
    half = lambda c: F.floor(C(c) / 2).cast("long").alias(c)
    quarters = one.where("level = 1").select(half("tx"), half("ty"), "status", "body")
    merged = quarters.groupBy("tx", "ty").agg(F.bool_or(C("status") == FOUND).alias("some"), F.bool_and(C("status") == NOT_FOUND).alias("none"))
    failed = whole.where(~ok).select("tx", "ty").join(merged, ["tx", "ty"], "left")
    rolled = failed.select("tx", "ty", F.when(C("some"), FOUND).when(C("none"), NOT_FOUND).otherwise(UNAVAILABLE).alias("status"))
    tiles = whole.where(ok).select("tx", "ty", "status").unionByName(rolled)
    text = whole.where(C("status") == FOUND).select("tx", "ty", "body").unionByName(quarters.where(C("status") == FOUND).join(failed.select("tx", "ty"), ["tx", "ty"], "left_semi").select("tx", "ty", "body"))
    each = text.select("tx", "ty", F.explode(F.from_json("body", f"elements {ELEMENTS}")["elements"]).alias("e"))
    at = lambda c: F.coalesce(C(f"e.{c}"), C(f"e.center.{c}")).alias(f"facility_{c}")
    rows = each.select("tx", "ty", C("e.id").alias("facility_id"), C("e.type").alias("kind"), at("lat"), at("lon"), C("e.tags").alias("tags"))
    first = rows.where("facility_lat is not null and facility_lon is not null").dropDuplicates(["tx", "ty", "kind", "facility_id"])
    return tiles, first.drop("kind")


def context(points: DataFrame, answers: DataFrame, size: float = TILE, km: float = RADIUS_KM) -> DataFrame:
    """Per point (cluster_id, latitude, longitude): the nearest facility within `km`, its distance, and the outcome of the point's tile.

    Without a position: missing_coords; where its tile was not asked: disabled; where that failed: unavailable, which
    is unknown and not empty. Points meet facilities in cells of the radius and not tile by tile, so a tile with many
    of both is no product of the two.
    """
    tiles, elements = answered(answers)
    p = points.select("cluster_id", "latitude", "longitude", tile(C("latitude"), size).alias("tx"), tile(C("longitude"), size).alias("ty")).join(tiles, ["tx", "ty"], "left")
    asked = p.where(C("status") == FOUND).select("cluster_id", "latitude", "longitude")
    places = elements.groupBy("facility_id", "facility_lat", "facility_lon").agg(F.count("*").alias("n")).drop("n")
    near = nearest(asked, places, "cluster_id", "facility", km, strict=False).select("cluster_id", "facility_id", C("km").alias("facility_km"))
    out = p.join(near, "cluster_id", "left")
    known = F.when(C("facility_id").isNotNull(), FOUND).otherwise(NOT_FOUND)
    status = F.when(C("latitude").isNull() | C("longitude").isNull() | F.isnan("latitude") | F.isnan("longitude"), MISSING).when(C("status").isNull(), DISABLED).when(C("status") == UNAVAILABLE, UNAVAILABLE).otherwise(known)
    return out.select("cluster_id", "facility_id", "facility_km", status.alias("osm_query_status"))
