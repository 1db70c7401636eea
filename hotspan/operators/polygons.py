"""Points in polygons of any number, with holes, and scenes whose footprint and days hold a point."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.geojson import edges_of, polygons
from .graph import checkpoint

#: Height in degrees of the slabs that polygons are cut into.
SLAB = 0.25
#: Size in degrees of the smallest cells of footprints; each level doubles it.
CELL, LEVELS = 0.5, 10
#: Bytes up to which scenes by their cells and days are broadcast; more are joined by a shuffle.
BROADCAST = 8 << 20
BOUNDS = ("west", "east", "south", "north")
#: The search's window and limit, and what it says.
WINDOW_DAYS, CLOUD_LIMIT = 5, 30.0
NONE_FOUND = "No matching Sentinel-2 observation found in temporal window"
OBSCURED = "Sentinel-2 observation available but obscured by cloud cover (best: {}%, threshold: {}%)"
FOUND = "Satellite metadata available"


def slabs(features: DataFrame, height: float = SLAB) -> DataFrame:
    """(feature_id, slab, edges): the edges of each feature's polygons by the slabs of latitude that they pass.

    Outer rings, holes and parts of a multipolygon are all just edges, as a point is inside where it sees an odd number
    of them. A row holds the edges of one feature in one slab, whatever the number of points; lower `height` for finer
    outlines. Features without polygons have no rows.
    """
    rings = F.flatten(polygons(F.col("kind"), F.col("coordinates")))
    edge = features.select("feature_id", F.explode(edges_of(rings)).alias("e")).where("e.x1 is not null and e.y1 is not null and e.x2 is not null and e.y2 is not null")
    at = lambda y: F.floor(y / F.lit(height)).cast("long")
    dealt = edge.withColumn("slab", F.explode(F.sequence(at(F.least("e.y1", "e.y2")), at(F.greatest("e.y1", "e.y2")))))
    return dealt.groupBy("feature_id", "slab").agg(F.collect_list("e").alias("edges"))


def odd(edges: Column, lat: Column, lon: Column) -> Column:
    """Whether a point sees an odd number of edges to its east: inside, by even and odd. A south end belongs to an edge, its north end does not."""

    def seen(e: Column) -> Column:
        at = (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        return ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < at)

    return F.size(F.filter(edges, seen)) % 2 == 1


def meets(points: DataFrame, cut: DataFrame, height: float) -> Column:
    return (F.floor(points.latitude / F.lit(height)).cast("long") == cut.slab) & odd(cut.edges, points.latitude, points.longitude)


def within(points: DataFrame, cut: DataFrame, height: float = SLAB) -> DataFrame:
    """`points` (latitude, longitude) with the feature_id of every feature of `cut` (see `slabs`) that they lie in.

    An equi-join on the slab, so each point meets one row a feature at most; Spark broadcasts the slabs where they are
    small. Points without a position lie in none.
    """
    return points.join(cut, meets(points, cut, height)).select(*[points[c] for c in points.columns], cut.feature_id)


def inside(points: DataFrame, cut: DataFrame, height: float = SLAB) -> DataFrame:
    """`points` that lie in any feature, each once, however many hold it."""
    return points.join(cut, meets(points, cut, height), "left_semi")


def boundary_report(points: DataFrame, cut: DataFrame, height: float = SLAB) -> DataFrame:
    """One row: points in all, inside and outside, the share that stays in per cent, their first and last day, and their count by satellite."""
    held = inside(points, cut, height)
    by = lambda s, name: F.count_if(F.col("satellite") == s).alias(name)
    got = held.agg(F.count("*").alias("records_inside"), F.min("acq_date").alias("first_day"), F.max("acq_date").alias("last_day"), by("NOAA-20", "noaa20_count"), by("NOAA-21", "noaa21_count"))
    row = points.agg(F.count("*").alias("input_records")).join(F.broadcast(got))  # one row each
    share = F.when(F.col("input_records") > 0, F.rint(F.col("records_inside") / F.col("input_records") * 10000) / 100).otherwise(0.0)
    return row.withColumns({"records_excluded": F.col("input_records") - F.col("records_inside"), "percentage_retained": share})


def scenes(features: DataFrame) -> DataFrame:
    """(scene_id, scene_date, scene_time, cloud, edges, bounds) of catalogue items; missing clouds count as 100 per cent.

    Items without an id, a date or a polygon are left out. A footprint is that of its polygons, not its box.
    """
    prop = lambda name: F.get_json_object("properties", f"$['{name}']")
    edges = edges_of(F.flatten(polygons(F.col("kind"), F.col("coordinates"))))
    rows = features.select(F.col("feature_id").alias("scene_id"), prop("datetime").alias("scene_time"), F.coalesce(prop("eo:cloud_cover").try_cast("double"), F.lit(100.0)).alias("cloud"), edges.alias("edges"))
    # Edges along a latitude are left out of `edges`, but each of their corners is the end of another edge.
    ends = lambda k: F.flatten(F.transform("edges", lambda e: F.array(e[f"{k}1"], e[f"{k}2"])))
    rows = rows.withColumns({"scene_date": F.left("scene_time", F.lit(10)).try_cast("date"), "west": F.array_min(ends("x")), "east": F.array_max(ends("x")), "south": F.array_min(ends("y")), "north": F.array_max(ends("y"))})
    return rows.where("scene_id is not null and scene_date is not null and west is not null")


def covering(points: DataFrame, found: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """`points` (latitude, longitude, day) with what is told of each row of `found` (edges, bounds, scene_date) whose footprint holds them within `days` of theirs.

    A scene is dealt to the level of cells as large as its footprint, where it touches four at most, and to its stretch
    of days and the two beside it; a point looks into one cell of each level that has scenes, in its own stretch. So
    neither a large footprint nor a long series of one place makes a row that everything meets.
    """
    extent = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    level = F.least(F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(1e-9)) / CELL)), F.lit(0)), F.lit(LEVELS)).cast("int")
    size = lambda k: F.pow(F.lit(2.0), k) * CELL
    at = lambda x, k: F.floor(x / size(k)).cast("long")
    step = F.lit(days + 1)
    s = found.withColumn("level", level).withColumn("cy", F.explode(F.sequence(at(F.col("south"), F.col("level")), at(F.col("north"), F.col("level")))))
    s = s.withColumn("cx", F.explode(F.sequence(at(F.col("west"), F.col("level")), at(F.col("east"), F.col("level")))))
    s = checkpoint(s.withColumn("ct", F.explode(F.array(*[F.floor(F.unix_date("scene_date") / step) + k for k in (-1, 0, 1)]))))
    some = s.groupBy("level").agg(F.sum(F.size("edges") * 32 + 256).alias("bytes")).collect()  # at most LEVELS + 1 rows
    p = points.withColumn("level", F.explode(F.array(*[F.lit(k) for k in sorted(r.level for r in some)]).cast("array<int>")))
    p = p.withColumn("cy", at(F.col("latitude"), F.col("level"))).withColumn("cx", at(F.col("longitude"), F.col("level"))).withColumn("ct", F.floor(F.unix_date("day") / step))
    near = F.abs(F.date_diff("scene_date", "day")) <= days
    boxed = F.col("latitude").between(F.col("south"), F.col("north")) & F.col("longitude").between(F.col("west"), F.col("east"))
    s = F.broadcast(s) if sum(r.bytes for r in some) <= BROADCAST else s.hint("merge")
    met = p.join(s, ["level", "cx", "cy", "ct"]).where(near & boxed & odd(F.col("edges"), F.col("latitude"), F.col("longitude")))
    return met.select(*points.columns, *[c for c in found.columns if c not in ("edges", *BOUNDS)])


def folded(found: DataFrame) -> DataFrame:
    """Scenes of one footprint and day as one row, with the clearest (ties: smallest id) as `best` and their number `n`: a point is covered by all of them or none."""
    best = F.min(F.struct("cloud", "scene_id", "scene_time")).alias("best")
    return found.groupBy("edges", "scene_date").agg(*[F.first(c).alias(c) for c in BOUNDS], best, F.count("*").alias("n"))


def matched(points: DataFrame, found: DataFrame, days: int = WINDOW_DAYS, limit: float = CLOUD_LIMIT) -> DataFrame:
    """Per point: cluster_id, the clearest scene that covers it (ties: smallest id), cloud_cover, n_scenes and observation_status.

    A scene counts as seen with at most `limit` per cent of clouds; without any the clearest is told as obscured, and
    without a scene the cover is 100 per cent and the id `none`.
    """
    best = covering(points, folded(found), days).groupBy("cluster_id").agg(F.min("best").alias("b"), F.sum("n").alias("n_scenes"))
    x = points.select("cluster_id").join(best, "cluster_id", "left")
    text = F.format_string(OBSCURED.replace("%", "%%").format("%.1f", "%.1f"), F.col("b.cloud"), F.lit(float(limit)))
    status = F.when(F.col("b").isNull(), NONE_FOUND).when(F.col("b.cloud") > limit, text).otherwise(FOUND)
    seen = F.col("b.cloud") <= limit
    return x.select("cluster_id", F.coalesce("b.scene_id", F.lit("none")).alias("satellite_item_id"), F.coalesce("b.cloud", F.lit(100.0)).alias("cloud_cover"), F.when(seen, F.col("b.scene_time")).alias("image_date"), F.coalesce("n_scenes", F.lit(0)).cast("long").alias("n_scenes"), status.alias("observation_status"))


