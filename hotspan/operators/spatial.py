"""Spatial joins: points near points, nearest places, points in a polygon, all blocked on grid cells."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import haversine, rounded
from .graph import checkpoint, components


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def neighbour_pairs(points: DataFrame, km: float = 1.0, days: int = 3, key: str = "detection_id", exact: bool = False, group: str | None = None) -> DataFrame:
    """(a, b), a < b: pairs of points at most `km` and `days` apart.

    Points are dealt to cells of km / 111 degrees a side and stretches of days, so that a site that burns for years never
    compares all its rows with each other. As a pair has no order, a point looks only into its own cell and into those of
    its neighbours that come later: 14 of the 27 in space and time. With `exact` the columns of cells widen with
    latitude, so that no pair beyond the neighbouring cell is missed; without, the plain neighbourhood counts. With `group`
    the pairs are those of different groups that points of both make neighbours, once a pair of points.
    """
    size = max(km / 111.0, 1e-6)
    cells = (cell(F.col("latitude"), size).alias("cx"), cell(F.col("longitude"), size).alias("cy"), F.floor(F.unix_date("acq_date") / (days + 1)).alias("ct"))
    p = points.select(F.col(key).alias("id"), F.col(group or key).alias("of"), "latitude", "longitude", "acq_date", *cells)
    wide = F.ceil(1.0 / F.greatest(F.cos(F.radians(F.abs(F.col("latitude")) + 2 * size)), F.lit(0.01))).cast("int") if exact else F.lit(1)
    later = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(t).alias("t")) for x, t in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    around = p.withColumn("d", F.explode(later)).withColumn("dy", F.explode(F.sequence(F.when((F.col("d.x") == 0) & (F.col("d.t") == 0), 0).otherwise(-wide), wide)))
    own = ((F.col("d.x") == 0) & (F.col("d.t") == 0) & (F.col("dy") == 0)).alias("own")
    l = around.select("id", "of", "latitude", "longitude", "acq_date", own, (F.col("cx") + F.col("d.x")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), (F.col("ct") + F.col("d.t")).alias("ct")).alias("l")
    r = p.alias("r").hint("merge")  # both sides grow with the points: neither is broadcast
    close = haversine(F.col("l.latitude"), F.col("l.longitude"), F.col("r.latitude"), F.col("r.longitude")) <= km
    near_in_time = F.abs(F.date_diff(F.col("l.acq_date"), F.col("r.acq_date"))) <= days
    meet = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("cx", "cy", "ct")]
    once = F.when(F.col("l.own"), F.col("l.id") < F.col("r.id")).otherwise(F.col("l.id") != F.col("r.id"))
    apart = [F.col("l.of") != F.col("r.of")] if group else []
    met = l.join(r, reduce(and_, [*meet, once, *apart, near_in_time, close]))
    return met.select(F.least("l.of", "r.of").alias("a"), F.greatest("l.of", "r.of").alias("b"))


def clustered(points: DataFrame, km: float = 1.0, days: int = 3) -> DataFrame:
    """`points` with cluster_id, the smallest detection_id that chains of neighbour pairs reach; `km` is over 0.

    Rows of one place and day are folded to one spot first, and spots of a cell so small that all its points are
    neighbours, in one stretch of days, to one node. Pairs are looked for between spots of different nodes only, so that a
    place with very many rows costs what its different spots cost. A row without a place or day is a cluster of its own.
    """
    at, size = ["latitude", "longitude", "acq_date"], km / 167.0  # the diagonal of such a cell is 0.95 km for a km of 1
    spots = points.dropna(subset=at).where(~F.isnan("latitude") & ~F.isnan("longitude")).groupBy(*at).agg(F.min("detection_id").alias("spot"))
    small = Window.partitionBy(cell(F.col("latitude"), size), cell(F.col("longitude"), size), F.floor(F.unix_date("acq_date") / (days + 1)))
    spots = checkpoint(spots.withColumn("node", F.min("spot").over(small)))
    groups = components(neighbour_pairs(spots, km, days, key="spot", group="node")).withColumnRenamed("node", "of")
    named = spots.join(groups.hint("merge"), spots.node == groups.of, "left").select(*at, F.coalesce("component", "node").alias("cluster_id"))
    out = points.join(named.hint("merge"), at, "left").withColumn("cluster_id", F.coalesce("cluster_id", "detection_id"))
    return out.select(*points.columns, "cluster_id")


def within_radius(left: DataFrame, places: DataFrame, key: str, place: str, km: float, strict: bool = True) -> DataFrame:
    """`left` (key, latitude, longitude) joined with every place (`place`_id, _lat, _lon) nearer than `km`, with `km` between them.

    Both sides are dealt to cells of about twice the radius; a point looks into the 3 x 3 cells around it, more to the
    sides where meridians close up. Places grow with the input, so they are not broadcast.
    """
    size = km / 55.0
    p = left.select(key, "latitude", "longitude", cell(F.col("latitude"), size).alias("cx"), cell(F.col("longitude"), size).alias("cy"))
    wide = F.ceil(0.5 / F.greatest(F.cos(F.radians(F.abs(F.col("latitude")))), F.lit(0.01)) + 0.1).cast("int")
    p = p.withColumn("dx", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("dy", F.explode(F.sequence(-wide, wide)))
    p = p.select(key, "latitude", "longitude", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    q = places.withColumn("cx", cell(F.col(f"{place}_lat"), size)).withColumn("cy", cell(F.col(f"{place}_lon"), size))
    d = haversine(F.col("latitude"), F.col("longitude"), F.col(f"{place}_lat"), F.col(f"{place}_lon"))
    return p.join(q.hint("merge"), ["cx", "cy"]).withColumn("km", d).where(F.col("km") < km if strict else F.col("km") <= km).drop("cx", "cy")


def nearest(left: DataFrame, places: DataFrame, key: str, place: str, km: float, strict: bool = True) -> DataFrame:
    """(key, the nearest place's columns, km to two places) for every row of `left`; NULL where none is near. Ties go to the smaller id."""
    found = within_radius(left, places, key, place, km, strict)
    best = F.min(F.struct("km", f"{place}_id", *[c for c in places.columns if c != f"{place}_id"])).alias("best")
    one = found.groupBy(key).agg(best)
    cols = [F.col(f"best.{c}").alias(c) for c in places.columns]
    return left.select(key).join(one.hint("merge"), key, "left").select(key, *cols, rounded(F.col("best.km"), 2).alias("km"))


def inside(lat: Column, lon: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon given as (longitude, latitude) corners: parity of the edges crossed eastwards."""
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        spans = (F.lit(y1) > lat) != (F.lit(y2) > lat)
        at = F.lit(x2 - x1) * (lat - F.lit(y1)) / F.lit(y2 - y1) + F.lit(x1) if y1 != y2 else F.lit(x1)
        crossed = crossed + F.when(spans & (lon < at), 1).otherwise(0)
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return lat.between(min(ys), max(ys)) & lon.between(min(xs), max(xs)) & (crossed % 2 == 1)
