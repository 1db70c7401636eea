"""GeoJSON files as tables: features with their properties, and the edges of their polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nested values stay text, as their shape depends on the geometry's type.
FIELDS = "type string, id string, properties string, bbox array<double>, geometry struct<type: string, coordinates: string>"
RINGS = "array<array<array<double>>>"


def features(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Features (feature_id, properties, bbox, kind, coordinates) of GeoJSON files, each a collection or a feature.

    With `whole` a file is one text, of at most 2 GB as any cell; without, each line is one, so that a large file is
    read in parts. A feature without an id has its property `id`. Text that is no JSON gives no feature, a feature
    without geometry has nulls.
    """
    text = spark.read.text(path, wholetext=whole)
    read = text.select(F.from_json("value", f"{FIELDS}, features array<struct<{FIELDS}>>").alias("c"))
    one = F.struct(*[F.col(f"c.{c}") for c in ("type", "id", "properties", "bbox", "geometry")])
    each = read.select(F.explode(F.when(F.col("c.type") == "FeatureCollection", F.col("c.features")).when(F.col("c.type") == "Feature", F.array(one))).alias("f"))
    own = F.coalesce(F.col("f.id"), F.get_json_object("f.properties", "$.id"))
    return each.where("f is not null").select(own.alias("feature_id"), "f.properties", "f.bbox", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def having(found: DataFrame, name: str, value: str) -> DataFrame:
    """Features whose property `name` is `value`; ValueError where there is none."""
    got = found.where(F.get_json_object("properties", f"$['{name}']") == value)
    if got.isEmpty():
        raise ValueError(f"no feature with {name} = {value}")
    return got


def polygons(kind: Column, coordinates: Column) -> Column:
    """The polygons of a geometry, each an array of rings of (longitude, latitude, ...) points; null for others."""
    return F.when(kind == "Polygon", F.array(F.from_json(coordinates, RINGS))).when(kind == "MultiPolygon", F.from_json(coordinates, f"array<{RINGS}>"))


def edges_of(rings: Column) -> Column:
    """The edges (x1, y1, x2, y2) of an array of rings that cross any latitude; rings that are not closed are."""

    def of(ring: Column) -> Column:
        ends = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
        return F.zip_with(ring, ends, lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))

    return F.filter(F.flatten(F.transform(rings, of)), lambda e: e["y1"] != e["y2"])
