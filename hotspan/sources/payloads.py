"""What services answer, as text in a column, made into rows: CSV feeds, weather with parallel arrays, map elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: Columns of a feed, those that it must have, and the most that a line may have.
FEED = ("latitude", "longitude", "bright_ti4", "scan", "track", "acq_date", "acq_time", "satellite", "instrument", "confidence", "version", "bright_ti5", "frp", "daynight")
REQUIRED = ("latitude", "longitude", "acq_date", "acq_time", "satellite")
WIDTH = 64
#: The satellites that a feed's codes stand for, and the name of a station that has none.
SATELLITES = {"N20": "NOAA-20", "N21": "NOAA-21", "NPP": "SUOMI-NPP"}
UNNAMED = "Fire station (unnamed)"
UNKNOWN_CLOUD = 50.0


def cells(line: Column) -> Column:
    """The fields of a CSV line as an array, quotes taken off; beyond its last field nulls."""
    read = F.array(F.from_csv(line, ", ".join(f"c{k} string" for k in range(WIDTH)), {"mode": "PERMISSIVE"}))
    return F.get(F.transform(read, lambda r: F.array(*[r[f"c{k}"] for k in range(WIDTH)])), 0)  # a lambda reads the line once


def feed(payloads: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of CSV payloads, one text each; other columns of `payloads` stay with both.

    Rows have FEED's columns: positions as doubles, the time padded to four digits, the confidence in lower case, the
    satellite by its name, VIIRS where no instrument is told. Rows without a possible position are left out. A payload
    without one of the required columns fails as a whole and is told with an `error`; null and blank ones have neither.
    """
    kept = [c for c in payloads.columns if c != text]
    lines = F.filter(F.split(F.trim(C(text)), "\\r?\\n"), lambda x: F.trim(x) != "")
    one = payloads.select(*kept, lines.alias("__lines")).where(F.size("__lines") > 0)
    head = one.withColumn("__head", F.filter(F.transform(cells(C("__lines")[0]), lambda x: F.trim(x)), lambda x: x.isNotNull()))
    missing = F.filter(F.array(*[F.lit(c) for c in REQUIRED]), lambda x: ~F.array_contains("__head", x))
    judged = head.withColumn("__missing", missing)
    failures = judged.where(F.size("__missing") > 0).select(*kept, F.concat(F.lit("FIRMS CSV missing required columns: "), F.array_join("__missing", ", ")).alias("error"))
    each = judged.where(F.size("__missing") == 0).select(*kept, "__head", F.explode(F.slice("__lines", F.lit(2), F.size("__lines"))).alias("__line")).withColumn("__cells", cells(C("__line")))

    def field(name: str) -> Column:
        return F.when(F.array_contains("__head", name), F.get("__cells", (F.array_position("__head", name) - 1).cast("int")))

    told = each.select(*kept, *[field(c).alias(c) for c in FEED])
    code = F.upper(F.trim(F.coalesce("satellite", F.lit(""))))
    named = F.create_map(*[F.lit(x) for kv in SATELLITES.items() for x in kv])
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = told.withColumns(
        {
            "latitude": C("latitude").try_cast("double"), "longitude": C("longitude").try_cast("double"), "acq_date": blank("acq_date"), "acq_time": F.lpad(blank("acq_time"), F.greatest(F.length(blank("acq_time")), F.lit(4)), F.lit("0")),
            "satellite": F.coalesce(F.try_element_at(named, code), F.trim(F.coalesce("satellite", F.lit("")))), "instrument": F.when(C("instrument").isNull(), "VIIRS").otherwise(F.trim("instrument")), "confidence": F.lower(blank("confidence")),
        }
    )
    return rows.where("latitude between -90 and 90 and longitude between -180 and 180"), failures


def weather(payloads: DataFrame, text: str = "text") -> DataFrame:
    """A row per day of JSON payloads whose `daily` arrays run side by side: day, cloud_cover, temperature_2m, wind_speed.

    Days that are no dates are left out. Where the array of clouds ends early the cover is 50 per cent, where it holds a
    null it is null; the others are null. Text that is no such JSON has no rows.
    """
    kept = [c for c in payloads.columns if c != text]
    daily = F.from_json(text, "daily struct<time: array<string>, cloud_cover_mean: array<double>, temperature_2m_mean: array<double>, wind_speed_10m_mean: array<double>>")["daily"]
    at = payloads.select(*kept, daily.alias("__d")).select(*kept, "__d", F.posexplode("__d.time").alias("__k", "__day"))
    cloud = F.when(C("__k") < F.coalesce(F.size("__d.cloud_cover_mean"), F.lit(0)), F.get("__d.cloud_cover_mean", C("__k"))).otherwise(UNKNOWN_CLOUD)
    return at.select(*kept, C("__day").try_cast("date").alias("day"), cloud.alias("cloud_cover"), F.get("__d.temperature_2m_mean", C("__k")).alias("temperature_2m"), F.get("__d.wind_speed_10m_mean", C("__k")).alias("wind_speed")).where("day is not null")


def stations(payloads: DataFrame, text: str = "text", order: str = "tile") -> DataFrame:
    """The stations of JSON payloads of map elements, each (osm_type, osm_id) once: the first by `order` and place in its payload.

    An element without a position of its own has that of its centre; without either it is left out, before repeats are.
    A station has its name, else its short name, else UNNAMED; positions are rounded to six digits.
    """
    element = "struct<type: string, id: long, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: struct<name: string, short_name: string>>"
    at = payloads.select(C(order).alias("__tile"), F.posexplode(F.from_json(text, f"elements array<{element}>")["elements"]).alias("__k", "e"))
    # A position of 0 counts as none of its own, as an empty name does.
    own = lambda c: F.when(C(f"e.{c}") != 0, C(f"e.{c}"))
    name = F.coalesce(*[F.when(C(f"e.tags.{c}") != "", C(f"e.tags.{c}")) for c in ("name", "short_name")], F.lit(UNNAMED))
    rows = at.select("__tile", "__k", F.coalesce("e.type", F.lit("node")).alias("osm_type"), C("e.id").alias("osm_id"), name.alias("name"), *[F.round(F.coalesce(own(s), F.col(f"e.center.{s}")), 6).alias(c) for s, c in (("lat", "latitude"), ("lon", "longitude"))])
    rows = rows.where("latitude is not null and longitude is not null")
    first = F.min_by(F.struct("name", "latitude", "longitude"), F.struct("__tile", "__k"))
    return rows.groupBy("osm_type", "osm_id").agg(first.alias("x")).select("osm_type", "osm_id", "x.*")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], day: str, days: int) -> DataFrame:
    """`left` with the columns of the latest row of `right` of the same keys whose `day` is not after its own, at most `days` before; else nulls.

    Both sides meet in stretches of days, the own one and the one before, so a place with a long series is no hot key
    of one task; of several rows of a day the least by all columns counts. Repeated rows of `left` stay.
    """
    values = [c for c in right.columns if c not in (*keys, day)]
    stretch = lambda c: F.floor(F.unix_date(c) / (days + 1))
    r = right.groupBy(*keys, day).agg(F.min(F.struct(*values)).alias("__v")).withColumnRenamed(day, "__day").withColumn("__s", stretch("__day"))
    asked = left.select(*keys, day).distinct()
    l = asked.withColumn("__s", F.explode(F.array(stretch(day), stretch(day) - 1)))
    near = (C("__day") <= C(day)) & (F.date_diff(day, "__day") <= days)
    best = l.join(r, [*keys, "__s"]).where(near).groupBy(*keys, day).agg(F.max_by("__v", "__day").alias("__v"), F.max("__day").alias(f"{day}_of"))
    return left.join(best, [*keys, day], "left").select(*left.columns, f"{day}_of", *[C(f"__v.{c}").alias(c) for c in values])
