"""Detections and the tables around them, derived from the generic star-schema tables.

Arithmetic is on whole numbers first and on doubles in one last step, so that any engine gets the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(site: str, lat_prime: int = 7919, lon_prime: int = 104729) -> tuple[str, str]:
    return f"8.0D + (({site} * {lat_prime}L) % 2500) * 0.01D", f"70.0D + (({site} * {lon_prime}L) % 2503) * 0.01D"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per observation: id, position, time, brightness temperatures, radiative power, confidence, satellite."""
    lat, lon = place("site")
    # A generator is read once a row: the optimizer would else copy the pattern into every use of a position in a filter.
    once = "inline(array(named_struct('k', cast(regexp_extract(props, '[0-9]+', 0) as bigint))))"
    e = read(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id", "event_type", "value", once)
    e = e.withColumn("site", F.expr("case when k < 30 then user_id when k < 85 then 1000 + (event_id * 37) % 797 + 800 * (event_id div 2500) else 100000 + event_id end"))
    return e.selectExpr(
        "event_id as detection_id",
        f"{lat} + ((event_id * 31) % 10) * 0.0012D as latitude",
        f"{lon} + ((event_id * 17) % 10) * 0.0012D as longitude",
        "cast(ts as date) as acq_date", "date_format(ts, 'HHmm') as acq_time", "cast(ts as timestamp) as acquisition_datetime",
        "295.0D + value * 0.2D as bright_ti4", "270.0D + k * 0.3D as bright_ti5", "value / 10.0D as frp",
        "case k % 3 when 0 then 'l' when 1 then 'n' else 'h' end as confidence",
        "case when event_type in ('view', 'click') then 'NOAA-20' else 'NOAA-21' end as satellite",
    )


def dirty_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text rows with repeats, impossible and missing positions and unpadded times, as a feed delivers them."""
    d = detections(spark, sf_dir)
    text = d.selectExpr(
        "detection_id", "detection_id as row_pos",
        "case when detection_id % 97 = 0 then '999' else cast(latitude as string) end as latitude",
        "case when detection_id % 101 = 0 then null else cast(longitude as string) end as longitude",
        "cast(acq_date as string) as acq_date", "cast(cast(acq_time as int) as string) as acq_time",
        "cast(bright_ti4 as string) as bright_ti4", "cast(frp as string) as frp",
        "concat(' ', upper(confidence)) as confidence", "satellite", "case when detection_id % 3 = 0 then 'VIIRS' else 'MODIS' end as instrument", "concat('firms_', case satellite when 'NOAA-20' then 'noaa20' else 'noaa21' end, '.csv') as source_file",
    )
    again = text.where("detection_id % 50 = 0").withColumn("row_pos", F.col("row_pos") + 100000000)
    return text.unionByName(again)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = place("s_suppkey", 6007, 99991)
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey as station_id", "s_name as station_name", f"{lat} as station_lat", f"{lon} as station_lon")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = place("p_partkey", 6007, 99991)
    return read(spark, sf_dir, "part").selectExpr("p_partkey as facility_id", "element_at(array('refinery', 'works', 'plant', 'industrial', ''), p_size % 5 + 1) as facility_type", f"{lat} as facility_lat", f"{lon} as facility_lon")


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloud cover in per cent for each day of the observations; every seventh day has no record."""
    days = detections(spark, sf_dir).select("acq_date").distinct()
    day = F.expr("cast(date_diff(acq_date, date'2024-01-01') as bigint)")
    return days.select("acq_date", ((day * 37 + 11) % 101).cast("double").alias("cloud_cover"), day.alias("day")).where("day % 7 <> 6").drop("day")


#: A polygon whose corners are off the grid of positions.
BOUNDARY = ((70.5003, 8.5003), (94.2503, 9.1003), (90.1003, 20.0503), (94.9003, 32.3503), (80.0503, 28.0003), (71.2003, 31.8503))
