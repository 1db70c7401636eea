"""From raw text rows to clean detections, and reports about what went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import detection_key, number, padded_time

REQUIRED = ("latitude", "longitude", "acq_date", "acq_time", "satellite", "confidence")


def require_columns(df: DataFrame, needed: tuple[str, ...], what: str = "columns") -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required {what}: {missing}")


def satellite_label(file_name: Column) -> Column:
    """The satellite that a file's name stands for."""
    name = F.lower(F.coalesce(file_name, F.lit("")))
    return F.when(name.contains("noaa20"), "NOAA-20").when(name.contains("noaa21"), "NOAA-21").when(name.contains("snpp"), "SUOMI-NPP").otherwise("UNKNOWN")


def typed(raw: DataFrame) -> DataFrame:
    """Numbers, dates, padded times and lower-case confidence; what cannot be read becomes NULL."""
    require_columns(raw, REQUIRED)
    numbers = {c: number(F.col(c)).alias(c) for c in ("latitude", "longitude", "bright_ti4", "bright_ti5", "scan", "track", "frp") if c in raw.columns}
    made = {"acq_time": padded_time(F.col("acq_time")), "acq_date": F.expr("try_cast(acq_date as date)"), "confidence": F.lower(F.trim("confidence"))}
    # Numbers come out of a generator, so that a filter on them reads a text once and not once for each comparison.
    once = raw.select(*[c for c in raw.columns if c not in numbers], F.inline(F.array(F.struct(*numbers.values())))) if numbers else raw
    out = once.select(*raw.columns).withColumns(made)
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.col("acq_date").cast("string"), "acq_time"), F.lit("yyyy-MM-dd HHmm"))
    return out.withColumn("acquisition_datetime", F.when(F.col("acq_date").isNotNull(), stamp))


def valid_positions(df: DataFrame) -> DataFrame:
    return df.where(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))


def repeat_keys(df: DataFrame) -> list[str]:
    """What makes two rows the same observation; a feed without the instrument is told apart by the rest."""
    return [c for c in ("latitude", "longitude", "acq_date", "acq_time", "satellite", "instrument") if c in df.columns]


def without_repeats(df: DataFrame) -> DataFrame:
    """The first row, by file and place in it, of rows that agree in place, time, satellite, instrument and date."""
    w = Window.partitionBy(*repeat_keys(df)).orderBy("source_file", "row_pos")
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def clean(raw: DataFrame) -> DataFrame:
    """Typed, valid, unrepeated detections with a hash id."""
    out = without_repeats(valid_positions(typed(raw)))
    return out.withColumn("observation_key", detection_key(F.col("latitude"), F.col("longitude"), F.col("acq_date"), F.col("acq_time"), F.col("satellite")))


def cleaning_report(raw: DataFrame) -> DataFrame:
    """One row: rows read, rows with valid positions, rows that stay, and what went, in counts and per cent."""
    t = typed(raw)
    ok = F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False))
    per_key = t.withColumn("ok", ok).groupBy("ok", *repeat_keys(t)).count()
    out = per_key.agg(F.sum("count").alias("input_rows"), F.sum(F.when(F.col("ok"), F.col("count")).otherwise(0)).alias("valid_rows"), F.count_if("ok").alias("kept_rows"))
    return out.select("input_rows", "valid_rows", "kept_rows", (F.col("input_rows") - F.col("valid_rows")).alias("invalid_removed"), (F.col("valid_rows") - F.col("kept_rows")).alias("repeats_removed"), (F.rint(F.col("kept_rows") * 10000.0 / F.col("input_rows")) / 100.0).alias("kept_pct"))


def missing_summary(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column, missing): how many values of each column are NULL, in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "missing")


def range_chunks(days: DataFrame, size: int) -> DataFrame:
    """(chunk_start, chunk_days): the range of the days in column `acq_date`, cut into pieces of at most `size`; no rows without a day."""
    ends = days.agg(F.min("acq_date").alias("a"), F.max("acq_date").alias("z")).where("a is not null")
    one = ends.select("z", F.explode(F.expr(f"sequence(a, z, interval {int(size)} days)")).alias("chunk_start"))
    return one.select("chunk_start", F.least(F.lit(int(size)), F.date_diff("z", "chunk_start") + 1).alias("chunk_days"))


def date_chunks(spark, start: str, end: str, days: int) -> DataFrame:
    """(chunk_start, chunk_days): a range of dates, ends included, cut into pieces of at most `days`."""
    if start > end:
        raise ValueError("start date must not be after end date")
    one = spark.sql(f"select explode(sequence(date'{start}', date'{end}', interval {int(days)} days)) as chunk_start")
    return one.select("chunk_start", F.least(F.lit(int(days)), F.date_diff(F.lit(end).cast("date"), "chunk_start") + 1).alias("chunk_days"))
