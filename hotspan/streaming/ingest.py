"""Incremental ingestion: a stream of raw text files becomes clean, unrepeated detections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scalar import fixed
from ..operators import cleaning

RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("latitude", "longitude", "bright_ti4", "scan", "track", "acq_date", "acq_time", "satellite", "confidence", "bright_ti5", "frp")])
#: How late an observation may come and how long its key is remembered.
REMEMBERED = "14 days"
REMEMBERED_MS = 14 * 24 * 3600 * 1000
KEYS = ("lat_key", "lon_key", "acq_date", "acq_time", "source_satellite")


def raw_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Header CSV files named firms_*.csv as they arrive, with the satellite that each file's name stands for."""
    rows = spark.readStream.schema(RAW).option("header", True).option("pathGlobFilter", "firms_*.csv").option("maxFilesPerTrigger", files_per_batch).csv(folder)
    return rows.withColumn("source_file", F.col("_metadata.file_name")).withColumn("source_satellite", cleaning.satellite_label(F.col("source_file")))


def keyed(raw: DataFrame) -> DataFrame:
    d = cleaning.valid_positions(cleaning.typed(raw)).where("acquisition_datetime is not null")
    return d.withColumns({"lat_key": fixed(F.col("latitude"), 4), "lon_key": fixed(F.col("longitude"), 4)})


def detections(raw: DataFrame) -> DataFrame:
    """Typed, valid detections, each place, time and satellite once within the time that keys are remembered."""
    return keyed(raw).withWatermark("acquisition_datetime", REMEMBERED).dropDuplicatesWithinWatermark(list(KEYS)).drop("lat_key", "lon_key")


class FirstSeen(StatefulProcessor):
    """Lets one row of a key through and remembers the key for `ttl_ms` of processing time from then on."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((True,))
            yield min(rows, key=repr)

    def close(self) -> None:
        pass


def first_seen(raw: DataFrame, ttl_ms: int = REMEMBERED_MS) -> DataFrame:
    """As `detections`, but however old an observation is: a key is forgotten by the time of processing, `ttl_ms` after it was first seen.

    Such a query needs the settings that `alerts.started` gives it. Of repeats in one batch the least row stays.
    """
    d = keyed(raw)
    return d.groupBy(*KEYS).transformWithState(FirstSeen(ttl_ms), d.schema, "Append", "ProcessingTime").drop("lat_key", "lon_key")


def run(raw: DataFrame, out: str, checkpoints: str, after: Callable[[DataFrame, int], None] | None = None, ttl_ms: int | None = None) -> StreamingQuery:
    """Append what is new to a Parquet table by day, and call `after` with each batch; stops when all files are read.

    A batch that is run again writes the same folder, so nothing is appended twice. With `ttl_ms` keys are remembered
    by processing time (`first_seen`), without it by the time of the observations.
    """
    from . import status
    from .alerts import started

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("acq_date").parquet(f"{out}/batch={number}")
        if after:
            after(batch, number)

    kept = status.kept(detections(raw) if ttl_ms is None else first_seen(raw, ttl_ms))
    writer = kept.writeStream.option("checkpointLocation", checkpoints).trigger(availableNow=True).foreachBatch(write)
    return writer.start() if ttl_ms is None else started(writer)


def daily_counts(raw: DataFrame) -> DataFrame:
    """Detections and peak radiative power by day and satellite, updated as data come."""
    return detections(raw).groupBy(F.window("acquisition_datetime", "1 day").alias("day"), "source_satellite").agg(F.count("*").alias("n"), F.max("frp").alias("peak_frp"))
