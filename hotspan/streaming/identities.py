"""Identities that live on between runs: a stored registry, a clock, and a hook that a stream of detections calls."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fixed
from ..operators import identity, spatial
from ..sources import versions


def cycle(detections: DataFrame, store: str, now: datetime, batch: int | None = None, legacy: DataFrame | None = None, issued: int = -1) -> bool:
    """One run over clustered `detections` at `now`: `store`/rows gets them with their stable ids, `store`/registry its next version.

    `legacy` and `issued` count only where there is no registry yet. The registry is committed last, so a run that
    died is made again from the registry before it; one that `batch` tells to have been committed is not. Whether it ran.
    """
    spark = detections.sparkSession
    known = versions.live(spark, f"{store}/registry")
    if known is not None and batch is not None and known["batch"] is not None and known["batch"] >= batch:
        return False
    registry = versions.read(spark, f"{store}/registry", known["version"]) if known else identity.empty_registry(spark)
    run = identity.resolved(identity.summaries(detections), registry, now, None if known else legacy, -1 if known else issued)
    versions.write(identity.mapped(detections, run), f"{store}/rows", batch)
    versions.write(identity.updated(registry, run, now), f"{store}/registry", batch)
    return True


def keeper(table: str, store: str, clock: Callable[[], datetime] = lambda: datetime.now(UTC)) -> Callable[[DataFrame, int], None]:
    """A hook for `ingest.run`: after each batch all detections of `table` are clustered and their identities kept in `store`.

    Whether an id is idle for too long is decided by `clock`, the time of processing, and not by the detections' days.
    """

    def after(batch: DataFrame, number: int) -> None:
        d = batch.sparkSession.read.parquet(table)
        if d.where(F.col("batch") == number).isEmpty():
            return  # a batch that only let old state go is no run
        place = [fixed(F.col(c), 4) for c in ("latitude", "longitude")]
        d = d.withColumn("detection_id", F.xxhash64(*place, "acq_date", "acq_time", "source_satellite")).withColumn("satellite", F.col("source_satellite"))
        cycle(spatial.clustered(d), store, clock(), number)

    return after
