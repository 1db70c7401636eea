"""A consumer of alerts that tells each new one once: what it has seen is kept beside what it has told."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import versions

#: Severities that are told.
TOLD = ("CRITICAL", "HIGH")


def poll(alerts: DataFrame, store: str, batch: int | None = None) -> DataFrame | None:
    """One look at `alerts` (alert_id, severity, status, ...): those to tell now, None where `batch` has been taken already.

    The first look only notes what is there, so that a consumer that starts does not tell old alerts. Later an ACTIVE
    alert of a told severity whose id has not been seen is told, and every id is noted. The note of a look is committed
    with the number of its batch after what it tells is written, so a look that is made again tells the same.
    """
    spark = alerts.sparkSession
    live = versions.live(spark, f"{store}/seen")
    if live is not None and batch is not None and live["batch"] is not None and live["batch"] >= batch:
        return None
    ids = alerts.select("alert_id").distinct()
    if live is None:
        told = alerts.limit(0)
        seen = ids
    else:
        before = versions.read(spark, f"{store}/seen", live["version"])
        told = alerts.where(F.col("severity").isin(*TOLD) & (F.col("status") == "ACTIVE")).dropDuplicates(["alert_id"]).join(before, "alert_id", "left_anti").select(*alerts.columns)
        seen = before.union(ids).distinct()
    name = str(live["version"] if live else 0) if batch is None else str(batch)
    told.write.mode("overwrite").parquet(f"{store}/told/look={name}")
    versions.write(seen, f"{store}/seen", batch)
    return spark.read.schema(told.schema).parquet(f"{store}/told/look={name}")


def follow(alerts: DataFrame, store: str, checkpoints: str) -> StreamingQuery:
    """Look at each batch of a stream of alerts; what was told is in `store`/told, each alert once, also after a restart."""
    return alerts.writeStream.option("checkpointLocation", checkpoints).trigger(availableNow=True).foreachBatch(lambda batch, number: poll(batch, store, number)).start()
