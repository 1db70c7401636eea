"""How an ingestion cycle went, told by the running stream itself: observed counts, and a listener that judges them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Products, by the label of their satellite, and the name of the counts.
PRODUCTS = ("NOAA-20", "NOAA-21", "SUOMI-NPP")
RAW, NEW = "ingest_raw", "ingest_new"


def watched(raw: DataFrame) -> DataFrame:
    """A stream of raw rows (source_satellite and text columns) that counts, by product, rows and rows with a position and a day.

    The counts come with each batch's progress and cost no pass of their own. A batch must be run once only (a hook
    that needs it again reads what was written), or its rows count again.
    """
    lat, lon = (F.col(c).try_cast("double") for c in ("latitude", "longitude"))
    ok = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & F.col("acq_date").try_cast("date").isNotNull(), F.lit(False))
    of = [F.coalesce(F.col("source_satellite") == p, F.lit(False)) for p in PRODUCTS]
    counts = [F.count_if(x).alias(f"rows_{k}") for k, x in enumerate(of)] + [F.count_if(x & ok).alias(f"good_{k}") for k, x in enumerate(of)]
    return raw.observe(RAW, F.count(F.lit(1)).alias("fetched"), F.count_if(~ok).alias("rejected"), *counts)


def kept(detections: DataFrame) -> DataFrame:
    """A stream of detections without repeats that counts what is new."""
    return detections.observe(NEW, F.count(F.lit(1)).alias("new"))


def judged(raw: dict[str, int], new: int) -> dict[str, Any]:
    """The record of a cycle. A product fails when none of its rows can be used; a cycle fails when all that came did, and is degraded when some did."""
    came = [p for k, p in enumerate(PRODUCTS) if raw[f"rows_{k}"]]
    failed = [p for k, p in enumerate(PRODUCTS) if raw[f"rows_{k}"] and not raw[f"good_{k}"]]
    status = "healthy" if not failed else "failed" if len(failed) == len(came) else "degraded"
    error = "; ".join(f"{p}: no usable row" for p in failed) or None
    return {"status": status, "error": error, "fetched": raw["fetched"], "rejected": raw["rejected"], "new": new, "duplicates": raw["fetched"] - raw["rejected"] - new}


class Cycles(StreamingQueryListener):
    """Keeps the record of every batch that had rows; a query that ends with an error is a failed cycle."""

    def __init__(self) -> None:
        self.records: list[dict[str, Any]] = []

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        found = event.progress.observedMetrics
        if RAW in found and found[RAW]["fetched"]:
            raw = found[RAW].asDict()
            self.records.append(judged(raw, found[NEW]["new"] if NEW in found else raw["fetched"] - raw["rejected"]) | {"batch": event.progress.batchId})

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        if event.exception:
            self.records.append({"status": "failed", "error": event.exception.splitlines()[0], "fetched": 0, "rejected": 0, "new": 0, "duplicates": 0, "batch": None})
