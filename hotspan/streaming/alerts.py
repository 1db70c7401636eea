"""Alerts as a stream: each cluster's status and severity live in the query's state, what changes is emitted."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources import versions

#: A run's severity of a cluster (`command` is null), or an operator's command about it after that run.
EVENTS = "cluster_id long, run long, seq long, severity string, command string"
CHANGES = "cluster_id long, run long, n long, change string, old_status string, new_status string, old_severity string, new_severity string, resolved_severity string"
STATE = "run long, n long, severity string, status string, resolved_severity string"
#: What such a query needs when it starts: its kind of state store, and no batches without data, of which a query that
#: stops when all is read would run one after the other, as state that expires by processing time asks for them.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
ORDER = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
ALLOWED = {"ACKNOWLEDGED": ("ACTIVE",), "RESOLVED": ("ACTIVE", "ACKNOWLEDGED")}
#: Time after which the state of a cluster that no run names is forgotten.
FORGET_MS = 14 * 24 * 3600 * 1000
CHANGE = Row(*[c.split()[0] for c in CHANGES.split(", ")])
Kept = tuple[int, int, str | None, str, str | None]


def told(key: int, was: Kept | None, event: Any) -> tuple[Kept | None, list[tuple]]:
    """The state after one event, and the changes it makes: the rules of `lifecycle.synced` and `lifecycle.moved`."""
    run, n, severity, status, resolved = was if was else (None, 0, None, None, None)
    if event.command is not None:
        if run != event.run or status not in ALLOWED.get(event.command, ()):
            return was, [(key, event.run, n, "REJECTED", status if run == event.run else None, event.command, severity, severity, resolved)]
        held = severity if event.command == "RESOLVED" else None
        return (run, n + 1, severity, event.command, held), [(key, run, n + 1, "STATUS_CHANGED", status, event.command, severity, severity, held)]
    if run is not None and event.run <= run:
        return was, []  # a run that has been taken already
    if run != event.run - 1:
        run, severity, status, resolved = None, None, None, None  # it was not in the run before, so not in the snapshot
    again = status == "RESOLVED" and resolved is not None and ORDER.get(event.severity, 1) > ORDER.get(resolved, 1)
    now = "ACTIVE" if run is None or again else status
    held = event.severity if now == "RESOLVED" else None
    changes = []
    if again:
        changes.append("REOPENED")
    if severity is not None and event.severity is not None and severity != event.severity:
        changes.append("SEVERITY_CHANGED")
    rows = [(key, event.run, n + k + 1, change, status, now, severity, event.severity, held) for k, change in enumerate([*changes, "SYNCED"])]
    return (event.run, n + len(rows), event.severity, now, held), rows


class AlertProcessor(StatefulProcessor):
    """Keeps one cluster's alert; forgotten when no run has named it for FORGET_MS of processing time."""

    def __init__(self, forget_ms: int = FORGET_MS):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.alert = handle.getValueState("alert", STATE, self.forget_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        was = tuple(self.alert.get()) if self.alert.exists() else None
        state = was
        # Commands follow the run that they are about, in their own order.
        for event in sorted(rows, key=lambda r: (r.run, r.command is not None, r.seq)):
            state, changes = told(key[0], state, event)
            yield from (CHANGE(*c) for c in changes)
        if state is not None and state != was:
            self.alert.update(state)

    def close(self) -> None:
        pass


def changes(events: DataFrame, forget_ms: int = FORGET_MS) -> DataFrame:
    """The changelog (CHANGES) of a stream of EVENTS; runs are numbered without gaps and a run's rows come in one batch or later ones, never before those of an earlier run."""
    return events.groupBy("cluster_id").transformWithState(AlertProcessor(forget_ms), CHANGES, "Append", "ProcessingTime")


def started(writer: DataStreamWriter) -> StreamingQuery:
    """Start a query with SETTINGS, which it keeps; the session gets its own back."""
    conf = writer._spark.conf
    before = {k: conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def snapshot(log: DataFrame) -> DataFrame:
    """(cluster_id, run, severity, status, resolved_severity) of the clusters of the last run, from the whole changelog or its newest part with the snapshot before it."""
    real = log.where("change <> 'REJECTED'")
    last = real.groupBy("cluster_id").agg(F.max_by(F.struct("run", "n", "new_severity", "new_status", "resolved_severity"), F.struct("run", "n")).alias("x")).select("cluster_id", "x.*")
    newest = last.agg(F.max("run").alias("newest"))
    return last.join(F.broadcast(newest), last.run == newest.newest).select("cluster_id", "run", "n", F.col("new_severity").alias("severity"), F.col("new_status").alias("status"), "resolved_severity")


def run(events: DataFrame, out: str, checkpoints: str, forget_ms: int = FORGET_MS) -> StreamingQuery:
    """Keep `out`/changes (a folder a batch) and `out`/alerts (versions of the snapshot) up to date with a stream of EVENTS.

    A batch that is run again after a crash writes the same folder and no second version, so each change counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"{out}/changes/batch={number}"
        batch.write.mode("overwrite").parquet(folder)
        made = spark.read.schema(CHANGES).parquet(folder)
        old = versions.live(spark, f"{out}/alerts")
        if old is not None:
            before = versions.read(spark, f"{out}/alerts", old["version"])
            made = made.unionByName(before.select("cluster_id", "run", "n", F.lit("SYNCED").alias("change"), F.lit(None).cast("string").alias("old_status"), F.col("status").alias("new_status"), F.lit(None).cast("string").alias("old_severity"), F.col("severity").alias("new_severity"), "resolved_severity"))
        versions.write(snapshot(made), f"{out}/alerts", number)

    return started(changes(events, forget_ms).writeStream.option("checkpointLocation", checkpoints).trigger(availableNow=True).foreachBatch(write))
