"""Keyed state over runs: alert snapshots with their history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def rank(x):
    """Order of severities; unknown ones count as LOW."""
    return F.coalesce(F.when(x == "LOW", 1).when(x == "MEDIUM", 2).when(x == "HIGH", 3).when(x == "CRITICAL", 4), F.lit(1))


def synced(old: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot, history) after a run: `fresh` (cluster_id, severity) against `old` (cluster_id, severity, status, resolved_severity).

    New clusters are ACTIVE. ACKNOWLEDGED and RESOLVED stay, but a RESOLVED alert opens again when its severity exceeds
    the one kept with it; while it stays RESOLVED that one follows the new severity. A change of severity is told, and
    a reopening on top of it. Clusters that are not in `fresh` leave the snapshot.
    """
    o = old.select("cluster_id", C("severity").alias("was"), C("status").alias("before"), "resolved_severity")
    j = fresh.select("cluster_id", "severity").join(o, "cluster_id", "left")
    again = (C("before") == "RESOLVED") & (rank(C("severity")) > rank(C("resolved_severity")))
    j = j.withColumn("reopened", F.coalesce(again, F.lit(False)))
    status = F.when(C("before").isNull() | C("reopened"), "ACTIVE").otherwise(C("before"))
    snapshot = j.withColumn("status", status).withColumn("resolved_severity", F.when(C("status") == "RESOLVED", C("severity")))
    told = F.filter(F.array(F.when(C("reopened"), "REOPENED"), F.when(C("was") != C("severity"), "SEVERITY_CHANGED")), lambda x: x.isNotNull())
    history = snapshot.select("cluster_id", F.explode(told).alias("change"), C("before").alias("old_status"), C("status").alias("new_status"), C("was").alias("old_severity"), C("severity").alias("new_severity"))
    return snapshot.select("cluster_id", "severity", "status", "resolved_severity"), history


def moved(snapshot: DataFrame, ids: DataFrame, to: str) -> DataFrame:
    """`snapshot` after the alerts in `ids` were acknowledged (only ACTIVE ones can be) or resolved (ACTIVE or ACKNOWLEDGED ones); others stay."""
    if to not in ("ACKNOWLEDGED", "RESOLVED"):
        raise ValueError(f"no such transition: {to}")
    hit = snapshot.join(ids.select("cluster_id", F.lit(True).alias("hit")).distinct(), "cluster_id", "left")
    may = C("hit") & (C("status") == "ACTIVE" if to == "ACKNOWLEDGED" else C("status") != "RESOLVED")
    out = hit.withColumn("status", F.when(F.coalesce(may, F.lit(False)), to).otherwise(C("status")))
    return out.withColumn("resolved_severity", F.when(C("status") == "RESOLVED", F.coalesce("resolved_severity", "severity"))).drop("hit")
