"""What lives on between runs: identities against a sequential twin, alerts as a stream against the batch rules, versions of tables."""

import datetime as dt
import math
import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hotspan.operators import identity, lifecycle
from hotspan.sources import versions
from hotspan.streaming import alerts, identities, ingest

CLUSTERS = "cluster_id long, event_key string, latitude double, longitude double, observation_count long, first_detection date, last_seen date"
NOW = dt.datetime(2024, 3, 1, 12, tzinfo=dt.UTC)
DAY = dt.date(2024, 2, 20)


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def one_by_one(clusters, registry, legacy, issued):
    """The same choice made one entry after the other."""
    clusters = sorted(clusters, key=lambda c: (-c[4], c[0]))
    got, keys = {}, {}
    live = [e for e in registry if (NOW - e[7]).total_seconds() / 86400 <= 14]
    order = sorted(live, key=lambda e: (str(e[5] or ""), e[0]), reverse=True)

    def nearest(lat, lon):
        free = [(round(km(lat, lon, c[2], c[3]), 9), i) for i, c in enumerate(clusters) if c[0] not in got]
        best = min(free, default=None)
        return clusters[best[1]] if best and best[0] <= 1.5 else None

    for key, cid, lat, lon, *_ in order:
        c = nearest(lat, lon)
        if c:
            got[c[0]], keys[c[0]] = (cid, "continued"), key
    for cid, lat, lon, _ in sorted(legacy, key=lambda e: (str(e[3] or ""), -e[0]), reverse=True):
        c = nearest(lat, lon)
        if c:
            got[c[0]], keys[c[0]] = (cid, "bootstrap_continued"), c[1]
    top = max([issued] + [e[1] for e in registry] + [e[0] for e in legacy])
    for c in clusters:
        if c[0] not in got:
            top += 1
            key = c[1]
            if key in {e[0] for e in registry} or key in keys.values():
                key += "-" + (c[5].strftime("%Y%m%d") if c[5] else "unknown")
            got[c[0]], keys[c[0]] = (top, "new"), key
    return {c: (*got[c], keys[c]) for c in got}


@pytest.mark.parametrize("seed", range(2))
def test_identities_are_those_of_the_sequential_order(spark, seed):
    rnd = random.Random(seed)
    at = lambda: (20 + rnd.randrange(25) * 0.004, 75 + rnd.randrange(25) * 0.004)
    clusters = [(i, f"k{rnd.randrange(40)}", *at(), rnd.randrange(1, 5), rnd.choice([DAY, None, DAY - dt.timedelta(3)]), DAY) for i in range(70)]
    registry = [(f"k{i}", 100 + i, *at(), DAY, rnd.choice([None, DAY, DAY - dt.timedelta(1)]), 3, NOW - dt.timedelta(days=rnd.choice([0, 5, 13, 14, 15, 200])), "new") for i in range(50)]
    legacy = [(500 + i, *at(), rnd.choice([None, DAY])) for i in range(20)]
    run = identity.resolved(spark.createDataFrame(clusters, CLUSTERS), spark.createDataFrame(registry, identity.REGISTRY), NOW, spark.createDataFrame(legacy, "cluster_id long, latitude double, longitude double, last_seen date"), issued=530)
    got = {r.cluster_id: (r.canonical_id, r.identity_status, r.event_key) for r in run.collect()}
    assert got == one_by_one(clusters, registry, legacy, 530)
    assert len({v[0] for v in got.values()}) == len(clusters)


def test_entries_that_wait_for_one_another_in_a_chain(spark):
    clusters = [(i, f"c{i}", 20.0, 75 + i * 0.01, 1, DAY, DAY) for i in range(12)]
    registry = [(f"k{i:02}", 100 + i, 20.0, 75 + i * 0.01 - 0.004, DAY, DAY, 1, NOW, "new") for i in range(12)]
    got = {r.cluster_id: r.canonical_id for r in identity.resolved(spark.createDataFrame(clusters, CLUSTERS), spark.createDataFrame(registry, identity.REGISTRY), NOW).collect()}
    assert got == {c: v[0] for c, v in one_by_one(clusters, registry, [], -1).items()}


def test_no_rows_and_rows_without_a_place(spark):
    none = spark.createDataFrame([], CLUSTERS)
    assert identity.resolved(none, identity.empty_registry(spark), NOW).count() == 0
    rows = [(1, 7, 20.0, 75.0, DAY, "N20"), (2, 7, 20.001, 75.0, DAY, "N20"), (3, 8, None, 75.0, DAY, "N20")]
    detections = spark.createDataFrame(rows, "detection_id long, cluster_id long, latitude double, longitude double, acq_date date, satellite string")
    clusters = identity.summaries(detections)
    run = identity.resolved(clusters, identity.empty_registry(spark), NOW, issued=40)
    mapped = {r.detection_id: (r.cluster_id, r.identity_status) for r in identity.mapped(detections, run).collect()}
    assert mapped == {1: (41, "new"), 2: (41, "new"), 3: (8, "unresolved")}
    assert identity.report(run).first().new_events == 1


def test_an_id_lives_through_13_idle_days_and_not_through_more_than_14(spark, tmp_path):
    store, place = str(tmp_path / "store"), [(1, 7, 20.0, 75.0, DAY, "N20")]
    schema = "detection_id long, cluster_id long, latitude double, longitude double, acq_date date, satellite string"
    ids = lambda: [(r.cluster_id, r.identity_status) for r in versions.read(spark, f"{store}/rows").collect()]
    seen = []
    for batch, days in enumerate((0, 13, 13 + 14, 13 + 28.1)):
        # what the detections' days say does not count, only the clock
        assert identities.cycle(spark.createDataFrame(place, schema), store, NOW + dt.timedelta(days=days), batch)
        seen += ids()
    assert seen == [(0, "new"), (0, "continued"), (0, "continued"), (1, "new")]
    assert not identities.cycle(spark.createDataFrame(place, schema), store, NOW + dt.timedelta(days=99), 3)
    keys = sorted(r.event_key for r in versions.read(spark, f"{store}/registry").collect())
    assert len(keys) == 2 and keys[1] == f"{keys[0]}-20240220"


def test_identities_follow_a_stream_of_files(spark, tmp_path):
    header = ",".join(ingest.RAW.fieldNames())
    folder, table, store = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "store")
    folder.mkdir()
    clock = [NOW]
    for k, lats in enumerate(((20.0, 25.0), (20.001, 10.0))):
        (folder / f"firms_noaa20_{k}.csv").write_text("\n".join([header] + [f"{lat},75.0,330,1,1,2024-01-0{k + 2},0630,N20,n,290,5" for lat in lats]))
        ingest.run(ingest.raw_stream(spark, str(folder)), table, str(tmp_path / "state"), identities.keeper(table, store, lambda: clock[0])).awaitTermination()
        clock[0] += dt.timedelta(days=1)
    rows = versions.read(spark, f"{store}/rows").collect()
    by = {r.latitude: (r.cluster_id, r.identity_status) for r in rows}
    assert by[20.0] == by[20.001] and by[20.0][0] in (0, 1) and by[20.0][1] == "continued"
    assert by[10.0] == (2, "new")


# --- alerts ------------------------------------------------------------------------------------------------------------


def put(spark, folder, rows):
    spark.createDataFrame(rows, alerts.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    alerts.run(spark.readStream.schema(alerts.EVENTS).parquet(f"{folder}/events"), folder, f"{folder}/state").awaitTermination()


def test_a_stream_of_runs_gives_the_snapshots_and_the_history_of_the_batch_rules(spark, tmp_path):
    rnd, folder = random.Random(8), str(tmp_path)
    snapshot = spark.createDataFrame([], "cluster_id long, severity string, status string, resolved_severity string")
    history = []
    for run in (1, 2, 3, 4):
        fresh = [(c, rnd.choice(["LOW", "MEDIUM", "HIGH", "CRITICAL"])) for c in range(30) if rnd.random() < 0.8]
        commands = [(c, rnd.choice(["ACKNOWLEDGED", "RESOLVED"])) for c in rnd.sample(range(33), 14)]
        put(spark, folder, [(c, run, 0, s, None) for c, s in fresh] + [(c, run, k, None, to) for k, (c, to) in enumerate(commands)])
        snapshot, told = lifecycle.synced(snapshot, spark.createDataFrame(fresh, "cluster_id long, severity string"))
        history += [(run, *r) for r in told.collect()]
        for to in ("ACKNOWLEDGED", "RESOLVED"):
            snapshot = lifecycle.moved(snapshot, spark.createDataFrame([(c,) for c, t in commands if t == to], "cluster_id long"), to)
        snapshot = spark.createDataFrame(snapshot.collect(), snapshot.schema)
        live = versions.read(spark, f"{folder}/alerts")
        assert sorted(map(tuple, live.select(*snapshot.columns).collect())) == sorted(map(tuple, snapshot.collect()))
    log = spark.read.schema(alerts.CHANGES).parquet(f"{folder}/changes")
    made = log.where("change in ('REOPENED', 'SEVERITY_CHANGED')").select("run", "cluster_id", "change", "old_status", "new_status", "old_severity", "new_severity")
    assert sorted(map(tuple, made.collect())) == sorted(history)
    assert log.where("change = 'REJECTED'").count() > 0


def test_a_batch_that_is_made_again_counts_once(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, folder, [(1, 1, 0, "LOW", None)])
    put(spark, folder, [(1, 2, 0, "HIGH", None)])
    before = versions.live(spark, f"{folder}/alerts")["version"]
    # as after a crash between the sink and the commit of the batch
    for name in ("1", ".1.crc"):
        (Path(folder) / "state" / "commits" / name).unlink(missing_ok=True)
    put(spark, folder, [(1, 3, 0, "HIGH", None)])
    log = spark.read.schema(alerts.CHANGES).parquet(f"{folder}/changes")
    assert sorted((r.run, r.change) for r in log.collect()) == [(1, "SYNCED"), (2, "SEVERITY_CHANGED"), (2, "SYNCED"), (3, "SYNCED")]
    assert versions.live(spark, f"{folder}/alerts")["version"] == before + 1


def test_keys_are_forgotten_by_the_time_of_processing(spark, tmp_path):
    import time

    header = ",".join(ingest.RAW.fieldNames())
    line = "20.0,75.0,330,1,1,2020-01-02,0630,N20,n,290,5"  # far behind any watermark
    folder = tmp_path / "in"
    folder.mkdir()
    counts = []
    for k, wait in enumerate((0, 0, 41)):
        time.sleep(wait)
        (folder / f"firms_noaa20_{k}.csv").write_text("\n".join([header, line, line]))
        ingest.run(ingest.raw_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "state"), lambda b, n: counts.append(b.count()), ttl_ms=40_000).awaitTermination()
    assert counts == [1, 0, 1]


# --- versions ----------------------------------------------------------------------------------------------------------


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    made = lambda n: spark.range(n * 10).repartition(2)
    with pytest.raises(ValueError):
        versions.read(spark, path)
    assert [versions.write(made(k), path) for k in (1, 2)] == [1, 2]
    with pytest.raises(Exception, match="half way"):
        versions.write(spark.range(100).repartition(4).select(F.when(F.col("id") == 50, F.raise_error(F.lit("half way"))).otherwise(F.col("id")).cast("long").alias("id")), path)
    assert versions.read(spark, path).count() == 20
    assert versions.write(made(3), path) == 3 and versions.read(spark, path).count() == 30
    newest = versions.live(spark, path)
    file = Path(path) / newest["folder"] / max(newest["files"])
    file.write_bytes(file.read_bytes()[:-1])  # cut short
    assert versions.read(spark, path).count() == 20
    (Path(path) / "_log" / "00000009.json").write_text('{"version": 9, "fold')
    assert versions.read(spark, path).count() == 20
    assert versions.write(made(5), path) == 10 and versions.read(spark, path).count() == 50
    assert versions.restore(spark, path) == 2 and versions.read(spark, path).count() == 20
    assert versions.restore(spark, path) == 1 and versions.read(spark, path).count() == 10
    with pytest.raises(ValueError):
        versions.restore(spark, path)


def test_old_versions_go_and_batches_count_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in (0, 1, 1, 2, 3, 3, 4):
        versions.write(spark.range(batch + 1).coalesce(1), path, batch)
    folders = defaultdict(list)
    for p in Path(path).iterdir():
        folders[p.name.split("-")[0]].append(p.name)
    assert versions.live(spark, path)["version"] == 5 and len(folders["data"]) == 1 + versions.GENERATIONS
    assert versions.read(spark, path, 3).count() == 3
    with pytest.raises(FileExistsError):
        versions.Files(spark, path).write_new(f"{path}/_log/00000005.json", "{}")
    # a table without rows keeps its columns
    versions.write(spark.range(0), path)
    assert versions.read(spark, path).columns == ["id"] and versions.read(spark, path).count() == 0


def test_tables_that_are_kept_follow_their_input(spark, tmp_path):
    from hotspan.plans import master

    d = str(tmp_path / "in")
    got = lambda: master.kept("t", spark, d, lambda: spark.read.parquet(f"{d}/t.parquet")).count()
    for n in (3, 3, 5):
        spark.range(n).coalesce(1).write.mode("overwrite").parquet(f"{d}/t.parquet")
        assert got() == n
    assert got() == 5
