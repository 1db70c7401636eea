"""Raw files, logs and reasons on small inputs."""

import pytest

from hotspan.operators import reasoning
from hotspan.sources import files

HEAD = "latitude,longitude,acq_date,acq_time,satellite,confidence"


def test_scan_leaves_out_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "firms_viirs_noaa20_a.csv").write_text(f"{HEAD}\n1.5,2.5,2024-01-01,5,N,n\n1.6,2.5,2024-01-01,5,N,h\n")
    (tmp_path / "firms_snpp.csv").write_text("frp,confidence,satellite,acq_time,acq_date,longitude,latitude\n9.5,l,1,1200,2024-01-02,70,8\n")
    (tmp_path / "firms_other.csv").write_text("latitude,longitude\n1,2\n")
    (tmp_path / "firms_empty.csv").write_text("")
    (tmp_path / "firms_noise.csv").write_bytes(bytes(range(256)))
    (tmp_path / "other.csv").write_text(f"{HEAD}\n0,0,2024-01-01,5,N,n\n")
    rows, skipped = files.scan(spark, str(tmp_path))
    got = sorted(tuple(r) for r in rows.select("source_file", "source_satellite", "latitude", "acq_time", "frp").collect())
    assert got == [("firms_snpp.csv", "SUOMI-NPP", "8", "1200", "9.5"), ("firms_viirs_noaa20_a.csv", "NOAA-20", "1.5", "5", None), ("firms_viirs_noaa20_a.csv", "NOAA-20", "1.6", "5", None)]
    assert skipped == ["firms_empty.csv", "firms_noise.csv", "firms_other.csv"]


def test_header_is_the_first_line_and_is_read_alone(spark, tmp_path):
    row = "1.5,2.5,2024-01-01,5,N,n\n"
    (tmp_path / "firms_a b%20.csv").write_text(f"\n{HEAD}\n{row}{HEAD}\n")  # a header that comes again is a row
    (tmp_path / "firms_bom.csv").write_bytes(b"\xef\xbb\xbf" + f"{HEAD}\r\n{row}".encode())
    (tmp_path / "firms_late.csv").write_text(f"{row}{HEAD}\n{row}")
    (tmp_path / "firms_twice.csv").write_text(f"{HEAD},Latitude\n{row}")
    (tmp_path / "firms_unnamed.csv").write_text(f"{HEAD},\n{row}")
    (tmp_path / "firms_only.csv").write_text(HEAD)
    (tmp_path / "firms_endless.csv").write_text(f"{HEAD},{'x' * 70000}\n{row}")
    (tmp_path / "firms_parts.csv").mkdir()
    for part in (1, 2):
        (tmp_path / "firms_parts.csv" / f"part-{part}.csv").write_text(f'"{HEAD.replace(",", chr(34) + "," + chr(34))}"\n{row}')
    rows, skipped = files.scan(spark, str(tmp_path))
    got = sorted((r.source_file, r.latitude) for r in rows.select("source_file", "latitude").collect())
    assert [lat for _, lat in got if lat == "1.5"] == ["1.5"] * 4 and len(got) == 5 and ("firms_parts.csv", "1.5") in got and ("firms_bom.csv", "1.5") in got
    assert skipped == ["firms_endless.csv", "firms_late.csv", "firms_twice.csv", "firms_unnamed.csv"]


def test_scan_of_nothing_readable_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        files.scan(spark, str(tmp_path))
    (tmp_path / "firms_a.csv").write_text("latitude\n1\n")
    with pytest.raises(ValueError):
        files.scan(spark, str(tmp_path))


def test_state_outlives_bad_lines_and_missing_files(spark, tmp_path):
    path = str(tmp_path / "state")
    assert files.read_state(spark, path, "run int").count() == 0
    for run in (1, 2):
        files.append_log(spark.createDataFrame([(run,)], "run int"), path)
    (tmp_path / "state" / "part-bad.json").write_text('{"run": \n[1]\n')
    assert sorted(r.run for r in files.read_state(spark, path, "run int").collect()) == [1, 2]
    for n in (5, 6):
        files.write_once(spark.createDataFrame([(n,)], "n int"), str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).first().n == 5


def test_reasons_follow_the_class(spark):
    schema = "cluster_id long, classification_label string, classification_score double, persistence_category string, movement_status string, bt_diff_max double, active_days long, max_frp double, facility_type string, risk_level string, risk_score double"
    rows = [
        (1, "Industrial-context thermal event", 0.75, "persistent", "STATIONARY", 36.0, 5, 1.0, "refinery", "HIGH", 61.25),
        (2, "Agricultural-context thermal event", 0.5, "isolated", None, None, None, 5.0, None, "MEDIUM", 40.0),
        (3, "Forest/Natural-context thermal event", 0.4, "isolated", "STATIONARY", 1.0, 2, 20.0, None, "LOW", 1.0),
        (4, "Unknown / Insufficient Evidence", 0.0, "persistent", "MOVING", 50.0, 1, 50.0, "refinery", "HIGH", 90.0),
    ]
    got = spark.createDataFrame(rows, schema).orderBy("cluster_id").select(reasoning.trimmed().alias("why"), reasoning.change().alias("change"), reasoning.summary().alias("summary"), reasoning.brief().alias("brief")).collect()
    assert got[0].why.count("; ") == 3 and got[0].summary.endswith(" | High confidence prediction")
    assert got[1].why == "Classification: Agricultural-context thermal event (confidence: 0.50); Short duration typical of crop burning"
    assert got[2].why == "Classification: Forest/Natural-context thermal event (confidence: 0.40)" and "Low confidence" in got[2].summary
    assert got[3].why.endswith("(confidence: 0.00)") and got[3].change.startswith("Insufficient evidence")
    assert got[0].brief.endswith("• Near industrial facility: refinery\n\nRecommendation:\n• Priority monitoring recommended\n• Consider ground verification")
    assert got[3].brief == "=== CLUSTER 4 ASSESSMENT ===\n\nClassification: Unknown / Insufficient Evidence\nConfidence: 0%\n\nRisk Level: HIGH (Score: 90.00/100)\n\nKey Evidence:\n\nRecommendation:\n• Routine monitoring sufficient"


def test_downloads_are_never_written_again(spark, tmp_path):
    import datetime as dt

    folder, day = str(tmp_path / "raw"), dt.date(2024, 1, 1)
    rows = lambda *x: spark.createDataFrame([(p, day + dt.timedelta(k), v) for p, k, v in x], "product string, acq_date date, v int")
    asked = lambda *x: spark.createDataFrame([(p, day + dt.timedelta(k), n) for p, k, n in x], "product string, chunk_start date, chunk_days int")
    told = lambda df: sorted((r.product, (r.chunk_start - day).days, r.record_count, r.outcome) for r in df.collect())
    first = files.fetch_range(rows(("a", 0, 1), ("a", 4, 2), ("a", 5, 3), ("b", 0, 4)), asked(("a", 0, 5), ("a", 0, 5), ("b", 5, 5)), folder)
    assert told(first) == [("a", 0, 2, "saved"), ("b", 5, 0, "empty")]
    again = files.fetch_range(rows(("a", 0, 9), ("a", 1, 9), ("a", 2, 9), ("b", 6, 5)), asked(("a", 0, 5), ("b", 5, 5), ("a", 5, 1)), folder)
    assert told(again) == [("a", 0, 2, "kept"), ("a", 5, 0, "empty"), ("b", 5, 1, "saved")]
    assert sorted(r.v for r in spark.read.parquet(folder).collect()) == [1, 2, 5]
