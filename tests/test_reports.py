"""What is told about clusters, held against the rules on small rows."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from hotspan.operators import report
from hotspan.plans import reports

SCHEMA = """cluster_id long, severity string, classification_label string, facility_type string, land_cover string, abnormality_level string,
    persistence_category string, active_days long, observation_count long, max_bright_ti4 double, bt_diff_max double, max_frp double, risk_score double,
    detection_reliability string, false_alarm_indicator string, evidence_confidence string, latitude double, longitude double, station_name string, station_km double, classification_score double, movement_status string"""
PLAIN = dict(cluster_id=1, severity="HIGH", classification_label="Unknown", facility_type="", land_cover="unknown", abnormality_level="NORMAL", persistence_category="isolated", active_days=1, observation_count=2, max_bright_ti4=300.0, bt_diff_max=5.0, max_frp=1.0, risk_score=61.26, detection_reliability="LOW", false_alarm_indicator="MEDIUM", evidence_confidence="LOW", latitude=12.5, longitude=-77.25, station_name=None, station_km=None, classification_score=0.5, movement_status="MOVING")


def one(spark, column, **changed):
    row = {**PLAIN, **changed}
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.split(","))], SCHEMA).select(column.alias("x")).first().x


def test_area_takes_the_first_that_fits(spark):
    assert one(spark, report.area_category()) == "MIXED_TERRAIN"
    assert one(spark, report.area_category(), facility_type="Oil REFINERY", land_cover="forest") == "INDUSTRIAL_ZONE"
    assert one(spark, report.area_category(), facility_type=None, land_cover="forest, built-up") == "FOREST_AREA"
    assert one(spark, report.area_category(), land_cover="cropland") == "AGRICULTURAL_AREA"
    assert one(spark, report.area_category(), land_cover="built-up") == "RESIDENTIAL_DOMESTIC"
    assert one(spark, report.area_category(), land_cover="grass") == "PARK_PROTECTED"


def test_evidence_needs_its_threshold(spark):
    keys = lambda **c: [e.key for e in one(spark, report.supporting_evidence(), **c)]
    assert keys() == [] and keys(max_frp=None, max_bright_ti4=None, bt_diff_max=None) == []
    assert keys(max_bright_ti4=340.0) == keys(bt_diff_max=45.0) == ["intensity"]
    assert keys(active_days=4, max_frp=15.0, abnormality_level="ELEVATED", detection_reliability="HIGH") == ["persistence", "frp", "abnormality", "reliability"]


def test_why_and_what_next(spark):
    assert one(spark, report.why_flagged()) == "Cluster flagged at HIGH level (Risk Score 61.3/100) because the anomaly exhibits localized thermal anomaly detection across 2 satellite observations."
    assert "elevated Fire Radiative Power (FRP 20.1 MW)" in one(spark, report.why_flagged(), max_frp=20.1)
    assert "moderate Fire Radiative Power (FRP 20.0 MW)" in one(spark, report.why_flagged(), max_frp=20.0)
    assert [len(one(spark, report.recommended_actions(), severity=s)) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", None)] == [4, 4, 3, 2, 2]


def test_message_has_ten_places(spark):
    places = one(spark, report.placeholders())
    assert places == ["HIGH", "1", "61", "12.50000,-77.25000", "Unknown", "LOW", "2", "1", "Verified fire station", "0.0"]
    assert "risk 61/100" in one(spark, report.message()) and one(spark, report.message(), station_name="A", station_km=2.04).count("A (2.0 km)") == 1


def test_attribution_ranks_by_size(spark):
    up, down, told = report.attribution({"a": F.lit(1.0), "b": F.lit(-7.0), "c": F.lit(3.0), "d": F.lit(None).cast("double"), "e": F.lit(1.0)}, most=2)
    assert (one(spark, up), one(spark, down)) == ("c (3.000), a (1.000)", "b (-7.000)")
    assert one(spark, told).endswith("Overall negative signal dominates")


def test_small_rules(spark):
    status = lambda s: one(spark, report.settled(F.lit(s).cast("string")))
    assert [status(s) for s in ("Cloud obscured", "Request TIMED OUT", "", None)] == [True, False, False, False]
    patch = lambda *v: one(spark, report.unusable_patch(*map(F.lit, v)))
    assert patch(0, 0, 0, 0) and patch(100, 96, 1000, 10**6) and patch(4, 0, 400, 40000) and not patch(4, 0, 400, 50000)
    tags = lambda **t: F.create_map(*[F.lit(x) for kv in (t or {"x": "y"}).items() for x in kv])
    head = lambda **t: one(spark, report.location_header(tags(**t), F.lit(1.5), F.lit(-2.0)))
    assert head(town="T", county="C", state="S") == "T, C, S" and head(suburb="L", state_district="S") == "L, S" and head(city="") == "Coordinates: 1.5000, -2.0000"
    assert one(spark, report.facility_kind(tags(industrial=" ", power="plant"))) == "plant" and one(spark, report.facility_kind(tags())) == "industrial"
    assert one(spark, report.coordinates(F.col("latitude"), F.col("longitude"))) == "12.500°N, 77.250°W"


def test_sort_and_run_status(spark):
    x = spark.createDataFrame([(1, "LOW"), (2, "HIGH"), (3, None), (4, "ELEVATED"), (5, "odd")], "id int, level string")
    assert [r.id for r in x.orderBy(*report.sort_keys(x, "level", ascending=False)).collect()] == [2, 4, 1, 5, 3]
    assert [r.id for r in x.orderBy(*report.sort_keys(x, "id")).collect()] == [1, 2, 3, 4, 5]
    runs = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (2, "a", "y"), (3, "a", None)], "run int, product string, error string")
    assert sorted(tuple(r) for r in report.run_status(runs, "run").collect()) == [(1, "degraded", "b: x"), (2, "failed", "a: y"), (3, "healthy", "")]


def test_all_reports_are_registered_with_sql():
    assert set(reports.queries()) == set(reports.oracle_sql()) and set(reports.queries()) <= set(entry.queries())


def test_area_by_reasons_and_settlement(spark):
    assert one(spark, report.area(rationale=F.lit("Dense Forest canopy")))[0] == "FOREST_AREA" and one(spark, report.area(rationale=F.lit(None)))[0] == "MIXED_TERRAIN"
    assert one(spark, report.area(rationale=F.lit("crop burning")), land_cover="urban")[1] == "Agricultural / Farmland Area"
    for town, locality, kind in (("Pune", None, "RESIDENTIAL_DOMESTIC"), (report.NONE, "Colony", "RESIDENTIAL_DOMESTIC"), (report.NONE, "", "MIXED_TERRAIN"), (None, None, "MIXED_TERRAIN")):
        assert one(spark, report.area_category(town=F.lit(town), locality=F.lit(locality))) == kind
    assert one(spark, report.area_category(town=F.lit("Pune")), land_cover="forest") == "FOREST_AREA"


def test_evidence_for_and_against(spark):
    row = {**PLAIN, "classification_score": 0.655, "movement_status": "INSUFFICIENT_DATA"}
    told = lambda imagery=None, **c: {e.key: (e.side, e.label, e.why) for e in one(spark, report.evidence(imagery), **{**row, **c})}
    plain = told()
    assert list(plain) == ["satellite", "movement", "station"] and all(v[0] == "limiting" for v in plain.values())
    assert list(told(F.lit(True), movement_status="MOVING", station_km=4.0)) == []
    assert list(told(F.lit(None).cast("boolean"), movement_status=None, station_km=4.0)) == ["satellite"]
    more = told(F.lit(True), classification_label="Industrial-context", false_alarm_indicator="HIGH", station_km=4.0, abnormality_level="ELEVATED", active_days=None, persistence_category="Persistent", movement_status="MOVING")
    assert more["context"][2] == "The source-classification model assigned a confidence of 66% (Industrial-context)." and more["abnormality"][1] == "ELEVATED statistical abnormality"
    assert more["persistence"][2] == "Activity spans 1 active day(s) with persistence category 'persistent'." and more["fa"][0] == "limiting"


def test_searches_rank_names_before_aliases_before_beginnings(spark):
    rows = [("Delhi", ["Dilli", "New Delhi"]), ("Delhi Cantt", None), ("Dehradun", ["delhi"]), ("Agra", ["Near Delhi", None]), ("Pune", [])]
    df = spark.createDataFrame(rows, "name string, aliases array<string>")
    got = lambda q: {r.name: r.x for r in df.select("name", report.relevance(F.col("name"), F.col("aliases"), F.lit(q)).alias("x")).collect() if r.x is not None}
    assert got(" DELHI ") == {"Delhi": 0, "Dehradun": 1, "Delhi Cantt": 2, "Agra": 3}
    assert got("  ") == {} and got(None) == {} and got("pune") == {"Pune": 0}


def test_json_holds_no_nan(spark):
    from hotspan.functions import scalar

    df = spark.createDataFrame([(float("nan"), float("inf"), None, None, 1), (1.5, -2.0, "x", "y", None)], "a double, b float, t string, u string, n int")
    assert [tuple(r) for r in scalar.json_safe(df, ("t",)).collect()] == [(None, None, "", None, 1), (1.5, -2.0, "x", "y", None)]
