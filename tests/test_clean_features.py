from pyspark.sql import functions as F

from conftest import incident_rows
from incidentflow.operators import clean as C
from incidentflow.operators import features as FE
from incidentflow import constants as K


def test_fill_defaults_and_bool(spark):
    df = incident_rows(spark, [(1, None, None, None, None, None, None, 13.0, 77.5, None, None)])
    r = C.fill_defaults(df).first()
    assert (r.event_cause, r.priority, r.corridor, r.police_station, r.requires_road_closure) == \
        ("others", "Low", "Non-corridor", "Unknown", False)


def test_coerce_bool_text(spark):
    df = spark.createDataFrame([(1, "False"), (2, "true"), (3, "junk"), (4, None)], "id long, requires_road_closure string")
    got = dict(C.coerce_bool(df).select("id", "requires_road_closure").collect())
    assert got == {1: False, 2: True, 3: False, 4: False}


def test_coerce_coords(spark):
    df = spark.createDataFrame([("12.9", "x"), ("n/a", "77.5")], "latitude string, longitude string")
    got = [tuple(r) for r in C.coerce_coords(df).collect()]
    assert got == [(12.9, None), (None, 77.5)]


def test_tight_box_is_strict(spark):
    rows = [(i, "a", "Low", False, "c", "s", "j", lat, lng, None, None) for i, (lat, lng) in enumerate(
        [(12.8, 77.5), (13.2, 77.5), (13.0, 77.4), (13.0, 77.8), (13.0, 77.6), (12.8001, 77.7999)])]
    got = sorted(r.incident_id for r in C.in_bbox(incident_rows(spark, rows), K.TIGHT_BOX).collect())
    assert got == [4, 5]


def test_wide_box_is_strict(spark):
    rows = [(i, "a", "Low", False, "c", "s", "j", lat, lng, None, None) for i, (lat, lng) in enumerate(
        [(12.0, 77.5), (14.0, 77.5), (13.0, 77.0), (13.0, 78.5), (13.9, 78.4)])]
    got = [r.incident_id for r in C.in_bbox(incident_rows(spark, rows), K.WIDE_BOX).collect()]
    assert got == [4]


def test_parse_times_and_duration_cap(spark):
    rows = [(1, "a", "Low", False, "c", "s", "j", 13.0, 77.5, "2024-01-01 10:00:00", "2024-01-01 10:00:00"),
            (2, "a", "Low", False, "c", "s", "j", 13.0, 77.5, "2024-01-01 10:00:00", "2024-01-03 10:00:00"),
            (3, "a", "Low", False, "c", "s", "j", 13.0, 77.5, "2024-01-01 10:00:00", "2024-01-01 10:00:06"),
            (4, "a", "Low", False, "c", "s", "j", 13.0, 77.5, "2024-01-01T10:00:00Z", "2024-01-03 09:59:54"),
            (5, "a", "Low", False, "c", "s", "j", 13.0, 77.5, "not a time", "2024-01-01 10:00:00")]
    df = C.with_duration(incident_rows(spark, rows))
    got = {r.incident_id: r.duration_min for r in df.collect()}
    assert got[1] == 0.0 and got[2] == 2880.0 and abs(got[3] - 0.1) < 1e-12 and abs(got[4] - 2879.9) < 1e-9
    assert got[5] is None
    kept = sorted(r.incident_id for r in C.cap_duration(df).collect())
    assert kept == [3, 4]


def _score(spark, cause, priority, closure, corridor, hour):
    ts = f"2024-01-01 {hour:02d}:30:00"
    df = incident_rows(spark, [(1, cause, priority, closure, corridor, "s", "j", 13.0, 77.5, ts, None)])
    return FE.train_table(df).first()


def test_severity_bounds(spark):
    r = _score(spark, "pot_holes", "Low", True, "Non-corridor", 3)        # 2 x 1.5 = 3.0
    assert r.congestion_score == 3.0 and r.congestion_severity == "Medium"
    r = _score(spark, "protest", "Low", False, "Non-corridor", 3)         # 5.0
    assert r.congestion_score == 5.0 and r.congestion_severity == "High"
    r = _score(spark, "Tree_Fall", "High", True, "Corridor 1", 3)         # 3 x 1.3 x 1.5 x 1.2 = 7.02
    assert abs(r.congestion_score - 7.02) < 1e-12 and r.congestion_severity == "Critical"
    r = _score(spark, "vehicle_breakdown", "Low", False, "Corridor 1", 3)  # 2.4
    assert r.congestion_severity == "Low"
    r = _score(spark, "unlisted cause", "Low", False, "Non-corridor", 9)   # 2 x 1.2 peak
    assert abs(r.congestion_score - 2.4) < 1e-12 and r.is_peak_hour == 1


def test_time_features_monday_zero(spark):
    df = incident_rows(spark, [(1, "a", "Low", False, "c", "s", "j", 13.0, 77.5, "2024-01-01 17:00:00", None)])
    r = FE.train_table(df).first()     # 2024-01-01 is a Monday
    assert (r.hour, r.day_of_week, r.month, r.is_peak_hour) == (17, 0, 1, 1)


def test_weight(spark):
    df = spark.range(2).withColumn("f", F.col("id") == 1)
    got = dict((r.id, r.weight) for r in FE.with_weight(df, F.col("f")).collect())
    assert got == {0: 1.0, 1: 10.0}
