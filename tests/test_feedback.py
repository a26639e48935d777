import json

from pyspark.sql import functions as F

from incidentflow.operators import feedback as FB
from incidentflow.sources import readers as R
from incidentflow.schema import FEEDBACK_SCHEMA

# Golden ledger: the 28 shipped rows (seq, id, cause, pred sev, act sev, pred dur, act dur,
# rec off, act off, rec bar, act bar, diversion, rating, timestamp), see FIXTURES.md section 5.
GOLDEN = [
    (1, "SIM-1001", "water_logging", "Medium", "Medium", 38.0, 49.0, 4, 4, 5, 7, "yes", 3, "2026-06-10T10:30:00Z"),
    (2, "SIM-1002", "vehicle_breakdown", "High", "High", 46.0, 57.0, 8, 7, 15, 17, "yes", 4, "2026-06-11T10:30:00Z"),
    (3, "SIM-1003", "protest", "Critical", "Critical", 54.0, 39.0, 15, 15, 30, 30, "yes", 4, "2026-06-11T10:30:00Z"),
    (4, "SIM-1004", "construction", "Low", "High", 62.0, 80.0, 2, 2, 0, 0, "no", 2, "2026-06-12T10:30:00Z"),
    (5, "SIM-1005", "public_event", "Medium", "Critical", 70.0, 70.0, 4, 5, 5, 10, "yes", 3, "2026-06-12T10:30:00Z"),
    (6, "SIM-1006", "accident", "High", "High", 78.0, 68.0, 8, 8, 15, 17, "yes", 3, "2026-06-13T10:30:00Z"),
    (7, "SIM-1007", "water_logging", "Critical", "Critical", 86.0, 86.0, 15, 16, 30, 28, "no", 2, "2026-06-13T10:30:00Z"),
    (8, "SIM-1008", "vehicle_breakdown", "Low", "Low", 94.0, 93.0, 2, 3, 0, 5, "yes", 3, "2026-06-14T10:30:00Z"),
    (9, "SIM-1009", "protest", "Medium", "Medium", 102.0, 123.0, 4, 3, 5, 5, "yes", 3, "2026-06-14T10:30:00Z"),
    (10, "SIM-1010", "construction", "High", "High", 110.0, 108.0, 8, 8, 15, 15, "yes", 5, "2026-06-15T10:30:00Z"),
    (11, "SIM-1011", "public_event", "Critical", "Critical", 118.0, 125.0, 15, 15, 30, 30, "yes", 4, "2026-06-15T10:30:00Z"),
    (12, "SIM-1012", "accident", "Low", "Low", 126.0, 131.0, 2, 2, 0, 0, "yes", 4, "2026-06-16T10:30:00Z"),
    (13, "SIM-1013", "water_logging", "Medium", "Medium", 134.0, 121.0, 4, 4, 5, 5, "yes", 3, "2026-06-16T10:30:00Z"),
    (14, "SIM-1014", "vehicle_breakdown", "High", "High", 142.0, 138.0, 8, 8, 15, 15, "yes", 4, "2026-06-17T10:30:00Z"),
    (15, "SIM-1015", "protest", "Critical", "Critical", 30.0, 30.0, 15, 15, 30, 30, "yes", 5, "2026-06-17T10:30:00Z"),
    (16, "SIM-1016", "construction", "Low", "Low", 38.0, 36.0, 2, 2, 0, 0, "yes", 3, "2026-06-18T10:30:00Z"),
    (17, "SIM-1017", "public_event", "Medium", "Medium", 46.0, 43.0, 4, 4, 5, 5, "yes", 4, "2026-06-18T10:30:00Z"),
    (18, "SIM-1018", "accident", "High", "High", 54.0, 52.0, 8, 8, 15, 15, "yes", 5, "2026-06-19T10:30:00Z"),
    (19, "SIM-1019", "water_logging", "Critical", "Critical", 62.0, 62.0, 15, 15, 30, 30, "yes", 5, "2026-06-19T10:30:00Z"),
    (20, "SIM-1020", "vehicle_breakdown", "Low", "Low", 70.0, 72.0, 2, 2, 0, 0, "yes", 5, "2026-06-20T10:30:00Z"),
    (21, "EVT-28043", "accident", "Critical", "Critical", 38.8, 39.0, 15, 15, 30, 30, "yes", 3, "2026-06-21T11:56:07.005657Z"),
    (22, "EVT-31494", "accident", "Critical", "Critical", 50.2, 65.0, 15, 12, 30, 25, "yes", 4, "2026-06-22T04:50:07.906795Z"),
    (23, "EVT-17623", "accident", "Critical", "Medium", 62.1, 62.0, 15, 15, 30, 30, "yes", 3, "2026-06-22T04:58:49.715519Z"),
    (24, "EVT-92735", "accident", "Critical", "Critical", 78.0, 60.0, 15, 10, 30, 35, "yes", 3, "2026-06-22T05:01:01.899144Z"),
    (25, "TEST-9999", "accident", "Critical", "Critical", 120.0, 50.0, 15, 8, 30, 10, "yes", 5, "2026-06-22T05:01:01.953287Z"),
    (26, "TEST-9999", "accident", "Critical", "Critical", 120.0, 50.0, 15, 8, 30, 10, "yes", 5, "2026-06-22T05:21:59.021550Z"),
    (27, "EVT-56312", "accident", "High", "High", 55.3, 55.0, 8, 8, 15, 15, "yes", 3, "2026-06-22T16:40:49.015366Z"),
    (28, "EVT-29656", "accident", "Critical", "Critical", 55.1, 55.0, 15, 15, 30, 30, "yes", 3, "2026-06-22T17:23:27.477738Z"),
]
FIELDS = ["seq", "event_id", "event_cause", "predicted_severity", "actual_severity", "predicted_duration",
          "actual_duration", "recommended_officers", "actual_officers", "recommended_barricades",
          "actual_barricades", "diversion_effective", "rating", "timestamp"]

CURVE = {5: (60.0, 11.0), 6: (66.7, 10.8), 7: (71.4, 9.3), 8: (75.0, 8.2), 9: (77.8, 9.7), 10: (80.0, 8.9),
         11: (81.8, 8.7), 12: (83.3, 8.4), 13: (84.6, 8.8), 14: (85.7, 8.4), 15: (86.7, 7.9), 16: (87.5, 7.5),
         17: (88.2, 7.2), 18: (88.9, 6.9), 19: (89.5, 6.6), 20: (90.0, 6.3), 21: (90.5, 6.1), 22: (90.9, 6.5),
         23: (87.0, 6.2), 24: (87.5, 6.7), 25: (88.0, 9.2), 26: (88.5, 11.5), 27: (88.9, 11.1), 28: (89.3, 10.7)}


def golden(spark):
    from pyspark.sql import types as T
    schema = T.StructType([FEEDBACK_SCHEMA[c] for c in FIELDS[:-1]] + [T.StructField("timestamp", T.StringType())])
    return spark.createDataFrame(GOLDEN, schema)


def test_golden_stats(spark):
    r = FB.feedback_stats(golden(spark)).first()
    assert (r.total_feedback_events, r.average_rating, r.severity_prediction_accuracy,
            r.duration_mae_minutes, r.manpower_savings_count) == (28, 3.68, 89.3, 10.7, 24)


def test_golden_learning_curve(spark):
    for chunks in (1, 3, 7, 40):
        got = {r.event_count: (r.accuracy, r.mae) for r in FB.learning_curve(golden(spark), chunks=chunks).collect()}
        assert got == CURVE, chunks


def test_two_pass_equals_plain_window(spark):
    from incidentflow.sources import fixtures as fx
    fb = fx.feedback(spark, "/root/testdata/sf0.001")
    a = sorted(tuple(r) for r in FB.learning_curve(fb, chunks=5).collect())
    b = sorted(tuple(r) for r in FB.learning_curve_plain(fb).collect())
    assert a == b and len(a) > 100


def test_empty_ledger(spark):
    empty = spark.createDataFrame([], FEEDBACK_SCHEMA)
    r = FB.feedback_stats(empty).first()
    assert tuple(r) == (0, 0.0, 0.0, 0.0, 0)
    assert FB.learning_curve(empty).count() == 0


def test_short_ledgers(spark):
    g = golden(spark)
    assert FB.learning_curve(g.filter("seq <= 4")).count() == 0
    assert FB.learning_curve(g.filter("seq <= 5")).count() == 1


def test_search_filters(spark):
    g = golden(spark)
    ids = lambda df: sorted(r.seq for r in df.collect())
    assert len(ids(FB.search_feedback(g))) == 28
    assert ids(FB.search_feedback(g, text="Water Logging")) == [1, 7, 13, 19]
    assert ids(FB.search_feedback(g, text="water_logging")) == []          # the cause is matched with spaces
    assert ids(FB.search_feedback(g, text="test-99")) == [25, 26]
    assert ids(FB.search_feedback(g, severity="Medium")) == [1, 5, 9, 13, 17, 23]   # 23: actual side only
    assert ids(FB.search_feedback(g, rating="2")) == [4, 7]


def test_json_reader_two_generations(spark, tmp_path):
    rows = []
    for row in GOLDEN:
        rec = dict(zip(FIELDS[1:], row[1:]))
        if row[0] >= 22:
            rec.update(event_type="unplanned", requires_road_closure=True, priority="High",
                       corridor="Hosur Road", police_station="Hebbal", hour=18, day_of_week=1)
        rows.append(rec)
    path = tmp_path / "ledger.json"
    path.write_text(json.dumps(rows, indent=2))
    fb = R.read_feedback(spark, str(path))
    assert fb.count() == 28
    assert [r.seq for r in fb.orderBy("seq").select("seq").collect()] == list(range(1, 29))
    assert fb.filter(F.col("hour").isNull()).count() == 21
    d = FB.feedback_defaults(fb)
    assert d.filter((F.col("hour") == 12) & (F.col("police_station") == "Unknown")).count() == 21
    r = FB.feedback_stats(fb).first()
    assert (r.average_rating, r.severity_prediction_accuracy, r.duration_mae_minutes) == (3.68, 89.3, 10.7)
    assert fb.select("event_id").distinct().count() == 27
    missing = R.read_feedback(spark, str(tmp_path / "absent.json"))
    assert missing.count() == 0


def test_training_union_keeps_duplicates(spark):
    from incidentflow.sources import fixtures as fx
    from incidentflow.operators.features import train_table
    inc = fx.incidents(spark, "/root/testdata/sf0.001")
    tr, fb = train_table(inc), fx.feedback_from_incidents(inc)
    u = FB.training_union(tr, fb.unionByName(fb))
    assert u.count() == tr.count() + 2 * fb.count()
    assert u.filter("is_feedback").select(F.min("weight")).first()[0] == 10.0
