import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from incidentflow import constants as K
from incidentflow.operators import clean as C
from incidentflow.operators import geo as GEO
from incidentflow.operators.features import train_table
from incidentflow.sources import fixtures as fx
from incidentflow.sources import readers as R
from incidentflow.sources import writers as W


def test_parquet_scan_pushes_box_filter(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="inc-"), "incidents")
    fx.incidents(spark, SF001).write.mode("overwrite").parquet(path)
    df = C.in_bbox(R.read_incidents(spark, path), K.TIGHT_BOX).select("incident_id", "latitude")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(latitude), IsNotNull(longitude), GreaterThan(latitude,12.8)" in plan
    assert "ReadSchema: struct<incident_id:bigint,latitude:double,longitude:double>" in plan
    assert df.count() == C.serve_table(fx.incidents(spark, SF001)).count()


def test_csv_scan_coerces_junk(spark, tmp_path):
    p = tmp_path / "inc.csv"
    p.write_text("incident_id,event_type,event_cause,priority,requires_road_closure,corridor,police_station,"
                 "junction,latitude,longitude,start_datetime,closed_datetime\n"
                 "1,planned,accident,High,True,C1,S1,J1,12.97,77.59,2024-01-01 08:00:00,2024-01-01 09:00:00\n"
                 "2,,protest,,maybe,,,,n/a,77.5,garbage,\n")
    rows = {r.incident_id: r for r in R.read_incidents(spark, str(p), fmt="csv").collect()}
    assert rows[1].requires_road_closure is True and rows[1].latitude == 12.97
    assert rows[2].latitude is None and rows[2].start_datetime is None and rows[2].requires_road_closure is None


def test_dims_round_trip(spark, tmp_path):
    st = GEO.station_centroids(train_table(fx.incidents(spark, SF001)))
    for fmt in ("parquet", "json"):
        path = str(tmp_path / f"st_{fmt}")
        W.write_dim(st, path, fmt=fmt)
        back = R.read_dim(spark, path)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, st.collect()))
    # the original single-object map form, and a missing file
    mp = tmp_path / "map.json"
    mp.write_text('{"A": {"lat": 12.9, "lng": 77.5}, "default": {"lat": 12.9716, "lng": 77.5946}}')
    assert sorted(map(tuple, R.read_dim(spark, str(mp)).collect())) == [("A", 12.9, 77.5),
                                                                         ("default", 12.9716, 77.5946)]
    assert R.read_dim(spark, str(tmp_path / "absent")).count() == 0


def test_append_is_idempotent_per_batch(spark, tmp_path):
    fb = fx.feedback(spark, SF001)
    path = str(tmp_path / "ledger")
    W.append_feedback(fb, path, batch_id=1)
    W.append_feedback(fb, path, batch_id=1)
    assert R.read_feedback(spark, path).count() == fb.count()
    rec = fb.limit(2).drop("seq", "timestamp")
    W.append_feedback(rec, path)
    back = R.read_feedback(spark, path)
    assert back.count() == fb.count() + 2 and back.filter(F.col("timestamp").isNull()).count() == 0


def test_date_partitioned_incidents_prune(spark, tmp_path):
    inc = fx.incidents(spark, SF001)
    path = str(tmp_path / "inc_by_day")
    W.write_incidents(inc, path)
    back = R.read_incidents(spark, path)
    assert back.count() == inc.count()
    day = back.filter((F.col("start_date") >= "2024-01-10") & (F.col("start_date") < "2024-01-12"))
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(start_date" in plan
    exp = inc.filter((F.to_date("start_datetime") >= "2024-01-10") & (F.to_date("start_datetime") < "2024-01-12"))
    assert day.count() == exp.count() > 0


def test_csv_by_header_name(spark, tmp_path):
    p = tmp_path / "inc.csv"
    p.write_text("remark,police_station,event_type,longitude,start_datetime,latitude,priority\n"
                 "x,North,planned,77.6,2024-01-01T08:00:00+05:30,12.97,High\n"
                 "y,\"A, B\",unplanned,junk,2024-01-01 09:30:00,,\n")
    rows = {r.police_station: r for r in R.read_incidents(spark, str(p), fmt="csv").collect()}
    a, b = rows["North"], rows["A, B"]
    assert (a.event_type, a.latitude, a.longitude, a.priority) == ("planned", 12.97, 77.6, "High")
    assert str(a.start_datetime) == "2024-01-01 02:30:00" and str(b.start_datetime) == "2024-01-01 09:30:00"
    assert b.longitude is None and b.latitude is None and b.closed_datetime is None
    again = {r.police_station: r.incident_id for r in R.read_incidents(spark, str(p), fmt="csv").collect()}
    assert again == {k: r.incident_id for k, r in rows.items()} and a.incident_id != b.incident_id


def test_json_ledger_in_file_order(spark, tmp_path):
    import json
    rows = [{"event_id": f"E{i:03d}", "rating": i % 5} for i in range(60)]
    (tmp_path / "l").mkdir()
    for name, lo, hi in (("a.json", 0, 3), ("b.json", 3, 40), ("c.json", 40, 60)):
        part = rows[lo:hi]
        text = json.dumps(part) if name == "b.json" else "\n".join(map(json.dumps, part))   # array and lines
        (tmp_path / "l" / name).write_text(text)
    got = sorted((r.seq, r.event_id) for r in R.read_feedback(spark, str(tmp_path / "l")).collect())
    assert got == [(i + 1, r["event_id"]) for i, r in enumerate(rows)]


def test_shared_folder_is_required_off_local_mode():
    from types import SimpleNamespace as N
    from incidentflow.session import ensure_checkpoint_dir
    conf = N(get=lambda k, d=None: d, set=lambda k, v: None)
    fake = N(sparkContext=N(master="spark://host:7077", getCheckpointDir=lambda: None), conf=conf)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(fake)


def test_package_code_travels_by_value():
    from pyspark import cloudpickle
    assert "incidentflow" in cloudpickle.list_registry_pickle_by_value()


def test_rejected_csv_records(spark, tmp_path):
    """Short and long lines and texts that a column cannot hold: side table with file and reason, all counted."""
    good = 'id-less,1,Accident,High,true,Hosur,Hebbal,J1,12.9,77.5,2024-01-01 10:00:00,2024-01-01 11:00:00'
    head = "remark,incident_id,event_cause,priority,requires_road_closure,corridor,police_station,junction,latitude,longitude," \
           "start_datetime,closed_datetime"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join([head, good, "x,2,Accident", good.replace("12.9", "north").replace(",1,", ",3,")]))
    (tmp_path / "in" / "b.csv").write_text("\n".join([head, good.replace(",1,", ",4,") + ",one,more", good.replace(",1,", ",5,").replace(
        "2024-01-01 10:00:00", "noon"), good.replace(",1,", ",6,").replace("12.9", "")]))
    rows, rejects, counts = R.read_incidents_checked(spark, str(tmp_path / "in"), rejects_path=str(tmp_path / "rejects"))
    assert sorted(r.incident_id for r in rows.collect()) == [1, 3, 5, 6]
    assert {r.incident_id: r.latitude for r in rows.collect()} == {1: 12.9, 3: None, 5: 12.9, 6: None}
    got = sorted((r.file.rsplit("/", 1)[1], r.reason) for r in rejects.collect())
    assert got == [("a.csv", "fields"), ("a.csv", "values: latitude"), ("b.csv", "fields"), ("b.csv", "values: start_datetime")]
    seen = counts.get
    assert seen["lines"] == 6 and seen["malformed"] == 2 and seen["latitude"] == 1 and seen["start_datetime"] == 1
    assert seen["longitude"] == 0
    plain = R.read_incidents(spark, str(tmp_path / "in"), fmt="csv").filter("incident_id IN (1, 3, 5, 6)")
    assert plain.exceptAll(rows).count() == 0 and rows.exceptAll(plain).count() == 0
