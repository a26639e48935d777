import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from incidentflow.operators import feedback as FB
from incidentflow.operators import learn as L
from incidentflow.operators.features import train_table
from incidentflow.sources import fixtures as fx
from incidentflow.sources import readers as R
from incidentflow.streaming import ingest as ST


def test_vocab_and_safe_encoding(spark):
    df = spark.createDataFrame([("planned", "b", "Low", "x", "S2"), (None, "a", "High", "y", "S1")],
                               "event_type string, event_cause string, priority string, corridor string, "
                               "police_station string")
    vocab = L.fit_vocab(df)
    v = {(r.feature, r.value): r.code for r in vocab.collect()}
    assert v[("event_type", "Unknown")] == 0 and v[("event_type", "planned")] == 1   # 'U' < 'p'
    assert v[("police_station", "S1")] == 0 and v[("police_station", "Unknown")] == 2
    req = spark.createDataFrame([("planned", "zzz", "Low", "x", "S9")], df.schema)
    r = L.encode(req, vocab).first()
    assert r.event_cause_code == v[("event_cause", "Unknown")] and r.police_station_code == 2
    no_unknown = vocab.filter(F.col("value") != "Unknown")
    assert L.encode(req, no_unknown).first().event_cause_code == 0      # first class


def test_split_is_stable_and_about_a_fifth(spark):
    rows = spark.range(20000).select(F.concat(F.lit("h-"), F.col("id").cast("string")).alias("row_key"))
    a = rows.repartition(7).select("row_key", L.split_flag().alias("t"))
    b = rows.repartition(3).select("row_key", L.split_flag().alias("t"))
    assert a.exceptAll(b).count() == 0
    frac = a.agg(F.avg(F.col("t").cast("double"))).first()[0]
    assert 0.18 < frac < 0.22


def test_severity_forest_learns_rule(spark):
    inc = fx.incidents(spark, "/root/testdata/sf0.01")
    tr = train_table(inc)
    empty = spark.createDataFrame([], fx.feedback_from_incidents(inc).schema)
    rows = L.classifier_rows(tr, empty)
    ft = L.feature_table(rows, L.fit_vocab(rows)).withColumn("is_test", L.split_flag())
    model = L.fit_severity(ft.filter(~F.col("is_test")), num_trees=40)
    acc = L.classification_metrics(model.transform(ft.filter("is_test").withColumn("label", L.label_index())))
    assert acc.first()["accuracy"] >= 0.95


def test_fit_and_predict_use_all_cores(spark, monkeypatch):
    from pyspark.ml import Pipeline
    cols = [f"cast(id % {n + 2} as double) AS {c}" for n, c in enumerate(L.FEATURE_COLS)]
    rows = spark.range(400).selectExpr("id", *cols, "1.0D AS weight", "'Low' AS congestion_severity",
                                       "cast(id % 7 as double) AS duration_min").coalesce(1)
    seen, fit = [], Pipeline.fit

    def watch(self, df, params=None):
        seen.append((df.rdd.getNumPartitions(), self.getStages()[-1].getCacheNodeIds(), sorted(r.id for r in df.collect())))
        return fit(self, df)

    assert L.spread(rows).rdd.getNumPartitions() == 1              # few rows stay
    monkeypatch.setattr(L, "FEW_ROWS", 100)
    monkeypatch.setattr(Pipeline, "fit", watch)
    L.fit_severity(rows, num_trees=2, max_depth=2)
    L.fit_duration(rows, num_trees=2, max_depth=2)
    cores = spark.sparkContext.defaultParallelism
    assert seen == [(cores, True, list(range(400)))] * 2
    monkeypatch.setattr(L, "FIT_ROWS", 50)
    assert L.spread(rows).rdd.getNumPartitions() == max(cores, 8)
    assert L.spread(rows.limit(0)).count() == 0


def test_stream_ingest_is_idempotent_and_stats_match(spark):
    base = tempfile.mkdtemp(prefix="stream-test-")
    ledger, ckpt = os.path.join(base, "ledger"), os.path.join(base, "ckpt")
    nation = fx.table(spark, SF001, "nation")

    def closures():
        return fx.feedback_from_incidents(fx.incidents_from_events(ST.events_stream(spark, SF001), nation))

    ST.start_ingest(closures(), ledger, ckpt).awaitTermination()
    n1 = R.read_feedback(spark, ledger).count()
    ST.start_ingest(closures(), ledger, ckpt).awaitTermination()      # restart from the checkpoint
    n2 = R.read_feedback(spark, ledger).count()
    batch = fx.feedback(spark, SF001)
    assert n1 == n2 == batch.count()
    out = os.path.join(base, "stats")
    ST.running_stats(closures(), out, os.path.join(base, "ckpt2")).awaitTermination()
    assert tuple(spark.read.parquet(out).first()) == tuple(FB.feedback_stats(batch).first())


def test_blueprint_model_path(spark):
    from incidentflow.operators import prescribe as P
    from incidentflow.session import work_path
    inc = fx.incidents(spark, SF001)
    out = work_path(spark, "test-models")
    L.retrain(train_table(inc), fx.feedback_from_incidents(inc), out_dir=out, num_trees=5, max_depth=5)
    models = L.load_models(out)
    req = fx.requests_from_incidents(inc)
    bp = P.blueprint_from_history(req, inc, models=models)
    rows = bp.collect()
    assert len(rows) == req.count()
    assert {r.predicted_severity for r in rows} <= {"Low", "Medium", "High", "Critical"}
    assert all(r.predicted_duration_minutes >= 10.0 for r in rows)
    plan = {"Low": 2, "Medium": 4, "High": 8, "Critical": 15}
    assert all(r.recommended_headcount == plan[r.predicted_severity] for r in rows)
