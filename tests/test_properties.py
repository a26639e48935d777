from pyspark.sql import functions as F

from conftest import SF001
from incidentflow.operators import dims as D
from incidentflow.operators import feedback as FB
from incidentflow.operators import geo as GEO
from incidentflow.operators import learn as L
from incidentflow.operators.features import train_table
from incidentflow.sources import fixtures as fx


def test_last_curve_point_equals_stats(spark):
    fb = fx.feedback(spark, SF001)
    last = FB.learning_curve(fb).orderBy(F.desc("event_count")).first()
    s = FB.feedback_stats(fb).first()
    assert last.event_count == s.total_feedback_events
    assert (last.accuracy, last.mae) == (s.severity_prediction_accuracy, s.duration_mae_minutes)


def test_join_dim_paths_agree(spark, monkeypatch):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    dim = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    a = D.join_dim(big, dim, "k")
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    monkeypatch.setattr(D, "broadcast_limit", lambda df: 0)      # nothing fits: shuffle path
    b = D.join_dim(big, dim.groupBy("k").agg(F.max("v").alias("v")), "k")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_meta_summary_document(spark):
    tr = train_table(fx.incidents(spark, SF001))
    r = GEO.meta_summary(tr).first()
    opts = {}
    for row in GEO.option_lists(tr).collect():
        opts.setdefault(row.list, []).append((row.position, row.value))
    for name in ("police_stations", "corridors", "event_causes", "event_types", "junctions"):
        assert r[name] == [v for _, v in sorted(opts[name])]
    cents = {x.name: (x.lat, x.lng) for x in GEO.station_centroids(tr).collect()}
    assert {k: (v.lat, v.lng) for k, v in r.station_coords.items()} == cents
    assert len(r.junction_coords) == GEO.junction_centroids(tr).count()


def test_duration_forest_beats_mean(spark):
    inc = fx.incidents(spark, "/root/testdata/sf0.01")
    tr = train_table(inc)
    fb = fx.feedback_from_incidents(inc)
    vocab = L.fit_vocab(L.classifier_rows(tr, fb))
    ft = L.feature_table(L.regressor_rows(tr, fb), vocab).withColumn("is_test", L.split_flag())
    train, test = ft.filter(~F.col("is_test")), ft.filter("is_test")
    model = L.fit_duration(train, num_trees=30, max_depth=8)
    mae = L.regression_metrics(model.transform(test)).first()["mae"]
    mean = train.agg(F.sum(F.col("duration_min") * F.col("weight")) / F.sum("weight")).first()[0]
    base = test.agg(F.avg(F.abs(F.col("duration_min") - F.lit(mean)))).first()[0]
    assert mae <= base


def test_analytics_document_parts(spark):
    from incidentflow.operators import analytics as A
    from incidentflow.operators import clean as C
    serve = C.serve_table(fx.incidents(spark, SF001))
    d = A.analytics_document(serve).first()
    assert d.total_incidents == serve.count()
    assert len(d.map_points) == min(120, serve.count())
    assert sorted(d.hour_distribution) == [str(h) for h in sorted(range(24), key=str)]
    assert sum(d.hour_distribution.values()) == serve.filter("start_datetime IS NOT NULL").count()
    top = {r.event_cause: r.n for r in A.value_counts(serve, "event_cause", k=10).collect()}
    assert dict(d.cause_counts) == top and len(d.station_counts) <= 8


def test_sizing_helpers(spark, monkeypatch):
    small = spark.range(2)                                           # exact statistics
    assert D.sized(small) is small                                   # estimate under the limit
    local = spark.createDataFrame([(1, "a")], "k int, v string")     # no statistics: written first
    assert D.sized(local) is not local and D.size_in_bytes(D.sized(local)) < 1024 * 1024
    big_estimate = spark.range(10_000_000).groupBy((F.col("id") % 3).alias("k")).count()
    monkeypatch.setattr(D, "broadcast_limit", lambda df: 1024 * 1024)
    written = D.sized(big_estimate, "test_sized")
    assert written is not big_estimate and D.size_in_bytes(written) < 1024 * 1024
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, big_estimate.collect()))
