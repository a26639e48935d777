import math

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from conftest import SF001
from incidentflow.operators import forest as T
from incidentflow.operators import learn as L
from incidentflow.plans import q_learn as Q

LEVELS = "array('Low', 'Medium', 'High', 'Critical')"


def coded(spark, n):
    """Training rows: the label follows from two codes, the duration from three; some rows come twice."""
    cols = [f"cast((id * {7 * i + 3} + id div {i + 5}) % {i + 2} as double) AS {c}" for i, c in enumerate(L.FEATURE_COLS)]
    a, b, c = L.FEATURE_COLS[4], L.FEATURE_COLS[6], L.FEATURE_COLS[2]
    rows = spark.range(n).select(F.expr("id - id % 3").alias("id")).selectExpr("id", *cols).selectExpr(
        "*", f"{LEVELS}[cast({a} % 2 + 2 * ({b} % 2) as int)] AS congestion_severity",
        f"10 * {a} + {b} + 100 * ({c} % 2) AS duration_min", "CASE WHEN id % 2 = 0 THEN 1.0D ELSE 10.0D END AS weight")
    return rows.repartition(5)


@pytest.fixture
def own(monkeypatch):
    monkeypatch.setattr(L, "FEW_ROWS", 100)


def trees(model):
    return [t.toDebugString.split("\n")[1:] for t in model.stages[-1].trees]


def test_large_tables_are_not_fitted_by_passes_over_all_rows(spark, own, monkeypatch):
    seen = []
    for cls in (RandomForestClassifier, RandomForestRegressor):
        fit = cls._fit
        monkeypatch.setattr(cls, "_fit", lambda self, df, fit=fit: (seen.append(df.count()), fit(self, df))[1])
    rows = coded(spark, 3000)
    sev, dur = L.fit_severity(rows, num_trees=10), L.fit_duration(rows, num_trees=10)
    assert seen == [4, 1]                               # only the forms of the models
    labelled = rows.withColumn("label", L.label_index())
    assert L.classification_metrics(sev.transform(labelled)).first()["accuracy"] >= 0.99
    assert L.regression_metrics(dur.transform(rows)).first()["r2"] >= 0.99
    assert sev.stages[-1].numClasses == 4 and sev.stages[-1].getNumTrees == 10


def test_both_ways_of_growing_give_the_same_trees(spark, own, monkeypatch):
    rows = coded(spark, 3000)
    monkeypatch.setattr(T, "CHUNK_ROWS", 400)
    monkeypatch.setattr(T, "PIECE", 2000)
    whole = [trees(f(rows, num_trees=3, max_depth=6)) for f in (L.fit_severity, L.fit_duration)]
    monkeypatch.setattr(T, "TASK_ROWS", 0)
    level = [trees(f(rows, num_trees=3, max_depth=6)) for f in (L.fit_severity, L.fit_duration)]
    assert whole == level and all(len(t) > 3 for t in whole[0] + whole[1])


def test_a_rare_first_code_has_its_own_cut(spark, own):
    """A code 0 of little weight: no sample of rows decides where a feature may be cut."""
    f0 = L.FEATURE_COLS[0]
    rest = [f"0.0D AS {c}" for c in L.FEATURE_COLS[1:]]
    rows = spark.range(30_000).selectExpr("id", f"CASE WHEN id % 1000 = 0 THEN 0.0D ELSE 1.0D + id % 2 END AS {f0}", *rest,
                                          "CASE WHEN id % 1000 = 0 THEN 2000.0D ELSE 50.0D END AS duration_min",
                                          "CASE WHEN id % 1000 = 0 THEN 1.0D ELSE 10.0D END AS weight")
    found = {r[0]: r[1] for r in L.fit_duration(rows, num_trees=5, max_depth=3).transform(rows).select(f0, "prediction")
             .distinct().collect()}
    assert found == {0.0: 2000.0, 1.0: 50.0, 2.0: 50.0}


def test_pure_tables_and_unusable_codes(spark, own):
    rows = coded(spark, 600).withColumn("duration_min", F.lit(7.0))
    model = L.fit_duration(rows, num_trees=3)
    assert model.stages[-1].totalNumNodes == 3 and model.transform(rows).agg(F.max("prediction")).first()[0] == 7.0
    odd = coded(spark, 600).withColumn(L.FEATURE_COLS[6], F.col(L.FEATURE_COLS[6]) + 0.25)     # left to Spark ML's trainer
    assert L.fit_duration(odd, num_trees=2, max_depth=3).stages[-1].getNumTrees == 2


def test_bags_are_poisson():
    k = T._once()
    for n in range(6):
        assert abs((k == n).mean() - math.exp(-1) / math.factorial(n)) < 1e-5


def test_metrics_cover_held_out_and_all_rows(spark, monkeypatch):
    fits, calls = {n: getattr(L, n) for n in ("fit_severity", "fit_duration")}, []
    for name, fit in fits.items():
        def small(train, name=name, fit=fit):
            model = fit(train, num_trees=2, max_depth=3)
            calls.append((name, train.count(), model))
            return model
        monkeypatch.setattr(L, name, small)
    m = Q.model_metrics(spark, SF001).first()
    c, r = Q._clf_frames(spark, SF001), Q._reg_frames(spark, SF001)
    assert (m.clf_rows, m.reg_rows) == (c.count(), r.count())
    assert [x[:2] for x in calls] == [("fit_severity", m.clf_rows - m.clf_test_rows), ("fit_severity", m.clf_rows),
                                      ("fit_duration", m.reg_rows - m.reg_test_rows), ("fit_duration", m.reg_rows)]
    a = L.classification_metrics(calls[1][2].transform(c.withColumn("label", L.label_index()))).first()
    d = L.regression_metrics(calls[3][2].transform(r)).first()
    assert m.severity_all_accuracy == pytest.approx(a["accuracy"])
    assert (m.duration_all_r2, m.duration_all_mae) == pytest.approx((d["r2"], d["mae"]))
