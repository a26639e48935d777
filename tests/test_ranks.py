"""Positions, stratified selection and prefix sums over whole tables."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from incidentflow.operators import feedback as FB
from incidentflow.operators import learn as L
from incidentflow.operators import ranks as R


def test_positions_equal_the_sorted_places(spark):
    r = random.Random(1)
    rows = {("a", f"v{r.randrange(10 ** 6)}") for _ in range(5000)} | {("b", f"v{i}") for i in range(3)} | {("c", "é"), ("c", "")}
    df = spark.createDataFrame(sorted(rows), "list string, value string").repartition(6)
    got = {(x.list, x.value): x.position for x in R.positions(df, "list", "value").collect()}
    want = {}
    for name in "abc":
        for i, v in enumerate(sorted((v for k, v in rows if k == name), key=lambda v: v.encode())):
            want[(name, v)] = i
    assert got == want
    assert R.positions(df.limit(0), "list", "value").count() == 0


def hash48(key):
    return int(hashlib.md5(f"42-{key}".encode()).hexdigest()[:12], 16)


def test_stratified_split_of_classes_of_all_sizes(spark):
    """2, 3 and 100,000 rows: each is held out at a fifth within one row, on both sides."""
    sizes = {"two": 2, "three": 3, "seven": 7, "many": 100_000, None: 12}
    rows = [(k, f"{k}-{i}") for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "congestion_severity string, row_key string").repartition(7)
    got = L.stratified_split(df)
    held = Counter(x.congestion_severity for x in got.filter("is_test").collect())
    for k, n in sizes.items():
        assert 1 <= held[k] <= n - 1 and abs(held[k] - n / 5) <= 1, (k, held[k])
        limit = sorted(hash48(f"{k}-{i}") for i in range(n))[held[k] - 1]
        if n < 100:
            assert {x.row_key for x in got.filter("is_test").filter(F.col("congestion_severity").eqNullSafe(k)).collect()} == {
                f"{k}-{i}" for i in range(n) if hash48(f"{k}-{i}") <= limit}
    again = L.stratified_split(df.repartition(3))
    assert got.exceptAll(again).count() == 0 and got.columns == ["congestion_severity", "row_key", "is_test"]


def test_split_without_support_is_the_plain_one(spark):
    df = spark.createDataFrame([("one", "a")] + [("many", f"k{i}") for i in range(500)],
                               "congestion_severity string, row_key string")
    got = L.stratified_split(df)
    assert got.exceptAll(df.withColumn("is_test", L.split_flag())).count() == 0
    assert L.stratified_split(df.limit(0)).count() == 0


def test_equal_keys_stay_on_one_side(spark):
    rows = [("x", f"k{i % 40}") for i in range(400)]
    got = L.stratified_split(spark.createDataFrame(rows, "congestion_severity string, row_key string"))
    assert got.groupBy("row_key").agg(F.countDistinct("is_test").alias("n")).filter("n > 1").count() == 0


def test_learning_curve_orders_ties_and_nulls(spark):
    """The same digits on any partitioning; equal seq by event id; prefixes without an error have none."""
    r = random.Random(4)
    rows = [(r.randrange(60), f"e{r.randrange(50)}", r.choice(["High", "Low", None]), "High",
             r.choice([None, 10.1, 20.25, 3.3]), r.choice([5.0, 8.2])) for _ in range(900)]
    cols = ("seq long, event_id string, predicted_severity string, actual_severity string, predicted_duration double, "
            "actual_duration double")
    fb = spark.createDataFrame(rows, cols)
    got = [sorted(tuple(x) for x in FB.learning_curve(fb.repartition(n), start=1, chunks=c).collect())
           for n, c in ((3, 2), (8, 11), (1, None))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 900
    keyed = sorted(rows, key=lambda x: (x[0], x[1], x[2] == "High", -1 if x[4] is None else round(abs(x[4] - x[5]) * 1e6)))
    total = known = 0
    for i, x in enumerate(keyed):
        if x[4] is not None:
            total, known = total + round(abs(x[4] - x[5]) * 1e6), known + 1
        want = total / 1e6 / (i + 1) if known else None
        assert (got[0][i][2] is None) == (want is None) and (want is None or abs(got[0][i][2] - want) <= 0.05 + 1e-9)
