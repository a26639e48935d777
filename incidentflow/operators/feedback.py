"""Feedback ledger: standardisation, search, statistics, learning curve (survey B14-B19,
B23, D13-D17, E1, F3, G1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import js_fixed, py_round
from .dims import materialise
from .features import is_peak, with_weight
from .ranks import offsets


def standardise_feedback(fb: DataFrame) -> DataFrame:
    """Actuals become the training labels; peak flag from the hour."""
    cols = set(fb.columns)
    out = {}
    if "actual_severity" in cols:
        out["congestion_severity"] = F.col("actual_severity")
    if "actual_duration" in cols:
        out["duration_min"] = F.col("actual_duration").cast("double")
    if "hour" in cols:
        out["is_peak_hour"] = is_peak(F.col("hour"))
    return fb.withColumns(out) if out else fb


def feedback_defaults(fb: DataFrame) -> DataFrame:
    """Missing feature columns are added as typed NULLs, then the eight defaults fill."""
    types = {"event_type": "string", "event_cause": "string", "requires_road_closure": "boolean",
             "priority": "string", "corridor": "string", "police_station": "string",
             "hour": "int", "day_of_week": "int"}
    missing = {c: F.lit(None).cast(t) for c, t in types.items() if c not in fb.columns}
    if missing:
        fb = fb.withColumns(missing)
    fills = {c: F.coalesce(F.col(c).cast(types[c]), F.lit(v).cast(types[c]))
             for c, v in K.FEEDBACK_DEFAULTS.items()}
    return fb.withColumns(fills)


def feedback_training_rows(fb: DataFrame) -> DataFrame:
    """Ledger rows as training rows: B14, then B15, flagged and weighted."""
    return with_weight(feedback_defaults(standardise_feedback(fb)), True)


def training_union(history: DataFrame, fb: DataFrame, label: str = "congestion_severity") -> DataFrame:
    """History and ledger rows by column name, missing columns as NULL, duplicates kept (G1)."""
    h = with_weight(history, False)
    f = feedback_training_rows(fb).filter(F.col(label).isNotNull())
    return h.unionByName(f, allowMissingColumns=True)


def search_feedback(fb: DataFrame, text: str = "", severity: str = "", rating: str = "") -> DataFrame:
    """Search box and two drop-down filters; blank means no filter.

    * text: case-insensitive contains on ``event_id`` or on the cause with ``_`` as space;
    * severity: predicted or actual equals the value;
    * rating: equality on the rating's text.
    """
    cond = F.lit(True)
    t = (text or "").lower().strip()
    if t:
        cond = cond & (F.lower(F.col("event_id").cast("string")).contains(t)
                       | F.lower(F.regexp_replace(F.col("event_cause").cast("string"), "_", " ")).contains(t))
    if severity:
        cond = cond & ((F.col("predicted_severity") == severity) | (F.col("actual_severity") == severity))
    if rating:
        cond = cond & (F.col("rating").cast("string") == str(rating))
    return fb.filter(cond)


def with_match(fb: DataFrame) -> DataFrame:
    """``severity_match`` = predicted equals actual."""
    return fb.withColumn("severity_match", F.col("predicted_severity") == F.col("actual_severity"))


def latest_first(fb: DataFrame) -> DataFrame:
    """Ledger in reverse append order."""
    return fb.orderBy(F.desc("seq"))


def prefill_closure(forms: DataFrame) -> DataFrame:
    """Closure form defaults from the forecast: actuals = predictions, rating 3."""
    return forms.select(
        "*",
        F.col("predicted_severity").alias("actual_severity"),
        js_fixed(F.col("predicted_duration_minutes"), 0).cast("long").alias("actual_duration"),
        F.col("recommended_headcount").alias("actual_officers"),
        F.col("barricade_count").alias("actual_barricades"),
        F.lit(3).alias("rating"),
    )


def _stat_columns():
    n = F.count(F.lit(1))
    hits = F.sum(F.when(F.col("predicted_severity") == F.col("actual_severity"), 1).otherwise(0))
    abs_err = F.sum(F.abs(F.col("predicted_duration") - F.col("actual_duration")))
    saved = F.sum(F.greatest(F.lit(0), F.col("recommended_officers") - F.col("actual_officers")))
    return n, hits, abs_err, saved, F.sum("rating")


def feedback_stats(fb: DataFrame) -> DataFrame:
    """One row: count, mean rating (2 dp), accuracy % (1 dp), MAE (1 dp), officers saved.

    A single global aggregate (partial per partition, one final row). An empty
    ledger yields the all-zero row.
    """
    n, hits, abs_err, saved, rating_sum = _stat_columns()
    agg = fb.agg(n.alias("n"), hits.alias("hits"), abs_err.alias("abs_err"),
                 saved.alias("saved"), rating_sum.alias("rating_sum"))
    return stats_from_sums(agg)


def stats_from_sums(agg: DataFrame) -> DataFrame:
    nz = F.col("n") > 0
    return agg.select(
        F.col("n").cast("long").alias("total_feedback_events"),
        F.when(nz, py_round(F.col("rating_sum") / F.col("n"), 2)).otherwise(F.lit(0.0)).alias("average_rating"),
        F.when(nz, py_round(F.col("hits") / F.col("n") * F.lit(100.0), 1)).otherwise(F.lit(0.0))
         .alias("severity_prediction_accuracy"),
        F.when(nz, py_round(F.col("abs_err") / F.col("n"), 1)).otherwise(F.lit(0.0)).alias("duration_mae_minutes"),
        F.coalesce(F.col("saved"), F.lit(0)).cast("long").alias("manpower_savings_count"),
    )


ERROR_SCALE = 1_000_000        # errors are summed as whole millionths of a minute


def learning_curve(fb: DataFrame, start: int = K.LEARNING_CURVE_START, chunks: int | None = None) -> DataFrame:
    """Accuracy % and MAE over the first i ledger rows for every i >= ``start``.

    The ledger is read once, into narrow rows (seq, event id, hit, error as an integer). Those are
    range-partitioned and sorted; each task adds up its own rows in order, and the totals of the partitions
    before (one row for each partition) complete the prefix. Sums are of integers, and equal ``seq`` are ordered by
    event id, hit and error, so every digit is the same on any partitioning. ``chunks`` sets the number of ranges.
    """
    hit = F.when(F.col("predicted_severity") == F.col("actual_severity"), 1).otherwise(0).cast("long")
    err = F.round(F.abs(F.col("predicted_duration") - F.col("actual_duration")) * F.lit(float(ERROR_SCALE))).cast("long")
    base = materialise(fb.select("seq", "event_id", hit.alias("hit"), err.alias("err")), "curve_rows")
    order = ["seq", "event_id", "hit", "err"]
    ranged = base.repartitionByRange(chunks, *order) if chunks else base.repartitionByRange(*order)

    def running(batches):
        from pyspark import TaskContext
        part, n, sums = TaskContext.get().partitionId(), 0, [0, 0, 0]
        for b in batches:
            rows = b.num_rows
            if not rows:
                continue
            err = b.column("err")
            added = (b.column("hit"), err.fill_null(0), err.is_valid().cast(pa.int64()))
            cols = [np.cumsum(np.asarray(c, np.int64)) + s for c, s in zip(added, sums)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, part), pa.int32()), pa.array(np.arange(n + 1, n + rows + 1)), *map(pa.array, cols)],
                names=["part", "n", "hits", "err", "known"])
            n, sums = n + rows, [int(c[-1]) for c in cols]

    local = materialise(ranged.sortWithinPartitions(*order).mapInArrow(
        running, "part int, n long, hits long, err long, known long"), "curve_prefix")
    totals = local.groupBy("part").agg(*[F.max(c).alias(c) for c in ("n", "hits", "err", "known")]).collect()
    before, rows = (0, 0, 0, 0), []
    for r in sorted(totals, key=lambda r: r["part"]):
        rows.append((r["part"], *before))
        before = tuple(a + b for a, b in zip(before, r[1:]))
    side = offsets(fb, rows, "part int, p_n long, p_hits long, p_err long, p_known long")
    n = F.col("n") + F.col("p_n")
    err = F.when(F.col("known") + F.col("p_known") > 0, (F.col("err") + F.col("p_err")) / F.lit(float(ERROR_SCALE)))
    return (local.join(side, "part").filter(n >= start).select(
        n.alias("event_count"),
        py_round((F.col("hits") + F.col("p_hits")) / n * F.lit(100.0), 1).alias("accuracy"),
        py_round(err / n, 1).alias("mae")))


def learning_curve_plain(fb: DataFrame, start: int = K.LEARNING_CURVE_START) -> DataFrame:
    """Plain form of E1 with one global running window (tests compare against it)."""
    w = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.when(F.col("predicted_severity") == F.col("actual_severity"), 1).otherwise(0)
    err = F.abs(F.col("predicted_duration") - F.col("actual_duration"))
    n = F.count(F.lit(1)).over(w)
    return (fb.select(n.cast("long").alias("event_count"),
                      py_round(F.sum(hit).over(w) / n * F.lit(100.0), 1).alias("accuracy"),
                      py_round(F.sum(err).over(w) / n, 1).alias("mae"))
            .filter(F.col("event_count") >= start))
