"""Time features, congestion score and severity (survey B10-B13, B22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .clean import fill_defaults, parse_times, drop_missing


def _literal_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def is_peak(hour: Column) -> Column:
    """1 for the eight commute hours, 0 otherwise (a NULL hour counts as off-peak)."""
    return F.coalesce(hour.isin(*K.PEAK_HOURS), F.lit(False)).cast("int")


def with_time_features(df: DataFrame, ts: str = "start_datetime") -> DataFrame:
    """hour, day_of_week (Monday = 0), month, is_peak_hour."""
    return df.withColumns({
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
    }).withColumn("is_peak_hour", is_peak(F.col("hour")))


def cause_weight(cause: Column, weights: dict = K.CAUSE_WEIGHTS, default=K.DEFAULT_CAUSE_WEIGHT) -> Column:
    """Lower-cased cause to its base weight via a literal map (no join, stays in codegen)."""
    return F.coalesce(F.try_element_at(_literal_map(weights), F.lower(cause)), F.lit(default))


def with_cause_weight(df: DataFrame) -> DataFrame:
    """``cause_weight`` column."""
    return df.withColumn("cause_weight", cause_weight(F.col("event_cause")))


def score_expr(base: Column, priority: Column, closure: Column, corridor: Column, peak: Column) -> Column:
    """base x 1.3 (High) x 1.5 (closure) x 1.2 (corridor) x 1.2 (peak), left to right in doubles."""
    one = F.lit(1.0)
    return (base.cast("double")
            * F.when(priority == "High", F.lit(K.PRIORITY_MULT)).otherwise(one)
            * F.when(closure, F.lit(K.CLOSURE_MULT)).otherwise(one)
            * F.when(corridor != K.DEFAULT_CORRIDOR, F.lit(K.CORRIDOR_MULT)).otherwise(one)
            * F.when(peak == 1, F.lit(K.PEAK_MULT)).otherwise(one))


def with_score(df: DataFrame) -> DataFrame:
    """``congestion_score`` from cleaned columns and ``is_peak_hour``."""
    return df.withColumn("congestion_score", score_expr(
        cause_weight(F.col("event_cause")), F.col("priority"), F.col("requires_road_closure"),
        F.col("corridor"), F.col("is_peak_hour")))


def severity_expr(score: Column) -> Column:
    (b1, l1), (b2, l2), (b3, l3) = K.SEVERITY_BOUNDS
    return (F.when(score < b1, l1).when(score < b2, l2).when(score < b3, l3)
            .otherwise(K.SEVERITY_TOP))


def with_severity(df: DataFrame) -> DataFrame:
    """``congestion_severity`` bucket of the score."""
    return df.withColumn("congestion_severity", severity_expr(F.col("congestion_score")))


def train_table(incidents: DataFrame) -> DataFrame:
    """History as the trainer sees it: B1, B6, rows with a start, B10-B13."""
    df = parse_times(fill_defaults(incidents))
    df = drop_missing(df, ["start_datetime"])
    return with_severity(with_score(with_time_features(df)))


def with_weight(df: DataFrame, is_feedback: bool | Column) -> DataFrame:
    """``is_feedback`` flag and sample ``weight`` 10.0 / 1.0."""
    flag = is_feedback if isinstance(is_feedback, Column) else F.lit(bool(is_feedback))
    df = df.withColumn("is_feedback", flag)
    return df.withColumn("weight", F.when(F.col("is_feedback"), F.lit(K.FEEDBACK_WEIGHT))
                         .otherwise(F.lit(K.HISTORY_WEIGHT)))
