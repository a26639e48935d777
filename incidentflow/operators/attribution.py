"""Explanation of a forecast: per-factor contributions and the display score (survey I13, I14, H18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as TX
from ..functions.numeric import js_fixed
from .features import cause_weight

FACTORS = ("cause", "peak", "closure", "priority", "corridor")


def _flags(hour: Column, closure: Column, priority: Column, corridor: Column):
    return (F.coalesce(hour.isin(*K.PEAK_HOURS), F.lit(False)), F.coalesce(closure, F.lit(False)),
            priority == "High", corridor != K.DEFAULT_CORRIDOR)


def _contributions(df: DataFrame, duration: str) -> DataFrame:
    """Adds attr_* and the unrounded percent (_pct_raw_*) and minutes (_min_raw_*)."""
    base = cause_weight(F.col("event_cause"), K.DISPLAY_CAUSE_WEIGHTS, K.DEFAULT_DISPLAY_WEIGHT).cast("double")
    peak, closure, high, corr = _flags(F.col("hour"), F.col("requires_road_closure"),
                                       F.col("priority"), F.col("corridor"))
    df = df.withColumn("_base", base)
    b = F.col("_base")
    zero = F.lit(0.0)
    attr = {
        "cause": b,
        "peak": F.when(peak, b * F.lit(K.ATTR_PEAK)).otherwise(zero),
        "closure": F.when(closure, b * F.lit(K.ATTR_CLOSURE)).otherwise(zero),
        "priority": F.when(high, b * F.lit(K.ATTR_PRIORITY)).otherwise(zero),
        "corridor": F.when(corr, b * F.lit(K.ATTR_CORRIDOR)).otherwise(b * F.lit(K.ATTR_NON_CORRIDOR)),
    }
    df = df.withColumns({f"attr_{f}": attr[f] for f in FACTORS})
    total = sum((F.col(f"attr_{f}") for f in FACTORS[1:]), F.col("attr_cause"))
    df = df.withColumn("_total", total)
    df = df.withColumns({f"_pct_raw_{f}": F.col(f"attr_{f}") / F.col("_total") * F.lit(100.0) for f in FACTORS}
                        | {f"_min_raw_{f}": F.col(f"attr_{f}") / F.col("_total") * F.col(duration)
                           for f in FACTORS})
    return df.drop("_base", "_total")


def with_attribution(df: DataFrame, duration: str) -> DataFrame:
    """Adds absolute contribution, whole percent and minutes per factor (display weights).

    Staged projections keep each rounding input a plain column reference, so the
    exact-rounding arithmetic does not copy the contribution expressions.
    """
    df = _contributions(df, duration)
    df = df.withColumns({f"pct_{f}": js_fixed(f"_pct_raw_{f}", 0).cast("int") for f in FACTORS}
                        | {f"min_{f}": js_fixed(f"_min_raw_{f}", 1) for f in FACTORS})
    return df.drop(*[f"_{p}_{f}" for p in ("pct_raw", "min_raw") for f in FACTORS])


def attribution_long(df: DataFrame, key: str, duration: str) -> DataFrame:
    """(key, factor, contribution, percent, minutes), five rows per input row.

    ``stack`` turns the five factors into rows first (a narrow Generate, no
    shuffle), so each rounding is generated once instead of once per factor.
    """
    wide = _contributions(df, duration)
    args = ", ".join(f"'{f}', attr_{f}, _pct_raw_{f}, _min_raw_{f}" for f in FACTORS)
    long = wide.selectExpr(key, f"stack({len(FACTORS)}, {args}) AS (factor, contribution, _pct, _min)")
    return long.select(key, "factor", "contribution", js_fixed("_pct", 0).cast("int").alias("percent"),
                       js_fixed("_min", 1).alias("minutes"))


def with_display_score(df: DataFrame) -> DataFrame:
    """Adds c_val, the four multipliers, display_score and display_severity.

    The display weight table and the display multiplier order differ from the
    training score on purpose (survey Q8). Staged so the score is computed once.
    """
    base = cause_weight(F.col("event_cause"), K.DISPLAY_CAUSE_WEIGHTS, K.DEFAULT_DISPLAY_WEIGHT)
    peak, closure, high, corr = _flags(F.col("hour"), F.col("requires_road_closure"),
                                       F.col("priority"), F.col("corridor"))
    df = df.withColumn("_c_raw", base / F.lit(10.0))
    df = df.withColumns({
        "c_val": js_fixed("_c_raw", 1),
        "p_mult": F.when(high, F.lit(K.PRIORITY_MULT)).otherwise(F.lit(1.0)),
        "cl_mult": F.when(closure, F.lit(K.CLOSURE_MULT)).otherwise(F.lit(1.0)),
        "peak_mult": F.when(peak, F.lit(K.PEAK_MULT)).otherwise(F.lit(1.0)),
        "corr_mult": F.when(corr, F.lit(K.CORRIDOR_MULT)).otherwise(F.lit(1.0)),
    }).drop("_c_raw")
    df = df.withColumn("display_score", F.col("c_val") * F.col("p_mult") * F.col("cl_mult")
                       * F.col("peak_mult") * F.col("corr_mult"))
    s = F.col("display_score")
    return df.withColumn("display_severity", F.when(s >= 7.0, F.lit("Critical")).when(s >= 5.0, F.lit("High"))
                         .when(s >= 3.0, F.lit("Medium")).otherwise(F.lit("Low")))


def formula_text(cause: Column, priority: Column) -> Column:
    """``Congestion Score = 4.0 (Cause: Accident) x 1.3 (Priority: High) x ... = 6.24 (High)``.

    Reads the columns added by ``with_display_score``.
    """
    def one(c):
        return F.format_string("%.1f", F.col(c))
    return F.concat(
        F.lit("Congestion Score = "), one("c_val"), F.lit(" (Cause: "), TX.title_case(cause),
        F.lit(") × "), one("p_mult"), F.lit(" (Priority: "), priority,
        F.lit(") × "), one("cl_mult"), F.lit(" (Closure) × "),
        one("corr_mult"), F.lit(" (Corridor) × "), one("peak_mult"),
        F.lit(" (Peak Hour) = "), TX.fixed(F.col("display_score"), 2), F.lit(" ("),
        F.col("display_severity"), F.lit(")"))


def with_factor_labels(df: DataFrame, duration: str) -> DataFrame:
    """Adds the five explanation lines with minutes to 1 dp."""
    df = with_attribution(df, duration)
    peak, closure, _, _ = _flags(F.col("hour"), F.col("requires_road_closure"),
                                 F.col("priority"), F.col("corridor"))
    hour_txt = F.col("hour").cast("string")

    def mins(f):
        return F.format_string("%.1f", F.col(f"min_{f}"))
    return df.withColumns({
        "label_cause": F.concat(F.lit("Incident Cause Base weight ("), TX.title_case(F.col("event_cause")),
                                F.lit("): +"), mins("cause"), F.lit(" min")),
        "label_peak": F.concat(F.lit("Temporal Commute surcharge ("), hour_txt, F.lit(":00 "),
                               F.when(peak, F.lit("Peak Hour")).otherwise(F.lit("Off-Peak")),
                               F.lit("): +"), mins("peak"), F.lit(" min")),
        "label_closure": F.concat(F.lit("Segment Closure impact ("),
                                  F.when(closure, F.lit("Full Block active")).otherwise(F.lit("No blockage")),
                                  F.lit("): +"), mins("closure"), F.lit(" min")),
        "label_priority": F.concat(F.lit("Priority level multiplier ("), F.col("priority"),
                                   F.lit(" Priority): +"), mins("priority"), F.lit(" min")),
        "label_corridor": F.concat(F.lit("Snapping Corridor multiplier ("), F.col("corridor"),
                                   F.lit("): +"), mins("corridor"), F.lit(" min")),
    })
