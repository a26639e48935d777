"""Cleaning, coercion and row filters (survey B1-B9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K


def _is_type(df: DataFrame, col: str, types: tuple) -> bool:
    return isinstance(df.schema[col].dataType, types)


def coerce_bool(df: DataFrame, col: str = "requires_road_closure", default: bool = False) -> DataFrame:
    """Closure flag to BOOLEAN; text that is not a boolean and NULL become ``default`` (B2)."""
    c = F.col(col) if _is_type(df, col, (T.BooleanType,)) else F.expr(f"try_cast(`{col}` AS BOOLEAN)")
    return df.withColumn(col, F.coalesce(c, F.lit(default)))


def fill_defaults(df: DataFrame) -> DataFrame:
    """The five null fills of the incident history (B1, with B2 for the flag)."""
    df = df.na.fill({
        "priority": K.DEFAULT_PRIORITY,
        "corridor": K.DEFAULT_CORRIDOR,
        "police_station": K.DEFAULT_STATION,
        "event_cause": K.DEFAULT_CAUSE,
    })
    return coerce_bool(df, "requires_road_closure", K.DEFAULT_CLOSURE)


def coerce_coords(df: DataFrame, cols=("latitude", "longitude")) -> DataFrame:
    """Non-numeric coordinates become NULL instead of failing."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in cols})


def drop_missing(df: DataFrame, subset) -> DataFrame:
    """Drop rows with a NULL in any column of ``subset``."""
    return df.na.drop(how="any", subset=list(subset))


def bbox_predicate(box, lat: str = "latitude", lng: str = "longitude") -> Column:
    lat_min, lat_max, lng_min, lng_max = box
    return ((F.col(lat) > lat_min) & (F.col(lat) < lat_max)
            & (F.col(lng) > lng_min) & (F.col(lng) < lng_max))


def in_bbox(df: DataFrame, box=K.TIGHT_BOX, lat: str = "latitude", lng: str = "longitude") -> DataFrame:
    """Strict bounding-box filter; four range predicates reach the Parquet scan."""
    return df.filter(bbox_predicate(box, lat, lng))


def parse_times(df: DataFrame, cols=("start_datetime", "closed_datetime"), tz: str = "UTC") -> DataFrame:
    """Text timestamps to wall-clock time in ``tz`` (TIMESTAMP_NTZ), unparseable text to NULL.

    Text with a zone designator (``Z``, ``+05:30``) is an instant and is converted;
    text without one is wall-clock time in ``tz`` already.
    """
    out = {}
    for c in cols:
        if c not in df.columns:
            continue
        if _is_type(df, c, (T.TimestampNTZType,)):
            continue
        zoned = F.expr(f"try_cast(`{c}` AS STRING)").rlike(r"(?i)(z|[+-][0-9]{2}:?[0-9]{2})\s*$") & F.col(c).contains(":")
        utc = F.expr(f"timestampadd(MICROSECOND, unix_micros(try_cast(`{c}` AS TIMESTAMP)), "
                     "TIMESTAMP_NTZ'1970-01-01 00:00:00')")
        out[c] = F.when(zoned, F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)).otherwise(
            F.expr(f"try_cast(`{c}` AS TIMESTAMP_NTZ)"))
    return df.withColumns(out) if out else df


def hotspot_columns(df: DataFrame) -> DataFrame:
    """The five columns a map point needs."""
    return df.select("latitude", "longitude", "event_cause", "priority", "requires_road_closure")


def duration_minutes(start: str = "start_datetime", closed: str = "closed_datetime") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, `{start}`, `{closed}`)") / F.lit(60_000_000.0)


def with_duration(df: DataFrame) -> DataFrame:
    """``duration_min`` = (closed - start) in minutes, microsecond exact."""
    return df.withColumn("duration_min", duration_minutes())


def cap_duration(df: DataFrame, lo: float = 0.0, hi: float = K.DURATION_CAP_MIN) -> DataFrame:
    """Keep 0 < duration_min < 2880."""
    return df.filter((F.col("duration_min") > lo) & (F.col("duration_min") < hi))


def serve_table(incidents: DataFrame) -> DataFrame:
    """History as the analytics side sees it: B1, B3, B4 on coordinates, tight box."""
    df = coerce_coords(fill_defaults(incidents))
    df = drop_missing(df, ["latitude", "longitude"])
    return in_bbox(df, K.TIGHT_BOX)
