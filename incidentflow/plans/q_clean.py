"""Registered queries: scans, cleaning, features (survey A1, A2, B1-B15, B22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import features as FE
from ..sources import fixtures as fx
from . import sqlbase as S
from .registry import register, ts_text, r6

INC_COLS = ("incident_id, event_type, event_cause, priority, requires_road_closure, corridor, "
            "police_station, junction, latitude, longitude")


@register("scan_incidents", S.BASE_INC + f"""
SELECT {INC_COLS}, {S.ts_text('start_datetime')} AS start_datetime,
       {S.ts_text('closed_datetime')} AS closed_datetime FROM inc""")
def scan_incidents(spark, sf):
    return fx.incidents(spark, sf).withColumns({
        "start_datetime": ts_text("start_datetime"), "closed_datetime": ts_text("closed_datetime")})


FB_COLS = ("seq, event_id, event_cause, predicted_severity, predicted_duration, actual_severity, "
           "actual_duration, recommended_officers, actual_officers, recommended_barricades, "
           "actual_barricades, diversion_effective, rating, event_type, requires_road_closure, "
           "priority, corridor, police_station, hour, day_of_week")


@register("scan_feedback", S.BASE_FB + f"""
SELECT {FB_COLS}, {S.ts_text('"timestamp"')} AS "timestamp" FROM fb""")
def scan_feedback(spark, sf):
    return fx.feedback(spark, sf).withColumn("timestamp", ts_text("timestamp"))


@register("fill_defaults", S.BASE_FILLED + """
SELECT incident_id, event_cause, priority, requires_road_closure, corridor, police_station FROM filled""")
def fill_defaults(spark, sf):
    return C.fill_defaults(fx.incidents(spark, sf)).select(
        "incident_id", "event_cause", "priority", "requires_road_closure", "corridor", "police_station")


@register("coerce_bool", S.BASE_INC + """
SELECT incident_id,
       coalesce(TRY_CAST(CASE WHEN requires_road_closure IS NULL THEN 'maybe'
                              WHEN requires_road_closure THEN 'true' ELSE 'false' END AS BOOLEAN), false)
         AS requires_road_closure
FROM inc""")
def coerce_bool(spark, sf):
    # The flag arrives as text (as from a CSV); missing values arrive as junk text.
    raw = fx.incidents(spark, sf).select(
        "incident_id",
        F.when(F.col("requires_road_closure").isNull(), F.lit("maybe"))
         .when(F.col("requires_road_closure"), F.lit("true")).otherwise(F.lit("false"))
         .alias("requires_road_closure"))
    return C.coerce_bool(raw)


@register("coerce_coords", S.BASE_INC + """
SELECT incident_id,
       TRY_CAST(coalesce(CAST(latitude AS VARCHAR), 'n/a') AS DOUBLE) AS latitude,
       TRY_CAST(coalesce(CAST(longitude AS VARCHAR), 'n/a') AS DOUBLE) AS longitude
FROM inc""")
def coerce_coords(spark, sf):
    # Coordinates as text, as a CSV delivers them; missing ones arrive as 'n/a'.
    raw = fx.incidents(spark, sf).select(
        "incident_id",
        F.coalesce(F.col("latitude").cast("string"), F.lit("n/a")).alias("latitude"),
        F.coalesce(F.col("longitude").cast("string"), F.lit("n/a")).alias("longitude"))
    return C.coerce_coords(raw)


@register("drop_missing", S.BASE_FILLED + """
SELECT incident_id, latitude, longitude FROM filled
WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
def drop_missing(spark, sf):
    df = C.coerce_coords(C.fill_defaults(fx.incidents(spark, sf)))
    return C.drop_missing(df, ["latitude", "longitude"]).select("incident_id", "latitude", "longitude")


@register("bbox_tight", S.BASE_SERVE + """
SELECT incident_id, event_cause, priority, requires_road_closure, corridor, police_station,
       junction, latitude, longitude FROM serve""")
def bbox_tight(spark, sf):
    return C.serve_table(fx.incidents(spark, sf)).select(
        "incident_id", "event_cause", "priority", "requires_road_closure", "corridor",
        "police_station", "junction", "latitude", "longitude")


@register("bbox_wide", S.BASE_FILLED + """
SELECT incident_id, police_station, latitude, longitude FROM filled
WHERE start_datetime IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL
  AND latitude > 12.0 AND latitude < 14.0 AND longitude > 77.0 AND longitude < 78.5""")
def bbox_wide(spark, sf):
    df = C.drop_missing(C.fill_defaults(fx.incidents(spark, sf)), ["start_datetime", "latitude", "longitude"])
    return C.in_bbox(df, C.K.WIDE_BOX).select("incident_id", "police_station", "latitude", "longitude")


@register("parse_times", S.BASE_INC + f"""
SELECT incident_id,
  {S.ts_text("TRY_CAST(coalesce(strftime(start_datetime, '%Y-%m-%dT%H:%M:%S.%fZ'), 'not a time') AS TIMESTAMP)")}
    AS start_datetime,
  {S.ts_text("TRY_CAST(coalesce(strftime(closed_datetime, '%Y-%m-%d %H:%M:%S'), '') AS TIMESTAMP)")}
    AS closed_datetime
FROM inc""")
def parse_times(spark, sf):
    # Times as text: ISO with a Z for starts, plain seconds for closures; junk for missing.
    raw = fx.incidents(spark, sf).select(
        "incident_id",
        F.coalesce(F.date_format("start_datetime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
                   F.lit("not a time")).alias("start_datetime"),
        F.coalesce(F.date_format("closed_datetime", "yyyy-MM-dd HH:mm:ss"), F.lit(""))
         .alias("closed_datetime"))
    out = C.parse_times(raw)
    return out.withColumns({"start_datetime": ts_text("start_datetime"),
                            "closed_datetime": ts_text("closed_datetime")})


OFFSET_SQL = """
SELECT incident_id, strftime(start_datetime + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS start_local,
  strftime(closed_datetime + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS closed_local,
  CAST(hour(start_datetime + INTERVAL 330 MINUTE) AS INTEGER) AS hour,
  date_diff('second', date_trunc('second', start_datetime), date_trunc('second', closed_datetime)) AS seconds
FROM inc"""


@register("parse_times_offset", S.BASE_INC + OFFSET_SQL)
def parse_times_offset(spark, sf):
    """Times with mixed zone offsets, read as wall-clock time of one zone."""
    def text(c, shift, zone):
        return F.date_format(F.col(c) + F.expr(f"INTERVAL '{shift}' MINUTE"), f"yyyy-MM-dd'T'HH:mm:ss'{zone}'")

    even = F.col("incident_id") % 2 == 0
    raw = fx.incidents(spark, sf).select(
        "incident_id", F.when(even, text("start_datetime", 330, "+05:30")).otherwise(
            text("start_datetime", 0, "Z")).alias("start_datetime"),
        F.when(even, text("closed_datetime", 0, "Z")).otherwise(
            text("closed_datetime", -180, "-03:00")).alias("closed_datetime"))
    out = C.parse_times(raw, tz="Asia/Kolkata")
    day = "yyyy-MM-dd HH:mm:ss"
    return out.select("incident_id", F.date_format("start_datetime", day).alias("start_local"),
                      F.date_format("closed_datetime", day).alias("closed_local"), F.hour("start_datetime").alias("hour"),
                      F.expr("timestampdiff(SECOND, start_datetime, closed_datetime)").alias("seconds"))


@register("hotspot_columns", S.BASE_SERVE + """
SELECT latitude, longitude, event_cause, priority, requires_road_closure FROM serve""")
def hotspot_columns(spark, sf):
    return C.hotspot_columns(C.serve_table(fx.incidents(spark, sf)))


DUR_SQL = "date_diff('microsecond', start_datetime, closed_datetime) / 60000000.0::DOUBLE"


@register("duration_min", S.BASE_TRAIN + f"""
SELECT incident_id, round({DUR_SQL}, 6) AS duration_min FROM train WHERE closed_datetime IS NOT NULL""")
def duration_min(spark, sf):
    df = FE.train_table(fx.incidents(spark, sf))
    df = C.with_duration(C.drop_missing(df, ["closed_datetime"]))
    return df.select("incident_id", r6("duration_min").alias("duration_min"))


@register("duration_cap", S.BASE_TRAIN + f"""
SELECT incident_id, round({DUR_SQL}, 6) AS duration_min FROM train
WHERE closed_datetime IS NOT NULL AND {DUR_SQL} > 0 AND {DUR_SQL} < 2880""")
def duration_cap(spark, sf):
    df = FE.train_table(fx.incidents(spark, sf))
    df = C.cap_duration(C.with_duration(C.drop_missing(df, ["closed_datetime"])))
    return df.select("incident_id", r6("duration_min").alias("duration_min"))


@register("time_features", S.BASE_TRAIN + """
SELECT incident_id, hour, day_of_week, month, is_peak_hour FROM train""")
def time_features(spark, sf):
    return FE.train_table(fx.incidents(spark, sf)).select(
        "incident_id", "hour", "day_of_week", "month", "is_peak_hour")


@register("cause_weight", S.BASE_FILLED + f"""
SELECT incident_id, event_cause, {S.CAUSE_WEIGHT_CASE} AS cause_weight FROM filled""")
def cause_weight(spark, sf):
    return FE.with_cause_weight(C.fill_defaults(fx.incidents(spark, sf))).select(
        "incident_id", "event_cause", "cause_weight")


@register("congestion_score", S.BASE_TRAIN + """
SELECT incident_id, round(congestion_score, 6) AS congestion_score FROM train""")
def congestion_score(spark, sf):
    return FE.train_table(fx.incidents(spark, sf)).select(
        "incident_id", r6("congestion_score").alias("congestion_score"))


@register("severity_bucket", S.BASE_TRAIN + """
SELECT incident_id, round(congestion_score, 6) AS congestion_score, congestion_severity FROM train""")
def severity_bucket(spark, sf):
    return FE.train_table(fx.incidents(spark, sf)).select(
        "incident_id", r6("congestion_score").alias("congestion_score"), "congestion_severity")
