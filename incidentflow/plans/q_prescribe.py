"""Registered queries: forecast, plan and blueprint per request (survey C4, E2, I7-I12, B24,
D19, H6, H7, H13, H17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import prescribe as P
from ..operators.features import train_table
from ..sources import fixtures as fx
from ..functions import geomath as G
from . import sqlbase as S
from .registry import register, r6


def _blueprint(spark, sf):
    inc = fx.incidents(spark, sf)
    return P.blueprint_from_history(fx.requests_from_incidents(inc), inc)


def _forecast(spark, sf):
    inc = fx.incidents(spark, sf)
    return P.with_forecast(fx.requests_from_incidents(inc), train_table(inc))


BASE_FC = S.with_ctes(S.INC, S.FILLED, S.TRAIN, S.REQ, S.FC)


@register("calibrate_duration", S.BASE_TRAIN + f"""
, d AS (SELECT incident_id, event_cause, {S.DUR} AS duration_min FROM train
        WHERE closed_datetime IS NOT NULL AND {S.DUR} > 0 AND {S.DUR} < 2880)
SELECT incident_id, event_cause, round(duration_min, 6) AS duration_min,
       {S.calibrate_sql('duration_min')} AS calibrated FROM d""")
def calibrate_duration(spark, sf):
    """Calibration (I7) applied to every observed duration of the capped history."""
    d = C.cap_duration(C.with_duration(C.drop_missing(train_table(fx.incidents(spark, sf)),
                                                      ["closed_datetime"])))
    return d.select("incident_id", "event_cause", r6("duration_min").alias("duration_min"),
                    P.calibrate(F.col("duration_min"), F.col("event_cause")).alias("calibrated"))


@register("resource_plan", BASE_FC + f"""
SELECT request_id, predicted_severity, predicted_duration_minutes,
       CAST({S.plan_int('predicted_severity', 1)} AS INTEGER) AS officers,
       CAST({S.plan_int('predicted_severity', 2)} AS INTEGER) AS barricades,
       CASE predicted_severity WHEN 'Low' THEN false ELSE true END AS diversion_required,
       {S.plan_text_sql('predicted_severity', 4)} AS barricade_description,
       {S.plan_text_sql('predicted_severity', 5)} AS diversion_description
FROM fc""")
def resource_plan(spark, sf):
    """Rule severity, calibrated duration and the plan for every request (I8)."""
    return P.attach_plan(_forecast(spark, sf)).select(
        "request_id", "predicted_severity", "predicted_duration_minutes", "officers", "barricades",
        "diversion_required", "barricade_description", "diversion_description")


@register("plan_lookup", S.BASE_FB + f"""
SELECT seq, actual_severity,
       CAST({S.plan_int('actual_severity', 1)} AS INTEGER) AS officers,
       CAST({S.plan_int('actual_severity', 2)} AS INTEGER) AS barricades FROM fb""")
def plan_lookup(spark, sf):
    """The plan the observed (actual) severity would have called for (C4)."""
    fb = fx.feedback(spark, sf)
    cols = P.plan_columns(F.col("actual_severity"))
    return fb.select("seq", "actual_severity", cols["officers"].alias("officers"),
                     cols["barricades"].alias("barricades"))


@register("role_split", BASE_FC + f"""
, p AS (SELECT request_id, {S.plan_int('predicted_severity', 1)} AS officers FROM fc)
SELECT request_id, CAST(officers AS INTEGER) AS officers,
       CAST(greatest(1, officers // 2) AS INTEGER) AS core_junction_control,
       CAST(greatest(1, officers // 3) AS INTEGER) AS upstream_diversion_guides,
       CAST(greatest(0, officers - officers // 2 - officers // 3) AS INTEGER) AS mobile_incident_patrols
FROM p""")
def role_split(spark, sf):
    df = P.attach_plan(_forecast(spark, sf))
    roles = P.role_split(F.col("officers"))
    return df.select("request_id", "officers", *[v.alias(k) for k, v in roles.items()])


@register("scope_text", BASE_FC + """
SELECT request_id, predicted_severity,
       CASE lower(predicted_severity) WHEN 'critical' THEN 'Full Segment Closure'
            WHEN 'high' THEN 'Partial Detour / Diversion' WHEN 'low' THEN 'Ad-hoc Ground Monitoring'
            ELSE 'Lane Merge / Advisory' END AS scope FROM fc""")
def scope_text(spark, sf):
    return _forecast(spark, sf).select("request_id", "predicted_severity",
                                       P.scope_text(F.col("predicted_severity")).alias("scope"))


BP_COLS_SQL = """request_id, event_id, predicted_severity, predicted_duration_minutes,
  officers AS recommended_headcount,
  CAST(greatest(1, officers // 2) AS INTEGER) AS core_junction_control,
  CAST(greatest(1, officers // 3) AS INTEGER) AS upstream_diversion_guides,
  CAST(greatest(0, officers - officers // 2 - officers // 3) AS INTEGER) AS mobile_incident_patrols,
  police_station AS police_station_in_charge, barricades AS barricade_count,
  barricade_description AS setup_description, diversion_required,
  array_to_string(suggested[1:3], ' | ') AS recommended_junctions, diversion_description,
  p1_name, round(p1_lat, 6) AS p1_lat, round(p1_lng, 6) AS p1_lng, p1_role,
  p2_name, round(p2_lat, 6) AS p2_lat, round(p2_lng, 6) AS p2_lng, p2_role, junction_source"""


def _bp_out(bp):
    return bp.select(
        "request_id", "event_id", "predicted_severity", "predicted_duration_minutes",
        "recommended_headcount", "core_junction_control", "upstream_diversion_guides",
        "mobile_incident_patrols", "police_station_in_charge", "barricade_count", "setup_description",
        "diversion_required", F.array_join("recommended_junctions", " | ").alias("recommended_junctions"),
        "diversion_description", "p1_name", r6("p1_lat").alias("p1_lat"), r6("p1_lng").alias("p1_lng"),
        "p1_role", "p2_name", r6("p2_lat").alias("p2_lat"), r6("p2_lng").alias("p2_lng"), "p2_role",
        "junction_source")


@register("blueprint", S.BASE_BP + f"\nSELECT {BP_COLS_SQL} FROM bp")
def blueprint(spark, sf):
    """The whole mitigation plan for every request, rule severity path."""
    return _bp_out(_blueprint(spark, sf))


@register("nested_access", S.BASE_BP + """
SELECT request_id, officers AS headcount,
       CAST(greatest(1, officers // 2) AS INTEGER) AS core,
       barricades AS barricades, suggested[1] AS first_junction,
       len(suggested[1:3]) AS n_junctions,
       CAST((CASE WHEN p1_name IS NULL THEN 0 ELSE 1 END) + (CASE WHEN p2_name IS NULL THEN 0 ELSE 1 END) AS INTEGER)
         AS n_points
FROM bp""")
def nested_access(spark, sf):
    """Build the nested response and read fields back out of it."""
    nested = P.blueprint_struct(_blueprint(spark, sf))
    b = F.col("blueprint")
    return nested.select(
        "request_id",
        b["manpower"]["recommended_headcount"].alias("headcount"),
        b["manpower"]["role_distribution"]["core_junction_control"].alias("core"),
        b["barricading"]["recommended_count"].alias("barricades"),
        F.element_at(b["diversion"]["recommended_junctions"], 1).alias("first_junction"),
        F.size(b["diversion"]["recommended_junctions"]).alias("n_junctions"),
        F.size(b["diversion"]["map_points"]).alias("n_points"))


@register("diversion_points", S.BASE_BP + """
SELECT request_id, p1_name, round(p1_lat, 6) AS p1_lat, round(p1_lng, 6) AS p1_lng, p1_role,
       p2_name, round(p2_lat, 6) AS p2_lat, round(p2_lng, 6) AS p2_lng, p2_role FROM bp""")
def diversion_points(spark, sf):
    return _bp_out(_blueprint(spark, sf)).select(
        "request_id", "p1_name", "p1_lat", "p1_lng", "p1_role", "p2_name", "p2_lat", "p2_lng", "p2_role")


@register("role_text", S.BASE_BP + "\nSELECT request_id, p1_role, p2_role FROM bp")
def role_text(spark, sf):
    return _blueprint(spark, sf).select("request_id", "p1_role", "p2_role")


@register("diversion_rank", S.BASE_BP + """
SELECT request_id, 1 AS diversion_rank, p1_name AS junction FROM bp WHERE p1_name IS NOT NULL
UNION ALL
SELECT request_id, 2, p2_name FROM bp WHERE p2_name IS NOT NULL""")
def diversion_rank(spark, sf):
    """Ordinal of each of the first two suggested junctions."""
    bp = _blueprint(spark, sf)
    return (bp.select("request_id", F.posexplode(F.slice("recommended_junctions", 1, 2)).alias("pos", "junction"))
            .select("request_id", (F.col("pos") + 1).cast("int").alias("diversion_rank"), "junction"))


@register("event_key", S.BASE_REQ + """
SELECT request_id,
       'EVT-' || CAST(CAST('0x' || substr(md5(CAST(request_id AS VARCHAR)), 1, 8) AS BIGINT) % 90000 + 10000 AS VARCHAR)
         AS event_id FROM req""")
def event_key(spark, sf):
    from ..functions.text import event_key as ek
    return fx.requests(spark, sf).select("request_id", ek(F.col("request_id")).alias("event_id"))


@register("polar_offset", S.BASE_REQ + f"""
SELECT request_id,
  round(latitude + 0.005::DOUBLE * sin({S._angle(0)}), 6) AS o1_lat,
  round(longitude + 0.005::DOUBLE * cos({S._angle(0)}), 6) AS o1_lng,
  round(latitude + 0.008::DOUBLE * sin({S._angle(1)}), 6) AS o2_lat,
  round(longitude + 0.008::DOUBLE * cos({S._angle(1)}), 6) AS o2_lng
FROM req""")
def polar_offset(spark, sf):
    """Both estimated offset points of every request."""
    r = fx.requests(spark, sf)
    out = [F.col("request_id")]
    for i in range(2):
        dist = F.lit(P.K.OFFSET_BASE_DIST + i * P.K.OFFSET_STEP_DIST)
        la, ln = G.polar_offset(F.col("latitude"), F.col("longitude"), P.offset_angle(F.col("request_id"), i), dist)
        out += [r6(la).alias(f"o{i + 1}_lat"), r6(ln).alias(f"o{i + 1}_lng")]
    return r.select(*out)


@register("junction_headcount", S.BASE_BP + """
SELECT request_id, CAST(ceil(officers * 0.6::DOUBLE) AS INTEGER) AS primary_officers,
       CAST(floor(officers * 0.4::DOUBLE) AS INTEGER) AS secondary_officers
FROM bp WHERE diversion_required AND p1_name IS NOT NULL""")
def junction_headcount(spark, sf):
    bp = _blueprint(spark, sf).filter(F.col("diversion_required") & F.col("p1_name").isNotNull())
    a, b = P.junction_headcount(F.col("recommended_headcount"))
    return bp.select("request_id", a.alias("primary_officers"), b.alias("secondary_officers"))


@register("map_extent", S.BASE_BP + """
, e AS (
  SELECT request_id,
    least(latitude, dest_lat, coalesce(p1_lat, latitude), coalesce(p2_lat, latitude)) AS s0,
    greatest(latitude, dest_lat, coalesce(p1_lat, latitude), coalesce(p2_lat, latitude)) AS n0,
    least(longitude, dest_lng, coalesce(p1_lng, longitude), coalesce(p2_lng, longitude)) AS w0,
    greatest(longitude, dest_lng, coalesce(p1_lng, longitude), coalesce(p2_lng, longitude)) AS e0
  FROM bp WHERE diversion_required AND p1_name IS NOT NULL)
SELECT request_id, round(s0 - (n0 - s0) * 0.2::DOUBLE, 6) AS south, round(w0 - (e0 - w0) * 0.2::DOUBLE, 6) AS west,
       round(n0 + (n0 - s0) * 0.2::DOUBLE, 6) AS north, round(e0 + (e0 - w0) * 0.2::DOUBLE, 6) AS east FROM e""")
def map_extent(spark, sf):
    ext = P.map_extent(_blueprint(spark, sf))
    return ext.select("request_id", *[r6(c).alias(c) for c in ("south", "west", "north", "east")])
