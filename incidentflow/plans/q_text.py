"""Registered queries: scalar text and geometry functions (survey H1-H4, H8-H12, H14-H16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geomath as G
from ..functions import text as TX
from ..functions.numeric import py_round
from ..operators import analytics as A
from ..operators import clean as C
from ..operators import geo as GEO
from ..operators import prescribe as P
from ..operators.features import train_table
from ..sources import fixtures as fx
from . import sqlbase as S
from ..functions.numeric import exact_round_sql as XR
from .q_prescribe import _blueprint
from .registry import register, r6


@register("title_case", S.BASE_FB + f"""
SELECT seq, {S.title_sql('event_cause')} AS cause_label FROM fb""")
def title_case(spark, sf):
    return fx.feedback(spark, sf).select("seq", TX.title_case("event_cause").alias("cause_label"))


@register("chart_label", S.BASE_SERVE + f"""
, c AS (SELECT event_cause, count(*) AS n FROM serve GROUP BY 1 ORDER BY n DESC, event_cause LIMIT 10)
SELECT event_cause, n, {S.title_sql('event_cause', all_underscores=False)} AS chart_label FROM c""")
def chart_label(spark, sf):
    top = A.value_counts(C.serve_table(fx.incidents(spark, sf)), "event_cause", k=10)
    return top.withColumn("chart_label", TX.chart_label("event_cause"))


JUNC_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(junction, '([a-z])([A-Z])', '\1 \2', 'g'), '\s*\(\s*', ' (', 'g'), '\s*\)\s*', ') ', 'g'),
  'Junc\b', 'Junction', 'g'), 'Junctions\b', 'Junction', 'g'), '\s+', ' ', 'g'))"""


@register("clean_junction_name", S.BASE_GEO + f"""
SELECT DISTINCT junction, {JUNC_SQL} AS junction_label FROM wpts WHERE junction IS NOT NULL""")
def clean_junction_name(spark, sf):
    j = GEO.wide_points(train_table(fx.incidents(spark, sf)), ["junction"]).select("junction").distinct()
    return j.withColumn("junction_label", TX.clean_junction_name("junction"))


@register("hour_label", S.BASE_TRAIN + """
SELECT incident_id, lpad(CAST(hour AS VARCHAR), 2, '0') || ':00' AS hour_label FROM train""")
def hour_label(spark, sf):
    return train_table(fx.incidents(spark, sf)).select("incident_id", TX.hour_label("hour").alias("hour_label"))


@register("iso_time", S.BASE_FB + """
SELECT seq, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') AS iso,
       strftime(CAST(strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%fZ') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS parsed
FROM fb""")
def iso_time(spark, sf):
    """Server timestamps to ISO-8601 with Z and back (H8)."""
    fb = fx.feedback(spark, sf).select("seq", TX.iso_z("timestamp").alias("iso"))
    back = C.parse_times(fb.withColumn("parsed", F.col("iso")), ["parsed"])
    return back.withColumn("parsed", F.date_format("parsed", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@register("clamp_round", S.BASE_FB + """
SELECT seq, greatest(10.0::DOUBLE, """ + XR("actual_duration * 0.37::DOUBLE", 1) + """) AS floor_10,
       least(5, greatest(1, rating)) AS rating_clamped,
       """ + XR("predicted_duration / 7.0::DOUBLE", 2) + """ AS per_day FROM fb""")
def clamp_round(spark, sf):
    """max / min clamps and rounding to 1-2 dp (H9)."""
    fb = fx.feedback(spark, sf)
    return fb.select("seq",
                     F.greatest(F.lit(10.0), py_round(F.col("actual_duration") * F.lit(0.37), 1)).alias("floor_10"),
                     F.least(F.lit(5), F.greatest(F.lit(1), F.col("rating"))).alias("rating_clamped"),
                     py_round(F.col("predicted_duration") / F.lit(7.0), 2).alias("per_day"))


@register("int_div_mod", S.BASE_FB + """
SELECT seq, recommended_officers // 2 AS half, recommended_officers // 3 AS third,
       recommended_officers % 3 AS rem3, fmod(actual_duration, 60.0::DOUBLE) AS dur_mod_60 FROM fb""")
def int_div_mod(spark, sf):
    """Integer division and remainders of integers and doubles."""
    fb = fx.feedback(spark, sf)
    o = F.col("recommended_officers")
    return fb.select("seq", F.floor(o / F.lit(2)).cast("int").alias("half"),
                     F.floor(o / F.lit(3)).cast("int").alias("third"), (o % 3).alias("rem3"),
                     (F.col("actual_duration") % F.lit(60.0)).alias("dur_mod_60"))


@register("percent_share", S.BASE_SERVE + """
, c AS (SELECT event_cause, count(*) AS n FROM serve GROUP BY 1)
SELECT event_cause, n, CAST(""" + XR("n * 100.0::DOUBLE / sum(n) OVER ()", 0, "up") + """ AS INTEGER) AS pct FROM c""")
def percent_share(spark, sf):
    """Whole-percent share of each cause."""
    c = A.value_counts(C.serve_table(fx.incidents(spark, sf)), "event_cause", dropna=False)
    return A.with_share(c, share="pct", digits=0).withColumn("pct", F.col("pct").cast("int"))


@register("great_circle_m", S.BASE_REQ + """
SELECT request_id, round(6371000.0::DOUBLE * 2.0::DOUBLE * atan2(sqrt(a), sqrt(1.0::DOUBLE - a)), 3) AS dist_m
FROM (SELECT request_id,
        sin((dest_lat - latitude) * 0.017453292519943295::DOUBLE / 2.0::DOUBLE)
          * sin((dest_lat - latitude) * 0.017453292519943295::DOUBLE / 2.0::DOUBLE)
        + cos(latitude * 0.017453292519943295::DOUBLE) * cos(dest_lat * 0.017453292519943295::DOUBLE)
          * sin((dest_lng - longitude) * 0.017453292519943295::DOUBLE / 2.0::DOUBLE)
          * sin((dest_lng - longitude) * 0.017453292519943295::DOUBLE / 2.0::DOUBLE) AS a
      FROM req)""")
def great_circle_m(spark, sf):
    """Source-to-destination distance of every request in metres, 3 dp."""
    r = fx.requests(spark, sf)
    return r.select("request_id", F.round(G.great_circle_m("latitude", "longitude", "dest_lat", "dest_lng"), 3)
                    .alias("dist_m"))


def _detour_sql(side: int) -> str:
    s = "+" if side > 0 else "-"
    return f"""
  CASE WHEN len > 0 THEN mid_lat {s} (-dy / len) * 0.002::DOUBLE ELSE mid_lat {s} 0.0015::DOUBLE END,
  CASE WHEN len > 0 THEN mid_lng {s} (dx / len) * 0.002::DOUBLE ELSE mid_lng {s} 0.0015::DOUBLE END"""


DETOUR_BASE = S.BASE_REQ + """
, d0 AS (SELECT request_id, latitude AS u_lat, longitude AS u_lng, dest_lat AS d_lat, dest_lng AS d_lng,
                (latitude + dest_lat) / 2.0::DOUBLE AS mid_lat, (longitude + dest_lng) / 2.0::DOUBLE AS mid_lng,
                dest_lat - latitude AS dx, dest_lng - longitude AS dy FROM req),
  d1 AS (SELECT *, sqrt(dx * dx + dy * dy) AS len FROM d0)"""


@register("detour_waypoint", DETOUR_BASE + f"""
, d2 AS (SELECT request_id, {_detour_sql(1)[1:].replace(chr(10), ' ').replace('END,', 'END AS w1_lat,', 1)} AS w1_lng,
                {_detour_sql(-1).replace(chr(10), ' ').replace('END,', 'END AS w2_lat,', 1)} AS w2_lng FROM d1)
SELECT request_id, round(w1_lat, 6) AS w1_lat, round(w1_lng, 6) AS w1_lng,
       round(w2_lat, 6) AS w2_lat, round(w2_lng, 6) AS w2_lng FROM d2""")
def detour_waypoint(spark, sf):
    """Primary and alternative detour waypoints of every request."""
    r = fx.requests(spark, sf)
    a_lat, a_lng = G.detour_waypoint("latitude", "longitude", "dest_lat", "dest_lng", 1)
    b_lat, b_lng = G.detour_waypoint("latitude", "longitude", "dest_lat", "dest_lng", -1)
    return r.select("request_id", r6(a_lat).alias("w1_lat"), r6(a_lng).alias("w1_lng"),
                    r6(b_lat).alias("w2_lat"), r6(b_lng).alias("w2_lng"))


T_VALUES = """
tv AS (
  WITH RECURSIVE t(i, v) AS (SELECT 0, 0.0::DOUBLE UNION ALL SELECT i + 1, v + 0.08::DOUBLE FROM t WHERE i < 12)
  SELECT i, v FROM t
)"""


def _leg_sql(leg: str, lat1, lng1, lat2, lng2, base_seq: str = "0") -> str:
    return f"""
SELECT request_id, '{leg}' AS route, CAST({base_seq} + tv.i AS INTEGER) AS seq,
  round((1.0::DOUBLE - tv.v) * (1.0::DOUBLE - tv.v) * {lat1} + 2.0::DOUBLE * (1.0::DOUBLE - tv.v) * tv.v *
        (({lat1} + {lat2}) / 2.0::DOUBLE - ({lng2} - {lng1}) * 0.15::DOUBLE) + tv.v * tv.v * {lat2}, 6) AS lat,
  round((1.0::DOUBLE - tv.v) * (1.0::DOUBLE - tv.v) * {lng1} + 2.0::DOUBLE * (1.0::DOUBLE - tv.v) * tv.v *
        (({lng1} + {lng2}) / 2.0::DOUBLE + ({lat2} - {lat1}) * 0.15::DOUBLE) + tv.v * tv.v * {lng2}, 6) AS lng
FROM req, tv
UNION ALL
SELECT request_id, '{leg}', CAST({base_seq} + 13 AS INTEGER), round({lat2}, 6), round({lng2}, 6) FROM req"""


@register("curve_points", S.with_ctes(S.INC, S.FILLED, S.REQ, T_VALUES) + _leg_sql(
    "affected", "latitude", "longitude", "dest_lat", "dest_lng"))
def curve_points(spark, sf):
    """Fallback curved path of every request's closed segment: 14 points."""
    r = fx.requests(spark, sf)
    rows = G.curve_rows(r, "request_id", [("latitude", "longitude", "dest_lat", "dest_lng")])
    return rows.select("request_id", F.lit("affected").alias("route"), "seq", r6("lat").alias("lat"),
                       r6("lng").alias("lng"))


@register("path_concat", S.with_ctes(S.INC, S.FILLED, S.REQ, T_VALUES) + """
, w AS (SELECT request_id,
          CASE WHEN len > 0 THEN mid_lat + (-dy / len) * 0.002::DOUBLE ELSE mid_lat + 0.0015::DOUBLE END AS w_lat,
          CASE WHEN len > 0 THEN mid_lng + (dx / len) * 0.002::DOUBLE ELSE mid_lng + 0.0015::DOUBLE END AS w_lng,
          latitude, longitude, dest_lat, dest_lng
        FROM (SELECT *, sqrt(dx * dx + dy * dy) AS len FROM
              (SELECT *, (latitude + dest_lat) / 2.0::DOUBLE AS mid_lat, (longitude + dest_lng) / 2.0::DOUBLE AS mid_lng,
                      dest_lat - latitude AS dx, dest_lng - longitude AS dy FROM req)))
SELECT request_id, CAST(tv.i AS INTEGER) AS seq,
  round((1.0::DOUBLE - tv.v) * (1.0::DOUBLE - tv.v) * latitude + 2.0::DOUBLE * (1.0::DOUBLE - tv.v) * tv.v *
        ((latitude + w_lat) / 2.0::DOUBLE - (w_lng - longitude) * 0.15::DOUBLE) + tv.v * tv.v * w_lat, 6) AS lat,
  round((1.0::DOUBLE - tv.v) * (1.0::DOUBLE - tv.v) * longitude + 2.0::DOUBLE * (1.0::DOUBLE - tv.v) * tv.v *
        ((longitude + w_lng) / 2.0::DOUBLE + (w_lat - latitude) * 0.15::DOUBLE) + tv.v * tv.v * w_lng, 6) AS lng
FROM w, tv
UNION ALL SELECT request_id, 13, round(w_lat, 6), round(w_lng, 6) FROM w
UNION ALL
SELECT request_id, CAST(14 + tv.i AS INTEGER),
  round((1.0::DOUBLE - tv.v) * (1.0::DOUBLE - tv.v) * w_lat + 2.0::DOUBLE * (1.0::DOUBLE - tv.v) * tv.v *
        ((w_lat + dest_lat) / 2.0::DOUBLE - (dest_lng - w_lng) * 0.15::DOUBLE) + tv.v * tv.v * dest_lat, 6),
  round((1.0::DOUBLE - tv.v) * (1.0::DOUBLE - tv.v) * w_lng + 2.0::DOUBLE * (1.0::DOUBLE - tv.v) * tv.v *
        ((w_lng + dest_lng) / 2.0::DOUBLE + (dest_lat - w_lat) * 0.15::DOUBLE) + tv.v * tv.v * dest_lng, 6)
FROM w, tv
UNION ALL SELECT request_id, 27, round(dest_lat, 6), round(dest_lng, 6) FROM w""")
def path_concat(spark, sf):
    """Two legs source -> detour waypoint -> destination concatenated in order.

    One path for every request, to its destination; the original's routes (H16) are ``diversion_routes``.
    """
    r = fx.requests(spark, sf)
    w_lat, w_lng = G.detour_waypoint("latitude", "longitude", "dest_lat", "dest_lng", 1)
    r = r.withColumn("w_lat", w_lat).withColumn("w_lng", w_lng)
    rows = G.curve_rows(r, "request_id", [("latitude", "longitude", "w_lat", "w_lng"),
                                          ("w_lat", "w_lng", "dest_lat", "dest_lng")])
    return rows.select("request_id", "seq", r6("lat").alias("lat"), r6("lng").alias("lng"))


def _route_leg(lat1, lng1, lat2, lng2, first: int) -> str:
    return f"""
SELECT request_id, route, CAST({first} + tv.i AS INTEGER) AS seq,
  round((1.0::DOUBLE - tv.v) * (1.0::DOUBLE - tv.v) * {lat1} + 2.0::DOUBLE * (1.0::DOUBLE - tv.v) * tv.v *
        (({lat1} + {lat2}) / 2.0::DOUBLE - ({lng2} - {lng1}) * 0.15::DOUBLE) + tv.v * tv.v * {lat2}, 6) AS lat,
  round((1.0::DOUBLE - tv.v) * (1.0::DOUBLE - tv.v) * {lng1} + 2.0::DOUBLE * (1.0::DOUBLE - tv.v) * tv.v *
        (({lng1} + {lng2}) / 2.0::DOUBLE + ({lat2} - {lat1}) * 0.15::DOUBLE) + tv.v * tv.v * {lng2}, 6) AS lng
FROM w, tv
UNION ALL SELECT request_id, route, {first + 13}, round({lat2}, 6), round({lng2}, 6) FROM w"""


@register("diversion_routes", S.with_ctes(S.INC, S.FILLED, S.SERVE, S.TRAIN, S.REQ, S.WPTS, S.FC, S.SUGG, S.BP, T_VALUES) + """
, need AS (SELECT *, sqrt(dx * dx + dy * dy) AS len FROM
            (SELECT *, (latitude + dest_lat) / 2.0::DOUBLE AS mid_lat, (longitude + dest_lng) / 2.0::DOUBLE AS mid_lng,
                    dest_lat - latitude AS dx, dest_lng - longitude AS dy
             FROM bp WHERE diversion_required AND p1_name IS NOT NULL)),
w AS (
  SELECT request_id, 'primary' AS route, latitude, longitude, p1_lat AS to_lat, p1_lng AS to_lng,
         CASE WHEN len > 0 THEN mid_lat + (-dy / len) * 0.002::DOUBLE ELSE mid_lat + 0.0015::DOUBLE END AS w_lat,
         CASE WHEN len > 0 THEN mid_lng + (dx / len) * 0.002::DOUBLE ELSE mid_lng + 0.0015::DOUBLE END AS w_lng
  FROM need
  UNION ALL
  SELECT request_id, 'alternative', latitude, longitude, p2_lat, p2_lng,
         CASE WHEN len > 0 THEN mid_lat - (-dy / len) * 0.002::DOUBLE ELSE mid_lat - 0.0015::DOUBLE END,
         CASE WHEN len > 0 THEN mid_lng - (dx / len) * 0.002::DOUBLE ELSE mid_lng - 0.0015::DOUBLE END
  FROM need WHERE p2_name IS NOT NULL)""" + _route_leg("latitude", "longitude", "w_lat", "w_lng", 0) + """
UNION ALL""" + _route_leg("w_lat", "w_lng", "to_lat", "to_lng", 14))
def diversion_routes(spark, sf):
    """Primary and alternative route of every request that needs a diversion, to its diversion points."""
    return P.diversion_routes(_blueprint(spark, sf)).select("request_id", "route", "seq", r6("lat").alias("lat"),
                                                            r6("lng").alias("lng"))
