"""Registered queries: hulls, GeoJSON, jurisdiction and nearest junctions (survey D10, A5, C6, C8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import geo as GEO
from ..operators import hulls as H
from ..operators import nearest as N
from ..operators.features import train_table
from ..session import work_path
from ..sources import fixtures as fx
from ..sources import readers as R
from ..sources import writers as W
from . import sqlbase as S
from .registry import register, r6


@register("station_hulls")
def station_hulls(spark, sf):
    """Convex hull ring per station (D10); checked against a brute force in tests."""
    h = H.station_hulls(train_table(fx.incidents(spark, sf)))
    return h.select("police_station", "n_vertices", "degenerate", F.to_json("ring").alias("ring"))


@register("write_polygons_geojson")
def write_polygons_geojson(spark, sf):
    """One GeoJSON Feature per station as text (A5)."""
    return H.to_geojson(H.station_hulls(train_table(fx.incidents(spark, sf))))


@register("jurisdiction_lookup", S.with_ctes(S.INC, S.FILLED, S.SERVE, S.TRAIN, S.REQ, S.WPTS) + """
, hs AS (SELECT DISTINCT police_station FROM wpts)
SELECT r.request_id, r.police_station,
       CASE WHEN hs.police_station IS NOT NULL THEN 'polygon' WHEN d.name IS NOT NULL THEN 'circle'
            ELSE 'none' END AS jurisdiction_kind,
       round(d.lat, 6) AS center_lat, round(d.lng, 6) AS center_lng,
       CASE WHEN hs.police_station IS NULL AND d.name IS NOT NULL THEN 2200.0::DOUBLE END AS radius_m
FROM req r LEFT JOIN hs ON hs.police_station = r.police_station
           LEFT JOIN sdim d ON d.name = r.police_station""")
def jurisdiction_lookup(spark, sf):
    inc = fx.incidents(spark, sf)
    tr = train_table(inc)
    out = H.attach_jurisdiction(fx.requests_from_incidents(inc), H.station_hulls(tr), GEO.station_centroids(tr))
    return out.select("request_id", "police_station", "jurisdiction_kind", r6("center_lat").alias("center_lat"),
                      r6("center_lng").alias("center_lng"), "radius_m")


NEAREST_SQL = S.with_ctes(S.INC, S.FILLED, S.SERVE, S.TRAIN, S.WPTS) + """
, x AS (
  SELECT s.incident_id, j.name AS junction,
    sin((j.lat - s.latitude) * 0.017453292519943295::DOUBLE / 2.0::DOUBLE)
      * sin((j.lat - s.latitude) * 0.017453292519943295::DOUBLE / 2.0::DOUBLE)
    + cos(s.latitude * 0.017453292519943295::DOUBLE) * cos(j.lat * 0.017453292519943295::DOUBLE)
      * sin((j.lng - s.longitude) * 0.017453292519943295::DOUBLE / 2.0::DOUBLE)
      * sin((j.lng - s.longitude) * 0.017453292519943295::DOUBLE / 2.0::DOUBLE) AS a
  FROM serve s, jdim j),
  d AS (SELECT incident_id, junction, 6371000.0::DOUBLE * 2.0::DOUBLE * atan2(sqrt(a), sqrt(1.0::DOUBLE - a)) AS dist
        FROM x),
  r AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY dist, junction) AS rank FROM d)
SELECT incident_id, CAST(rank AS INTEGER) AS rank, junction, round(dist, 3) AS dist_m FROM r WHERE rank <= 3"""


@register("nearest_points", NEAREST_SQL)
def nearest_points(spark, sf):
    """Three nearest junction centroids of every incident by great-circle distance."""
    inc = fx.incidents(spark, sf)
    serve = C.serve_table(inc).select("incident_id", "latitude", "longitude")
    jdim = GEO.junction_centroids(train_table(inc))
    out = N.nearest(serve, jdim, "incident_id", k=3)
    return out.select("incident_id", "rank", "junction", F.round("dist_m", 3).alias("dist_m"))


HULL_CTES = """
, pts AS (
  SELECT DISTINCT police_station, CAST(round(longitude * 1000000.0::DOUBLE) AS BIGINT) AS x,
                  CAST(round(latitude * 1000000.0::DOUBLE) AS BIGINT) AS y FROM wpts),
  pairs AS (
  SELECT a.police_station, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM pts a JOIN pts b
    ON a.police_station = b.police_station AND (a.x <> b.x OR a.y <> b.y)),
  sup AS (   -- ordered pairs (a, b) with no point strictly right of a -> b
  SELECT p.police_station, p.ax, p.ay, p.bx, p.by FROM pairs p JOIN pts r ON r.police_station = p.police_station
  GROUP BY p.police_station, p.ax, p.ay, p.bx, p.by
  HAVING min((p.bx - p.ax) * (r.y - p.ay) - (p.by - p.ay) * (r.x - p.ax)) >= 0),
  vtx AS (   -- a is a vertex when nothing on the supporting line lies behind it
  SELECT DISTINCT police_station, x, y FROM (
    SELECT s.police_station, s.ax AS x, s.ay AS y FROM sup s JOIN pts r ON r.police_station = s.police_station
    GROUP BY s.police_station, s.ax, s.ay, s.bx, s.by
    HAVING min(CASE WHEN (s.bx - s.ax) * (r.y - s.ay) - (s.by - s.ay) * (r.x - s.ax) = 0
                    THEN (r.x - s.ax) * (s.bx - s.ax) + (r.y - s.ay) * (s.by - s.ay) END) >= 0)),
  nv AS (SELECT police_station, count(*) AS n FROM vtx GROUP BY 1),
  st AS (SELECT DISTINCT police_station FROM pts),
  sq AS (   -- fewer than three vertices: the square around the station centroid
  SELECT st.police_station, CAST(round((d.lng + cx) * 1000000.0::DOUBLE) AS BIGINT) AS x,
         CAST(round((d.lat + cy) * 1000000.0::DOUBLE) AS BIGINT) AS y
  FROM st LEFT JOIN nv ON nv.police_station = st.police_station
          JOIN sdim d ON d.name = st.police_station,
       (VALUES (-0.015::DOUBLE, -0.015::DOUBLE), (0.015::DOUBLE, -0.015::DOUBLE),
               (0.015::DOUBLE, 0.015::DOUBLE), (-0.015::DOUBLE, 0.015::DOUBLE)) c(cx, cy)
  WHERE coalesce(nv.n, 0) < 3),
  corners AS (
  SELECT v.police_station, v.x, v.y FROM vtx v JOIN nv ON nv.police_station = v.police_station WHERE nv.n >= 3
  UNION ALL SELECT police_station, x, y FROM sq)"""
HULL_SQL = S.with_ctes(S.INC, S.FILLED, S.TRAIN, S.WPTS) + HULL_CTES + "\nSELECT police_station, x, y FROM corners"


def _vertices(hulls):
    """One row for each vertex of a ring, as integer micro-degree points."""
    v = hulls.select("police_station", F.explode(F.slice("ring", 1, F.size("ring") - 1)).alias("p"))
    return v.select("police_station", F.round(F.col("p")[0] * F.lit(1e6)).cast("long").alias("x"),
                    F.round(F.col("p")[1] * F.lit(1e6)).cast("long").alias("y"))


@register("polygon_files", HULL_SQL)
def polygon_files(spark, sf):
    """The polygons written as GeoJSON FeatureCollection files and read back: their vertices (A5)."""
    path = work_path(spark, "polygons_geojson")
    W.write_feature_collections(H.to_geojson(H.station_hulls(train_table(fx.incidents(spark, sf)))), path)
    return _vertices(R.read_feature_collections(spark, path))


# some requests name the default entry (it has a centroid and no polygon) or a station without history
_OTHER_STATION = ("CASE WHEN request_id % 7 = 0 THEN 'default' WHEN request_id % 11 = 0 THEN 'No such station' "
                  "ELSE police_station END")


@register("jurisdiction_rings", S.with_ctes(S.INC, S.FILLED, S.SERVE, S.TRAIN, S.REQ, S.WPTS) + HULL_CTES + f"""
, rings AS (SELECT police_station, string_agg(x || ' ' || y, ',' ORDER BY x, y) AS ring FROM corners GROUP BY 1),
  asked AS (SELECT request_id, {_OTHER_STATION} AS police_station FROM req)
SELECT a.request_id, a.police_station,
       CASE WHEN g.ring IS NOT NULL THEN 'polygon' WHEN d.name IS NOT NULL THEN 'circle' ELSE 'none' END AS jurisdiction_kind,
       g.ring, round(d.lat, 6) AS center_lat, round(d.lng, 6) AS center_lng
FROM asked a LEFT JOIN rings g ON g.police_station = a.police_station
             LEFT JOIN sdim d ON d.name = a.police_station""")
def jurisdiction_rings(spark, sf):
    """Jurisdiction with its polygon, as sorted vertices; stations of all three kinds occur."""
    inc = fx.incidents(spark, sf)
    tr = train_table(inc)
    asked = fx.requests_from_incidents(inc).withColumn("police_station", F.expr(_OTHER_STATION))
    out = H.attach_jurisdiction(asked, H.station_hulls(tr), GEO.station_centroids(tr))
    points = F.transform(F.slice("ring", 1, F.size("ring") - 1), lambda p: F.struct(
        F.round(p[0] * F.lit(1e6)).cast("long").alias("x"), F.round(p[1] * F.lit(1e6)).cast("long").alias("y")))
    text = F.array_join(F.transform(F.array_sort(points), lambda p: F.concat_ws(" ", p["x"].cast("string"),
                                                                                p["y"].cast("string"))), ",")
    return out.select("request_id", "police_station", "jurisdiction_kind", text.alias("ring"),
                      r6("center_lat").alias("center_lat"), r6("center_lng").alias("center_lng"))


@register("hull_vertices", HULL_SQL)
def hull_vertices(spark, sf):
    """Hull vertices per station as integer micro-degree points (D10, oracle form)."""
    return _vertices(H.station_hulls(train_table(fx.incidents(spark, sf))))
