"""Registered queries: spatial dimensions and lookups (survey D8, D9, D11, D12, C1, C2, C7, G2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import geo as GEO
from ..operators.features import train_table
from ..sources import fixtures as fx
from . import sqlbase as S
from .registry import register, r6


def _train(spark, sf):
    return train_table(fx.incidents(spark, sf))


@register("station_centroids", S.BASE_GEO + """
SELECT name, round(lat, 6) AS lat, round(lng, 6) AS lng FROM sdim""")
def station_centroids(spark, sf):
    d = GEO.station_centroids(_train(spark, sf))
    return d.select("name", r6("lat").alias("lat"), r6("lng").alias("lng"))


@register("junction_centroids", S.BASE_GEO + """
SELECT name, round(lat, 6) AS lat, round(lng, 6) AS lng FROM jdim""")
def junction_centroids(spark, sf):
    d = GEO.junction_centroids(_train(spark, sf))
    return d.select("name", r6("lat").alias("lat"), r6("lng").alias("lng"))


@register("distinct_points", S.BASE_GEO + """
SELECT DISTINCT police_station, latitude, longitude FROM wpts""")
def distinct_points(spark, sf):
    return GEO.distinct_points(_train(spark, sf))


@register("option_lists", S.BASE_TRAIN + """
, kv AS (
  SELECT 'police_stations' AS list, police_station AS value FROM train
  UNION SELECT 'corridors', corridor FROM train
  UNION SELECT 'event_causes', event_cause FROM train
  UNION SELECT 'event_types', coalesce(event_type, 'Unknown') FROM train
  UNION SELECT 'junctions', junction FROM train)
SELECT list, value, CAST(row_number() OVER (PARTITION BY list ORDER BY value) - 1 AS INTEGER) AS position
FROM kv WHERE value IS NOT NULL""")
def option_lists(spark, sf):
    return GEO.option_lists(_train(spark, sf))


@register("top_junctions", S.with_ctes(S.INC, S.FILLED, S.SERVE,
                                       S.top_junctions_sql("police_station", "tj_st"),
                                       S.top_junctions_sql("corridor", "tj_co")) + """
SELECT 'station' AS kind, police_station AS key, rank, junction, n FROM tj_st_r WHERE rank <= 3
UNION ALL
SELECT 'corridor', corridor, rank, junction, n FROM tj_co_r WHERE rank <= 3""")
def top_junctions(spark, sf):
    serve = C.serve_table(fx.incidents(spark, sf))
    t = GEO.top_junctions_multi(serve, ("police_station", "corridor"))
    kind = F.when(F.col("kind") == "police_station", F.lit("station")).otherwise(F.lit("corridor"))
    return t.withColumn("kind", kind)


def _suggestions(spark, sf):
    inc = fx.incidents(spark, sf)
    return GEO.suggest_junctions(fx.requests_from_incidents(inc), C.serve_table(inc))


@register("junction_fallback", S.with_ctes(S.INC, S.FILLED, S.SERVE, S.REQ) + ", fc AS (SELECT * FROM req), "
          + S.SUGG[1:] + """
SELECT request_id, CAST(generate_subscripts(suggested, 1) AS INTEGER) AS rank,
       unnest(suggested) AS junction, junction_source FROM sugg""")
def junction_fallback(spark, sf):
    s = _suggestions(spark, sf)
    return s.select("request_id", F.posexplode("suggested_junctions").alias("pos", "junction"),
                    "junction_source").select(
        "request_id", (F.col("pos") + 1).cast("int").alias("rank"), "junction", "junction_source")


@register("station_equality_filter", S.with_ctes(S.INC, S.FILLED, S.SERVE, S.REQ) + """
, sc AS (SELECT police_station, count(*) AS n FROM serve WHERE junction IS NOT NULL GROUP BY 1)
SELECT r.request_id, r.police_station, coalesce(sc.n, 0) AS station_history_rows
FROM req r LEFT JOIN sc ON sc.police_station = r.police_station""")
def station_equality_filter(spark, sf):
    """History rows with a junction that share each request's station (C9), by equi-join."""
    inc = fx.incidents(spark, sf)
    serve = C.serve_table(inc)
    counts = (serve.filter(F.col("junction").isNotNull()).groupBy("police_station")
              .agg(F.count(F.lit(1)).alias("n")))
    req = fx.requests_from_incidents(inc)
    from ..operators.dims import join_dim
    return (join_dim(req, counts, "police_station", name="station_counts")
            .select("request_id", "police_station",
                    F.coalesce(F.col("n"), F.lit(0)).alias("station_history_rows")))


@register("junction_coords_lookup", S.with_ctes(S.INC, S.FILLED, S.SERVE, S.TRAIN, S.WPTS) + """
SELECT s.incident_id, s.junction, round(j.lat, 6) AS junction_lat, round(j.lng, 6) AS junction_lng
FROM serve s LEFT JOIN jdim j ON j.name = s.junction""")
def junction_coords_lookup(spark, sf):
    inc = fx.incidents(spark, sf)
    serve = C.serve_table(inc).select("incident_id", "junction")
    out = GEO.attach_junction(serve, GEO.junction_centroids(train_table(inc)))
    return out.select("incident_id", "junction", r6("junction_lat").alias("junction_lat"),
                      r6("junction_lng").alias("junction_lng"))


@register("station_snap", S.with_ctes(S.INC, S.FILLED, S.SERVE, S.TRAIN, S.REQ, S.WPTS) + """
SELECT r.request_id, r.police_station, round(d.lat, 6) AS src_lat, round(d.lng, 6) AS src_lng,
       round(d.lat + 0.0005::DOUBLE, 6) AS dst_lat, round(d.lng + (-0.001)::DOUBLE, 6) AS dst_lng
FROM req r LEFT JOIN sdim d ON d.name = r.police_station""")
def station_snap(spark, sf):
    inc = fx.incidents(spark, sf)
    out = GEO.snap_station(fx.requests_from_incidents(inc), GEO.station_centroids(train_table(inc)))
    return out.select("request_id", "police_station", *[r6(c).alias(c) for c in
                                                        ("src_lat", "src_lng", "dst_lat", "dst_lng")])


@register("meta_summary")
def meta_summary(spark, sf):
    """The one-row metadata document: lists, centroid maps, polygons."""
    from ..operators import hulls as H
    tr = _train(spark, sf)
    return GEO.meta_summary(tr, H.polygons(H.station_hulls(tr)))
