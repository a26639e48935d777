"""Registered queries: analytics over the cleaned history (survey D1-D7, D18, D21, D22, C5, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import clean as C
from ..sources import fixtures as fx
from . import sqlbase as S
from ..functions.numeric import exact_round_sql as XR
from .registry import register


def _serve(spark, sf):
    return C.serve_table(fx.incidents(spark, sf))


def _topk_sql(col: str, k: int) -> str:
    return S.BASE_SERVE + f"""
SELECT {col}, count(*) AS n FROM serve WHERE {col} IS NOT NULL
GROUP BY {col} ORDER BY n DESC, {col} ASC LIMIT {k}"""


@register("cause_top10", _topk_sql("event_cause", 10))
def cause_top10(spark, sf):
    return A.value_counts(_serve(spark, sf), "event_cause", k=10)


@register("station_top8", _topk_sql("police_station", 8))
def station_top8(spark, sf):
    return A.value_counts(_serve(spark, sf), "police_station", k=8)


@register("corridor_top8", _topk_sql("corridor", 8))
def corridor_top8(spark, sf):
    return A.value_counts(_serve(spark, sf), "corridor", k=8)


@register("top_k", _topk_sql("junction", 3))
def top_k(spark, sf):
    """Generic top-k (F1): the three busiest junctions."""
    return A.value_counts(_serve(spark, sf), "junction", k=3)


@register("hour_distribution", S.BASE_SERVE + """
SELECT CAST(hour(start_datetime) AS INTEGER) AS hour, count(*) AS n FROM serve
WHERE start_datetime IS NOT NULL GROUP BY 1""")
def hour_distribution(spark, sf):
    return A.hour_counts(_serve(spark, sf))


@register("hour_zero_fill", S.BASE_SERVE + """
, h AS (SELECT CAST(hour(start_datetime) AS INTEGER) AS hour, count(*) AS n FROM serve
        WHERE start_datetime IS NOT NULL GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS hour, CAST(coalesce(h.n, 0) AS BIGINT) AS n
FROM range(24) r LEFT JOIN h ON h.hour = r.range""")
def hour_zero_fill(spark, sf):
    return A.hour_distribution(_serve(spark, sf))


@register("sorted_hours", S.BASE_SERVE + """
, h AS (SELECT CAST(hour(start_datetime) AS INTEGER) AS hour, count(*) AS n FROM serve
        WHERE start_datetime IS NOT NULL GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS hour, CAST(coalesce(h.n, 0) AS BIGINT) AS n,
       lpad(CAST(r.range AS VARCHAR), 2, '0') || ':00' AS hour_label
FROM range(24) r LEFT JOIN h ON h.hour = r.range ORDER BY 1""")
def sorted_hours(spark, sf):
    """Ascending hour order with the chart label."""
    hd = A.hour_distribution(_serve(spark, sf))
    return (hd.withColumn("hour_label", F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00")))
            .orderBy("hour"))


@register("priority_counts", S.BASE_SERVE + """
, c AS (SELECT priority, count(*) AS n FROM serve GROUP BY priority)
SELECT priority, n, """ + XR("n * 100.0::DOUBLE / sum(n) OVER ()", 1, "up") + """ AS share_pct FROM c""")
def priority_counts(spark, sf):
    return A.with_share(A.value_counts(_serve(spark, sf), "priority", dropna=False))


@register("closure_counts", S.BASE_SERVE + """
SELECT CASE WHEN requires_road_closure THEN 'True' ELSE 'False' END AS closure, count(*) AS n
FROM serve GROUP BY 1""")
def closure_counts(spark, sf):
    return A.closure_counts(_serve(spark, sf))


@register("total_incidents", S.BASE_SERVE + """
SELECT count(*) AS total_incidents FROM serve""")
def total_incidents(spark, sf):
    return _serve(spark, sf).agg(F.count(F.lit(1)).alias("total_incidents"))


@register("hotspot_sample", S.BASE_SERVE + """
SELECT incident_id, latitude, longitude, event_cause, priority, requires_road_closure FROM serve
ORDER BY md5('42-' || CAST(incident_id AS VARCHAR)), incident_id LIMIT 120""")
def hotspot_sample(spark, sf):
    s = _serve(spark, sf).select("incident_id", "latitude", "longitude", "event_cause", "priority",
                                 "requires_road_closure")
    return A.sample_n(s)


@register("top_labels", S.BASE_SERVE + """
, st AS (SELECT 'station' AS kind, police_station AS label, count(*) AS n FROM serve GROUP BY 2
         ORDER BY n DESC, label LIMIT 1),
  co AS (SELECT 'corridor' AS kind, corridor AS label, count(*) AS n FROM serve GROUP BY 2
         ORDER BY n DESC, label LIMIT 1),
  ca AS (SELECT 'cause' AS kind, event_cause AS label, count(*) AS n FROM serve GROUP BY 2
         ORDER BY n DESC, label LIMIT 1)
SELECT * FROM st UNION ALL SELECT * FROM co UNION ALL SELECT * FROM ca""")
def top_labels(spark, sf):
    """Argmax station, corridor and cause (D18); ties go to the smallest label."""
    return A.top_k_each(_serve(spark, sf), {"station": "police_station", "corridor": "corridor",
                                            "cause": "event_cause"}).select("kind", "label", "n")


@register("peak_surge", S.BASE_SERVE + f"""
, h AS (SELECT CAST(hour(start_datetime) AS INTEGER) AS hour, count(*) AS n FROM serve
        WHERE start_datetime IS NOT NULL GROUP BY 1),
  a AS (SELECT coalesce(sum(CASE WHEN hour IN {S.PEAK} THEN n ELSE 0 END), 0) AS peak_n,
               coalesce(sum(CASE WHEN hour NOT IN {S.PEAK} THEN n ELSE 0 END), 0) AS off_n FROM h)
SELECT CAST(peak_n AS BIGINT) AS peak_n, CAST(off_n AS BIGINT) AS off_n,
       """ + XR("CASE WHEN off_n = 0 THEN NULL ELSE (peak_n / 8.0::DOUBLE) / (off_n / 16.0::DOUBLE) END", 2)
       + """ AS surge_ratio FROM a""")
def peak_surge(spark, sf):
    return A.peak_surge(_serve(spark, sf))


@register("analytics_summary", S.BASE_SERVE + """
, kv AS (
  SELECT 'total' AS section, 'all' AS label FROM serve
  UNION ALL SELECT 'cause', event_cause FROM serve
  UNION ALL SELECT 'hour', CAST(hour(start_datetime) AS VARCHAR) FROM serve
  UNION ALL SELECT 'priority', priority FROM serve
  UNION ALL SELECT 'closure', CASE WHEN requires_road_closure THEN 'True' ELSE 'False' END FROM serve
  UNION ALL SELECT 'station', police_station FROM serve
  UNION ALL SELECT 'corridor', corridor FROM serve),
  c AS (SELECT section, label, count(*) AS n FROM kv WHERE label IS NOT NULL GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, label) AS rk FROM c)
SELECT section, label, n FROM r
WHERE NOT ((section = 'cause' AND rk > 10) OR (section IN ('station', 'corridor') AND rk > 8))""")
def analytics_summary(spark, sf):
    """All analytics sections from one scan and one shuffle, in long form."""
    return A.analytics_long(_serve(spark, sf))


@register("station_severity_summary", S.BASE_TRAIN + """
SELECT police_station, congestion_severity, count(*) AS n,
       round(avg(congestion_score), 6) AS avg_score,
       CAST(sum(CASE WHEN requires_road_closure THEN 1 ELSE 0 END) AS BIGINT) AS closures
FROM train GROUP BY 1, 2""")
def station_severity_summary(spark, sf):
    """Flagship: incidents, mean score and closures per station and severity."""
    from ..operators.features import train_table
    t = train_table(fx.incidents(spark, sf))
    return t.groupBy("police_station", "congestion_severity").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("congestion_score"), 6).alias("avg_score"),
        F.sum(F.when(F.col("requires_road_closure"), 1).otherwise(0)).cast("long").alias("closures"))


@register("marker_class", S.BASE_SERVE + """
SELECT incident_id, CASE WHEN priority = 'High' AND requires_road_closure THEN 'critical'
                         WHEN priority = 'High' THEN 'high' WHEN requires_road_closure THEN 'medium'
                         ELSE 'low' END AS marker_class FROM serve""")
def marker_class(spark, sf):
    s = _serve(spark, sf)
    return s.select("incident_id", A.marker_class(F.col("priority"), F.col("requires_road_closure"))
                    .alias("marker_class"))


@register("cause_category", S.BASE_SERVE + """
SELECT incident_id, event_cause,
       CASE WHEN contains(lower(event_cause), 'accident') THEN 'accident'
            WHEN contains(lower(event_cause), 'protest') THEN 'protest'
            WHEN contains(lower(event_cause), 'water') THEN 'water'
            WHEN contains(lower(event_cause), 'construction') THEN 'construction'
            WHEN contains(lower(event_cause), 'breakdown') THEN 'breakdown'
            WHEN contains(lower(event_cause), 'other') THEN 'other' ELSE 'generic' END AS cause_category
FROM serve""")
def cause_category(spark, sf):
    s = _serve(spark, sf)
    return s.select("incident_id", "event_cause", A.cause_category(F.col("event_cause")).alias("cause_category"))


@register("analytics_document")
def analytics_document(spark, sf):
    """The one-row analytics response (D21 document form; its parts are oracle-checked)."""
    return A.analytics_document(_serve(spark, sf))
