"""Registered queries: feedback ledger, statistics, learning curve, attribution (survey B14-B23,
D13-D17, D20, E1, F3, G1, H5, I13, I14, H18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as AT
from ..operators import feedback as FB
from ..operators import prescribe as P
from ..operators.features import train_table
from ..functions import text as TX
from ..sources import fixtures as fx
from . import sqlbase as S
from ..functions.numeric import exact_round_sql as XR
from .registry import register, r6


def _fb(spark, sf):
    return fx.feedback(spark, sf)


@register("fb_standardise", S.BASE_FB + f"""
SELECT seq, actual_severity AS congestion_severity, actual_duration AS duration_min,
       CAST(coalesce(hour IN {S.PEAK}, false) AS INTEGER) AS is_peak_hour FROM fb""")
def fb_standardise(spark, sf):
    return FB.standardise_feedback(_fb(spark, sf)).select(
        "seq", "congestion_severity", "duration_min", "is_peak_hour")


@register("fb_defaults", S.BASE_FB + """
SELECT seq, coalesce(event_type, 'unplanned') AS event_type, coalesce(event_cause, 'others') AS event_cause,
       coalesce(requires_road_closure, false) AS requires_road_closure, coalesce(priority, 'Low') AS priority,
       coalesce(corridor, 'Non-corridor') AS corridor, coalesce(police_station, 'Unknown') AS police_station,
       coalesce(hour, 12) AS hour, coalesce(day_of_week, 1) AS day_of_week FROM fb""")
def fb_defaults(spark, sf):
    return FB.feedback_defaults(_fb(spark, sf)).select(
        "seq", "event_type", "event_cause", "requires_road_closure", "priority", "corridor",
        "police_station", "hour", "day_of_week")


@register("fb_search", S.BASE_FB + """
SELECT seq, event_id, event_cause FROM fb
WHERE contains(lower(event_id), 'water log') OR contains(lower(replace(event_cause, '_', ' ')), 'water log')""")
def fb_search(spark, sf):
    return FB.search_feedback(_fb(spark, sf), text=" Water Log ").select("seq", "event_id", "event_cause")


@register("fb_search_id", S.BASE_FB + """
SELECT seq, event_id FROM fb
WHERE contains(lower(event_id), 'evt-12') OR contains(lower(replace(event_cause, '_', ' ')), 'evt-12')""")
def fb_search_id(spark, sf):
    """Search on the event id side."""
    return FB.search_feedback(_fb(spark, sf), text="EVT-12").select("seq", "event_id")


@register("fb_filter_severity", S.BASE_FB + """
SELECT seq, predicted_severity, actual_severity FROM fb
WHERE predicted_severity = 'High' OR actual_severity = 'High'""")
def fb_filter_severity(spark, sf):
    return FB.search_feedback(_fb(spark, sf), severity="High").select(
        "seq", "predicted_severity", "actual_severity")


@register("fb_filter_rating", S.BASE_FB + """
SELECT seq, rating FROM fb WHERE CAST(rating AS VARCHAR) = '4'""")
def fb_filter_rating(spark, sf):
    return FB.search_feedback(_fb(spark, sf), rating="4").select("seq", "rating")


@register("fb_match_flag", S.BASE_FB + """
SELECT seq, predicted_severity = actual_severity AS severity_match FROM fb""")
def fb_match_flag(spark, sf):
    return FB.with_match(_fb(spark, sf)).select("seq", "severity_match")


@register("fb_latest_first", S.BASE_FB + """
SELECT seq, event_id FROM fb ORDER BY seq DESC""")
def fb_latest_first(spark, sf):
    return FB.latest_first(_fb(spark, sf)).select("seq", "event_id")


AVG_RATING = "CASE WHEN count(*) > 0 THEN " + XR("sum(rating) / count(*)", 2) + " ELSE 0.0 END"
ACC = ("CASE WHEN count(*) > 0 THEN " + XR("sum(CASE WHEN predicted_severity = actual_severity THEN 1 ELSE 0 END)"
                                          " / count(*) * 100.0::DOUBLE", 1) + " ELSE 0.0 END")
MAE = ("CASE WHEN count(*) > 0 THEN " + XR("sum(abs(predicted_duration - actual_duration)) / count(*)", 1)
       + " ELSE 0.0 END")

STATS_SQL = f"""
SELECT CAST(count(*) AS BIGINT) AS total_feedback_events,
       {AVG_RATING} AS average_rating,
       {ACC} AS severity_prediction_accuracy,
       {MAE} AS duration_mae_minutes,
       CAST(coalesce(sum(greatest(0, recommended_officers - actual_officers)), 0) AS BIGINT)
         AS manpower_savings_count
FROM fb"""


@register("feedback_stats", S.BASE_FB + STATS_SQL)
def feedback_stats(spark, sf):
    return FB.feedback_stats(_fb(spark, sf))


@register("fb_total", S.BASE_FB + "\nSELECT CAST(count(*) AS BIGINT) AS total_feedback_events FROM fb")
def fb_total(spark, sf):
    return FB.feedback_stats(_fb(spark, sf)).select("total_feedback_events")


@register("fb_avg_rating", S.BASE_FB + f"\nSELECT {AVG_RATING} AS average_rating FROM fb")
def fb_avg_rating(spark, sf):
    return FB.feedback_stats(_fb(spark, sf)).select("average_rating")


@register("fb_severity_accuracy", S.BASE_FB + f"\nSELECT {ACC} AS severity_prediction_accuracy FROM fb")
def fb_severity_accuracy(spark, sf):
    return FB.feedback_stats(_fb(spark, sf)).select("severity_prediction_accuracy")


@register("fb_duration_mae", S.BASE_FB + f"\nSELECT {MAE} AS duration_mae_minutes FROM fb")
def fb_duration_mae(spark, sf):
    return FB.feedback_stats(_fb(spark, sf)).select("duration_mae_minutes")


@register("fb_manpower_saved", S.BASE_FB + """
SELECT CAST(coalesce(sum(greatest(0, recommended_officers - actual_officers)), 0) AS BIGINT)
         AS manpower_savings_count FROM fb""")
def fb_manpower_saved(spark, sf):
    return FB.feedback_stats(_fb(spark, sf)).select("manpower_savings_count")


@register("learning_curve", S.BASE_FB + """
, w AS (
  SELECT count(*) OVER o AS n,
         sum(CASE WHEN predicted_severity = actual_severity THEN 1 ELSE 0 END) OVER o AS hits,
         sum(abs(predicted_duration - actual_duration)) OVER o AS err
  FROM fb WINDOW o AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(n AS BIGINT) AS event_count, """ + XR("hits / n * 100.0::DOUBLE", 1) + """ AS accuracy,
       """ + XR("err / n", 1) + """ AS mae FROM w WHERE n >= 5""")
def learning_curve(spark, sf):
    return FB.learning_curve(_fb(spark, sf))


@register("compare_label", S.BASE_FB + """
SELECT seq,
  regexp_replace(CAST(predicted_duration AS VARCHAR), '\\.0$', '') || 'm / ' ||
    regexp_replace(CAST(actual_duration AS VARCHAR), '\\.0$', '') || 'm' AS duration_label,
  CAST(recommended_officers AS VARCHAR) || ' / ' || CAST(actual_officers AS VARCHAR) AS officers_label,
  CAST(recommended_barricades AS VARCHAR) || ' / ' || CAST(actual_barricades AS VARCHAR) AS barricades_label,
  upper(diversion_effective) AS diversion_flag FROM fb""")
def compare_label(spark, sf):
    fb = _fb(spark, sf)
    return fb.select("seq",
                     TX.compare_label("predicted_duration", "actual_duration", "m").alias("duration_label"),
                     TX.compare_label("recommended_officers", "actual_officers").alias("officers_label"),
                     TX.compare_label("recommended_barricades", "actual_barricades").alias("barricades_label"),
                     F.upper("diversion_effective").alias("diversion_flag"))


def _union(spark, sf):
    inc = fx.incidents(spark, sf)
    return FB.training_union(train_table(inc), fx.feedback_from_incidents(inc))


@register("training_union", S.BASE_TU + """
SELECT is_feedback, row_key, event_type, event_cause, police_station, hour, congestion_severity, weight FROM tu""")
def training_union(spark, sf):
    u = _union(spark, sf)
    key = F.when(F.col("is_feedback"), F.col("seq")).otherwise(F.col("incident_id"))
    return u.select("is_feedback", key.alias("row_key"), "event_type", "event_cause", "police_station",
                    "hour", "congestion_severity", "weight")


@register("provenance_weight", S.BASE_TU + """
SELECT is_feedback, count(*) AS n, sum(weight) AS total_weight FROM tu GROUP BY 1""")
def provenance_weight(spark, sf):
    return _union(spark, sf).groupBy("is_feedback").agg(F.count(F.lit(1)).alias("n"),
                                                        F.sum("weight").alias("total_weight"))


@register("label_support", S.BASE_TU + """
, c AS (SELECT congestion_severity, count(*) AS n FROM tu GROUP BY 1)
SELECT congestion_severity, n, min(n) OVER () >= 2 AS all_supported FROM c""")
def label_support(spark, sf):
    from ..operators.learn import label_support as ls
    return ls(_union(spark, sf), "congestion_severity")


BASE_FORMS = S.with_ctes(S.INC, S.FILLED, S.TRAIN, S.REQ, S.FC)


@register("fb_defaults_from_prediction", BASE_FORMS + f"""
SELECT request_id, predicted_severity AS actual_severity,
       CAST({XR("predicted_duration_minutes", 0, "up")} AS BIGINT) AS actual_duration,
       CAST({S.plan_int('predicted_severity', 1)} AS INTEGER) AS actual_officers,
       CAST({S.plan_int('predicted_severity', 2)} AS INTEGER) AS actual_barricades, 3 AS rating FROM fc""")
def fb_defaults_from_prediction(spark, sf):
    """Open closure forms pre-filled from each request's forecast."""
    inc = fx.incidents(spark, sf)
    forms = P.attach_plan(P.with_forecast(fx.requests_from_incidents(inc), train_table(inc)))
    forms = forms.select("request_id", "predicted_severity", "predicted_duration_minutes",
                         F.col("officers").alias("recommended_headcount"),
                         F.col("barricades").alias("barricade_count"))
    return FB.prefill_closure(forms).select("request_id", "actual_severity", "actual_duration",
                                            "actual_officers", "actual_barricades", "rating")


def _with_features(spark, sf):
    """Every ledger row; old rows without feature fields get the defaults."""
    return FB.feedback_defaults(_fb(spark, sf))


@register("attribution", S.BASE_ATTR + "\n" + " UNION ALL ".join(
    f"SELECT seq, '{f}' AS factor, a_{f} AS contribution, "
    f"CAST({XR(f'a_{f} / tot * 100.0::DOUBLE', 0, 'up')} AS INTEGER) AS percent, "
    f"{XR(f'a_{f} / tot * dur', 1, 'up')} AS minutes FROM a5" for f in AT.FACTORS))
def attribution(spark, sf):
    """Five factor contributions per ledger forecast, long form."""
    return AT.attribution_long(_with_features(spark, sf), "seq", "predicted_duration")


@register("attribution_score", S.BASE_ATTR + """
SELECT seq, c_val, round(display_score, 6) AS display_score, display_severity FROM a5""")
def attribution_score(spark, sf):
    df = AT.with_display_score(_with_features(spark, sf))
    return df.select("seq", "c_val", r6("display_score").alias("display_score"), "display_severity")


def _fx1(c: str) -> str:
    return f"printf('%.1f', {XR(c, 1, 'up')})"


@register("attribution_label", S.BASE_ATTR + f"""
SELECT seq,
  'Congestion Score = ' || {_fx1('c_val')} || ' (Cause: ' || {S.title_sql('event_cause')} || ') × ' ||
  {_fx1('p_mult')} || ' (Priority: ' || priority || ') × ' || {_fx1('cl_mult')} || ' (Closure) × ' ||
  {_fx1('corr_mult')} || ' (Corridor) × ' || {_fx1('peak_mult')} || ' (Peak Hour) = ' ||
  printf('%.2f', {XR('display_score', 2, 'up')}) || ' (' || display_severity || ')' AS formula,
  'Incident Cause Base weight (' || {S.title_sql('event_cause')} || '): +' || {_fx1('a_cause / tot * dur')} || ' min'
    AS label_cause,
  'Temporal Commute surcharge (' || CAST(hour AS VARCHAR) || ':00 ' ||
    CASE WHEN pk THEN 'Peak Hour' ELSE 'Off-Peak' END || '): +' || {_fx1('a_peak / tot * dur')} || ' min'
    AS label_peak,
  'Segment Closure impact (' || CASE WHEN cl THEN 'Full Block active' ELSE 'No blockage' END || '): +' ||
    {_fx1('a_closure / tot * dur')} || ' min' AS label_closure,
  'Priority level multiplier (' || priority || ' Priority): +' || {_fx1('a_priority / tot * dur')} || ' min'
    AS label_priority,
  'Snapping Corridor multiplier (' || corridor || '): +' || {_fx1('a_corridor / tot * dur')} || ' min'
    AS label_corridor
FROM a5""")
def attribution_label(spark, sf):
    df = AT.with_display_score(_with_features(spark, sf))
    df = AT.with_factor_labels(df.withColumn("formula", AT.formula_text(F.col("event_cause"), F.col("priority"))),
                               "predicted_duration")
    return df.select("seq", "formula", "label_cause", "label_peak", "label_closure", "label_priority",
                     "label_corridor")
