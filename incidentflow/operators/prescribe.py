"""Scoring and prescription for tables of requests (survey C4, E2, I7-I12, B24, D19, H6, H7, H13)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geomath as G
from ..functions import text as TX
from ..functions.numeric import py_round
from .clean import cap_duration, drop_missing, with_duration
from .features import cause_weight, is_peak, score_expr, severity_expr
from .dims import join_dim, materialise
from .geo import junction_centroids, suggest_junctions


def _case(sev: Column, idx: int) -> Column:
    expr = None
    for row in K.RESOURCE_PLAN:
        expr = (F.when(sev == row[0], F.lit(row[idx])) if expr is None
                else expr.when(sev == row[0], F.lit(row[idx])))
    fb = [r for r in K.RESOURCE_PLAN if r[0] == K.PLAN_FALLBACK][0]
    return expr.otherwise(F.lit(fb[idx]))


def plan_columns(sev: Column) -> dict:
    """Resource plan of a severity; anything unlisted gets the Critical plan (C4, I8).

    The four-row plan is compiled into CASE expressions: no join, no shuffle,
    and the lookup stays inside whole-stage code generation.
    """
    return {
        "officers": _case(sev, 1).cast("int"),
        "barricades": _case(sev, 2).cast("int"),
        "diversion_required": _case(sev, 3).cast("boolean"),
        "barricade_description": _case(sev, 4),
        "diversion_description": _case(sev, 5),
    }


def attach_plan(df: DataFrame, sev: str = "predicted_severity") -> DataFrame:
    return df.withColumns(plan_columns(F.col(sev)))


def scope_text(sev: Column) -> Column:
    """Action scope text of a severity, case-insensitive."""
    s = F.lower(sev)
    expr = None
    for level, text in K.SCOPE_TEXT.items():
        cond = s == level.lower()
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return expr.otherwise(F.lit(K.SCOPE_DEFAULT))


def role_split(n: Column) -> dict:
    """core = max(1, n div 2), guides = max(1, n div 3), patrols = max(0, n - n div 2 - n div 3)."""
    half, third = F.floor(n / F.lit(2)), F.floor(n / F.lit(3))
    return {
        "core_junction_control": F.greatest(F.lit(1), half).cast("int"),
        "upstream_diversion_guides": F.greatest(F.lit(1), third).cast("int"),
        "mobile_incident_patrols": F.greatest(F.lit(0), n - half - third).cast("int"),
    }


def calibrate_raw(duration: Column, cause: Column) -> Column:
    """Per-cause cap of implausible forecasts, before rounding."""
    c = F.lower(cause)
    d = duration.cast("double")
    expr = None
    for name, thr, base, mod in K.CALIBRATION:
        cond = (c == name) & (d > thr)
        val = F.lit(base) + d % F.lit(mod)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(d)


def finish_duration(raw: Column) -> Column:
    """max(10, round(raw, 1)) with Python's rounding."""
    return F.greatest(F.lit(K.MIN_DURATION), py_round(raw, 1))


def calibrate(duration: Column, cause: Column) -> Column:
    """Cap implausible forecasts per cause, then max(10, round 1 dp)."""
    return finish_duration(calibrate_raw(duration, cause))


def rule_score(df: DataFrame) -> Column:
    return score_expr(cause_weight(F.col("event_cause")), F.col("priority"),
                      F.col("requires_road_closure"), F.col("corridor"), is_peak(F.col("hour")))


def rule_severity(df: DataFrame) -> Column:
    """Severity of a request by the scoring rule (exact path; the forest is optional)."""
    return severity_expr(rule_score(df))


def with_rule_severity(df: DataFrame) -> DataFrame:
    """``predicted_severity`` with the score staged in its own projection, so the
    three threshold tests read a column instead of recomputing the score."""
    df = df.withColumn("_rule_score", rule_score(df))
    return df.withColumn("predicted_severity", severity_expr(F.col("_rule_score"))).drop("_rule_score")


def duration_baseline(train: DataFrame) -> DataFrame:
    """Mean observed duration per (cause, severity) over the capped history.

    This is the exact, model-free duration forecast used by the rule path.
    """
    d = cap_duration(with_duration(drop_missing(train, ["closed_datetime"])))
    return (d.groupBy("event_cause", F.col("congestion_severity").alias("predicted_severity"))
            .agg(F.avg("duration_min").alias("_base_duration")))


def with_forecast(requests: DataFrame, train: DataFrame) -> DataFrame:
    """predicted_severity (rule) and calibrated predicted_duration_minutes."""
    df = with_rule_severity(requests)
    base = materialise(duration_baseline(train), "duration_baseline")
    df = join_dim(df, base, ["event_cause", "predicted_severity"])
    raw = F.coalesce(F.col("_base_duration"), F.lit(K.FALLBACK_DURATION))
    df = df.withColumn("_cal_raw", calibrate_raw(raw, F.col("event_cause")))   # staged before rounding
    return (df.withColumn("predicted_duration_minutes", finish_duration(F.col("_cal_raw")))
            .drop("_base_duration", "_cal_raw"))


def offset_angle(key: Column, i: int) -> Column:
    """i*pi plus a stable pseudo-random fraction of 0.5 rad derived from the key."""
    u = TX.hex8_int(F.concat(key.cast("string"), F.lit(f"-{i}"))).cast("double") / F.lit(4294967296.0)
    return F.lit(i * math.pi) + u * F.lit(0.5)


def diversion_point(df: DataFrame, i: int, junctions: DataFrame) -> DataFrame:
    """Point i (0-based) of the suggestion list: centroid if known, else an offset."""
    name = F.element_at(F.col("suggested_junctions"), i + 1)
    p = f"p{i + 1}"
    dim = junctions.select(F.col("name").alias(f"{p}_name"), F.col("lat").alias("_jlat"),
                           F.col("lng").alias("_jlng"))
    df = join_dim(df.withColumn(f"{p}_name", name), dim, f"{p}_name")
    dist = F.lit(K.OFFSET_BASE_DIST + i * K.OFFSET_STEP_DIST)
    olat, olng = G.polar_offset(F.col("latitude"), F.col("longitude"),
                                offset_angle(F.col("request_id"), i), dist)
    known = F.col("_jlat").isNotNull() & F.col("_jlng").isNotNull()
    role = F.concat(F.lit(f"Diversion Point {i + 1} - Reroute target"),
                    F.when(known, F.concat(F.lit(" ("), F.col(f"{p}_name"), F.lit(" centroid)")))
                    .otherwise(F.lit(" (Estimated offset)")))
    present = F.col(f"{p}_name").isNotNull()
    return (df.withColumn(f"{p}_lat", F.when(present, F.when(known, F.col("_jlat")).otherwise(olat)))
            .withColumn(f"{p}_lng", F.when(present, F.when(known, F.col("_jlng")).otherwise(olng)))
            .withColumn(f"{p}_role", F.when(present, role))
            .drop("_jlat", "_jlng"))


def blueprint_flat(requests: DataFrame, serve: DataFrame, train: DataFrame) -> DataFrame:
    """The whole mitigation plan per request as flat columns.

    One pass over the requests: the forecast, the plan and the roles are column
    expressions; the suggestion arrays and centroids are pre-aggregated
    dimensions joined by key.
    """
    df = with_forecast(requests, train)
    df = attach_plan(df)
    df = suggest_junctions(df, serve)
    jdim = materialise(junction_centroids(train), "junction_centroids")
    for i in range(2):
        df = diversion_point(df, i, jdim)
    return _blueprint_select(df)


def _blueprint_select(df: DataFrame) -> DataFrame:
    roles = role_split(F.col("officers"))
    return df.select(
        "request_id",
        TX.event_key(F.col("request_id")).alias("event_id"),
        "predicted_severity", "predicted_duration_minutes",
        F.col("officers").alias("recommended_headcount"),
        *[v.alias(k) for k, v in roles.items()],
        F.col("police_station").alias("police_station_in_charge"),
        F.col("barricades").alias("barricade_count"),
        F.col("barricade_description").alias("setup_description"),
        "diversion_required",
        F.slice("suggested_junctions", 1, 3).alias("recommended_junctions"),
        "diversion_description",
        "p1_name", "p1_lat", "p1_lng", "p1_role", "p2_name", "p2_lat", "p2_lng", "p2_role",
        "latitude", "longitude", "dest_lat", "dest_lng", "junction_source",
    )


def blueprint_struct(flat: DataFrame) -> DataFrame:
    """Nested plan per request in the response shape."""
    def point(p):
        return F.struct(F.col(f"{p}_name").alias("name"), F.col(f"{p}_lat").alias("lat"),
                        F.col(f"{p}_lng").alias("lng"), F.col(f"{p}_role").alias("role"))
    points = F.filter(F.array(point("p1"), point("p2")), lambda x: x["name"].isNotNull())
    return flat.select(
        "request_id",
        F.struct(
            "event_id", "predicted_severity", "predicted_duration_minutes",
            F.struct("recommended_headcount",
                     F.struct("core_junction_control", "upstream_diversion_guides",
                              "mobile_incident_patrols").alias("role_distribution"),
                     "police_station_in_charge").alias("manpower"),
            F.struct(F.col("barricade_count").alias("recommended_count"),
                     "setup_description").alias("barricading"),
            F.struct(F.col("diversion_required").alias("required"), "recommended_junctions",
                     F.col("diversion_description").alias("description"),
                     points.alias("map_points")).alias("diversion"),
        ).alias("blueprint"))


def junction_headcount(n: Column):
    """ceil(0.6 n) at the primary and floor(0.4 n) at the secondary junction."""
    return (F.ceil(n * F.lit(K.PRIMARY_SHARE)).cast("int"),
            F.floor(n * F.lit(K.SECONDARY_SHARE)).cast("int"))


def map_extent(flat: DataFrame) -> DataFrame:
    """Padded bounds of source, destination and diversion points (D19), rows needing a detour."""
    lat0, lng0, lat1, lng1 = G.padded_extent(
        [F.col("latitude"), F.col("dest_lat"), F.col("p1_lat"), F.col("p2_lat")],
        [F.col("longitude"), F.col("dest_lng"), F.col("p1_lng"), F.col("p2_lng")])
    return (flat.filter(F.col("diversion_required") & F.col("p1_name").isNotNull())
            .select("request_id", lat0.alias("south"), lng0.alias("west"),
                    lat1.alias("north"), lng1.alias("east")))


def diversion_routes(flat: DataFrame) -> DataFrame:
    """Curved paths of the primary and the alternative route, rows needing a detour.

    Source -> waypoint -> first diversion point, and source -> opposite waypoint -> second one where
    there is a second one.
    """
    routes = []
    for name, side, p in (("primary", 1, "p1"), ("alternative", -1, "p2")):
        lat, lng = G.detour_waypoint("latitude", "longitude", "dest_lat", "dest_lng", side)
        routes.append(F.struct(F.lit(name).alias("route"), lat.alias("w_lat"), lng.alias("w_lng"),
                               F.col(f"{p}_name").alias("to"), F.col(f"{p}_lat").alias("to_lat"),
                               F.col(f"{p}_lng").alias("to_lng")))
    legs = (flat.filter(F.col("diversion_required") & F.col("p1_name").isNotNull())
            .select("request_id", "latitude", "longitude", F.explode(F.array(*routes)).alias("r"))
            .filter(F.col("r.to").isNotNull())
            .select("request_id", "latitude", "longitude", "r.*"))
    return G.curve_rows(legs, ["request_id", "route"], [("latitude", "longitude", "w_lat", "w_lng"),
                                                        ("w_lat", "w_lng", "to_lat", "to_lng")])


# --- one pass over the history for every dimension the blueprint needs ------

def history_dims(incidents: DataFrame) -> DataFrame:
    """All blueprint dimensions from ONE scan and ONE shuffle of the history.

    Each history row emits up to four keyed entries:
      ``st`` (station, junction) and ``co`` (corridor, junction) counts over the
      tight-box history; ``jc`` (junction) integer micro-degree sums over the
      wide-box training rows; ``du`` (cause, severity) duration sums over the
      capped durations. One partial/final aggregate on (kind, k1, k2) reduces
      them; the result (bounded by the number of distinct keys) is written once
      to the shared folder and every dimension is a filter of it.
    """
    from .clean import coerce_coords, fill_defaults, bbox_predicate, duration_minutes
    from .features import with_time_features, with_score, with_severity
    from .dims import materialise
    f = with_severity(with_score(with_time_features(coerce_coords(fill_defaults(incidents)))))
    has_xy = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    started = F.col("start_datetime").isNotNull()
    serve = has_xy & F.coalesce(bbox_predicate(K.TIGHT_BOX), F.lit(False))
    wide = started & has_xy & F.coalesce(bbox_predicate(K.WIDE_BOX), F.lit(False))
    has_j = F.col("junction").isNotNull()
    dur = duration_minutes()
    dur_ok = started & F.col("closed_datetime").isNotNull() & (dur > 0) & (dur < K.DURATION_CAP_MIN)
    micro = lambda c: F.round(F.col(c) * F.lit(1e6)).cast("long")
    nul_d, nul_l = F.lit(None).cast("double"), F.lit(None).cast("long")

    def entry(kind, keep, k1, k2, a=nul_d, m1=nul_l, m2=nul_l):
        return F.struct(F.lit(kind).alias("kind"), keep.alias("keep"), k1.cast("string").alias("k1"),
                        k2.cast("string").alias("k2"), a.alias("a"), m1.alias("m1"), m2.alias("m2"))

    entries = F.array(
        entry("st", serve & has_j, F.col("police_station"), F.col("junction")),
        entry("co", serve & has_j, F.col("corridor"), F.col("junction")),
        entry("jc", wide & has_j, F.col("junction"), F.lit(None), m1=micro("latitude"), m2=micro("longitude")),
        entry("du", dur_ok, F.col("event_cause"), F.col("congestion_severity"), a=dur),
    )
    # exploded whole and filtered as rows: an array filter by a lambda is interpreted row by row
    keyed = f.select(F.explode(entries).alias("e")).filter("e.keep").select("e.kind", "e.k1", "e.k2", "e.a", "e.m1", "e.m2")
    agg = keyed.groupBy("kind", "k1", "k2").agg(
        F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("m1").alias("m1"), F.sum("m2").alias("m2"))
    return materialise(agg, "history_dims")


def dims_junction_centroids(d: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    return d.filter(F.col("kind") == "jc").select(
        F.col("k1").alias("name"), (F.col("m1").cast("double") / n / F.lit(1e6)).alias("lat"),
        (F.col("m2").cast("double") / n / F.lit(1e6)).alias("lng"))


def dims_duration_baseline(d: DataFrame) -> DataFrame:
    return d.filter(F.col("kind") == "du").select(
        F.col("k1").alias("event_cause"), F.col("k2").alias("predicted_severity"),
        (F.col("a") / F.col("n").cast("double")).alias("_base_duration"))


def dims_ranked(d: DataFrame, k: int = 3) -> DataFrame:
    """(kind, k1, arr): the k most frequent junctions per station (``st``) and per
    corridor (``co``) in one window over the small dimension table, written once."""
    from pyspark.sql import Window
    from .dims import materialise
    c = d.filter(F.col("kind").isin("st", "co")).select("kind", "k1", F.col("k2").alias("junction"), "n")
    w = Window.partitionBy("kind", "k1").orderBy(F.desc("n"), F.asc("junction"))
    top = c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    arr = (top.groupBy("kind", "k1").agg(F.array_sort(F.collect_list(F.struct("rank", "junction"))).alias("_r"))
           .select("kind", "k1", F.transform("_r", lambda x: x["junction"]).alias("arr")))
    return materialise(arr, "history_ranked")


def dims_top_arrays(ranked: DataFrame, kind: str, key: str, name: str) -> DataFrame:
    return ranked.filter(F.col("kind") == kind).select(F.col("k1").alias(key), F.col("arr").alias(name))


def blueprint_from_history(requests: DataFrame, incidents: DataFrame, k: int = 3, models=None) -> DataFrame:
    """``blueprint_flat`` with every dimension taken from one pass over the history.

    ``models`` = (vocab, severity model, duration model) as returned by
    ``learn.load_models`` switches the forecast from the exact rule path to the
    model path: the forests' severity label and raw duration, then the same
    calibration, plan, junction suggestions and points.
    """
    d = history_dims(incidents)
    if models is None:
        df = with_rule_severity(requests)
        df = join_dim(df, dims_duration_baseline(d), ["event_cause", "predicted_severity"])
    else:
        from .learn import predict_requests
        vocab, sev_model, dur_model = models
        pred = predict_requests(requests, vocab, sev_model, dur_model)
        df = pred.select(*requests.columns, F.col("model_severity").alias("predicted_severity"),
                         F.col("model_duration").cast("double").alias("_base_duration"))
    raw = F.coalesce(F.col("_base_duration"), F.lit(K.FALLBACK_DURATION))
    df = df.withColumn("_cal_raw", calibrate_raw(raw, F.col("event_cause")))
    df = (df.withColumn("predicted_duration_minutes", finish_duration(F.col("_cal_raw")))
          .drop("_base_duration", "_cal_raw"))
    df = attach_plan(df)
    ranked = dims_ranked(d, k)
    st = dims_top_arrays(ranked, "st", "police_station", "_st")
    co = dims_top_arrays(ranked, "co", "corridor", "_co")
    df = join_dim(join_dim(df, st, "police_station"), co, "corridor")
    fallback = F.array(*[F.lit(j) for j in K.FALLBACK_JUNCTIONS])
    source = (F.when(F.col("_st").isNotNull(), F.lit("station"))
              .when(F.col("_co").isNotNull(), F.lit("corridor")).otherwise(F.lit("default")))
    df = (df.withColumn("suggested_junctions", F.coalesce("_st", "_co", fallback))
          .withColumn("junction_source", source).drop("_st", "_co"))
    jdim = dims_junction_centroids(d)
    for i in range(2):
        df = diversion_point(df, i, jdim)
    return _blueprint_select(df)
