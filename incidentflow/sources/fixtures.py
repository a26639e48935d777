"""Incident, feedback and request tables derived from the shared test tables.

The original application's incident CSV is not available, so the history is
derived row by row from ``events`` (joined to ``nation`` for station names).
The rules are arithmetic that means the same in Spark and in any SQL engine,
so every derived table can be rebuilt independently for oracle checks.
Every row of ``events`` yields one incident: the work grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.clean import fill_defaults
from ..operators.features import is_peak, severity_expr, score_expr, cause_weight

# --- fixed values: cause cycle used by the fixture (index 13 -> NULL) --------
FIXTURE_CAUSES = ("accident", "protest", "procession", "public_event", "vip_movement",
                  "water_logging", "tree_fall", "construction", "pot_holes",
                  "road_conditions", "congestion", "vehicle_breakdown", "others")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def incidents_from_events(events: DataFrame, nation: DataFrame) -> DataFrame:
    """One incident per event; see FIXTURES.md section 3 for the rules."""
    eid, uid = F.col("event_id"), F.col("user_id")
    # ``props`` is parsed once in its own projection; referenced twice inside
    # CASE branches it would otherwise be parsed twice per row.
    events = events.withColumn("_k", F.get_json_object("props", "$.k").try_cast("int"))
    k = F.col("_k")
    lit = F.lit
    station_key = uid % 25
    # nation is a fixed 25-row dimension; the optimizer sees its file size and
    # broadcasts it under autoBroadcastJoinThreshold (else a sort-merge join).
    e = events.join(nation.select(F.col("n_nationkey").cast("long").alias("_nk"), "n_name"),
                    station_key == F.col("_nk"), "left")
    cause_idx = (eid * 7 + uid) % 14
    lat = (lit(127600) + station_key * 160 + (eid * 7919) % 600).cast("double") / lit(10000.0)
    lng = (lit(773800) + ((station_key * 7) % 25) * 160 + (eid * 104729) % 600).cast("double") / lit(10000.0)
    gap = F.make_dt_interval(secs=F.floor(F.col("value") * 600))
    return e.select(
        eid.alias("incident_id"),
        F.when(eid % 53 == 0, lit(None))
         .when(F.col("event_type").isin("purchase", "signup"), lit("planned"))
         .otherwise(lit("unplanned")).alias("event_type"),
        F.get(F.array(*[lit(c) for c in FIXTURE_CAUSES]), cause_idx.cast("int")).alias("event_cause"),
        F.when(eid % 10 == 0, lit(None)).when(F.col("value") >= 60, lit("High"))
         .otherwise(lit("Low")).alias("priority"),
        F.when(eid % 11 == 0, lit(None)).otherwise(eid % 5 == 0).alias("requires_road_closure"),
        F.when(uid % 9 == 8, lit(None))
         .otherwise(F.concat(lit("Corridor "), (uid % 9).cast("string"))).alias("corridor"),
        F.when(uid % 37 == 0, lit(None)).otherwise(F.col("n_name")).alias("police_station"),
        F.when(k % 10 == 9, lit(None))
         .otherwise(F.concat(lit("Junc"), (station_key * 4 + k % 4).cast("string"))).alias("junction"),
        F.when(eid % 41 == 0, lit(None).cast("double")).when(eid % 211 == 0, lit(0.0))
         .otherwise(lat).alias("latitude"),
        lng.alias("longitude"),
        F.when(eid % 97 == 0, lit(None)).otherwise(F.col("ts")).alias("start_datetime"),
        F.when(eid % 13 == 0, lit(None))
         .when(eid % 101 == 0, F.col("ts") - F.expr("INTERVAL 1 HOUR"))
         .otherwise(F.col("ts") + gap).alias("closed_datetime"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents_from_events(table(spark, sf_dir, "events"), table(spark, sf_dir, "nation"))


def feedback_from_incidents(inc: DataFrame) -> DataFrame:
    """A closure ledger: every incident with a start; see FIXTURES.md section 4."""
    lit = F.lit
    f = fill_defaults(inc).filter(F.col("start_datetime").isNotNull())
    iid = F.col("incident_id")
    hour = F.hour("start_datetime")
    f = f.withColumn("_score", score_expr(cause_weight(F.col("event_cause")), F.col("priority"),
                                          F.col("requires_road_closure"), F.col("corridor"), is_peak(hour)))
    f = f.select("*", severity_expr(F.col("_score")).alias("_pred"), hour.alias("_hour"),
                 F.weekday("start_datetime").alias("_dow")).drop("_score")
    up = (F.when(F.col("_pred") == "Low", lit("Medium")).when(F.col("_pred") == "Medium", lit("High"))
          .otherwise(lit("Critical")))
    pred_dur = (lit(30) + (iid * 8) % 120).cast("double")
    from ..operators.prescribe import plan_columns
    plan = plan_columns(F.col("_pred"))
    rec_off, rec_bar = plan["officers"], plan["barricades"]
    rating = (lit(1) + (iid * 7) % 5).cast("int")
    old = iid % 20 == 0     # the oldest rows carry no feature fields

    def feat(c, name):
        return F.when(old, lit(None)).otherwise(c).alias(name)

    return f.select(
        iid.alias("seq"),
        F.concat(lit("EVT-"), iid.cast("string")).alias("event_id"),
        F.col("event_cause"),
        F.col("_pred").alias("predicted_severity"),
        pred_dur.alias("predicted_duration"),
        F.when(iid % 12 == 0, up).otherwise(F.col("_pred")).alias("actual_severity"),
        F.greatest(lit(15.0), pred_dur + ((iid * 13) % 41 - 20).cast("double")).alias("actual_duration"),
        rec_off.cast("int").alias("recommended_officers"),
        F.greatest(lit(1), rec_off + (iid * 3) % 5 - 2).cast("int").alias("actual_officers"),
        rec_bar.cast("int").alias("recommended_barricades"),
        F.greatest(lit(0), rec_bar + (iid * 7) % 5 - 2).cast("int").alias("actual_barricades"),
        F.when(rating >= 3, lit("yes")).otherwise(lit("no")).alias("diversion_effective"),
        rating.alias("rating"),
        F.col("start_datetime").alias("timestamp"),
        feat(F.col("event_type"), "event_type"),
        feat(F.col("requires_road_closure"), "requires_road_closure"),
        feat(F.col("priority"), "priority"),
        feat(F.col("corridor"), "corridor"),
        feat(F.col("police_station"), "police_station"),
        feat(F.col("_hour"), "hour"),
        feat(F.col("_dow"), "day_of_week"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback_from_incidents(incidents(spark, sf_dir))


def requests_from_incidents(inc: DataFrame) -> DataFrame:
    """Prediction requests: cleaned incidents with a position and a start time."""
    f = fill_defaults(inc).filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
                                  & F.col("start_datetime").isNotNull())
    return f.select(
        F.col("incident_id").alias("request_id"), "event_type", "event_cause",
        "requires_road_closure", "priority", "corridor", "police_station",
        "latitude", "longitude",
        F.hour("start_datetime").alias("hour"), F.weekday("start_datetime").alias("day_of_week"),
        (F.col("latitude") + F.lit(K.DEST_OFFSET[0])).alias("dest_lat"),
        (F.col("longitude") + F.lit(K.DEST_OFFSET[1])).alias("dest_lng"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from_incidents(incidents(spark, sf_dir))
