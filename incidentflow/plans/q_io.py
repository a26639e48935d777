"""Registered queries: sources, sinks and streaming (survey A2-A4, A6, J1-J3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import geo as GEO
from ..operators import learn as L
from ..operators.features import train_table
from ..session import work_path
from ..sources import fixtures as fx
from ..sources import readers as R
from ..sources import writers as W
from ..streaming import ingest as ST
from . import sqlbase as S
from .q_clean import FB_COLS, INC_COLS
from .q_feedback import STATS_SQL
from .registry import register, ts_text


@register("load_dims", S.BASE_GEO + """
SELECT name, lat, lng FROM sdim""")
def load_dims(spark, sf):
    """Station centroids written as JSON lines, then loaded back (A4 + A3)."""
    path = work_path(spark, "station_coords")
    W.write_dim(GEO.station_centroids(train_table(fx.incidents(spark, sf))), path, fmt="json")
    return R.read_dim(spark, path)


@register("write_dims", S.BASE_GEO + """
SELECT name, lat, lng FROM jdim""")
def write_dims(spark, sf):
    """Junction centroids written as Parquet and read back (A4)."""
    path = work_path(spark, "junction_coords")
    W.write_dim(GEO.junction_centroids(train_table(fx.incidents(spark, sf))), path)
    return R.read_dim(spark, path)


@register("scan_feedback_json", S.BASE_FB + f"""
SELECT {FB_COLS}, {S.ts_text('"timestamp"')} AS "timestamp" FROM fb""")
def scan_feedback_json(spark, sf):
    """The ledger exported as JSON lines and scanned back with the ledger reader (A2)."""
    path = work_path(spark, "ledger_json")
    W.write_ledger_json(fx.feedback(spark, sf), path)
    return R.read_feedback(spark, path).withColumn("timestamp", ts_text("timestamp"))


@register("append_feedback", S.BASE_FB + f"""
SELECT {FB_COLS}, {S.ts_text('"timestamp"')} AS "timestamp" FROM fb""")
def append_feedback(spark, sf):
    """The ledger appended in two batches (one replayed) and read back whole."""
    path = work_path(spark, "ledger")
    fb = fx.feedback(spark, sf)
    W.append_feedback(fb.filter(F.col("seq") % 8 == 0), path, batch_id=1)
    W.append_feedback(fb.filter(F.col("seq") % 8 != 0), path, batch_id=2)
    W.append_feedback(fb.filter(F.col("seq") % 8 != 0), path, batch_id=2)   # a retried append
    return R.read_feedback(spark, path).withColumn("timestamp", ts_text("timestamp"))


@register("append_feedback_unkeyed", S.BASE_FB + """
SELECT count(*) AS n, count(*) AS n_seq, 1 AS first_seq, count(*) AS last_seq FROM fb""")
def append_feedback_unkeyed(spark, sf):
    """Appends without ``seq``: two batches, one of them retried; positions are dense and unique."""
    path = work_path(spark, "ledger")
    fb = fx.feedback(spark, sf).repartition(5, "seq")
    for part, batch in ((F.col("seq") % 3 == 0, 1), (F.col("seq") % 3 != 0, 2), (F.col("seq") % 3 != 0, 2)):
        W.append_feedback(fb.filter(part).drop("seq"), path, batch_id=batch)
    return R.read_feedback(spark, path).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("n_seq"),
        F.min("seq").cast("int").alias("first_seq"), F.max("seq").alias("last_seq"))


@register("append_two_writers", S.BASE_FB + f"""
SELECT {FB_COLS}, {S.ts_text('"timestamp"')} AS "timestamp" FROM fb""")
def append_two_writers(spark, sf):
    """Two producers append batches of the same number; neither loses a row."""
    path = work_path(spark, "ledger")
    fb = fx.feedback(spark, sf)
    W.append_feedback(fb.filter(F.col("seq") % 2 == 0), path, batch_id=0, producer="a")
    W.append_feedback(fb.filter(F.col("seq") % 2 != 0), path, batch_id=0, producer="b")
    return R.read_feedback(spark, path).withColumn("timestamp", ts_text("timestamp"))


@register("append_indexed", S.BASE_FB + """
SELECT 4 AS batches, (SELECT count(*) FROM fb) AS n, (SELECT count(*) FROM fb) AS n_seq,
       (SELECT count(*) FROM fb) AS last_seq, 1 AS after_compaction, (SELECT count(*) FROM fb) AS rows_read""")
def append_indexed(spark, sf):
    """Appends without ``seq`` that read the ledger's index only; then compaction and a replay."""
    path = work_path(spark, "ledger")
    fb = fx.feedback(spark, sf)
    for batch in range(4):
        W.append_feedback(fb.filter(F.col("seq") % 4 == batch).drop("seq"), path, batch_id=batch)
    index = W.ledger_index(spark, path).agg(F.count(F.lit(1)).cast("int").alias("batches"), F.sum("n").alias("n"))
    read = R.read_feedback(spark, path).agg(F.countDistinct("seq").alias("n_seq"), F.max("seq").alias("last_seq"))
    before = index.crossJoin(read).first()                       # one row each
    W.compact_ledger(spark, path)
    W.append_feedback(fb.filter(F.col("seq") % 4 == 3).drop("seq"), path, batch_id=3)      # a replay after it
    after = R.read_feedback(spark, path).agg(F.count(F.lit(1)).alias("rows_read"))
    count = W.ledger_index(spark, path).count()
    return after.select(*[F.lit(before[c]).alias(c) for c in ("batches", "n", "n_seq", "last_seq")],
                        F.lit(count).alias("after_compaction"), "rows_read")


@register("scan_incidents_csv", S.BASE_INC + f"""
SELECT {INC_COLS}, {S.ts_text('start_datetime')} AS start_datetime,
       {S.ts_text('closed_datetime')} AS closed_datetime FROM inc""")
def scan_incidents_csv(spark, sf):
    """The history as CSV with its columns in another order and one more, read by the header's names (A1)."""
    path = work_path(spark, "incidents_csv")
    inc = fx.incidents(spark, sf)
    (inc.select(F.lit("x").alias("remark"), *reversed(inc.columns)).withColumns(
        {"start_datetime": ts_text("start_datetime"), "closed_datetime": ts_text("closed_datetime")})
     .write.option("header", True).csv(path))
    return R.read_incidents(spark, path, fmt="csv").withColumns(
        {"start_datetime": ts_text("start_datetime"), "closed_datetime": ts_text("closed_datetime")})


def write_damaged_csv(inc, path):
    """The history as CSV lines, some cut short and some with a text for a latitude."""
    text = inc.withColumns({c: F.col(c).cast("string") for c in inc.columns}).withColumns(
        {"start_datetime": ts_text("start_datetime"), "closed_datetime": ts_text("closed_datetime")})
    text = text.withColumn("latitude", F.when(F.col("incident_id").cast("long") % 51 == 0, "north").otherwise(F.col("latitude")))
    line = F.to_csv(F.struct(*text.columns))
    line = F.when(F.col("incident_id").cast("long") % 50 == 0, F.concat("incident_id", F.lit(",cut"))).otherwise(line)
    (text.select(line.alias(",".join(text.columns))).write.option("header", True).option("sep", "\x01").option("quote", "\x02")
     .csv(path))


@register("scan_incidents_rejects", S.BASE_INC + """
SELECT incident_id, CASE WHEN incident_id % 50 = 0 THEN 'fields' ELSE 'values: latitude' END AS reason,
       (SELECT count(*) FROM inc) AS lines, (SELECT count(*) FROM inc WHERE incident_id % 50 <> 0) AS kept
FROM inc WHERE incident_id % 50 = 0 OR incident_id % 51 = 0""")
def scan_incidents_rejects(spark, sf):
    """A damaged CSV: what cannot be read lands in the side table with its reason, and is counted (A1)."""
    path = work_path(spark, "incidents_damaged")
    write_damaged_csv(fx.incidents(spark, sf), f"{path}/csv")
    rows, rejects, counts = R.read_incidents_checked(spark, f"{path}/csv", rejects_path=f"{path}/rejects")
    kept = rows.count()
    number = F.coalesce(F.get_json_object("record", "$.incident_id"), F.split("record", ",")[0]).cast("long")
    return rejects.select(number.alias("incident_id"), "reason", F.lit(counts.get["lines"]).alias("lines"),
                          F.lit(kept).cast("long").alias("kept"))


@register("scan_incidents_stored", S.BASE_SERVE + "\nSELECT incident_id, latitude, longitude FROM inc WHERE "
          "latitude > 12.8 AND latitude < 13.2 AND longitude > 77.4 AND longitude < 77.8")
def scan_incidents_stored(spark, sf):
    """The history stored by date and read back; the box reaches the Parquet scan."""
    path = work_path(spark, "incidents_by_day")
    W.write_incidents(fx.incidents(spark, sf), path)
    return C.in_bbox(R.read_incidents(spark, path)).select("incident_id", "latitude", "longitude")


def _closure_stream(spark, sf):
    nation = fx.table(spark, sf, "nation")
    return fx.feedback_from_incidents(fx.incidents_from_events(ST.events_stream(spark, sf), nation))


@register("stream_feedback", S.BASE_FB + f"""
SELECT {FB_COLS}, {S.ts_text('"timestamp"')} AS "timestamp" FROM fb""")
def stream_feedback(spark, sf):
    """Closures derived from the events file stream appended to a ledger; the
    ledger is read back after the stream drains."""
    ledger, ckpt = work_path(spark, "stream_ledger"), work_path(spark, "stream_ckpt")
    q = ST.start_ingest(_closure_stream(spark, sf), ledger, ckpt)
    q.awaitTermination()
    return R.read_feedback(spark, ledger).withColumn("timestamp", ts_text("timestamp"))


@register("stream_stats", S.BASE_FB + STATS_SQL)
def stream_stats(spark, sf):
    """Running ledger statistics from a streaming aggregate (equals D17)."""
    out, ckpt = work_path(spark, "stream_stats"), work_path(spark, "stream_stats_ckpt")
    q = ST.running_stats(_closure_stream(spark, sf), out, ckpt)
    q.awaitTermination()
    return spark.read.parquet(out)


@register("publish_stats", S.BASE_FB + STATS_SQL)
def publish_stats(spark, sf):
    """J2 by versions: each micro-batch publishes the statistics; the reader follows the pointer."""
    out, ckpt = work_path(spark, "published_stats"), work_path(spark, "published_stats_ckpt")
    ST.publish_stats(_closure_stream(spark, sf), out, ckpt).awaitTermination()
    return ST.read_stats(spark, out)


@register("stream_retrain")
def stream_retrain(spark, sf):
    """Each appended micro-batch triggers a refit on history plus the whole ledger."""
    ledger, ckpt = work_path(spark, "retrain_ledger"), work_path(spark, "retrain_ckpt")
    summaries = work_path(spark, "retrain_summaries")
    history = train_table(fx.incidents(spark, sf))

    def on_batch(batch_id):
        # keyed by the batch: a replayed batch replaces its summary
        L.retrain(history, R.read_feedback(spark, ledger)).write.mode("overwrite").parquet(
            f"{summaries}/batch_id={batch_id}")

    q = ST.start_ingest(_closure_stream(spark, sf), ledger, ckpt, on_batch=on_batch)
    q.awaitTermination()
    return spark.read.parquet(summaries)
