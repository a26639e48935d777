"""Descriptive analytics of the cleaned history (survey D1-D7, D18, D21, D22, C5, F1-F4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import js_fixed, py_round


def value_counts(df: DataFrame, col: str, k: int | None = None, name: str = "n",
                 dropna: bool = True) -> DataFrame:
    """Count per value; with ``k`` the k largest (count desc, then value asc).

    The aggregate is partial-then-final (map-side combine), so a hot value costs
    one row per partition in the shuffle; top-k is a TakeOrderedAndProject.
    """
    src = df.filter(F.col(col).isNotNull()) if dropna else df
    out = src.groupBy(col).agg(F.count(F.lit(1)).alias(name))
    if k is not None:
        out = out.orderBy(F.desc(name), F.asc_nulls_last(col)).limit(k)
    return out


def with_share(counts: DataFrame, name: str = "n", share: str = "share_pct", digits: int = 1) -> DataFrame:
    """Share of the total in percent; the window runs over the (small) aggregated rows only."""
    total = F.sum(name).over(Window.partitionBy())
    return counts.withColumn(share, js_fixed(F.col(name) * F.lit(100.0) / total, digits))


def hour_counts(df: DataFrame, ts: str = "start_datetime") -> DataFrame:
    """Count per hour of day; rows whose time does not parse are left out."""
    h = F.hour(F.expr(f"try_cast(`{ts}` AS TIMESTAMP_NTZ)"))
    return (df.select(h.alias("hour")).filter(F.col("hour").isNotNull())
            .groupBy("hour").agg(F.count(F.lit(1)).alias("n")))


def hour_distribution(df: DataFrame, ts: str = "start_datetime") -> DataFrame:
    """All 24 hours with zero for missing ones (D2 + C5).

    The 24-row hour axis is a fixed-size dimension; the counts side has at most
    24 rows after the partial/final aggregate, so the join is between two tiny sides.
    """
    spark = df.sparkSession
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = hour_counts(df, ts)
    # the counts side has at most 24 rows (hour of day): a proven bound
    return (hours.join(F.broadcast(counts), "hour", "left")
            .select("hour", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def closure_counts(df: DataFrame, col: str = "requires_road_closure") -> DataFrame:
    """Count per closure flag keyed by ``True`` / ``False`` text."""
    key = F.when(F.col(col), F.lit("True")).otherwise(F.lit("False"))
    return (df.select(key.alias("closure")).groupBy("closure")
            .agg(F.count(F.lit(1)).alias("n")))


def top_k_each(df: DataFrame, columns: dict[str, str], k: int = 1) -> DataFrame:
    """(kind, label, n, rank): the k most frequent labels of each of several text columns, from one scan.

    ``columns`` names a column for each kind. One aggregate over grouping sets counts all of them (partial, then
    final, one shuffle); the ranking keeps at most k rows of a kind in each partition before it exchanges
    them, so nothing that grows with the labels meets in one task. Ties go to the smallest label; nulls are
    not labels.
    """
    names = list(columns.values())
    sets = df.groupingSets([[c] for c in names], *names).agg(F.count(F.lit(1)).alias("n"),
                                                             *[F.grouping(c).alias(f"_not_{c}") for c in names])
    kind, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, c in columns.items():
        here = F.col(f"_not_{c}") == 0
        kind, label = F.when(here, F.lit(name)).otherwise(kind), F.when(here, F.col(c)).otherwise(label)
    counts = sets.select(kind.alias("kind"), label.alias("label"), "n").filter("label IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), F.asc("label")))
    return counts.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k)


def top_label(df: DataFrame, col: str) -> DataFrame:
    """The most frequent value (ties: smallest value) as one row."""
    return value_counts(df, col, k=1)


def peak_surge(df: DataFrame, ts: str = "start_datetime") -> DataFrame:
    """Mean count of the 8 peak hours over the mean of the 16 others."""
    hd = hour_distribution(df, ts)
    peak = F.col("hour").isin(*K.PEAK_HOURS)
    n_peak = len(K.PEAK_HOURS)
    agg = hd.agg(
        F.sum(F.when(peak, F.col("n")).otherwise(0)).alias("peak_n"),
        F.sum(F.when(~peak, F.col("n")).otherwise(0)).alias("off_n"),
    )
    ratio = F.try_divide(F.col("peak_n") / F.lit(float(n_peak)),
                         F.col("off_n") / F.lit(float(24 - n_peak)))
    return agg.select(F.col("peak_n").cast("long").alias("peak_n"),
                      F.col("off_n").cast("long").alias("off_n"),
                      py_round(ratio, 2).alias("surge_ratio"))


def sample_n(df: DataFrame, n: int = K.SAMPLE_SIZE, seed: int = K.SAMPLE_SEED,
             key: str = "incident_id") -> DataFrame:
    """Exactly min(n, N) rows chosen by a seeded hash order (F2).

    Reproducible on any partitioning: the order key is a pure function of the row key.
    Each partition keeps only its n best rows before the final merge.
    """
    order = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    return df.orderBy(order, F.col(key)).limit(n)


def analytics_long(serve: DataFrame) -> DataFrame:
    """The analytics summary in long form: (section, label, n) (D21 without the sample).

    One scan feeds every section through a single ``Expand`` + aggregate:
    grouping sets compute the five counts and the total in one shuffle.
    """
    closure = F.when(F.col("requires_road_closure"), F.lit("True")).otherwise(F.lit("False"))
    hour = F.hour(F.expr("try_cast(start_datetime AS TIMESTAMP_NTZ)")).cast("string")
    keyed = serve.select(
        F.explode(F.array(
            F.struct(F.lit("total").alias("section"), F.lit("all").alias("label")),
            F.struct(F.lit("cause").alias("section"), F.col("event_cause").alias("label")),
            F.struct(F.lit("hour").alias("section"), hour.alias("label")),
            F.struct(F.lit("priority").alias("section"), F.col("priority").alias("label")),
            F.struct(F.lit("closure").alias("section"), closure.alias("label")),
            F.struct(F.lit("station").alias("section"), F.col("police_station").alias("label")),
            F.struct(F.lit("corridor").alias("section"), F.col("corridor").alias("label")),
        )).alias("kv")).select("kv.section", "kv.label")
    counts = (keyed.filter(F.col("label").isNotNull())
              .groupBy("section", "label").agg(F.count(F.lit(1)).alias("n")))
    limits = {"cause": 10, "station": 8, "corridor": 8}
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), F.asc("label")))
    ranked = counts.withColumn("rank", rank)
    keep = F.lit(True)
    for sec, k in limits.items():
        keep = keep & ~((F.col("section") == sec) & (F.col("rank") > k))
    return ranked.filter(keep).drop("rank")


def marker_class(priority, closure):
    """(priority, closure) -> critical / high / medium / low map marker class."""
    high = priority == "High"
    cl = F.coalesce(closure, F.lit(False))
    return (F.when(high & cl, F.lit("critical")).when(high, F.lit("high"))
            .when(cl, F.lit("medium")).otherwise(F.lit("low")))


def cause_category(cause):
    """First matching substring of the lower-cased cause, else ``generic``."""
    c = F.lower(cause.cast("string"))
    expr = None
    for needle, cat in K.CAUSE_CATEGORIES:
        expr = (F.when(c.contains(needle), F.lit(cat)) if expr is None
                else expr.when(c.contains(needle), F.lit(cat)))
    return expr.otherwise(F.lit(K.CAUSE_CATEGORY_DEFAULT))


def analytics_document(serve: DataFrame, sample: int = K.SAMPLE_SIZE) -> DataFrame:
    """The analytics response as one row (D21): total, cause / priority / closure /
    station / corridor count maps, the 24-hour histogram and the map-point sample.

    Counts come from the one-shuffle long form; hours are zero-filled; the sample is
    the seeded top-n. The parts are stacked and folded by a single conditional
    aggregate (no join); the row is bounded by distinct labels plus ``sample``.
    """
    long = analytics_long(serve)
    hours = hour_distribution(serve).select(F.lit("hour").alias("section"),
                                            F.col("hour").cast("string").alias("label"), "n")
    counts = long.filter(F.col("section") != "hour").unionByName(hours)
    pts = sample_n(serve.select("incident_id", "latitude", "longitude", "event_cause", "priority",
                                "requires_road_closure"), sample)
    point_t = ("struct<latitude:double,longitude:double,event_cause:string,priority:string,"
               "requires_road_closure:boolean>")
    stacked = (counts.select("section", "label", "n", F.lit(None).cast(point_t).alias("point"))
               .unionByName(pts.select(F.lit("sample").alias("section"), F.lit(None).cast("string").alias("label"),
                                       F.lit(None).cast("long").alias("n"),
                                       F.struct("latitude", "longitude", "event_cause", "priority",
                                                "requires_road_closure").alias("point"))))

    def as_map(section, name):
        e = F.when(F.col("section") == section, F.struct("label", "n"))
        return F.map_from_entries(F.collect_list(e)).alias(name)

    return stacked.agg(
        F.max(F.when(F.col("section") == "total", F.col("n"))).alias("total_incidents"),
        F.collect_list(F.when(F.col("section") == "sample", F.col("point"))).alias("map_points"),
        as_map("cause", "cause_counts"), as_map("hour", "hour_distribution"),
        as_map("priority", "priority_counts"), as_map("closure", "closure_counts"),
        as_map("station", "station_counts"), as_map("corridor", "corridor_counts"))
