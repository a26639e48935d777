"""Spatial dimensions and lookups (survey D8, D9, D11, D12, C1, C2, C6, C7, C8, G2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .clean import drop_missing, in_bbox
from .dims import join_dim, materialise
from .ranks import positions


def wide_points(train: DataFrame, extra_keys=()) -> DataFrame:
    """Rows with coordinates inside the wide box: the input of every dimension."""
    return in_bbox(drop_missing(train, ["latitude", "longitude", *extra_keys]), K.WIDE_BOX)


MICRO = 1_000_000


def exact_mean(c: str):
    """Mean of a coordinate summed as integer micro-degrees.

    Integer sums are exact and associative, so the mean is the same double on
    any partitioning, executor count or engine (a double sum is not).
    """
    micro = F.round(F.col(c) * F.lit(float(MICRO))).cast("long")
    return F.sum(micro).cast("double") / F.count(micro).cast("double") / F.lit(float(MICRO))


def centroids(points: DataFrame, key: str, default_row: tuple | None = None) -> DataFrame:
    """Mean position per key: a partial/final hash aggregate, one row per key.

    ``default_row`` = (name, lat, lng) appended as in the station map.
    """
    out = (points.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("name"))
           .agg(exact_mean("latitude").alias("lat"), exact_mean("longitude").alias("lng")))
    if default_row is not None:
        spark = points.sparkSession
        name, lat, lng = default_row
        out = out.unionByName(spark.createDataFrame([(name, float(lat), float(lng))],
                                                    "name string, lat double, lng double"))
    return out


def station_centroids(train: DataFrame) -> DataFrame:
    return centroids(wide_points(train), "police_station", K.DEFAULT_CENTROID)


def junction_centroids(train: DataFrame) -> DataFrame:
    return centroids(wide_points(train, ["junction"]), "junction")


def distinct_points(train: DataFrame, key: str = "police_station") -> DataFrame:
    """De-duplicated (key, lat, lng) points of the wide box."""
    return wide_points(train).select(key, "latitude", "longitude").dropDuplicates()


def option_lists(train: DataFrame) -> DataFrame:
    """Sorted distinct option values in long form (list, value, position).

    A missing event type is listed as ``Unknown``; junction NULLs are dropped.
    One scan, one distinct over all lists; then range-partitioned positions, so a list may have any length.
    """
    kv = train.select(F.explode(F.array(
        F.struct(F.lit("police_stations").alias("list"), F.col("police_station").alias("value")),
        F.struct(F.lit("corridors").alias("list"), F.col("corridor").alias("value")),
        F.struct(F.lit("event_causes").alias("list"), F.col("event_cause").alias("value")),
        F.struct(F.lit("event_types").alias("list"),
                 F.coalesce(F.col("event_type"), F.lit(K.UNKNOWN)).alias("value")),
        F.struct(F.lit("junctions").alias("list"), F.col("junction").alias("value")),
    )).alias("kv")).select("kv.list", "kv.value")
    d = kv.filter(F.col("value").isNotNull()).distinct()
    return positions(d, "list", "value")


def top_junctions(history: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The k most frequent junctions per key value, long form (key, rank, junction, n).

    Counting is partial/final, so a hot key adds one row per partition to the
    shuffle. The rank window sees one row per (key, junction) pair only, and
    ``row_number <= k`` is planned as a WindowGroupLimit before the exchange.
    """
    counts = (history.filter(F.col("junction").isNotNull() & F.col(key).isNotNull())
              .groupBy(key, "junction").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(key).orderBy(F.desc("n"), F.asc("junction"))
    return (counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(key, F.col("rank").cast("int").alias("rank"), "junction", "n"))


def ranked_arrays(top: DataFrame, key: str, name: str) -> DataFrame:
    """(key, array of junctions in rank order); at most k entries per key."""
    return (top.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("rank", "junction"))).alias("_r"))
            .select(key, F.transform("_r", lambda x: x["junction"]).alias(name)))


def top_junctions_multi(history: DataFrame, keys=("police_station", "corridor"), k: int = 3) -> DataFrame:
    """(kind, key, rank, junction, n): D12 for several key columns in one pass.

    Rows are tagged with each key column, counted by one partial/final
    aggregate, and ranked by one window over the aggregated pairs.
    """
    tagged = history.filter(F.col("junction").isNotNull()).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key"))
                            for c in keys])).alias("t"), "junction")
    counts = (tagged.filter(F.col("t.key").isNotNull())
              .groupBy(F.col("t.kind").alias("kind"), F.col("t.key").alias("key"), "junction")
              .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("kind", "key").orderBy(F.desc("n"), F.asc("junction"))
    return (counts.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
            .select("kind", "key", "rank", "junction", "n"))


def ranked_junction_lists(history: DataFrame, keys=("police_station", "corridor"), k: int = 3) -> DataFrame:
    """(kind, key, arr): the k most frequent junctions per value of every key column,
    from one pass (``top_junctions_multi``), written once to the shared folder."""
    top = top_junctions_multi(history, keys, k)
    arr = (top.groupBy("kind", "key").agg(F.array_sort(F.collect_list(F.struct("rank", "junction"))).alias("_r"))
           .select("kind", "key", F.transform("_r", lambda x: x["junction"]).alias("arr")))
    return materialise(arr, "ranked_junctions")


def suggest_junctions(requests: DataFrame, history: DataFrame, k: int = 3) -> DataFrame:
    """Station's top-k junctions, else the corridor's, else three fixed names.

    Both rankings come from one pass over the history (``ranked_junction_lists``);
    each is joined with a size-checked broadcast, so the request side is never
    shuffled for them.
    """
    ranked = ranked_junction_lists(history, ("police_station", "corridor"), k)
    by_station = ranked.filter(F.col("kind") == "police_station").select(
        F.col("key").alias("police_station"), F.col("arr").alias("_st"))
    by_corridor = ranked.filter(F.col("kind") == "corridor").select(
        F.col("key").alias("corridor"), F.col("arr").alias("_co"))
    fallback = F.array(*[F.lit(j) for j in K.FALLBACK_JUNCTIONS])
    out = join_dim(join_dim(requests, by_station, "police_station"), by_corridor, "corridor")
    source = (F.when(F.col("_st").isNotNull(), F.lit("station"))
              .when(F.col("_co").isNotNull(), F.lit("corridor")).otherwise(F.lit("default")))
    return (out.withColumn("suggested_junctions", F.coalesce("_st", "_co", fallback))
            .withColumn("junction_source", source).drop("_st", "_co"))


def attach_junction(df: DataFrame, junction_dim: DataFrame, col: str = "junction",
                    prefix: str = "junction") -> DataFrame:
    """Junction -> centroid, NULL when the junction is unknown."""
    dim = junction_dim.select(F.col("name").alias(col), F.col("lat").alias(f"{prefix}_lat"),
                              F.col("lng").alias(f"{prefix}_lng"))
    return join_dim(df, dim, col)


def snap_station(requests: DataFrame, station_dim: DataFrame) -> DataFrame:
    """Source = station centroid, destination = source + (0.0005, -0.001)."""
    dim = station_dim.select(F.col("name").alias("police_station"),
                             F.col("lat").alias("src_lat"), F.col("lng").alias("src_lng"))
    return (join_dim(requests, dim, "police_station")
            .withColumn("dst_lat", F.col("src_lat") + F.lit(K.DEST_OFFSET[0]))
            .withColumn("dst_lng", F.col("src_lng") + F.lit(K.DEST_OFFSET[1])))


def meta_summary(train: DataFrame, polygons: DataFrame | None = None) -> DataFrame:
    """One-row metadata (D23): the five sorted option lists, both centroid maps and
    the station polygons.

    Every part is a dimension (one row per distinct station, corridor, cause,
    type, junction). The parts are stacked into one long table and folded by a
    single global aggregate with per-part conditional collections: no join.
    The one row is bounded by the dimension sizes, not by the history.
    """
    geom_t = "struct<type:string,coordinates:array<array<array<double>>>>"
    nul = F.lit(None)

    def part(df, kind, name, lat=None, lng=None, geom=None):
        return df.select(F.lit(kind).alias("part"), name.cast("string").alias("name"),
                         (lat if lat is not None else nul).cast("double").alias("lat"),
                         (lng if lng is not None else nul).cast("double").alias("lng"),
                         (geom if geom is not None else nul).cast(geom_t).alias("geometry"))

    lists = option_lists(train)
    stacked = lists.select(F.col("list").alias("part"), F.col("value").alias("name"),
                           nul.cast("double").alias("lat"), nul.cast("double").alias("lng"),
                           nul.cast(geom_t).alias("geometry"))
    stacked = stacked.unionByName(part(station_centroids(train), "station_coords", F.col("name"),
                                       F.col("lat"), F.col("lng")))
    stacked = stacked.unionByName(part(junction_centroids(train), "junction_coords", F.col("name"),
                                       F.col("lat"), F.col("lng")))
    if polygons is not None:
        stacked = stacked.unionByName(part(polygons, "station_polygons", F.col("police_station"),
                                           geom=F.col("geometry")))

    def names(p):
        return F.array_sort(F.collect_list(F.when(F.col("part") == p, F.col("name")))).alias(p)

    def coords(p):
        entry = F.when(F.col("part") == p, F.struct("name", F.struct("lat", "lng")))
        return F.map_from_entries(F.collect_list(entry)).alias(p)

    aggs = [names(p) for p in ("police_stations", "corridors", "event_causes", "event_types", "junctions")]
    aggs += [coords("station_coords"), coords("junction_coords")]
    if polygons is not None:
        aggs.append(F.map_from_entries(F.collect_list(
            F.when(F.col("part") == "station_polygons", F.struct("name", "geometry")))).alias("station_polygons"))
    return stacked.agg(*aggs)
