"""k nearest reference points by great-circle distance: exact, without a cross join or a second pass over
the large side (survey C8).

The reference points are indexed by a quadtree over (latitude, longitude modulo 360): a cell with more than
``LEAF`` points is split in 16, so dense areas have small cells and empty ones large cells. For each leaf cell (empty
ones too) the points that can be among the k nearest of *any* place in the cell are found once, on the small
side: a best-first descent from a coarse level keeps the nodes whose nearest edge is not farther than the
distance within which k points are certain, and splits only those. Distances between cells are those of their
centres, more or less the radii of the cells, so the bounds hold over the 180th meridian and at the poles alike.

The candidate table has at most 16 leaves for each split cell, so it grows with the reference points and not with
any search radius. Each query point is then joined once with the candidates of its own leaf (a
size-checked broadcast join: narrow, no shuffle) and sorts that short list. Nothing of the large side is
stored or read twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .dims import join_dim, materialise

RAD = math.pi / 180.0
LEAF = 8                        # points of a cell that is not split
STEP, DEPTH = 2, 12             # bits of a split; levels (the finest cells have 360 / 2^24 degrees)
START_NODES = 64                # the descent starts at the finest level with at most so many nodes
SLACK = 1.0 + 1e-9              # bounds are compared with room for rounding


def _side(level: int) -> float:
    return 360.0 / (1 << (STEP * level))


def _cell(lat: Column, lng: Column, level: int) -> tuple[Column, Column]:
    side = F.lit(_side(level))
    return F.floor((lat + F.lit(90.0)) / side), F.floor(F.pmod(lng + F.lit(180.0), F.lit(360.0)) / side)


def _cells(lat: Column, lng: Column) -> Column:
    """The cells of a place on all levels, as an array of (level, gx, gy)."""
    return F.array(*[F.struct(F.lit(n).alias("level"), x.alias("gx"), y.alias("gy"))
                     for n in range(DEPTH + 1) for x, y in [_cell(lat, lng, n)]])


def _by_level(level: Column, value) -> Column:
    return F.get(F.array(*[F.lit(float(value(n))) for n in range(DEPTH + 1)]), level)


def _placed(df: DataFrame, prefix: str = "") -> DataFrame:
    """Centre (lat, lng) and radius in metres of the cells in level, gx, gy."""
    side = _by_level(F.col(f"{prefix}level"), _side)
    # no place of a cell is farther from its centre than half a side each way
    return df.withColumns({
        f"{prefix}lat": (F.col(f"{prefix}gx") + F.lit(0.5)) * side - F.lit(90.0),
        f"{prefix}lng": (F.col(f"{prefix}gy") + F.lit(0.5)) * side - F.lit(180.0),
        f"{prefix}r": _by_level(F.col(f"{prefix}level"), lambda n: K.EARTH_RADIUS_M * _side(n) * RAD)})


def _haversine_expr(p_lat: str, p_lng: str, q_lat: str, q_lng: str) -> str:
    """SQL text of the great-circle distance (same formula as functions.geomath)."""
    r = repr(RAD)
    a = (f"sin(({q_lat} - {p_lat}) * {r}D / 2.0D) * sin(({q_lat} - {p_lat}) * {r}D / 2.0D)"
         f" + cos({p_lat} * {r}D) * cos({q_lat} * {r}D)"
         f" * sin(({q_lng} - {p_lng}) * {r}D / 2.0D) * sin(({q_lng} - {p_lng}) * {r}D / 2.0D)")
    return f"{K.EARTH_RADIUS_M!r}D * 2.0D * atan2(sqrt({a}), sqrt(1.0D - ({a})))"


def tree(ref: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) of the quadtree over ``ref`` (name, lat, lng): nodes (level, gx, gy, n, split) hold points, leaves
    (level, gx, gy) cover every place once. Cells of level ``depth`` are not split."""
    spark = ref.sparkSession
    nodes = (ref.select(F.explode(_cells(F.col("lat"), F.col("lng"))).alias("c")).groupBy("c.level", "c.gx", "c.gy")
             .agg(F.count(F.lit(1)).alias("n")).withColumn("split", (F.col("n") > LEAF) & (F.col("level") < depth)))
    nodes = materialise(nodes, "nearest_nodes")
    split = nodes.filter("split")
    part = F.sequence(F.lit(0), F.lit((1 << STEP) - 1))
    below = split.withColumn("ox", F.explode(part)).withColumn("oy", F.explode(part)).select(
        (F.col("level") + 1).alias("level"), ((F.col("gx") * (1 << STEP)) + F.col("ox")).alias("gx"),
        ((F.col("gy") * (1 << STEP)) + F.col("oy")).alias("gy"))
    root = spark.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("gx"), F.lit(0).cast("long").alias("gy"))
    leaves = root.unionByName(below).join(split.select("level", "gx", "gy"), ["level", "gx", "gy"], "left_anti")
    return nodes, leaves


def candidates(ref: DataFrame, k: int, depth: int = DEPTH) -> DataFrame:
    """(level, gx, gy, js): for every leaf cell the points that can be among the k nearest of a place in it."""
    nodes, leaves = tree(ref, depth)
    counts = {r["level"]: (r["n"], r["split"]) for r in nodes.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.max("split").alias("split")).collect()}        # one row a level
    if not counts:
        return leaves.withColumn("js", F.array().cast("array<struct<junction:string,j_lat:double,j_lng:double>>"))
    # a node above the start that is not split has no node below it that matters: start where all are still nodes
    start = max(n for n in counts if counts[n][0] <= START_NODES)
    deepest = max([n for n in counts if counts[n][1]], default=-1) + 1
    start = min(start, deepest)
    first = nodes.filter(F.col("level") == start).select("level", "gx", "gy", "n", "split").collect()   # START_NODES rows
    table = F.array(*[F.struct(F.lit(r["level"]).alias("level"), F.lit(r["gx"]).cast("long").alias("gx"),
                               F.lit(r["gy"]).cast("long").alias("gy"), F.lit(r["n"]).cast("long").alias("n"),
                               F.lit(r["split"]).alias("split")) for r in first])
    key = ["q_level", "q_gx", "q_gy"]
    front = _placed(leaves.select(*[F.col(c).alias(f"q_{c}") for c in ("level", "gx", "gy")]), "q_")
    front = front.withColumn("node", F.explode(table)).select(*front.columns, "node.*")
    own, at = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("far")
    children = nodes.withColumns({"up_level": F.col("level") - 1, "up_gx": F.shiftright("gx", STEP),
                                  "up_gy": F.shiftright("gy", STEP)})

    def pruned(df):
        away = F.expr(_haversine_expr("q_lat", "q_lng", "lat", "lng"))
        df = _placed(df).withColumn("away", away).withColumns({"far": F.col("away") + F.col("r") + F.col("q_r"),
                                                               "near": F.col("away") - F.col("r") - F.col("q_r")})
        df = df.withColumn("sure", F.sum("n").over(at))                    # points within that distance
        limit = F.min(F.when(F.col("sure") >= k, F.col("far"))).over(own)
        df = df.withColumn("limit", F.coalesce(limit, F.lit(float("inf"))))
        return df.filter(F.col("near") <= F.col("limit") * F.lit(SLACK)).drop(
            "lat", "lng", "r", "away", "far", "near", "sure", "limit")

    front = pruned(front)
    for level in range(start, deepest):
        # nodes that are split give way to those below; leaves stay
        more = join_dim(front.filter(F.col("split") & (F.col("level") == level)).select(
            *[c for c in front.columns if c not in ("level", "gx", "gy", "n", "split")],
            F.col("level").alias("up_level"), F.col("gx").alias("up_gx"), F.col("gy").alias("up_gy")),
            children.filter(F.col("level") == level + 1), ["up_level", "up_gx", "up_gy"], "inner", name="nearest_children")
        front = materialise(pruned(front.filter(~F.col("split") | (F.col("level") != level)).unionByName(
            more.drop("up_level", "up_gx", "up_gy"))), "nearest_front")
    points = (ref.select(F.col("name").alias("junction"), F.col("lat").alias("j_lat"), F.col("lng").alias("j_lng"),
                         F.explode(_cells(F.col("lat"), F.col("lng"))).alias("c"))
              .select("junction", "j_lat", "j_lng", "c.*"))
    near = join_dim(front.select(*key, "q_lat", "q_lng", "q_r", "level", "gx", "gy"), points, ["level", "gx", "gy"], "inner",
                    name="nearest_points")
    near = near.withColumn("away", F.expr(_haversine_expr("q_lat", "q_lng", "j_lat", "j_lng")))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("away"))
    near = near.withColumn("place", place)
    kth = F.max(F.when(F.col("place") <= k, F.col("away"))).over(own)
    near = near.withColumn("kth", kth).filter(F.col("away") <= (F.col("kth") + 2 * F.col("q_r")) * F.lit(SLACK))
    lists = near.groupBy(*key).agg(F.collect_list(F.struct("junction", "j_lat", "j_lng")).alias("js"))
    return lists.select(*[F.col(f"q_{c}").alias(c) for c in ("level", "gx", "gy")], "js")


def nearest(points: DataFrame, ref: DataFrame, key: str, k: int = 3, cell: float | None = None,
            lat: str = "latitude", lng: str = "longitude") -> DataFrame:
    """(key, rank, junction, dist_m) for the k nearest rows of ``ref`` (name, lat, lng).

    ``cell``: cells of this side in degrees or less are not split (the result does not depend on it).

    Points without a coordinate have no row; equal distances are ordered by name; fewer than k reference
    points are all returned.
    """
    ref = materialise(ref.select("name", "lat", "lng").filter("lat IS NOT NULL AND lng IS NOT NULL"), "nearest_ref")
    depth = DEPTH if cell is None else max([n for n in range(DEPTH + 1) if _side(n) > cell], default=-1) + 1
    lists = materialise(candidates(ref, k, min(depth, DEPTH)), "nearest_candidates")
    levels = sorted(r["level"] for r in lists.select("level").distinct().collect())      # at most DEPTH + 1
    if not levels:
        return points.sparkSession.createDataFrame([], f"{key} long, rank int, junction string, dist_m double")
    place = points.select(key, F.col(lat).alias("p_lat"), F.col(lng).alias("p_lng")).filter(
        F.col("p_lat").isNotNull() & F.col("p_lng").isNotNull())
    cells = F.filter(_cells(F.col("p_lat"), F.col("p_lng")), lambda c: c["level"].isin(levels))
    # of a place's cells exactly one is a leaf
    own = place.withColumn("c", F.explode(cells)).select(key, "p_lat", "p_lng", "c.*")
    joined = join_dim(own, lists, ["level", "gx", "gy"], "inner", name="nearest_lists")
    dist = _haversine_expr("p_lat", "p_lng", "j.j_lat", "j.j_lng")
    best = F.slice(F.expr(f"array_sort(transform(js, j -> named_struct('dist_m', {dist}, 'junction', j.junction)))"), 1, k)
    return joined.select(key, F.posexplode(best).alias("pos", "b")).select(
        key, (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.junction").alias("junction"),
        F.col("b.dist_m").alias("dist_m"))
