"""Convex-hull jurisdictions per station (survey D10, A5, C6).

Scale plan (a station may hold a third of all rows):

1. Every task reduces its own input rows to the vertices of one partial hull per station before anything is
   shuffled: a batch's points join the vertices held so far and all others are thrown away. So only vertices
   travel, however fine or unique the coordinates are.
2. The partial hulls of a station meet in ``salts`` groups, which merge them in the same way (the hull of a
   union is the hull of the partial hulls).
3. The few vertices that are left per station are merged in one small group per station.

Each hull is an exact integer quickhull (numpy-vectorised side tests
on micro-degree coordinates), so collinear points are detected exactly and
never become vertices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .geo import centroids, wide_points

MICRO = 1_000_000


def _right_of(p, q, pts: np.ndarray) -> np.ndarray:
    """How far each point lies to the right of the directed line p -> q (exact int64, scaled)."""
    return (q[1] - p[1]) * (pts[:, 0] - p[0]) - (q[0] - p[0]) * (pts[:, 1] - p[1])


def _chain(p, q, pts: np.ndarray) -> list:
    """Hull vertices strictly right of p -> q, in walking order from p to q (quickhull step)."""
    if len(pts) == 0:
        return []
    d = _right_of(p, q, pts)
    far = pts[int(np.argmax(d))]
    left_part = pts[_right_of(p, far, pts) > 0]
    right_part = pts[_right_of(far, q, pts) > 0]
    return _chain(p, far, left_part) + [tuple(far)] + _chain(far, q, right_part)


def convex_hull(points) -> list:
    """Counter-clockwise hull vertices of integer (x, y) points, starting at the smallest
    (x, y); points on an edge are not vertices. Exact: all tests are integer cross products."""
    pts = np.unique(np.asarray(list(points), dtype=np.int64).reshape(-1, 2), axis=0)   # sorted by (x, y)
    if len(pts) <= 2:
        return [tuple(v) for v in pts]
    a, b = pts[0], pts[-1]
    below = pts[_right_of(a, b, pts) > 0]
    above = pts[_right_of(b, a, pts) > 0]
    hull = [tuple(a)] + _chain(a, b, below) + [tuple(b)] + _chain(b, a, above)
    return hull if len(hull) >= 3 else [tuple(a), tuple(b)]


def _hull_places(lng: np.ndarray, lat: np.ndarray) -> list[int]:
    """Places of the hull vertices, computed on micro-degree integers.

    Of several doubles of one micro-degree point the smallest (lng, lat) stands for it, so the
    vertices do not depend on the order of the rows.
    """
    order = np.lexsort((lat, lng))
    xy = np.stack([np.rint(lng[order] * MICRO), np.rint(lat[order] * MICRO)], axis=1).astype(np.int64)
    uniq, first = np.unique(xy, axis=0, return_index=True)        # rows sorted by (x, y)
    keys, out = uniq[:, 0], []                                    # x column, ascending
    for hx, hy in convex_hull(uniq):
        lo, hi = np.searchsorted(keys, hx, "left"), np.searchsorted(keys, hx, "right")
        out.append(int(order[first[lo + int(np.searchsorted(uniq[lo:hi, 1], hy))]]))
    return out


def _hull_frame(pdf: pd.DataFrame) -> list:
    """Hull vertices of one group as (lng, lat) doubles."""
    lng, lat = (pdf[c].to_numpy(dtype=np.float64) for c in ("longitude", "latitude"))
    return [(float(lng[i]), float(lat[i])) for i in _hull_places(lng, lat)]


HELD = 200_000                  # vertices that a task holds before it passes them on


def partial_hulls(points: DataFrame) -> DataFrame:
    """(police_station, longitude, latitude): the vertices of each task's partial hulls; no shuffle.

    A task holds only vertices (a few for each station); when it holds too many, because of very many stations, it
    passes them on and starts anew, which costs rows and never a vertex.
    """
    names = ["police_station", "longitude", "latitude"]

    def run(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, (x, _) in held.items() for _ in range(len(x))], pa.string()),
                 *(pa.array(np.concatenate([v[i] for v in held.values()])) for i in (0, 1))], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            station = b.column("police_station").dictionary_encode()
            code = np.asarray(station.indices, np.int64)
            order = np.argsort(code, kind="stable")
            lng, lat = (np.asarray(b.column(c), np.float64)[order] for c in names[1:])
            edge = np.concatenate([[0], np.flatnonzero(np.diff(code[order])) + 1, [len(code)]])
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                name = station.dictionary[int(code[order[lo]])].as_py()
                x, y = lng[lo:hi], lat[lo:hi]
                if name in held:
                    x, y = np.concatenate([held[name][0], x]), np.concatenate([held[name][1], y])
                at = _hull_places(x, y)
                held[name] = (x[at], y[at])
            if sum(len(x) for x, _ in held.values()) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    return points.select(*names).filter("police_station IS NOT NULL").mapInArrow(
        run, "police_station string, longitude double, latitude double")


def _final(pdf: pd.DataFrame) -> pd.DataFrame:
    st = pdf["police_station"].iloc[0]
    verts = _hull_frame(pdf)
    degenerate = len(verts) < 3
    if degenerate:
        clat, clng, d = float(pdf["c_lat"].iloc[0]), float(pdf["c_lng"].iloc[0]), K.HULL_PAD
        # counter-clockwise square starting at the south-west corner
        verts = [(clng - d, clat - d), (clng + d, clat - d), (clng + d, clat + d), (clng - d, clat + d)]
    ring = [[float(a), float(b)] for a, b in verts]
    ring.append(list(ring[0]))
    return pd.DataFrame({"police_station": [st], "ring": [ring], "n_vertices": [len(verts)],
                         "degenerate": [degenerate]})


def prefilter(points: DataFrame, key: str = "police_station") -> DataFrame:
    """Westmost and eastmost point of every (key, latitude) row: exact for hulls."""
    ends = points.groupBy(key, "latitude").agg(F.min("longitude").alias("w"), F.max("longitude").alias("e"))
    return (ends.select(key, "latitude", F.explode(F.array_distinct(F.array("w", "e"))).alias("longitude")))


MERGE_GROUPS = 16


def station_hulls(train: DataFrame, salts: int | None = None) -> DataFrame:
    """(police_station, ring [[lng, lat], ...] closed, n_vertices, degenerate).

    Partial hulls of the tasks, merged in ``salts`` groups per station and then in one.
    """
    from .dims import join_dim
    pts = wide_points(train)
    cents = centroids(pts, "police_station").select(F.col("name").alias("police_station"),
                                                    F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    local = partial_hulls(pts)
    salted = local.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(int(salts or MERGE_GROUPS))))
    merged = partial_hulls(salted.repartition("police_station", "_salt").sortWithinPartitions("police_station"))
    named = join_dim(merged, cents, "police_station", "left", name="hull_centroids")
    return named.groupBy("police_station").applyInPandas(
        _final, "police_station string, ring array<array<double>>, n_vertices int, degenerate boolean")


def polygons(hulls: DataFrame) -> DataFrame:
    """GeoJSON-shaped polygon struct per station."""
    geom = F.struct(F.lit("Polygon").alias("type"), F.array(F.col("ring")).alias("coordinates"))
    return hulls.select("police_station", geom.alias("geometry"))


def to_geojson(hulls: DataFrame) -> DataFrame:
    """One GeoJSON Feature text per station (A5); ``write.text`` stores it."""
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.struct(F.col("police_station")).alias("properties"),
                    F.struct(F.lit("Polygon").alias("type"),
                             F.array(F.col("ring")).alias("coordinates")).alias("geometry"))
    return hulls.select("police_station", F.to_json(feat).alias("feature"))


def attach_jurisdiction(requests: DataFrame, hulls: DataFrame, station_dim: DataFrame) -> DataFrame:
    """Station polygon (``ring``) if one exists, else a 2,200 m circle on the centroid, else none."""
    from .dims import join_dim
    h = hulls.select("police_station", F.col("ring").alias("_ring"))
    c = station_dim.select(F.col("name").alias("police_station"), F.col("lat").alias("center_lat"),
                           F.col("lng").alias("center_lng"))
    out = join_dim(join_dim(requests, h, "police_station", name="hulls"), c, "police_station",
                   name="station_centroids")
    kind = (F.when(F.col("_ring").isNotNull(), F.lit("polygon"))
            .when(F.col("center_lat").isNotNull(), F.lit("circle")).otherwise(F.lit("none")))
    return (out.withColumn("jurisdiction_kind", kind)
            .withColumn("radius_m", F.when(kind == "circle", F.lit(K.JURISDICTION_RADIUS_M)))
            .withColumn("n_vertices", F.when(F.col("_ring").isNotNull(), F.size("_ring") - 1))
            .withColumnRenamed("_ring", "ring"))
