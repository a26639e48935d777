import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import incident_rows
from incidentflow.operators import geo as GEO
from incidentflow.operators import hulls as H
from incidentflow.operators import nearest as N
from incidentflow.operators.features import train_table
from incidentflow.sources import readers as R
from incidentflow.sources import writers as W


def _train(spark, pts):
    rows = [(i, "accident", "Low", False, "c", st, f"J{i % 3}", lat, lng, "2024-01-01 10:00:00", None)
            for i, (st, lat, lng) in enumerate(pts)]
    return train_table(incident_rows(spark, rows))


def _brute_vertices(points):
    """Hull vertices by definition, O(n^3): for every ordered pair (p, q) with no point
    strictly right of p -> q, the two extreme points on that line are vertices."""
    pts = np.unique(np.array([(round(lng * 1e6), round(lat * 1e6)) for lat, lng in points], dtype=np.int64), axis=0)
    if len(pts) <= 2:
        return {tuple(int(v) for v in x) for x in pts}
    verts = set()
    for i in range(len(pts)):
        d = pts - pts[i]
        c = d[:, 0][:, None] * d[:, 1][None, :] - d[:, 1][:, None] * d[:, 0][None, :]   # c[j, r]
        ok = (c >= 0).all(axis=1)
        ok[i] = False
        for j in np.nonzero(ok)[0]:
            on = np.nonzero(c[j] == 0)[0]
            t = d[on, 0] * d[j, 0] + d[on, 1] * d[j, 1]
            verts.add(tuple(int(v) for v in pts[on[np.argmin(t)]]))
            verts.add(tuple(int(v) for v in pts[on[np.argmax(t)]]))
    return verts


def _ring_set(ring):
    return {(round(a * 1e6), round(b * 1e6)) for a, b in ring[:-1]}


@pytest.mark.parametrize("salts", [None, 1, 7, 64])
def test_hull_matches_single_pass(spark, salts):
    random.seed(salts or 0)
    pts = []
    for st in ("A", "B", "C"):
        for _ in range(300):
            pts.append((st, 12.9 + random.randint(0, 400) / 10000, 77.5 + random.randint(0, 400) / 10000))
    pts += [("A", 12.9, 77.5), ("A", 12.9, 77.5)]   # duplicates
    h = {r.police_station: r for r in H.station_hulls(_train(spark, pts), salts=salts).collect()}
    for st in ("A", "B", "C"):
        exp = _brute_vertices([(la, ln) for s, la, ln in pts if s == st])
        ring = h[st].ring
        assert ring[0] == ring[-1]
        assert _ring_set(ring) == exp
        # counter-clockwise: positive shoelace area
        area = sum(ring[i][0] * ring[i + 1][1] - ring[i + 1][0] * ring[i][1] for i in range(len(ring) - 1))
        assert area > 0


def test_hull_degenerate_cases(spark):
    pts = [("one", 12.95, 77.55),
           ("two", 12.95, 77.55), ("two", 12.96, 77.56),
           ("line", 12.90, 77.50), ("line", 12.91, 77.51), ("line", 12.92, 77.52),
           ("sq", 12.90, 77.50), ("sq", 12.90, 77.60), ("sq", 13.00, 77.60), ("sq", 13.00, 77.50),
           ("sq", 12.95, 77.55)]
    h = {r.police_station: r for r in H.station_hulls(_train(spark, pts)).collect()}
    for st in ("one", "two", "line"):
        assert h[st].degenerate and h[st].n_vertices == 4
    c = h["one"].ring
    assert c[0] == pytest.approx([77.55 - 0.015, 12.95 - 0.015]) and c[2] == pytest.approx([77.55 + 0.015, 12.95 + 0.015])
    line = h["line"].ring   # square around the centroid of the three points
    assert line[0] == pytest.approx([77.51 - 0.015, 12.91 - 0.015])
    assert not h["sq"].degenerate and h["sq"].n_vertices == 4
    assert _ring_set(h["sq"].ring) == {(77500000, 12900000), (77600000, 12900000), (77600000, 13000000),
                                       (77500000, 13000000)}


def test_prefilter_keeps_all_vertices(spark):
    random.seed(3)
    pts = [("S", 12.9 + random.randint(0, 50) / 1000, 77.5 + random.randint(0, 50) / 1000) for _ in range(500)]
    df = spark.createDataFrame(pts, "police_station string, latitude double, longitude double")
    kept = {(round(r.longitude * 1e6), round(r.latitude * 1e6)) for r in H.prefilter(df).collect()}
    assert _brute_vertices([(a, b) for _, a, b in pts]) <= kept


def test_geojson_feature(spark):
    pts = [("sq", 12.90, 77.50), ("sq", 12.90, 77.60), ("sq", 13.00, 77.60)]
    f = H.to_geojson(H.station_hulls(_train(spark, pts))).first().feature
    assert f.startswith('{"type":"Feature","properties":{"police_station":"sq"},"geometry":{"type":"Polygon"')


def test_centroids_exact_and_default(spark):
    pts = [("A", 12.91, 77.51), ("A", 12.93, 77.53), ("B", 13.5, 78.0), ("C", 11.0, 77.5)]  # C out of wide box
    d = {r.name: (r.lat, r.lng) for r in GEO.station_centroids(_train(spark, pts)).collect()}
    assert d["A"] == (12.92, 77.52) and d["B"] == (13.5, 78.0) and "C" not in d
    assert d["default"] == (12.9716, 77.5946)


def test_nearest_matches_brute_force(spark):
    random.seed(7)
    ref = [(f"J{i}", 12.8 + random.random() * 0.4, 77.4 + random.random() * 0.4) for i in range(60)]
    pts = [(i, 12.7 + random.random() * 0.6, 77.3 + random.random() * 0.6) for i in range(400)]
    rdf = spark.createDataFrame(ref, "name string, lat double, lng double")
    pdf = spark.createDataFrame(pts, "incident_id long, latitude double, longitude double")
    import math

    def hav(a, b, c, d):
        r = math.pi / 180
        x = math.sin((c - a) * r / 2) ** 2 + math.cos(a * r) * math.cos(c * r) * math.sin((d - b) * r / 2) ** 2
        return 6371000.0 * 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x))
    for cell in (0.005, 0.05, 1.0):
        got = {}
        for r in N.nearest(pdf, rdf, "incident_id", k=3, cell=cell).collect():
            got.setdefault(r.incident_id, []).append((r.rank, r.junction))
        for i, la, ln in pts:
            exp = sorted(ref, key=lambda j: (hav(la, ln, j[1], j[2]), j[0]))[:3]
            assert [j for _, j in sorted(got[i])] == [e[0] for e in exp], (cell, i)


def test_top_junctions_and_fallback(spark):
    hist = spark.createDataFrame(
        [("S1", "C1", "J1")] * 3 + [("S1", "C1", "J2")] * 3 + [("S1", "C1", "J3")] * 2 + [("S1", "C1", "J4")] * 2
        + [("S2", "C2", None)] + [("S3", "C3", "J9")],
        "police_station string, corridor string, junction string")
    req = spark.createDataFrame([(1, "S1", "C9"), (2, "S2", "C3"), (3, "S8", "C8")],
                                "request_id long, police_station string, corridor string")
    got = {r.request_id: (r.suggested_junctions, r.junction_source)
           for r in GEO.suggest_junctions(req, hist).collect()}
    assert got[1] == (["J1", "J2", "J3"], "station")       # ties by name
    assert got[2] == (["J9"], "corridor")                    # station rows have no junction
    assert got[3] == (["Mekhri Circle", "Richmond Circle", "Silk Board Junction"], "default")


def test_blueprint_paths_agree(spark):
    """The one-pass dimension path equals the per-dimension path."""
    from incidentflow.operators import clean as C
    from incidentflow.operators import prescribe as P
    from incidentflow.sources import fixtures as fx
    inc = fx.incidents(spark, "/root/testdata/sf0.001")
    req = fx.requests_from_incidents(inc)
    a = P.blueprint_flat(req, C.serve_table(inc), train_table(inc))
    b = P.blueprint_from_history(req, inc)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _brute_nearest(points, ref, k):
    import math

    def away(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))

    return {i: sorted(away(a, b, c, d) for _, c, d in ref)[:k] for i, a, b in points}


@pytest.mark.parametrize("kind", ["clustered", "far", "meridian", "poles", "same", "few"])
def test_nearest_on_hard_layouts(spark, kind):
    """Dense clusters, far-away points, both sides of 180 degrees, poles, equal places, fewer points than k."""
    r = random.Random(11)
    ref = {"clustered": [(12 + r.gauss(0, 0.0005), 77 + r.gauss(0, 0.0005)) for _ in range(200)]
           + [(r.uniform(-60, 60), r.uniform(-170, 170)) for _ in range(30)],
           "far": [(12.9 + r.random() / 10, 77.5 + r.random() / 10) for _ in range(80)],
           "meridian": [(r.uniform(-5, 5), (179.9 + r.uniform(0, 0.2) + 180) % 360 - 180) for _ in range(60)],
           "poles": [(r.uniform(88, 90), r.uniform(-180, 180)) for _ in range(60)] + [(-90.0, 10.0), (90.0, 0.0)],
           "same": [(12.5, 77.5)] * 40 + [(12.6, 77.5)] * 3, "few": [(1.0, 2.0), (1.0, 3.0)]}[kind]
    ref = [(f"J{i:03d}", a, b) for i, (a, b) in enumerate(ref)]
    points = [(i, a + r.gauss(0, 0.01), b + r.gauss(0, 0.01)) for i, (_, a, b) in enumerate(ref[:60]) if abs(a) < 89.9]
    points += [(500 + i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(60)] + [(900, 89.99, -179.99), (901, 0.0, 180.0)]
    rdf = spark.createDataFrame(ref, "name string, lat double, lng double")
    pdf = spark.createDataFrame(points + [(999, None, 1.0)], "incident_id long, latitude double, longitude double")
    got = {}
    for x in N.nearest(pdf, rdf, "incident_id", k=3).collect():
        got.setdefault(x.incident_id, []).append((x.rank, x.dist_m))
    want = _brute_nearest(points, ref, 3)
    assert set(got) == set(want)
    for i, d in want.items():
        assert [x[1] for x in sorted(got[i])] == pytest.approx(d, rel=1e-6, abs=0.05), i


def test_candidate_table_grows_with_the_reference_points(spark):
    """Its size does not depend on how far the query points are, and is linear in the reference points."""
    def size(n):
        r = random.Random(n)
        ref = [(f"J{i}", 12.8 + r.random() * 0.4, 77.4 + r.random() * 0.4) for i in range(n)]
        lists = N.candidates(spark.createDataFrame(ref, "name string, lat double, lng double"), 3)
        return lists.agg(F.sum(F.size("js"))).first()[0]

    small, large = size(100), size(800)
    assert large <= 3 * 8 * small


def test_hulls_shuffle_vertices_only(spark):
    """Every GPS latitude is unique, so no point shares a row with another; only hull vertices leave a task."""
    r = random.Random(21)
    pts = [("A" if i % 3 else "B", 12.9 + r.random() * 0.1, 77.5 + r.random() * 0.1) for i in range(30_000)]
    df = spark.createDataFrame(pts, "police_station string, latitude double, longitude double").repartition(4)
    local = H.partial_hulls(df)
    assert "Exchange" not in local._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert local.count() < 400
    for st in "AB":
        own = [(a, b) for k, a, b in pts if k == st]
        want = H.convex_hull([(round(b * 1e6), round(a * 1e6)) for a, b in own])
        kept = {(round(x.longitude * 1e6), round(x.latitude * 1e6)) for x in local.filter(F.col("police_station") == st).collect()}
        assert set(want) <= kept


def test_partial_hulls_with_many_stations(spark, monkeypatch):
    """A task that holds too many vertices passes them on; no vertex is lost."""
    monkeypatch.setattr(H, "HELD", 50)
    r = random.Random(22)
    pts = [(f"S{i % 40}", 12.9 + r.random() * 0.1, 77.5 + r.random() * 0.1) for i in range(4000)]
    whole = {x.police_station: _ring_set(x.ring) for x in H.station_hulls(_train(spark, pts)).collect()}
    for st, ring in whole.items():
        assert ring == set(H.convex_hull([(round(b * 1e6), round(a * 1e6)) for k, a, b in pts if k == st]))
    assert len(whole) == 40


def test_feature_collection_files(spark, tmp_path):
    """Each file is one valid FeatureCollection; names with quotes survive; an empty table writes no feature."""
    import glob
    import json
    pts = [(f'sq "{i}" é', 12.90 + i / 1000, 77.50) for i in range(9)] + [(f'sq "{i}" é', 12.90, 77.60) for i in range(9)]
    pts += [(f'sq "{i}" é', 13.00, 77.60 - i / 1000) for i in range(9)]
    hulls = H.station_hulls(_train(spark, pts))
    W.write_feature_collections(H.to_geojson(hulls).repartition(3, "police_station"), str(tmp_path / "g"))
    names = []
    for f in glob.glob(str(tmp_path / "g" / "part-*")):
        text = open(f).read()
        if text:
            whole = json.loads(text)
            assert whole["type"] == "FeatureCollection"
            names += [x["properties"]["police_station"] for x in whole["features"]]
    assert sorted(names) == sorted({p[0] for p in pts})
    back = {x.police_station: x.ring for x in R.read_feature_collections(spark, str(tmp_path / "g")).collect()}
    assert back == {x.police_station: x.ring for x in hulls.collect()}
    W.write_feature_collections(H.to_geojson(hulls).limit(0), str(tmp_path / "none"))
    assert R.read_feature_collections(spark, str(tmp_path / "none")).count() == 0
