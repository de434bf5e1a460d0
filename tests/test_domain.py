import bisect
import json
import math
import random
import zipfile
import zlib
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from kerbside import documents, hooks, scenes, sinks
from kerbside import params as P
from kerbside.engine import Engine
from kerbside.functions import geo, media, overlay
from kerbside.operators import cluster, detect, links, merge, suppress, track, triangulate
from kerbside.plans.components import connected_components
from kerbside.plans.pipeline import from_boxes, job_summary
from kerbside.plans.scratch import Scratch, compiled_methods, with_row_key
from kerbside.plans.skew import join_groups
from kerbside.sources import archive, gpx, labels, listing
from kerbside.streaming import entries as live


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalars(spark):
    c = F.lit
    assert value(spark, geo.haversine_ft(c(30.4), c(-86.7), c(30.4001), c(-86.7))) == pytest.approx(36.481275196, abs=1e-6)
    assert value(spark, geo.haversine_ft(c(30.4), c(-86.7), c(30.4), c(-86.6999))) == pytest.approx(31.465598528, abs=1e-6)
    assert value(spark, geo.mono_distance_m(c(11.0), c(960.0), c(1920))) == pytest.approx(16.308170654, abs=1e-8)
    assert value(spark, geo.mono_distance_m(c(8.0), c(480.0), c(1920))) == pytest.approx(23.720975496, abs=1e-8)
    lat, lon = geo.destination(c(30.4), c(-86.7), F.radians(c(90.0)), c(100.0), P.EARTH_PROJECT_M)
    assert (value(spark, lat), value(spark, lon)) == (pytest.approx(30.3999999959, abs=1e-9), pytest.approx(-86.6989573248, abs=1e-9))
    assert value(spark, F.round(geo.object_bearing_deg(c(350.0), c(0.9)), 6)) == 6.0
    assert value(spark, F.round(geo.object_bearing_deg(c(5.0), c(0.1)), 6)) == 349.0
    assert value(spark, geo.dms_decimal(c(82), c(32), c(19.0), c("w"))) == pytest.approx(-82.538611111, abs=1e-8)


CLEANED = [
    ("Position: +028.54521 / -080.79476", "Position: +028.54521 / -080.79476"),
    ("+030/40972 -08671261", "+030.40972 -086.71261"),
    ("030.409 68", "030.40968"),
    ("+030.40972-086.71261", "+030.40972 / -086.71261"),
    ("+028 54484 / -080,79476", "+028.54484 / -080.79476"),
    ("+O28.54521|-08O.79476", "+O28.54521 / -08O.79476"),
    ('+03l.40972\n-086.71239"', "+03l.40972 -086.71239"),
    ("year 2024 12345", "year 2024.12345"),
]
BEARINGS = [("Azimuth/Bearing: 339° N21W 6027mils (True)", 339.0), ("Bearing: 360", 0.0), ("heading 400", 40.0), ("Bearing: 3999", None), ("Bearing: -12", None), ("Heading 7.5", 7.5), ("none", None)]


def test_overlay(spark):
    df = spark.createDataFrame(CLEANED, "raw string, want string")
    assert [r for r in df.select("want", overlay.clean_number(F.col("raw")).alias("got")).collect() if r.want != r.got] == []
    df = spark.createDataFrame(BEARINGS, "raw string, want double")
    assert [r for r in df.select("want", overlay.text_bearing(F.col("raw")).alias("got")).collect() if r.want != r.got] == []
    texts = [("Position: +028.54521 / -080.79476", 28.54521, -80.79476), ("gps: 27.1, 82.5", 27.1, -82.5), ("x 81.12345 y 28.54321", 28.54321, -81.12345), ("N 27 20 38 W 82 32 19", 27.343888889, -82.538611111), ("nothing", None, None), ("Position: 099.00000 / -190.00000", None, None)]
    got = spark.createDataFrame(texts, "t string, lat double, lng double").select("lat", "lng", overlay.text_coords(F.col("t")).alias("c")).collect()
    for r in got:
        assert (r.c is None) == (r.lat is None)
        if r.c:
            assert (r.c.lat, r.c.lng) == (pytest.approx(r.lat, abs=1e-8), pytest.approx(r.lng, abs=1e-8))
    row = spark.createDataFrame([("API_ERROR: x", "", " lat: 27.5, lon: -82.5 heading 10")], "a string, b string, c string").select(overlay.region_cascade(F.col("a"), F.col("b"), F.col("c")).alias("o")).first().o
    assert (row.lat, row.lng, row.bearing, row.region, row.raw_text) == (27.5, -82.5, 10.0, "full", "lat: 27.5, lon: -82.5 heading 10")


def test_media(spark):
    rect = value(spark, media.crop_rect(F.lit(0.5), F.lit(0.5), F.lit(0.1), F.lit(0.2), F.lit(1080), F.lit(1920)))
    assert tuple(rect) == (297, 432, 783, 1488)
    assert value(spark, media.video_fps(F.lit('{"streams":[{"codec_type":"video","r_frame_rate":"30000/1001"}]}'))) == pytest.approx(29.97, abs=0.01)
    assert value(spark, media.video_fps(F.lit("{}"))) == 30.0
    assert value(spark, media.crop_name(F.lit(7), F.lit(3))) == "frame_000007_det_03.jpg"
    assert value(spark, media.exif_time(F.lit(None).cast("string"), F.lit("not a time"))) is None


RAYS = {
    1: ([(30.4, -86.7, 45), (30.4001, -86.7, 90)], None, 11.13, 45.0, 0.0, 11.13, 15.74, 30.4001, -86.6998841),
    2: ([(30.4, -86.7, 350), (30.4001797, -86.7, 310)], None, 20.0, 40.0, 0.0, 5.4, 23.84, 30.4002109, -86.7000431),
    3: ([(30.4, -86.7, 90), (30.4000898, -86.7, 60)], None, 10.0, 30.0, 0.0, 17.31, 19.99, 30.4, -86.7001803),
    4: ([(30.4, -86.7, 30), (30.400018, -86.7, 60)], "baseline_too_short", 2.0, 30.0, 0.0, 2.0, 3.47, 30.400027, -86.6999819),
    5: ([(30.4, -86.7, 30), (30.4000898, -86.7, 45)], "bearing_spread_too_small", 10.0, 15.0, 0.0, 19.31, 27.31, 30.4002125, -86.6998578),
    6: ([(30.4, -86.7, 0), (30.4001, -86.7, 180)], "singular_matrix", 11.13, 180.0, None, None, None, None, None),
    7: ([(30.4, -86.7, 20), (30.4000898, -86.7, 80), (30.4001797, -86.7, 20), (30.4002695, -86.7, 110)], "residual_too_big", 30.0, 90.0, 5.76, 5.9, 20.71, 30.4001783, -86.6999386),
    8: ([(30.4, -86.7, 60), (30.400539, -86.7, 85)], "too_far_from_cams", 60.0, 25.0, 0.0, 122.95, 141.44, 30.4006353, -86.6987243),
    9: ([(30.4, -86.7, 5), (30.4000898, -86.7, 30), (30.4001078, -86.7, 90)], "collapsed_onto_track", 12.0, 85.0, 0.04, 1.09, 12.03, 30.4001076, -86.6999886),
    10: ([(30.4, -86.7, 45)], "too_few_bearings", None, None, None, None, None, None, None),
}


def test_triangulation_gates(spark):
    rows = [(0, "pole", c * 100, c * 100 + k, k, float(lat), float(lng), 0.0, float(b)) for c, (rays, *_) in RAYS.items() for k, (lat, lng, b) in enumerate(rays)]
    members = spark.createDataFrame(rows, "job_id long, class string, cluster_id long, entry_seq long, frame_id long, cam_lat double, cam_lng double, cam_bearing double, obj_bearing double")
    for r in triangulate.triangulated(members).collect():
        _, reason, *want = RAYS[r.cluster_id // 100]
        assert r.reject_reason == reason and r.status == ("rejected" if reason else "ok")
        assert [r.baseline_m, r.spread_deg, r.residual_m, r.closest_m, r.farthest_m] == pytest.approx(want[:5], abs=0.011) if reason != "singular_matrix" and want[0] else True
        if want[5] is not None:
            assert (r.raw_lat, r.raw_lon) == (pytest.approx(want[5], abs=2e-7), pytest.approx(want[6], abs=2e-7))


def interpolate(points, t):
    """The rule written as a loop: points are (t, lat), sorted."""
    if not points or t < points[0][0] - 300 or t > points[-1][0] + 300:
        return None
    if t < points[0][0]:
        d = points[0][0] - t
        if d > 60 or len(points) < 2:
            return points[0][1]
        return points[0][1] - d / max(points[1][0] - points[0][0], 0.001) * (points[1][1] - points[0][1])
    if t > points[-1][0]:
        d = t - points[-1][0]
        if d > 60 or len(points) < 2:
            return points[-1][1]
        return points[-1][1] + d / max(points[-1][0] - points[-2][0], 0.001) * (points[-1][1] - points[-2][1])
    for (a, x), (b, y) in zip(points, points[1:]):
        if a <= t <= b:
            return x + ((t - a) / (b - a) if b > a else 0) * (y - x)
    return None


def test_interpolation_equals_loop(spark):
    rng = random.Random(3)
    points, asks, want = [], [], {}
    for job in range(25):
        n = rng.choice([1, 2, 3, 8])
        p = sorted((rng.randrange(0, 40) * 10, rng.random()) for _ in range(n))
        p = [(t, x) for t, x in sorted(p, key=lambda q: q[0])]
        points += [(job, k, t, x) for k, (t, x) in enumerate(p)]
        for k, t in enumerate([p[0][0], p[-1][0], p[0][0] - 60, p[0][0] - 61, p[-1][0] + 300, p[-1][0] + 301, p[-1][0] + 59, *rng.sample(range(400), 6)]):
            asks.append((job, k, t))
            want[job, k] = interpolate(p, t)
    tr = spark.createDataFrame(points, "job_id long, pt_seq long, sec long, lat double").withColumns({"ts": F.timestamp_seconds("sec"), "lng": F.lit(0.0), "ele": F.lit(0.0)})
    tm = spark.createDataFrame(asks, "job_id long, frame_idx long, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    got = {(r.job_id, r.frame_idx): r.lat for r in track.interpolated(tr, tm).collect()}
    for k, v in want.items():
        assert got[k] == (pytest.approx(v, abs=1e-9) if v is not None else None)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()))
    parent = {}
    for a, b in edges:
        if a is not None and a != b:
            parent.setdefault(a, a), parent.setdefault(b, b)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a in parent and b in parent:
            r, q = root(a), root(b)
            parent[max(r, q)] = min(r, q)
    assert got == {n: root(n) for n in parent}


def greedy(rows):
    """Ids that the greedy pass drops, asset by asset. rows: id, score and the ids in conflict with it, in order."""
    place = {r[0]: k for k, r in enumerate(rows)}
    gone = set()
    for i, (_, score, others) in enumerate(rows):
        if i in gone:
            continue
        for j in sorted(place[c] for c in others):
            if j in gone:
                continue
            if rows[j][1] > score:
                gone.add(i)
                break
            gone.add(j)
    return sorted(rows[k][0] for k in gone)


def suppressed(spark, n, pairs, scores, **how):
    """Ids that kept_assets drops and those that the loop drops: assets 0 to n - 1, of classes by turns of three."""
    cls = [f"c{k % 3}" for k in range(n)]
    a = spark.createDataFrame([(0, cls[k], k, scores[k][0], scores[k][1]) for k in range(n)], "job_id long, class string, cluster_id long, confidence double, num_detections_merged long")
    seen = spark.createDataFrame([(0, f"c{k}", e) for k, e in ((0, 5), (1, 2), (2, 9))], "job_id long, class string, entry_seq long")
    edges = spark.createDataFrame(pairs + pairs[:3], "a long, b long") if pairs else spark.createDataFrame([], "a long, b long")
    kept = {r.cluster_id for r in suppress.kept_assets(a, edges, seen, **how).collect()}
    against = {k: set() for k in range(n)}
    for x, y in pairs:
        against[x].add(y), against[y].add(x)
    order = sorted(range(n), key=lambda k: ({"c0": 5, "c1": 2, "c2": 9}[cls[k]], k))
    return sorted(set(range(n)) - kept), greedy([(k, scores[k], against[k]) for k in order])


def test_greedy_suppression(spark):
    assert greedy([(10, (3.0, 1), [20]), (20, (2.0, 1), [10, 30]), (30, (1.0, 1), [20])]) == [20]
    assert greedy([(10, (1.0, 2), [20]), (20, (1.0, 2), [10])]) == [20]


@pytest.mark.parametrize("together", [0, 40, 1_000_000])
def test_rounds_of_suppression_equal_the_loop(spark, together):
    """Chains with rising and falling scores, stars, cliques and random graphs with ties, all in one; with rounds to the end, some, and none."""
    rng = random.Random(21)
    pairs, scores, n = [], [], 0

    def add(size, edges, score):
        nonlocal n
        pairs.extend((n + x, n + y) for x, y in edges)
        scores.extend(score(k) for k in range(size))
        n += size

    tie = lambda k: (rng.choice([0.1, 0.5, 0.9]), rng.randint(1, 2))
    add(12, [(k, k + 1) for k in range(11)], lambda k: (k / 20, 1))
    add(12, [(k, k + 1) for k in range(11)], lambda k: (1 - k / 20, 1))
    add(60, [(k, k + 1) for k in range(59)], tie)
    add(50, [(0, k) for k in range(1, 50)], lambda k: (0.5 if k == 0 else 0.4 + k / 1000, 1))
    add(50, [(49, k) for k in range(49)], tie)
    add(9, [(x, y) for x in range(9) for y in range(x)], tie)
    for _ in range(15):
        size = rng.randint(2, 25)
        add(size, sorted({tuple(sorted(rng.sample(range(size), 2))) for _ in range(rng.randint(1, 3 * size))}), tie)
    add(5, [], tie)
    got, want = suppressed(spark, n, pairs, scores, together=together)
    assert got == want and 50 < len(want) < n


def test_suppression_of_odd_rows(spark):
    assert suppressed(spark, 3, [], [(0.5, 1)] * 3) == ([], [])
    a = spark.createDataFrame([(0, "pole", 1, None, 1), (0, "tree", 2, 0.5, 1), (0, "sign", 3, 0.1, 1)], "job_id long, class string, cluster_id long, confidence double, num_detections_merged long")
    seen = spark.createDataFrame([(0, "pole", 1), (0, "tree", 2)], "job_id long, class string, entry_seq long")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 99), (None, 1)], "a long, b long")
    for together in (0, 100):
        assert sorted(r.cluster_id for r in suppress.kept_assets(a, pairs, seen, together).collect()) == [1, 3]
    with pytest.raises(RuntimeError):
        suppress.kept_assets(a, pairs, seen, 0, 0)


def everywhere(seed, n):
    """Entries in dense heaps at the equator, mid-latitudes, the date line and near a pole, with repeated points; some lack a value."""
    rng = random.Random(seed)
    heaps = [(0.0, 0.0), (30.4, -86.7), (-55.0, 180.0), (64.0, -179.99999), (89.9999, 10.0), (-89.99999, -40.0)]
    rows = []
    for k in range(n):
        la, lo = rng.choice(heaps)
        far = 1e-4 / max(math.cos(math.radians(la)), 1e-6)
        rows.append((k % 2, rng.choice(["pole", "valve", "sidewalk", "unknown"]), k, rng.choice([0.0, 6.0, rng.uniform(0, 30)]), round(max(-90.0, min(90.0, la + rng.uniform(-1e-4, 1e-4))), 6), (lo + rng.uniform(-far, far) + 180) % 360 - 180))
    rows += [(*rows[k][:2], n + k, *rows[k][3:]) for k in range(20)]
    return rows + [(None, "pole", 9001, 0.0, 0.0, 0.0), (0, None, 9002, 0.0, 0.0, 0.0), (0, "pole", 9003, None, 0.0, 0.0), (0, "pole", 9004, 0.0, None, 0.0), (0, "pole", 9005, 0.0, 0.0, None)]


ENTRY = "job_id long, class string, entry_seq long, timestamp double, lat double, lon double"


def all_links(rows):
    eps = {c[1]: c[4] or P.DEFAULT_EPS_FT for c in P.CLASSES}
    out = set()
    whole = [r for r in rows if None not in r]
    for i, x in enumerate(whole):
        for y in whole[i + 1 :]:
            if x[0] == y[0] and x[1] == y[1] and abs(x[3] - y[3]) <= P.TIME_GATE_S:
                p, q, d = math.radians(x[4]), math.radians(y[4]), math.radians(y[5] - x[5])
                h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2
                if 2 * P.EARTH_FT * math.asin(math.sqrt(h)) <= eps.get(x[1], P.DEFAULT_EPS_FT):
                    out.add((min(x[2], y[2]), max(x[2], y[2])))
    return out


def roots(rows, edges):
    parent = {r[2]: r[2] for r in rows}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        r, q = root(a), root(b)
        parent[max(r, q)] = min(r, q)
    return {x: root(x) for x in parent}


def test_pairs_by_cells_equal_all_pairs(spark):
    rows = everywhere(5, 900)
    got = [(r.a, r.b) for r in cluster.proximity_pairs(spark.createDataFrame(rows, ENTRY), P.class_params(spark)).collect()]
    assert len(got) == len(set(got)) and set(got) == all_links(rows) and len(got) > 1000


@pytest.mark.parametrize("tries", [32, 0.02])
def test_clusters_by_cells_equal_those_of_all_pairs(spark, monkeypatch, tries):
    """With cells tried member by member, and with cells that are cut and cut again."""
    monkeypatch.setattr(links, "TRIES", tries)
    monkeypatch.setattr(links.links, "__defaults__", (P.TIME_GATE_S, tries, 60))
    rows = everywhere(6, 900)
    got = {r.entry_seq: r.cluster_id for r in cluster.linked(spark.createDataFrame(rows, ENTRY).repartition(4), P.class_params(spark)).collect()}
    assert got == roots(rows, all_links(rows))
    assert 20 < len(set(got.values())) < 700


def test_links_are_linear_on_a_dense_scene(spark):
    """Ten times the entries on one spot: pairs grow a hundredfold, candidates with them, links hardly."""
    found = []
    for n in (300, 3000):
        rng = random.Random(7)
        e = spark.createDataFrame([(0, "sidewalk", k, rng.uniform(0, 20), 30.4 + rng.uniform(0, 3e-4), -86.7 + rng.uniform(0, 3e-4)) for k in range(n)], ENTRY)
        scratch = Scratch(spark)
        rows = scratch.write(links.keyed(e, P.class_params(spark)), "rows")
        c = scratch.write(links.cells(rows), "cells")
        assert c.agg(F.sum("n")).first()[0] == n
        edges = links.links(rows, c, scratch).count()
        pairs = cluster.proximity_pairs(e, P.class_params(spark))
        kept = pairs.count()
        assert edges <= 50 * c.count()
        found.append((edges, kept))
    assert found[1][1] > 60 * found[0][1] and found[1][0] < 4 * found[0][0]


def test_few_copies_of_cells_are_moved(spark):
    """A cell looks for its neighbours in a few blocks, and meets a bounded number of cells there however dense a scene is."""
    rng = random.Random(11)
    for n, wide in ((2000, 1.0), (2000, 2e-4), (8000, 2e-4)):
        e = spark.createDataFrame([(0, "pole", k, rng.uniform(0, 60), 30.4 + rng.uniform(0, wide), -86.7 + rng.uniform(0, wide)) for k in range(n)], ENTRY)
        c = links.cells(links.keyed(e, P.class_params(spark)))
        left, right = links.around(c), links.in_blocks(c)
        cells = right.count()
        assert left.count() < 6 * cells
        met = left.alias("x").join(right.alias("y"), ["job_id", "class", "slots", "blocks", "block"]).count()
        assert met < 6 * links.SLOTS * (links.BLOCK + 1) ** 2 * cells


def test_candidates_are_a_few_times_the_pairs(spark):
    """Entries that share a cell of the join for each pair that is kept, however dense the scene."""
    for n in (500, 4000):
        rng = random.Random(8)
        e = spark.createDataFrame([(0, "pole", k, rng.uniform(0, 60), 30.4 + rng.uniform(0, 4e-4), -86.7 + rng.uniform(0, 4e-4)) for k in range(n)], ENTRY)
        pairs = cluster.proximity_pairs(e, P.class_params(spark))
        kept = pairs.count()
        wide = cluster.proximity_pairs(e.withColumn("class", F.lit("sidewalk")), P.class_params(spark), 12.0).count()
        assert kept and wide > kept
        met = pairs_met(e, P.class_params(spark))
        assert met < 20 * kept


def pairs_met(e, params):
    """Pairs of entries whose keys meet in proximity_pairs, from its own plan without the tests of distance and time."""
    old = cluster.haversine_ft
    cluster.haversine_ft = lambda *a: F.lit(0.0)
    try:
        return cluster.proximity_pairs(e, params).count()
    finally:
        cluster.haversine_ft = old


def test_repeated_entries_are_refused(spark):
    e = spark.createDataFrame([(0, "pole", 1, 0.0, 30.0, -86.0), (1, "tree", 1, 0.0, 31.0, -86.0)], ENTRY)
    with pytest.raises(ValueError):
        cluster.linked(e, P.class_params(spark))
    assert cluster.linked(e.limit(0), P.class_params(spark)).collect() == []


def test_widest_gap_equals_all_pairs(spark):
    """Ties go to the first pair by entry_seq; repeated bearings, opposite ones, halves of the circle, one or two rays."""
    rng = random.Random(12)
    rows = []
    for c in range(120):
        kind = c % 6
        pool = [[rng.randrange(3600) / 10 for _ in range(40)], [0.0, 90.0, 180.0, 270.0, 360.0], [k / 10 for k in range(300, 900)], [359.9, 0.0, 0.1, 179.9, 180.1], [12.5], [k * 0.5 for k in range(720)]][kind]
        seqs = rng.sample(range(c * 1000, c * 1000 + 1000), rng.choice([1, 2, 3, 9, 60]))
        rows += [(c, s, rng.choice(pool)) for s in seqs]
    rays = spark.createDataFrame(rows, "cluster_id long, entry_seq long, obj_bearing double")
    got = {r.cluster_id: (r.spread_deg, r.a, r.b) for r in triangulate.spread(rays.repartition(3)).collect()}
    want = {}
    for c in range(120):
        mine = sorted((s, b) for k, s, b in rows if k == c)
        best = None
        for i, (s, x) in enumerate(mine):
            for t, y in mine[i + 1 :]:
                d = abs(x % 360 - y % 360)
                d = min(d, 360 - d)
                if best is None or d > best[0]:
                    best = (d, s, t)
        if best:
            want[c] = best
    assert {c: (pytest.approx(v[0], abs=1e-9), *v[1:]) for c, v in want.items()} == got


def test_widest_gap_by_joins_that_shuffle(spark):
    """Tables too large to broadcast: rays that a join left dealt by cluster."""
    rows = [(c, c * 10 + k, 30.0 + k / 1e4, -86.0, 20.0 * k) for c in range(50) for k in range(4)]
    m = spark.createDataFrame(rows, "cluster_id long, entry_seq long, cam_lat double, cam_lng double, obj_bearing double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = triangulate.spread(triangulate.local_rays(m)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((r.cluster_id, r.spread_deg, r.a, r.b) for r in got) == [(c, 60.0, c * 10, c * 10 + 3) for c in range(50)]


def test_chain_spans_more_than_the_gate(spark):
    rows = [(0, "pole", k, float(k * 5), 30.4 + k * 4e-5, -86.7) for k in range(6)] + [(0, "pole", 50, 3.0, 31.0, -86.7)]
    e = spark.createDataFrame(rows, "job_id long, class string, entry_seq long, timestamp double, lat double, lon double")
    pairs = cluster.proximity_pairs(e, P.class_params(spark))
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(k, k + 1) for k in range(5)]
    got = {r.entry_seq: r.cluster_id for r in cluster.clustered(e, pairs).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 50: 50}


def test_sources(spark, tmp_path):
    (tmp_path / "a.gpx").write_text('<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="1.5" lon="2.5"><time>2026-01-01T00:00:05Z</time></wpt><trk><trkseg><trkpt lat="1.0" lon="2.0"><ele>3.0</ele><time>2026-01-01T00:00:00</time></trkpt><trkpt lat="1.1" lon="2.1"><time>2026-01-01T00:00:10Z</time></trkpt><trkpt lat="9" lon="9"></trkpt></trkseg></trk></gpx>')
    got = [(r.pt_seq, r.lat, r.lng, r.ele) for r in gpx.gpx_points(spark, str(tmp_path / "a.gpx")).orderBy("pt_seq").collect()]
    assert got == [(0, 1.0, 2.0, 3.0), (1, 1.5, 2.5, 0.0), (2, 1.1, 2.1, 0.0)]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "f_1.txt").write_text("3 0.5 0.5 0.1 0.2 0.9\nbad 1 2 3 4\n1 2 3\n\n2 .5 .5 .1 .2\n1 0.5 0.5 0.1 0.2 nope\n")
    got = [(r.stem, r.line_no, r.class_id, r.confidence) for r in labels.label_files(spark, str(tmp_path / "labels")).orderBy("line_no").collect()]
    assert got == [("f_1", 0, 3, 0.9), ("f_1", 4, 2, 0.0)]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("../evil.jpg", b"")
    with pytest.raises(ValueError):
        archive.zip_frames(spark, str(tmp_path / "x.zip"))
    (tmp_path / "frames").mkdir()
    for n in ("b.jpg", "a.PNG", "c.JPEG"):
        (tmp_path / "frames" / n).write_bytes(n.encode())
    f = listing.frames(spark, str(tmp_path / "frames"))
    assert sorted(r.path.rsplit("/", 1)[1] for r in f.select("path").collect()) == ["a.PNG", "b.jpg"]
    f = f.select(F.lit(0).cast("long").alias("job_id"), F.monotonically_increasing_id().alias("frame_idx"), "content")
    assert hooks.detect(f, hooks.stub_detector, 0.0).count() == 2
    texts = hooks.recognize(f, lambda: lambda c, region: "ok" if region == "top" else "", bool).collect()
    assert {(r.bottom, r.top, r.full) for r in texts} == {("", "ok", None)}


def test_engine_writes_all_files(spark, tmp_path):
    boxes = scenes.scene(spark, "/root/testdata/sf0.001").where("job_id < 2")
    engine = Engine(spark, f"file://{tmp_path}")
    run = engine.run(boxes)
    assert engine.status(run)["status"] == "complete"
    assets = spark.read.option("header", True).csv(engine.artifact(run, "assets_csv"))
    assert assets.columns == list(sinks.ASSETS_COLUMNS) and assets.count() > 0
    assert spark.read.option("header", True).csv(engine.artifact(run, "tri_debug_csv")).columns == list(sinks.DEBUG_COLUMNS)
    kml = (tmp_path / run / "detections.kml").read_text()
    line = ElementTree.fromstring(kml.encode())[0].findall("{*}Placemark/{*}LineString/{*}coordinates")
    assert len(line) == 2 and all(len(x.text.split()) > 2 for x in line)
    raw = json.loads((tmp_path / run / "detections_raw.json").read_text())
    order = [(r["job_id"], r["entry_seq"]) for r in raw]
    assert order == sorted(order) and len(raw) > assets.count()
    done = spark.read.parquet(f"{tmp_path}/{run}/summary").collect()
    log = (tmp_path / run / "calibration.log").read_text()
    assert sum(r.lines_count for r in done) == log.count("\n[") and all(r.last_lines[-1].startswith("[PATH]") and r.last_lines[-1] in log for r in done)
    assert kml.count("<Placemark>") == kml.count("</Placemark>") > assets.count()
    found = json.loads((tmp_path / run / "detections_deduped.geojson").read_text())
    assert found["type"] == "FeatureCollection" and len(found["features"]) == assets.count()
    with pytest.raises(KeyError):
        engine.status("none")
    crops = spark.createDataFrame([("a.jpg", bytearray(b"x"))], "name string, content binary")
    with zipfile.ZipFile(engine.kmz(run, f"{tmp_path}/out.kmz", crops)) as z:
        assert set(z.namelist()) == {"doc.kml", "calibration.log", "images/a.jpg"}
        doc, log = z.read("doc.kml").decode(), z.read("calibration.log").decode()
    assert doc.startswith("<?xml") and doc.rstrip().endswith("</kml>") and doc.count("<Placemark>") == kml.count("<Placemark>")
    assert log.startswith("# calibration log for job") and "#   pole: 1.55" in log and "[PATH]" in log


def test_stream(spark, tmp_path):
    boxes = scenes.scene(spark, "/root/testdata/sf0.001").withColumn("event_time", F.timestamp_seconds(F.col("ts").cast("long")))
    boxes.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(boxes.schema).parquet(f"{tmp_path}/in")
    kept = live.live_detections(stream, P.class_params(spark))
    q = live.counts_by_minute(kept).writeStream.format("memory").queryName("minutes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("minutes").agg(F.sum("n")).first()[0] == live.live_detections(boxes, P.class_params(spark)).count()


def test_scene_registers(spark):
    from kerbside import oracles, queries

    assert set(oracles.oracle_sql()) <= set(queries.queries())
    assert math.isclose(P.EARTH_FT, 20_902_231.0)


def test_run_from_frames(spark, tmp_path):
    """Detector, text and GPS track together: frames without a readable text take the track's position."""
    rows = [(0, k, 1767225600 + k, float(k), bytearray([k % 7, 30]), 1080, 1920) for k in range(12)]
    frames = spark.createDataFrame(rows, "job_id long, frame_idx long, sec long, offset_sec double, content binary, image_w_px int, image_h_px int").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    points = spark.createDataFrame([(0, k, 1767225600 + 4 * k, 30.5, -86.5, 1.0) for k in range(4)], "job_id long, pt_seq long, sec long, lat double, lng double, ele double").withColumn("ts", F.timestamp_seconds("sec"))
    reader = lambda: lambda content, region: "Position: +030.40972 / -086.71261 Bearing: 12" if content[0] % 2 and region == "bottom" else ""
    engine = Engine(spark, f"file://{tmp_path}")
    run = engine.run_frames(frames, hooks.stub_detector, reader, points)
    s = spark.read.parquet(f"{tmp_path}/{run}/summary").first()
    assert (s.frames_processed, s.ocr_hits, s.gpx_hits, s.ocr_misses_count) == (12, 5, 7, 7) and s.ocr_misses.startswith("0|2|4")
    assert s.raw_detections == 12


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4) + b"IHDR" + w.to_bytes(4) + h.to_bytes(4) + b"\x08\x02\0\0\0"


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc2\x00\x0b\x08" + h.to_bytes(2) + w.to_bytes(2) + b"\x03" + bytes(9)


def test_image_sizes():
    assert media.image_size(png(640, 480)) == (640, 480) and media.image_size(jpeg(1080, 1920)) == (1080, 1920)
    for bad in (None, b"", b"GIF89a", b"\xff\xd8\xff", png(1, 1)[:20], b"\xff\xd8\x00\x00" * 9):
        assert media.image_size(bad) is None


def test_zip_is_read_by_tasks(spark, tmp_path):
    made = {f"day/{k:03d}.{('jpg', 'PNG', 'jpeg')[k % 3]}": bytes([k % 251]) * (500 + k) for k in range(40)}
    with zipfile.ZipFile(tmp_path / "f.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in made.items():
            z.writestr(name, content)
        z.writestr("day/notes.txt", b"no image")
        z.writestr("day/sub/", b"")
    for where in (str(tmp_path / "f.zip"), f"file://{tmp_path}/f.zip"):
        f = archive.zip_frames(spark, where, part_bytes=100)
        assert f.rdd.getNumPartitions() > 3
        assert {r.path: bytes(r.content) for r in f.collect()} == made
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    assert archive.zip_frames(spark, str(tmp_path / "none.zip")).collect() == []
    for name in ("/etc/a.jpg", "a/../../b.jpg", "c:\\d.jpg", "..\\e.jpg"):
        with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
            z.writestr(name, b"")
        with pytest.raises(ValueError):
            archive.zip_frames(spark, str(tmp_path / "bad.zip"))


def test_run_from_a_zip_and_a_folder(spark, tmp_path):
    """An unreadable image takes its place in the order; times are those of tags, else of the start and the place."""
    images = {"b/1.png": png(1080, 1920), "b/2.jpg": b"broken", "b/3.JPG": jpeg(1080, 1920), "a/9.png": png(1080, 1920) + b"tagged"}
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        for name, content in images.items():
            z.writestr(name, content)
            (tmp_path / "in" / name).parent.mkdir(exist_ok=True)
            (tmp_path / "in" / name).write_bytes(content)
    reader = lambda: lambda content, region: ""
    tags = lambda: lambda content: ("2026:05:06 07:08:09" if content.endswith(b"tagged") else None, None)
    engine = Engine(spark, f"file://{tmp_path}/out")
    points = spark.createDataFrame([(0, k, 1767225600 + 4 * k, 30.5, -86.5, 1.0) for k in range(4)], "job_id long, pt_seq long, sec long, lat double, lng double, ele double").withColumn("ts", F.timestamp_seconds("sec"))
    for path in (f"{tmp_path}/f.zip", f"{tmp_path}/in"):
        run = engine.run_dir(path, hooks.stub_detector, reader, points, 2.0, "2026-01-01T00:00:00+05:00", tags)
        s = spark.read.parquet(f"{tmp_path}/out/{run}/summary").first()
        assert (s.frames_processed, s.gpx_hits, s.ocr_misses) == (3, 2, "0|1|3")


def test_clock(spark):
    from datetime import UTC, datetime

    from kerbside.engine import start_time

    points = spark.createDataFrame([(1767225600,), (1767225590,)], "sec long").select(F.timestamp_seconds("sec").alias("ts"))
    probe = datetime(2026, 2, 3, tzinfo=UTC)
    assert start_time("2026-01-02T03:04:05+09:00", probe, points) == datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC)
    assert start_time(None, probe, points) == probe and start_time(None, None, points).timestamp() == 1767225590
    assert abs(start_time(None, None, points.limit(0)).timestamp() - datetime.now(UTC).timestamp()) < 60


def test_summary_of_jobs_without_boxes(spark):
    frames = spark.createDataFrame([(1, 0, None, " x "), (2, 0, "ocr", "")], "job_id long, frame_idx long, gps_source string, top_text string")
    none = spark.createDataFrame([], "job_id long, cam_lat double")
    got = {r.job_id: r for r in job_summary(frames, none, none, none).collect()}
    assert (got[1].raw_detections, got[1].hint, got[1].ocr_samples, got[2].ocr_hits, got[2].ocr_misses) == (0, "no boxes", "0:x", 1, "")


def test_parameters_of_classes_win_over_columns_of_rows(spark):
    p = P.class_params(spark)
    rows = spark.createDataFrame([(2, 0.3, 0.1, "keep"), (2, 0.7, 0.9, "keep"), (None, None, 0.0, "x")], "class_id int, confidence double, min_conf double, height_m string")
    got = detect.confident(detect.named(rows, p), p).collect()
    assert [(r.confidence, r.min_conf, r.height_m) for r in got] == [(0.7, 0.9, "keep")]


def test_interpolation_over_many_slots(spark):
    """One job with 10,000 points and gaps of several slots against the loop."""
    rng = random.Random(8)
    p, t = [], 0
    for _ in range(10_000):
        t += rng.choice([1, 7, 7, 7, 60] if rng.random() < 0.999 else [20_000])
        p.append((t, rng.random()))
    tr = spark.createDataFrame([(0, k, t, x) for k, (t, x) in enumerate(p)], "job_id long, pt_seq long, sec long, lat double").withColumns({"ts": F.timestamp_seconds("sec"), "lng": F.lit(0.0), "ele": F.lit(0.0)})
    asks = [rng.randrange(-400, p[-1][0] + 400) for _ in range(400)] + [a + 10_000 for (a, _), (b, _) in zip(p, p[1:]) if b - a == 20_000]
    tm = spark.createDataFrame([(0, k, a) for k, a in enumerate(asks)] + [(None, 900, 5), (7, 901, 5)], "job_id long, frame_idx long, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    got = {r.frame_idx: r.lat for r in track.interpolated(tr, tm).collect()}
    assert len(got) == len(asks) + 2 and got[900] is None and got[901] is None
    times = [t for t, _ in p]
    for k, a in enumerate(asks):
        i = min(max(bisect.bisect_left(times, a), 1), len(p) - 1)
        want = interpolate(p if not p[0][0] <= a <= p[-1][0] else p[i - 1 : i + 1], a)
        assert got[k] == (pytest.approx(want, abs=1e-9) if want is not None else None)


def test_conflicts_equal_all_pairs(spark):
    rng = random.Random(9)
    near = [(60.0, 179.99999), (60.0, -179.99999), (0.0, 0.0), (-45.0, 10.0)]
    rows = []
    for k in range(240):
        la, lo = rng.choice(near)
        t = sorted(rng.choices(range(0, 400), k=2))
        rows.append((k % 2, ("pole", "tree", "street_light")[k % 3], k, la + rng.uniform(-3e-4, 3e-4), lo + rng.uniform(-3e-4, 3e-4), [float(x) for x in t]))
    rows += [(0, "pole", 900, None, None, [0.0]), (0, "tree", 901, 0.0, 0.0, None)]
    a = spark.createDataFrame(rows, "job_id long, class string, cluster_id long, lat double, lon double, members_video_sec array<double>")
    got = sorted((r.a, r.b) for r in suppress.conflict_pairs(a, P.confusion_pairs(spark)).collect())
    x, y = a.alias("x"), a.alias("y")
    d = geo.haversine_ft(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon"))
    every = x.join(y, (F.col("x.job_id") == F.col("y.job_id")) & (F.col("x.cluster_id") < F.col("y.cluster_id")) & (d <= P.CONFLICT_FT)).select("x.class", "y.class", "x.cluster_id", "y.cluster_id", "x.members_video_sec", "y.members_video_sec").collect()
    confused = {frozenset(p) for p in P.CONFUSED}
    want = sorted((r[2], r[3]) for r in every if frozenset((r[0], r[1])) in confused and r[4] and r[5] and r[4][0] - 8 <= r[5][-1] and r[5][0] - 8 <= r[4][-1])
    assert got == want and len(got) > 30


def test_baseline_equals_all_pairs(spark):
    rng = random.Random(10)
    rows = [(c, rng.gauss(0, 9), rng.gauss(0, 9)) for c in range(30) for _ in range(rng.choice([1, 2, 3, 5, 40, 300]))] + [(99, 1.0, 1.0)] * 4 + [(98, float(k), 2.0 * k) for k in range(50)]
    got = {r.cluster_id: r.baseline_m for r in triangulate.baseline(spark.createDataFrame(rows, "cluster_id long, x double, y double").repartition(3)).collect()}
    by = {}
    for c, x, y in rows:
        by.setdefault(c, []).append((x, y))
    assert got == {c: pytest.approx(max(math.dist(p, q) for p in v for q in v), abs=1e-9) for c, v in by.items() if len(v) > 1}


def test_greedy_over_chains(spark):
    """Components of three and more: the pass takes assets in the order of class first seen, then cluster."""
    def asset(k, cls, conf, n=1):
        return (0, cls, k, conf, n)

    rows = [asset(1, "pole", 0.5), asset(2, "tree", 0.6), asset(3, "pole", 0.7), asset(4, "tree", 0.8), asset(9, "pole", 0.1)]
    a = spark.createDataFrame(rows, "job_id long, class string, cluster_id long, confidence double, num_detections_merged long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    seen = spark.createDataFrame([(0, "pole", 1), (0, "tree", 2)], "job_id long, class string, entry_seq long")
    assert sorted(r.cluster_id for r in suppress.kept_assets(a, pairs, seen).collect()) == [4, 9]
    assert suppress.kept_assets(a.limit(0), pairs.limit(0), seen).count() == 0


def test_components_fail_when_unsettled(spark):
    rows = [(k, k + 1) for k in range(300)]
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(rows, "a long, b long").repartition(9), Scratch(spark), max_rounds=0)


def test_skewed_groups_meet_once(spark, monkeypatch):
    from kerbside.plans import skew

    monkeypatch.setattr(skew, "HEAVY", 5)
    rows = [(k, "hot" if k % 3 else f"k{k % 50}") for k in range(300)] + [(900, None), (901, "none")]
    r = spark.createDataFrame(rows, "id long, key string")
    groups = r.where("key IS NOT NULL AND key <> 'none'").groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("c"))
    got = sorted((x.id, x.low) for x in skew.join_groups(r, groups, "key", "c", 302).collect())
    low = {}
    for i, k in rows[:300]:
        low.setdefault(k, i)
    assert got == [(i, low[k]) for i, k in rows[:300]]


@pytest.mark.parametrize("staged", [False, True])
def test_documents_are_one_file_by_many_tasks(spark, tmp_path, monkeypatch, staged):
    rows = spark.range(20_000).select(F.lit(4).alias("ord"), sinks.order_key("id").alias("key"), F.col("id").cast("string").alias("value")).orderBy(F.rand(1))
    at = f"file://{tmp_path}/folder/doc.txt"
    for _ in range(2):  # the second replaces the first
        sinks.write_text(rows, at, staged)
    assert (tmp_path / "folder" / "doc.txt").read_text() == "".join(f"{i}\n" for i in range(20_000))
    assert [p.name for p in (tmp_path / "folder").iterdir()] == ["doc.txt"]
    odd = spark.createDataFrame([(1, ["a"], None), (1, ["b"], "é\nz"), (0, [], ""), (1, ["b"], "é\nz")], sinks.ROWS)
    sinks.write_text(odd, f"file://{tmp_path}/odd", staged)
    assert (tmp_path / "odd").read_text() == "\né\nz\né\nz\n"
    sinks.write_text(odd.limit(0), f"file://{tmp_path}/none", staged)
    assert (tmp_path / "none").read_bytes() == b""


@pytest.mark.parametrize("staged", [False, True])
def test_failed_documents_leave_no_file(spark, tmp_path, staged):
    pieces = spark.range(0, 40, 1, 4).select((F.col("id") * 3).alias("offset"), F.encode(F.format_string("%03d", "id"), "utf-8").alias("content"))
    fails = pieces.withColumn("content", F.when(F.col("offset") == 90, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    for rows, size in ((fails, 120), (pieces, 121), (pieces, 119)):
        with pytest.raises(Exception):
            documents.write_at(rows, f"file://{tmp_path}/doc", size, staged)
        assert list(tmp_path.iterdir()) == []
    documents.write_at(pieces, f"file://{tmp_path}/doc", 120, staged)
    assert (tmp_path / "doc").read_text() == "".join(f"{i:03d}" for i in range(40))


def test_joined_checksums():
    rng = random.Random(5)
    for a, b in ((0, 0), (1, 0), (0, 1), (5, 1), (1, 70_000), (333, 4096)):
        x, y = rng.randbytes(a), rng.randbytes(b)
        assert documents.joined_crc(zlib.crc32(x), zlib.crc32(y), b) == zlib.crc32(x + y)


def test_archive_by_tasks(spark, tmp_path):
    text = "".join(f"line {i} of many\n" for i in range(30_000)).encode()
    (tmp_path / "a.kml").write_bytes(text)
    (tmp_path / "b.log").write_bytes(b"")
    images = spark.range(0, 70_000, 1, 8).select(F.concat(F.lit("images/é"), F.col("id").cast("string")).alias("name"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"))
    odd = spark.createDataFrame([(None, b"x"), ("none", None), ("empty", b"")], "name string, content binary")
    files = [("doc.kml", f"file://{tmp_path}/a.kml"), ("calibration.log", f"{tmp_path}/b.log")]
    documents.write_archive(spark, files, images.union(odd), f"file://{tmp_path}/out.kmz", piece=10_000)
    with zipfile.ZipFile(tmp_path / "out.kmz") as z:
        assert z.testzip() is None and len(z.namelist()) == 70_003 == len(set(z.namelist()))
        assert z.read("doc.kml") == text and z.read("calibration.log") == b"" == z.read("empty") and z.read("images/é69999") == b"69999"
        assert z.getinfo("doc.kml").compress_size < len(text) // 3
    documents.write_archive(spark, files[:1], None, f"{tmp_path}/small.kmz")
    with zipfile.ZipFile(tmp_path / "small.kmz") as z:
        assert z.testzip() is None and z.namelist() == ["doc.kml"] and z.read("doc.kml") == text
    documents.write_archive(spark, files[:1], odd.where("name = 'empty'"), f"file://{tmp_path}/staged.kmz", 10_000, True)
    with zipfile.ZipFile(tmp_path / "staged.kmz") as z:
        assert z.testzip() is None and z.namelist() == ["doc.kml", "empty"] and z.read("doc.kml") == text


def test_wide_records_of_archives(tmp_path):
    """Entries and places beyond 4 GB, read back from a file with a hole."""
    far, data = 5 << 30, b"abc"
    record = documents.local_record("x", 0, zlib.crc32(data), 3, 3) + data
    directory = documents.central_record("x", 0, zlib.crc32(data), 3, 3, far) + documents.central_record("huge", 0, 0, far - 200, far - 200, 0)
    with open(tmp_path / "z.zip", "wb") as f:
        f.write(documents.local_record("huge", 0, 0, far - 200, far - 200))
        f.seek(far)
        f.write(record + directory + documents.end_records(2, len(directory), far + len(record)))
    with zipfile.ZipFile(tmp_path / "z.zip") as z:
        assert z.read("x") == data and z.getinfo("huge").file_size == far - 200 and z.getinfo("x").header_offset == far


def test_track_lines_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sinks, "LINE_FRAMES", 7)
    frames = spark.range(100).select((F.col("id") % 3).alias("job_id"), (F.col("id") * 2).alias("frame_idx"), F.when(F.col("id") != 3, F.col("id").cast("double")).alias("cam_lat"), F.lit(2.5).alias("cam_lng"), F.when(F.col("id") % 2 == 0, 1.0).alias("ele"), F.col("id").cast("string").alias("timestamp_iso"))
    frames = frames.union(frames.where("frame_idx = 8").withColumn("job_id", F.lit(9)))  # one point makes no line
    marks = sinks.placemarks(sinks.asset_features(from_boxes(spark, scenes.scene(spark, "/root/testdata/sf0.001").limit(0)).assets))
    doc = "\n".join(r.value for r in sinks.kml_document("x", frames.orderBy(F.rand(2)), marks).orderBy("ord", "key", "value").collect())
    found = [x.text.split() for x in ElementTree.fromstring(doc.encode())[0].findall("{*}Placemark/{*}LineString/{*}coordinates")]
    point = lambda i: f"2.5,{i}.0,1.0" if i % 2 == 0 else f"2.5,{i}.0"
    assert found == [[point(i) for i in range(j, 100, 3) if i != 3] for j in range(3)]
    ends = {r.job_id: (r.start_iso, r.end_iso, r.n_points) for r in sinks.track_ends(frames).collect()}
    assert ends == {0: ("0", "99", 33), 1: ("1", "97", 33), 2: ("2", "98", 33)}


def test_csv_and_json_documents(spark, tmp_path):
    t = spark.createDataFrame([(2, 'a,"b"', None), (1, "", 1.5), (1, "", 1.5)], "id long, s string, x double")
    sinks.write_text(sinks.csv_document(t, ("s", "x"), "id"), f"{tmp_path}/t.csv")
    assert (tmp_path / "t.csv").read_text() == 's,x\n,1.5\n,1.5\n"a,""b""",\n'
    lines = t.select(sinks.order_key("id").alias("key"), F.to_json(F.struct("id", "s")).alias("value"))
    for rows in (lines, lines.limit(0), lines.where("value LIKE '%2%'")):
        sinks.write_text(sinks.json_list(rows), f"{tmp_path}/t.json")
        assert json.loads((tmp_path / "t.json").read_text()) == [json.loads(r.value) for r in rows.orderBy("key").collect()]


def test_row_keys(spark, tmp_path):
    spark.range(1000).repartition(5).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    once = {r.id: r._row for r in with_row_key(t).collect()}
    assert len(set(once.values())) == 1000 and once == {r.id: r._row for r in with_row_key(t).collect()}
    assert with_row_key(t).columns == ["id", "_row"]


def test_hooks_for_videos_and_images(spark):
    v = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b""))], "job_id long, content binary")
    f = hooks.decode(v, lambda: lambda c: (bytes([x]) for x in c))
    assert sorted((r.job_id, r.frame_idx, bytes(r.content)) for r in f.collect()) == [(1, 0, b"a"), (1, 1, b"b"), (1, 2, b"c")]

    def tags(content):
        if content == b"b":
            raise ValueError("no tags")
        return "2026:01:02 03:04:05", None

    got = hooks.image_tags(f, lambda: tags).orderBy("frame_idx").select(F.unix_seconds(media.exif_time(F.col("original"), F.col("changed"))).alias("t")).collect()
    assert [r.t for r in got] == [1767323045, None, 1767323045]
    kept = spark.createDataFrame([(1, 0, "x.jpg", (1, 2, 3, 4)), (1, 1, None, None)], "job_id long, frame_idx long, image_file string, rect struct<x0:int,y0:int,x1:int,y1:int>")
    got = hooks.cropped(f, kept, lambda: lambda c, *r: c + bytes(r)).collect()
    assert [(r.name, bytes(r.content)) for r in got] == [("x.jpg", b"a\x01\x02\x03\x04")]


MEMBERS = "job_id long, class string, cluster_id long, entry_seq long, frame_id long, timestamp double, class_id int, confidence double, lat double, lon double, bbox_area double, distance_m double, obj_bearing double, cam_lat double, cam_lng double, cam_bearing double, elevation_m double, gps_source string, image_file string, timestamp_iso string"


def member(cluster_id, entry_seq, **given):
    """A row of MEMBERS: a pole seen from 30 N, 86 W, with nulls where given says so."""
    row = {"job_id": 0, "class": "pole", "cluster_id": cluster_id, "entry_seq": entry_seq, "frame_id": entry_seq, "timestamp": float(entry_seq), "class_id": 0, "confidence": 0.5, "lat": 30.0001, "lon": -86.0, "bbox_area": 10.0, "distance_m": 12.0, "obj_bearing": 10.0 * entry_seq, "cam_lat": 30.0 + entry_seq * 1e-4, "cam_lng": -86.0, "cam_bearing": 0.0, "elevation_m": None, "gps_source": "ocr", "image_file": None, "timestamp_iso": None}
    return tuple((row | given).values())


def test_clusters_of_odd_rows(spark):
    """Nulls in what members are ranked, averaged and projected by, repeated rows, unknown classes, no rows."""
    p = P.class_params(spark)
    empty = dict.fromkeys(("frame_id", "timestamp", "confidence", "bbox_area", "distance_m", "obj_bearing", "cam_lat", "cam_lng", "cam_bearing"))
    rows = [member(1, 1, bbox_area=None, confidence=None), member(1, 2), member(1, 3, distance_m=None), member(1, 3, distance_m=None), member(2, 7, **empty), member(3, 8, **{"class": None}), member(4, 9, **{"class": "odd"})]
    m = spark.createDataFrame(rows, MEMBERS)
    assert {r.cluster_id for r in cluster.large_enough(m, p).collect()} == {1, 3, 4}
    order = {(r["class"], r.n, r.first_seq) for r in cluster.class_order(m).collect()}
    assert order == {("pole", 5, 1), (None, 1, 8), ("odd", 1, 9)}
    c = {r.cluster_id: r for r in cluster.summarized(m).collect()}
    assert (c[1].n, c[1].mean_conf, c[1].min_mono_m, c[1].closest.entry_seq, c[1].best.entry_seq) == (4, 0.375, 12.0, 2, 2)
    assert c[1].source_frames == [1, 2, 3, 3] and c[1].members_video_sec == [1.0, 2.0, 3.0] and c[1].unique_cam_pos == 3
    assert (c[2].n, c[2].mean_conf, c[2].min_mono_m, c[2].bearings, c[2].members_video_sec) == (1, 0.0, None, 0, [])
    t = {r.cluster_id: r for r in triangulate.triangulated(m).collect()}
    assert t[1].n_rays == 4 and [t[k].reject_reason for k in (2, 3, 4)] == ["too_few_bearings"] * 3
    a = {r.cluster_id: r for r in merge.placed(cluster.summarized(m), triangulate.triangulated(m), p).collect()}
    assert set(a) == {1, 2, 3, 4} and (a[2].lat, a[2].lon, a[2].coord_source) == (30.0001, -86.0, "cam_only")
    f = sinks.asset_features(merge.placed(cluster.summarized(m), triangulate.triangulated(m), p)).collect()
    assert len(f) == 4 and {(r.elevation_m, r.timestamp) for r in f} == {(0.0, "")}
    none = m.limit(0)
    assert [x.count() for x in (cluster.large_enough(none, p), cluster.class_order(none), cluster.summarized(none), triangulate.local_rays(none), triangulate.triangulated(none))] == [0] * 5


def test_summary_of_clusters_in_two_steps(spark):
    """Camera positions are counted beside the lists, with no aggregates of their own by position; equal ones once, 0.0 and -0.0 too."""
    rows = [(1, 1, 30.0, 0.0), (1, 2, 30.0, -0.0), (1, 3, 30.000001, 0.0), (1, 4, 30.1, 0.0), (1, 5, None, 0.0), (2, 6, None, None)]
    m = spark.createDataFrame([member(c, k, cam_lat=lat, cam_lng=lng) for c, k, lat, lng in rows], MEMBERS)
    got = cluster.summarized(m)
    assert {r.cluster_id: r.unique_cam_pos for r in got.collect()} == {1: 2, 2: 0} and got.schema["unique_cam_pos"].dataType.simpleString() == "bigint"
    assert got._jdf.queryExecution().sparkPlan().toString().count("ObjectHashAggregate") == 2


def test_tables_are_written_by_compiled_methods(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before, seen = spark.conf.get(name), []
    table = spark.range(3)
    schema = table.schema

    class Writer:
        write = property(lambda self: self)

        def parquet(self, path):
            seen.append(spark.conf.get(name))
            table.write.parquet(path)

    Writer.schema = schema
    assert Scratch(spark).write(Writer(), "x").count() == 3
    assert seen == ["8000"] and spark.conf.get(name) == before


def test_rays_that_are_repeated_or_alone(spark):
    """One ray has no solution, the same ray twice is singular, and neither has residuals."""
    rays = triangulate.local_rays(spark.createDataFrame([member(1, 1), member(2, 2), member(2, 2), member(3, 3), member(3, 4, obj_bearing=120.0)], MEMBERS))
    s = {r.cluster_id: r.singular for r in triangulate.solved(rays).collect()}
    assert s == {2: True, 3: False}
    assert [r.cluster_id for r in triangulate.residuals(rays, triangulate.solved(rays)).collect()] == [3]


def test_poses_and_indices_of_odd_rows(spark):
    frames = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (None, 1), (0, None)], "job_id long, frame_idx long")
    ocr = spark.createDataFrame([(0, 1, 30.0, -86.0, 5.0), (0, 2, None, None, 7.0)], "job_id long, frame_idx long, lat double, lng double, bearing double")
    gps = spark.createDataFrame([(0, 1, 1.0, 1.0, 9.0), (0, 2, 2.0, 2.0, 9.0)], "job_id long, frame_idx long, lat double, lng double, ele double")
    got = {(r.job_id, r.frame_idx): tuple(r)[2:] for r in track.resolved(frames, ocr, gps).collect()}
    assert got == {(0, 1): (30.0, -86.0, 0.0, 5.0, "ocr"), (0, 2): (2.0, 2.0, 9.0, 7.0, "gpx"), (0, 3): (None,) * 5, (None, 1): (None,) * 5, (0, None): (None,) * 5}
    files = spark.createDataFrame([(0, "b", True), (0, None, True), (0, "a", None), (0, "b", True), (1, "z", False)], "job_id long, path string, readable boolean")
    assert sorted((r.path or "", r.frame_idx) for r in track.indexed(files).collect()) == [("", 0), ("b", 2), ("b", 3)]
    assert track.resolved(frames.limit(0), ocr, gps).count() == track.indexed(files.limit(0)).count() == 0


def test_boxes_by_a_table_function(spark):
    rows = [(1, k, bytearray([k % 7, 30 + k]), f"u{k}", -1.0) for k in range(40)] + [(2, 0, None, "n", -1.0)]
    frames = spark.createDataFrame(rows, "job_id long, frame_idx long, content binary, camera string, cx double")

    def make(threshold):
        one = hooks.stub_detector(threshold)
        return lambda c: one(c) * (sum(c) % 3)

    names = ["job_id", "frame_idx", "line_no", "class_id", "cx", "cy", "w", "h", "confidence"]
    want = hooks.detect(frames.where("content IS NOT NULL"), make, 0.4).select(*names).collect()
    got = hooks.detect_beside(frames, make, 0.4)
    assert got.columns == ["job_id", "frame_idx", "camera", *names[2:]]
    assert sorted(got.select(*names).collect()) == sorted(want) and len(want) > 10
    spark.udtf.register("boxes_of", hooks.box_function(make, 0.4))
    frames.createOrReplaceTempView("frames_in")
    assert spark.sql("SELECT f.frame_idx, b.line_no FROM frames_in f, LATERAL boxes_of(f.content) b").count() == len(want)
    assert hooks.detect_beside(frames.limit(0), make, 0.4).count() == 0


def test_empty_jobs(spark):
    boxes = scenes.scene(spark, "/root/testdata/sf0.001").limit(0)
    r = from_boxes(spark, boxes)
    assert r.assets.count() == 0 and sinks.assets_report(r.assets).count() == 0
    doc = sinks.feature_collection(sinks.asset_features(r.assets)).orderBy("ord").collect()
    assert json.loads("".join(x.value for x in doc)) == {"type": "FeatureCollection", "features": []}


def test_members_and_clusters_of_one(spark):
    """Members of large enough clusters by the cells' numbers, and clusters of one member by rows, equal those by groups of rows."""
    p = P.class_params(spark)
    rng = random.Random(5)
    rows = [(rng.randrange(2), rng.choice(["pole", "valve", "odd", None]), k, rng.uniform(0, 40), 30.4 + rng.uniform(0, 3e-4), -86.7 + rng.uniform(0, 3e-4)) for k in range(300)]
    rows += [(0, c, 300 + k, None, 30.4, -86.7) for k, c in enumerate(("pole", "valve", None))]
    e = Scratch(spark).write(spark.createDataFrame(rows, ENTRY), "entries")
    linked = cluster.linked(e, p)
    assert "cluster_n" not in linked.columns
    sizes = {r.cluster_id: r["count"] for r in linked.groupBy("cluster_id").count().collect()}
    expected = {(r.entry_seq, r.cluster_id, sizes[r.cluster_id]) for r in cluster.large_enough(linked, p).collect()}
    assert {(r.entry_seq, r.cluster_id, r.cluster_n) for r in cluster.linked(e, p, enough=True).collect()} == expected
    assert 0 < len(expected) < 303 and {n for _, _, n in expected} >= {1, 2, 3}
    empty = dict.fromkeys(("frame_id", "timestamp", "confidence", "bbox_area", "distance_m", "obj_bearing", "cam_lat", "cam_lng", "cam_bearing"))
    m = spark.createDataFrame([member(1, 1), member(2, 2, **empty), member(3, 3, obj_bearing=None, distance_m=-1.0), member(4, 4, cam_lat=-1e-9, confidence=0.12345)], MEMBERS)
    one, many, tri = cluster.of_one(m).withColumns(triangulate.alone()), cluster.summarized(m), triangulate.triangulated(m)
    same = lambda x, y: x.exceptAll(y).count() == 0 == y.exceptAll(x).count()
    assert same(one.select(*many.columns), many) and same(one.select(*tri.columns), tri)
    both = one.drop("n_cluster", "det", "trace")
    assert same(merge.pinned(both, p), merge.placed(many, tri, p))


def test_clusters_of_one_member_are_not_grouped(spark):
    """Assets of one member come by rows: what is grouped is only larger clusters."""
    r = from_boxes(spark, scenes.scene(spark, "/root/testdata/sf0.001"), suppress_conflicts=False)
    sizes = {x.n: x["count"] for x in r.clusters.groupBy("n").count().collect()}
    assert sizes[1] > 0 and r._many.groupBy("cluster_id").count().where("count = 1").count() == 0
    assert r.placed.count() == r.tri.count() == sum(sizes.values())


def test_triangulation_reads_no_more_than_rays(spark):
    """A run for triangulation alone has the same clusters and solutions, without crops, texts and boxes' areas in what it writes."""
    boxes = scenes.scene(spark, "/root/testdata/sf0.001")
    rays, whole = from_boxes(spark, boxes, suppress_conflicts=False, rays_only=True), from_boxes(spark, boxes, suppress_conflicts=False)
    assert set(rays.entries.columns) == set(triangulate.READ) < set(whole.entries.columns)
    assert "image_file" not in rays.kept.columns
    assert rays.tri.columns == whole.tri.columns
    both = [sorted(r.tri.select("cluster_id", "status", "reject_reason", "n_rays", "n_cluster", "frame_a", "frame_b").collect(), key=lambda x: x.cluster_id) for r in (rays, whole)]
    assert both[0] == both[1] and len(both[0]) > 0


def test_rounding_by_arithmetic(spark):
    values = [0.5, -0.5, 1.005, 2.675, -2.675, 1e300, float("nan"), float("inf"), -0.0, -1e-12, None, 30.40000005, 86.70000015, 1234567.45, 0.25, 0.35]
    rng = random.Random(9)
    values += [rng.uniform(-180, 180) for _ in range(2000)] + [rng.randrange(-10**6, 10**6) / 2000 for _ in range(2000)]
    t = spark.createDataFrame([(v,) for v in values], "v double")
    for n in (1, 2, 3, 7):
        bad = t.select("v", F.round("v", n).alias("a"), geo.rounded(F.col("v"), n).alias("b")).where("NOT (a <=> b)")
        assert bad.count() == 0, bad.collect()[:5]
    names = spark.createDataFrame([(0, 0), (12, 3), (999_999, 99), (1_000_000, 100), (-5, 1), (None, 1)], "f long, k int")
    assert names.where(~media.crop_name(F.col("f"), F.col("k")).eqNullSafe(F.format_string("frame_%06d_det_%02d.jpg", "f", "k"))).count() == 0


def test_rays_of_small_clusters_by_all_pairs(spark):
    rng = random.Random(5)
    sizes = [1, 2, 3, 5, 16, 17, 40] * 12
    rows, seq = [], 0
    for c, n in enumerate(sizes):
        for k in range(n):
            seq += rng.choice((1, 3))
            # repeated bearings and opposite ones, so that gaps tie; cluster 2 has one bearing only
            bearing = 30.0 if c == 2 else float(rng.choice((0, 10, 90, 180, 190, 270, 359)))
            rows.append((1, "car", c * 1000, seq, k, 30.0 + rng.random() / 1e3, -86.0 + rng.random() / 1e3, 5.0, bearing, 0.5))
    m = spark.createDataFrame(rows, "job_id long, class string, cluster_id long, entry_seq long, frame_id long, cam_lat double, cam_lng double, cam_bearing double, obj_bearing double, confidence double").repartition(3)
    rays = triangulate.local_rays(m).localCheckpoint()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # clusters lie across batches
    try:
        got = {r.cluster_id: r for r in triangulate.pairs_of_few(rays).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == [c * 1000 for c, n in enumerate(sizes) if 2 <= n <= triangulate.FEW]
    base = {r.cluster_id: r.baseline_m for r in triangulate.baseline(rays).collect()}
    wide = {r.cluster_id: r for r in triangulate.widest_rays(rays).collect()}
    for c, r in got.items():
        assert abs(r.baseline_m - base[c]) < 1e-9
        assert (r.spread_deg, r.a, r.b) == (wide[c].spread_deg, wide[c].a, wide[c].b)
    tri = {r.cluster_id: r for r in triangulate.triangulated(m).collect()}
    assert sorted(tri) == [c * 1000 for c in range(len(sizes))]
    assert all(abs(tri[c].spread_deg - w.spread_deg) < 0.01 and (tri[c].frame_a, tri[c].frame_b) == (w.a.frame, w.b.frame) for c, w in wide.items())
    # of clusters without two rays, the first members are shown
    assert tri[0].reject_reason == "too_few_bearings" and tri[0].frame_a == 0 and tri[0].frame_b is None


def test_sorted_members_are_grouped_as_they_come(spark):
    m = spark.range(200).selectExpr("id % 2 job_id", "concat('c', id % 2) class", "id % 50 cluster_id", "id entry_seq", "id frame_id", "id * 1d timestamp", "1L class_id", "0.5d confidence", "30d lat", "-86d lon", "id * 1d bbox_area", "2d distance_m", "1d obj_bearing", "30d cam_lat", "-86d cam_lng", "0d cam_bearing", "0d elevation_m", "'ocr' gps_source", "'f' image_file", "'t' timestamp_iso")
    with compiled_methods(spark):
        c = cluster.summarized(m)
        rows = {(r.job_id, r.cluster_id): r for r in c.collect()}
        plan = c._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ObjectHashAggregate" not in plan and plan.count("SortAggregate") == 1
    assert len(rows) == 50 and rows[1, 7].source_frames == [7, 57, 107, 157] and rows[1, 7].closest.entry_seq == 157


def test_cells_meet_by_a_hash_first(spark):
    rows = spark.createDataFrame([(k % 5, k % 3, k) for k in range(60)], "a long, b long, k long").selectExpr("struct(a, b) _cell", "k")
    rows = rows.withColumn("_hash", F.xxhash64("_cell"))
    groups = rows.groupBy("_hash", "_cell").agg(F.count("*").alias("n"), F.min("k").alias("least"))
    got = join_groups(rows, groups, ["_hash", "_cell"], "n", 60).collect()
    assert sorted((r.k, r.least) for r in got) == [(k, k % 15) for k in range(60)]
