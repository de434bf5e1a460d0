"""DuckDB SQL for the registered queries, as chains of common table expressions over the derived scene."""

from __future__ import annotations

from kerbside import params as P
from kerbside import scenes
from kerbside.functions.overlay import BEARING


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(float(x)) + "e0" if isinstance(x, float) else str(x)


_ROWS = ", ".join("(" + ", ".join(_value(x) for x in row) + ")" for row in P.CLASSES)
_PAIRS = ", ".join(f"('{a}', '{b}')" for p in P.CONFUSED for a, b in (p, p[::-1]))


def _hav(a: str, b: str, c: str, d: str) -> str:
    """Half-chord of the haversine formula."""
    return f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"


def _ft(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 20902231e0 * asin(sqrt({_hav(a, b, c, d)})))"


def _azimuth(a: str, b: str, c: str, d: str) -> str:
    return f"atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))"


def _mod(x: str) -> str:
    return f"(({x}) - 360e0 * floor(({x}) / 360e0))"


def _go(lat: str, lon: str, br: str, dist: str, earth: str) -> tuple[str, str]:
    q = f"asin(sin(radians({lat})) * cos(({dist}) / {earth}) + cos(radians({lat})) * sin(({dist}) / {earth}) * cos({br}))"
    step = f"atan2(sin({br}) * sin(({dist}) / {earth}) * cos(radians({lat})), cos(({dist}) / {earth}) - sin(radians({lat})) * sin({q}))"
    return f"degrees({q})", f"degrees(radians({lon}) + {step})"


_P_LAT, _P_LNG = _go("cam_lat", "cam_lng", "radians(ob)", "dm", "6371000e0")
_F_LAT, _F_LON = _go("base_lat", "base_lon", "radians(proj_bearing - 2.5e0)", "offset_m", "6371008.8e0")
_T_LAT, _T_LON = _go("base_lat", "base_lon", f"({_azimuth('base_lat', 'base_lon', 'raw_lat', 'raw_lon')} + radians(-2.5e0))", "stretched_m", "6371008.8e0")

STEPS: dict[str, str] = {
    "params": f"SELECT * FROM (VALUES {_ROWS}) v(class_id, class, min_conf, height_m, eps_ft, offset_m, max_m, stretch, min_frames)",
    "confused": f"SELECT * FROM (VALUES {_PAIRS}) v(class_a, class_b)",
    "scene": scenes.SCENE,
    "det": """SELECT s.*, coalesce(p.class, 'class_' || s.class_id) AS class, p.min_conf, p.height_m,
  strftime(to_timestamp(1767225600 + frame_idx) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp_iso
FROM scene s LEFT JOIN params p ON s.class_id = p.class_id""",
    "kept": """SELECT *, row_number() OVER (PARTITION BY job_id, frame_idx ORDER BY entry_seq) - 1 AS det,
  greatest(0, CAST(trunc(cx * 1080 - w * 1080 / 2 - mw) AS INTEGER)) AS x0, greatest(0, CAST(trunc(cy * 1920 - h * 1920 / 2 - mh) AS INTEGER)) AS y0,
  least(1080, CAST(trunc(cx * 1080 + w * 1080 / 2 + mw) AS INTEGER)) AS x1, least(1920, CAST(trunc(cy * 1920 + h * 1920 / 2 + mh) AS INTEGER)) AS y1
FROM (SELECT *, CASE WHEN w * 1080 + 2 * (w * 1080) * 0.75e0 < 1080 * 0.45e0 THEN (1080 * 0.45e0 - w * 1080) / 2 ELSE w * 1080 * 0.75e0 END AS mw,
  CASE WHEN h * 1920 + 2 * (h * 1920) * 0.75e0 < 1920 * 0.55e0 THEN (1920 * 0.55e0 - h * 1920) / 2 ELSE h * 1920 * 0.75e0 END AS mh
  FROM det WHERE confidence >= coalesce(min_conf, 0.25e0)) k""",
    "proj": f"""SELECT *, coalesce({_P_LAT}, cam_lat) AS obj_lat, coalesce({_P_LNG}, cam_lng) AS obj_lng, dm AS distance_m, ob AS obj_bearing,
  CASE WHEN x1 > x0 AND y1 > y0 THEN printf('frame_%06d_det_%02d.jpg', frame_idx, det) END AS image_file
FROM (SELECT *, CASE WHEN ok AND d > 0 AND d <= 200 THEN d END AS dm FROM (SELECT *, cam_lat IS NOT NULL AND cam_bearing IS NOT NULL AS ok,
  CASE WHEN cam_lat IS NOT NULL AND cam_bearing IS NOT NULL THEN {_mod("cam_bearing + (cx - 0.5e0) * 40e0")} END AS ob,
  CASE WHEN height_m > 0 AND h > 0 THEN height_m * 1920 / (2 * (h * 1920) * tan(radians(34e0))) END AS d FROM kept) k) k2""",
    "ent": """SELECT job_id, entry_seq, frame_idx AS frame_id, ts AS timestamp, class, class_id, round(confidence, 3) AS confidence, round(obj_lat, 7) AS lat, round(obj_lng, 7) AS lon,
  round(w * h * 1080 * 1920, 1) AS bbox_area, round(distance_m, 2) AS distance_m, round(obj_bearing, 1) AS obj_bearing, round(cam_lat, 7) AS cam_lat, round(cam_lng, 7) AS cam_lng, round(cam_bearing, 1) AS cam_bearing,
  image_file, gps_source, timestamp_iso FROM proj WHERE obj_lat IS NOT NULL""",
    "near": f"""SELECT * FROM (SELECT a.job_id, a.entry_seq AS a, b.entry_seq AS b, {_ft("a.lat", "a.lon", "b.lat", "b.lon")} AS dist_ft, coalesce(p.eps_ft, 10e0) AS eps
  FROM ent a JOIN ent b ON a.job_id = b.job_id AND a.class = b.class AND a.entry_seq < b.entry_seq AND abs(a.timestamp - b.timestamp) <= 6 LEFT JOIN params p ON p.class = a.class) x WHERE dist_ft <= eps""",
    "ways": "SELECT a, b FROM near UNION ALL SELECT b, a FROM near",
    "reach(node, c)": "SELECT entry_seq, entry_seq FROM ent UNION SELECT w.b, r.c FROM reach r JOIN ways w ON w.a = r.node",
    "comp": "SELECT node AS entry_seq, min(c) AS cluster_id FROM reach GROUP BY node",
    "mem": """SELECT e.*, c.cluster_id, count(*) OVER (PARTITION BY c.cluster_id) AS n, coalesce(p.min_frames, 1) AS need, coalesce(p.max_m, 50e0) AS most, coalesce(p.offset_m, 3e0) AS side, coalesce(p.stretch, 1.3e0) AS stretch
FROM ent e JOIN comp c USING (entry_seq) LEFT JOIN params p ON p.class = e.class QUALIFY n >= need""",
    "sco": """SELECT *, confidence + 0.3e0 * norm_area AS score FROM (SELECT *, CASE WHEN max(bbox_area) OVER c > min(bbox_area) OVER c THEN (bbox_area - min(bbox_area) OVER c) / (max(bbox_area) OVER c - min(bbox_area) OVER c) ELSE 1e0 END AS norm_area FROM mem WINDOW c AS (PARTITION BY cluster_id)) m""",
    "clo": "SELECT * FROM sco QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY bbox_area DESC, entry_seq) = 1",
    "bes": "SELECT * FROM sco QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, entry_seq) = 1",
    "stat": """SELECT cluster_id, any_value(class) AS class, any_value(job_id) AS job_id, count(*) AS n, round(avg(coalesce(confidence, 0)), 4) AS mean_conf, min(CASE WHEN distance_m > 0 THEN distance_m END) AS min_mono_m,
  list_sort(list(DISTINCT timestamp)) AS times, list(frame_id ORDER BY entry_seq) AS frames, count(obj_bearing) AS bearings,
  count(DISTINCT CASE WHEN cam_lat IS NOT NULL AND cam_lng IS NOT NULL THEN (round(cam_lat, 5), round(cam_lng, 5)) END) AS unique_cam_pos FROM mem GROUP BY cluster_id""",
    "rays": """SELECT *, (cam_lng - lng0) * (111320e0 * cos(radians(lat0))) AS x, (cam_lat - lat0) * 111320e0 AS y FROM (SELECT *, avg(cam_lat) OVER c AS lat0, avg(cam_lng) OVER c AS lng0, count(*) OVER c AS n_rays,
  row_number() OVER (PARTITION BY cluster_id ORDER BY entry_seq) AS k FROM mem WHERE cam_lat IS NOT NULL AND cam_lng IS NOT NULL AND obj_bearing IS NOT NULL WINDOW c AS (PARTITION BY cluster_id)) r""",
    "duo": """SELECT a.cluster_id, a.entry_seq AS a, b.entry_seq AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, least(abs(a.obj_bearing - b.obj_bearing), 360 - abs(a.obj_bearing - b.obj_bearing)) AS gap
FROM rays a JOIN rays b ON a.cluster_id = b.cluster_id AND a.entry_seq < b.entry_seq""",
    "geom": """SELECT cluster_id, max(d) AS baseline_m, max(gap) AS spread_deg, arg_min(a, CAST(-round(gap * 10) AS BIGINT) * 1000000000000 + a * 1000000 + (b - a)) AS a, arg_min(b, CAST(-round(gap * 10) AS BIGINT) * 1000000000000 + a * 1000000 + (b - a)) AS b FROM duo GROUP BY cluster_id""",
    "norm": """SELECT *, a11 * a22 - a12 * a12 AS det, abs(a11 * a22 - a12 * a12) < 1e-4 * greatest(pow(a11 + a22, 2), 1e0) AS singular FROM (SELECT cluster_id, count(*) AS n_rays, any_value(lat0) AS lat0, any_value(lng0) AS lng0,
  sum(nx * nx) AS a11, sum(nx * ny) AS a12, sum(ny * ny) AS a22, sum((x * nx + y * ny) * nx) AS b1, sum((x * nx + y * ny) * ny) AS b2
  FROM (SELECT *, cos(radians(obj_bearing)) AS nx, -sin(radians(obj_bearing)) AS ny FROM rays) r GROUP BY cluster_id HAVING count(*) > 1) s""",
    "sol": """SELECT *, lat0 + qy / 111320e0 AS raw_lat, lng0 + qx / (111320e0 * cos(radians(lat0))) AS raw_lon FROM (SELECT *, CASE WHEN NOT singular THEN (a22 * b1 - a12 * b2) / det END AS qx, CASE WHEN NOT singular THEN (a11 * b2 - a12 * b1) / det END AS qy FROM norm) s""",
    "res": """SELECT r.cluster_id, avg(abs((qx - x) * cos(radians(obj_bearing)) - (qy - y) * sin(radians(obj_bearing)))) AS residual_m, min(sqrt(pow(qx - x, 2) + pow(qy - y, 2))) AS closest_m, max(sqrt(pow(qx - x, 2) + pow(qy - y, 2))) AS farthest_m
FROM rays r JOIN sol s ON r.cluster_id = s.cluster_id AND NOT s.singular GROUP BY r.cluster_id""",
    "tri": """SELECT t.*, CASE WHEN nr < 2 THEN 'too_few_bearings' WHEN baseline_m < 5 THEN 'baseline_too_short' WHEN spread_deg < 20 THEN 'bearing_spread_too_small' WHEN singular THEN 'singular_matrix'
  WHEN residual_m > 3 THEN 'residual_too_big' WHEN farthest_m > 80 THEN 'too_far_from_cams' WHEN closest_m < 2 THEN 'collapsed_onto_track' END AS reject_reason FROM (
  SELECT c.cluster_id, c.class, c.job_id, c.n AS n_cluster, (SELECT count(*) FROM rays r WHERE r.cluster_id = c.cluster_id) AS nr, g.baseline_m, g.spread_deg, g.a, g.b, s.singular, round(s.raw_lat, 7) AS raw_lat, round(s.raw_lon, 7) AS raw_lon, e.residual_m, e.closest_m, e.farthest_m
  FROM stat c LEFT JOIN geom g USING (cluster_id) LEFT JOIN sol s USING (cluster_id) LEFT JOIN res e USING (cluster_id)) t""",
    "fal": f"""SELECT *, CASE WHEN go THEN {_F_LAT} ELSE base_lat END AS fb_lat, CASE WHEN go THEN {_F_LON} ELSE base_lon END AS fb_lon FROM (SELECT *, proj_bearing IS NOT NULL AND base_lat IS NOT NULL AND offset_m > 0 AS go FROM (
  SELECT s.*, c.stretch, c.frame_id AS coords_from_frame, CASE WHEN s.n = 1 THEN c.most * 0.65e0 ELSE c.most END AS max_d, CASE WHEN c.cam_lat IS NOT NULL AND c.cam_lng IS NOT NULL THEN c.cam_lat ELSE c.lat END AS base_lat, CASE WHEN c.cam_lat IS NOT NULL AND c.cam_lng IS NOT NULL THEN c.cam_lng ELSE c.lon END AS base_lon,
  CASE WHEN s.min_mono_m IS NULL THEN c.side ELSE greatest(0.5e0, least(s.min_mono_m * 0.85e0, CASE WHEN s.n = 1 THEN c.most * 0.65e0 ELSE c.most END)) END AS offset_m,
  coalesce(c.obj_bearing, {_mod("c.cam_bearing + 90e0")}) AS proj_bearing FROM stat s JOIN clo c ON c.cluster_id = s.cluster_id) f) f2""",
    "pl": f"""SELECT *, CASE WHEN use THEN 'triangulated' WHEN moved THEN 'cam+offset' ELSE 'cam_only' END AS coord_source, CASE WHEN use THEN {_T_LAT} WHEN moved THEN fb_lat ELSE base_lat END AS pin_lat, CASE WHEN use THEN {_T_LON} WHEN moved THEN fb_lon ELSE base_lon END AS pin_lon
FROM (SELECT *, tri_cam_m IS NOT NULL AND clamp_reason IS NULL AS use, go AND (fb_lat <> base_lat OR fb_lon <> base_lon) AS moved, CASE WHEN tri_cam_m IS NOT NULL AND clamp_reason IS NULL THEN least(tri_cam_m * stretch, max_d) END AS stretched_m
FROM (SELECT *, CASE WHEN tri_cam_m > max_d THEN printf('tri_dist_%.1fm>max_%.1fm', tri_cam_m, max_d) WHEN tri_cam_m < 0.5 THEN printf('tri_dist_%.2fm<min_%.1fm', tri_cam_m, 0.5e0) END AS clamp_reason
FROM (SELECT f.*, t.raw_lat, t.raw_lon, t.reject_reason, t.nr, t.spread_deg, t.a, t.b, t.baseline_m, t.residual_m, t.closest_m, t.farthest_m, CASE WHEN t.reject_reason IS NULL THEN {_ft("f.base_lat", "f.base_lon", "t.raw_lat", "t.raw_lon")} / 3.28084e0 END AS tri_cam_m FROM fal f JOIN tri t USING (cluster_id)) p1) p2) p3""",
    "ass": f"""SELECT p.*, b.confidence, b.class_id, b.frame_id AS image_from_frame, b.cam_lat, b.cam_lng, b.cam_bearing, b.image_file, b.timestamp_iso, b.timestamp AS video_sec, b.gps_source, round(p.pin_lat, 7) AS lat, round(p.pin_lon, 7) AS lon,
  CASE WHEN b.cam_lat IS NOT NULL THEN round(2 * 6371008.8e0 * atan2(sqrt({_hav("b.cam_lat", "b.cam_lng", "p.pin_lat", "p.pin_lon")}), sqrt(1 - {_hav("b.cam_lat", "b.cam_lng", "p.pin_lat", "p.pin_lon")})), 2) ELSE b.distance_m END AS distance_m,
  CASE WHEN b.cam_lat IS NOT NULL THEN round({_mod("degrees(" + _azimuth("b.cam_lat", "b.cam_lng", "p.pin_lat", "p.pin_lon") + ") + 360e0")}, 1) ELSE b.obj_bearing END AS obj_bearing
FROM pl p JOIN bes b USING (cluster_id)""",
    "pairs": f"""SELECT * FROM (SELECT x.job_id, x.cluster_id AS a, y.cluster_id AS b, {_ft("x.lat", "x.lon", "y.lat", "y.lon")} AS d FROM ass x JOIN confused c ON c.class_a = x.class JOIN ass y ON y.class = c.class_b AND y.job_id = x.job_id AND x.cluster_id < y.cluster_id
  WHERE list_min(x.times) - 8 <= list_max(y.times) AND list_min(y.times) - 8 <= list_max(x.times)) p WHERE d <= 50""",
    "turns": """SELECT *, row_number() OVER (ORDER BY class_seq, cluster_id) AS k FROM (SELECT s.cluster_id, s.confidence, s.n, e.class_seq FROM ass s
  JOIN (SELECT job_id, class, min(entry_seq) AS class_seq FROM ent GROUP BY job_id, class) e ON e.job_id = s.job_id AND e.class = s.class WHERE s.cluster_id IN (SELECT a FROM pairs UNION SELECT b FROM pairs)) t""",
    "against": """SELECT x.k, list(y.k ORDER BY y.k) AS others, list((y.confidence, y.n) > (x.confidence, x.n) ORDER BY y.k) AS stronger FROM (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs) p JOIN turns x ON x.cluster_id = p.a JOIN turns y ON y.cluster_id = p.b GROUP BY x.k""",
    "pass(k, gone)": """SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT k, CASE WHEN list_contains(gone, k) THEN gone WHEN p > 0 THEN list_concat(gone, list_concat(list_transform(left_[1:CAST(p - 1 AS BIGINT)], lambda z: z.o), [k])) ELSE list_concat(gone, list_transform(left_, lambda z: z.o)) END
  FROM (SELECT k, gone, left_, list_position(list_transform(left_, lambda z: z.s), true) AS p FROM (SELECT a.k, r.gone, list_filter(list_transform(range(1, len(a.others) + 1), lambda i: {'o': a.others[i], 's': a.stronger[i]}), lambda z: NOT list_contains(r.gone, z.o)) AS left_ FROM pass r JOIN against a ON a.k = r.k + 1) f) g""",
    "gone": "SELECT cluster_id FROM turns WHERE k IN (SELECT unnest(gone) FROM pass WHERE k = (SELECT max(k) FROM pass))",
    "log": """SELECT job_id, cluster_id, unnest(range(0, len(lines))) AS ord, unnest(lines) AS line FROM (SELECT job_id, cluster_id, list_filter([CASE WHEN reject_reason IS NOT NULL THEN '[TRI_REJECT] cls=' || class || ' reason=' || reject_reason || ' cluster_n=' || n || ' rays=' || nr END,
  CASE WHEN use THEN '[CAL] cls=' || class || ' raw_tri=' || printf('%.2f', round(tri_cam_m, 2)) || 'm stretch=' || printf('%.2f', stretch) || ' stretched=' || printf('%.2f', round(stretched_m, 2)) || 'm (max=' || printf('%.1f', round(max_d, 1)) || 'm) bearing_off=-2.50deg' END,
  '[PATH] cls=' || class || ' src=' || coord_source || ' cluster_n=' || n || ' bearings=' || bearings || ' unique_cam_pos=' || unique_cam_pos || ' tri_ok=' || CASE WHEN use THEN 'True' ELSE 'False' END || ' tri_reject=' || coalesce(clamp_reason, '-') || ' proj_dist=' || printf('%.1f', round(offset_m, 1)) || 'm proj_brg=' || coalesce(printf('%.1f', round(proj_bearing, 1)), '-')], lambda z: z IS NOT NULL) AS lines FROM ass) l""",
    "feat": """SELECT f.job_id, CASE WHEN d.class_id IS NULL THEN 'gps_track' ELSE 'detection' END AS type, d.class_id, d.class AS class_name, round(d.confidence, 3) AS confidence, f.frame_idx AS frame_num, f.ts AS video_sec, f.timestamp_iso AS timestamp, round(coalesce(round(d.obj_lat, 7), f.cam_lat), 7) AS latitude, round(coalesce(round(d.obj_lng, 7), f.cam_lng), 7) AS longitude,
  round(f.ele, 2) AS elevation_m, round(d.distance_m, 2) AS distance_m, round(d.obj_bearing, 1) AS obj_bearing, CASE WHEN d.class_id IS NOT NULL THEN round(f.cam_lat, 7) END AS cam_lat, CASE WHEN d.class_id IS NOT NULL THEN round(f.cam_lng, 7) END AS cam_lng, round(f.cam_bearing, 1) AS cam_bearing, round(d.cx, 4) AS bbox_cx, round(d.cy, 4) AS bbox_cy, round(d.w, 4) AS bbox_w, round(d.h, 4) AS bbox_h, f.gps_source, d.image_file
FROM (SELECT DISTINCT job_id, frame_idx, ts, timestamp_iso, cam_lat, cam_lng, cam_bearing, ele, gps_source FROM det WHERE cam_lat IS NOT NULL) f LEFT JOIN proj d ON d.job_id = f.job_id AND d.frame_idx = f.frame_idx""",
}


def chain(select: str, last: str | None = None) -> str:
    """A query after all steps, or those up to last."""
    names = list(STEPS)
    names = names[: names.index(last) + 1] if last else names
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({STEPS[n]})" for n in names) + f"\n{select}"


_COORD = {
    0: ("CAST(la || '.' || d1 AS DOUBLE)", "-CAST(lo || '.' || d2 AS DOUBLE)"),
    4: ("la + 20 / 60e0 + 38 / 3600e0", "-(lo + 32 / 60e0 + 19.5e0 / 3600e0)"),
    7: ("NULL", "NULL"),
}
_TEXT = f"""WITH t AS ({scenes.TEXTS}), p AS (SELECT event_id, 25 + event_id % 20 AS la, 70 + event_id % 25 AS lo, 10000 + (event_id * 7919) % 89999 AS d1, 10000 + (event_id * 104729) % 89999 AS d2, event_id % 8 AS form, event_id % 300 AS be FROM events),
c AS (SELECT event_id AS frame_idx, event_id % 8 AS job_id, form, CASE WHEN form = 4 THEN {_COORD[4][0]} WHEN form = 7 THEN NULL ELSE {_COORD[0][0]} END AS lat, CASE WHEN form = 4 THEN {_COORD[4][1]} WHEN form = 7 THEN NULL ELSE {_COORD[0][1]} END AS lng,
  CASE form WHEN 0 THEN CAST(be AS DOUBLE) WHEN 1 THEN 7.5e0 WHEN 2 THEN 0e0 WHEN 4 THEN 40e0 WHEN 6 THEN 12e0 END AS bearing FROM p)"""

_EV = "WITH e AS (SELECT event_id, 30 + event_id % 97 / 100e0 AS lat1, -86 - event_id % 89 / 100e0 AS lon1 FROM events), f AS (SELECT *, lat1 + (event_id % 7 - 3) / 1000e0 AS lat2, lon1 + (event_id % 11 - 5) / 1000e0 AS lon2 FROM e)"
_E_LAT, _E_LON = _go("lat1", "lon1", "radians(event_id % 360)", "event_id % 150 + 0.5e0", "6371000e0")

_POSE = f"""WITH tr AS ({scenes.TRACK}), tm AS ({scenes.TIMES}),
pt AS (SELECT *, lag((sec, lat, lng, ele)) OVER w AS prev, lead((sec, lat, lng, ele)) OVER w AS next, row_number() OVER w AS k, count(*) OVER (PARTITION BY job_id) AS n FROM (SELECT job_id, pt_seq, CAST(sec AS DOUBLE) AS sec, lat, lng, ele FROM tr) x WINDOW w AS (PARTITION BY job_id ORDER BY sec, pt_seq)),
fi AS (SELECT job_id, sec AS t0, lat AS la0, lng AS ln0, ele AS e0, next[1] AS t1, next[2] AS la1, next[3] AS ln1, next[4] AS e1, n FROM pt WHERE k = 1),
la AS (SELECT job_id, sec AS u1, lat AS lb1, lng AS lm1, ele AS f1, prev[1] AS u0, prev[2] AS lb0, prev[3] AS lm0, prev[4] AS f0 FROM pt WHERE k = n),
q AS (SELECT tm.job_id, tm.frame_idx, CAST(tm.sec AS DOUBLE) AS t, pt.k AS j FROM tm ASOF LEFT JOIN pt ON pt.job_id = tm.job_id AND tm.sec <= pt.sec),
g AS (SELECT q.job_id, q.frame_idx, q.t, b.sec AS s1, b.lat AS blat, b.lng AS blng, b.ele AS bele, a.sec AS s0, a.lat AS alat, a.lng AS alng, a.ele AS aele, fi.*, la.* FROM q LEFT JOIN pt b ON b.job_id = q.job_id AND b.k = greatest(q.j, 2) LEFT JOIN pt a ON a.job_id = q.job_id AND a.k = greatest(q.j, 2) - 1 JOIN fi ON fi.job_id = q.job_id JOIN la ON la.job_id = q.job_id),
r AS (SELECT job_id, frame_idx, {{0}} AS lat, {{1}} AS lng, {{2}} AS ele FROM g)"""


def _interp(first0: str, first1: str, last0: str, last1: str, a: str, b: str) -> str:
    return f"""CASE WHEN t < t0 - 300 OR t > u1 + 300 THEN NULL WHEN t < t0 THEN CASE WHEN t0 - t > 60 THEN {first0} ELSE {first0} - (t0 - t) / greatest(t1 - t0, 0.001e0) * ({first1} - {first0}) END
 WHEN t > u1 THEN CASE WHEN t - u1 > 60 THEN {last1} ELSE {last1} + (t - u1) / greatest(u1 - u0, 0.001e0) * ({last1} - {last0}) END ELSE {a} + (CASE WHEN s1 > s0 THEN (t - s0) / (s1 - s0) ELSE 0e0 END) * ({b} - {a}) END"""


_POSE = _POSE.format(_interp("la0", "la1", "lb0", "lb1", "alat", "blat"), _interp("ln0", "ln1", "lm0", "lm1", "alng", "blng"), _interp("e0", "e1", "f0", "f1", "aele", "bele"))
_FILES = f"WITH files AS ({scenes.LISTING})"
_LABEL = "(event_id % 28)::VARCHAR || ' 0.5 0.25  0.1 0.2'"

_MARKS = """SELECT job_id, class || ' (' || pct || ')' || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END AS name, '#detection' AS style_url, timestamp_iso AS when_iso, concat_ws('', '<b>' || class || '</b> — ' || pct, CASE WHEN n > 1 THEN ' &nbsp;(merged from ' || n || ' frames)' END, '<br/>Video: ' || CAST(video_sec AS VARCHAR) || 's &nbsp;|&nbsp; GPS: ' || coalesce(gps_source, 'None') || '<br/><b>Object:</b> ' || CAST(round(lat, 5) AS VARCHAR) || ', ' || CAST(round(lon, 5) AS VARCHAR) || '<br/>', 'Distance from camera: ' || CAST(round(distance_m, 0) AS VARCHAR) || ' m' || coalesce(' &nbsp;|&nbsp; Bearing to object: ' || CAST(round(obj_bearing, 0) AS VARCHAR) || '°', '') || '<br/>', '<i>Camera pos:</i> ' || CAST(cam_lat AS VARCHAR) || ', ' || CAST(cam_lng AS VARCHAR) || coalesce(' &nbsp;(heading ' || CAST(cam_bearing AS VARCHAR) || '°)', '') || '<br/>', timestamp_iso || '<br/>', '<br/><img src="images/' || image_file || '" width="480"/>') AS description, round(lon, 5) AS longitude, round(lat, 5) AS latitude, 0e0 AS elevation_m FROM (SELECT *, printf('%.1f', confidence * 100) || '%' AS pct FROM ass) a
UNION ALL SELECT job_id, 'Track @' || CAST(video_sec AS VARCHAR) || 's', '#gpstrack', timestamp, 'GPS track point<br/>Source: ' || coalesce(gps_source, 'None') || '<br/>' || timestamp, longitude, latitude, elevation_m FROM feat WHERE type = 'gps_track'"""

_KML = f"""SELECT CAST(ord AS INTEGER) AS ord, count(*) FILTER (WHERE ord IN (0, 9) OR value LIKE '<Placemark>%') AS n, count(*) FILTER (WHERE value LIKE '<Placemark>%') AS placemarks, count(*) FILTER (WHERE value LIKE '%</Placemark>') AS closed,
  CAST(sum(CASE WHEN ord NOT IN (0, 9) THEN CAST('0x' || md5(value)[1:8] AS BIGINT) END) AS BIGINT) AS digest FROM (
WITH pt AS (SELECT DISTINCT job_id, frame_idx, timestamp_iso, CAST(cam_lng AS VARCHAR) || ',' || CAST(cam_lat AS VARCHAR) || ',0.0' AS p FROM det WHERE cam_lat IS NOT NULL),
jobs AS (SELECT job_id, arg_min(p, frame_idx) AS p0, arg_max(p, frame_idx) AS p1, arg_min(timestamp_iso, frame_idx) AS t0, arg_max(timestamp_iso, frame_idx) AS t1 FROM pt GROUP BY job_id HAVING count(*) >= 2),
marks AS ({_MARKS})
SELECT 0 AS ord, 'head' AS value UNION ALL SELECT 9, 'tail'
UNION ALL SELECT 1, '<Placemark><name>GPS Track</name><styleUrl>#trackLine</styleUrl><LineString><tessellate>1</tessellate><coordinates>' FROM jobs
UNION ALL SELECT 1, string_agg(p, ' ' ORDER BY frame_idx) FROM pt WHERE job_id IN (SELECT job_id FROM jobs) GROUP BY job_id, frame_idx // 1000
UNION ALL SELECT 1, '</coordinates></LineString></Placemark>' FROM jobs
UNION ALL SELECT 2, '<Placemark><name>Start</name><styleUrl>#start</styleUrl><description><![CDATA[' || t0 || ']]></description><Point><coordinates>' || p0 || '</coordinates></Point></Placemark>' FROM jobs
UNION ALL SELECT 3, '<Placemark><name>End</name><styleUrl>#end</styleUrl><description><![CDATA[' || t1 || ']]></description><Point><coordinates>' || p1 || '</coordinates></Point></Placemark>' FROM jobs
UNION ALL SELECT CASE style_url WHEN '#detection' THEN 4 ELSE 5 END, concat('<Placemark>', chr(10), '  <name>', name, '</name>', chr(10), '  <styleUrl>', style_url, '</styleUrl>', chr(10), '  <TimeStamp><when>', when_iso, '</when></TimeStamp>', chr(10), '  <description><![CDATA[', description, ']]></description>', chr(10),
  '  <Point><coordinates>', CAST(longitude AS VARCHAR), ',', CAST(latitude AS VARCHAR), ',', CAST(elevation_m AS VARCHAR), '</coordinates></Point>', chr(10), '</Placemark>') FROM marks) x GROUP BY ord"""


def oracle_sql() -> dict[str, str]:
    return {
        "flagship": chain("SELECT class, count(*) AS n, round(avg(distance_m), 3) AS mean_distance_m FROM proj GROUP BY class", "proj"),
        "haversine": f"{_EV} SELECT event_id, round({_ft('lat1', 'lon1', 'lat2', 'lon2')}, 3) AS ft, round(2 * 6371008.8e0 * asin(sqrt({_hav('lat1', 'lon1', 'lat2', 'lon2')})), 3) AS m, round({_mod('degrees(' + _azimuth('lat1', 'lon1', 'lat2', 'lon2') + ') + 360e0')}, 4) AS azimuth FROM f",
        "destination": f"{_EV} SELECT event_id, round({_E_LAT}, 6) AS lat, round({_E_LON}, 6) AS lon FROM f",
        "object_bearing": chain(f"SELECT entry_seq, round({_mod('entry_seq % 360 * 1e0 + (cx - 0.5e0) * 40e0')}, 3) AS bearing FROM scene", "scene"),
        "mono_distance": chain("SELECT entry_seq, round(height_m * 1920 / (2 * (h * 1920) * tan(radians(34e0))), 3) AS distance_m FROM det", "det"),
        "dms_decimal": "SELECT event_id, round(CASE WHEN event_id % 4 IN (1, 3) THEN -1 ELSE 1 END * (event_id % 90 + event_id % 60 / 60e0 + (event_id % 59 + 0.5e0) / 3600e0), 6) AS deg FROM events",
        "project_detections": chain("SELECT entry_seq, class, round(round(obj_lat, 7), 6) AS obj_lat, round(round(obj_lng, 7), 6) AS obj_lng, round(distance_m, 2) AS distance_m, round(obj_bearing, 1) AS obj_bearing FROM proj", "proj"),
        "ocr_clean": f"{_TEXT} SELECT frame_idx, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '°', ' ', 'g'), '\\s*\\|\\s*', ' / ', 'g'), '(\\d{{2,3}})[ ,](\\d{{4,5}})($|\\D)', '\\1.\\2\\3', 'g'), '([+-])(\\d{{3}})(\\d{{5}})($|\\D)', '\\1\\2.\\3\\4', 'g'), '\\s{{2,}}', ' ', 'g')) AS cleaned FROM t",
        "ocr_coords": f"{_TEXT} SELECT frame_idx, round(lat, 6) AS lat, round(lng, 6) AS lng FROM c",
        "ocr_anchor": f"{_TEXT} SELECT frame_idx, CASE WHEN form IN (2, 4, 7) THEN NULL ELSE round(lat, 6) END AS lat, CASE WHEN form IN (2, 4, 7) THEN NULL ELSE round(lng, 6) END AS lng FROM c",
        "ocr_bearing": f"{_TEXT} SELECT frame_idx, round(CASE WHEN regexp_matches(text, '{BEARING}') AND TRY_CAST(regexp_extract(text, '{BEARING}', 1) AS DOUBLE) BETWEEN 0 AND 360 THEN fmod(CAST(regexp_extract(text, '{BEARING}', 1) AS DOUBLE), 360) END, 2) AS bearing FROM t",
        "ocr_region_cascade": f"{_TEXT} SELECT frame_idx, round(lat, 6) AS lat, round(lng, 6) AS lng, CASE WHEN lat IS NOT NULL THEN bearing END AS bearing, CASE WHEN lat IS NOT NULL THEN ['bottom', 'top', 'full'][frame_idx % 3 + 1] END AS region, CASE WHEN lat IS NOT NULL THEN 'vision' END AS method FROM c",
        "crop_rects": chain("SELECT entry_seq, CAST(det AS INTEGER) AS det, image_file, x0, y0, x1, y1 FROM proj", "proj"),
        "frame_time": f"WITH tm AS ({scenes.TIMES}) SELECT frame_idx, frame_idx * 14 AS frame_num, round(frame_idx * 0.5e0, 2) AS offset_sec, strftime(to_timestamp(sec) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM tm",
        "start_time": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1767225600 + event_id % 60 WHEN 1 THEN 1770084306 END AS start_s FROM events",
        "fps_parse": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN round(30000 / 1001, 4) WHEN 1 THEN CAST(event_id % 50 + 10 AS DOUBLE) ELSE 30e0 END AS fps, CASE event_id % 3 WHEN 0 THEN 90 ELSE 0 END AS rotation FROM events",
        "exif_time": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 1767225600 + (event_id % 9) * 86400 + 36000 + event_id % 60 END AS taken_s FROM events",
        "gpx_points": f"WITH tr AS ({scenes.TRACK}), b AS (SELECT *, 0 AS kind FROM tr UNION ALL SELECT job_id, pt_seq, sec, lat, lng, 0e0, 1 FROM tr WHERE pt_seq % 10 = 0) SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY sec, kind, pt_seq) - 1 AS place, sec, lat, lng, ele FROM b",
        "parse_labels": f"""WITH l AS (SELECT event_id, 0 AS line_no, CASE WHEN event_id % 3 = 0 THEN CAST('0.' || event_id AS DOUBLE) ELSE 0e0 END AS confidence FROM events UNION ALL SELECT event_id, 5, 0e0 FROM events)
SELECT event_id, line_no, CAST(event_id % 28 AS INTEGER) AS class_id, 0.5e0 AS cx, 0.25e0 AS cy, 0.1e0 AS w, 0.2e0 AS h, confidence FROM l""",
        "label_files": """WITH l AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST('0.' || event_id AS DOUBLE) ELSE 0e0 END AS confidence FROM events UNION ALL SELECT event_id, 0e0 FROM events)
SELECT event_id % 100 AS stem, count(*) AS n, CAST(sum(event_id % 28) AS BIGINT) AS classes, round(sum(confidence), 4) AS confidence FROM l GROUP BY 1""",
        "frame_index": f"{_FILES}, f AS (SELECT job_id, path || '/' || lpad(event_id::VARCHAR, 9, '0') AS path, event_id % 5 <> 0 AS readable FROM files) SELECT job_id, path, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY path) - 1 AS frame_idx FROM f) x WHERE readable",
        "class_names": f"WITH params AS ({STEPS['params']}) SELECT event_id, CAST(event_id % 33 AS INTEGER) AS class_id, coalesce(p.class, 'class_' || event_id % 33) AS class FROM events LEFT JOIN params p ON p.class_id = event_id % 33",
        "class_params_join": chain("SELECT entry_seq, d.class, coalesce(p.min_conf, 0.25e0) AS min_conf, p.height_m, coalesce(p.eps_ft, 10e0) AS eps_ft, coalesce(p.offset_m, 3e0) AS offset_m, coalesce(p.max_m, 50e0) AS max_m, coalesce(p.stretch, 1.3e0) AS stretch, coalesce(p.min_frames, 1) AS min_frames FROM det d LEFT JOIN params p ON p.class = d.class", "det"),
        "conf_filter": chain("SELECT entry_seq, class, confidence FROM kept", "kept"),
        "detector_threshold": f"WITH params AS ({STEPS['params']}) SELECT least(0.5e0, min(min_conf)) AS threshold FROM params WHERE class_id IN (SELECT class_id FROM ({scenes.SCENE}) s)",
        "image_count": f"{_FILES} SELECT split, count(*) AS n_images FROM files WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png)$') GROUP BY split",
        "incoming_images": f"{_FILES} SELECT event_id, path FROM files WHERE regexp_matches(path, '\\.(jpg|jpeg|png|JPG|JPEG|PNG)$')",
        "latest_model": f"{_FILES} SELECT max(path) AS path FROM files WHERE path LIKE '%/weights/best.pt'",
        "model_list": f"{_FILES} SELECT split_part(path, '/', 4) AS name, split_part(path, '/', 2) AS run, path, round(bytes / 1048576, 2) AS size_mb FROM files WHERE path LIKE '%/weights/%.pt'",
        "training_runs": f"{_FILES} SELECT split_part(path, '/', 2) AS run, bool_or(path LIKE '%/weights/best.pt') AS has_best FROM files GROUP BY 1 HAVING bool_or(path LIKE '%/results.csv')",
        "run_counts": f"{_FILES} SELECT split_part(path, '/', 2) AS run, count(*) FILTER (WHERE regexp_matches(path, '\\.(jpg|png)$')) AS n_images FROM files GROUP BY 1",
        "entries": chain("SELECT entry_seq, job_id, frame_id, timestamp, class, confidence, round(lat, 6) AS lat, round(lon, 6) AS lon, bbox_area, distance_m, obj_bearing, cam_lat, cam_lng, cam_bearing, timestamp_iso FROM ent", "ent"),
        "frames_with_boxes": chain(f"SELECT f.job_id, f.frame_idx::VARCHAR AS stem, b.entry_seq FROM ({scenes.FRAMES}) f LEFT JOIN scene b ON b.job_id = f.job_id AND b.frame_idx = f.frame_idx", "scene"),
        "miss_sample": f"{_TEXT} SELECT job_id, frame_idx, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY frame_idx) AS k FROM c WHERE lat IS NULL) m WHERE k <= 20",
        "gps_interpolate": f"{_POSE} SELECT frame_idx, round(lat, 6) AS lat, round(lng, 6) AS lng, round(ele, 4) AS ele FROM r",
        "pose_resolve": _POSE + _TEXT.replace("WITH t AS", ", t AS") + " SELECT r.frame_idx, round(coalesce(c.lat, r.lat), 6) AS lat, round(coalesce(c.lng, r.lng), 6) AS lng, round(CASE WHEN c.lat IS NOT NULL THEN 0 ELSE r.ele END, 4) AS ele, round(CASE WHEN c.lat IS NOT NULL THEN c.bearing END, 2) AS bearing, CASE WHEN c.lat IS NOT NULL THEN 'ocr' WHEN r.lat IS NOT NULL THEN 'gpx' END AS gps_source FROM r LEFT JOIN c ON c.frame_idx = r.frame_idx",
        "track_line": chain("SELECT job_id, count(*) AS n_points, CAST(count(*) AS INTEGER) AS n_coordinates, arg_min(timestamp_iso, frame_idx) AS start_iso, arg_max(timestamp_iso, frame_idx) AS end_iso FROM (SELECT DISTINCT job_id, frame_idx, timestamp_iso FROM det WHERE cam_lat IS NOT NULL) f GROUP BY job_id HAVING count(*) >= 2", "det"),
        "class_groups": chain("SELECT job_id, class, count(*) AS n, min(entry_seq) AS first_seq FROM ent GROUP BY job_id, class", "ent"),
        "proximity_pairs": chain("SELECT job_id, a, b, round(dist_ft, 3) AS dist_ft FROM near", "near"),
        "clusters": chain("SELECT entry_seq, cluster_id FROM comp", "comp"),
        "min_frames_filter": chain("SELECT entry_seq, cluster_id FROM mem", "mem"),
        "area_norm": chain("SELECT entry_seq, round(norm_area, 4) AS norm_area, round(score, 4) AS score FROM sco", "sco"),
        "cluster_best": chain("SELECT cluster_id, c.entry_seq AS closest, b.entry_seq AS best FROM clo c JOIN bes b USING (cluster_id)", "bes"),
        "cluster_stats": chain("SELECT cluster_id, class, n, round(mean_conf, 3) AS mean_conf, min_mono_m, array_to_string(list_transform(times, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), '|') AS members_video_sec, array_to_string(frames, '|') AS source_frames, bearings, unique_cam_pos FROM stat", "stat"),
        "tri_local_xy": chain("SELECT entry_seq, round(x, 2) + 0e0 AS x, round(y, 2) + 0e0 AS y, n_rays FROM rays", "rays"),
        "tri_baseline": chain("SELECT cluster_id, round(baseline_m, 3) AS baseline_m FROM geom", "geom"),
        "tri_spread": chain("SELECT cluster_id, round(spread_deg, 3) AS spread_deg, a, b FROM geom", "geom"),
        "tri_solve": chain("SELECT cluster_id, singular, round(raw_lat, 5) AS raw_lat, round(raw_lon, 5) AS raw_lon FROM sol", "sol"),
        "tri_residuals": chain("SELECT cluster_id, round(residual_m, 2) AS residual_m, round(closest_m, 2) AS closest_m, round(farthest_m, 2) AS farthest_m FROM res", "res"),
        "tri_gates": chain("SELECT cluster_id, class, CASE WHEN reject_reason IS NULL THEN 'ok' ELSE 'rejected' END AS status, reject_reason, nr AS n_rays, n_cluster, CASE WHEN nr > 1 THEN round(round(baseline_m, 2), 1) END AS baseline_m, CASE WHEN nr > 1 THEN round(round(spread_deg, 2), 1) END AS spread_deg, CASE WHEN nr > 1 AND coalesce(reject_reason, '') <> 'singular_matrix' THEN round(round(residual_m, 2), 1) END AS residual_m, CASE WHEN nr > 1 AND coalesce(reject_reason, '') <> 'singular_matrix' THEN round(round(closest_m, 2), 1) END AS closest_m, CASE WHEN nr > 1 AND coalesce(reject_reason, '') <> 'singular_matrix' THEN round(round(farthest_m, 2), 1) END AS farthest_m, CASE WHEN nr > 1 AND coalesce(reject_reason, '') <> 'singular_matrix' THEN round(round(raw_lat, 7), 6) END AS raw_lat, CASE WHEN nr > 1 AND coalesce(reject_reason, '') <> 'singular_matrix' THEN round(round(raw_lon, 7), 6) END AS raw_lon FROM tri", "tri"),
        "fallback_point": chain("SELECT cluster_id, round(base_lat, 6) AS base_lat, round(base_lon, 6) AS base_lon, round(max_d, 3) AS max_d, round(offset_m, 4) AS offset_m, round(proj_bearing, 1) AS proj_bearing, round(fb_lat, 6) AS fb_lat, round(fb_lon, 6) AS fb_lon FROM fal", "fal"),
        "placement": chain("SELECT cluster_id, class, round(lat, 6) AS lat, round(lon, 6) AS lon, coord_source, clamp_reason, n AS num_detections_merged, coords_from_frame, image_from_frame FROM ass", "ass"),
        "pin_recompute": chain("SELECT cluster_id, round(distance_m, 1) AS distance_m, round(obj_bearing, 0) AS obj_bearing FROM ass", "ass"),
        "conflict_pairs": chain("SELECT job_id, a, b, round(d, 1) AS dist_ft FROM pairs", "pairs"),
        "geojson_features": chain("SELECT * REPLACE (round(latitude, 6) AS latitude, round(longitude, 6) AS longitude) FROM feat"),
        "deduped_features": chain("SELECT job_id, 'detection' AS type, class_id, class AS class_name, confidence, n AS num_detections_merged, round(lat, 6) AS latitude, round(lon, 6) AS longitude, 0e0 AS elevation_m, round(distance_m, 1) AS distance_m, round(obj_bearing, 0) AS obj_bearing, cam_lat, cam_lng, cam_bearing, gps_source, image_file, timestamp_iso AS timestamp, video_sec, array_to_string(list_transform(times, lambda z: CAST(z AS VARCHAR)), '|') AS members_video_sec FROM ass", "ass"),
        "assets_report": chain("""SELECT job_id, coalesce(nullif(coords_from_frame, 0)::VARCHAR, nullif(image_from_frame, 0)::VARCHAR, timestamp_iso) AS asset_id, class, round(lat, 6) AS solved_lat, round(lon, 6) AS solved_lon, coord_source AS solve_method, n AS num_observations, round(mean_conf, 3) AS mean_conf, CASE WHEN nr > 1 THEN round(round(baseline_m, 2), 1) END AS baseline_m, CASE WHEN nr > 1 THEN round(round(spread_deg, 2), 1) END AS ray_angle_deg, CASE WHEN reject_reason IS NULL THEN round(round(residual_m, 2), 1) END AS residual_m, coalesce(reject_reason, clamp_reason) AS rejection_reason, array_to_string(frames, '|') AS source_frames, CASE WHEN nr > 1 AND coalesce(reject_reason, '') <> 'singular_matrix' THEN round(round(raw_lat, 7), 6) END AS raw_tri_lat, CASE WHEN nr > 1 AND coalesce(reject_reason, '') <> 'singular_matrix' THEN round(round(raw_lon, 7), 6) END AS raw_tri_lon, CASE WHEN nr > 1 AND coalesce(reject_reason, '') <> 'singular_matrix' THEN round(round(closest_m, 2), 1) END AS tri_closest_dist_m, CASE WHEN nr > 1 AND coalesce(reject_reason, '') <> 'singular_matrix' THEN round(round(farthest_m, 2), 1) END AS tri_farthest_dist_m, class_id, confidence, 0e0 AS elevation_m, round(distance_m, 1) AS distance_m, round(obj_bearing, 0) AS obj_bearing, cam_lat, cam_lng, cam_bearing, round(offset_m, 4) AS offset_m, round(proj_bearing, 1) AS offset_bearing, gps_source, timestamp_iso, video_sec, array_to_string(list_transform(times, lambda z: CAST(z AS VARCHAR)), '|') AS members_video_sec, image_file, coords_from_frame, image_from_frame FROM ass""", "ass"),
        "tri_debug_report": chain("""SELECT t.job_id, t.class, x.frame_id AS frame_a, y.frame_id AS frame_b, x.cam_lat AS cam_a_lat, x.cam_lng AS cam_a_lng, x.cam_bearing AS cam_a_bearing, y.cam_lat AS cam_b_lat, y.cam_lng AS cam_b_lng, y.cam_bearing AS cam_b_bearing, CASE WHEN t.nr > 1 THEN round(round(t.baseline_m, 2), 1) END AS baseline_m, CASE WHEN t.nr > 1 AND coalesce(t.reject_reason, '') <> 'singular_matrix' THEN round(round(t.raw_lat, 7), 6) END AS solved_lat, CASE WHEN t.nr > 1 AND coalesce(t.reject_reason, '') <> 'singular_matrix' THEN round(round(t.raw_lon, 7), 6) END AS solved_lon, CASE WHEN t.nr > 1 AND coalesce(t.reject_reason, '') <> 'singular_matrix' THEN round(round(t.closest_m, 2), 1) END AS distance_from_track_m, CASE WHEN t.nr > 1 AND coalesce(t.reject_reason, '') <> 'singular_matrix' THEN round(round(t.farthest_m, 2), 1) END AS farthest_from_track_m, CASE WHEN t.nr > 1 AND coalesce(t.reject_reason, '') <> 'singular_matrix' THEN round(round(t.residual_m, 2), 1) END AS residual_m, x.obj_bearing AS obj_bearing_a, y.obj_bearing AS obj_bearing_b, CASE WHEN t.nr > 1 THEN round(round(t.spread_deg, 2), 1) END AS intersection_angle_deg, t.nr AS n_rays, t.n AS n_cluster, CASE WHEN t.reject_reason IS NULL THEN 'True' ELSE 'False' END AS accept, t.reject_reason
FROM (SELECT p.*, coalesce(p.a, m.a1) AS a2, coalesce(p.b, m.b1) AS b2 FROM pl p JOIN (SELECT cluster_id, min(CASE WHEN k = 1 THEN entry_seq END) AS a1, min(CASE WHEN k = 2 THEN entry_seq END) AS b1 FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY entry_seq) AS k FROM mem) z GROUP BY cluster_id) m USING (cluster_id)) t LEFT JOIN mem x ON x.entry_seq = t.a2 LEFT JOIN mem y ON y.entry_seq = t.b2""", "pl"),
        "kml_placemarks": chain(_MARKS),
        "kml_document": chain(_KML),
        "path_log": chain("SELECT job_id, cluster_id, CAST(ord AS INTEGER) AS ord, line FROM log", "log"),
        "log_tail": chain("SELECT job_id, CAST(place AS INTEGER) AS place, cluster_id, CAST(ord AS INTEGER) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY cluster_id DESC, ord DESC) AS place FROM log) t WHERE place <= 40", "log"),
        "cross_class_dedup": chain("SELECT job_id, cluster_id, class FROM ass WHERE cluster_id NOT IN (SELECT cluster_id FROM gone)", "gone"),
        "job_summary": chain(f"""SELECT f.job_id, frames_processed, ocr_hits, gpx_hits, ocr_misses_count, coalesce(ocr_misses, '') AS ocr_misses, coalesce(ocr_samples, '') AS ocr_samples, coalesce(raw_detections, 0) AS raw_detections, coalesce(kept_detections, 0) AS kept_detections, coalesce(no_gps_drops, 0) AS no_gps_drops, coalesce(detections_per_frame, 0) AS detections_per_frame, coalesce(detections, 0) AS detections,
  CASE WHEN coalesce(raw_detections, 0) = 0 THEN 'no boxes' WHEN coalesce(kept_detections, 0) = 0 THEN 'class filter dropped all' WHEN no_gps_drops > 0 THEN 'some without position' ELSE 'complete' END AS hint
FROM (SELECT job_id, count(*) AS frames_processed, count(*) FILTER (WHERE gps_source = 'ocr') AS ocr_hits, count(*) FILTER (WHERE gps_source = 'gpx') AS gpx_hits, count(*) FILTER (WHERE gps_source IS DISTINCT FROM 'ocr') AS ocr_misses_count FROM ({scenes.FRAMES}) x GROUP BY 1) f
  LEFT JOIN (SELECT job_id, string_agg(frame_idx::VARCHAR, '|' ORDER BY frame_idx) FILTER (WHERE k <= 20) AS ocr_misses, string_agg(frame_idx || ':' || top_text, '|' ORDER BY frame_idx) FILTER (WHERE k <= 8) AS ocr_samples FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY frame_idx) AS k FROM ({scenes.FRAMES}) x WHERE gps_source IS DISTINCT FROM 'ocr') m GROUP BY 1) m USING (job_id)
  LEFT JOIN (SELECT job_id, count(*) AS raw_detections FROM scene GROUP BY 1) r USING (job_id)
  LEFT JOIN (SELECT job_id, count(*) AS kept_detections, count(*) FILTER (WHERE cam_lat IS NULL) AS no_gps_drops, count(*) FILTER (WHERE cam_lat IS NOT NULL) AS detections_per_frame FROM kept GROUP BY 1) k USING (job_id)
  LEFT JOIN (SELECT job_id, count(*) AS detections FROM ass WHERE cluster_id NOT IN (SELECT cluster_id FROM gone) GROUP BY 1) a USING (job_id)""", "gone"),
    }
