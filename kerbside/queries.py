"""The registered queries: each an operator or report over whole derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside import params as P
from kerbside import scenes, sinks
from kerbside.functions import geo, media, overlay
from kerbside.operators import cluster, detect, merge, suppress, track, triangulate
from kerbside.plans.pipeline import Result, from_boxes, job_summary
from kerbside.plans.scratch import Scratch
from kerbside.sources import gpx, labels, listing

Query = Callable[[SparkSession, str], DataFrame]


def _kept(s: SparkSession, d: str) -> DataFrame:
    p = P.class_params(s)
    return detect.confident(detect.named(scenes.scene(s, d), p), p)


def _projected(s: SparkSession, d: str) -> DataFrame:
    return detect.projected(detect.crops(_kept(s, d)), P.class_params(s))


def _run(s: SparkSession, d: str, suppressed: bool = False) -> Result:
    return from_boxes(s, scenes.scene(s, d), suppress_conflicts=suppressed)


def _of_rays(s: SparkSession, d: str) -> Result:
    """A run of which members and their triangulation alone are read."""
    return from_boxes(s, scenes.scene(s, d), rays_only=True)


def _rays(s: SparkSession, d: str) -> DataFrame:
    """Rays of clusters of two members or more: those of one have no baseline, spread or solution."""
    return triangulate.local_rays(_of_rays(s, d).members.where("cluster_n > 1"))


def _pairs_of_events(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select("event_id")
    x = {"lat1": 30.0 + F.col("event_id") % 97 / 100.0, "lon1": -86.0 - F.col("event_id") % 89 / 100.0}
    e = e.withColumns(x).withColumn("lat2", F.col("lat1") + (F.col("event_id") % 7 - 3) / 1000.0)
    return e.withColumn("lon2", F.col("lon1") + (F.col("event_id") % 11 - 5) / 1000.0)


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Boxes, kept and projected: count and mean distance by class."""
    p = _projected(s, d)
    return p.groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg("distance_m"), 3).alias("mean_distance_m"))


def haversine(s: SparkSession, d: str) -> DataFrame:
    a = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    return _pairs_of_events(s, d).select("event_id", F.round(geo.haversine_ft(*a), 3).alias("ft"), F.round(geo.haversine_m(*a), 3).alias("m"), F.round(geo.azimuth_deg(*a), 4).alias("azimuth"))


def destination(s: SparkSession, d: str) -> DataFrame:
    e = _pairs_of_events(s, d)
    lat, lon = geo.destination(F.col("lat1"), F.col("lon1"), F.radians(F.col("event_id") % 360), F.col("event_id") % 150 + 0.5, P.EARTH_PROJECT_M)
    return e.select("event_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def object_bearing(s: SparkSession, d: str) -> DataFrame:
    return scenes.scene(s, d).select("entry_seq", F.round(geo.object_bearing_deg(F.col("entry_seq") % 360 * 1.0, F.col("cx")), 3).alias("bearing"))


def mono_distance(s: SparkSession, d: str) -> DataFrame:
    p = detect.with_params(detect.named(scenes.scene(s, d), P.class_params(s)), P.class_params(s).select("class", "height_m"))
    return p.select("entry_seq", F.round(geo.mono_distance_m(F.col("height_m"), F.col("h") * 1920, F.lit(1920)), 3).alias("distance_m"))


def dms_decimal(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select("event_id")
    side = F.when(F.col("event_id") % 4 == 0, "N").when(F.col("event_id") % 4 == 1, "s").when(F.col("event_id") % 4 == 2, "E").otherwise("W")
    return e.select("event_id", F.round(geo.dms_decimal(F.col("event_id") % 90, F.col("event_id") % 60, F.col("event_id") % 59 + 0.5, side), 6).alias("deg"))


def project_detections(s: SparkSession, d: str) -> DataFrame:
    return detect.detections(_projected(s, d)).select("entry_seq", "class", F.round("obj_lat", 6).alias("obj_lat"), F.round("obj_lng", 6).alias("obj_lng"), "distance_m", "obj_bearing")


def _texts(s: SparkSession, d: str) -> DataFrame:
    return scenes.derive(s, d, scenes.TEXTS)


def ocr_clean(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("frame_idx", overlay.clean_number(F.col("text")).alias("cleaned"))


def ocr_coords(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, d).withColumn("c", overlay.text_coords(F.col("text")))
    return t.select("frame_idx", F.round("c.lat", 6).alias("lat"), F.round("c.lng", 6).alias("lng"))


def ocr_anchor(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, d).withColumn("c", overlay.anchor_coords(F.col("text")))
    return t.select("frame_idx", F.round("c.lat", 6).alias("lat"), F.round("c.lng", 6).alias("lng"))


def ocr_bearing(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("frame_idx", F.round(overlay.text_bearing(F.col("text")), 2).alias("bearing"))


def _ocr(s: SparkSession, d: str) -> DataFrame:
    third = F.col("frame_idx") % 3
    t = _texts(s, d)
    text = lambda k: F.when(third == k, F.col("text")).otherwise(F.lit("EXCEPTION: none") if k else F.lit(""))
    return t.select("job_id", "frame_idx", overlay.region_cascade(text(0), text(1), text(2)).alias("o"))


def ocr_region_cascade(s: SparkSession, d: str) -> DataFrame:
    return _ocr(s, d).select("frame_idx", F.round("o.lat", 6).alias("lat"), F.round("o.lng", 6).alias("lng"), "o.bearing", "o.region", "o.method")


def crop_rects(s: SparkSession, d: str) -> DataFrame:
    return detect.crops(_kept(s, d)).select("entry_seq", "det", "image_file", "rect.x0", "rect.y0", "rect.x1", "rect.y1")


def frame_time(s: SparkSession, d: str) -> DataFrame:
    t = scenes.times(s, d)
    n, off = media.frame_number(F.col("frame_idx"), F.lit(29.97), F.lit(0.5)), media.offset_seconds(F.col("frame_idx"), F.lit(0.5))
    return t.select("frame_idx", n.cast("long").alias("frame_num"), off.alias("offset_sec"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("iso"))


def _probe(kind: str) -> Column:
    if kind == "start_time":
        return F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"format":{"tags":{"creation_time":"2026-01-01T00:00:'), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit('.000000Z"}}}'))).when(F.col("event_id") % 3 == 1, F.lit('{"format":{"tags":{"date":"2026-02-03T04:05:06+02:00"}}}')).otherwise(F.lit('{"format":{}}'))
    return F.when(F.col("event_id") % 3 == 0, F.lit('{"streams":[{"codec_type":"audio","r_frame_rate":"0/0"},{"codec_type":"video","r_frame_rate":"30000/1001","tags":{"rotate":"90"}}]}')).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"streams":[{"codec_type":"video","r_frame_rate":"'), (F.col("event_id") % 50 + 10).cast("string"), F.lit('/1"}]}'))).otherwise(F.lit('{"streams":[]}'))


def start_time(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", _probe("start_time").alias("j"))
    return e.select("event_id", F.unix_seconds(media.video_start(F.col("j"))).alias("start_s"))


def fps_parse(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", _probe("fps_parse").alias("j"))
    return e.select("event_id", F.round(media.video_fps(F.col("j")), 4).alias("fps"), media.video_rotation(F.col("j")).alias("rotation"))


def exif_time(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select("event_id")
    at = F.concat(F.lit("2026:01:0"), (F.col("event_id") % 9 + 1).cast("string"), F.lit(" 10:00:"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"))
    original = F.when(F.col("event_id") % 3 == 0, at)
    changed = F.when(F.col("event_id") % 3 == 1, at).when(F.col("event_id") % 3 == 2, "unknown")
    return e.select("event_id", F.unix_seconds(media.exif_time(original, changed)).alias("taken_s"))


def _track(s: SparkSession, d: str) -> DataFrame:
    return track.interpolated(scenes.track(s, d), scenes.times(s, d))


def gpx_points(s: SparkSession, d: str) -> DataFrame:
    """The track written as GPX, a folder of files a job, with each tenth point as a waypoint too, and read back."""
    t = scenes.track(s, d)
    tag = lambda name: F.format_string(f'<{name} lat="%s" lon="%s"><ele>%s</ele><time>%s</time></{name}>', F.col("lat").cast("string"), F.col("lng").cast("string"), F.col("ele").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    wpt = t.where("pt_seq % 10 = 0").withColumn("ele", F.lit(0.0))
    path = Scratch(s).path("gpx")
    jobs = t.select("job_id").distinct()
    rows = t.select("job_id", F.lit(1).alias("ord"), tag("trkpt").alias("value")).union(wpt.select("job_id", F.lit(3), tag("wpt")))
    for ord_, text in ((0, '<gpx version="1.1"><trk><trkseg>'), (2, "</trkseg></trk>"), (4, "</gpx>")):
        rows = rows.union(jobs.select("job_id", F.lit(ord_), F.lit(text)))
    rows.repartition("job_id").sortWithinPartitions("job_id", "ord").drop("ord").write.partitionBy("job_id").text(path)
    p = gpx.gpx_points(s, path, lambda file: F.regexp_extract(file, "job_id=([0-9]+)", 1).cast("long"))
    return p.select("job_id", F.col("pt_seq").alias("place"), F.unix_seconds("ts").alias("sec"), "lat", "lng", "ele")


def gps_interpolate(s: SparkSession, d: str) -> DataFrame:
    r = F.round
    return _track(s, d).select("frame_idx", r("lat", 6).alias("lat"), r("lng", 6).alias("lng"), r("ele", 4).alias("ele"))


def pose_resolve(s: SparkSession, d: str) -> DataFrame:
    """Poses of all frames: from their texts, where these hold a position, else from the track."""
    ocr = _ocr(s, d).where("o IS NOT NULL").select("job_id", "frame_idx", "o.lat", "o.lng", "o.bearing")
    frames = scenes.times(s, d).select("job_id", "frame_idx")
    p = track.resolved(frames, ocr, _track(s, d))
    return p.select("frame_idx", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.round("ele", 4).alias("ele"), F.round("bearing", 2).alias("bearing"), "gps_source")


def _frames(s: SparkSession, d: str) -> DataFrame:
    return scenes.scene(s, d).select("job_id", "frame_idx", F.col("ts").alias("offset_sec"), "timestamp_iso", "cam_lat", "cam_lng", "cam_bearing", "ele", "gps_source").distinct()


def track_line(s: SparkSession, d: str) -> DataFrame:
    """Tracks by their ends and by the points in all pieces of their lines."""
    f = _frames(s, d)
    points = sinks.track_pieces(f).groupBy("job_id").agg(F.sum(F.size(F.split("coordinates", " "))).cast("int").alias("n_coordinates"))
    return sinks.track_ends(f).join(points, "job_id").select("job_id", "n_points", "n_coordinates", "start_iso", "end_iso")


def _label_text(i: Column) -> Column:
    line = F.concat((i % 28).cast("string"), F.lit(" 0.5 0.25  0.1 0.2"))
    more = F.when(i % 3 == 0, F.concat(F.lit(" 0."), i.cast("string"))).otherwise("")
    return F.concat(line, more, F.lit("\n1 2 3\nx 0.1 0.1 0.1 0.1 0.9\n\n"), line, F.lit(" nope\n"), line)


def parse_labels(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select("event_id")
    p = labels.parsed(e.select("event_id", _label_text(F.col("event_id")).alias("value")))
    return p.select("event_id", "line_no", "class_id", "cx", "cy", "w", "h", "confidence")


def label_files(s: SparkSession, d: str) -> DataFrame:
    """Label files, one for each hundredth of the events by number, written and read back: lines and sums of what they hold."""
    e = s.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 100).alias("f"), _label_text(F.col("event_id")).alias("value"))
    path = Scratch(s).path("labels")
    e.repartition("f").write.partitionBy("f").text(path)
    p = labels.label_files(s, path, lambda file: F.regexp_extract(file, "f=([0-9]+)", 1).cast("long"))
    return p.groupBy("stem").agg(F.count("*").alias("n"), F.sum("class_id").alias("classes"), F.round(F.sum("confidence"), 4).alias("confidence"))


def frame_index(s: SparkSession, d: str) -> DataFrame:
    f = scenes.derive(s, d, scenes.LISTING).select("job_id", F.concat("path", F.lit("/"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("path"), (F.col("event_id") % 5 != 0).alias("readable"))
    return track.indexed(f).select("job_id", "path", "frame_idx")


def class_names(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 33).cast("int").alias("class_id"))
    return detect.named(e, P.class_params(s)).select("event_id", "class_id", "class")


def class_params_join(s: SparkSession, d: str) -> DataFrame:
    p = P.class_params(s)
    x = detect.with_params(detect.named(scenes.scene(s, d), p).select("entry_seq", "class"), p.drop("class_id"))
    default = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return x.select("entry_seq", "class", default("min_conf", P.DEFAULT_CONF), "height_m", default("eps_ft", P.DEFAULT_EPS_FT), default("offset_m", P.DEFAULT_OFFSET_M), default("max_m", P.DEFAULT_MAX_M), default("stretch", P.DEFAULT_STRETCH), default("min_frames", P.DEFAULT_MIN_FRAMES))


def conf_filter(s: SparkSession, d: str) -> DataFrame:
    return _kept(s, d).select("entry_seq", "class", "confidence")


def detector_threshold(s: SparkSession, d: str) -> DataFrame:
    """What a detector is asked for, by the classes that the scene has."""
    seen = scenes.scene(s, d).select("class_id").distinct()
    return detect.detector_threshold(P.class_params(s).join(seen, "class_id", "left_semi"), 0.5)


def image_count(s: SparkSession, d: str) -> DataFrame:
    return listing.image_count(scenes.derive(s, d, scenes.LISTING))


def incoming_images(s: SparkSession, d: str) -> DataFrame:
    return listing.incoming(scenes.derive(s, d, scenes.LISTING)).select("event_id", "path")


def latest_model(s: SparkSession, d: str) -> DataFrame:
    return listing.latest_model(scenes.derive(s, d, scenes.LISTING))


def model_list(s: SparkSession, d: str) -> DataFrame:
    return listing.models(scenes.derive(s, d, scenes.LISTING))


def training_runs(s: SparkSession, d: str) -> DataFrame:
    return listing.training_runs(scenes.derive(s, d, scenes.LISTING))


def run_counts(s: SparkSession, d: str) -> DataFrame:
    f = scenes.derive(s, d, scenes.LISTING)
    runs = f.select(F.element_at(F.split("path", "/"), 2).alias("run")).distinct()
    return listing.run_counts(runs, f)


def entries(s: SparkSession, d: str) -> DataFrame:
    e = detect.entries(_projected(s, d))
    return e.select("entry_seq", "job_id", "frame_id", "timestamp", "class", "confidence", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "bbox_area", "distance_m", "obj_bearing", "cam_lat", "cam_lng", "cam_bearing", "timestamp_iso")


def frames_with_boxes(s: SparkSession, d: str) -> DataFrame:
    """All frames with their boxes; those of the job without boxes stay."""
    stem = F.col("frame_idx").cast("string").alias("stem")
    frames = scenes.derive(s, d, scenes.FRAMES).select("job_id", stem)
    boxes = scenes.scene(s, d).select("job_id", stem, "entry_seq")
    return detect.frames_with_boxes(frames, boxes).select("job_id", "stem", "entry_seq")


def miss_sample(s: SparkSession, d: str) -> DataFrame:
    """First 20 frames of each job whose text holds no position: a report, limited as such."""
    from pyspark.sql import Window

    miss = _ocr(s, d).where("o IS NULL")
    k = F.row_number().over(Window.partitionBy("job_id").orderBy("frame_idx"))
    return miss.withColumn("k", k).where("k <= 20").select("job_id", "frame_idx", "k")


def class_groups(s: SparkSession, d: str) -> DataFrame:
    return cluster.class_order(detect.entries(_projected(s, d)))


def proximity_pairs(s: SparkSession, d: str) -> DataFrame:
    p = cluster.proximity_pairs(detect.entries(_projected(s, d)), P.class_params(s))
    return p.select("job_id", "a", "b", F.round("dist_ft", 3).alias("dist_ft"))


def clusters(s: SparkSession, d: str) -> DataFrame:
    return cluster.linked(_run(s, d).entries, P.class_params(s)).select("entry_seq", "cluster_id")


def min_frames_filter(s: SparkSession, d: str) -> DataFrame:
    return _run(s, d).members.select("entry_seq", "cluster_id")


def area_norm(s: SparkSession, d: str) -> DataFrame:
    return cluster.scored(_run(s, d).members).select("entry_seq", F.round("norm_area", 4).alias("norm_area"), F.round("score", 4).alias("score"))


def cluster_best(s: SparkSession, d: str) -> DataFrame:
    return _run(s, d).clusters.select("cluster_id", F.col("closest.entry_seq").alias("closest"), F.col("best.entry_seq").alias("best"))


def cluster_stats(s: SparkSession, d: str) -> DataFrame:
    c = _run(s, d).clusters
    times = F.array_join(F.transform("members_video_sec", lambda x: x.cast("int").cast("string")), "|")
    return c.select("cluster_id", "class", "n", F.round("mean_conf", 3).alias("mean_conf"), "min_mono_m", times.alias("members_video_sec"), sinks.joined(F.col("source_frames")).alias("source_frames"), "bearings", "unique_cam_pos")


def tri_local_xy(s: SparkSession, d: str) -> DataFrame:
    return triangulate.local_rays(_of_rays(s, d).members).select("entry_seq", (F.round("x", 2) + 0.0).alias("x"), (F.round("y", 2) + 0.0).alias("y"), "n_rays")


def tri_baseline(s: SparkSession, d: str) -> DataFrame:
    return triangulate.baseline(_rays(s, d)).select("cluster_id", F.round("baseline_m", 3).alias("baseline_m"))


def tri_spread(s: SparkSession, d: str) -> DataFrame:
    return triangulate.spread(_rays(s, d)).select("cluster_id", F.round("spread_deg", 3).alias("spread_deg"), "a", "b")


def tri_solve(s: SparkSession, d: str) -> DataFrame:
    t = triangulate.solved(_rays(s, d))
    return t.select("cluster_id", "singular", F.round("raw_lat", 5).alias("raw_lat"), F.round("raw_lon", 5).alias("raw_lon"))


def tri_residuals(s: SparkSession, d: str) -> DataFrame:
    rays = _rays(s, d)
    t = triangulate.residuals(rays, triangulate.solved(rays))
    return t.select("cluster_id", *(geo.rounded(F.col(c), 2).alias(c) for c in ("residual_m", "closest_m", "farthest_m")))


def tri_gates(s: SparkSession, d: str) -> DataFrame:
    t = _of_rays(s, d).tri
    near = lambda c, n: geo.rounded(F.col(c), n).alias(c)
    return t.select("cluster_id", "class", "status", "reject_reason", "n_rays", "n_cluster", near("baseline_m", 1), near("spread_deg", 1), near("residual_m", 1), near("closest_m", 1), near("farthest_m", 1), near("raw_lat", 6), near("raw_lon", 6))


def fallback_point(s: SparkSession, d: str) -> DataFrame:
    f = merge.fallback(_run(s, d).clusters, P.class_params(s))
    r = F.round
    return f.select("cluster_id", r("base_lat", 6).alias("base_lat"), r("base_lon", 6).alias("base_lon"), r("max_d", 3).alias("max_d"), r("offset_m", 4).alias("offset_m"), r("proj_bearing", 1).alias("proj_bearing"), r("fb_lat", 6).alias("fb_lat"), r("fb_lon", 6).alias("fb_lon"))


def placement(s: SparkSession, d: str) -> DataFrame:
    a = _run(s, d).placed
    return a.select("cluster_id", "class", geo.rounded(F.col("lat"), 6).alias("lat"), geo.rounded(F.col("lon"), 6).alias("lon"), "coord_source", "clamp_reason", "num_detections_merged", "coords_from_frame", "image_from_frame")


def pin_recompute(s: SparkSession, d: str) -> DataFrame:
    a = _run(s, d).placed
    return a.select("cluster_id", geo.rounded(F.col("distance_m"), 1).alias("distance_m"), geo.rounded(F.col("obj_bearing"), 0).alias("obj_bearing"))


def conflict_pairs(s: SparkSession, d: str) -> DataFrame:
    c = suppress.conflict_pairs(_run(s, d).placed, P.confusion_pairs(s))
    return c.select("job_id", "a", "b", F.round("dist_ft", 1).alias("dist_ft"))


def cross_class_dedup(s: SparkSession, d: str) -> DataFrame:
    return _run(s, d, True).assets.select("job_id", "cluster_id", "class")


def geojson_features(s: SparkSession, d: str) -> DataFrame:
    f = sinks.frame_features(_frames(s, d), detect.detections(_projected(s, d)))
    return f.withColumns({"latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6)})


def deduped_features(s: SparkSession, d: str) -> DataFrame:
    f = sinks.asset_features(_run(s, d).placed)
    return f.withColumns({"latitude": geo.rounded(F.col("latitude"), 6), "longitude": geo.rounded(F.col("longitude"), 6), "distance_m": geo.rounded(F.col("distance_m"), 1), "obj_bearing": geo.rounded(F.col("obj_bearing"), 0), "members_video_sec": sinks.joined(F.col("members_video_sec"))})


def assets_report(s: SparkSession, d: str) -> DataFrame:
    places = {"solved_lat": 6, "solved_lon": 6, "mean_conf": 3, "baseline_m": 1, "ray_angle_deg": 1, "residual_m": 1, "raw_tri_lat": 6, "raw_tri_lon": 6, "tri_closest_dist_m": 1, "tri_farthest_dist_m": 1, "distance_m": 1, "obj_bearing": 0, "offset_m": 4}
    return sinks.assets_report(_run(s, d).placed).withColumns({c: geo.rounded(F.col(c), n) for c, n in places.items()})


def tri_debug_report(s: SparkSession, d: str) -> DataFrame:
    places = {"baseline_m": 1, "intersection_angle_deg": 1, "solved_lat": 6, "solved_lon": 6, "distance_from_track_m": 1, "farthest_from_track_m": 1, "residual_m": 1}
    return sinks.tri_debug_report(_run(s, d).placed).withColumns({c: geo.rounded(F.col(c), n) for c, n in places.items()})


def kml_placemarks(s: SparkSession, d: str) -> DataFrame:
    """Placemarks with their whole popups; positions and distances of assets, as they are texts here, to a metre and a degree."""
    tracks = sinks.frame_features(_frames(s, d), detect.detections(_projected(s, d))).where("type = 'gps_track'")
    assets = sinks.asset_features(_run(s, d).placed).withColumns({"latitude": F.round("latitude", 5), "longitude": F.round("longitude", 5), "distance_m": F.round("distance_m", 0), "obj_bearing": F.round("obj_bearing", 0)})
    return sinks.placemarks(assets.unionByName(tracks, allowMissingColumns=True))


def kml_document(s: SparkSession, d: str) -> DataFrame:
    """The whole KML document of kml_placemarks and track lines, by part: elements, placemarks opened and closed, and a sum over the hashes of its texts (none for head and tail, which are fixed)."""
    k = sinks.kml_document("all", _frames(s, d), kml_placemarks(s, d))
    ends = F.col("ord").isin(0, 9)
    opened = F.col("value").startswith("<Placemark>")
    digest = F.conv(F.substring(F.md5("value"), 1, 8), 16, 10).cast("long")
    return k.groupBy("ord").agg(F.count_if(ends | opened).alias("n"), F.count_if(opened).alias("placemarks"), F.count_if(F.col("value").endswith("</Placemark>")).alias("closed"), F.sum(F.when(~ends, digest)).alias("digest"))


def path_log(s: SparkSession, d: str) -> DataFrame:
    return sinks.path_log(_run(s, d).placed)


def log_tail(s: SparkSession, d: str) -> DataFrame:
    """The last 40 log lines of each job: a report, limited as such."""
    return sinks.last_lines(sinks.path_log(_run(s, d).placed)).select("job_id", "place", "cluster_id", "ord")


def job_summary_query(s: SparkSession, d: str) -> DataFrame:
    r = from_boxes(s, scenes.scene(s, d), write_kept=True)
    return job_summary(scenes.derive(s, d, scenes.FRAMES), scenes.scene(s, d), r.kept, r.assets)


def queries() -> dict[str, Query]:
    plain = (
        flagship, haversine, destination, object_bearing, mono_distance, dms_decimal, project_detections, ocr_clean, ocr_coords, ocr_anchor, ocr_bearing, ocr_region_cascade, crop_rects, frame_time, start_time, fps_parse, exif_time,
        gpx_points, parse_labels, label_files, frame_index, class_names, class_params_join, conf_filter, detector_threshold, image_count, incoming_images, latest_model, model_list, training_runs, run_counts, entries, frames_with_boxes, miss_sample,
        gps_interpolate, pose_resolve, track_line, class_groups, proximity_pairs, clusters, min_frames_filter, area_norm, cluster_best, cluster_stats,
        tri_local_xy, tri_baseline, tri_spread, tri_solve, tri_residuals, tri_gates, fallback_point, placement, pin_recompute, conflict_pairs, cross_class_dedup,
        geojson_features, deduped_features, assets_report, tri_debug_report, kml_placemarks, kml_document, path_log, log_tail,
    )
    return {f.__name__: f for f in plain} | {"job_summary": job_summary_query}
