"""Reports: features, tables, placemarks and logs, and the files they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside import documents
from kerbside import params as P
from kerbside.plans.scratch import Scratch

#: Rows of a text document: part, order in the part, and a value of one line or more.
ROWS = "ord int, key array<string>, value string"

# Columns of the two tables, in order.
ASSETS_COLUMNS = ("asset_id", "class", "solved_lat", "solved_lon", "solve_method", "num_observations", "mean_conf", "baseline_m", "ray_angle_deg", "residual_m", "rejection_reason", "source_frames", "raw_tri_lat", "raw_tri_lon", "tri_closest_dist_m", "tri_farthest_dist_m", "class_id", "confidence", "elevation_m", "distance_m", "obj_bearing", "cam_lat", "cam_lng", "cam_bearing", "offset_m", "offset_bearing", "gps_source", "timestamp_iso", "video_sec", "members_video_sec", "image_file", "coords_from_frame", "image_from_frame")
DEBUG_COLUMNS = ("class", "frame_a", "frame_b", "cam_a_lat", "cam_a_lng", "cam_a_bearing", "cam_b_lat", "cam_b_lng", "cam_b_bearing", "obj_bearing_a", "obj_bearing_b", "baseline_m", "intersection_angle_deg", "solved_lat", "solved_lon", "distance_from_track_m", "farthest_from_track_m", "residual_m", "n_rays", "n_cluster", "accept", "reject_reason")


def frame_features(frames: DataFrame, det: DataFrame) -> DataFrame:
    """One row a feature: each kept box of a posed frame, or the frame itself if it has none. Frames without pose have none.

    frames: job_id, frame_idx, offset_sec, timestamp_iso, cam_lat, cam_lng, cam_bearing, ele, gps_source.
    det: job_id, frame_idx and the rounded columns of detect.detections, with class, class_id, image_file.
    """
    d = det.select("job_id", "frame_idx", "class_id", F.col("class").alias("class_name"), "confidence", "obj_lat", "obj_lng", "distance_m", "obj_bearing", "cx", "cy", "w", "h", "image_file")
    f = frames.where("cam_lat IS NOT NULL").join(d, ["job_id", "frame_idx"], "left")
    lat, lng = F.coalesce("obj_lat", "cam_lat"), F.coalesce("obj_lng", "cam_lng")
    box = F.col("class_id").isNotNull()
    return f.select(
        "job_id", F.when(box, "detection").otherwise("gps_track").alias("type"), "class_id", "class_name", "confidence", F.col("frame_idx").alias("frame_num"), F.col("offset_sec").alias("video_sec"), F.col("timestamp_iso").alias("timestamp"),
        F.round(lat, 7).alias("latitude"), F.round(lng, 7).alias("longitude"), F.round("ele", 2).alias("elevation_m"), "distance_m", "obj_bearing",
        F.when(box, F.round("cam_lat", 7)).alias("cam_lat"), F.when(box, F.round("cam_lng", 7)).alias("cam_lng"), F.round("cam_bearing", 1).alias("cam_bearing"),
        F.col("cx").alias("bbox_cx"), F.col("cy").alias("bbox_cy"), F.col("w").alias("bbox_w"), F.col("h").alias("bbox_h"), "gps_source", "image_file",
    )


def asset_features(assets: DataFrame) -> DataFrame:
    """Assets as rows of features, one each in no order: no elevation is 0, no time an empty text, other nulls stay."""
    return assets.select(
        "job_id", F.lit("detection").alias("type"), "class_id", F.col("class").alias("class_name"), "confidence", "num_detections_merged", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.coalesce("elevation_m", F.lit(0.0)).alias("elevation_m"),
        "distance_m", "obj_bearing", "cam_lat", "cam_lng", "cam_bearing", "gps_source", "image_file", F.coalesce("timestamp_iso", F.lit("")).alias("timestamp"), "video_sec", "members_video_sec",
    )


def _feature(features: DataFrame) -> Column:
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude", "elevation_m").alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*(c for c in features.columns if c != "job_id")).alias("properties")), {"ignoreNullFields": "false"}).alias("value")


def geojson(features: DataFrame) -> DataFrame:
    """One GeoJSON Feature a row, in column value."""
    return features.select("job_id", _feature(features))


def feature_collection(features: DataFrame) -> DataFrame:
    """One GeoJSON document in rows (ord, key, value), a line a feature, by job and frame or time; written by write_text."""
    when = F.col("frame_num") if "frame_num" in features.columns else F.round(F.col("video_sec") * 1000)
    rows = features.withColumn("_when", when).select(order_key("job_id", "_when").alias("key"), _feature(features))
    return json_list(rows, '{"type": "FeatureCollection", "features": [', "]}")


def json_list(lines: DataFrame, head: str = "[", tail: str = "]") -> DataFrame:
    """Rows (ord, key, value) of a JSON document from its items (key, value), in their order: head, items with commas between them, tail. Without items, an empty list."""
    spark = lines.sparkSession
    lines = Scratch(spark).write(lines.select("key", "value", F.monotonically_increasing_id().alias("i")), "lines")
    last = lines.orderBy(F.desc("key"), F.desc("value"), F.desc("i")).select("i").first()
    final = F.col("i") == (last.i if last else -1)
    rows = lines.select(F.when(final, 2).otherwise(1).alias("ord"), "key", F.concat("value", F.when(final, "").otherwise(",")).alias("value"))
    return spark.createDataFrame([(0, [""], head), (9, [""], tail)], ROWS).union(rows)


def csv_document(table: DataFrame, columns: tuple[str, ...], *key: str) -> DataFrame:
    """Rows (ord, key, value) of a CSV document with a head, by the numbers in the key columns. Nulls and empty texts are empty fields."""
    line = F.to_csv(F.struct(*columns), {"escape": '"', "nullValue": "", "emptyValue": ""})
    head = table.sparkSession.createDataFrame([(0, [""], ",".join(columns))], ROWS)
    return head.union(table.select(F.lit(1), order_key(*key), line))


def joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|")


def assets_report(assets: DataFrame, *more: str) -> DataFrame:
    """The table of assets: job_id, more of their columns, and those in the order of ASSETS_COLUMNS. Frame 0 names no asset: the next frame or the time does."""
    s = lambda c: F.nullif(F.col(c), F.lit(0)).cast("string")
    a = assets.withColumn("asset_id", F.coalesce(s("coords_from_frame"), s("image_from_frame"), "timestamp_iso"))
    a = a.withColumn("rejection_reason", F.coalesce("reject_reason", "clamp_reason"))
    named = {"solved_lat": "lat", "solved_lon": "lon", "solve_method": "coord_source", "num_observations": "num_detections_merged", "ray_angle_deg": "spread_deg", "raw_tri_lat": "raw_lat", "raw_tri_lon": "raw_lon", "tri_closest_dist_m": "closest_m", "tri_farthest_dist_m": "farthest_m"}
    lists = ("source_frames", "members_video_sec")
    return a.select("job_id", *more, *((joined(F.col(c)) if c in lists else F.col(named.get(c, c))).alias(c) for c in ASSETS_COLUMNS))


def tri_debug_report(assets: DataFrame, *more: str) -> DataFrame:
    named = {"intersection_angle_deg": "spread_deg", "solved_lat": "raw_lat", "solved_lon": "raw_lon", "distance_from_track_m": "closest_m", "farthest_from_track_m": "farthest_m", "residual_m": "tri_residual_m", "n_cluster": "num_detections_merged"}
    named |= {f"cam_{k}_{c}": f"cam_{c}_{k}" for k in "ab" for c in ("lat", "lng", "bearing")}
    accept = F.initcap((F.col("status") == "ok").cast("string"))
    return assets.select("job_id", *more, *((accept if c == "accept" else F.col(named.get(c, c))).alias(c) for c in DEBUG_COLUMNS))


# The texts, signs and styles of placemarks and log lines below are fixed values.


def placemarks(features: DataFrame) -> DataFrame:
    """Name, style and popup of each asset or track feature (unionByName of asset_features and the gps_track rows)."""
    percent = F.concat(F.format_string("%.1f", F.col("confidence") * 100), F.lit("%"))
    n = F.coalesce("num_detections_merged", F.lit(1))
    is_asset = F.col("type") == "detection"
    name = F.concat(F.col("class_name"), F.lit(" ("), percent, F.lit(")"), F.when(n > 1, F.concat(F.lit(" ×"), n.cast("string"))).otherwise(""))
    text = lambda c: F.col(c).cast("string")
    asset = F.concat_ws(
        "",
        F.concat(F.lit("<b>"), F.col("class_name"), F.lit("</b> — "), percent),
        F.when(n > 1, F.concat(F.lit(" &nbsp;(merged from "), n.cast("string"), F.lit(" frames)"))),
        F.concat(F.lit("<br/>Video: "), F.coalesce(text("video_sec"), F.lit("None")), F.lit("s &nbsp;|&nbsp; GPS: "), F.coalesce("gps_source", F.lit("None")), F.lit("<br/><b>Object:</b> "), text("latitude"), F.lit(", "), text("longitude"), F.lit("<br/>")),
        F.concat(F.lit("Distance from camera: "), text("distance_m"), F.lit(" m"), F.coalesce(F.concat(F.lit(" &nbsp;|&nbsp; Bearing to object: "), text("obj_bearing"), F.lit("°")), F.lit("")), F.lit("<br/>")),
        F.concat(F.lit("<i>Camera pos:</i> "), text("cam_lat"), F.lit(", "), text("cam_lng"), F.coalesce(F.concat(F.lit(" &nbsp;(heading "), text("cam_bearing"), F.lit("°)")), F.lit("")), F.lit("<br/>")),
        F.concat(F.col("timestamp"), F.lit("<br/>")),
        F.concat(F.lit('<br/><img src="images/'), F.col("image_file"), F.lit('" width="480"/>')),
    )
    track = F.concat(F.lit("GPS track point<br/>Source: "), F.coalesce("gps_source", F.lit("None")), F.lit("<br/>"), F.col("timestamp"))
    return features.select(
        "job_id", F.when(is_asset, name).otherwise(F.concat(F.lit("Track @"), text("video_sec"), F.lit("s"))).alias("name"), F.when(is_asset, "#detection").otherwise("#gpstrack").alias("style_url"),
        F.col("timestamp").alias("when_iso"), F.when(is_asset, asset).otherwise(track).alias("description"), "longitude", "latitude", "elevation_m",
    )


#: Frames of a piece of a track line, by number.
LINE_FRAMES = 1000


def _posed(frames: DataFrame) -> DataFrame:
    point = F.concat_ws(",", *(F.col(c).cast("string") for c in ("cam_lng", "cam_lat", "ele")))
    return frames.where("cam_lat IS NOT NULL AND cam_lng IS NOT NULL").withColumn("p", point)


def track_ends(frames: DataFrame) -> DataFrame:
    """Per job with two or more posed frames: their number, first and last point and time. Rows without frame_idx have no place in the order: they count, but are no ends."""
    at = lambda pick, c, name: pick(c, "frame_idx").alias(name)
    ends = (at(F.min_by, "p", "start"), at(F.max_by, "p", "end"), at(F.min_by, "timestamp_iso", "start_iso"), at(F.max_by, "timestamp_iso", "end_iso"))
    return _posed(frames).groupBy("job_id").agg(F.count("*").alias("n_points"), *ends).where("n_points >= 2")


def track_pieces(frames: DataFrame) -> DataFrame:
    """Tracks in pieces of at most LINE_FRAMES frame numbers: job_id, piece, n, and coordinates in frame order. Their concatenation by piece is a job's line; no row holds a whole one, however long the job."""
    pts = F.array_sort(F.collect_list(F.struct("frame_idx", "p")))
    piece = F.floor(F.col("frame_idx") / LINE_FRAMES).alias("piece")
    return _posed(frames).groupBy("job_id", piece).agg(F.count("*").alias("n"), F.array_join(F.transform(pts, lambda x: x["p"]), " ").alias("coordinates"))


def kml_document(name: str, frames: DataFrame, marks: DataFrame) -> DataFrame:
    """KML in rows (ord, key, value), written by write_text: the frame around placemarks, one row each, and track lines of frames (see track_pieces), each in rows of its own: opening, pieces, end."""
    spark = marks.sparkSession
    styles = (("trackLine", "<LineStyle><color>ffff7800</color><width>3</width></LineStyle>"), ("detection", "<IconStyle><scale>1.3</scale></IconStyle>"), ("gpstrack", "<IconStyle><scale>0.5</scale></IconStyle>"), ("start", "<IconStyle><scale>1.2</scale></IconStyle>"), ("end", "<IconStyle><scale>1.2</scale></IconStyle>"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n<Document>\n<name>' + name + "</name>\n" + "\n".join(f'<Style id="{k}">{v}</Style>' for k, v in styles)
    ends = spark.createDataFrame([(0, [""], head), (9, [""], "</Document>\n</kml>")], ROWS)
    coords = F.concat_ws(",", *(F.col(c).cast("string") for c in ("longitude", "latitude", "elevation_m")))
    safe = F.replace(F.replace(F.replace("name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    mark = F.concat(F.lit("<Placemark>\n  <name>"), safe, F.lit("</name>\n  <styleUrl>"), F.col("style_url"), F.lit("</styleUrl>\n  <TimeStamp><when>"), F.col("when_iso"), F.lit("</when></TimeStamp>\n  <description><![CDATA["), F.col("description"), F.lit("]]></description>\n  <Point><coordinates>"), coords, F.lit("</coordinates></Point>\n</Placemark>"))
    opening = "<Placemark><name>GPS Track</name><styleUrl>#trackLine</styleUrl><LineString><tessellate>1</tessellate><coordinates>"
    closing = "</coordinates></LineString></Placemark>"
    tip = lambda which, style, c, point: F.concat(F.lit(f"<Placemark><name>{which}</name><styleUrl>#{style}</styleUrl><description><![CDATA["), F.coalesce(c, F.lit("")), F.lit("]]></description><Point><coordinates>"), F.coalesce(point, F.lit("")), F.lit("</coordinates></Point></Placemark>"))
    by_job = order_key("job_id")
    tracks = Scratch(spark).write(track_ends(frames), "tracks")
    place = lambda n, *c: F.concat(by_job, F.array(F.lit(str(n))), *c)
    rows = tracks.select(F.lit(1).alias("ord"), place(0).alias("key"), F.lit(opening).alias("value"))
    rows = rows.union(track_pieces(frames).join(tracks, "job_id", "left_semi").select(F.lit(1), place(1, order_key("piece")), "coordinates"))
    rows = rows.union(tracks.select(F.lit(1), place(2), F.lit(closing)))
    rows = rows.union(tracks.select(F.lit(2), by_job, tip("Start", "start", "start_iso", "start"))).union(tracks.select(F.lit(3), by_job, tip("End", "end", "end_iso", "end")))
    rows = rows.union(marks.select(F.when(F.col("style_url") == "#detection", 4).otherwise(5), F.concat(by_job, F.array(F.coalesce("when_iso", F.lit("")), F.coalesce("name", F.lit("")))), mark))
    return ends.union(rows)


def order_key(*numbers: str) -> Column:
    """Numbers as strings that sort as they do."""
    return F.array(*(F.format_string("%020d", F.coalesce(F.col(c).cast("long"), F.lit(0))) for c in numbers))


def write_text(rows: DataFrame, path: str, staged: bool = False) -> None:
    """Rows (see ROWS) as one text file in the order of ord, key and value, each range of them written by a task of its own (see documents.write_lines)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    documents.write_lines(rows.repartitionByRange(parts, "ord", "key").sortWithinPartitions("ord", "key", "value"), path, staged)


def path_log(assets: DataFrame) -> DataFrame:
    """Lines [CAL], [TRI_REJECT] and [PATH] of each asset, in column line, with ord for their order."""
    c = F.col
    cal = F.format_string(f"[CAL] cls=%s raw_tri=%.2fm stretch=%.2f stretched=%.2fm (max=%.1fm) bearing_off={P.BEARING_OFFSET_DEG:+.2f}deg", "class", "tri_cam_m", "stretch", "stretched_m", "max_d")
    reject = F.concat(F.lit("[TRI_REJECT] cls="), c("class"), F.lit(" reason="), c("reject_reason"), F.lit(" cluster_n="), c("num_detections_merged").cast("string"), F.lit(" rays="), c("n_rays").cast("string"))
    path = F.concat(
        F.lit("[PATH] cls="), c("class"), F.lit(" src="), c("coord_source"), F.lit(" cluster_n="), c("num_detections_merged").cast("string"), F.lit(" bearings="), c("bearings").cast("string"), F.lit(" unique_cam_pos="), c("unique_cam_pos").cast("string"),
        F.lit(" tri_ok="), F.initcap((c("stretched_m").isNotNull()).cast("string")), F.lit(" tri_reject="), F.coalesce("clamp_reason", F.lit("-")), F.lit(" proj_dist="), F.format_string("%.1fm", "offset_m"), F.lit(" proj_brg="), F.coalesce(F.when(c("offset_bearing").isNotNull(), F.format_string("%.1f", "offset_bearing")), F.lit("-")),
    )
    lines = F.array_compact(F.array(F.when(c("reject_reason").isNotNull(), reject), F.when(c("stretched_m").isNotNull(), cal), path))
    return assets.select("job_id", "cluster_id", F.posexplode(lines).alias("ord", "line"))


def last_lines(log: DataFrame, n: int = 40) -> DataFrame:
    """The last n lines of each job's log (path_log): a report, limited as such. Adds place, counted from the end."""
    back = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("cluster_id"), F.desc("ord")))
    return log.withColumn("place", back).where(F.col("place") <= n)


def log_summary(log: DataFrame, n: int = 40) -> DataFrame:
    """Per job: lines_count, and last_lines, the last n lines in order. Jobs without lines have no row."""
    entry = F.struct((-F.col("place")).alias("place"), "line")
    tails = last_lines(log, n).groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["line"]).alias("last_lines"))
    return log.groupBy("job_id").agg(F.count("*").alias("lines_count")).join(tails, "job_id")
