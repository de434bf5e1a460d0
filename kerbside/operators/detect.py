"""Detections: class names, confidence filter, projection, clusterer entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside import params as P
from kerbside.functions import geo, media


def with_params(rows: DataFrame, params: DataFrame, key: str = "class", prefix: str = "") -> DataFrame:
    """rows with its class's parameters, each named prefix and its name; null where the class or the parameter is unknown.

    The class's values count: a column of rows of such a name is replaced, so callers that return rows as they came give
    a prefix. The class table is broadcast: it has a row a class. Null keys find nothing; repeated rows stay; no rows
    give no rows.
    """
    p = params.where("class_id IS NOT NULL") if key == "class_id" else params
    p = p.select(key, *(F.col(c).alias(prefix + c) for c in p.columns if c != key))
    return rows.drop(*(c for c in p.columns if c != key)).join(F.broadcast(p), key, "left")


def named(det: DataFrame, params: DataFrame) -> DataFrame:
    """det (class_id) with class: class_<id> for unknown ids."""
    out = with_params(det.drop("class"), params.select("class_id", "class"), "class_id")
    return out.withColumn("class", F.coalesce("class", F.concat(F.lit("class_"), F.col("class_id").cast("string"))))


def confident(det: DataFrame, params: DataFrame, conf: float = P.DEFAULT_CONF) -> DataFrame:
    """Rows of det (class, confidence) at or above their class's least confidence, conf where it has none; a null confidence goes. Columns of det stay, whatever their names."""
    rows = with_params(det, params.select("class", "min_conf"), prefix="_of_class_")
    return rows.where(F.col("confidence") >= F.coalesce("_of_class_min_conf", F.lit(conf))).drop("_of_class_min_conf")


def detector_threshold(params: DataFrame, conf: float = P.DEFAULT_CONF) -> DataFrame:
    """The lowest confidence that any class accepts: what a detector is asked for."""
    return params.agg(F.least(F.lit(conf), F.min("min_conf")).alias("threshold"))


def projected(det: DataFrame, params: DataFrame) -> DataFrame:
    """det (class, cam_lat, cam_lng, cam_bearing, cx, h, image_w_px, image_h_px) with obj_lat, obj_lng, distance_m, obj_bearing.

    Unrounded. Without a plausible distance the object is put at the camera; without a bearing nothing is known of it.
    Null poses or boxes give nulls, and each row gives a row.
    """
    rows = with_params(det, params.select("class", "height_m"), prefix="_of_class_")
    posed = F.col("cam_lat").isNotNull() & F.col("cam_lng").isNotNull() & F.col("cam_bearing").isNotNull() & (F.col("image_w_px") > 0) & (F.col("image_h_px") > 0)
    d = geo.mono_distance_m(F.col("_of_class_height_m"), F.col("h") * F.col("image_h_px"), F.col("image_h_px"))
    rows = rows.withColumn("obj_bearing", F.when(posed, geo.object_bearing_deg(F.col("cam_bearing"), F.col("cx"))))
    rows = rows.withColumn("distance_m", F.when(posed & (d > 0) & (d <= P.PLAUSIBLE_M), d))
    lat, lng = geo.destination(F.col("cam_lat"), F.col("cam_lng"), F.radians("obj_bearing"), F.col("distance_m"), P.EARTH_PROJECT_M)
    return rows.withColumn("obj_lat", F.coalesce(lat, "cam_lat")).withColumn("obj_lng", F.coalesce(lng, "cam_lng")).drop("_of_class_height_m")


def detections(det: DataFrame) -> DataFrame:
    """Projected rows as they are exported: rounded."""
    places = {"confidence": 3, "cx": 4, "cy": 4, "w": 4, "h": 4, "obj_lat": 7, "obj_lng": 7, "distance_m": 2, "obj_bearing": 1}
    return det.withColumns({c: F.round(c, n) for c, n in places.items() if c in det.columns})


def entries(det: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Projected rows with a position, as the clusterer takes them; of columns, where given, no others."""
    d = det.where("obj_lat IS NOT NULL AND obj_lng IS NOT NULL")
    r = lambda c, n: geo.rounded(F.col(c) if isinstance(c, str) else c, n)
    made = {
        **{c: F.col(c) for c in ("job_id", "entry_seq")}, "frame_id": F.col("frame_idx"), "timestamp": F.col("ts"), **{c: F.col(c) for c in ("class", "class_id")},
        "confidence": r("confidence", 3), "lat": r("obj_lat", 7), "lon": r("obj_lng", 7),
        "bbox_area": r(F.col("w") * F.col("h") * F.col("image_w_px") * F.col("image_h_px"), 1),
        "distance_m": r("distance_m", 2), "obj_bearing": r("obj_bearing", 1),
        "cam_lat": r("cam_lat", 7), "cam_lng": r("cam_lng", 7), "cam_bearing": r("cam_bearing", 1),
        "elevation_m": r(F.coalesce("ele", F.lit(0.0)), 2), **{c: F.col(c) for c in ("gps_source", "image_file", "timestamp_iso")},
    }
    return d.select(*(v.alias(c) for c, v in made.items() if columns is None or c in columns))


def crops(kept: DataFrame, order: str = "entry_seq") -> DataFrame:
    """Kept boxes (job_id, frame_idx, cx, cy, w, h, image_w_px, image_h_px) with crop rectangle and file name, numbered within the frame."""
    n = F.row_number().over(Window.partitionBy("frame_idx", "job_id").orderBy(order)) - 1
    rect = media.crop_rect(*(F.col(c) for c in ("cx", "cy", "w", "h", "image_w_px", "image_h_px")))
    return kept.withColumn("det", n).withColumn("rect", rect).withColumn("image_file", F.when(F.col("rect").isNotNull(), media.crop_name(F.col("frame_idx"), F.col("det"))))


def frames_with_boxes(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every frame with its boxes (job_id, stem); frames without any stay."""
    return frames.join(boxes, ["job_id", "stem"], "left")


def positive(c: Column) -> Column:
    return F.when(c > 0, c)
