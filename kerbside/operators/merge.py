"""Placement: where a cluster's pin goes, and what is known of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside import params as P
from kerbside.functions import geo
from kerbside.operators.detect import with_params


def fallback(clusters: DataFrame, params: DataFrame) -> DataFrame:
    """clusters (see cluster.summarized) with base_lat/lon, max_d, offset_m, proj_bearing and the projected fb_lat, fb_lon.

    From the closest member's camera along its bearing to the object (heading + 90 without one) by the smallest
    distance seen, shrunk and clamped; without any, by the class's roadside offset.
    """
    c = with_params(clusters, params.select("class", "offset_m", "max_m", "stretch").withColumnRenamed("offset_m", "side_m"))
    posed = F.col("closest.cam_lat").isNotNull() & F.col("closest.cam_lng").isNotNull()
    most = F.coalesce("max_m", F.lit(P.DEFAULT_MAX_M))
    c = c.withColumn("max_d", F.when(F.col("n") == 1, most * P.SINGLE_FACTOR).otherwise(most))
    c = c.withColumn("base_lat", F.when(posed, F.col("closest.cam_lat")).otherwise(F.col("closest.lat"))).withColumn("base_lon", F.when(posed, F.col("closest.cam_lng")).otherwise(F.col("closest.lon")))
    mono = F.greatest(F.lit(P.MIN_DISTANCE_M), F.least(F.col("min_mono_m") * P.MONO_SHRINK, F.col("max_d")))
    c = c.withColumn("offset_m", F.when(F.col("min_mono_m").isNull(), F.coalesce("side_m", F.lit(P.DEFAULT_OFFSET_M))).otherwise(mono))
    c = c.withColumn("proj_bearing", F.coalesce(F.col("closest.obj_bearing"), F.pmod(F.col("closest.cam_bearing") + 90.0, F.lit(360.0))))
    lat, lon = geo.destination(F.col("base_lat"), F.col("base_lon"), F.radians(F.col("proj_bearing") + P.BEARING_OFFSET_DEG), F.col("offset_m"), P.EARTH_MERGE_M)
    go = F.col("proj_bearing").isNotNull() & F.col("base_lat").isNotNull() & (F.col("offset_m") > 0)
    return c.withColumn("fb_lat", F.when(go, lat).otherwise(F.col("base_lat"))).withColumn("fb_lon", F.when(go, lon).otherwise(F.col("base_lon"))).drop("side_m", "max_m")


def placed(clusters: DataFrame, tri: DataFrame, params: DataFrame) -> DataFrame:
    """One row an asset: the best member's columns, the pin and where it is from, lists of members, solver's diagnostics.

    An accepted solution is checked against the class's range from the closest camera, stretched along its bearing
    plus the calibration offset, and taken; else the fallback point; else the camera. Without a camera the pin is at the
    member's own position. Clusters without a row in tri are placed by the fallback; no clusters give no rows.
    """
    return pinned(clusters.join(tri.drop("job_id", "class", "n_cluster", "det", "trace"), "cluster_id", "left"), params)


def pinned(clusters: DataFrame, params: DataFrame) -> DataFrame:
    """placed for clusters that have tri's columns."""
    c = fallback(clusters, params)
    ok = (F.col("status") == "ok") & F.col("base_lat").isNotNull() & F.col("base_lon").isNotNull()
    c = c.withColumn("tri_cam_m", F.when(ok, geo.haversine_ft(F.col("base_lat"), F.col("base_lon"), F.col("raw_lat"), F.col("raw_lon")) / P.FT_PER_M))
    d = F.col("tri_cam_m")
    far = F.format_string("tri_dist_%.1fm>max_%.1fm", d, F.col("max_d"))
    near = F.format_string("tri_dist_%.2fm<min_%.1fm", d, F.lit(P.MIN_DISTANCE_M))
    c = c.withColumn("clamp_reason", F.when(d > F.col("max_d"), far).when(d < P.MIN_DISTANCE_M, near))
    use = d.isNotNull() & F.col("clamp_reason").isNull()
    c = c.withColumn("stretch", F.coalesce("stretch", F.lit(P.DEFAULT_STRETCH)))
    c = c.withColumn("stretched_m", F.when(use, F.least(d * F.col("stretch"), F.col("max_d"))))
    toward = geo.azimuth_rad(F.col("base_lat"), F.col("base_lon"), F.col("raw_lat"), F.col("raw_lon")) + F.radians(F.lit(P.BEARING_OFFSET_DEG))
    lat, lon = geo.destination(F.col("base_lat"), F.col("base_lon"), toward, F.col("stretched_m"), P.EARTH_MERGE_M)
    moved = F.col("proj_bearing").isNotNull() & F.col("base_lat").isNotNull() & (F.col("offset_m") > 0) & ((F.col("fb_lat") != F.col("base_lat")) | (F.col("fb_lon") != F.col("base_lon")))
    c = c.withColumn("coord_source", F.when(use, "triangulated").when(moved, "cam+offset").otherwise("cam_only"))
    pick = lambda a, b, cam, best: F.when(use, a).when(moved, b).otherwise(F.coalesce(cam, best))
    c = c.withColumn("pin_lat", pick(lat, F.col("fb_lat"), F.col("base_lat"), F.col("best.lat"))).withColumn("pin_lon", pick(lon, F.col("fb_lon"), F.col("base_lon"), F.col("best.lon")))
    cam = F.col("best.cam_lat").isNotNull() & F.col("best.cam_lng").isNotNull()
    args = (F.col("best.cam_lat"), F.col("best.cam_lng"), F.col("pin_lat"), F.col("pin_lon"))
    return c.select(
        "job_id", "class", "cluster_id", F.col("best.class_id").alias("class_id"), geo.rounded(F.col("pin_lat"), 7).alias("lat"), geo.rounded(F.col("pin_lon"), 7).alias("lon"), "coord_source",
        F.col("best.confidence").alias("confidence"), F.col("n").alias("num_detections_merged"), "mean_conf", "members_video_sec", "source_frames",
        F.col("closest.frame_id").alias("coords_from_frame"), F.col("best.frame_id").alias("image_from_frame"),
        F.col("closest.lat").alias("projected_lat"), F.col("closest.lon").alias("projected_lon"),
        F.when(cam, geo.rounded(geo.haversine_m(*args), 2)).otherwise(F.col("best.distance_m")).alias("distance_m"),
        F.when(cam, geo.rounded(geo.azimuth_deg(*args), 1)).otherwise(F.col("best.obj_bearing")).alias("obj_bearing"),
        F.col("best.cam_lat").alias("cam_lat"), F.col("best.cam_lng").alias("cam_lng"), F.col("best.cam_bearing").alias("cam_bearing"),
        F.col("best.elevation_m").alias("elevation_m"), F.col("best.gps_source").alias("gps_source"), F.col("best.image_file").alias("image_file"), F.col("best.timestamp_iso").alias("timestamp_iso"), F.col("best.timestamp").alias("video_sec"),
        "offset_m", geo.rounded(F.col("proj_bearing"), 1).alias("offset_bearing"), "clamp_reason", "bearings", "unique_cam_pos", "tri_cam_m", "stretch", "stretched_m", "max_d",
        "status", "reject_reason", "n_rays", "baseline_m", "spread_deg", F.when(F.col("status") == "ok", F.col("residual_m")).alias("residual_m"), F.col("residual_m").alias("tri_residual_m"), "closest_m", "farthest_m", "raw_lat", "raw_lon",
        *(f"{x}_{k}" for k in "ab" for x in ("frame", "cam_lat", "cam_lng", "cam_bearing", "obj_bearing")),
    )
