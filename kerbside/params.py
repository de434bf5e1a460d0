"""Constants and the class table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Id, class, minimum confidence, height m, clustering radius ft, roadside offset m, largest distance m,
# stretch, detections a cluster needs. None: the default below.
CLASSES = (
    (0, "pole", 0.25, 11.0, 20.0, 4.0, 80.0, 1.55, 3),
    (1, "conduit", None, 2.0, None, None, None, None, None),
    (2, "manhole", 0.60, 0.6, 6.0, 1.5, 20.0, 1.30, None),
    (3, "splice_enclosure", None, 0.6, 6.0, 2.0, 30.0, None, None),
    (4, "transformer", None, 1.2, 12.0, 4.0, 80.0, 1.55, 3),
    (5, "bush", None, None, None, None, None, None, None),
    (6, "car", None, 1.5, None, None, None, None, None),
    (7, "chair", None, None, None, None, None, None, None),
    (8, "crosswalk", None, None, None, None, None, None, None),
    (9, "curb", None, None, None, None, None, None, None),
    (10, "fire_hydrant", None, 0.8, 6.0, 3.0, 20.0, 1.30, None),
    (11, "obstacle", None, None, None, None, None, None, None),
    (12, "sign", None, 2.4, None, None, None, None, None),
    (13, "stairs", None, None, None, None, None, None, None),
    (14, "table", None, None, None, None, None, None, None),
    (15, "trashcan", None, 0.9, None, None, None, None, None),
    (16, "tree", 0.30, None, 25.0, 5.0, 80.0, 1.55, 3),
    (17, "culvert", 0.55, 0.6, 25.0, 3.0, 80.0, 1.30, 3),
    (18, "hand_hole", 0.55, 0.5, 20.0, 1.5, 15.0, 1.30, None),
    (19, "power_marks", 0.30, None, 6.0, 0.0, 3.0, None, None),
    (20, "ramp", 0.60, None, 20.0, 0.0, 3.0, None, None),
    (21, "riser", 0.55, 2.0, 15.0, 2.0, 30.0, 1.55, None),
    (22, "sidewalk", 0.50, None, 30.0, 0.0, 3.0, None, None),
    (23, "street_light", 0.25, 8.0, 30.0, 4.0, 80.0, 1.55, 3),
    (24, "telecom", 0.60, 1.5, 8.0, 3.0, 40.0, 1.30, 3),
    (25, "u_guard", 0.55, 1.8, 8.0, 3.0, 30.0, 1.55, None),
    (26, "valve", 0.60, 0.2, 4.0, 1.5, 12.0, 1.30, None),
    (27, "water_mark", 0.30, None, 6.0, 0.0, 3.0, None, None),
    (None, "cabinet", None, None, 10.0, 3.0, 40.0, 1.30, 3),
    (None, "pedestal", None, 1.0, 8.0, 3.0, 30.0, 1.30, None),
    (None, "handhole", None, None, 20.0, 1.5, 15.0, None, None),
    (None, "fire_hydrant ", None, 0.8, None, None, None, None, None),
)
COLUMNS = "class_id int, class string, min_conf double, height_m double, eps_ft double, offset_m double, max_m double, stretch double, min_frames int"
DEFAULT_CONF, DEFAULT_EPS_FT, DEFAULT_OFFSET_M, DEFAULT_MAX_M, DEFAULT_STRETCH, DEFAULT_MIN_FRAMES = 0.25, 10.0, 3.0, 50.0, 1.30, 1
# Classes mistaken for each other, either way.
CONFUSED = (("pole", "tree"), ("pole", "street_light"), ("culvert", "sidewalk"), ("pedestal", "cabinet"), ("riser", "pedestal"), ("hand_hole", "manhole"))
HFOV_DEG, VFOV_DEG = 40.0, 68.0
TIME_GATE_S = 6.0
MIN_DISTANCE_M, SINGLE_FACTOR, MONO_SHRINK, BEARING_OFFSET_DEG = 0.5, 0.65, 0.85, -2.5
MIN_BASELINE_M, MIN_SPREAD_DEG, MAX_RESIDUAL_M, MAX_FARTHEST_M, MIN_CLOSEST_M = 5.0, 20.0, 3.0, 80.0, 2.0
CONFLICT_FT, CONFLICT_S = 50.0, 8.0
AREA_WEIGHT, PLAUSIBLE_M = 0.3, 200.0
EXTRAPOLATE_S, CUTOFF_S = 60.0, 300.0
# The earth models, each where it is used.
EARTH_FT, EARTH_MERGE_M, EARTH_PROJECT_M, DEGREE_M, FT_PER_M = 20_902_231.0, 6_371_008.8, 6_371_000.0, 111_320.0, 3.28084


def class_params(spark: SparkSession) -> DataFrame:
    """One row a class; a few dozen rows, so joins broadcast it."""
    return spark.createDataFrame(list(CLASSES), COLUMNS)


def confusion_pairs(spark: SparkSession) -> DataFrame:
    """class_a, class_b in both directions."""
    return spark.createDataFrame([*CONFUSED, *((b, a) for a, b in CONFUSED)], "class_a string, class_b string")
