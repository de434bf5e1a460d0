"""GPX tracks by Spark's XML reader."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINT = "_lat double, _lon double, ele double, time string"


def gpx_points(spark: SparkSession, path: str, job: Callable[[Column], Column] = lambda file: file) -> DataFrame:
    """job_id (job() of the file's path), pt_seq, ts, lat, lng, ele: track points, then waypoints, in order of time; ties keep this order.

    Points without a time are left out, heights missing are 0, times without a zone are UTC. Routes aren't read.
    """
    parts = []
    for kind, tag in enumerate(("trkpt", "wpt")):
        rows = spark.read.format("xml").option("rowTag", tag).schema(POINT).load(path)
        parts.append(rows.select(job(F.col("_metadata.file_path")).alias("job_id"), F.lit(kind).alias("kind"), F.monotonically_increasing_id().alias("place"), "_lat", "_lon", "ele", "time"))
    p = parts[0].union(parts[1])
    zoned = F.when(F.col("time").rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.col("time")).otherwise(F.concat("time", F.lit("Z")))
    p = p.withColumn("ts", zoned.try_cast("timestamp")).where("ts IS NOT NULL")
    seq = F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "kind", "place")) - 1
    return p.select("job_id", seq.cast("long").alias("pt_seq"), "ts", F.col("_lat").alias("lat"), F.col("_lon").alias("lng"), F.coalesce("ele", F.lit(0.0)).alias("ele"))
