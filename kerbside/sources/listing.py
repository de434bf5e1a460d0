"""Files by name: frames, models, runs, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions.media import extension

# Endings of images, as each listing takes them.
FRAME_GLOB = "{*.jpg,*.jpeg,*.JPG,*.png,*.PNG}"
INCOMING = (".jpg", ".jpeg", ".png", ".JPG", ".JPEG", ".PNG")
COUNTED = (".jpg", ".jpeg", ".png")


def listed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, bytes, modified of all files below; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def frames(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the frame images below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", FRAME_GLOB).load(path).select("path", "content")


def _under(path: Column, ending: str) -> Column:
    return path.rlike(ending)


def latest_model(files: DataFrame) -> DataFrame:
    """The best weights whose path is last by name."""
    return files.where(_under(F.col("path"), r"(^|/)weights/best\.pt$")).agg(F.max("path").alias("path"))


def models(files: DataFrame) -> DataFrame:
    """name, run, path, size_mb of all weights."""
    parts = F.split("path", "/")
    f = files.where(_under(F.col("path"), r"(^|/)weights/[^/]*\.pt$"))
    return f.select(F.element_at(parts, -1).alias("name"), F.element_at(parts, -3).alias("run"), "path", F.round(F.col("bytes") / 1048576, 2).alias("size_mb"))


def training_runs(files: DataFrame) -> DataFrame:
    """run, has_best of each run with a results.csv."""
    run = F.element_at(F.split("path", "/"), -2)
    best = files.where(_under(F.col("path"), r"/weights/best\.pt$")).select(F.element_at(F.split("path", "/"), -3).alias("run")).distinct().withColumn("best", F.lit(True))
    return files.where(F.col("path").endswith("/results.csv")).select(run.alias("run")).distinct().join(best, "run", "left").select("run", F.coalesce("best", F.lit(False)).alias("has_best"))


def run_counts(runs: DataFrame, files: DataFrame) -> DataFrame:
    """run, n_images (.jpg and .png) of each of runs, also those without any; last by name first."""
    run = F.element_at(F.split("path", "/"), 2)
    n = files.where(F.col("path").rlike(r"\.(jpg|png)$")).groupBy(run.alias("run")).agg(F.count("*").alias("n_images"))
    return runs.join(n, "run", "left").select("run", F.coalesce("n_images", F.lit(0)).cast("long").alias("n_images")).orderBy(F.desc("run"))


def image_count(files: DataFrame) -> DataFrame:
    """Images by split, whatever the case of their ending."""
    return files.where(F.lower(extension(F.col("path"))).isin(*COUNTED)).groupBy("split").agg(F.count("*").alias("n_images"))


def incoming(files: DataFrame) -> DataFrame:
    return files.where(extension(F.col("path")).isin(*INCOMING))
