"""The whole plan from boxes to assets."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside import params as P
from kerbside.operators import cluster, detect, merge, suppress, triangulate
from kerbside.plans.scratch import Scratch


class Result:
    """Tables of one run, each planned (and, where it is read more than once, written) when it is first asked for."""

    def __init__(self, spark: SparkSession, boxes: DataFrame, conf: float, suppress_conflicts: bool, write_kept: bool, rays_only: bool = False):
        self._spark, self._boxes, self._conf, self._suppress, self._write_kept = spark, boxes, conf, suppress_conflicts, write_kept
        self._rays_only = rays_only
        self._scratch = Scratch(spark)
        self._params = P.class_params(spark)

    @cached_property
    def kept(self) -> DataFrame:
        kept = detect.confident(detect.named(self._boxes, self._params), self._params, self._conf)
        kept = detect.projected(kept if self._rays_only else detect.crops(kept), self._params)
        return self._scratch.write(kept, "kept") if self._write_kept else kept

    @cached_property
    def entries(self) -> DataFrame:
        return self._scratch.write(detect.entries(self.kept, triangulate.READ if self._rays_only else None), "entries")

    @cached_property
    def members(self) -> DataFrame:
        return self._scratch.write(cluster.linked(self.entries, self._params, enough=True), "members")

    @cached_property
    def _many(self) -> DataFrame:
        return self.members.where("cluster_n > 1").drop("cluster_n")

    @cached_property
    def _alone(self) -> DataFrame:
        """Clusters of one member, with what triangulation says of them: by rows, as no other row is needed."""
        return cluster.of_one(self.members.where("cluster_n = 1")).withColumns(triangulate.alone())

    @cached_property
    def _of_many(self) -> DataFrame:
        return triangulate.triangulated(self._many)

    @cached_property
    def clusters(self) -> DataFrame:
        c = cluster.summarized(self._many)
        return c.unionByName(self._alone.select(*c.columns))

    @cached_property
    def tri(self) -> DataFrame:
        t = self._scratch.write(self._of_many, "tri")
        alone = self.members.where("cluster_n = 1").select("job_id", "class", "cluster_id", *(v.alias(c) for c, v in triangulate.alone(F.col).items()))
        return t.unionByName(alone)

    @cached_property
    def placed(self) -> DataFrame:
        t = self._of_many.drop("job_id", "class", "n_cluster", "det", "trace")
        c = cluster.summarized(self._many).join(t, "cluster_id", "left")
        return self._scratch.write(merge.pinned(c.unionByName(self._alone.select(*c.columns)), self._params), "placed")

    @cached_property
    def assets(self) -> DataFrame:
        if not self._suppress:
            return self.placed
        return suppress.kept_assets(self.placed, suppress.conflict_pairs(self.placed, P.confusion_pairs(self._spark)), self.entries)


def from_boxes(spark: SparkSession, boxes: DataFrame, conf: float = P.DEFAULT_CONF, suppress_conflicts: bool = True, write_kept: bool = False, rays_only: bool = False) -> Result:
    """boxes (see scenes.SCENE for the columns) through filter, projection, clusters, triangulation, placement and suppression.

    The plan is cut where results are read more than once: entries, members of clusters, placed assets. What a caller
    doesn't read isn't computed. write_kept: kept boxes are written too, for callers that read them beside the assets.
    rays_only: entries have the columns that triangulation reads, and boxes no crops, for callers that read members and tri alone.
    """
    return Result(spark, boxes, conf, suppress_conflicts, write_kept, rays_only)


def job_summary(frames: DataFrame, boxes: DataFrame, kept: DataFrame, assets: DataFrame, misses: int = 20, samples: int = 8) -> DataFrame:
    """One row for each job of frames: frames and where their poses are from, boxes and kept ones, those without a pose and those shown, assets, the first misses and samples of text recognition, and a hint of what happened.

    frames: job_id, frame_idx, gps_source ('ocr', 'gpx' or null), top_text; a miss is a frame whose pose isn't from its
    text. Lists are cut to their first entries before they are gathered: a report, limited as such. Jobs without boxes
    have zeros.
    """
    missed = F.coalesce(F.col("gps_source") != "ocr", F.lit(True))
    f = frames.groupBy("job_id").agg(F.count("*").alias("frames_processed"), F.count_if(~missed).alias("ocr_hits"), F.count_if(F.col("gps_source") == "gpx").alias("gpx_hits"), F.count_if(missed).alias("ocr_misses_count"))
    first = frames.where(missed).withColumn("k", F.row_number().over(Window.partitionBy("job_id").orderBy("frame_idx"))).where(F.col("k") <= max(misses, samples))
    entry = F.struct("k", F.col("frame_idx").cast("string").alias("frame"), F.substring(F.coalesce(F.btrim("top_text"), F.lit("")), 1, 200).alias("text"))
    first = first.groupBy("job_id").agg(F.array_sort(F.collect_list(entry)).alias("m"))
    listed = lambda n, make: F.array_join(F.transform(F.filter("m", lambda x: x["k"] <= n), make), "|")
    first = first.select("job_id", listed(misses, lambda x: x["frame"]).alias("ocr_misses"), listed(samples, lambda x: F.concat(x["frame"], F.lit(":"), x["text"])).alias("ocr_samples"))
    raw = boxes.groupBy("job_id").agg(F.count("*").alias("raw_detections"))
    k = kept.groupBy("job_id").agg(F.count("*").alias("kept_detections"), F.count_if(F.col("cam_lat").isNull()).alias("no_gps_drops"), F.count_if(F.col("cam_lat").isNotNull()).alias("detections_per_frame"))
    a = assets.groupBy("job_id").agg(F.count("*").alias("detections"))
    j = f.join(first, "job_id", "left").join(raw, "job_id", "left").join(k, "job_id", "left").join(a, "job_id", "left").na.fill(0).na.fill("")
    hint = (
        F.when(F.col("raw_detections") == 0, "no boxes")
        .when(F.col("kept_detections") == 0, "class filter dropped all")
        .when(F.col("no_gps_drops") > 0, "some without position")
        .otherwise("complete")
    )
    return j.withColumn("hint", hint)
