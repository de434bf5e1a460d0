"""Clusters: time-gated spatial join, connected components, statistics of members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside import params as P
from kerbside.functions import grid
from kerbside.functions.geo import haversine_ft, rounded
from kerbside.operators import links
from kerbside.operators.detect import positive, with_params
from kerbside.plans.components import connected_components
from kerbside.plans.scratch import Scratch
from kerbside.plans.skew import join_groups

MEMBER = ("entry_seq", "frame_id", "timestamp", "class_id", "confidence", "lat", "lon", "distance_m", "obj_bearing", "cam_lat", "cam_lng", "cam_bearing", "elevation_m", "gps_source", "image_file", "timestamp_iso")


def proximity_pairs(entries: DataFrame, params: DataFrame, gate_s: float = P.TIME_GATE_S) -> DataFrame:
    """job_id, a, b, dist_ft: entries of one class at most gate_s apart in time and the class's radius in space, a < b.

    Time is cut into slots as long as the gate, the globe into cells as wide as the class's radius: slot and cell are
    keys of the join. The left side goes to its own slot and the next, and to its own cell and those around it, so each
    pair meets once, and what meets is a few times what is kept, however dense a class is. Entries without job, class,
    time or position are in no pair; repeated entries are pairs with all others, not with each other.
    """
    e = with_params(entries.select("job_id", "class", "entry_seq", "timestamp", "lat", "lon"), params.select("class", "eps_ft"))
    e = e.withColumn("eps_ft", F.coalesce("eps_ft", F.lit(P.DEFAULT_EPS_FT)))
    side = F.col("eps_ft") / grid.DEGREE_FT * 1.0001
    e = e.withColumn("slot", F.floor(F.col("timestamp") / gate_s)).withColumn("band", grid.band(F.col("lat"), side))
    left = e.withColumn("later", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("slot", F.col("slot") + F.col("later"))
    left = left.withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    left = left.withColumn("n", grid.wide_columns(F.col("band"), side)).withColumn("reach", grid.reach(F.greatest(F.abs("lat"), grid.farthest(F.col("band"), side)), F.col("eps_ft")))
    left = left.withColumn("cell", F.explode(F.sequence(*grid.first_last(F.col("lon") - F.col("reach"), F.col("lon") + F.col("reach"), F.col("n"))))).withColumn("cell", F.pmod("cell", "n"))
    x, y = left.alias("x"), e.withColumn("cell", grid.column(F.col("lon"), grid.wide_columns(F.col("band"), side))).alias("y")
    d = haversine_ft(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon"))
    same = (F.col("x.job_id") == F.col("y.job_id")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.slot") == F.col("y.slot")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.cell") == F.col("y.cell"))
    once = ((F.col("x.later") == 1) | (F.col("x.entry_seq") < F.col("y.entry_seq"))) & (F.abs(F.col("x.timestamp") - F.col("y.timestamp")) <= gate_s)
    j = x.join(y, same & once & (d <= F.col("x.eps_ft")))
    a, b = F.col("x.entry_seq"), F.col("y.entry_seq")
    return j.where(a != b).select("x.job_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), d.alias("dist_ft"))


def clustered(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """entries with cluster_id, the smallest entry_seq that pairs connect; entry_seq is unique over all jobs."""
    comp = connected_components(pairs.select("a", "b"), Scratch(entries.sparkSession))
    c = comp.select(F.col("node").alias("entry_seq"), F.col("component").alias("_c"))
    return entries.join(c, "entry_seq", "left").withColumn("cluster_id", F.coalesce("_c", "entry_seq")).drop("_c")


def linked(entries: DataFrame, params: DataFrame, gate_s: float = P.TIME_GATE_S, enough: bool = False) -> DataFrame:
    """entries with cluster_id, the smallest entry_seq that links connect; the same as clustered over proximity_pairs, without the pairs.

    Links are between cells whose members all link (operators.links), so their number is linear in the entries; the
    components of cells are those of their members. Entries without job, class, time or position are alone. entry_seq
    is unique over all jobs; repeated ones are refused. No entries give no rows.

    enough: only what large_enough leaves, with cluster_n, the number of a cluster's members. Cells tell these numbers, so
    entries of smaller clusters aren't moved. Entries are read several times: pass a written table.
    """
    scratch = Scratch(entries.sparkSession)
    if entries.groupBy("entry_seq").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("entry_seq is repeated")
    rows = scratch.write(links.keyed(entries.select("job_id", "class", "entry_seq", "timestamp", "lat", "lon"), params, gate_s), "rows")
    c = scratch.write(links.cells(rows), "cells")
    comp = connected_components(links.links(rows, c, scratch, gate_s), scratch)
    sizes = c.select("node", "n").join(comp, "node").groupBy("component").agg(F.sum("n").alias("cluster_n"))
    c = c.select("_cell", "node", "n").join(comp.join(sizes, "component"), "node", "left")
    c = c.select("_cell", "n", F.coalesce("component", "node").alias("cluster_id"), F.coalesce("cluster_n", "n").alias("cluster_n"))
    if enough:
        c = _enough(c.withColumn("class", F.col("_cell.class")), params).drop("class")
    # joined by a hash first, as sorting by whole structs compares them field by field
    hashed = lambda x: x.withColumn("_hash", F.xxhash64("_cell"))
    c = scratch.write(hashed(c), "clusters")
    total = c.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = links.keyed(entries, params, gate_s)
    names = [F.col(f"`{x}`") for x in entries.columns]
    alone = rows.where("_cell IS NULL").select(*names, F.col("entry_seq").alias("cluster_id"), F.lit(1).cast("long").alias("cluster_n"))
    out = join_groups(hashed(rows), c, ["_hash", "_cell"], "n", total).select(*names, "cluster_id", "cluster_n")
    return out.unionByName(_enough(alone, params)) if enough else out.unionByName(alone).drop("cluster_n")


def _enough(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Rows (class, cluster_n) of clusters with as many members as their class asks for."""
    r = with_params(rows, params.select("class", "min_frames"), prefix="_of_class_")
    return r.where(F.col("cluster_n") >= F.coalesce("_of_class_min_frames", F.lit(P.DEFAULT_MIN_FRAMES))).drop("_of_class_min_frames")


def large_enough(members: DataFrame, params: DataFrame) -> DataFrame:
    """Members of clusters with as many detections as their class asks for; the default for unknown and null classes. Repeated rows count each; no rows give none."""
    n = members.groupBy("job_id", "class", "cluster_id").agg(F.count("*").alias("n"))
    n = with_params(n, params.select("class", "min_frames")).where(F.col("n") >= F.coalesce("min_frames", F.lit(P.DEFAULT_MIN_FRAMES)))
    return members.join(n.select("cluster_id"), "cluster_id", "left_semi")


def class_order(entries: DataFrame) -> DataFrame:
    """job_id, class, n, first_seq: classes in the order in which they were first seen. Null jobs and classes are groups of their own; a null entry_seq counts, but isn't first."""
    return entries.groupBy("job_id", "class").agg(F.count("*").alias("n"), F.min("entry_seq").alias("first_seq"))


def scored(members: DataFrame) -> DataFrame:
    """members with norm_area (0 to 1 within the cluster, 1 where all are equal) and score. Without an area of its own, in a cluster of several areas, both are null; a null confidence gives a null score."""
    # in the order of the groups of summarized, which then needs no sort of its own
    whole = Window.partitionBy("cluster_id").orderBy("job_id", "class").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = members.where("cluster_id IS NOT NULL").withColumns({"lo": F.min("bbox_area").over(whole), "hi": F.max("bbox_area").over(whole)})
    norm = F.when(F.col("hi") > F.col("lo"), (F.col("bbox_area") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0))
    return m.withColumn("norm_area", norm).withColumn("score", F.col("confidence") + P.AREA_WEIGHT * F.col("norm_area")).drop("lo", "hi")


def summarized(members: DataFrame) -> DataFrame:
    """One row a cluster: members' counts and lists, and the rows with the largest box (closest) and score (best); ties go to the first.

    Null areas and scores come last, a null confidence counts as 0 in the mean, null times and frames are in no list, and
    a cluster without any distance has a null min_mono_m. Repeated rows count each. No members give no rows.
    """
    # what is gathered is made below the window of scored: within the aggregate, Spark would interpret it
    at = F.when(_posed(), F.struct(rounded(F.col("cam_lat"), 5) + 0.0, rounded(F.col("cam_lng"), 5) + 0.0))
    m = scored(members.withColumns({"_at": at, "_frame": F.struct("entry_seq", "frame_id")}))
    row = F.struct(*(F.col(c) for c in MEMBER))
    first = -F.col("entry_seq")
    in_order = F.array_sort(F.collect_list("_frame"))
    c = m.groupBy("cluster_id", "job_id", "class").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 4).alias("mean_conf"),
        F.min(positive(F.col("distance_m"))).alias("min_mono_m"),
        F.array_sort(F.collect_set("timestamp")).alias("members_video_sec"),
        F.transform(in_order, lambda x: x["frame_id"]).alias("source_frames"),
        F.count("obj_bearing").alias("bearings"),
        F.size(F.collect_set("_at")).cast("long").alias("unique_cam_pos"),
        F.max_by(row, F.struct("bbox_area", first)).alias("closest"),
        F.max_by(row, F.struct("score", first)).alias("best"),
    )
    return c.select("job_id", "class", *(x for x in c.columns if x not in ("job_id", "class")))


def _posed() -> Column:
    return F.col("cam_lat").isNotNull() & F.col("cam_lng").isNotNull()


def of_one(members: DataFrame) -> DataFrame:
    """summarized for members that are clusters of their own: row by row, without grouping them."""
    row = F.struct(*(F.col(c) for c in MEMBER))
    return members.select(
        "job_id", "class", "cluster_id",
        F.lit(1).cast("long").alias("n"),
        rounded(F.coalesce("confidence", F.lit(0.0)), 4).alias("mean_conf"),
        positive(F.col("distance_m")).alias("min_mono_m"),
        F.array_compact(F.array("timestamp")).alias("members_video_sec"),
        F.array("frame_id").alias("source_frames"),
        F.col("obj_bearing").isNotNull().cast("long").alias("bearings"),
        _posed().cast("long").alias("unique_cam_pos"),
        row.alias("closest"),
        row.alias("best"),
    )
