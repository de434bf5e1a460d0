"""Least-squares intersection of bearing rays, cluster by cluster, by aggregates alone."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from kerbside import params as P
from kerbside.functions.geo import circular_gap_deg, rounded
from kerbside.plans.scratch import Scratch
from kerbside.plans.skew import HEAVY_GROUPS


#: Columns of entries that clusters and their triangulation read.
READ = ("job_id", "class", "entry_seq", "timestamp", "lat", "lon", "frame_id", "cam_lat", "cam_lng", "cam_bearing", "obj_bearing")


def local_rays(members: DataFrame) -> DataFrame:
    """Members with camera and bearing, in metres east (x) and north (y) of the cluster's mean camera position. Others are left out; repeated rows are rays each; no members give no rows."""
    r = members.where("cam_lat IS NOT NULL AND cam_lng IS NOT NULL AND obj_bearing IS NOT NULL AND cluster_id IS NOT NULL")
    whole = Window.partitionBy("cluster_id")
    r = r.withColumns({"lat0": F.avg("cam_lat").over(whole), "lng0": F.avg("cam_lng").over(whole), "n_rays": F.count("*").over(whole)})
    x = (F.col("cam_lng") - F.col("lng0")) * (P.DEGREE_M * F.cos(F.radians("lat0")))
    return r.withColumn("x", x).withColumn("y", (F.col("cam_lat") - F.col("lat0")) * P.DEGREE_M)


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull (Andrew's chain), at least one and at most all."""
    order = np.lexsort((y, x))
    order = order[np.append(True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0))].tolist()
    if len(order) < 3:
        return np.array(order)

    def chain(points):
        out: list[int] = []
        for k in points:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[k] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[k] - x[out[-2]]) <= 0:
                out.pop()
            out.append(k)
        return out

    return np.array(sorted({*chain(order), *chain(order[::-1])}))


#: Points of a cluster up to which all pairs are taken, many clusters at once.
FEW = 16


def _runs(ids: np.ndarray):
    cut = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, int)
    return zip(cut.tolist(), [*cut[1:].tolist(), len(ids)])


def baseline(rays: DataFrame) -> DataFrame:
    """cluster_id, baseline_m: largest distance of two cameras of a cluster with two rays or more.

    It is between corners of their convex hull. Tasks keep the hull's corners of what they hold, a batch at a time;
    only these are moved, and read cluster by cluster with the corners so far in memory.
    """

    def corners(batches):
        for b in batches:
            ids, x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            order = np.argsort(ids, kind="stable")
            ids, x, y = ids[order], x[order], y[order]
            keep, n = [], []
            if len(ids) and max(e - a for a, e in _runs(ids)) <= FEW:
                yield pa.record_batch([pa.array(v) for v in (ids, x, y, np.ones(len(ids), np.int64))], names=["cluster_id", "x", "y", "n"])
                continue
            for a, e in _runs(ids):
                k = np.arange(a, e) if e - a <= FEW else a + hull(x[a:e], y[a:e])
                keep.append(k)
                n.append(np.append(e - a, np.zeros(len(k) - 1, np.int64)))
            if keep:
                k = np.concatenate(keep)
                yield pa.record_batch([pa.array(v) for v in (ids[k], x[k], y[k], np.concatenate(n))], names=["cluster_id", "x", "y", "n"])

    def widest(batches):
        at, x, y, n = None, np.zeros(0), np.zeros(0), 0

        def row():
            dx, dy = x[:, None] - x, y[:, None] - y
            return at, n, float(np.sqrt(dx * dx + dy * dy).max())

        for b in batches:
            ids, bx, by, bn = (b.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            if not len(ids):
                continue
            rows, cut = [], np.array([a for a, _ in _runs(ids)])
            end = np.append(cut[1:], len(ids))
            few = end - cut <= FEW
            few[0] = few[-1] = False  # these may have more rows in the batch before or after
            far = np.zeros(len(ids))
            for k in range(1, min(FEW, len(ids))):
                dx, dy = bx[k:] - bx[:-k], by[k:] - by[:-k]
                far[:-k] = np.maximum(far[:-k], np.where(ids[k:] == ids[:-k], dx * dx + dy * dy, 0.0))
            whole = (ids[cut], np.add.reduceat(bn, cut), np.sqrt(np.maximum.reduceat(far, cut)))
            yield pa.record_batch([pa.array(v[few], t) for v, t in zip(whole, (pa.int64(), pa.int64(), pa.float64()))], names=["cluster_id", "n", "baseline_m"])
            for a, e in zip(cut[~few].tolist(), end[~few].tolist()):
                if ids[a] != at:
                    if at is not None:
                        rows.append(row())
                    at, x, y, n = int(ids[a]), np.zeros(0), np.zeros(0), 0
                x, y, n = np.append(x, bx[a:e]), np.append(y, by[a:e]), n + int(bn[a:e].sum())
                if len(x) > 16:
                    k = hull(x, y)
                    x, y = x[k], y[k]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["cluster_id", "n", "baseline_m"])
        if at is not None:
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row(), (pa.int64(), pa.int64(), pa.float64()))], names=["cluster_id", "n", "baseline_m"])

    some = rays.select(F.col("cluster_id").cast("long").alias("cluster_id"), "x", "y").mapInArrow(corners, "cluster_id long, x double, y double, n long")
    some = some.repartition("cluster_id").sortWithinPartitions("cluster_id")
    return some.mapInArrow(widest, "cluster_id long, n long, baseline_m double").where("n > 1").select("cluster_id", "baseline_m")


SEEN = ("frame", "cam_lat", "cam_lng", "cam_bearing", "obj_bearing")


def _seen(rows: DataFrame) -> Column:
    """What a report shows of a ray, after its entry_seq."""
    have = {"frame": "frame_id", **{c: c for c in SEEN[1:]}}
    return F.struct("entry_seq", *(F.col(have[c]).alias(c) if have[c] in rows.columns else F.lit(None).cast("double").alias(c) for c in SEEN))


def widest_rays(rays: DataFrame) -> DataFrame:
    """cluster_id, spread_deg, a, b: widest gap of two bearings and the first pair (by entry_seq) that has it, as structs of SEEN.

    The first ray of each bearing stands for it. The bearing farthest from another is one of the two on either side of
    its antipode, so bearings and antipodes are put in one circular order, and each antipode takes the last bearing
    before it and the next one after it: two sorts, no pairs. Without a gap, the first two rays; clusters of one ray have
    no row.
    """
    p = rays.groupBy("cluster_id", F.pmod("obj_bearing", F.lit(360.0)).alias("angle")).agg(F.min(_seen(rays)).alias("r"))
    p = p.withColumn("here", F.struct("angle", "r")).drop("r")
    none = F.lit(None).cast(p.schema["here"].dataType)
    bearing = F.struct("angle", "here", none.alias("of"))
    antipode = F.struct(F.pmod(F.col("angle") + 180.0, F.lit(360.0)).alias("angle"), none.alias("here"), F.col("here").alias("of"))
    stops = p.select("cluster_id", F.inline(F.array(bearing, antipode)))
    turn = Window.partitionBy("cluster_id")
    so_far = lambda *order: F.last("here", ignorenulls=True).over(turn.orderBy(*order, F.col("here").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    j = stops.withColumn("before", so_far(F.col("angle"))).withColumn("after", so_far(F.col("angle").desc()))
    j = j.withColumn("before", F.coalesce("before", F.max("here").over(turn))).withColumn("after", F.coalesce("after", F.min("here").over(turn)))
    j = j.where("of IS NOT NULL").select("cluster_id", F.col("of").alias("x"), F.explode(F.array("before", "after")).alias("y"))
    gap = circular_gap_deg(F.col("x.angle"), F.col("y.angle"))
    first = F.col("x.r.entry_seq") < F.col("y.r.entry_seq")
    pair = F.struct(gap.alias("gap"), F.when(first, F.col("x.r")).otherwise(F.col("y.r")).alias("a"), F.when(first, F.col("y.r")).otherwise(F.col("x.r")).alias("b"))
    j = j.select("cluster_id", pair.alias("w"))
    rank = F.struct("w.gap", (-F.col("w.a.entry_seq")).alias("a"), (-F.col("w.b.entry_seq")).alias("b"))
    wide = j.groupBy("cluster_id").agg(F.max_by("w", rank).alias("w")).where("w.gap > 0")
    two = _first_two(rays).where("b IS NOT NULL")
    j = two.join(wide, "cluster_id", "left")
    return j.select("cluster_id", F.coalesce("w.gap", F.lit(0.0)).alias("spread_deg"), F.coalesce("w.a", "a").alias("a"), F.coalesce("w.b", "b").alias("b"))


def _first_two(rows: DataFrame) -> DataFrame:
    """cluster_id, a, b: the first two rows by entry_seq as structs of SEEN; b is null where there is one."""
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("entry_seq"))
    r = rows.select("cluster_id", "entry_seq", _seen(rows).alias("r")).withColumn("k", rank).where("k <= 2")
    return r.groupBy("cluster_id").agg(F.min(F.when(F.col("k") == 1, F.col("r"))).alias("a"), F.min(F.when(F.col("k") == 2, F.col("r"))).alias("b"))


def pairs_of_few(rays: DataFrame) -> DataFrame:
    """cluster_id, baseline_m, spread_deg, a, b, as baseline and widest_rays have them, of clusters of 2 to FEW rays (n_rays, of local_rays): all pairs of rays, many clusters at once."""
    some = rays.where(F.col("n_rays").between(2, FEW)).select(F.col("cluster_id").cast("long").alias("cluster_id"), "entry_seq", "x", "y", F.pmod("obj_bearing", F.lit(360.0)).alias("angle"), _seen(rays).alias("r"))
    seen = some.schema["r"].dataType
    out = StructType([StructField("cluster_id", LongType()), StructField("baseline_m", DoubleType()), StructField("spread_deg", DoubleType()), StructField("a", seen), StructField("b", seen)])

    def widest(t: pa.Table) -> pa.RecordBatch:
        ids, x, y, angle = (t.column(c).to_numpy() for c in ("cluster_id", "x", "y", "angle"))
        n = len(ids)
        far, gap, other = np.zeros(n), np.full(n, -1.0), np.minimum(np.arange(1, n + 1), n - 1)
        for k in range(1, min(FEW, n)):
            same = ids[k:] == ids[:-k]
            dx, dy, turn = x[k:] - x[:-k], y[k:] - y[:-k], np.abs(angle[k:] - angle[:-k])
            far[:-k] = np.maximum(far[:-k], np.where(same, dx * dx + dy * dy, 0.0))
            turn = np.where(same, np.minimum(turn, 360.0 - turn), -1.0)
            wider = turn > gap[:-k]  # the first of equals stays
            gap[:-k], other[:-k] = np.where(wider, turn, gap[:-k]), np.where(wider, np.arange(k, n), other[:-k])
        cut = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        most = np.maximum.reduceat(gap, cut)
        at = np.where(gap == np.repeat(most, np.diff(np.append(cut, n))), np.arange(n), n)
        first = np.minimum.reduceat(at, cut)
        r = t.column("r").combine_chunks()
        columns = [pa.array(ids[cut]), pa.array(np.sqrt(np.maximum.reduceat(far, cut))), pa.array(most), r.take(pa.array(first)), r.take(pa.array(other[first]))]
        return pa.record_batch(columns, names=out.names)

    def clusters(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            ids = t.column("cluster_id").to_numpy()
            last = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0  # the last cluster may have more rays in the next batch
            if last:
                yield widest(t.slice(0, last))
            held = t.slice(last)
        if held is not None and held.num_rows:
            yield widest(held)

    return some.repartition("cluster_id").sortWithinPartitions("cluster_id", "entry_seq").mapInArrow(clusters, out)


def spread(rays: DataFrame) -> DataFrame:
    """widest_rays with the rays' entry_seq alone."""
    return widest_rays(rays).select("cluster_id", "spread_deg", F.col("a.entry_seq").alias("a"), F.col("b.entry_seq").alias("b"))


def solved(rays: DataFrame) -> DataFrame:
    """cluster_id, singular, qx, qy, raw_lat, raw_lon: the point nearest to all lines through the rays, by the normal equations.

    Clusters of one ray have no row; parallel rays, repeated ones among them, are singular and have no point.
    """
    nx, ny = F.cos(F.radians("obj_bearing")), -F.sin(F.radians("obj_bearing"))
    pn = F.col("x") * nx + F.col("y") * ny
    s = rays.groupBy("cluster_id").agg(F.count("*").alias("n_rays"), F.first("lat0").alias("lat0"), F.first("lng0").alias("lng0"), F.sum(nx * nx).alias("a11"), F.sum(nx * ny).alias("a12"), F.sum(ny * ny).alias("a22"), F.sum(pn * nx).alias("b1"), F.sum(pn * ny).alias("b2"))
    s = s.where("n_rays > 1").withColumn("det", F.expr("a11 * a22 - a12 * a12")).withColumn("trace", F.expr("a11 + a22"))
    s = s.withColumn("singular", F.abs("det") < 1e-4 * F.greatest(F.col("trace") * F.col("trace"), F.lit(1.0)))
    s = s.withColumn("qx", F.when(~F.col("singular"), F.expr("(a22 * b1 - a12 * b2) / det"))).withColumn("qy", F.when(~F.col("singular"), F.expr("(a11 * b2 - a12 * b1) / det")))
    lat, lon = F.col("lat0") + F.col("qy") / P.DEGREE_M, F.col("lng0") + F.col("qx") / (P.DEGREE_M * F.cos(F.radians("lat0")))
    return s.select("cluster_id", "n_rays", "singular", "det", "trace", "qx", "qy", lat.alias("raw_lat"), lon.alias("raw_lon"))


def residuals(rays: DataFrame, solution: DataFrame) -> DataFrame:
    """cluster_id, residual_m (mean distance from the lines), closest_m, farthest_m (from the cameras). Clusters without a solution, or with a singular one, have no row."""
    r = rays.select("cluster_id", "x", "y", "obj_bearing").join(solution.where("NOT singular").select("cluster_id", "qx", "qy"), "cluster_id")
    dx, dy, t = F.col("qx") - F.col("x"), F.col("qy") - F.col("y"), F.radians("obj_bearing")
    far = F.sqrt(dx * dx + dy * dy)
    return r.groupBy("cluster_id").agg(F.avg(F.abs(dx * F.cos(t) - dy * F.sin(t))).alias("residual_m"), F.min(far).alias("closest_m"), F.max(far).alias("farthest_m"))


def gate():
    """Reason of rejection, null if accepted; the first gate that fails, on unrounded values. No number of rays counts as none; a gate whose value is null doesn't fail."""
    c = F.col
    return (
        F.when(F.coalesce(c("n_rays"), F.lit(0)) < 2, "too_few_bearings")
        .when(c("baseline_m") < P.MIN_BASELINE_M, "baseline_too_short")
        .when(c("spread_deg") < P.MIN_SPREAD_DEG, "bearing_spread_too_small")
        .when(c("singular"), "singular_matrix")
        .when(c("residual_m") > P.MAX_RESIDUAL_M, "residual_too_big")
        .when(c("farthest_m") > P.MAX_FARTHEST_M, "too_far_from_cams")
        .when(c("closest_m") < P.MIN_CLOSEST_M, "collapsed_onto_track")
    )


def triangulated(members: DataFrame) -> DataFrame:
    """One row a cluster: status, reject_reason, n_rays, n_cluster, the rounded solution and its diagnostics, and the two widest rays.

    Members without camera or bearing count for n_cluster alone; no members give no rows. Rays are written once, as
    several passes read them; what the passes find is joined by cluster. Clusters of few rays, most of them, have their
    baseline and widest gap by all pairs; first members are sought only where there aren't two rays to show.
    """
    scratch = Scratch(members.sparkSession)
    rays = scratch.write(local_rays(members), "rays")
    s = solved(rays)
    r = residuals(rays, s)
    posed = F.col("cam_lat").isNotNull() & F.col("cam_lng").isNotNull() & F.col("obj_bearing").isNotNull()
    n = scratch.write(members.groupBy("job_id", "class", "cluster_id").agg(F.count("*").alias("n_cluster"), F.count_if(posed).alias("n_rays")), "sizes")
    many = rays.where(F.col("n_rays") > FEW)
    wide = pairs_of_few(rays).unionByName(baseline(many).join(widest_rays(many), "cluster_id"))
    bare = n.where("n_rays < 2").select("cluster_id")
    bare = F.broadcast(bare) if bare.count() <= HEAVY_GROUPS else bare
    two = _first_two(members.join(bare, "cluster_id", "left_semi")).select("cluster_id", F.col("a").alias("a1"), F.col("b").alias("b1"))
    t = n.join(s.drop("n_rays"), "cluster_id", "left").join(r, "cluster_id", "left").join(wide, "cluster_id", "left").join(two, "cluster_id", "left")
    t = t.withColumn("reject_reason", gate()).withColumn("a", F.coalesce("a", "a1")).withColumn("b", F.coalesce("b", "b1"))
    alone = F.col("n_rays") < 2
    keep = ~alone & ~F.coalesce(F.col("reject_reason") == "singular_matrix", F.lit(False))
    shown = lambda c, d, when=keep: F.when(when, rounded(F.col(c), d)).alias(c)
    return t.select(
        "job_id", "class", "cluster_id", F.when(F.col("reject_reason").isNull(), "ok").otherwise("rejected").alias("status"), "reject_reason", "n_rays", "n_cluster",
        shown("baseline_m", 2, ~alone), shown("spread_deg", 2, ~alone), shown("residual_m", 2), shown("closest_m", 2), shown("farthest_m", 2), shown("raw_lat", 7), shown("raw_lon", 7),
        *(F.col(f"{k}.{c}").alias(f"{c}_{k}") for k in "ab" for c in SEEN), F.when(~alone, F.col("det")).alias("det"), F.when(~alone, F.col("trace")).alias("trace"),
    )


def alone(one: Callable[[str], Column] = lambda c: F.col(f"closest.{c}")) -> dict[str, Column]:
    """What triangulated finds of a cluster of one member: columns by name, without grouping. one: gives the member's columns, those of a row of cluster.of_one by default."""
    none = F.lit(None).cast("double")
    posed = one("cam_lat").isNotNull() & one("cam_lng").isNotNull() & one("obj_bearing").isNotNull()
    seen = {"frame": one("frame_id"), **{c: one(c) for c in SEEN[1:]}}
    return {
        "status": F.lit("rejected"), "reject_reason": F.lit("too_few_bearings"), "n_rays": posed.cast("long"), "n_cluster": F.lit(1).cast("long"),
        **{c: none for c in ("baseline_m", "spread_deg", "residual_m", "closest_m", "farthest_m", "raw_lat", "raw_lon")},
        **{f"{c}_a": v for c, v in seen.items()}, **{f"{c}_b": F.when(F.lit(False), v) for c, v in seen.items()}, "det": none, "trace": none,
    }
