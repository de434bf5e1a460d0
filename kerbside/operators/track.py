"""Camera poses: interpolation along a GPS track and the choice of source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside import params as P


#: Seconds of a slot: the points and times of a job's slot are one window.
SLOT_S = 3600


def interpolated(track: DataFrame, times: DataFrame) -> DataFrame:
    """times (job_id, frame_idx, ts) with lat, lng, ele of the track (job_id, pt_seq, ts, lat, lng, ele) at that time.

    Linear between neighbours; up to 60 s outside the track with the speed of its first or last two points, up to 300 s
    its end point, beyond that null. A track of one point, asked for its very time, gives null; so do null times and
    jobs without a track. Points without time are left out. Each row of times gives a row; points of one time count in
    the order of pt_seq.

    An as-of join without a range join: in each slot of SLOT_S seconds of a job, points and times in one order of
    time; each time takes the next point, which carries the one before it. A second small window, of a row a slot,
    carries the last point into a slot and the first one of later slots back. Both run in one direction, so each row is
    read once.
    """
    sec = F.unix_micros("ts") / 1e6
    slot = F.floor(F.col("t") / SLOT_S)
    point = F.struct("t", "pt_seq", "lat", "lng", "ele")
    p = track.select("job_id", sec.alias("t"), "pt_seq", "lat", "lng", "ele").where("t IS NOT NULL").withColumn("slot", slot).withColumn("p", point)
    by_slot = Window.partitionBy("job_id").orderBy("slot")
    slots = p.groupBy("job_id", "slot").agg(F.min("p").alias("head"), F.max("p").alias("tail"))
    slots = slots.select("job_id", "slot", F.lag("tail").over(by_slot).alias("left"), F.lead("head").over(by_slot).alias("right"))
    inside = Window.partitionBy("job_id", "slot").orderBy("t", "pt_seq")
    p = p.withColumn("before", F.lag("p").over(inside)).withColumn("after", F.lead("p").over(inside)).join(slots, ["job_id", "slot"])
    p = p.select("job_id", "slot", "t", "pt_seq", "p", F.coalesce("before", "left").alias("before"), F.coalesce("after", "right").alias("after"))
    order = F.struct("t", "pt_seq")
    ends = p.groupBy("job_id").agg(F.count("*").alias("n"), F.min_by(F.struct("p", "after"), order).alias("first"), F.max_by(F.struct("p", "before"), order).alias("last"))
    knots = p.select("job_id", "slot", "t", F.lit(1).alias("kind"), "pt_seq", F.struct("p", "before", "after").alias("seg"), F.lit(None).cast("long").alias("frame_idx"))
    empty = F.lit(None).cast(knots.schema["seg"].dataType)
    asked = times.select("job_id", sec.alias("t"), F.col("frame_idx").cast("long").alias("frame_idx"))
    asked = asked.select("job_id", slot.alias("slot"), "t", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("pt_seq"), empty.alias("seg"), "frame_idx")
    heads = knots.groupBy("job_id", "slot").agg(F.min_by("seg", order).alias("head"))
    every = heads.unionByName(asked.select("job_id", "slot", empty.alias("head"))).groupBy("job_id", "slot").agg(F.max("head").alias("head"))
    later = Window.partitionBy("job_id").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    every = every.select("job_id", "slot", F.last("head", ignorenulls=True).over(later).alias("next"))
    back = Window.partitionBy("job_id", "slot").orderBy(F.desc("t"), F.desc("kind"), F.desc("pt_seq")).rowsBetween(Window.unboundedPreceding, 0)
    found = knots.unionByName(asked).withColumn("s", F.last("seg", ignorenulls=True).over(back)).where("kind = 0")
    same = found.job_id.eqNullSafe(every.job_id) & found.slot.eqNullSafe(every.slot)
    found = found.join(every, same, "left").select(found.job_id, "frame_idx", "t", F.coalesce("s", "next").alias("s"))
    found = found.join(ends, "job_id", "left")
    a = F.when(F.col("s.before").isNotNull(), F.col("s.before")).otherwise(F.col("s.p"))
    b = F.when(F.col("s.before").isNotNull(), F.col("s.p")).otherwise(F.col("s.after"))
    found = found.withColumn("a", a).withColumn("b", b)
    t, t0, t1 = F.col("t"), F.col("first.p.t"), F.col("last.p.t")

    def value(c: str):
        f0, f1, l0, l1 = F.col(f"first.p.{c}"), F.col(f"first.after.{c}"), F.col(f"last.before.{c}"), F.col(f"last.p.{c}")
        early = f0 - (t0 - t) / F.greatest(F.col("first.after.t") - t0, F.lit(0.001)) * (f1 - f0)
        late = l1 + (t - t1) / F.greatest(t1 - F.col("last.before.t"), F.lit(0.001)) * (l1 - l0)
        span = F.col("b.t") - F.col("a.t")
        ratio = F.when(span > 0, (t - F.col("a.t")) / span).otherwise(F.lit(0.0))
        inside = F.col(f"a.{c}") + ratio * (F.col(f"b.{c}") - F.col(f"a.{c}"))
        return (
            F.when((t < t0 - P.CUTOFF_S) | (t > t1 + P.CUTOFF_S), F.lit(None).cast("double"))
            .when(t < t0, F.when((t0 - t > P.EXTRAPOLATE_S) | (F.col("n") < 2), f0).otherwise(early))
            .when(t > t1, F.when((t - t1 > P.EXTRAPOLATE_S) | (F.col("n") < 2), l1).otherwise(late))
            .when(F.col("n") < 2, F.lit(None).cast("double"))
            .otherwise(inside)
        )

    return found.select("job_id", "frame_idx", value("lat").alias("lat"), value("lng").alias("lng"), value("ele").alias("ele"))


def resolved(frames: DataFrame, ocr: DataFrame, gps: DataFrame) -> DataFrame:
    """frames (job_id, frame_idx) with lat, lng, ele, bearing, gps_source: overlay text first (height 0), then the track.

    Frames in neither have nulls, as do those of a null job or number. A text without a latitude counts as none but for its
    bearing. ocr and gps have one row a frame at most; more give as many rows. No frames give no rows.
    """
    o = ocr.select("job_id", "frame_idx", F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"), F.col("bearing").alias("o_bearing"))
    g = gps.select("job_id", "frame_idx", F.col("lat").alias("g_lat"), F.col("lng").alias("g_lng"), F.col("ele").alias("g_ele"))
    f = frames.join(o, ["job_id", "frame_idx"], "left").join(g, ["job_id", "frame_idx"], "left")
    by = F.when(F.col("o_lat").isNotNull(), "ocr").when(F.col("g_lat").isNotNull(), "gpx")
    pick = lambda x, y: F.when(F.col("o_lat").isNotNull(), x).otherwise(y)
    return f.select(*frames.columns, pick(F.col("o_lat"), F.col("g_lat")).alias("lat"), pick(F.col("o_lng"), F.col("g_lng")).alias("lng"), pick(F.lit(0.0), F.col("g_ele")).alias("ele"), F.col("o_bearing").alias("bearing"), by.alias("gps_source"))


def indexed(listing: DataFrame) -> DataFrame:
    """listing (job_id, path, readable) with frame_idx in path order; unreadable images take an index and are then left out.

    Null paths come first, a null readable counts as unreadable, and repeated paths have an index each.
    """
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("path")) - 1
    return listing.withColumn("frame_idx", n.cast("long")).where("readable")
