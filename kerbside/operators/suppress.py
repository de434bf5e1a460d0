"""Suppression of assets that one object of easily confused classes has twice."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside import params as P
from kerbside.functions.geo import haversine_ft
from kerbside.plans.scratch import Scratch

#: Sides of the grid, in degrees of latitude: a little over CONFLICT_FT; and seconds of a slot.
CELL_DEG, SLOT_S = 1.4e-4, 60.0
#: Conflicts that one task settles.
TOGETHER = 200_000


def _columns(band: Column) -> Column:
    """Cells around the globe in a band of latitude, none narrower than CELL_DEG anywhere in the band."""
    edge = F.greatest(F.abs(band), F.abs(band + 1)) * CELL_DEG
    return F.greatest(F.floor(F.cos(F.radians(F.least(edge, F.lit(90.0)))) * 360.0 / CELL_DEG), F.lit(1)).cast("long")


def _cell(lon: Column, band: Column) -> Column:
    n = _columns(band)
    return F.pmod(F.floor((lon + 180.0) / 360.0 * n).cast("long"), n)


def conflict_pairs(assets: DataFrame, confused: DataFrame) -> DataFrame:
    """job_id, a, b (cluster_id, a < b), dist_ft: assets of confused classes within CONFLICT_FT whose times come within CONFLICT_S.

    A grid over latitude and longitude and slots of time give the join its keys: the left side goes to its own cell and
    those around it, both sides to each slot of their time, and a pair counts in the later of their first slots.
    Assets without position, time or class are in no pair.
    """
    t0, t1 = F.array_min("members_video_sec") - P.CONFLICT_S, F.array_max("members_video_sec")
    x = assets.select("job_id", "class", "cluster_id", "lat", "lon", t0.alias("t0"), t1.alias("t1"), F.floor(F.col("lat") / CELL_DEG).alias("band")).where("lat IS NOT NULL AND lon IS NOT NULL AND t0 IS NOT NULL")
    first = F.floor(F.col("t0") / SLOT_S)
    x = x.withColumn("first", first).withColumn("slot", F.explode(F.sequence(first, F.floor(F.col("t1") / SLOT_S))))
    left = x.join(F.broadcast(confused), F.col("class") == F.col("class_a")).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    n = _columns(F.col("band"))
    around = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.pmod(_cell(F.col("lon"), F.col("band")) + o, n))
    left = left.withColumn("cell", F.explode(F.array_distinct(around))).alias("x")
    right = x.join(F.broadcast(confused.select(F.col("class_b").alias("class")).distinct()), "class", "left_semi")
    right = right.withColumn("cell", _cell(F.col("lon"), F.col("band"))).alias("y")
    d = haversine_ft(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon"))
    meet = (F.col("x.t0") <= F.col("y.t1")) & (F.col("y.t0") <= F.col("x.t1")) & (F.col("x.slot") == F.greatest("x.first", "y.first"))
    keys = (F.col("x.job_id") == F.col("y.job_id")) & (F.col("x.class_b") == F.col("y.class")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.slot") == F.col("y.slot"))
    j = left.join(right, keys & (F.col("x.cluster_id") < F.col("y.cluster_id")) & meet)
    return j.select("x.job_id", F.col("x.cluster_id").alias("a"), F.col("y.cluster_id").alias("b"), d.alias("dist_ft")).where(F.col("dist_ft") <= P.CONFLICT_FT)


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    """Ids that go, with the turn at which they do, when the turns that are left are taken one after the other. rows: turn, node, later_turn, later, better, gone (turns as numbers in order)."""
    gone = {n: g for n, g in zip(rows["later"], rows["gone"]) if g >= 0}
    for node, group in rows.sort_values(["turn", "later_turn"]).groupby("turn", sort=True):
        me = group["node"].iloc[0]
        if me in gone:
            continue
        for other, better in zip(group["later"], group["better"]):
            if gone.get(other, node) < node:
                continue
            if better:
                gone[me] = node
                break
            gone[other] = node
    return pd.DataFrame({"node": list(gone)}, dtype="int64")


def kept_assets(assets: DataFrame, conflicts: DataFrame, entries: DataFrame, together: int = TOGETHER, max_rounds: int = 10_000) -> DataFrame:
    """assets without those that the greedy pass drops: taken in the order of class first seen, then cluster, each asset that is left meets those left of its conflicts in order; the weaker in (confidence, n) goes, a tie spares the asset whose turn it is, and an asset that goes ends its turn.

    An asset that is left when its turn comes has only later ones left to meet, as an earlier one would have dropped it
    or gone. So its turn depends on its earlier conflicts, and on whether those of its later ones that are better still
    stand. In each round, all assets take their turn for which that is known, wherever they are: two joins of conflicts
    with what is known of their ends. What an asset drops is kept with its turn, so turns may be taken out of order. The
    first asset that is left can always act; runs of assets that wait for each other need better and better ones, so few
    rounds do unless confidences are sorted along a street. Once at most together conflicts are left, one task takes
    the turns that remain; that bounds its memory.

    Assets without conflicts stay; conflicts repeated or with assets that aren't there don't matter; a null confidence is
    never the better one. No assets give no rows.
    """
    scratch = Scratch(assets.sparkSession)
    first = entries.groupBy("job_id", "class").agg(F.min("entry_seq").alias("class_seq"))
    both = conflicts.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a = assets.join(first, ["job_id", "class"], "left").select("cluster_id", F.struct("class_seq", "cluster_id").alias("turn"), "confidence", F.col("num_detections_merged").alias("n"))
    x, y = (a.select(*(F.col(c).alias(f"{c}_{k}") for c in a.columns)) for k in "xy")
    e = both.join(x, F.col("a") == F.col("cluster_id_x")).join(y, F.col("b") == F.col("cluster_id_y"))
    ahead = F.col("turn_x") < F.col("turn_y")
    stronger = lambda k, m: F.coalesce((F.col(f"confidence_{k}") > F.col(f"confidence_{m}")) | ((F.col(f"confidence_{k}") == F.col(f"confidence_{m}")) & (F.col(f"n_{k}") > F.col(f"n_{m}"))), F.lit(False))
    pick = lambda c, early: F.when(ahead == early, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y"))
    e = e.select(pick("cluster_id", True).alias("node"), pick("turn", True).alias("turn"), pick("cluster_id", False).alias("later"), pick("turn", False).alias("later_turn"), F.when(ahead, stronger("y", "x")).otherwise(stronger("x", "y")).alias("better"))
    e = scratch.write(e, "conflicts")
    gone = e.select(F.col("node"), F.col("turn").alias("gone")).limit(0)
    left = e.count()
    for _ in range(max_rounds):
        if left <= together:
            break
        e, gone = _round(e, gone, scratch)
        left = e.count()
    else:
        raise RuntimeError(f"turns aren't settled after {max_rounds} rounds")
    dropped = gone.select(F.col("node").alias("cluster_id"))
    if left:
        dropped = dropped.union(_in_one_task(e, gone))
    dropped = scratch.write(dropped.distinct(), "dropped")
    return assets.join(dropped, "cluster_id", "left_anti")


def _round(e: DataFrame, gone: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conflicts of the assets whose turn is still to come, and who went at whose turn, after all turns that can be taken."""
    known = e.groupBy(F.col("later").alias("node")).agg(F.min("turn").alias("waits")).join(gone, "node", "full")
    mine, other = (known.select(F.col("node").alias(c), F.col("waits").alias(f"{c}_waits"), F.col("gone").alias(f"{c}_gone")) for c in ("node", "later"))
    j = e.join(mine, "node", "left").join(other, "later", "left")
    fallen = F.coalesce(F.col("later_gone") < F.col("turn"), F.lit(False))
    stands = F.col("later_waits") >= F.col("turn")
    acts = j.groupBy("node").agg(
        F.max(F.col("node_gone").isNotNull()).alias("out"),
        F.max(F.col("node_waits").isNotNull()).alias("waits"),
        F.min(F.when(F.col("better") & ~fallen & stands, F.col("later_turn"))).alias("ends"),
        F.min(F.when(F.col("better") & ~fallen & ~stands, F.col("later_turn"))).alias("unsure"),
    )
    sure = F.col("out") | (~F.col("waits") & (F.col("unsure").isNull() | F.coalesce(F.col("ends") < F.col("unsure"), F.lit(False))))
    acts = scratch.write(acts.where(sure).select("node", "out", "ends"), "acts")
    turns = e.join(acts.where("NOT out"), "node")
    falls = turns.where(F.col("ends").isNull() | (F.col("later_turn") < F.col("ends"))).select(F.col("later").alias("node"), F.col("turn").alias("gone"))
    ended = turns.where("ends IS NOT NULL").select("node", F.col("turn").alias("gone"))
    gone = scratch.write(gone.union(falls).union(ended).groupBy("node").agg(F.min("gone").alias("gone")), "gone")
    return scratch.write(e.join(acts, "node", "left_anti"), "conflicts"), gone


def _in_one_task(e: DataFrame, gone: DataFrame) -> DataFrame:
    """Ids that go in the turns that are left, of conflicts that fit one task."""
    j = e.join(gone.select(F.col("node").alias("later"), "gone"), "later", "left").join(gone.select("node", F.col("gone").alias("out")), "node", "left").where("out IS NULL")
    rows = j.select("node", "turn", "later", "later_turn", "better", "gone")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        place = {t: k for k, t in enumerate(sorted({*group["turn"], *group["later_turn"], *group["gone"].dropna()}))}
        g = group.assign(**{c: [place.get(t, -1) for t in group[c]] for c in ("turn", "later_turn", "gone")})
        return _settled(g).rename(columns={"node": "cluster_id"})

    text = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%020d|%020d", F.coalesce(F.col(f"{c}.class_seq"), F.lit(-1)) + 1, F.col(f"{c}.cluster_id")))
    rows = rows.select(F.lit(0).alias("all"), "node", "later", "better", *(text(c).alias(c) for c in ("turn", "later_turn", "gone")))
    return rows.groupBy("all").applyInPandas(run, "cluster_id long")
