"""Links between entries in linear number: cells whose members all link, and one witness between two cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside import params as P
from kerbside.functions import grid
from kerbside.functions.geo import haversine_ft
from kerbside.operators.detect import with_params
from kerbside.plans.scratch import Scratch

#: Pairs of members, for each entry, up to which open pairs of cells are tried member by member; beyond, cells are cut.
TRIES = 32
#: Cells along a side of the blocks by which cells meet, and slots of one.
BLOCK, SLOTS = 8, 2
BOX = ("lat_lo", "lat_hi", "lon_lo", "lon_hi", "t_lo", "t_hi")


def keyed(entries: DataFrame, params: DataFrame, gate_s: float = P.TIME_GATE_S) -> DataFrame:
    """entries with _cell, a struct of job, class, slot of gate_s, band and column, and _eps_ft; _cell is null where one of these has no value.

    A cell is as long as the gate and its diagonal as the class's radius, so all its members link.
    """
    e = with_params(entries, params.select("class", "eps_ft"), prefix="_").withColumn("_eps_ft", F.coalesce("_eps_ft", F.lit(P.DEFAULT_EPS_FT)))
    side = F.col("_eps_ft") / (grid.DEGREE_FT * 2**0.5) * 0.9999
    b = grid.band(F.col("lat"), side)
    key = F.struct("job_id", "class", F.floor(F.col("timestamp") / gate_s).cast("long").alias("slot"), b.alias("band"), grid.column(F.col("lon"), grid.narrow_columns(b, side)).alias("col"))
    whole = F.col("job_id").isNotNull() & F.col("class").isNotNull() & F.col("timestamp").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return e.withColumn("_cell", F.when(whole, key))


def _boxed(rows: DataFrame, *by: str) -> DataFrame:
    lo_hi = [f(c).alias(f"{n}_{k}") for c, n in (("lat", "lat"), ("lon", "lon"), ("timestamp", "t")) for f, k in ((F.min, "lo"), (F.max, "hi"))]
    return rows.groupBy(*by).agg(F.min("entry_seq").alias("node"), F.count("*").alias("n"), *lo_hi)


def cells(rows: DataFrame) -> DataFrame:
    """Of rows of keyed: _cell, node (smallest entry_seq of its members), n, _eps_ft and the box of its members."""
    return _boxed(rows.where("_cell IS NOT NULL"), "_cell", "_eps_ft")


def _bounds(u: str, v: str, gate_s: float) -> tuple[Column, Column]:
    """Whether members of two boxes may link, and whether they must."""
    a, b = (lambda c: F.col(f"{u}.{c}")), (lambda c: F.col(f"{v}.{c}"))
    apart = lambda c: F.greatest(F.lit(0.0), a(f"{c}_lo") - b(f"{c}_hi"), b(f"{c}_lo") - a(f"{c}_hi"))
    across = lambda c: F.greatest(a(f"{c}_hi") - b(f"{c}_lo"), b(f"{c}_hi") - a(f"{c}_lo"))
    mid = (a("lon_lo") + a("lon_hi") - b("lon_lo") - b("lon_hi")) / 2
    half = (a("lon_hi") - a("lon_lo") + b("lon_hi") - b("lon_lo")) / 2
    turn = F.abs(F.pmod(mid + 180.0, F.lit(360.0)) - 180.0)
    far = lambda x: F.cos(F.radians(F.greatest(F.abs(x("lat_lo")), F.abs(x("lat_hi")))))
    near = lambda x: F.when((x("lat_lo") <= 0) & (x("lat_hi") >= 0), 1.0).otherwise(F.cos(F.radians(F.least(F.abs(x("lat_lo")), F.abs(x("lat_hi"))))))

    def feet(dlat: Column, dlon: Column, cosines: Column) -> Column:
        s, t = F.sin(F.radians(dlat) / 2), F.sin(F.radians(dlon) / 2)
        return 2 * P.EARTH_FT * F.asin(F.least(F.sqrt(s * s + cosines * t * t), F.lit(1.0)))

    least = feet(apart("lat"), F.greatest(turn - half, F.lit(0.0)), far(a) * far(b))
    most = feet(across("lat"), F.least(turn + half, F.lit(180.0)), near(a) * near(b))
    eps = F.col("_eps_ft")
    soon = (apart("t") <= gate_s) & (apart("lat") * grid.DEGREE_FT <= eps * (1 + 1e-6))  # before the sines, as it is cheap
    return soon & (least <= eps * (1 + 1e-9)), (most <= eps * (1 - 1e-9)) & (across("t") <= gate_s)


def _side() -> Column:
    return F.col("_eps_ft") / (grid.DEGREE_FT * 2**0.5) * 0.9999


def _block_columns() -> Column:
    return grid.narrow_columns(F.col("blocks"), _side() * BLOCK)


def _large(x: Column, n: int) -> Column:
    return F.floor(x / n).cast("long")


def in_blocks(c: DataFrame) -> DataFrame:
    """Cells, their keys as columns, with slots, blocks and block: the one block that a cell is in, by its slot, band and the western edge of its members."""
    c = c.select("*", "_cell.*").drop("_cell").withColumn("slots", _large(F.col("slot"), SLOTS)).withColumn("blocks", _large(F.col("band"), BLOCK))
    return c.withColumn("block", grid.column(F.col("lon_lo"), _block_columns()))


def around(c: DataFrame) -> DataFrame:
    """Cells, their keys as columns, once for each block (see in_blocks) that a neighbour of the same slot or the next can be in."""
    ends = [F.col("band") - 2, F.col("band") + 2]
    # members of a cell are all in its column, so the edge that its block goes by is at most a column from the one that links
    width = 360.0 / F.least(*(grid.narrow_columns(b, _side()) for b in ends)) * 1.0001
    c = c.select("*", "_cell.*").drop("_cell").withColumn("reach", grid.reach(F.greatest(*(grid.farthest(b, _side()) for b in ends)), F.col("_eps_ft")) + width)
    c = c.withColumn("slots", F.explode(F.sequence(_large(F.col("slot"), SLOTS), _large(F.col("slot") + 1, SLOTS))))
    c = c.withColumn("blocks", F.explode(F.sequence(*(_large(b, BLOCK) for b in ends)))).withColumn("n_blocks", _block_columns())
    block = F.explode(F.sequence(*grid.first_last(F.col("lon_lo") - F.col("reach"), F.col("lon_hi") + F.col("reach"), F.col("n_blocks"))))
    return c.withColumn("block", block).withColumn("block", F.pmod("block", "n_blocks")).drop("reach", "n_blocks")


def neighbours(c: DataFrame, gate_s: float = P.TIME_GATE_S) -> DataFrame:
    """a, b, tries, sure, _eps_ft: pairs of cells that may hold a link, once each; sure: all their members link. tries: pairs of members.

    Cells meet by blocks of BLOCK by BLOCK cells and SLOTS slots, so that few copies of a cell are moved; a block has a
    fixed number of cells, however dense it is.
    """
    x, y = around(c).drop("col").alias("u"), in_blocks(c).drop("_eps_ft", "col").alias("v")
    u, v = (lambda k: F.col(f"u.{k}")), (lambda k: F.col(f"v.{k}"))
    # keys that tell most cells apart come first: sorting then seldom compares classes
    same = (u("block") == v("block")) & (u("slots") == v("slots")) & (u("blocks") == v("blocks")) & (u("job_id") == v("job_id")) & (u("class") == v("class"))
    once = ((v("slot") == u("slot") + 1) | ((v("slot") == u("slot")) & (u("node") < v("node")))) & (F.abs(v("band") - u("band")) <= 2)
    may, must = _bounds("u", "v", gate_s)
    j = x.join(y, same & once & may)
    return j.select(F.col("u.node").alias("a"), F.col("v.node").alias("b"), (_points("u") * _points("v")).alias("tries"), must.alias("sure"), "_eps_ft")


def _points(u: str) -> Column:
    """Members of a node that differ, or more."""
    one = F.lit(True)
    for c in ("lat", "lon", "t"):
        one = one & (F.col(f"{u}.{c}_lo") == F.col(f"{u}.{c}_hi"))
    return F.when(one, 1.0).otherwise(F.col(f"{u}.n").cast("double"))


def links(rows: DataFrame, c: DataFrame, scratch: Scratch, gate_s: float = P.TIME_GATE_S, tries: int = TRIES, max_rounds: int = 60) -> DataFrame:
    """a, b: pairs of cells (by node) of which a member of one links to a member of the other.

    rows: of keyed, c: its cells, both written tables. A cell has at most some fifty neighbours, so links are at most a
    constant times the cells, however many members link. Where boxes settle a pair of cells, members aren't read; the
    others are tried member by member if that takes at most tries for each row. If it takes more, the members of open
    pairs are cut at the middle of their boxes in latitude, longitude and time, boxes are drawn anew, and the parts
    that stay open are taken further; a pair of cells ends with its first link.
    """
    near = scratch.write(neighbours(c, gate_s), "near")
    found = near.where("sure").select("a", "b")
    open_ = near.where("NOT sure").select("a", "b", F.col("a").alias("u"), F.col("b").alias("v"), "tries", "_eps_ft")
    points = rows.where("_cell IS NOT NULL").select("_cell", "entry_seq", "lat", "lon", "timestamp")
    nodes = c.select("node", "n", *BOX)
    more = F.sum(F.when(F.col("tries") > 1, F.col("tries")).otherwise(0.0))  # pairs of single points are tried as they are
    (work, left), n = open_.agg(more, F.count("*")).first(), None
    if left:
        held = points.join(c.select("_cell", "node"), "_cell").drop("_cell")
        ends = lambda o: o.select(F.col("u").alias("node")).union(o.select(F.col("v").alias("node"))).distinct()
        for _ in range(max_rounds):
            n = c.agg(F.sum("n")).first()[0] if n is None else n
            if not work or work <= tries * n:
                break
            parts = scratch.write(held.join(ends(open_).join(nodes, "node"), "node").withColumn("part", _part()).select("node", "part", "entry_seq", "lat", "lon", "timestamp"), "parts")
            kids = scratch.write(_boxed(parts.withColumnRenamed("node", "whole"), "whole", "part"), "kids")
            held = parts.join(kids.select(F.col("whole").alias("node"), "part", F.col("node").alias("kid")), ["node", "part"]).drop("node", "part").withColumnRenamed("kid", "node")
            o = open_.select("a", "b", F.col("u").alias("_u"), F.col("v").alias("_v"), "_eps_ft")
            j = o.join(kids.alias("u"), F.col("_u") == F.col("u.whole")).join(kids.alias("v"), F.col("_v") == F.col("v.whole"))
            may, must = _bounds("u", "v", gate_s)
            j = scratch.write(j.where(may).select("a", "b", F.col("u.node").alias("u"), F.col("v.node").alias("v"), (_points("u") * _points("v")).alias("tries"), must.alias("sure"), "_eps_ft"), "near")
            settled = j.where("sure").select("a", "b").distinct()
            found = found.union(settled)
            open_ = scratch.write(j.where("NOT sure").drop("sure").join(settled, ["a", "b"], "left_anti"), "open")
            nodes, work = kids.select("node", "n", *BOX), open_.agg(more).first()[0]
        else:
            raise RuntimeError(f"links aren't settled after {max_rounds} rounds")
        held = held.join(ends(open_), "node", "left_semi").dropDuplicates(["node", "lat", "lon", "timestamp"])
        x, y = held.alias("x"), held.alias("y")
        d = haversine_ft(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon"))
        j = open_.join(x, F.col("u") == F.col("x.node")).join(y, F.col("v") == F.col("y.node"))
        found = found.union(j.where((d <= F.col("_eps_ft")) & (F.abs(F.col("x.timestamp") - F.col("y.timestamp")) <= gate_s)).select("a", "b").distinct())
    return found


def _part() -> Column:
    """Which eighth of its node's box a member is in; a box with any extent gives two parts at least."""
    out = F.lit(0)
    for k, (c, n) in enumerate((("lat", "lat"), ("lon", "lon"), ("timestamp", "t"))):
        mid = (F.col(f"{n}_lo") + F.col(f"{n}_hi")) / 2
        cut = F.when(mid >= F.col(f"{n}_hi"), F.col(f"{n}_lo")).otherwise(mid)
        out = out + F.when(F.col(c) > cut, 1 << k).otherwise(0)
    return out
