"""Operator 2: mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.plans.scratch import Scratch

#: Ranges of the sampling key in which a source's sizes are summed.
RANGES = 4096
#: Sources whose targets are broadcast (about 60 bytes each); beyond it the join shuffles.
BROADCAST_SOURCES = 200_000


def n_words(text: Column) -> Column:
    t = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", 0).otherwise(F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """source, source_size -> source, source_size, target: shares of the sum by weight, each cap * source_size at most.

    Sources by code point, null last, take the weights in turn. What a capped source leaves is shared by weight again
    until none is above its cap: with the sources in the order of cap / weight, the first k are capped, for the
    smallest k whose rest, shared by weight, fits the next one. One row a source; sizes 0 have target 0.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1)
    s = sources.withColumn("w", w.cast("long")).withColumn("most", F.col("source_size") * cap)
    s = s.withColumn("ratio", F.col("most") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    s = s.withColumn("level", left / weight).withColumn("k", F.row_number().over(order))
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("k"))).over(everything)
    s = s.withColumn("free", free)
    level = F.max(F.when(F.col("k") == F.col("free"), F.col("level"))).over(everything)
    target = F.when(F.col("free").isNull() | (F.col("k") < F.col("free")), F.col("most").cast("double")).otherwise(F.col("w") * level)
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 17) -> DataFrame:
    """Repeats each document so that each source's words come near its target.

    docs: columns doc_id, text, source; others are ignored. Returns, for each row, doc_id, size (words), source_size,
    target (its source's, see water_fill), repeats, taken (size * repeats).

    A source with target / source_size = q takes each document floor(q) times and, for the fraction, those that come
    first in the order of a seeded hash of doc_id, as long as their sizes stay within fraction * source_size; the
    document that crosses it is taken if that comes nearer. The order is cut exactly: sizes are summed for ranges of
    the hash, and only the rows of the range in which the fraction ends, one in 4096, are ordered within their source.
    The same seed gives the same mix.

    Null or empty text: size 0. Null source: a source, the last. Null doc_id: hashed as such. Repeated rows of a
    doc_id share a hash and are taken together or not; sources without words have target 0. Empty input: no rows.
    """
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("_mix_size"))
    out = _with_repeats(d, weights, cap, seed)
    return out.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_mix_repeats").alias("repeats"), (F.col("_mix_size") * F.col("_mix_repeats")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as mix_sources repeats it; whole texts stay where they are read. Columns may have any names."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_mix_row")
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("_mix_size"), row)
    out = _with_repeats(d, weights, cap, seed).where("_mix_repeats > 0")
    return out.select("_mix_row", F.explode(F.sequence(F.lit(1), F.col("_mix_repeats")))).select("_mix_row.*")


def _with_repeats(docs: DataFrame, weights: tuple[int, ...], cap: int, seed: int) -> DataFrame:
    """docs has doc_id, source, _mix_size; adds _mix_total, _mix_target, _mix_repeats."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    docs = docs.withColumn("_mix_key", key).withColumn("_mix_range", F.conv(F.substring("_mix_key", 1, 3), 16, 10).cast("int"))
    sizes = scratch.write(docs.select(F.col("source").cast("string").alias("source"), F.col("_mix_size").alias("size"), F.col("_mix_key").alias("key"), F.col("_mix_range").alias("range")), "sizes")
    ranges = scratch.write(sizes.groupBy("source", "range").agg(F.sum("size").alias("s")), "ranges")
    targets = scratch.write(water_fill(ranges.groupBy("source").agg(F.sum("s").alias("source_size")), weights, cap), "targets")
    n = targets.count()
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    hint = F.broadcast if n <= BROADCAST_SOURCES else (lambda t: t)
    q = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("whole", F.floor(q).cast("int"))
    plan = plan.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("range")
    r = ranges.withColumn("to", F.sum("s").over(running)).alias("r").join(hint(plan).alias("p"), same("r", "p"))
    # Where the fraction ends: the first range whose sum goes beyond it, and what the ranges before leave of it.
    ends = r.where("to > part").groupBy("r.source").agg(F.min(F.struct("range", (F.col("part") - F.col("to") + F.col("s")).alias("rest"))).alias("e"))
    plan = plan.alias("p").join(ends.alias("e"), same("p", "e"), "left").select("p.*", F.coalesce("e.range", F.lit(RANGES)).alias("end"), F.col("e.rest").alias("rest"))
    plan = scratch.write(plan, "plan")
    last = sizes.alias("d").join(hint(plan).alias("p"), same("d", "p")).where("range = end").select("d.*", "rest")
    last = last.groupBy("source", "key").agg(F.sum("size").alias("s"), F.first("rest").alias("rest")).withColumn("to", F.sum("s").over(Window.partitionBy("source").orderBy("key")))
    nearer = (F.col("to") - F.col("s") < F.col("rest")) & (F.col("to") - F.col("rest") < F.col("rest") - F.col("to") + F.col("s"))
    chosen = scratch.write(last.where((F.col("to") <= F.col("rest")) | nearer).select(F.col("source").alias("_mix_s"), F.col("key").alias("_mix_k")), "chosen")
    small = F.broadcast if chosen.count() <= BROADCAST_SOURCES else (lambda t: t)
    plan = plan.select(F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_total"), F.col("target").alias("_mix_target"), F.col("whole").alias("_mix_whole"), F.col("end").alias("_mix_end"))
    source = F.col("source")
    out = docs.join(hint(plan), source.eqNullSafe(plan["_mix_source"]))
    out = out.join(small(chosen), (F.col("_mix_range") == F.col("_mix_end")) & source.eqNullSafe(chosen["_mix_s"]) & (F.col("_mix_key") == chosen["_mix_k"]), "left")
    extra = (F.col("_mix_range") < F.col("_mix_end")) | F.col("_mix_k").isNotNull()
    return out.withColumn("_mix_repeats", F.col("_mix_whole") + extra.cast("int"))
