"""Connected components as DataFrame steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.plans.scratch import Scratch
from kerbside.plans.skew import join_groups

#: Edges that a task contracts at once.
CHUNK = 500_000


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Labels the nodes of an undirected graph with the smallest node of their component.

    edges: columns a, b of one orderable type; direction, repeats and loops don't matter, nulls are left out.
    Returns node, component for each node that has an edge to another node. No edges: no rows.

    Each task first contracts the edges that it holds, a chunk at a time, to stars. Then the two star contractions of
    Kiveris et al. (2014) alternate: each node's larger neighbours, then its smaller ones, are hung below its smallest
    neighbour. Minima are aggregated before they are shuffled, and those of hubs broadcast. Each round is written to
    the shared folder; it stops when a round changes nothing, and fails if max_rounds didn't get there. Once a chunk
    holds all edges that are left, one task contracts them.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    e = scratch.write(e.mapInArrow(_stars, e.schema), "cc")
    before = _digest(e)
    if not before[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        if before[0] <= CHUNK:
            e = scratch.write(e.coalesce(1).mapInArrow(_stars, e.schema), "cc")
            break
        both = e.union(e.select("b", "a"))
        low = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("c")), "low")
        large = scratch.write(join_groups(both, low, "a", "c", 2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("s"))
        new = scratch.write(small.select(F.col("s.a").alias("a"), F.col("s.m").alias("b")).where("a <> b").distinct(), "cc")
        after = _digest(new)
        scratch.drop(e, low, large)
        e = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components aren't settled after {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _stars(batches):
    """Edges of the same components, from each node of a chunk to its smallest one."""
    names, held = None, []

    def contracted():
        parent: dict = {}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for b in held:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parent.setdefault(x, x), parent.setdefault(y, y)
                r, s = root(x), root(y)
                if r != s:
                    parent[max(r, s)] = min(r, s)
        pairs = [(x, root(x)) for x in parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        kind = held[0].schema.field(0).type
        return pa.record_batch([pa.array([x for x, _ in pairs], kind), pa.array([r for _, r in pairs], kind)], names=names)

    for b in batches:
        names = b.schema.names
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield contracted()
            held = []
    if held:
        yield contracted()


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF)), F.bit_xor(F.xxhash64("a", "b"))).first())
