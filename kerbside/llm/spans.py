"""Spans of whole texts: from tasks as (kind, start, end), to the digest and list that queries return."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:int,start:long,end:long>>"


def joined(spans: Column, kinds: tuple[str, ...], by_kind: bool) -> Column:
    """kind:start:end, comma-joined; by kind as listed, then start, or by start, then kind."""
    names = F.array(*(F.lit(k) for k in kinds))
    if by_kind:
        ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["kind"].alias("a"), s["start"].alias("b"), s["end"].alias("e"))))
        text = F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["a"]), s["b"].cast("string"), s["e"].cast("string")))
    else:
        ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["kind"].alias("b"), s["end"].alias("e"))))
        text = F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["b"]), s["a"].cast("string"), s["e"].cast("string")))
    return F.array_join(text, ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(spans: Column, kinds: tuple[str, ...], by_kind: bool) -> Column:
    return F.sha2(joined(spans, kinds, by_kind).cast("binary"), 256)


class Cover:
    """Which stretches of a text spans (kind, start, end) touch, each asked for in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in ordered]
        self.reach = list(accumulate((b for _, b in ordered), max))

    def touches(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start
