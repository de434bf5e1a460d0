"""Operator 12: exact copies by sorting contents: sampled splitters, external sorts, comparisons of neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.ngram_jaccard import small_enough
from kerbside.plans.scratch import Scratch, free_name, with_row_key

#: Bytes of a text that splitters hold; texts alike so far are told apart by a hash of all their bytes, then in full.
HEAD = 64
#: Rows that a task gives back at once.
ROWS = 8192
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("first", pa.bool_()), ("sha", pa.string()), ("edge", pa.int64()), ("text", pa.binary())])
_COLUMNS = "doc_id long, row long, keep_id long, group_size long, first boolean, sha string, edge long, text binary"


def content_groups(docs: DataFrame, largest: bool = True, normalised: Callable[[Column], Column] | None = None, row: str | None = None) -> DataFrame:
    """Which documents have equal texts, and which of them stays.

    docs: columns doc_id, text; others are ignored. Texts are compared as they are, or as normalised (a function of a
    column) makes them. Returns a row for each row of docs: doc_id, keep_id (largest or smallest doc_id of the rows with
    that text), group_size, kept (true for one row of each text), text_sha256 (of the normalised text in UTF-8), and the
    column row, if one is named. Null texts count as empty, and empty texts equal each other. A null doc_id comes after
    all others; of rows that share the doc_id to be kept, one stays. No documents give no rows.

    Texts are dealt to ranges of their bytes: splitters are sampled from their first HEAD bytes, a hash of all bytes
    and the row's place, so what is sampled is bounded, and copies by the million are spread over many ranges. Each
    range is sorted by Spark, which spills what memory can't hold; then equal texts lie side by side, and each is
    compared in full with the one before. A task holds the numbers of one text's rows, never more than its range has.
    Where a text goes on in the next range, its parts, one for each range, meet by their whole texts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    text = (normalised(text) if normalised else text).cast("binary")
    key = F.col(f"`{row}`").cast("long") if row else F.lit(None).cast("long")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("row"), text.alias("text"))
    d = d.select("*", F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("place"))
    best = F.col("doc_id").desc_nulls_last() if largest else F.col("doc_id").asc_nulls_last()
    d = d.repartitionByRange("head", "digest", "place").sortWithinPartitions("head", "digest", "text", best, F.col("row").asc_nulls_last())
    runs = scratch.write(d.select("doc_id", "row", "text", "digest").mapInArrow(_runs, _COLUMNS), "runs")
    named = lambda t, kept: t.select("doc_id", *([F.col("row").alias(row)] if row else []), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
    inner = named(runs.where("edge IS NULL"), F.col("first"))

    parts = runs.where("text IS NOT NULL").select("edge", "text", "keep_id", "group_size")
    rank = F.struct(F.col("keep_id").isNull(), (-F.col("keep_id") if largest else F.col("keep_id")), "edge")
    whole = parts.groupBy("text").agg(F.sum("group_size").alias("group_size"), (F.max if largest else F.min)("keep_id").alias("keep_id"), F.min_by("edge", rank).alias("winner"), F.collect_list("edge").alias("edges"))
    whole = scratch.write(whole.select(F.explode("edges").alias("edge"), "group_size", "keep_id", "winner"), "parts")
    outer = runs.where("edge IS NOT NULL").drop("group_size", "keep_id", "text").join(small_enough(whole, whole.count()), "edge")
    return inner.unionByName(named(outer, F.col("first") & (F.col("edge") == F.col("winner"))))


def deduplicated(docs: DataFrame, largest: bool = True, normalised: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs, read from files, without the rows whose text another row keeps; all columns stay. See content_groups."""
    row = free_name("row", docs.columns)
    rows = with_row_key(docs, row)
    kept = Scratch(docs.sparkSession).write(content_groups(rows, largest, normalised, row).where("kept").select(row), "kept")
    return rows.join(small_enough(kept, kept.count()), row, "left_semi").select(*(rows[f"`{c}`"] for c in docs.columns))


def _runs(batches):
    """Rows of one sorted range with what their text's rows in this range add up to.

    edge: number of the run where its text may go on in another range, that is, where its hash is the first or the last
    of this one; the run's first row has the text then.
    """
    prefix = TaskContext.get().partitionId() << 33
    made = 0
    group: list[tuple[bytes, list, list]] = []  # runs of the hash at hand: text, doc_ids, rows
    digest, first = None, True
    out: list[tuple] = []

    def flush(edge: bool):
        nonlocal made
        for text, ids, rows in group:
            sha, number = hashlib.sha256(text).hexdigest(), prefix + made if edge else None
            made += 1
            out.extend((i, r, ids[0], len(ids), k == 0, sha, number, text if edge and k == 0 else None) for k, (i, r) in enumerate(zip(ids, rows)))
        group.clear()

    def batch():
        b = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), _SCHEMA.types)], schema=_SCHEMA)
        out.clear()
        return b

    for b in batches:
        if not b.num_rows:
            continue
        ids, rows, texts, hashes = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()
        new = np.ones(b.num_rows, bool)
        new[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        new[0] = not group or hashes[0] != digest or texts[0].as_py() != group[-1][0]
        starts = np.flatnonzero(new).tolist()
        if not new[0]:
            end = starts[0] if starts else b.num_rows
            group[-1][1].extend(ids[:end])
            group[-1][2].extend(rows[:end])
        for a, e in zip(starts, [*starts[1:], b.num_rows]):
            if group and hashes[a] != digest:
                flush(first)
                first = False
            digest = hashes[a]
            group.append((texts[a].as_py(), ids[a:e], rows[a:e]))
            if len(out) >= ROWS:
                yield batch()
    flush(True)
    if out:
        yield batch()
