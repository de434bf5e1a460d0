"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.plans.scratch import Scratch

#: Characters of a sample altogether; a text of more than a hundredth of that isn't learnt from.
LIMIT_CHARS = 64_000_000


def remainder(mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; null doc_id as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, limit: int, scratch: Scratch, limit_chars: int = LIMIT_CHARS) -> DataFrame:
    """doc_id, text, label of labelled rows for which train holds, as a written table: at most limit rows of at most limit_chars characters altogether, those with the smallest hash of doc_id.

    Labels other than 0 and 1 are left out; a doc_id labelled twice counts with the smaller label. Null texts are
    empty. Longer texts than a hundredth of limit_chars are left out, so one can't take the place of many.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").where(train)
    ids = ids.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = scratch.write(text.join(F.broadcast(ids), "doc_id").where(F.length("text") <= limit_chars // 100), "sample")  # limit bounds the table
    order = F.xxhash64("doc_id")
    lengths = rows.groupBy(order.alias("h")).agg(F.sum(F.length("text")).alias("chars")).collect()  # limit rows at most, two numbers each
    total, last = 0, None
    for r in sorted(lengths, key=lambda r: r.h):
        total += r.chars
        if total > limit_chars:
            return rows.where(F.lit(False) if last is None else order <= last)
        last = r.h
    return rows
