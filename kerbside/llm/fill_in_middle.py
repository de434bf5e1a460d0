"""Operator 13: fill-in-the-middle arrangements of documents, and back, in DataFrame functions alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of a text: its lines. Whatever the pattern, its matches must cover the text.
LINES = r"[^\n]*\n|[^\n]+"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = LINES, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Each document cut in three at the bounds of units and rearranged: psm (prefix, suffix, middle) or spm.

    docs: columns doc_id, text; others are ignored. Returns a row for each row of docs: doc_id, n (units), form ('psm',
    'spm' or 'plain'), prefix, middle, suffix (null if plain), output.

    The cuts and the form follow from the hash of the seed and doc_id alone, so reruns and any order of rows agree, and
    rows of one doc_id are cut by the same numbers; a null doc_id is hashed as empty text. Of 100 documents rate are
    rearranged, of 100 of these spm as spm. Null texts count as empty; an empty text, and one that holds a mark (its
    parts could not be told apart again), stays plain. No documents give no rows.

    A row is made where it lies, from its own text: no shuffle, no Python.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring("key", 8 * k + 1, 8), 16, 10).cast("long")
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    d = d.withColumn("units", F.regexp_extract_all("text", F.lit(unit), F.lit(0))).withColumn("n", F.size("units").cast("long"))
    one, two = F.pmod(number(0), F.col("n") + 1), F.pmod(number(1), F.col("n") + 1)
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.col("text").contains(m)
    plain = (F.col("text") == "") | marked | (F.pmod(number(2), F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(number(3), F.lit(100)) < spm, "spm").otherwise("psm")
    d = d.select("doc_id", "text", "units", "n", form.alias("form"), F.least(one, two).cast("int").alias("a"), F.greatest(one, two).cast("int").alias("b"))
    piece = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    d = d.select(
        "doc_id", "text", "n", "form",
        piece(F.lit(1), F.col("a")).alias("prefix"), piece(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"), piece(F.col("b") + 1, F.col("n").cast("int") - F.col("b")).alias("suffix"),
    )
    p, s, m = (F.lit(x) for x in marks)
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("text"))
    return d.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of which fill_in_middle made output, from output and form alone: cut at the marks, each of which is in it once."""
    parts = F.split(output, "|".join(re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", m) for m in marks), 4)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def fim_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (code points, null if plain), output_sha256, restored_sha256 of each document."""
    d = fill_in_middle(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
