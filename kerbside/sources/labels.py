"""Detector label files: class cx cy w h [confidence], one box a line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions.media import stem


def parsed(files: DataFrame) -> DataFrame:
    """files (value: whole text; other columns are kept) -> a row for each line of five numbers or more.

    Adds line_no, class_id, cx, cy, w, h, confidence (0.0 where the line has five numbers). Lines with fewer words or
    with words that aren't numbers are passed over.
    """
    f = files.select(*(c for c in files.columns if c != "value"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    f = f.withColumn("p", F.split(F.btrim("line", F.lit(" \t\r\f")), r"\s+")).where(F.size("p") >= 5)
    number = lambda i: F.get("p", F.lit(i)).try_cast("double")
    sixth = F.when(F.size("p") > 5, number(5)).otherwise(F.lit(0.0))
    whole = F.when(F.get("p", F.lit(0)).rlike(r"^[+-]?\d+$"), F.get("p", F.lit(0)).try_cast("int"))
    f = f.withColumns({"class_id": whole, "cx": number(1), "cy": number(2), "w": number(3), "h": number(4), "confidence": sixth})
    return f.dropna(subset=["class_id", "cx", "cy", "w", "h", "confidence"]).drop("p", "line")


def label_files(spark: SparkSession, path: str, name: Callable[[Column], Column] = stem) -> DataFrame:
    """Boxes of all .txt files below path, with stem, the name that joins them to frames: name() of the file's path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return parsed(files.select(name(F.col("_metadata.file_path")).alias("stem"), "value"))
