"""A pipeline over documents: quality, near copies, benchmark passages, mix, token ids.

Decisions are of rows, not of doc_id: each of the first three stages numbers the rows of its input files
(scratch.with_row_key), lets the operator decide with that number as the id, and keeps the rows that it keeps. So rows
without doc_id, and rows that share one, are each judged by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.decontamination import contaminated
from kerbside.llm.mixing import mixed_documents
from kerbside.llm.ngram_jaccard import ngram_components, small_enough
from kerbside.llm.quality_rules import quality_rules
from kerbside.llm.token_output import token_index
from kerbside.plans.scratch import Scratch, free_name, with_row_key

#: SQL can't express the outlier estimates and the tokenizer.
ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """docs with its row numbers in a column that docs lacks, doc_id and text with these in place of doc_id, and the column's name."""
    row = free_name("_row", docs.columns)
    rows = with_row_key(docs, row)
    return rows, rows.select(F.col(row).alias("doc_id"), *(c for c in ("text", "lang", "source") if c in docs.columns)), row


def _kept(docs: DataFrame, rows: DataFrame, row: str, ids: DataFrame) -> DataFrame:
    """Rows whose number is in ids (column id), with the columns of docs."""
    ids = Scratch(docs.sparkSession).write(ids, "kept")
    return rows.join(small_enough(ids.withColumnRenamed("id", row), ids.count()), row, "left_semi").select(*(rows[f"`{c}`"] for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that the quality rules reject, null texts among them. Empty documents: no rows."""
    rows, named, row = _numbered(docs)
    return _kept(docs, rows, row, quality_rules(named).where("kept").select(F.col("doc_id").alias("id")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component the row of the smallest doc_id (null last), of several the first; rows without words stay, as they are like nothing. Empty documents: no rows."""
    rows, named, row = _numbered(docs)
    found = ngram_components(named).select(F.col("doc_id").alias("id"), "component_id")
    ids = rows.select(F.col(row).alias("id"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("id")).alias("rank"))
    first = found.join(ids, "id").groupBy("component_id").agg(F.min("rank").alias("rank"))
    return _kept(docs, rows, row, first.select("rank.id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark item. Null texts hold none. Empty documents: no rows; empty benchmark: all."""
    rows, named, row = _numbered(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = Scratch(spark).write(contaminated(named, benchmark).select(F.col("doc_id").alias(row)).distinct(), "leaks")
    return rows.join(small_enough(found, found.count()), row, "left_anti").select(*(rows[f"`{c}`"] for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples rows so that sources come near their targets; rows of one doc_id, or without any, are taken alike within a source."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token ids and returns where each row's lie; null texts have the end id alone, rows without doc_id come first."""
    import public_tokenizers

    return token_index(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each written as Parquet and reread."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
