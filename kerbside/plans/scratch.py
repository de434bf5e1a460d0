"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one of this session if all tasks run on this machine (local master), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kerbside-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def compiled_methods(spark: SparkSession):
    """A context in which Spark doesn't fuse steps to methods of more than 8,000 bytes of code, as the JVM interprets those instead of compiling them, and in which rows that are sorted by their group are grouped as they come, not hashed and sorted again."""
    limit, as_sorted = "spark.sql.codegen.hugeMethodLimit", "spark.sql.execution.replaceHashWithSortAgg"
    before = {name: spark.conf.get(name) for name in (limit, as_sorted)}
    spark.conf.set(limit, min(int(before[limit]), 8000))
    spark.conf.set(as_sorted, True)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class Scratch:
    """Tables that cut lineage: each is written once as Parquet to the shared folder and read back.

    A lost executor costs nothing that was written. drop() deletes a table that no later plan reads; the rest go
    when the driver's process ends, as returned DataFrames may still read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kerbside-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with compiled_methods(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kerbside_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.drop_path(t._kerbside_path)

    def drop_path(self, path: str) -> None:
        self._delete(path)

    def _delete(self, path: str) -> None:
        try:
            jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
            if jvm is None or jsc is None:
                return
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: the folder's owner clears it
            return


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many underscores before it as set it apart from the names that are taken, in either case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def with_row_key(table: DataFrame, name: str = "_row") -> DataFrame:
    """table, read from files, with a number of its own for each row: place of the file by path, and of the row in it.

    The same files give the same numbers. name must be none of the table's columns (see free_name), which may have any
    names otherwise. Only the list of files is ordered in one task.
    """
    from pyspark.sql import Window

    file, index, place = (free_name(c, [*table.columns, name]) for c in ("_file", "_index", "_place"))
    meta = table.metadataColumn("_metadata")
    files = table.select(meta["file_path"].alias(file)).distinct()
    files = files.select(file, (F.row_number().over(Window.orderBy(file)) - 1).cast("long").alias(place))
    rows = table.select("*", meta["file_path"].alias(file), meta["row_index"].alias(index))
    return rows.join(F.broadcast(files), file).select(*(rows[f"`{c}`"] for c in table.columns), (F.shiftleft(place, 36) + F.col(index)).alias(name))
