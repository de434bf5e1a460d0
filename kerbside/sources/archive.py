"""Frames in a zip archive as a Spark data source: tasks read the members they are given, nothing is unpacked elsewhere."""

from __future__ import annotations

import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kerbside.sources.listing import INCOMING

#: Packed bytes of a partition, about.
PART_BYTES = 32 << 20


@contextmanager
def _opened(path: str):
    """The archive at a path or URI of any file system that pyarrow reads; only what is asked for is fetched."""
    if "://" not in path:
        with zipfile.ZipFile(path) as z:
            yield z
        return
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        yield z


def members(path: str) -> list[tuple[str, int]]:
    """Name and packed bytes of each image, from the central directory alone; names that would leave a folder are refused."""
    out = []
    with _opened(path) as z:
        for m in z.infolist():
            parts = m.filename.replace("\\", "/").split("/")
            if m.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
                raise ValueError(f"unsafe path in archive: {m.filename}")
            if not m.is_dir() and m.filename.endswith(INCOMING):
                out.append((m.filename, m.compress_size))
    return sorted(out)


class Names(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class ZipFrames(DataSource):
    """format("zipframes"): path (name in the archive) and content of each image; option part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "zipframes"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


class ZipReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[Names]:
        out, held, size = [], [], 0
        for name, n in members(self.path):
            held.append(name)
            size += n
            if size >= self.part_bytes:
                out.append(Names(held))
                held, size = [], 0
        return [*out, Names(held)] if held or not out else out

    def read(self, partition: Names):
        if not partition.names:
            return
        with _opened(self.path) as z:
            for name in partition.names:
                yield name, z.read(name)


def zip_frames(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """path, content of the images of an archive that all tasks can reach. A lost task reads its members again; a name that is there twice counts twice with the later content, as zip readers do; no images give no rows."""
    members(path)
    spark.dataSource.register(ZipFrames)
    return spark.read.format("zipframes").option("part_bytes", part_bytes).load(path)
