"""One file made by many tasks: pieces of bytes with their offsets, a data source that writes them, and packed archives."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from kerbside.plans.scratch import Scratch

#: Bytes of a piece, about.
PIECE = 4 << 20
#: Pieces: part (a task's), place and bytes in it; checksum and length of what the part's pieces were made from, so far.
PIECES = "part int, at long, size long, raw long, crc long, content binary"


def local_path(path: str) -> str | None:
    """The path of a file system that is mounted here, or None if it is of another kind."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


@dataclass
class Written(WriterCommitMessage):
    size: int = 0
    staged: list[tuple[int, str]] = field(default_factory=list)


class OneFile(DataSource):
    """format("onefile"): rows offset, content as one file of option size bytes, at path."""

    @classmethod
    def name(cls) -> str:
        return "onefile"

    def schema(self) -> str:
        return "offset long, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        path, size = self.options["path"], int(self.options["size"])
        mounted = local_path(path) if self.options.get("staged", "false") != "true" else None
        return StagedWriter(path, size) if mounted is None else InPlaceWriter(mounted, size)


class InPlaceWriter(DataSourceArrowWriter):
    """Tasks write their pieces at their offsets in one hidden file, which gets its name when all are there.

    For file systems mounted by driver and executors. An attempt that runs twice writes the same bytes to the same
    places; a failed job leaves no file.
    """

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        folder, name = os.path.split(path)
        self.hidden = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        os.makedirs(folder or ".", exist_ok=True)
        with open(self.hidden, "wb") as f:
            f.truncate(size)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = Written()
        with open(self.hidden, "r+b") as f:
            for b in iterator:
                for offset, content in zip(b.column("offset").to_pylist(), b.column("content")):
                    f.seek(offset)
                    done.size += f.write(content.as_buffer())
            f.flush()
            os.fsync(f.fileno())
        return done

    def commit(self, messages: list[Written | None]) -> None:
        written = sum(m.size for m in messages if m)
        if written != self.size or os.path.getsize(self.hidden) != self.size:
            self.abort(messages)
            raise OSError(f"{written} bytes were written for {self.path}, not {self.size}")
        os.replace(self.hidden, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.hidden):
            os.remove(self.hidden)


class StagedWriter(DataSourceArrowWriter):
    """For file systems without writes at an offset: an object for each piece, then one stream over them in order.

    The stream holds one piece at a time. An attempt that runs twice leaves objects that nobody names; the commit and
    the abort clear them all.
    """

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.stage = f"{path}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = fs.FileSystem.from_uri(self.stage)
        system.create_dir(at, recursive=True)
        done = Written()
        for b in iterator:
            for offset, content in zip(b.column("offset").to_pylist(), b.column("content")):
                name = f"{offset:020d}-{uuid.uuid4().hex}"
                with system.open_output_stream(f"{at}/{name}") as f:
                    f.write(content.as_buffer())
                done.size += len(content.as_buffer())
                done.staged.append((offset, name))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        written = sum(m.size for m in messages if m)
        if written != self.size:
            self.abort(messages)
            raise OSError(f"{written} bytes were written for {self.path}, not {self.size}")
        system, stage = fs.FileSystem.from_uri(self.stage)
        system.create_dir(stage, recursive=True)
        to = fs.FileSystem.from_uri(self.path)[1]
        with system.open_output_stream(f"{stage}/whole") as f:
            for _, name in sorted(p for m in messages if m for p in m.staged):
                with system.open_input_stream(f"{stage}/{name}") as piece:
                    while block := piece.read(PIECE):
                        f.write(block)
        system.move(f"{stage}/whole", to)
        system.delete_dir(stage)

    def abort(self, messages: list[Written | None]) -> None:
        system, stage = fs.FileSystem.from_uri(self.stage)
        if system.get_file_info(stage).type != fs.FileType.NotFound:
            system.delete_dir(stage)


def write_at(rows: DataFrame, path: str, size: int, staged: bool = False) -> None:
    """Rows offset, content, which cover size bytes without overlap, as the file at path; one that is there is replaced.

    staged: the way of file systems without writes at an offset, also where path is a mounted one (it must be a URI).
    """
    rows.sparkSession.dataSource.register(OneFile)
    rows.select("offset", "content").write.format("onefile").mode("overwrite").option("size", size).option("staged", str(staged).lower()).save(path)


def _pieces(blocks: Iterator[bytes], deflate: bool) -> Iterator[pa.RecordBatch]:
    part, at, raw, crc = TaskContext.get().partitionId(), 0, 0, 0
    for block in blocks:
        raw, crc = raw + len(block), zlib.crc32(block, crc)
        if deflate:
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            block = packer.compress(block) + packer.flush(zlib.Z_SYNC_FLUSH)  # ends at a byte, so that pieces can follow
        yield pa.record_batch([pa.array([part], pa.int32()), *(pa.array([v], pa.int64()) for v in (at, len(block), raw, crc)), pa.array([block], pa.binary())], names=["part", "at", "size", "raw", "crc", "content"])
        at += len(block)


def _text_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def blocks():
        held, size = [], 0
        for b in batches:
            lines = [v for v in b.column(0).to_pylist() if v is not None]
            if lines:
                held.append(("\n".join(lines) + "\n").encode())
                size += len(held[-1])
            if size >= PIECE:
                yield b"".join(held)
                held, size = [], 0
        if held:
            yield b"".join(held)

    return _pieces(blocks(), False)


def _placed(pieces: DataFrame, base: int) -> tuple[DataFrame, list]:
    """The pieces with offset (parts in their order, from base) and the parts: part, size, raw, crc. A part is a task's, so these are few."""
    spark = pieces.sparkSession
    parts = pieces.groupBy("part").agg(F.max(F.col("at") + F.col("size")).alias("size"), F.max("raw").alias("raw"), F.max_by("crc", "raw").alias("crc")).orderBy("part").collect()
    starts, at = [], base
    for p in parts:
        starts.append((p.part, at))
        at += p.size
    starts = spark.createDataFrame(starts, "part int, start long")
    return pieces.join(F.broadcast(starts), "part").withColumn("offset", F.col("start") + F.col("at")), parts


def write_lines(lines: DataFrame, path: str, staged: bool = False) -> None:
    """Column value of lines, in the order of its partitions and of rows in them, as one text file; each value ends with a line break. Nulls are left out; no rows make an empty file."""
    scratch = Scratch(lines.sparkSession)
    pieces = scratch.write(lines.select("value").mapInArrow(_text_pieces, PIECES), "pieces")
    rows, parts = _placed(pieces, 0)
    write_at(rows, path, sum(p.size for p in parts), staged)
    scratch.drop(pieces)


# Archives. The numbers of the records are fixed values of the zip format.
_BIG, _STORED, _DEFLATED = 0xFFFFFFFF, 0, 8
_END_OF_DEFLATE = b"\x03\x00"
_CRC32 = 0xEDB88320


def joined_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of two strings one after the other, by that of each and the size of the second."""

    def times(a: int, b: int) -> int:  # polynomials over two elements, the highest bit is the constant
        out = 0
        for k in range(31, -1, -1):
            out ^= b if a >> k & 1 else 0
            b = b >> 1 ^ (_CRC32 if b & 1 else 0)
        return out

    shift, power = 1 << 31, 1 << 23  # x ** 0 and x ** 8, a byte's shift
    while size:
        shift = times(shift, power) if size & 1 else shift
        power, size = times(power, power), size >> 1
    return times(shift, first) ^ second


def local_record(name: str, method: int, crc: int, packed: int, raw: int) -> bytes:
    key, big = name.encode(), max(packed, raw) >= _BIG
    extra = struct.pack("<HHQQ", 1, 16, raw, packed) if big else b""
    sizes = (_BIG, _BIG) if big else (packed, raw)
    return struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, method, 0, 33, crc, *sizes, len(key), len(extra)) + key + extra


def central_record(name: str, method: int, crc: int, packed: int, raw: int, offset: int) -> bytes:
    key = name.encode()
    big = max(packed, raw) >= _BIG
    wide = ([raw, packed] if big else []) + ([offset] if offset >= _BIG else [])
    extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
    sizes = (_BIG, _BIG) if big else (packed, raw)
    return struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if wide else 20, 0x800, method, 0, 33, crc, *sizes, len(key), len(extra), 0, 0, 0, 0, min(offset, _BIG)) + key + extra


def end_records(count: int, size: int, start: int) -> bytes:
    out = b""
    if count >= 0xFFFF or max(size, start) >= _BIG:
        out = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, start) + struct.pack("<IIQI", 0x07064B50, 0, start + size, 1)
    n = min(count, 0xFFFF)
    return out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, min(size, _BIG), min(start, _BIG), 0)


def _reader(path: str, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = (fs.LocalFileSystem(), local_path(path)) if local_path(path) else fs.FileSystem.from_uri(path)

        def blocks():
            with system.open_input_file(at) as f:
                for b in batches:
                    for k in b.column(0).to_pylist():
                        f.seek(k * piece)
                        yield f.read(piece)

        return _pieces(blocks(), True)

    return run


def _image_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        for name, content in zip(b.column("name").to_pylist(), b.column("content")):
            if name is None or not content.is_valid:
                continue
            data = content.as_buffer().to_pybytes()
            crc, raw = zlib.crc32(data), len(data)
            data = local_record(name, _STORED, crc, raw, raw) + data
            yield pa.record_batch([pa.array([part], pa.int32()), *(pa.array([v], pa.int64()) for v in (at, len(data), raw, crc)), pa.array([data], pa.binary()), pa.array([name])], names=["part", "at", "size", "raw", "crc", "content", "name"])
            at += len(data)


def _directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def blocks():
        for b in batches:
            if b.num_rows:
                yield b"".join(central_record(r["name"], _STORED, r["crc"], r["raw"], r["raw"], r["offset"]) for r in b.to_pylist())

    return _pieces(blocks(), False)


def write_archive(spark: SparkSession, files: list[tuple[str, str]], images: DataFrame | None, to: str, piece: int = PIECE, staged: bool = False) -> None:
    """A zip at to: files (name, path), each deflated by many tasks, then images (name, content), stored as they are.

    Tasks deflate pieces of a file that end at whole bytes, so they follow each other as one entry, whose checksum is
    joined from theirs; the driver sees lengths and checksums of tasks only. Rows without name or content are left out; a
    name that is there twice is two entries. Large archives and entries have the format's wide records.
    """
    scratch = Scratch(spark)
    small: list[tuple[int, bytes]] = []
    bodies: list[DataFrame] = []
    central, count, at = b"", 0, 0
    for name, path in files:
        system, where = (fs.LocalFileSystem(), local_path(path)) if local_path(path) else fs.FileSystem.from_uri(path)
        n = -(-(system.get_file_info(where).size or 0) // piece)
        tasks = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
        packed = scratch.write(spark.range(0, n, 1, tasks).mapInArrow(_reader(path, piece), PIECES), "deflated")
        _, parts = _placed(packed, 0)
        size, raw = sum(p.size for p in parts) + len(_END_OF_DEFLATE), sum(p.raw for p in parts)
        crc = reduce(lambda c, p: joined_crc(c, p.crc, p.raw), parts, 0)
        head = local_record(name, _DEFLATED, crc, size, raw)
        central += central_record(name, _DEFLATED, crc, size, raw, at)
        bodies.append(_placed(packed, at + len(head))[0])
        small += [(at, head), (at + len(head) + size - len(_END_OF_DEFLATE), _END_OF_DEFLATE)]
        count, at = count + 1, at + len(head) + size
    listed = None
    if images is not None:
        stored = scratch.write(images.select("name", "content").mapInArrow(_image_pieces, f"{PIECES}, name string"), "images")
        body, parts = _placed(stored, at)
        bodies.append(body)
        listed = scratch.write(body.select("name", "crc", "raw", "offset").mapInArrow(_directory, PIECES), "directory")
        count, at = count + stored.count(), at + sum(p.size for p in parts)
    start, size = at, len(central)
    small.append((at, central))
    if listed is not None:
        body, parts = _placed(listed, at + len(central))
        bodies.append(body)
        size += sum(p.size for p in parts)
    end = end_records(count, size, start)
    small.append((start + size, end))
    rows = spark.createDataFrame([(o, bytearray(b)) for o, b in small if b], "offset long, content binary")
    for b in bodies:
        rows = rows.union(b.select("offset", "content"))
    write_at(rows, to, start + size + len(end), staged)
