"""Operator 6: legacy ARC archives to WARC, with revisit records for repeated payloads."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.plans.scratch import Scratch

#: Packed bytes at which a file ends, so that a file can be read in one piece; one record may be larger.
FILE_BYTES = 16 << 20
#: Bytes by which packed bytes are unpacked, and passed ones after which the buffer is cut.
CHUNK, PASSED = 1 << 16, 1 << 20
#: Times its size that deflate can unpack a byte to.
INFLATE = 1032
#: Repeated payloads whose digests are broadcast (about 60 bytes each); beyond it the join shuffles.
BROADCAST_DIGESTS = 300_000
# The field names of the two header versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 kerbside\n{FIELDS[version]}\n".encode()
    head = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    head += ["200", "-", "-", "0", name] if version == 2 else []
    return f"{' '.join(head)} {len(body)}\n".encode() + body


def arc_record(url: str, date: str, kind: str, block: bytes, version: int, name: str) -> bytes:
    head = ["".join(c if c > " " else f"%{ord(c):02X}" for c in url) or "-", "0.0.0.0", date, kind]
    head += ["200", "-", "-", "0", name] if version == 2 else []
    return f"{' '.join(head)} {len(block)}\n".encode() + block


class Record(NamedTuple):
    """A record of an ARC file; one with an error has nothing else."""

    url: str = ""
    ip: str = ""
    date: str = ""
    kind: str = ""
    block: bytes = b""
    error: str | None = None


class Reader:
    """Bytes that may be gzipped, in one member or many, unpacked as they are read. Broken members are passed over and counted.

    Reading moves a place in a buffer, so looking ahead and going back copy nothing; the buffer holds what was looked
    at, and lengths beyond what the bytes can unpack to aren't looked for.
    """

    def __init__(self, data: bytes):
        self.broken = 0
        self._held, self._at, self._left = bytearray(), 0, (INFLATE if data[:2] == b"\x1f\x8b" else 1) * len(data)
        self._more = self._members(data) if data[:2] == b"\x1f\x8b" else (data[k : k + CHUNK] for k in range(0, len(data), CHUNK))

    def _members(self, data: bytes) -> Iterator[bytes]:
        at = 0
        while (at := data.find(b"\x1f\x8b\x08", at)) >= 0:
            d, stop, tail = zlib.decompressobj(31), at, b""
            try:
                while not d.eof:
                    if not tail:
                        tail = data[stop : stop + CHUNK]
                        stop += len(tail)
                    ended = not tail
                    part = d.decompress(tail, CHUNK)
                    tail = d.unconsumed_tail
                    if part:
                        yield part
                    elif ended and not d.eof:
                        raise zlib.error("short member")
                at = stop - len(d.unused_data)
            except zlib.error:
                self.broken += 1
                at += 3

    def has(self, n: int) -> bool:
        """Whether n more bytes are there."""
        if n > self._left + len(self._held) - self._at:
            return False
        while len(self._held) - self._at < n:
            part = next(self._more, None)
            if part is None:
                return False
            if self._at > PASSED:
                del self._held[: self._at]
                self._at = 0
            self._held += part
        return True

    def peek(self, n: int, after: int = 0) -> bytes:
        """Up to n bytes beyond the next ones; fewer at the end."""
        self.has(after + n)
        return bytes(self._held[self._at + after : self._at + after + n])

    def read(self, n: int) -> bytes:
        """Up to n bytes; fewer at the end."""
        out = self.peek(n)
        self._at += len(out)
        return out

    def line(self) -> bytes:
        """Up to a line end, which is included, or the end."""
        seen = 0
        while (cut := self._held.find(b"\n", self._at + seen)) < 0:
            seen = len(self._held) - self._at
            if not self.has(seen + 1):
                break
        return self.read(cut + 1 - self._at if cut >= 0 else seen)

    def back(self, data: bytes) -> None:
        """Back to before data, which were the last bytes read."""
        self._at -= len(data)


def number(text: str | None) -> int | None:
    """An integer of 64 bits in ASCII digits, else None."""
    n = int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text, re.A) else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


_IP, _DATE = re.compile(r"[0-9.]+|[0-9A-Fa-f:]+"), re.compile(r"[0-9]{4,14}")


def _arc_head(line: bytes, fields: list[str]) -> dict[str, str] | None:
    """Values of a header line by field, or None if it is none. A URL with spaces takes the values that are too many."""
    values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
    first = values[0].startswith("filedesc://")
    if not line.endswith(b"\n") or (number(values[-1]) or 0) < 0 or number(values[-1]) is None or (not first and len(values) < len(fields)):
        return None
    if first:
        return {"URL": values[0], "Archive-date": values[2] if len(values) > 2 else "", "Archive-length": values[-1]}
    more = len(values) - len(fields)
    head = dict(zip(fields, [" ".join(values[: more + 1]), *values[more + 1 :]]))
    return head if _IP.fullmatch(head["IP-address"]) and _DATE.fullmatch(head["Archive-date"]) else None


def parse_arc(data: bytes) -> Iterator[Record]:
    """The records of an ARC file, version blocks (filedesc://) among them.

    The version block names the fields; each header line has the values. Declared lengths decide where records end, and
    a line end must follow. Where a line is no header, or a record doesn't end where it says, the reading goes on at the
    next header line, inside the record too, and one record with an error stands for what was lost. So does one for
    a record that the end of the file cuts short and for broken gzip members.
    """
    r, fields, lost = Reader(data), FIELDS[1].split(), False
    while line := r.line():
        if not line.strip(b"\r\n"):
            continue
        head = _arc_head(line, fields)
        if head is None:
            if not lost:
                yield Record(error="no header")
            lost = True
            continue
        length = int(head["Archive-length"])
        if not r.has(length) or r.peek(1, length) not in (b"", b"\n", b"\r"):
            yield Record(error="wrong length" if r.has(length) else "short record")
            lost = True
            continue
        block, lost = r.read(length), False
        if line.startswith(b"filedesc://"):
            lines = block.decode("utf-8", "replace").split("\n")
            if len(lines) > 1 and lines[1].startswith("URL "):
                fields = lines[1].strip().split(" ")
        yield Record(head["URL"], head.get("IP-address", ""), head["Archive-date"], head.get("Content-type", "text/plain"), block)
    for _ in range(r.broken):
        yield Record(error="broken member")


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, header bytes and body of an HTTP response; a block that is none is a body."""
    cut = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    if cut < 0:
        return {}, b"", block
    head = block[: cut + 4]
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}, head, block[cut + 4 :]


def record_uuid(page: str, digest: str) -> str:
    h = hashlib.md5(f"{page}:{digest}".encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def _uuid_column(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat(page, F.lit(":"), digest).cast("binary"))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))


def warc_head(kind: str, uuid: str, url: str, ip: str, date: str, payload_digest: str, block: bytes, content: str = "application/http; msgtype=response", info: str = "") -> bytes:
    """Named fields of a record up to its Content-Length; an ARC date of 14 digits becomes an ISO time, shorter ones are filled up."""
    d = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() else "19700101000000"
    when = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    lines = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid}>", f"WARC-Date: {when}"]
    if kind == "warcinfo":
        lines.append(f"WARC-Filename: {url}")
    else:
        lines += [f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    lines.append(f"WARC-Block-Digest: sha1:{base32_sha1(block)}")
    if info:
        lines.append(f"WARC-Warcinfo-ID: <urn:uuid:{info}>")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record by its declared length.

    Where a record doesn't begin, has no length, or doesn't end where it says, the reading goes on at the next line
    that begins a record; one pair of fields {"error": reason} stands for what was lost.
    """
    r, lost = Reader(data), False
    while line := r.line():
        if not line.strip(b"\r\n"):
            continue
        fields: dict[str, str] = {}
        if line.startswith(b"WARC/1."):
            held = [line]
            while (x := r.line()).strip(b"\r\n"):
                held.append(x)
                if x.startswith(b"WARC/1."):
                    r.back(x)
                    break
                k, _, v = x.decode("utf-8", "replace").partition(":")
                fields[k.strip().lower()] = v.strip()
        length = number(fields.get("content-length"))
        if length is None or length < 0 or "warc-type" not in fields:
            if not lost:
                yield {"error": "no header"}, b""
            lost = True
            continue
        if not r.has(length) or r.peek(4, length) not in (b"", b"\r\n\r\n"):
            yield {"error": "wrong length" if r.has(length) else "short record"}, b""
            lost = True
            continue
        lost = False
        yield fields, r.read(length)
    for _ in range(r.broken):
        yield {"error": "broken member"}, b""


def member(data: bytes) -> bytes:
    """A gzip member whose last byte is 0 (it is the high byte of the length); one of 16 MB or more is followed by an empty one."""
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return out if out[-1] == 0 else out + zlib.compressobj(1, zlib.DEFLATED, 31).flush()


class Packer:
    """Members to whole files of FILE_BYTES, about."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, record: bytes) -> None:
        self.held.append(member(record))
        self.size += len(self.held[-1])

    def file(self) -> pa.RecordBatch:
        """The file so far, without its last byte, which the writer sets."""
        data, self.held, self.size = b"".join(self.held)[:-1], [], 0
        return pa.record_batch([pa.array([data], pa.binary())], names=["value"])


def _write(files: DataFrame, path: str) -> None:
    """A file for each value: Spark's text files hold any bytes, and the end of a line is the zero that ends a member."""
    files.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def write_arc(pages: DataFrame, path: str, date: str = "20260101000000") -> None:
    """Pages as HTTP responses in gzipped ARC files of FILE_BYTES, a member a record, by turns of version 1 and 2; page_id goes in a header."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))

    def run(batches):
        pack, n = Packer(), 0
        for b in batches:
            for page, url, html in zip(*(b.column(c) for c in range(3))):
                page, url, html = page.as_py(), url.as_py(), html.as_py()
                version = 1 + n % 2
                file = f"{n}.arc"
                if not pack.held:
                    pack.add(version_block(file, version, date) + b"\n")
                name = "" if page is None else f"X-Page-Id: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{name}Content-Length: {len(html)}\r\n\r\n"
                pack.add(arc_record(url, date, "text/html", head.encode() + html, version, file) + b"\n")
                if pack.size >= FILE_BYTES:
                    yield pack.file()
                    n += 1
        if pack.held:
            yield pack.file()

    _write(p.mapInArrow(run, "value binary"), path)


def convert_arc(spark: SparkSession, arc: str, warc: str, least_bytes: int = 0) -> dict[str, int]:
    """ARC files at arc to WARC files at warc; returns how often which error was met.

    A version block becomes a warcinfo record, which the records of its file name; an HTTP response a response; any other
    record (dns lookups, files) a resource of its own content type. Identifiers are derived from page and payload
    digest, times from the ARC date, digests from the bytes. Of responses with equal payloads of at least least_bytes
    bytes, the one of the largest page id becomes a response, the others revisits that refer to it and keep their HTTP
    header. Digests are grouped with a partial maximum; payloads aren't moved unless more than BROADCAST_DIGESTS
    digests repeat. A task holds one packed file and one record; foreign files must fit Spark's binary files (2 GB).
    """

    def index(batches):
        for b in batches:
            for data in b.column(0):
                rows = []
                for r in parse_arc(data.as_py()):
                    fields, head, body = http_parts(r.block)
                    if r.error or (head and len(body) >= least_bytes):
                        rows.append((number(fields.get("x-page-id")), None if r.error else base32_sha1(body), r.error))
                kinds = (("page", pa.int64()), ("digest", pa.string()), ("error", pa.string()))
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    scratch = Scratch(spark)
    seen = scratch.write(_files(spark, arc).mapInArrow(index, "page long, digest string, error string"), "index")
    errors = {r.error: r["count"] for r in seen.where("error IS NOT NULL").groupBy("error").count().collect()}
    found = seen.where("error IS NULL").groupBy("digest").agg(F.max("page").alias("keeper"), F.count("*").alias("n"))
    found = scratch.write(found.where("n > 1 AND keeper IS NOT NULL").select("digest", "keeper"), "digests")
    hint = F.broadcast if found.count() <= BROADCAST_DIGESTS else (lambda t: t)
    kinds = (("page", pa.int64()), ("digest", pa.string()), ("response", pa.binary()), ("revisit", pa.binary()), ("rest", pa.binary()))

    def batch(rows):
        return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

    def convert(batches):
        for b in batches:
            for data in b.column(0):
                rows, held, info = [], 0, ""
                for r in parse_arc(data.as_py()):
                    if r.error:
                        continue
                    fields, head, body = http_parts(r.block)
                    page, digest = fields.get("x-page-id"), base32_sha1(body)
                    if r.url.startswith("filedesc://"):
                        info = record_uuid(r.url, digest)
                        about = b"software: kerbside\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC\r\n" + b"".join(b"arc-header: " + x.rstrip(b"\r") + b"\r\n" for x in r.block.split(b"\n") if x.strip())
                        rows.append((None, None, warc_head("warcinfo", info, r.url.removeprefix("filedesc://"), "", r.date, "", about, "application/warc-fields") + b"\r\n" + about, None, None))
                    elif head:
                        uuid = record_uuid(page or "", digest)
                        key = digest if len(body) >= least_bytes else None
                        common = (uuid, r.url, r.ip, r.date, digest)
                        rows.append((number(page), key, warc_head("response", *common, r.block, info=info) + b"\r\n" + r.block, warc_head("revisit", *common, head, info=info), b"\r\n" + head))
                    else:
                        rows.append((None, None, warc_head("resource", record_uuid(r.url + r.date, digest), r.url, r.ip, r.date, digest, r.block, r.kind, info) + b"\r\n" + r.block, None, None))
                    held += len(r.block)
                    if held > 8_000_000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    def pack(batches):
        p = Packer()
        for b in batches:
            for value in b.column(0):
                p.add(value.as_py() + b"\r\n\r\n")
                if p.size >= FILE_BYTES:
                    yield p.file()
        if p.held:
            yield p.file()

    rows = _files(spark, arc).mapInArrow(convert, "page long, digest string, response binary, revisit binary, rest binary")
    rows = rows.join(hint(found), "digest", "left")
    refers = F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), _uuid_column(F.col("keeper").cast("string"), F.col("digest")), F.lit(">\r\n")).cast("binary")
    first = F.col("keeper").isNull() | F.col("page").eqNullSafe(F.col("keeper"))
    value = F.when(first, F.col("response")).otherwise(F.concat("revisit", refers, "rest"))
    _write(rows.select(value.alias("value")).mapInArrow(pack, "value binary"), warc)
    return errors


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files but warcinfo: record_id, record_type, refers (record id), page_id, payload_bytes, payload_digest, error.

    A response's or resource's size and digest are taken from its bytes, a revisit's from its headers; what a header lacks,
    or has no number for, is null. A row with an
    error stands for bytes that couldn't be read as records.
    """

    def run(batches):
        kinds = (("record_id", pa.string()), ("record_type", pa.string()), ("refers", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string()))
        for b in batches:
            for data in b.column(0):
                rows = []
                for fields, block in parse_warc(data.as_py()):
                    if "error" in fields or fields["warc-type"] == "warcinfo":
                        rows += [(None,) * 6 + (fields["error"],)] if "error" in fields else []
                        continue
                    http, _, body = http_parts(block)
                    whole = fields["warc-type"] != "revisit"
                    size = len(body) if whole else number(http.get("content-length"))
                    digest = base32_sha1(body) if whole else fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    rows.append((fields.get("warc-record-id"), fields["warc-type"], fields.get("warc-refers-to"), number(http.get("x-page-id")), size, digest, None))
                cols = zip(*rows) if rows else [[]] * len(kinds)
                yield pa.record_batch([pa.array(list(c), t) for c, (_, t) in zip(cols, kinds)], names=[n for n, _ in kinds])

    return _files(spark, path).mapInArrow(run, "record_id string, record_type string, refers string, page_id long, payload_bytes long, payload_digest string, error string")


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages through ARC files and the converter to WARC files, and what these hold.

    pages: columns page_id, url, html; others are ignored. Returns, for each row, page_id, payload_bytes,
    payload_digest (base32 SHA-1), record_type, refers_to (page_id of the response of a revisit).

    Null html: empty payload. Null url: "-". Null page_id: no id in the archive, null in the result; it revisits a
    record with one. Rows that repeat the largest page_id of a payload are responses each. Empty input: no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    arc, warc = scratch.path("arc"), scratch.path("warc")
    write_arc(pages, arc)
    errors = convert_arc(spark, arc, warc, least_bytes)
    read = scratch.write(read_warc(spark, warc), "records")
    if errors or read.where("error IS NOT NULL").limit(1).count():
        raise RuntimeError(f"archives can't be read back: {errors or 'WARC'}")
    scratch.drop_path(arc)
    kept = read.where("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to")).dropDuplicates(["refers"])
    return read.join(kept, "refers", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
