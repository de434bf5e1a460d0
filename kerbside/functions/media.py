"""Times, frame rates, crops and file names, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBE = "struct<streams:array<struct<codec_type:string,r_frame_rate:string,tags:map<string,string>>>,format:struct<tags:map<string,string>>>"


def video_fps(probe_json: Column, default: float = 30.0) -> Column:
    """Frame rate a/b of the first video stream; default where there is none or b is 0."""
    video = F.get(F.filter(F.from_json(probe_json, PROBE)["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    rate = F.split(video["r_frame_rate"], "/")
    a, b = F.get(rate, F.lit(0)).try_cast("double"), F.get(rate, F.lit(1)).try_cast("double")
    return F.coalesce(F.when(b != 0, a / b), F.lit(default))


def video_rotation(probe_json: Column) -> Column:
    """tags.rotate of the first video stream, 0 by default."""
    video = F.get(F.filter(F.from_json(probe_json, PROBE)["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    return F.coalesce(video["tags"]["rotate"].try_cast("int"), F.lit(0))


def video_start(probe_json: Column) -> Column:
    """First of the tags creation_time, date, com.apple.quicktime.creationdate, as a time; null if it is none."""
    tags = F.from_json(probe_json, PROBE)["format"]["tags"]
    return F.coalesce(*(F.nullif(tags[k], F.lit("")) for k in ("creation_time", "date", "com.apple.quicktime.creationdate"))).try_cast("timestamp")


def exif_time(original: Column, changed: Column) -> Column:
    """DateTimeOriginal, else DateTime, in the form YYYY:MM:DD HH:MM:SS."""
    return F.try_to_timestamp(F.coalesce(F.nullif(original, F.lit("")), F.nullif(changed, F.lit(""))), F.lit("yyyy:MM:dd HH:mm:ss"))


def frame_number(index: Column, fps: Column, interval_s: Column) -> Column:
    return index * F.greatest((fps * interval_s).cast("int"), F.lit(1))


def offset_seconds(index: Column, interval_s: Column) -> Column:
    return F.round(index * interval_s, 2)


def crop_rect(cx: Column, cy: Column, w: Column, h: Column, image_w: Column, image_h: Column, pad: float = 0.75, least_w: float = 0.45, least_h: float = 0.55) -> Column:
    """Struct x0, y0, x1, y1 in pixels: the box and a margin, at least a share of the image, cut off at its edges; null if nothing is left."""

    def side(c: Column, s: Column, image: Column, least: float) -> tuple[Column, Column]:
        c, s = c * image, s * image
        margin = F.when(s + 2 * s * pad < image * least, (image * least - s) / 2.0).otherwise(s * pad)
        return F.greatest(F.lit(0), (c - s / 2 - margin).cast("int")), F.least(image.cast("int"), (c + s / 2 + margin).cast("int"))

    (x0, x1), (y0, y1) = side(cx, w, image_w, least_w), side(cy, h, image_h, least_h)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def crop_name(frame_num: Column, index: Column) -> Column:
    text = lambda c, n: F.lpad(c.cast("string"), n, "0")
    short = frame_num.between(0, 999_999) & index.between(0, 99)
    return F.when(short, F.concat(F.lit("frame_"), text(frame_num, 6), F.lit("_det_"), text(index, 2), F.lit(".jpg"))).otherwise(F.format_string("frame_%06d_det_%02d.jpg", frame_num, index))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def image_size(content: bytes | None) -> tuple[int, int] | None:
    """Width and height by the header of a PNG or JPEG; None for other bytes and broken headers."""
    if not content:
        return None
    if content[:8] == b"\x89PNG\r\n\x1a\n" and content[12:16] == b"IHDR" and len(content) >= 24:
        return int.from_bytes(content[16:20]), int.from_bytes(content[20:24])
    if content[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(content) and content[at] == 0xFF:
        mark = content[at + 1]
        if mark == 0xFF:
            at += 1
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9]), int.from_bytes(content[at + 5 : at + 7])
        elif mark == 1 or 0xD0 <= mark <= 0xD7:
            at += 2
        else:
            at += 2 + int.from_bytes(content[at + 2 : at + 4])
    return None
