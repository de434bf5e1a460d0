"""What lies outside of Spark, as functions that tasks call: decoder, image tags, detector, text recognition, crops."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

BOXES = "job_id long, frame_idx long, line_no int, class_id int, cx double, cy double, w double, h double, confidence double"
IMAGE_BOXES = "line_no int, class_id int, cx double, cy double, w double, h double, confidence double"
TEXTS = "job_id long, frame_idx long, bottom string, top string, full string"


def detect(frames: DataFrame, make: Callable[[float], Callable[[bytes], list[tuple]]], threshold: float) -> DataFrame:
    """Boxes of frames (job_id, frame_idx, content). make(threshold) builds a detector once a task; it returns rows of class_id, cx, cy, w, h, confidence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make(threshold)
        for b in batches:
            rows = [(j, f, k, *box) for j, f, c in zip(b.job_id, b.frame_idx, b.content) for k, box in enumerate(model(c))]
            yield pd.DataFrame(rows, columns=["job_id", "frame_idx", "line_no", "class_id", "cx", "cy", "w", "h", "confidence"])

    return frames.select("job_id", "frame_idx", "content").mapInPandas(run, BOXES)


def box_function(make: Callable[[float], Callable[[bytes], list[tuple]]], threshold: float) -> UserDefinedTableFunction:
    """A table function of an image's bytes: its boxes as rows of IMAGE_BOXES, in the detector's order; none for null.

    For lateral joins and, registered by spark.udtf.register, for SQL. make(threshold) builds a detector once a task.
    """

    class Boxes:
        def __init__(self):
            self._model = make(threshold)

        def eval(self, content: bytes) -> Iterator[tuple]:
            if content is not None:
                for k, box in enumerate(self._model(bytes(content))):
                    yield k, *box

    return F.udtf(Boxes, returnType=IMAGE_BOXES, useArrow=True)


def detect_beside(frames: DataFrame, make: Callable[[float], Callable[[bytes], list[tuple]]], threshold: float) -> DataFrame:
    """The boxes of detect beside all columns of frames but content, by a lateral join with box_function; frames without boxes have no row.

    Columns of frames that are named as a box's are kept from the boxes alone.
    """
    boxes = box_function(make, threshold)(F.col("content").outer())
    taken = {c.lower() for c in (*(b.split()[0] for b in IMAGE_BOXES.split(", ")), "content")}
    names = [F.col(f"f.`{c}`") for c in frames.columns if c.lower() not in taken]
    return frames.alias("f").lateralJoin(boxes.alias("b")).select(*names, "b.*")


def _position(text: str) -> bool:
    """Whether a text may hold a position: two numbers with decimals. Errors hold none."""
    return not text.startswith(("API_ERROR", "EXCEPTION")) and len(re.findall(r"[0-9]{2,3}[.,/ ][0-9]{3,}", text)) > 1


def recognize(frames: DataFrame, make: Callable[[], Callable[[bytes, str], str]], found: Callable[[str], bool] = _position) -> DataFrame:
    """Texts of frames by region. Regions are asked in order and only until found() says that a text will do: calls cost money."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = make()
        for b in batches:
            rows = []
            for j, f, c in zip(b.job_id, b.frame_idx, b.content):
                texts: dict[str, str | None] = {"bottom": None, "top": None, "full": None}
                for region in texts:
                    try:
                        texts[region] = read(c, region)
                    except Exception as e:
                        texts[region] = f"EXCEPTION: {type(e).__name__}"
                    if found(texts[region] or ""):
                        break
                rows.append((j, f, *texts.values()))
            yield pd.DataFrame(rows, columns=["job_id", "frame_idx", "bottom", "top", "full"])

    return frames.select("job_id", "frame_idx", "content").mapInPandas(run, TEXTS)


def decode(videos: DataFrame, make: Callable[[], Callable[[bytes], Iterator[bytes]]]) -> DataFrame:
    """Frames (job_id, frame_idx, content) of videos (job_id, content): make() builds a decoder once a task, which yields a video's frames at its interval."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = make()
        for b in batches:
            for j, c in zip(b.job_id, b.content):
                for k, frame in enumerate(read(c)):
                    yield pd.DataFrame([(j, k, frame)], columns=["job_id", "frame_idx", "content"])

    return videos.select("job_id", "content").mapInPandas(run, "job_id long, frame_idx long, content binary")


def image_tags(frames: DataFrame, make: Callable[[], Callable[[bytes], tuple[str | None, str | None]]]) -> DataFrame:
    """job_id, frame_idx, original, changed: the two date tags of each image, for functions.media.exif_time; null where they can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = make()
        for b in batches:
            rows = []
            for j, f, c in zip(b.job_id, b.frame_idx, b.content):
                try:
                    rows.append((j, f, *read(c)))
                except Exception:
                    rows.append((j, f, None, None))
            yield pd.DataFrame(rows, columns=["job_id", "frame_idx", "original", "changed"])

    return frames.select("job_id", "frame_idx", "content").mapInPandas(run, "job_id long, frame_idx long, original string, changed string")


def cropped(frames: DataFrame, kept: DataFrame, make: Callable[[], Callable[[bytes, int, int, int, int], bytes]]) -> DataFrame:
    """job_id, name, content: pixels of the crop rectangles (operators.detect.crops) of kept boxes."""
    rows = kept.where("image_file IS NOT NULL").select("job_id", "frame_idx", F.col("image_file").alias("name"), "rect.*").join(frames.select("job_id", "frame_idx", "content"), ["job_id", "frame_idx"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = make()
        for b in batches:
            content = [cut(*r) for r in zip(b.content, b.x0, b.y0, b.x1, b.y1)]
            yield pd.DataFrame({"job_id": b.job_id, "name": b["name"], "content": content})

    return rows.select("job_id", F.col("name"), "content", "x0", "y0", "x1", "y1").mapInPandas(run, "job_id long, name string, content binary")


def stub_detector(threshold: float) -> Callable[[bytes], list[tuple]]:
    """A detector for tests: one box from the sum of the bytes, if its confidence reaches the threshold."""

    def model(content: bytes) -> list[tuple]:
        s = sum(content) % 100
        return [(s % 28, 0.5, 0.5, 0.1, 0.2, s / 100)] if s / 100 >= threshold else []

    return model
