"""Jobs: runs over frames or boxes, their registry and their files."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside import documents, hooks, sinks
from kerbside import params as P
from kerbside.functions import media, overlay
from kerbside.operators import detect, track
from kerbside.plans.pipeline import Result, from_boxes, job_summary
from kerbside.plans.scratch import Scratch
from kerbside.sources import archive, listing

#: Kinds of files of a job and their names; kmz is packed when it is asked for.
ARTIFACTS = {"geojson": "detections.geojson", "deduped_geojson": "detections_deduped.geojson", "kml": "detections.kml", "assets_csv": "detections_deduped.csv", "tri_debug_csv": "detections_triangulation_debug.csv", "calibration_log": "calibration.log", "raw": "detections_raw.json"}


def start_time(override: str | None = None, probe: datetime | None = None, points: DataFrame | None = None) -> datetime:
    """When a video began, in UTC: as the caller says (ISO, its offset ignored), by its own tags, with the track, or now."""
    if override:
        return datetime.fromisoformat(override).replace(tzinfo=UTC)
    if probe is not None:
        return probe if probe.tzinfo else probe.replace(tzinfo=UTC)
    first = points.agg(F.unix_micros(F.min("ts"))).first()[0] if points is not None else None
    return datetime.now(UTC) if first is None else datetime.fromtimestamp(first / 1e6, UTC)


def _sizes(batches):
    for b in batches:
        sizes = [media.image_size(c.as_py()) or (None, None) for c in b.column("content")]
        yield pa.record_batch([b.column("job_id"), b.column("path"), *(pa.array([s[k] for s in sizes], pa.int32()) for k in range(2))], names=["job_id", "path", "image_w_px", "image_h_px"])


class Engine:
    """Runs jobs under out_dir and keeps a table of them there, so a job outlives the process that ran it."""

    def __init__(self, spark: SparkSession, out_dir: str):
        self.spark, self.out_dir = spark, out_dir.rstrip("/")

    def run(self, boxes: DataFrame, frames: DataFrame | None = None, conf: float = P.DEFAULT_CONF) -> str:
        """Assets of boxes (see scenes.SCENE) and, with their frames, tracks; writes all files and returns the run's id.

        frames: job_id, frame_idx, offset_sec, timestamp_iso, cam_lat, cam_lng, cam_bearing, ele, gps_source, top_text;
        by default those that have boxes. A plan of boxes is computed once.
        """
        return self._run(lambda: Scratch(self.spark).write(boxes, "boxes"), frames, conf)

    def _run(self, made: Callable[[], DataFrame], frames: DataFrame | None, conf: float) -> str:
        run_id = uuid.uuid4().hex[:8]
        started = datetime.now(UTC).isoformat()
        try:
            boxes = made()
            r = from_boxes(self.spark, boxes, conf, write_kept=True)
            if frames is None:
                frames = boxes.select("job_id", "frame_idx", F.col("ts").alias("offset_sec"), "timestamp_iso", "cam_lat", "cam_lng", "cam_bearing", "ele", "gps_source", F.lit("").alias("top_text")).distinct()
            self._write(run_id, r, frames)
            log = sinks.log_summary(sinks.path_log(r.assets))
            summary = job_summary(frames, boxes, r.kept, r.assets).join(log, "job_id", "left").na.fill(0, ["lines_count"])
            summary.write.parquet(f"{self.out_dir}/{run_id}/summary")
            self._register(run_id, "complete", "", started)
        except Exception as e:
            self._register(run_id, "error", str(e)[-500:], started)
            raise
        return run_id

    def run_frames(self, frames: DataFrame, detector: Callable, reader: Callable, points: DataFrame | None = None, conf: float = P.DEFAULT_CONF) -> str:
        """A run from images: texts, poses and boxes of frames, then run().

        frames: job_id, frame_idx, ts (time), offset_sec, content, image_w_px, image_h_px. detector and reader: see
        hooks.detect and hooks.recognize. points: a GPS track (sources.gpx) for frames whose text has no position.
        """
        scratch = Scratch(self.spark)
        plain = frames.drop("content")
        texts = hooks.recognize(frames, reader)
        texts = scratch.write(texts.select("job_id", "frame_idx", F.col("top").alias("top_text"), overlay.region_cascade(F.col("bottom"), F.col("top"), F.col("full")).alias("o")), "texts")
        seen = texts.where("o IS NOT NULL").select("job_id", "frame_idx", "o.lat", "o.lng", "o.bearing")
        empty = self.spark.createDataFrame([], "job_id long, pt_seq long, ts timestamp, lat double, lng double, ele double")
        pose = track.resolved(plain, seen, track.interpolated(points if points is not None else empty, plain))
        pose = pose.withColumnsRenamed({"lat": "cam_lat", "lng": "cam_lng", "bearing": "cam_bearing"}).withColumn("timestamp_iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
        pose = scratch.write(pose.join(texts.select("job_id", "frame_idx", F.coalesce("top_text", F.lit("")).alias("top_text")), ["job_id", "frame_idx"], "left"), "poses")
        threshold = detect.detector_threshold(P.class_params(self.spark), conf).first()[0]
        boxes = scratch.write(hooks.detect(frames, detector, threshold), "boxes")
        order = Window.partitionBy("job_id").orderBy("frame_idx", "line_no")
        boxes = boxes.withColumn("entry_seq", F.shiftleft(F.col("job_id"), 36) + F.row_number().over(order))
        boxes = boxes.drop("line_no").join(pose.withColumn("ts", F.col("offset_sec")).drop("top_text"), ["job_id", "frame_idx"])
        return self._run(lambda: scratch.write(boxes, "boxes"), pose, conf)

    def run_dir(self, path: str, detector: Callable, reader: Callable, points: DataFrame | None = None, interval: float = 1.0, start: str | None = None, tags: Callable | None = None, conf: float = P.DEFAULT_CONF) -> str:
        """A run from a folder or a zip of frames, in order of their paths, interval seconds apart.

        Images whose header can't be read take their place in the order and are left out. A frame's time is what its
        tags say (tags: see hooks.image_tags), else start_time plus its place. points: a GPS track of job 0. detector,
        reader: see run_frames.
        """
        files = archive.zip_frames(self.spark, path) if path.lower().endswith(".zip") else listing.frames(self.spark, path)
        files = files.select(F.lit(0).cast("long").alias("job_id"), "path", "content")
        scratch = Scratch(self.spark)
        sizes = scratch.write(files.mapInArrow(_sizes, "job_id long, path string, image_w_px int, image_h_px int"), "sizes")
        order = track.indexed(sizes.withColumn("readable", F.col("image_w_px").isNotNull())).drop("readable")
        f = scratch.write(order.join(files, ["job_id", "path"]), "frames")
        f = f.withColumn("offset_sec", F.round(F.col("frame_idx") * F.lit(float(interval)), 2))
        began = start_time(start, points=points)
        ts = F.timestamp_micros((F.lit(round(began.timestamp() * 1e6)) + F.round(F.col("offset_sec") * 1e6)).cast("long"))
        if tags is not None:
            t = hooks.image_tags(f.select("job_id", "frame_idx", "content"), tags).select("job_id", "frame_idx", media.exif_time(F.col("original"), F.col("changed")).alias("taken"))
            f = f.join(scratch.write(t, "tags"), ["job_id", "frame_idx"], "left").withColumn("ts", F.coalesce("taken", ts)).drop("taken")
        else:
            f = f.withColumn("ts", ts)
        return self.run_frames(f.drop("path"), detector, reader, points, conf)

    def _write(self, run_id: str, r: Result, frames: DataFrame) -> None:
        at = f"{self.out_dir}/{run_id}/"
        det = detect.detections(r.kept)
        features, assets = sinks.frame_features(frames, det), sinks.asset_features(r.assets)
        sinks.write_text(sinks.feature_collection(features), at + ARTIFACTS["geojson"])
        sinks.write_text(sinks.feature_collection(assets), at + ARTIFACTS["deduped_geojson"])
        sinks.write_text(sinks.csv_document(sinks.assets_report(r.assets, "cluster_id"), sinks.ASSETS_COLUMNS, "job_id", "cluster_id"), at + ARTIFACTS["assets_csv"])
        sinks.write_text(sinks.csv_document(sinks.tri_debug_report(r.assets, "cluster_id"), sinks.DEBUG_COLUMNS, "job_id", "cluster_id"), at + ARTIFACTS["tri_debug_csv"])
        entry = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")
        sinks.write_text(sinks.json_list(r.entries.select(sinks.order_key("job_id", "entry_seq").alias("key"), entry)), at + ARTIFACTS["raw"])
        log = sinks.path_log(r.assets).select(F.lit(1).alias("part"), sinks.order_key("job_id", "cluster_id", "ord").alias("key"), F.col("line").alias("value"))
        stretch = [f"#   {c[1]}: {c[7]}" for c in P.CLASSES if c[7] is not None]
        head = "\n".join([f"# calibration log for job {run_id}", f"# TRI_STRETCH_DEFAULT={P.DEFAULT_STRETCH}", f"# CALIBRATION_BEARING_OFFSET_DEG={P.BEARING_OFFSET_DEG:+.2f}", "# TRI_STRETCH_BY_CLASS:", *stretch, ""])
        sinks.write_text(self.spark.createDataFrame([(0, [""], head)], sinks.ROWS).union(log), at + ARTIFACTS["calibration_log"])
        marks = sinks.placemarks(assets.unionByName(features.where("type = 'gps_track'"), allowMissingColumns=True))
        sinks.write_text(sinks.kml_document(f"Roadside assets — {run_id}", frames, marks), at + ARTIFACTS["kml"])

    def kmz(self, run_id: str, to: str, images: DataFrame | None = None) -> str:
        """Packs a finished run for download into one file: the document, crops (name, content) and log (see documents.write_archive)."""
        files = [(name, self.artifact(run_id, kind)) for name, kind in (("doc.kml", "kml"), ("calibration.log", "calibration_log"))]
        if images is not None:
            images = images.select(F.concat(F.lit("images/"), "name").alias("name"), "content")
        documents.write_archive(self.spark, files, images, to)
        return to

    def _register(self, run_id: str, status: str, message: str, started: str) -> None:
        row = [(run_id, status, message, started, datetime.now(UTC).isoformat())]
        self.spark.createDataFrame(row, "job_id string, status string, message string, started_at string, finished_at string").coalesce(1).write.mode("append").parquet(f"{self.out_dir}/jobs")

    def jobs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.out_dir}/jobs")

    def status(self, run_id: str) -> dict:
        found = self.jobs().where(F.col("job_id") == run_id).first()
        if found is None:
            raise KeyError(run_id)
        return found.asDict()

    def artifact(self, run_id: str, kind: str) -> str:
        """Path of a finished job's file of one kind."""
        if self.status(run_id)["status"] != "complete":
            raise FileNotFoundError(f"{run_id} is not ready")
        return f"{self.out_dir}/{run_id}/{ARTIFACTS[kind]}"

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version, "out_dir": self.out_dir}
