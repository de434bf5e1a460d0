"""A detection scene, overlay texts and file listings derived from the events table, for queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row a box: cameras drive north, each asset is seen in up to six frames. Runs on Spark and DuckDB.
SCENE = """
SELECT entry_seq, job_id, frame_idx, asset, class_id, ts, cam_lat, cam_lng, cam_bearing, confidence,
  ROUND(GREATEST(0e0,LEAST(1e0,5e-1+(th-30e0)/40e0)),4) AS cx, 5e-1 AS cy, 1e-1 AS w,
  ROUND(LEAST(1e0,GREATEST(5e-3,COALESCE(height_m,2e0)/(2e0*dist*TAN(RADIANS(34e0))))),4) AS h,
  1080 AS image_w_px, 1920 AS image_h_px, CAST(0 AS DOUBLE) AS ele, 'ocr' AS gps_source
FROM (SELECT *, DEGREES(ATAN2(lm,am)) AS th, SQRT(lm*lm+am*am) AS dist,
  CASE class_id WHEN 0 THEN 11.0e0 WHEN 1 THEN 2.0e0 WHEN 2 THEN 0.6e0 WHEN 3 THEN 0.6e0
  WHEN 4 THEN 1.2e0 WHEN 6 THEN 1.5e0 WHEN 10 THEN 0.8e0 WHEN 12 THEN 2.4e0 WHEN 15 THEN 0.9e0 WHEN 17 THEN 0.6e0
  WHEN 18 THEN 0.5e0 WHEN 21 THEN 2.0e0 WHEN 23 THEN 8.0e0 WHEN 24 THEN 1.5e0 WHEN 25 THEN 1.8e0 WHEN 26 THEN 0.2e0 END AS height_m
FROM (SELECT *, (asset*5+job_id) % 28 AS class_id, CAST(frame_idx AS DOUBLE) AS ts,
  3e0+(asset % 7)*2e0 AS lm, 20e0+(asset % 3)*6e0-3.3396e0*i AS am,
  CASE WHEN (frame_idx*8+job_id) % 41 = 0 THEN NULL ELSE ROUND(30.4e0+job_id*2e-2+frame_idx*3e-5,7) END AS cam_lat,
  CASE WHEN (frame_idx*8+job_id) % 41 = 0 THEN NULL ELSE -86.7e0 END AS cam_lng,
  CASE WHEN (frame_idx*8+job_id) % 29 = 0 THEN NULL ELSE 30e0 END AS cam_bearing,
  ROUND(2e-1+((entry_seq*37) % 80)/100e0,3) AS confidence
FROM (SELECT *, CAST(FLOOR(frame_idx/6) AS BIGINT)*4+box AS asset, frame_idx % 6 AS i
FROM (SELECT entry_seq, job_id, CAST(FLOOR(k/4) AS BIGINT) AS frame_idx, k % 4 AS box
FROM (SELECT event_id AS entry_seq, event_id % 8 AS job_id, CAST(FLOOR(event_id/8) AS BIGINT) AS k FROM events) s1) s2) s3) s4) s5
"""

#: Overlay texts by turns of eight forms; each third, the top strip holds the position.
TEXTS = """
SELECT event_id % 8 AS job_id, event_id AS frame_idx,
  CASE event_id % 8
    WHEN 0 THEN concat('Position: +0', la, '.', d1, ' / -0', lo, '.', d2, ' Azimuth/Bearing: ', be, '° N21W 6027mils (True)')
    WHEN 1 THEN concat('Position: 0', la, '.', d1, ' | -0', lo, '.', d2, ' Heading 7.5')
    WHEN 2 THEN concat('+0', la, ' ', d1, ' / -0', lo, ',', d2, ' bearing: 360')
    WHEN 3 THEN concat('lat: ', la, '.', d1, ', lon: -', lo, '.', d2)
    WHEN 4 THEN concat('N ', la, ' 20 38 W ', lo, ' 32 19.5 heading 400')
    WHEN 5 THEN concat('gps: ', la, '.', d1, ', ', lo, '.', d2, ' Bearing: -12')
    WHEN 6 THEN concat('junk ', lo, '.', d2, ' text ', la, '.', d1, ' azimuth 12')
    ELSE 'API_ERROR: none' END AS text
FROM (SELECT event_id, CAST(25 + event_id % 20 AS VARCHAR(9)) AS la, CAST(70 + event_id % 25 AS VARCHAR(9)) AS lo, CAST(event_id % 300 AS VARCHAR(9)) AS be,
  CAST(10000 + (event_id * 7919) % 89999 AS VARCHAR(9)) AS d1, CAST(10000 + (event_id * 104729) % 89999 AS VARCHAR(9)) AS d2 FROM events) t
"""

#: A track point for each event, seven seconds apart in its job, and a camera time for each event, all along the track
#: and up to 350 s outside of it.
TRACK = """
SELECT event_id % 8 AS job_id, event_id AS pt_seq, CAST(FLOOR(event_id / 8) AS BIGINT) * 7 AS sec,
  30e0 + (event_id % 1000) / 1e3 AS lat, -86e0 - (event_id % 700) / 1e3 AS lng, CAST(event_id % 90 AS DOUBLE) AS ele
FROM events
"""
TIMES = "SELECT event_id % 8 AS job_id, event_id AS frame_idx, CAST(FLOOR(event_id / 8) AS BIGINT) * 7 + CAST((event_id * 13) % 701 - 350 AS BIGINT) AS sec FROM events"

#: Frames of the scene with where their pose is from and what their top strip says, and those of a job without boxes.
FRAMES = """
SELECT job_id, frame_idx, CASE WHEN (frame_idx*8+job_id) % 41 = 0 THEN NULL WHEN frame_idx % 5 = 0 THEN 'gpx' ELSE 'ocr' END AS gps_source,
  concat('strip ', CAST(frame_idx AS VARCHAR(12))) AS top_text
FROM (SELECT DISTINCT event_id % 8 AS job_id, CAST(FLOOR(FLOOR(event_id/8)/4) AS BIGINT) AS frame_idx FROM events
UNION ALL SELECT 8 AS job_id, CAST(FLOOR(event_id/50) AS BIGINT) AS frame_idx FROM events WHERE event_id % 50 = 0) f
"""

#: Paths of images, weights and result files.
LISTING = """
SELECT event_id, event_id % 8 AS job_id,
  CASE event_id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'incoming' END AS split,
  concat('runs/run-', CAST(event_id % 37 AS VARCHAR(9)), '/', CASE event_id % 7 WHEN 0 THEN 'a.JPG' WHEN 1 THEN 'b.jpeg' WHEN 2 THEN 'c.png' WHEN 3 THEN 'weights/best.pt' WHEN 4 THEN 'weights/last.pt' WHEN 5 THEN 'd.Jpg' ELSE 'results.csv' END) AS path,
  event_id * 4096 AS bytes
FROM events
"""


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format(F.timestamp_seconds(F.lit(1767225600) + F.col("frame_idx")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return derive(spark, sf_dir, SCENE).withColumn("timestamp_iso", iso)


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, TRACK).withColumn("ts", F.timestamp_seconds("sec"))


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, TIMES).withColumn("ts", F.timestamp_seconds("sec"))
