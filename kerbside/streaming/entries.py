"""An addition of ours: boxes as a stream, kept, projected and counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside import params as P
from kerbside.operators import detect


def live_detections(boxes: DataFrame, params: DataFrame, conf: float = P.DEFAULT_CONF) -> DataFrame:
    """Kept and projected boxes of a stream; stateless."""
    return detect.projected(detect.confident(detect.named(boxes, params), params, conf), params)


def counts_by_minute(kept: DataFrame, time: str = "event_time", late: str = "30 seconds") -> DataFrame:
    """Kept boxes and mean confidence by job, class and minute; rows later than the watermark are left out, and its state with them."""
    w = kept.withWatermark(time, late).groupBy(F.window(time, "1 minute"), "job_id", "class")
    return w.agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_conf")).select("window.start", "job_id", "class", "n", "mean_conf")
