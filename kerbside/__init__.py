"""kerbside: locate roadside assets from per-frame detections, as Spark DataFrames."""
