"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

#: Columns of a tracking file, in order; all text until they are cast.
TRACKING_COLUMNS = [
    "frame", "id", "x", "y",
    "primary_static_class", "primary_static_conf", "primary_motion_class", "primary_motion_conf",
    "secondary_static_class", "secondary_static_conf", "secondary_motion_class", "secondary_motion_conf",
]
TRACKING_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in TRACKING_COLUMNS])
METADATA_TEXT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("video_filename", "group_id", "group_type", "exclude_track_ids")]
)
