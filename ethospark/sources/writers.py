"""Sinks: the files that the engine's users exchange, written by Spark's own writers."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import exprs as X
from . import named


def tracking(rows: DataFrame, path: str, video: str = "video_filename") -> None:
    """The twelve columns of a tracking file, confidences with three decimals, a folder for each video."""
    made = rows
    for c in schema.TRACKING_COLUMNS:
        if c not in made.columns:
            made = made.withColumn(c, F.lit(0.0) if c.endswith("_conf") else F.lit(""))
        if c.endswith("_conf"):
            made = made.withColumn(c, F.format_string("%.3f", F.coalesce(F.col(c).cast("double"), F.lit(0.0))))
    made.select(video, *schema.TRACKING_COLUMNS).repartition(video).sortWithinPartitions(video, "frame").write.mode("overwrite").partitionBy(video).option("header", True).csv(path)


def report(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A budget or suspects report as one CSV file with a header, also when it has no rows."""
    (rows.select(*columns) if columns else rows).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def label_lines(boxes: DataFrame, width: int, height: int, offset: int = 0) -> DataFrame:
    """basename and the text of its label file: class, centre and size with six decimals; motion classes are re-based."""
    values = X.normalised_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(width), F.lit(height))
    line = F.format_string("%d %.6f %.6f %.6f %.6f", (F.col("cls") - offset).cast("int"), *values)
    return boxes.groupBy("basename").agg(F.array_sort(F.collect_list(F.struct("det", line.alias("line")))).alias("l")).select("basename", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def label_lines_by_stream(boxes: DataFrame, n_static: int, width: int, height: int) -> DataFrame:
    """stream, basename and the text of its label file, of boxes with joint class ids: ids from ``n_static`` on are
    motion classes and start from 0 in their stream's files."""
    moving = F.col("cls") >= n_static
    static = label_lines(boxes.filter(~moving), width, height).withColumn("stream", F.lit("static"))
    return static.unionByName(label_lines(boxes.filter(moving), width, height, n_static).withColumn("stream", F.lit("motion")))


def mask_lines(masks: DataFrame) -> DataFrame:
    """basename and the text of its mask file."""
    line = lambda b: F.concat_ws(" ", *[b[c].cast("string") for c in ("x1", "y1", "x2", "y2")])
    return masks.select("basename", F.array_join(F.transform("boxes", line), "\n").alias("text"))


def named_files(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows (name, content) as files of those names below a folder, all of them or none (:mod:`sources.named`)."""
    rows.sparkSession.dataSource.register(named.NamedFiles)
    made = rows.select("name", F.col("content").cast("binary").alias("content"))
    made.write.format("named_files").mode("overwrite" if overwrite else "append").save(path)


def text_by_key(rows: DataFrame, path: str, suffix: str = ".txt") -> None:
    """A file ``<basename><suffix>`` for each row (basename, text): labels with ``.txt``, masks with ``.mask.txt``."""
    named_files(rows.select(F.concat("basename", F.lit(suffix)).alias("name"), F.col("text").alias("content")), path)


def grey_png(px: Column, width: Column, height: Column) -> Column:
    """Bytes of an 8-bit grey PNG of a row-major image."""

    @F.pandas_udf("binary")
    def encoded(images: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else png(np.asarray(p, np.uint8).reshape(h, w)) for p, w, h in zip(images, widths, heights)])

    return encoded(px, width.cast("int"), height.cast("int"))


def png(image: np.ndarray) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width = image.shape
    raw = np.zeros((height, width + 1), np.uint8)  # each row begins with its filter, none
    raw[:, 1:] = image
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def crop_files(boxes: DataFrame, frames: DataFrame, width: int, path: str) -> None:
    """Grey crops of boxes as PNG files ``<cls>/<secondary>/<video>_<frame>_<x1>_<y1>.png``, which ``readers.crops`` reads.

    Boxes are within the frame; of boxes with one corner in a frame and equal classes the largest is kept.
    """
    size = [F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")]
    name = F.format_string("%s/%s/%s_%d_%d_%d.png", "cls", "secondary", "video", F.col("frame").cast("bigint"), F.col("x1").cast("bigint"), F.col("y1").cast("bigint"))
    some = boxes.filter((size[0] > 0) & (size[1] > 0)).withColumn("name", name)
    some = some.groupBy("name").agg(F.max_by(F.struct("video", "frame", "x1", "y1", "x2", "y2"), F.struct(size[0] * size[1], "x2")).alias("b")).select("name", "b.*")
    made = some.join(frames.select("video", "frame", "px"), ["video", "frame"]).select("name", grey_png(cropped(width), *size).alias("content"))
    named_files(made, path)


def cropped(width: int) -> Column:
    """The pixels of a box (x1, y1, x2, y2) of a row-major image px."""
    h = F.col("y2") - F.col("y1")
    return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(h - 1, F.lit(0))), lambda r: F.slice("px", (F.col("y1") + r) * width + F.col("x1") + 1, F.col("x2") - F.col("x1"))))


def crops(boxes: DataFrame, frames: DataFrame, width: int, path: str) -> None:
    """Grey crops of boxes, under their primary and secondary class, as arrays with their corner."""
    made = boxes.filter("y2 > y1").join(frames.select("video", "frame", "px"), ["video", "frame"])
    made.select("video", "frame", "x1", "y1", "cls", "secondary", cropped(width).alias("px")).write.mode("overwrite").partitionBy("cls", "secondary").parquet(path)
