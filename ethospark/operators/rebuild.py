"""Rebuilding a dataset's images from the keys of its labels, and automatic annotation of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import dataset, detect, geometry, motion

#: Spellings of video extensions that are tried, the preferred first.
CLIP_EXTENSIONS = (".mp4", ".MP4", ".avi", ".AVI", ".mov", ".MOV", ".mkv", ".MKV")


def items(*folders: DataFrame) -> DataFrame:
    """The distinct (basename, split, stream) of all label folders, without augmented ones, with label and frame."""
    keys = folders[0]
    for f in folders[1:]:
        keys = keys.unionByName(f)
    label, frame = X.basename_parts(F.col("basename"))
    keys = keys.select("basename", "split", "stream").distinct().filter(~X.is_augmented(F.col("basename")))
    return keys.withColumn("label", label).withColumn("frame", frame).na.drop(subset=["label"])


def with_clips(keys: DataFrame, clips: DataFrame) -> DataFrame:
    """Items with the path of the clip of exactly that stem, by extension; items without one are skipped."""
    rank = F.lit(None).cast("int")
    for i in reversed(range(len(CLIP_EXTENSIONS))):
        rank = F.when(F.col("name").endswith(CLIP_EXTENSIONS[i]), i).otherwise(rank)
    best = (
        clips.withColumn("rank", rank)
        .filter("rank is not null")
        .groupBy(X.stem(F.col("name")).alias("label"))
        .agg(F.min(F.struct("rank", "path")).alias("b"))
    )
    return keys.join(best, "label").withColumn("path", F.col("b.path")).drop("b")


def motion_images(
    keys: DataFrame, frames: DataFrame, window: int, skip: int = 0, exponential: bool = True, exp_a: float = 0.5, exp_b: float = 0.8, **colour
) -> DataFrame:
    """The false-colour image of each item (basename, label, frame) from the window of frames that ends at it.

    frames: video, frame (from 0), px. One walk over the frames serves all windows (:func:`motion.windows_walk`).
    """
    asked = keys.select(F.col("label").alias("video"), F.col("frame").alias("target")).distinct()
    last = motion.windows_walk(frames, asked, window, skip, exponential, exp_a, exp_b)
    planes = motion.false_colour(last, **colour).select(F.col("video").alias("label"), F.col("target").alias("frame"), "blue", "green", "red")
    return keys.join(planes, ["label", "frame"])


def blocked(images: DataFrame, masks: DataFrame, blocks: DataFrame | None, width: int, column: str = "px") -> DataFrame:
    """Images (basename, px) with their mask rectangles filled, and those of another stream's labels if given."""
    out = images.join(masks.select("basename", F.col("boxes").alias("_m")), "basename", "left")
    empty = F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>")
    boxes: Column = F.coalesce("_m", empty)
    if blocks is not None:
        own = blocks.groupBy("basename").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_b"))
        out, boxes = out.join(own, "basename", "left"), F.concat(boxes, F.coalesce("_b", empty))
    return out.withColumn(column, motion.masked(F.col(column), width, boxes)).select(*images.columns)


def auto_annotate(
    static: DataFrame,
    moving: DataFrame,
    threshold: float = 0.95,
    models: dict | None = None,
    secondary_static: tuple[str, ...] = (),
    secondary_motion: tuple[str, ...] = (),
) -> DataFrame:
    """Boxes of both detectors on the same frames, after greedy suppression over all of them.

    With ``models`` (by route, as ``static:cat``) each box is judged by its secondary model first, static ones preferred.
    """
    both = static.unionByName(moving)
    if models is not None:
        both = detect.classify(both, models, detect.annotation_route(F.col("cls"), list(secondary_static), list(secondary_motion)))
    order = F.xxhash64("source", "x1", "y1", "x2", "y2", "cls")  # ties of confidence in a fixed order
    return geometry.suppress(both.withColumn("det", order), threshold).drop("det")


def unannotated_items(pool: DataFrame, keys: DataFrame) -> DataFrame:
    return dataset.unannotated(pool, keys.select(F.col("label").alias("video"), "frame"))
