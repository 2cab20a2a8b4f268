"""Boxes of one frame: candidate pairs, suppression, merging, distances to tracks.

Frames are the unit of work. Pairs are an equi-join on the frame with the geometric test as its other condition;
order-dependent rules are folds over a frame's sorted array of boxes, inside generated plans, so a frame is never
taken out to Python. A frame holds as many boxes as a detector reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

KEYS = ("video", "frame")


def pairs(boxes: DataFrame, condition, keys: tuple[str, ...] = KEYS, order: str = "det") -> DataFrame:
    """Pairs a before b of a frame's boxes that satisfy ``condition(a, b)``; columns of both under a_ and b_."""
    rest = [c for c in boxes.columns if c not in keys]
    a, b = boxes.alias("a"), boxes.alias("b")
    same = F.col(f"a.{order}") < F.col(f"b.{order}")
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, same & condition).select(
        *[F.col(f"a.{k}") for k in keys],
        *[F.col(f"a.{c}").alias(f"a_{c}") for c in rest],
        *[F.col(f"b.{c}").alias(f"b_{c}") for c in rest],
    )


def centre_distance(a: str, b: str) -> Column:
    centre = lambda t, p, q: X.centroid(F.col(f"{t}.{p}"), F.col(f"{t}.{q}"))
    return X.distance(centre(a, "x1", "x2"), centre(a, "y1", "y2"), centre(b, "x1", "x2"), centre(b, "y1", "y2"))


def overlap_pairs(boxes: DataFrame, threshold: float = 0.0) -> DataFrame:
    score = X.overlap(X.corners("a"), X.corners("b"))
    found = pairs(boxes, score > threshold)
    inside = lambda p: [F.col(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")]
    return found.withColumn("overlap", X.overlap(inside("a"), inside("b")))


def merge_candidates(boxes: DataFrame, distance: float = 50.0, overlap: float = 0.95) -> DataFrame:
    """Pairs that merging would put together if both were still unmerged."""
    return pairs(boxes, (centre_distance("a", "b") < distance) | (X.overlap(X.corners("a"), X.corners("b")) > overlap))


def _struct_overlap(a: Column, b: Column) -> Column:
    return X.overlap([a[c] for c in ("x1", "y1", "x2", "y2")], [b[c] for c in ("x1", "y1", "x2", "y2")])


def suppress(boxes: DataFrame, threshold: float = 0.95, keys: tuple[str, ...] = KEYS, order: str = "det") -> DataFrame:
    """Greedy suppression over all classes: by falling confidence, ties in input order, a box stays if it overlaps
    no kept one by more than the threshold."""
    rest = [c for c in boxes.columns if c not in keys]
    item = F.struct((-F.col("conf")).alias("_neg"), F.col(order).alias("_ord"), *rest)
    frames = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))
    kind = boxes.select(F.array(item)).schema[0].dataType.simpleString()
    kept = F.aggregate(
        "all",
        F.array().cast(kind),
        lambda acc, d: F.when(F.exists(acc, lambda k: _struct_overlap(k, d) > threshold), acc).otherwise(F.concat(acc, F.array(d))),
    )
    return frames.select(*keys, F.explode(kept).alias("k")).select(*keys, *[F.col(f"k.{c}").alias(c) for c in rest])


def merge(
    boxes: DataFrame,
    dominant: str = "confidence",
    distance: float = 50.0,
    overlap: float = 0.95,
    keys: tuple[str, ...] = KEYS,
    order: str = "det",
) -> DataFrame:
    """Fold a frame's detections, static ones first, into merged ones.

    A detection meets the merged ones in order and stops at the first that is near or overlaps. Of the same source, or
    if confidence decides, it takes over only when it is surer; of another source, only when its source dominates.
    Taking over keeps the former class and confidence as the combined ones. Results carry their place in the fold.
    """
    item = F.struct(
        F.when(F.col("source") == "static", 0).otherwise(1).alias("rank"), F.col(order).cast("bigint").alias("ord"),
        *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")], F.col("cls"), F.col("conf").cast("double").alias("conf"), F.col("source"),
    )
    frames = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))
    merged = merged_boxes(F.col("all"), dominant, distance, overlap)
    return frames.select(*keys, F.posexplode(merged).alias("det", "m")).select(*keys, F.col("det").cast("bigint").alias("det"), "m.*")


def merged_boxes(boxes: Column, dominant: str = "confidence", distance: float = 50.0, overlap: float = 0.95) -> Column:
    """:func:`merge` on one frame's array of boxes (x1, y1, x2, y2, cls, conf, source), static ones first."""
    if dominant not in ("confidence", "static", "motion"):
        raise ValueError(f"unknown dominant source {dominant!r}")
    kind = (
        "array<struct<x1:int,y1:int,x2:int,y2:int,cls:string,conf:double,source:string,combined_cls:string,combined_conf:double>>"
    )

    def near(m: Column, d: Column) -> Column:
        centre = lambda b, p, q: X.centroid(b[p], b[q])
        apart = X.distance(centre(m, "x1", "x2"), centre(m, "y1", "y2"), centre(d, "x1", "x2"), centre(d, "y1", "y2"))
        return (apart < distance) | (_struct_overlap(m, d) > overlap)

    def made(d: Column, cls: Column, conf: Column) -> Column:
        return F.struct(
            *[d[c].alias(c) for c in ("x1", "y1", "x2", "y2", "cls", "conf", "source")], cls.alias("combined_cls"), conf.alias("combined_conf")
        )

    def step(acc: Column, d: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda m: near(m, d)), F.lit(True))  # 0: none
        surer = lambda m: d["conf"] > m["conf"]
        wins = lambda m: (
            surer(m) if dominant == "confidence" else F.when(d["source"] == m["source"], surer(m)).otherwise(d["source"] == dominant)
        )
        replaced = F.transform(
            acc, lambda m, i: F.when((i + 1 == at) & wins(m), made(d, m["cls"], m["conf"])).otherwise(m)
        )
        return F.when(at == 0, F.concat(acc, F.array(made(d, F.lit(""), F.lit(0.0))))).otherwise(replaced)

    return F.aggregate(boxes, F.array().cast(kind), step)


def stream_columns(merged: DataFrame) -> DataFrame:
    """The winner fills its own source's columns, the combined one the other source's."""
    static = F.col("source") == "static"
    pick = lambda own, other: F.when(static, F.col(own)).otherwise(F.col(other))
    return merged.withColumns(
        {
            "primary_static_class": pick("cls", "combined_cls"),
            "primary_static_conf": pick("conf", "combined_conf"),
            "primary_motion_class": pick("combined_cls", "cls"),
            "primary_motion_conf": pick("combined_conf", "conf"),
        }
    )


def distances(tracks: DataFrame, detections: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The cost matrix of each frame as rows: tracks (track, tx, ty) by detections (det, x, y)."""
    return tracks.join(detections, list(keys)).withColumn("distance", X.distance(F.col("tx"), F.col("ty"), F.col("x"), F.col("y")))


def within(tracks: DataFrame, detections: DataFrame, gate: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Pairs of tracks (track, tx, ty) and detections (det, x, y) of a frame that are nearer than the gate.

    The plane is cut into cells of the gate's size. What is nearer than the gate lies in the same cell or in one of the eight
    around it, so tracks are joined by their cell with detections that stand in all nine of theirs: an equi-join whose work
    is that of near pairs, not of a frame's whole matrix.
    """
    cell = lambda c: F.floor(F.col(c) / gate).cast("bigint")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    own = tracks.withColumns({"_cx": cell("tx"), "_cy": cell("ty")})
    around = detections.withColumn("_s", F.explode(steps)).withColumns({"_cx": cell("x") + F.col("_s.i"), "_cy": cell("y") + F.col("_s.j")}).drop("_s")
    met = own.join(around, [*keys, "_cx", "_cy"]).drop("_cx", "_cy")
    return met.withColumn("distance", X.distance(F.col("tx"), F.col("ty"), F.col("x"), F.col("y"))).filter(F.col("distance") < gate)


def nearest_track(tracks: DataFrame, detections: DataFrame, gate: float = 200.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Each detection's nearest track within the gate, the first of equals; null where there is none."""
    near = (
        within(tracks, detections, gate, keys)
        .groupBy(*keys, "det")
        .agg(F.min(F.struct("distance", "track")).alias("m"))
        .select(*keys, "det", F.col("m.track").alias("track"), F.col("m.distance").alias("distance"))
    )
    return detections.select(*keys, "det").join(near, [*keys, "det"], "left")


def topmost(boxes: DataFrame, px: Column, py: Column, keys: tuple[str, ...] = KEYS, order: str = "det") -> DataFrame:
    """The last drawn box that contains the point."""
    inside = (px >= F.col("x1")) & (px <= F.col("x2")) & (py >= F.col("y1")) & (py <= F.col("y2"))
    return boxes.filter(inside).groupBy(*keys).agg(F.max(order).alias(order))
