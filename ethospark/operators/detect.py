"""Detectors and classifiers as plug-ins: any function on batches of frames, routed by source and class."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A detector gets frames (video, frame, px, ...) and returns rows video, frame, x1, y1, x2, y2, cls, conf.
Detector = Callable[[pd.DataFrame], pd.DataFrame]


def detect(frames: DataFrame, detector: Detector, source: str, threshold: float = 0.5) -> DataFrame:
    """Run a detector on Arrow batches of frames; keep what is sure enough; corners are cut to whole pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = detector(pdf)
            made = made[made["conf"] >= threshold].copy()
            for c in ("x1", "y1", "x2", "y2"):
                made[c] = made[c].astype(float).astype("int32")
            made["source"] = source
            yield made[["video", "frame", "x1", "y1", "x2", "y2", "cls", "conf", "source"]]

    return frames.mapInPandas(run, "video string, frame bigint, x1 int, y1 int, x2 int, y2 int, cls string, conf double, source string")


BOXES = "array<struct<x1: int, y1: int, x2: int, y2: int, cls: string, conf: double, source: string>>"


def detect_both(frames: DataFrame, static: Detector | None, moving: Detector | None, threshold: float = 0.5) -> DataFrame:
    """video, frame and the boxes of both detectors in one array, static ones first; a row for each frame, also without boxes.

    ``moving`` gets the frames with their planes, which are the motion images. No rows of different frames meet, so this is good for streams.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[tuple, list[dict]] = {}
            for source, detector in (("static", static), ("motion", moving)):
                if detector is not None:
                    made = detector(pdf)
                    made = made[made["conf"] >= threshold]
                    for r in made.to_dict("records"):
                        box = {c: int(float(r[c])) for c in ("x1", "y1", "x2", "y2")} | {"cls": r["cls"], "conf": float(r["conf"]), "source": source}
                        found.setdefault((str(r["video"]), int(r["frame"])), []).append(box)
            keys = [(str(v), int(f)) for v, f in zip(pdf["video"], pdf["frame"])]
            yield pd.DataFrame({"video": [k[0] for k in keys], "frame": [k[1] for k in keys], "boxes": [found.get(k, []) for k in keys]})

    return frames.mapInPandas(run, f"video string, frame bigint, boxes {BOXES}")


def bright_spots(size: int, level: int = 200) -> Detector:
    """A deterministic stand-in for a trained model: the box of the pixels above a level, its share as confidence."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for video, frame, px in zip(pdf["video"], pdf["frame"], pdf["px"]):
            hot = [i for i, v in enumerate(px) if v >= level]
            if hot:
                xs, ys = [i % size for i in hot], [i // size for i in hot]
                rows.append((str(video), frame, min(xs), min(ys), max(xs) + 1, max(ys) + 1, "spot", min(1.0, 0.5 + len(hot) / len(px))))
        return pd.DataFrame(rows, columns=["video", "frame", "x1", "y1", "x2", "y2", "cls", "conf"])

    return run


def secondary_route(source: Column, cls: Column, static: list[str], motion: list[str], ignored: list[str], hierarchical: bool = True) -> Column:
    """Which secondary model judges a detection: that of its own source for its class, else the other source's; null: none."""
    if not hierarchical:
        return F.lit(None).cast("string")
    has = lambda kind, classes: F.when(cls.isin(*classes), F.concat(F.lit(f"{kind}:"), cls)) if classes else F.lit(None).cast("string")
    s, m = has("static", static), has("motion", motion)
    routed = F.when(source == "static", F.coalesce(s, m)).otherwise(F.coalesce(m, s))
    return F.when(~cls.isin(*ignored), routed) if ignored else routed


def annotation_route(cls: Column, static: list[str], motion: list[str]) -> Column:
    """Which secondary model judges a box when frames are annotated automatically: the static model of its class for boxes of
    either source, the motion models only where there are fewer than two static secondary classes; null: none."""
    kind = "static" if len(static) >= 2 else "motion" if len(motion) >= 2 else None
    return F.concat(F.lit(f"{kind}:"), cls) if kind else F.lit(None).cast("string")


def classify(detections: DataFrame, models: dict[str, Callable[[pd.DataFrame], pd.DataFrame]], route: Column) -> DataFrame:
    """Add secondary_class and secondary_conf from the routed model; unrouted rows keep their own class at 1.0.

    A model gets rows and returns columns secondary_class and secondary_conf of the same length. No threshold applies.
    """
    routed = detections.withColumn("route", route)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["secondary_class"], pdf["secondary_conf"] = pdf["cls"], 1.0
            for name, part in pdf.groupby("route"):
                if name in models:
                    made = models[name](part)
                    pdf.loc[part.index, "secondary_class"] = made["secondary_class"].to_numpy()
                    pdf.loc[part.index, "secondary_conf"] = made["secondary_conf"].to_numpy()
            yield pdf

    fields = ", ".join(f"`{c}` {k}" for c, k in routed.dtypes)
    return routed.mapInPandas(run, f"{fields}, secondary_class string, secondary_conf double").drop("route")
