"""The live path on Structured Streaming: motion images and tracking per camera, recordings, rates, gated sinks.

``motion_stream`` and ``gated_stream`` keep keyed state with ``transformWithState``, for which Spark needs its RocksDB state
store: set ``spark.sql.streaming.stateStore.providerClass`` to ``ROCKSDB`` when the session is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import exprs as X
from ..operators import detect, geometry, motion
from ..operators.tracking import OUT, Tracker

STATE = "next_id bigint, last_frame bigint, late bigint, ids array<bigint>, missed array<int>, numbers array<double>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class MotionMemory(StatefulProcessor):
    """A camera's grey values that the next frame is compared with, as bytes: the last three frames, or the last and two
    exponential memories; and the last frame's number and how many frames came too late."""

    def __init__(self, exponential: bool, exp_a: float, exp_b: float):
        self.exponential, self.exp_a, self.exp_b = exponential, exp_a, exp_b

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("memory", "last bigint, late bigint, a binary, b binary, c binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        have = self.state.get() if self.state.exists() else None
        last, late, memory = (have[0], have[1], [np.frombuffer(bytes(m), np.uint8) for m in have[2:]]) if have else (None, 0, None)
        pdf = pd.concat(list(rows)).sort_values("frame")
        out = []
        for frame, px in zip(pdf["frame"], pdf["px"]):
            if last is not None and frame <= last:
                late += 1
                continue
            now = np.frombuffer(px, np.uint8) if isinstance(px, (bytes, bytearray)) else np.asarray(px, np.uint8)
            memory = memory or [now] * 3
            grey = now.astype(np.int32)
            out.append((key[0], frame, grey, *[np.abs(grey - m) for m in memory], late))
            if self.exponential:
                mixed = [motion.remembered(m.astype(float), now.astype(float), w).astype(np.uint8) for m, w in zip(memory[1:], (self.exp_a, self.exp_b))]
                memory = [now, *mixed]
            else:
                memory = [now, *memory[:2]]
            last = frame
        self.state.update((int(last), int(late), *[m.tobytes() for m in memory]))
        yield pd.DataFrame(out, columns=["video", "frame", "px", "d0", "d1", "d2", "late"])

    def close(self) -> None:
        pass


def motion_stream(frames: DataFrame, exponential: bool = False, exp_a: float = 0.5, exp_b: float = 0.8, **colour) -> DataFrame:
    """Motion images of a stream of grey frames (video, frame, px as bytes or numbers): px, d0, d1, d2 and the planes
    blue, green and red, equal to those of the whole table wherever it is cut into micro-batches.

    Inside a micro-batch frames are taken in order; frames up to the last one taken are late: they are dropped, and counted
    in ``late``, the number that the camera had lost when this frame was made.
    """
    rows = frames.select(F.col("video").cast("string").alias("video"), F.col("frame").cast("bigint").alias("frame"), "px").filter("px is not null and frame is not null")
    made = rows.groupBy("video").transformWithStateInPandas(
        MotionMemory(exponential, exp_a, exp_b),
        "video string, frame bigint, px array<int>, d0 array<int>, d1 array<int>, d2 array<int>, late bigint",
        "append",
        "None",
    )
    return motion.false_colour(made, **colour)


def track_stream(
    rows: DataFrame, gate: float = 200.0, max_missed: float = 5, noise=(0.01, 0.1, 0.1), prune: bool = False, count_late: bool = False
) -> DataFrame:
    """Identities of a stream of detections (video, frame, det, x, y), one state per video or camera.

    Inside a micro-batch frames are taken in order; frames up to the last one that was tracked are late and dropped.
    A frame must not be split over micro-batches. The state is the tracker's: its tracks end by misses, not by time.
    ``count_late`` adds a column ``late``, how many late frames the camera had lost when the row was made.
    """

    schema = OUT + ", late bigint" if count_late else OUT

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, last, late = Tracker(gate, max_missed, noise, prune), -1, 0
        if state.exists:
            next_id, last, late, ids, missed, numbers = state.get
            tracker.load(next_id, ids, missed, numbers)
        pdf = pd.concat(list(pdfs)).sort_values(["frame", "det"])
        out = []
        late += int(pdf.loc[pdf["frame"] <= last, "frame"].nunique())
        for frame, part in pdf[pdf["frame"] > last].groupby("frame", sort=True):
            part = part.dropna(subset=["det"])
            points = list(zip(part["x"], part["y"]))
            dets = part["det"].tolist()
            out += [(key[0], int(frame), int(dets[c]), *rest, *([late] if count_late else [])) for c, *rest in tracker.rows(points)]
            last = int(frame)
        next_id, ids, missed, numbers = tracker.dump()
        state.update((next_id, last, late, ids, missed, numbers))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    typed = rows.select(F.col("video").cast("string").alias("video"), F.col("frame").cast("bigint").alias("frame"), F.col("det").cast("double").alias("det"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return typed.groupBy("video").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def live_detections(
    frames: DataFrame, static: detect.Detector | None, moving: detect.Detector | None, threshold: float = 0.5,
    dominant: str = "confidence", distance: float = 50.0, overlap: float = 0.95, **motion_options,
) -> DataFrame:
    """Merged detections of a stream of grey frames: video, frame, det, x, y, box, classes; frames without any have a row of nulls.

    Motion images are made with keyed state, both detectors run on Arrow batches, and a frame's boxes are merged in its own
    row, so what follows can track them (:func:`track_stream`).
    """
    found = detect.detect_both(motion_stream(frames, **motion_options), static, moving, threshold)
    merged = geometry.merged_boxes(F.col("boxes"), dominant, distance, overlap)
    each = found.select("video", "frame", F.posexplode_outer(merged).alias("det", "m")).select("video", "frame", F.col("det").cast("bigint").alias("det"), "m.*")
    return geometry.stream_columns(each.withColumns({"x": X.centroid(F.col("x1"), F.col("x2")), "y": X.centroid(F.col("y1"), F.col("y2"))}))


def detection_sessions(detections: DataFrame, gap: str = "3 seconds 1 microsecond", late: str = "10 seconds") -> DataFrame:
    """Recordings: a session of detections of a camera ends when more than the gap passes without one."""
    return (
        detections.withWatermark("ts", late)
        .groupBy("video", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
        .drop("w")
    )


def late_rows(query) -> int:
    """Rows that a running or ended query has dropped behind its watermark, in the progress reports Spark still has.

    Where Spark sums before it drops, as in windows, a row here can stand for several of one group.
    """
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


#: Time that one bin of an interval join covers, in seconds.
BIN_SECONDS = 60


def recordings(frames: DataFrame, detections: DataFrame, gap_seconds: float = 3.0, bin_seconds: float = BIN_SECONDS) -> DataFrame:
    """Frames (video, ts, ...) of detection recordings: with recording (its number, from 1), started, stopped and place (from 1).

    A recording begins with a detection (video, ts) and ends at the first frame that comes more than the gap after the last
    one, so it has all frames from its first detection to the gap after its last, also those without detections. Frames and
    recordings are joined by the bins of time that they touch, so a frame meets the recordings of its own bin only.
    """
    from pyspark.sql import Window

    us, gap = F.unix_micros(F.col("ts").cast("timestamp")), round(gap_seconds * 1_000_000)
    width = max(1, round(bin_seconds * 1_000_000))
    seen = detections.select("video", us.alias("at")).filter("at is not null").distinct()
    both = seen.withColumn("det", F.lit(True)).unionByName(frames.select("video", us.alias("at"), F.lit(False).alias("det")))
    by_time = Window.partitionBy("video").orderBy("at")
    before = by_time.rangeBetween(Window.unboundedPreceding, -1)
    last = lambda wanted: F.max(F.when(wanted, F.col("at"))).over(before)
    begins = F.coalesce(last(~F.col("det")) > last(F.col("det")) + gap, last(F.col("det")).isNull()).cast("int")
    sessions = (
        both.withColumn("begins", begins)
        .filter("det")
        .withColumn("recording", F.sum("begins").over(by_time))
        .groupBy("video", "recording")
        .agg(F.min("at").alias("first"), (F.max("at") + gap).alias("end"))
    )
    bins = F.sequence(F.floor(F.col("first") / width), F.floor(F.col("end") / width))
    held = sessions.withColumn("_bin", F.explode(bins))
    shown = frames.withColumn("_at", us).withColumn("_bin", F.floor(F.col("_at") / width))
    found = shown.join(held, ["video", "_bin"]).filter(F.col("_at").between(F.col("first"), F.col("end")))
    place = F.row_number().over(Window.partitionBy("video", "recording").orderBy("_at", *[c for c in ("frame",) if c in frames.columns]))
    return found.withColumn("place", place.cast("bigint")).select(
        *frames.columns, F.col("recording").cast("bigint").alias("recording"), F.timestamp_micros("first").alias("started"), F.timestamp_micros("end").alias("stopped"), "place"
    )


def frame_rate(frames: DataFrame, width: str = "1 second", slide: str = "200 milliseconds", late: str = "2 seconds") -> DataFrame:
    """Frames of a camera in each sliding interval."""
    return frames.withWatermark("ts", late).groupBy("video", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select("video", F.col("w.start").alias("started"), "n")


def budget_per_bin(rows: DataFrame, width: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """Frames of each track and behaviour in tumbling intervals."""
    return (
        rows.withWatermark("ts", late)
        .groupBy("video", "track_id", "behaviour", F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("frames"))
        .select("video", "track_id", "behaviour", F.col("w.start").alias("started"), "frames")
    )


def with_classes(detections: DataFrame, classes: DataFrame, on: str = "cls") -> DataFrame:
    """A stream of detections with the columns of a class table, one row a class; other classes get nulls.

    Spark sends the class table if its size allows, else it deals both sides by class.
    """
    return detections.join(classes.dropDuplicates([on]), on, "left")


class Recorder(StatefulProcessor):
    """Whether a camera is recording: the number of its recording, when that began, its frames so far, and the last detection."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("recorder", "last bigint, late bigint, recording bigint, active boolean, began bigint, place bigint, seen bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, late, recording, active, began, place, seen = self.state.get() if self.state.exists() else (None, 0, 0, False, 0, 0, 0)
        pdf = pd.concat(list(rows)).sort_values("frame")
        out = []
        for frame, at, detected in zip(pdf["frame"].astype("int64"), pdf["at"].astype("int64"), pdf["detected"].astype(bool)):
            frame, at = int(frame), int(at)
            if last is not None and frame <= last:
                late += 1
                continue
            last = frame
            if detected:
                if not active:
                    recording, active, began, place = recording + 1, True, at, 0
                seen = at
            elif active and at - seen > self.gap:
                active = False
            if active:
                place += 1
                out.append((key[0], frame, at, recording, began, place, late))
        self.state.update((last, late, recording, active, began, place, seen))
        yield pd.DataFrame(out, columns=["video", "frame", "at", "recording", "began", "place", "late"])

    def close(self) -> None:
        pass


def recording_stream(frames: DataFrame, gap_seconds: float = 3.0) -> DataFrame:
    """:func:`recordings` of a stream of frames (video, frame, ts, detected), frame by frame: the recorded ones with recording, started,
    place, and ``late``, how many frames the camera had lost as they came after later ones."""
    rows = frames.select(
        F.col("video").cast("string").alias("video"), F.col("frame").cast("bigint").alias("frame"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("detected", F.lit(False)).alias("detected")
    ).filter("video is not null and frame is not null and at is not null")
    made = rows.groupBy("video").transformWithStateInPandas(
        Recorder(round(gap_seconds * 1_000_000)), "video string, frame bigint, at bigint, recording bigint, began bigint, place bigint, late bigint", "append", "None"
    )
    return made.select("video", "frame", F.timestamp_micros("at").alias("ts"), "recording", F.timestamp_micros("began").alias("started"), "place", "late")


def gated(rows: DataFrame, control: DataFrame) -> DataFrame:
    """Rows while recording is on: the last switch (video, ts, enabled) at or before a row decides, of equal times one that is on.

    An as-of join as one window over the union of rows and switches of a camera; for a micro-batch or a table.
    """
    from pyspark.sql import Window

    both = rows.withColumns({"_on": F.lit(None).cast("boolean"), "_row": F.lit(True)}).unionByName(
        control.select("video", "ts", F.col("enabled").alias("_on"), F.lit(False).alias("_row")), allowMissingColumns=True
    )
    w = Window.partitionBy("video").orderBy("ts", F.col("_row").cast("int"), "_on").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.coalesce(F.last("_on", ignorenulls=True).over(w), F.lit(False))
    return both.withColumn("_state", state).filter("_row and _state").select(*rows.columns)


class Gate(StatefulProcessor):
    """Rows wait until the watermark has passed them, when every switch that decides about them has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "at bigint, n bigint", "raw string")
        self.switches = handle.getMapState("switches", "at bigint", "enabled boolean")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.count.get()[0] if self.count.exists() else 0
        due = set()
        for pdf in rows:
            for at, enabled, raw in zip(pdf["at"].astype("int64"), pdf["enabled"], pdf["raw"]):
                at = int(at)
                if raw is None:
                    on = bool(enabled) or (self.switches.containsKey((at,)) and self.switches.getValue((at,))[0])
                    self.switches.updateValue((at,), (on,))
                else:
                    n += 1
                    self.rows.updateValue((at, n), (raw,))
                    due.add(-(-at // 1000))
        self.count.update((n,))
        for ms in due:
            self.handle.registerTimer(ms)
        yield pd.DataFrame({"video": [], "raw": []}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        switches = sorted((k[0], v[0]) for k, v in self.switches.iterator())
        ready = sorted((k, v[0]) for k, v in self.rows.iterator() if k[0] <= until)
        out, at, on = [], 0, False
        for place, raw in ready:
            while at < len(switches) and switches[at][0] <= place[0]:
                on, at = switches[at][1], at + 1
            if on:
                out.append((key[0], raw))
            self.rows.removeKey(place)
        for old, _ in [s for s in switches if s[0] <= until][:-1]:  # the last one still holds
            self.switches.removeKey((old,))
        yield pd.DataFrame(out, columns=["video", "raw"], dtype=object)

    def close(self) -> None:
        pass


def gated_stream(rows: DataFrame, control: DataFrame, late: str = "10 seconds") -> DataFrame:
    """:func:`gated` on two streams, rows (video, ts, ...) and switches (video, ts, enabled), in event time.

    Both may come in any order within ``late``; a row is decided once the watermark of both has passed it, and never
    again, so a micro-batch that is repeated decides the same. What comes later than that is dropped by Spark and counted by :func:`late_rows`.
    """
    raw = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    known = F.col("video").isNotNull() & F.col("ts").isNotNull()
    both = rows.filter(known).select("video", F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("boolean").alias("enabled"), raw.alias("raw"))
    switches = control.filter(known).select("video", F.col("ts").cast("timestamp").alias("ts"), "enabled", F.lit(None).cast("string").alias("raw"))
    told = both.unionByName(switches).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    kind = rows.schema["video"].dataType.simpleString()
    made = told.groupBy("video").transformWithStateInPandas(Gate(), f"video {kind}, raw string", "append", "EventTime")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    return made.select(F.from_json("raw", schema).alias("r")).select("r.*")


def write_gated(rows: DataFrame, control, path: str, checkpoint: str, **trigger):
    """Append a stream's rows to CSV while recording is on; ``control()`` gives the switches known so far."""

    def sink(batch: DataFrame, _: int) -> None:
        gated(batch, control()).write.mode("append").option("header", True).csv(path)

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
