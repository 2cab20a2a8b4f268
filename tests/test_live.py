"""The live path: streams cut anywhere against whole tables; cameras read by tasks; recordings; gates in event time."""

import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethospark.operators import detect, geometry, motion, tracking
from ethospark.plans import views as V
from ethospark.sources import frames as video_frames
from ethospark.sources import readers
from ethospark.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, live.ROCKSDB)
    yield spark
    spark.conf.set(key, old)


def files(folder, parts):
    """JSON files that a stream takes in this order."""
    folder.mkdir(exist_ok=True)
    for i, rows in enumerate(parts):
        path = folder / f"{i:04}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def run(stream, name, checkpoint):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return q


def cut(rows, places):
    return [rows[a:b] for a, b in zip([0, *places], [*places, len(rows)])]


@pytest.mark.parametrize("exponential", [False, True])
def test_motion_stream_equals_table(rocks, tmp_path, exponential):
    rows = V.grey(rocks, SF).filter("video < 3").orderBy("frame").toPandas()
    parts = cut([{"video": str(v), "frame": f, "px": [int(x) for x in p]} for v, f, p in zip(rows["video"], rows["frame"], rows["px"])], [1, 2, 50, 53, 90])
    for part in parts:
        random.Random(1).shuffle(part)
    stream = rocks.readStream.schema("video string, frame long, px array<int>").option("maxFilesPerTrigger", 1).json(files(tmp_path / "in", parts))
    colour = {"lum": 0.7, "multipliers": (2.0, 3.0, 4.0), "threshold": 5}
    run(live.motion_stream(stream, exponential, 0.3, 0.9, **colour), f"motion{exponential}".lower(), tmp_path / "ck")
    got = {(r["video"], r["frame"]): tuple(map(tuple, r[2:])) for r in rocks.sql(f"select video, frame, d0, d1, d2, blue, green, red from motion{exponential}".lower()).collect()}
    table = V.grey(rocks, SF).filter("video < 3")
    made = motion.exponential_walk(table, 0.3, 0.9) if exponential else motion.sequential_differences(table)
    want = {(str(r["video"]), r["frame"]): tuple(map(tuple, r[2:])) for r in motion.false_colour(made, **colour).select("video", "frame", "d0", "d1", "d2", "blue", "green", "red").collect()}
    assert len(want) == 150 and got == want


def test_late_frames_are_counted(rocks, tmp_path):
    row = lambda f: {"video": "a", "frame": f, "px": [f % 256] * 4}
    parts = [[row(1), row(5)], [row(2), row(3), row(6)], [row(6), row(4), row(7), {"video": "b", "frame": 1, "px": [1, 2]}]]
    stream = rocks.readStream.schema("video string, frame long, px array<int>").option("maxFilesPerTrigger", 1).json(files(tmp_path / "in", parts))
    run(live.motion_stream(stream), "late_motion", tmp_path / "ck")
    got = {(r["video"], r["frame"]): r["late"] for r in rocks.table("late_motion").collect()}
    assert got == {("a", 1): 0, ("a", 5): 0, ("a", 6): 2, ("a", 7): 4, ("b", 1): 0}
    det = lambda f: {"video": "a", "frame": f, "det": 0, "x": 1.0 * f, "y": 1.0}
    stream = rocks.readStream.schema("video string, frame long, det long, x double, y double").option("maxFilesPerTrigger", 1).json(files(tmp_path / "det", [[det(1), det(5)], [det(2), det(3), det(3), det(6)], [det(7)]]))
    run(live.track_stream(stream, count_late=True), "late_tracks", tmp_path / "ck2")
    assert {r["frame"]: r["late"] for r in rocks.table("late_tracks").collect()} == {1: 0, 5: 0, 6: 2, 7: 2}


def test_late_rows_of_windows(spark, tmp_path):
    at = lambda s: {"video": "a", "ts": f"2024-01-01T00:{s // 60:02}:{s % 60:02}Z"}
    stream = spark.readStream.schema("video string, ts timestamp").option("maxFilesPerTrigger", 1).json(files(tmp_path / "in", [[at(100)], [at(300)], [at(1), at(20), at(400)]]))
    q = run(live.frame_rate(stream, "10 seconds", "10 seconds"), "rates", tmp_path / "ck")
    assert live.late_rows(q) == 2


def y4m(path, n, width=6, height=4):
    rng = np.random.default_rng(7)
    images = rng.integers(0, 256, (n, height, width), dtype=np.uint8)
    path.write_bytes(f"YUV4MPEG2 W{width} H{height} F25:1 Cmono\n".encode() + b"".join(b"FRAME\n" + i.tobytes() for i in images))
    return images


def test_camera_is_read_by_tasks(spark, tmp_path):
    cams = tmp_path / "cams"
    cams.mkdir()
    y4m(cams / "a.y4m", 25)
    seen = []
    stream = readers.camera(spark, str(cams), framesPerBatch=20, framesPerPartition=5, progress=str(tmp_path / "progress")).select("video", "frame", "px", F.spark_partition_id().alias("part"))
    take = lambda df, n: seen.append((n, df.collect()))
    q = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "ck")).start()
    wait = lambda n: any(sum(len(r) for _, r in seen) >= n or time.sleep(0.2) for _ in range(150))
    try:
        assert wait(25)
        y4m(cams / "b.y4m", 7)
        assert wait(32)
    finally:
        q.stop()
    assert [len(r) for _, r in seen] == [20, 5, 7]
    assert len({r["part"] for r in seen[0][1]}) == 4
    q = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:  # after a restart, only what is new
        y4m(cams / "b.y4m", 9)
        assert wait(34)
    finally:
        q.stop()
    rows = [(r["video"], r["frame"]) for _, part in seen for r in part]
    assert sorted(rows) == [("a.y4m", f) for f in range(1, 26)] + [("b.y4m", f) for f in range(1, 10)]


def test_camera_offsets(tmp_path):
    images = y4m(tmp_path / "a.y4m", 12)
    reader = video_frames.CameraReader(reader_options(tmp_path, progress=str(tmp_path / "p")))
    start, path = reader.initialOffset(), str(tmp_path / "a.y4m")
    ends = []
    for _ in range(4):
        end = reader.latestOffset()
        parts = reader.partitions(start, end)
        rows = [r for p in parts for r in reader.read(p)]
        assert rows == [r for p in video_frames.CameraReader(reader_options(tmp_path)).partitions(start, end) for r in reader.read(p)]
        assert [r[4] for r in rows] == [i.tobytes() for i in images[start.get(path, 0) : end[path]]]
        ends.append((end[path], len(parts)))
        if len(ends) == 2:  # stopped before the second batch was committed
            reader = video_frames.CameraReader(reader_options(tmp_path, progress=str(tmp_path / "p")))
            assert reader.latestOffset() == end
        reader.commit(end)
        start = end
    assert ends == [(5, 3), (10, 3), (12, 1), (12, 0)]
    os.remove(path)
    assert reader.latestOffset() == {path: 12}
    again = video_frames.CameraReader(reader_options(tmp_path))
    y4m(tmp_path / "b.y4m", 3)
    assert again.latestOffset() == {str(tmp_path / "b.y4m"): 3}


def reader_options(folder, **more):
    return {"path": str(folder), "framesPerBatch": "5", "framesPerPartition": "2", **more}


def plain_resize(image, height, width, ry, rx):
    h, w = image.shape
    out = np.zeros((height, width), int)
    for i in range(height):
        for j in range(width):
            y, x = min(max((i + 0.5) * ry - 0.5, 0), h - 1), min(max((j + 0.5) * rx - 0.5, 0), w - 1)
            a, b = int(y), int(x)
            c, d = min(a + 1, h - 1), min(b + 1, w - 1)
            top = image[a, b] * (1 - (x - b)) + image[a, d] * (x - b)
            low = image[c, b] * (1 - (x - b)) + image[c, d] * (x - b)
            out[i, j] = int(top * (1 - (y - a)) + low * (y - a) + 0.5)
    return out


@pytest.mark.parametrize("scale", [0.5, 1.5, 2.0, 0.1])
def test_scale_of_a_reader(spark, tmp_path, scale):
    images = y4m(tmp_path / "a.y4m", 3, 7, 5)
    rows = readers.y4m_frames(spark, str(tmp_path), scale=scale).orderBy("frame").collect()
    width, height = max(1, round(7 * scale)), max(1, round(5 * scale))
    for r, image in zip(rows, images):
        assert (r["width"], r["height"]) == (width, height)
        assert np.array_equal(np.frombuffer(r["px"], np.uint8).reshape(height, width), plain_resize(image.astype(float), height, width, 1 / scale, 1 / scale))


def test_resized_columns_equal_arrays(spark):
    image = np.random.default_rng(2).integers(0, 256, (5, 7))
    df = spark.createDataFrame([(image.ravel().tolist(),)], "px array<int>")
    for height, width in ((5, 7), (3, 4), (11, 9), (1, 1)):
        got = np.array(df.select(motion.resized(F.col("px"), 7, 5, width, height)).first()[0]).reshape(height, width)
        assert np.array_equal(got, plain_resize(image.astype(float), height, width, 5 / height, 7 / width))
        assert np.array_equal(got, video_frames.resized(image.astype(np.uint8), height, width))


def test_masks_by_differences(spark):
    r = random.Random(3)
    for width, height in ((8, 8), (1, 5), (7, 3)):
        px = [r.randrange(256) for _ in range(width * height)]
        boxes = [(r.randint(-3, width), r.randint(-3, height), r.randint(-3, width + 3), r.randint(-3, height + 3)) for _ in range(6)]
        df = spark.createDataFrame([(px, boxes), (None, boxes), (px, None), (px, [])], "px array<int>, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
        got = [x[0] for x in df.select(motion.masked(F.col("px"), width, F.col("boxes"), 128)).collect()]
        want = [128 if any(a <= i % width <= c and b <= i // width <= d for a, b, c, d in boxes) else v for i, v in enumerate(px)]
        assert got == [want, None, px, px]


def test_windows_in_one_walk(spark, monkeypatch):
    r = random.Random(5)
    frames = [(v, f, [r.randrange(256) for _ in range(4)]) for v in "ab" for f in range(60) if r.random() > 0.1]
    table = spark.createDataFrame(frames, "video string, frame long, px array<int>").repartition(4)
    targets = spark.createDataFrame([(v, f) for v in "abc" for f in range(0, 62, 1 if v == "a" else 7)], "video string, target long")
    monkeypatch.setattr(motion, "STRETCH", 10)
    for window, skip in ((1, 0), (4, 0), (3, 2), (6, 1)):
        series = motion.window_ending_at(table, targets, window, skip).select(F.struct("video", "target").alias("video"), "frame", "px")
        for exponential in (False, True):
            old = motion.exponential_differences(series).join(series, ["video", "frame"]) if exponential else motion.sequential_differences(series)
            old = old.filter("frame = video.target").select("video.video", "video.target", "px", "d0", "d1", "d2")
            new = motion.windows_walk(table, targets, window, skip, exponential)
            key = lambda df: sorted(map(str, map(tuple, df.collect())))
            assert key(new) == key(old) and new.count() > 60
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_by_cells(spark):
    r = random.Random(6)
    place = lambda: (r.uniform(-2000, 2000), r.uniform(-2000, 2000))
    tracks = spark.createDataFrame([("v", 1, i, *place()) for i in range(300)] + [("v", 1, 300, 400.0, 0.0)], "video string, frame long, track long, tx double, ty double")
    dets = spark.createDataFrame([("v", 1, i, *place()) for i in range(300)] + [("v", 1, 300, 200.0, 0.0), ("v", 1, 301, None, 1.0)], "video string, frame long, det long, x double, y double")
    full = geometry.distances(tracks, dets)
    for gate in (200.0, 35.5):
        near = full.groupBy("det").agg(F.min(F.struct("distance", "track")).alias("m")).filter(F.col("m.distance") < gate)
        want = {x["det"]: x["m"]["track"] for x in near.collect()}
        got = {x["det"]: x["track"] for x in geometry.nearest_track(tracks, dets, gate).collect()}
        assert len(got) == 302 and {k: v for k, v in got.items() if v is not None} == want
    assert geometry.within(tracks, dets, 200.0).count() == full.filter("distance < 200").count() < full.count() / 50


def test_recordings_have_all_their_frames(spark):
    frames = spark.createDataFrame([(v, f, 1_700_000_000_000_000 + f * 500_000) for v in ("a", "b") for f in range(40)], "video string, frame long, us long")
    frames = frames.select("video", "frame", F.timestamp_micros("us").alias("ts"))
    seen = {"a": (2, 4, 10, 17, 30), "b": (39,)}
    dets = frames.filter(F.expr("(video = 'a' and frame in (2, 4, 10, 17, 30)) or (video = 'b' and frame = 39)")).select("video", "ts")
    want, active = [], None
    for v, at in seen.items():
        number, last = 0, None
        for f in range(40):
            if f in at:
                number += last is None
                last = f
            elif last is not None and (f - last) * 0.5 > 3.0:
                last = None
            if last is not None:
                want.append((v, f, number))
    for bin_seconds in (0.4, 3, 60):
        made = live.recordings(frames, dets, 3.0, bin_seconds)
        got = sorted((r["video"], r["frame"], r["recording"]) for r in made.collect())
        assert got == want
    assert "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.filter("recording = 1 and video = 'a'").agg(F.max("place")).first()[0] == 22



@pytest.mark.parametrize("seed", [1, 2])
def test_gate_in_event_time(rocks, tmp_path, seed):
    """Rows and switches in any order within the watermark decide as the whole table does."""
    r = random.Random(seed)
    at = lambda s: f"2024-01-01T00:{int(s) // 60:02}:{s % 60:09.6f}Z"
    rows = [{"video": r.choice("ab"), "ts": at(r.randrange(4000) / 10), "n": i, "x": r.choice([None, 1.5]), "raw": "q"} for i in range(150)]
    switches = [{"video": r.choice("ab"), "ts": at(r.randrange(400)), "enabled": r.random() < 0.5} for _ in range(25)]
    late = lambda part: sorted(part, key=lambda x: x["ts"][14:] + str(x))
    seconds = lambda x: int(x["ts"][14:16]) * 60 + float(x["ts"][17:-1])
    arrival = lambda part: sorted(part, key=lambda x: seconds(x) + r.uniform(0, 25))
    end = {"video": "a", "ts": at(3000.0), "n": -1, "x": None, "raw": None}
    stop = [{"video": v, "ts": at(2900.0), "enabled": False} for v in "ab"]
    chunks = lambda part, n: cut(part, [len(part) * k // n for k in range(1, n)])
    kind, skind = "video string, ts timestamp, n long, x double, raw string", "video string, ts timestamp, enabled boolean"
    ordered_rows, ordered_switches = arrival(rows), arrival(switches)
    one = rocks.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(files(tmp_path / "rows", chunks(ordered_rows, 4) + [[end], [end | {"ts": at(3100.0)}]]))
    two = rocks.readStream.schema(skind).option("maxFilesPerTrigger", 1).json(files(tmp_path / "switches", chunks(ordered_switches, 4) + [stop, stop]))
    q = run(live.gated_stream(one, two, "300 seconds"), f"gate{seed}", tmp_path / "ck")
    assert live.late_rows(q) == 0
    got = sorted(tuple(x) for x in rocks.sql(f"select n, x is null, raw, ts, video from gate{seed} where n >= 0").collect())
    table = live.gated(rocks.read.schema(kind).json(str(tmp_path / "rows")), rocks.read.schema(skind).json(str(tmp_path / "switches")))
    want = sorted(tuple(x) for x in table.filter("n >= 0").selectExpr("n", "x is null", "raw", "ts", "video").collect())
    assert got == want and 20 < len(got) < 150 and late(rows)


def moving_spots(size):
    """The box of the pixels that the red plane marks, a stand-in for a model on motion images."""

    def run(pdf):
        return detect.bright_spots(size, 150)(pdf.assign(px=pdf["red"])).assign(cls="move")

    return run


def test_live_loop_equals_table(rocks, tmp_path):
    """Frames to tracks in one streaming query, cut anywhere, against the operators on the whole table."""
    rows = V.grey(rocks, SF).filter("video < 2").orderBy("frame").toPandas()
    parts = cut([{"video": str(v), "frame": f, "px": [int(x) for x in p]} for v, f, p in zip(rows["video"], rows["frame"], rows["px"])], [3, 40, 41, 77])
    stream = rocks.readStream.schema("video string, frame long, px array<int>").option("maxFilesPerTrigger", 1).json(files(tmp_path / "in", parts))
    static, moving, merge = detect.bright_spots(8, 150), moving_spots(8), {"dominant": "motion", "distance": 3.0, "overlap": 0.9}
    colour = {"lum": 0.5, "multipliers": (2.0, 3.0, 4.0)}
    found = live.live_detections(stream, static, moving, 0.5, **merge, **colour)
    run(live.track_stream(found, 9.0), "live_loop", tmp_path / "ck")
    got = sorted(tuple(r) for r in rocks.sql("select video, frame, det, track_id from live_loop").collect())
    table = motion.false_colour(motion.sequential_walk(V.grey(rocks, SF).filter("video < 2").withColumn("video", F.col("video").cast("string"))), **colour)
    both = detect.detect(table, static, "static").unionByName(detect.detect(table, moving, "motion")).withColumn("det", F.when(F.col("source") == "static", 0).otherwise(1))
    here = geometry.merge(both, **merge).select("video", "frame", "det", ((F.col("x1") + F.col("x2")) / 2).cast("int").alias("x"), ((F.col("y1") + F.col("y2")) / 2).cast("int").alias("y"))
    want = tracking.track(tracking.with_frame_axis(here, table), 9.0).select("video", "frame", "det", "track_id")
    assert got == sorted(map(tuple, want.collect())) and len(got) > 100


def test_recording_stream_equals_table(rocks, tmp_path):
    r = random.Random(11)
    rows, at = [], 0.0
    for f in range(160):
        at += r.choice([0.2, 0.5, 2.0, 3.5])
        rows += [{"video": v, "frame": f, "ts": f"2024-01-01T00:{int(at) // 60:02}:{at % 60:09.6f}Z", "detected": r.random() < 0.2} for v in "ab"]
    kind = "video string, frame long, ts timestamp, detected boolean"
    stream = rocks.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(files(tmp_path / "in", cut(rows, [1, 2, 100, 103, 250])))
    run(live.recording_stream(stream, 3.0), "recorded", tmp_path / "ck")
    got = sorted(tuple(x) for x in rocks.sql("select video, frame, ts, recording, started, place from recorded").collect())
    table = rocks.read.schema(kind).json(str(tmp_path / "in"))
    want = live.recordings(table.select("video", "frame", "ts"), table.filter("detected"), 3.0).select("video", "frame", "ts", "recording", "started", "place")
    assert got == sorted(map(tuple, want.collect())) and 50 < len(got) < 300 and len({x[3] for x in got}) > 5
