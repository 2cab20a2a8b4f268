"""Readers by header, listings, frame sources, streaming sinks and joins."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from ethospark.functions import exprs as X
from ethospark.operators import budget, dataset, detect, rebuild, tracking
from ethospark.sources import frames, readers, writers
from ethospark.streaming import live


def test_tracking_files_by_their_own_headers(spark, tmp_path):
    (tmp_path / "a_tracking.csv").write_text("frame,id,x,y,primary_motion_class,primary_motion_conf\n1,7,1.5,2.5,walk,0.9\n2,7,1,2,run,0.8\n")
    (tmp_path / "b_tracking.csv").write_text("\ufeffid,frame,extra,y,x,primary_static_class,primary_static_conf\n8,3,zz,2,1,graze,0.7\n")
    (tmp_path / "c_tracking.csv").write_text('frame,id,x,y\n4,9,5,"6"\nbad,9,1,1\n5,9\n')
    (tmp_path / "d_tracking.csv").write_text("x,y\n1,2\n")
    (tmp_path / "e_Training_tracking.csv").write_text("frame,id,x,y\n1,1,1,1\n")
    (tmp_path / "other.csv").write_text("frame,id,x,y\n1,1,1,1\n")
    got = {(r["stem"], r["frame"]): r for r in readers.tracking(spark, str(tmp_path)).collect()}
    assert set(got) == {("a", "1"), ("a", "2"), ("b", "3"), ("c", "4"), ("c", "bad"), ("c", "5")}
    b = got["b", "3"]
    assert (b["id"], b["x"], b["y"], b["primary_static_class"], b["primary_motion_class"]) == ("8", "1", "2", "graze", None)
    assert got["a", "1"]["row_no"] < got["a", "2"]["row_no"] and got["c", "4"]["y"] == "6"
    rows = budget.tracking_rows(readers.tracking(spark, str(tmp_path)).withColumnRenamed("stem", "video_filename")).collect()
    assert sorted((r["video_filename"], r["frame"], r["behaviour"]) for r in rows) == [("a", 1, "walk"), ("a", 2, "run"), ("b", 3, "graze"), ("c", 4, "unknown")]


def test_existence_probe(spark, tmp_path):
    project = str(tmp_path)
    assert not readers.has_annotations(spark, project)
    deep = tmp_path / "annot_static" / "labels" / "val" / "sub"
    deep.mkdir(parents=True)
    (deep / ".hidden").write_text("")
    (tmp_path / "annot_static" / "other.txt").write_text("x")
    assert not readers.has_annotations(spark, project)
    (deep / "v_1.txt").write_text("x")
    assert readers.has_annotations(spark, project)


def test_dataset_counts(spark, tmp_path):
    for f in ("t/a.JPG", "t/b.tiff", "t/notes.txt", "s/cat/a.png", "s/cat/b.bmp", "s/dog/c.jpg", "s/dog/d.txt", "s/loose.jpg"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x")
    (tmp_path / "list.txt").write_text("a.jpg\nb.jpg\nc.jpg\n")
    for name, train in (("d", "t"), ("l", "list.txt"), ("none", "absent"), ("abs", str(tmp_path / "t"))):
        (tmp_path / f"{name}.yaml").write_text(f"train: {train}\n")
    (tmp_path / "empty.yaml").write_text("names: [a]\n")
    count = lambda p: readers.dataset_count(spark, str(tmp_path / p))
    assert [count(p) for p in ("d.yaml", "l.yaml", "none.yaml", "abs.yaml", "empty.yaml", "s")] == [2, 3, 0, 2, 0, 3]


def test_listings(spark, tmp_path):
    for f in ("b/z.mp4", "b/a.MP4", "a/z.mp4", "a/n.txt"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_text("x")
    found = readers.videos_in_order(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 2)[1:] for r in found.collect()] == [["a", "z.mp4"], ["b", "a.MP4"], ["b", "z.mp4"]]
    odd = {"/a/./b//c": "/a/b/c", "/a/b/../../c": "/c", "../x/..": "..", "s3://bucket/a/../b": "s3://bucket/b", "file:///a//b": "file:///a/b", "a": "a", "../../z": "../../z"}
    df = spark.createDataFrame([(k,) for k in odd], "path string")
    assert {r[0]: r[1] for r in df.select("path", X.normalised_path(F.col("path"))).collect()} == odd
    runs = spark.createDataFrame([("/r/1", 5), ("/r/2", 9), ("/r/3", 9)], "path string, modificationTime int")
    assert dataset.newest(runs).first()["path"] == "/r/3" and dataset.newest(runs.filter("false")).count() == 0
    items = spark.createDataFrame([("b_1",), ("a_2",), ("b_1",)], "basename string")
    assert [r[0] for r in dataset.sorted_basenames(items).collect()] == ["a_2", "b_1"]


def video(path, n, w=3, h=2):
    head = f"YUV4MPEG2 W{w} H{h} F30:1 C420\n".encode()
    path.write_bytes(head + b"".join(b"FRAME\n" + bytes([i] * (w * h)) + bytes(2 * ((w + 1) // 2) * ((h + 1) // 2)) for i in range(1, n + 1)))


def test_frames_in_parts(spark, tmp_path):
    video(tmp_path / "a.y4m", 25)
    (tmp_path / "sub").mkdir()
    video(tmp_path / "sub" / "b.y4m", 4)
    df = readers.y4m_frames(spark, str(tmp_path), framesPerPartition=10)
    assert df.rdd.getNumPartitions() == 4
    assert sorted((r["video"], r["frame"], r["px"][0]) for r in df.collect()) == [*(("a.y4m", i, i) for i in range(1, 26)), *(("b.y4m", i, i) for i in range(1, 5))]
    part = readers.y4m_frames(spark, str(tmp_path / "a.y4m"), start=7, stop=12)
    assert [r["frame"] for r in part.orderBy("frame").collect()] == list(range(7, 12))
    (tmp_path / "bad.y4m").write_bytes(b"something else\n")
    with pytest.raises(ValueError):
        frames.layout(str(tmp_path / "bad.y4m"))


def test_camera_stream(spark, tmp_path):
    """A recording that appears late and grows while it is read."""
    path = tmp_path / "cam.y4m"
    threading.Timer(1.0, video, (path, 5)).start()
    q = readers.camera(spark, str(path), openSeconds=20).select("frame").writeStream.format("memory").queryName("cam").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        wait = lambda n: any(spark.table("cam").count() == n or time.sleep(0.3) for _ in range(100))
        assert wait(5)
        video(path, 9)
        assert wait(9)
    finally:
        q.stop()
    assert sorted(r["frame"] for r in spark.table("cam").collect()) == list(range(1, 10))


def test_stream_with_static_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"det": i, "cls": c}) for i, c in enumerate(("cat", "dog", "owl"))))
    classes = spark.createDataFrame([("cat", 0, "red"), ("dog", 1, "blue")], "cls string, id int, colour string")
    stream = spark.readStream.schema("det long, cls string").json(str(tmp_path / "in"))
    q = live.with_classes(stream, classes).writeStream.format("memory").queryName("classed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["det"], r["id"]) for r in spark.table("classed").collect()} == {(0, 0), (1, 1), (2, None)}


def test_write_gated_and_bins(spark, tmp_path):
    start = 1_700_000_040
    rows = spark.createDataFrame([("a", start + 10 * i, 1, "walk") for i in range(12)], "video string, t long, track_id long, behaviour string")
    rows = rows.select("video", F.timestamp_seconds("t").alias("ts"), "track_id", "behaviour")
    rows.write.parquet(str(tmp_path / "in"))
    control = spark.createDataFrame([("a", start + 20, True), ("a", start + 50, False)], "video string, t long, enabled boolean").select("video", F.timestamp_seconds("t").alias("ts"), "enabled")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    live.write_gated(stream, lambda: control, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    bins = live.budget_per_bin(rows).orderBy("started").collect()
    assert [r["frames"] for r in bins] == [6, 6]
    assert sum(r["n"] for r in live.frame_rate(rows, "10 seconds", "10 seconds").collect()) == 12


def test_ordered_reports(spark):
    rows = spark.createDataFrame(
        [("b", 1, f, 1.0, 1.0, "walk", f) for f in range(1, 40)] + [("a", k, f, 1.0, 1.0, "walk", f) for k in (3, 2) for f in range(1, 3 if k == 2 else 90)],
        "video_filename string, track_id long, frame long, x double, y double, behaviour string, row_no long",
    )
    got = [(r["video_filename"], r["individual_type"], r["track_id"]) for r in budget.individual_budget(rows, ordered=True).collect()]
    assert got == [("a", "group_member", 3), ("a", "stranger", 2), ("b", "group_member", 1)]
    rows = rows.withColumn("track_id", F.when(F.col("frame") < 3, F.col("frame")).otherwise(F.lit(9)))
    assert [(r["video_filename"], r["track_id"]) for r in budget.suspects(rows, ordered=True).collect()] == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_pruning_of_close_tracks(spark):
    """Of a chain of tracks, each close to the next, only the first stays."""
    t = tracking.Tracker(100, 5, prune=True)
    assert t.update([(0, 0), (400, 0)]) == {0: 1, 1: 2}
    t.tracks[3], t.tracks[4] = (tracking.Track(t.tracks[1].state + [40 * k, 0, 0, 0], t.tracks[1].cov, t.tracks[1].noise) for k in (1, 2))
    t._prune()
    assert sorted(t.tracks) == [1, 2]
    kind = "video string, frame long, det long, x double, y double"
    near = [("v", f, d, x, 5.0) for f in range(1, 8) for d, x in ((0, 100.0 + f), (1, 340.0 - 30 * f))]
    ids = lambda prune: {r["track_id"] for r in tracking.track(spark.createDataFrame(near, kind), gate=100, prune=prune).filter("frame = 7").collect()}
    assert ids(False) == {1, 2} and ids(True) == {1}


def test_label_files_of_both_streams(spark):
    boxes = spark.createDataFrame([("v_1", 0, 1, 0, 0, 10, 10), ("v_1", 1, 3, 10, 10, 20, 20), ("v_2", 0, 2, 0, 0, 10, 10)], "basename string, det int, cls int, x1 int, y1 int, x2 int, y2 int")
    got = {(r["stream"], r["basename"]): r["text"][0] for r in writers.label_lines_by_stream(boxes, 2, 100, 100).collect()}
    assert got == {("static", "v_1"): "1", ("motion", "v_1"): "1", ("motion", "v_2"): "0"}


def test_automatic_annotation_prefers_static_secondaries(spark):
    import pandas as pd

    kind = "video string, frame long, x1 int, y1 int, x2 int, y2 int, cls string, conf double, source string"
    one = spark.createDataFrame([("v", 1, 0, 0, 10, 10, "cat", 0.9, "static")], kind)
    two = spark.createDataFrame([("v", 1, 50, 0, 60, 10, "cat", 0.8, "motion"), ("v", 1, 90, 0, 99, 10, "owl", 0.7, "motion")], kind)
    says = lambda word: lambda p: pd.DataFrame({"secondary_class": [word] * len(p), "secondary_conf": [0.6] * len(p)})
    models = {"static:cat": says("still"), "motion:cat": says("moving")}
    got = rebuild.auto_annotate(one, two, models=models, secondary_static=("still", "lying"), secondary_motion=("a", "b")).collect()
    assert sorted((r["x1"], r["secondary_class"], r["secondary_conf"]) for r in got) == [(0, "still", 0.6), (50, "still", 0.6), (90, "owl", 1.0)]
    got = rebuild.auto_annotate(one, two, models=models, secondary_motion=("a", "b")).collect()
    assert {r["secondary_class"] for r in got} == {"moving", "owl"}
    assert rebuild.auto_annotate(one, two).count() == 3
    assert spark.range(1).select(detect.annotation_route(F.lit("cat"), ["x"], []).alias("r")).first()["r"] is None
