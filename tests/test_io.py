"""Readers and writers round trip; configuration."""

import pytest
from pyspark.sql import functions as F

from ethospark import config
from ethospark.operators import augment, budget, dataset, motion, rebuild
from ethospark.plans import views as V
from ethospark.sources import readers, writers

SF = "/root/testdata/sf0.001"



def test_tracking_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 7, 1.0, 2.0, "walk", 0.1234), ("a", 2, 7, 1.0, 2.0, "", 0.0)], "video_filename string, frame int, id int, x double, y double, primary_motion_class string, primary_motion_conf double")
    writers.tracking(rows, str(tmp_path / "out"))
    (part,) = (tmp_path / "out" / "video_filename=a").glob("*.csv")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_tracking.csv").write_text(part.read_text())
    (tmp_path / "in" / "b_Training_tracking.csv").write_text(part.read_text())
    back = readers.tracking(spark, str(tmp_path / "in"))
    assert {r["stem"] for r in back.collect()} == {"a"}
    assert "0.123" in part.read_text()
    got = budget.tracking_rows(back.withColumnRenamed("stem", "video_filename")).collect()
    assert sorted((r["frame"], r["behaviour"]) for r in got) == [(1, "walk"), (2, "unknown")]


def test_metadata_absent(spark, tmp_path):
    assert readers.group_metadata(spark, str(tmp_path / "none.csv")).count() == 0


def test_labels_masks_crops(spark, tmp_path):
    (tmp_path / "v_1.txt").write_text("1 0.5 0.5 0.1 0.1\nbad\n2 0.1 0.1 0.2 0.2 9\n")
    (tmp_path / "v_1.mask.txt").write_text("1 2 3 4\n1 2 3 4 5\n")
    crop = tmp_path / "crops" / "cat" / "run"
    crop.mkdir(parents=True)
    (crop / "v_1_10_20.jpg").write_bytes(b"x")
    assert sorted(r["cls"] for r in readers.labels(spark, str(tmp_path)).collect()) == [1, 2]
    assert len(readers.masks(spark, str(tmp_path)).first()["boxes"]) == 2
    assert len(readers.masks(spark, str(tmp_path), strict=True).first()["boxes"]) == 1
    (r,) = readers.crops(spark, str(tmp_path / "crops")).collect()
    assert (r["cls"], r["secondary"], r["video"], r["frame"], r["x1"], r["y1"]) == ("cat", "run", "v", 1, 10, 20)
    assert readers.image_counts(spark, str(tmp_path / "crops")).first()["images"] == 1


def test_videos_and_frames(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for d in (tmp_path, tmp_path / "sub"):
        (d / "a.mp4").write_bytes(b"1")
    (r,) = readers.files(spark, str(tmp_path)).collect()
    assert r["stem"] == "a" and "/sub/" in r["path"]
    frame = b"FRAME\n" + bytes(range(6)) + bytes(4)
    (tmp_path / "m.y4m").write_bytes(b"YUV4MPEG2 W3 H2 F30:1 C420\n" + frame + frame)
    got = readers.y4m_frames(spark, str(tmp_path)).orderBy("frame").collect()
    assert [(g["frame"], bytes(g["px"])) for g in got] == [(1, bytes(range(6))), (2, bytes(range(6)))]


def test_label_writer_and_reports(spark, tmp_path):
    boxes = spark.createDataFrame([("v_1", 0, 3, 10, 20, 30, 40)], "basename string, det int, cls int, x1 int, y1 int, x2 int, y2 int")
    lines = writers.label_lines(boxes, 100, 100, offset=2)
    assert lines.first()["text"] == "1 0.200000 0.300000 0.200000 0.200000"
    writers.text_by_key(lines, str(tmp_path / "l"))
    masks = spark.createDataFrame([("v_1", [(1, 2, 3, 4)])], "basename string, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
    assert writers.mask_lines(masks).first()["text"] == "1 2 3 4"
    writers.report(boxes.filter("false"), str(tmp_path / "r"))
    assert next((tmp_path / "r").glob("*.csv")).read_text().startswith("basename,")
    frames = spark.createDataFrame([("v", 1, list(range(16)))], "video string, frame int, px array<int>")
    box = spark.createDataFrame([("v", 1, 1, 1, 3, 3, "cat", "run")], "video string, frame int, x1 int, y1 int, x2 int, y2 int, cls string, secondary string")
    writers.crops(box, frames, 4, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).first()["px"] == [5, 6, 9, 10]


def test_training_log(spark, tmp_path):
    (tmp_path / "results.csv").write_text("epoch,  metrics/precision(B) \n1, 0.5\n2, 0.6\n")
    log = readers.training_log(spark, str(tmp_path / "results.csv"))
    assert log.columns == ["epoch", "metrics/precision(B)"] and log.count() == 2


def test_settings(tmp_path):
    (tmp_path / "s.ini").write_text("[DEFAULT]\nprimary_motion_classes = walk, run\nsecondary_motion_classes = one\nexpA = 0.3\nrgb_multipliers = 1,2,3\nsave_empty_frames = true\nprimary_static_classes = 0\n[kalman]\nprocess_noise_pos = 0.5\n")
    s = config.read_ini(str(tmp_path / "s.ini"))
    assert s.primary_motion_classes == ("walk", "run") and s.secondary_motion_classes == () and s.primary_static_classes == ()
    assert (s.expA, s.rgb_multipliers, s.save_empty_frames, s.process_noise_pos, s.expB) == (0.3, (1.0, 2.0, 3.0), True, 0.5, 0.8)
    assert s.updated(expB=0.9).expA == 0.3
    with pytest.raises(ValueError):
        config.Settings(strategy="other")
    config.write_dataset_yaml(str(tmp_path / "d.yaml"), "t", "v", ["a", "b"])
    assert config.read_class_map(str(tmp_path / "d.yaml")) == {"a": 0, "b": 1}
    assert config.resolve_path("/p", " ", "clips") == "/p/clips" and config.resolve_path("/p", "/q", "clips") == "/q"


def test_plan_is_reproducible(spark):
    items = V.table(spark, SF, "documents").select(F.col("doc_id").cast("string").alias("basename"))
    params = spark.createDataFrame([("blur", 1.0, [("range", 3.0, 7.0)], True), ("hue", 1.0, [("range", 0.0, 5.0)], False)], "parameter string, probability double, segments array<struct<kind:string,lo:double,hi:double>>, whole boolean")
    a, b = (augment.plan(items.repartition(n), params, 0.5, seed=3).collect() for n in (1, 4))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and 0 < len(a)
    assert all(r["value"] % 2 == 1 for r in a if r["parameter"] == "blur")
    motion = augment.plan(items, params, 1.0, motion=True)
    assert {r["parameter"] for r in motion.select("parameter").distinct().collect()} == {"blur"}


def test_dataset_helpers(spark):
    pool = dataset.frame_pool(spark.createDataFrame([("a", 40), ("b", 11)], "video string, n_frames long"), 10)
    assert [r["frame"] for r in pool.orderBy("frame").collect()] == list(range(9, 38))
    assert dataset.pick(pool, 1).first() == dataset.pick(pool.repartition(5), 1).first()
    counts = spark.createDataFrame([("m", 3, 3), ("n", 3, None)], "model string, images int, recorded int")
    assert [r["retrain"] for r in dataset.needs_training(counts).orderBy("model").collect()] == [False, True]
    items = spark.range(1000).select(F.col("id").cast("string").alias("basename"))
    assert 50 < dataset.split_by_key(items, 0.1).filter("split = 'val'").count() < 150
    files = spark.createDataFrame([("label", "a"), ("label", "b")], "kind string, name string")
    assert dataset.remaining(files, files.filter("name = 'a'")).count() == 1


def test_names_and_classes():
    assert config.project_problems("a/b") and config.project_problems(" ") and config.project_problems("x", ("X",)) and not config.project_problems("fine")
    assert config.class_problems(config.Settings()) and not config.class_problems(config.Settings(primary_static_classes=("a",)))
    assert config.class_problems(config.Settings(primary_static_classes=("a",), secondary_static_classes=("b",)))


def model_motion(frames, target, window, skip, a, b):
    at = list(range(target, -1, -skip - 1))[:window][::-1]
    last = ea = eb = frames[at[0]]
    for f in at:
        d = [[abs(x - y) for x, y in zip(frames[f], m)] for m in (last, ea, eb)]
        held = lambda m, w: [max(0, min(255, round(w * e + (1.0 - w) * g))) for e, g in zip(m, frames[f])]  # noqa: E731, B023
        last, ea, eb = frames[f], held(ea, a), held(eb, b)
    mix = lambda x, m: [max(0, min(255, round(g * 0.7 + v * m - 0.0))) for g, v in zip(frames[target], x)]
    return mix(d[0], 2.0), mix(d[1], 2.0), mix(d[2], 2.0)


def test_rebuild_equals_model(spark):
    import random

    r = random.Random(1)
    data = {f: [r.randrange(256) for _ in range(6)] for f in range(30)}
    frames = spark.createDataFrame([("a", f, px) for f, px in data.items()], "video string, frame long, px array<int>")
    keys = spark.createDataFrame([("a_20", "train", "motion"), ("a_7", "val", "motion"), ("b_1", "val", "motion"), ("a_9_aug_blur", "val", "motion")], "basename string, split string, stream string")
    found = rebuild.items(keys, keys)
    assert found.count() == 3
    clips = spark.createDataFrame([("a.MP4", "/x/a.MP4"), ("a.mp4", "/y/a.mp4"), ("ab.mp4", "/z")], "name string, path string")
    assert {r["path"] for r in rebuild.with_clips(found, clips).collect()} == {"/y/a.mp4"}
    for exponential in (True, False):
        made = {r["frame"]: r for r in rebuild.motion_images(found, frames, 5, 1, exponential).collect()}
        assert set(made) == {20, 7}
    made = {r["frame"]: r for r in rebuild.motion_images(found, frames, 5, 1).collect()}
    for target in (20, 7):
        assert (made[target]["blue"], made[target]["green"], made[target]["red"]) == model_motion(data, target, 5, 1, 0.5, 0.8)
    masks = spark.createDataFrame([("a_7", [(0, 0, 0, 0)])], "basename string, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
    blocks = spark.createDataFrame([("a_7", 2, 1, 2, 1)], "basename string, x1 int, y1 int, x2 int, y2 int")
    images = spark.createDataFrame([("a_7", [1, 2, 3, 4, 5, 6]), ("a_8", [1] * 6)], "basename string, px array<int>")
    got = dict(rebuild.blocked(images, masks, blocks, 3).collect())
    assert got == {"a_7": [128, 2, 3, 4, 5, 128], "a_8": [1] * 6}
    assert rebuild.unannotated_items(frames.select("video", "frame"), found).count() == 28
    boxes = "video string, frame long, x1 int, y1 int, x2 int, y2 int, cls string, conf double, source string"
    one, two = (spark.createDataFrame([("v", 1, 0, 0, 10, 10, "a", c, k)], boxes) for c, k in ((0.5, "static"), (0.9, "motion")))
    assert [r["source"] for r in rebuild.auto_annotate(one, two).collect()] == ["motion"]


def test_walk_equals_fold(spark):
    grey = V.grey(spark, SF)
    fold, walk = motion.exponential_differences(grey), motion.exponential_walk(grey.repartition(3))
    assert sorted(map(tuple, fold.collect())) == sorted(map(tuple, walk.select(*fold.columns).collect()))


def test_exp_frame_diff_collects_no_video(spark):
    from ethospark.plans.queries import QUERIES

    plan = QUERIES["exp_frame_diff"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan
