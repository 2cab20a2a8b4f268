"""Tracker, merging and suppression against hand cases and independent models; batch against stream."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethospark.operators import detect, geometry, tracking
from ethospark.plans import views as V
from ethospark.streaming import live

SF = "/root/testdata/sf0.001"



def test_assignment_is_optimal():
    r = np.random.default_rng(1)
    for n, m in itertools.product(range(1, 5), range(1, 6)):
        c = r.random((n, m))
        got = sum(c[i, j] for i, j in tracking.assign(c))
        k = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert len(tracking.assign(c)) == k and got == pytest.approx(best)


def test_hand_case():
    t = tracking.Tracker(200, 5)
    assert t.update([(100, 100)]) == {0: 1}
    assert t.update([(110, 100), (500, 500)]) == {0: 1, 1: 2}
    for _ in range(5):
        assert t.update([]) == {}
    assert len(t.tracks) == 2
    t.update([])
    assert not t.tracks
    assert t.update([(110, 100)]) == {0: 3}


def test_shared_and_new_tracks():
    t = tracking.Tracker(200, 5)
    t.update([(100, 100)])
    assert set(t.update([(101, 100), (105, 100)]).values()) == {1}
    assert tracking.Tracker(200, 5).update([(0, 0), (5, 0)]) == {0: 1, 1: 2}


def test_state_round_trip():
    a = tracking.Tracker()
    for p in ([(1, 2), (300, 300)], [(2, 3)], [(4, 4), (310, 300)]):
        a.update(p)
    b = tracking.Tracker().load(*a.dump())
    assert a.rows([(5, 5), (320, 301)]) == b.rows([(5, 5), (320, 301)])


def walks(frames=30, n=3, videos=2):
    r = np.random.default_rng(3)
    for v in range(videos):
        at = r.random((n, 2)) * 900
        for f in range(1, frames + 1):
            at += r.normal(0, 4, at.shape)
            shown = [k for k in range(n) if (f + k + v) % 7]
            if f % 11 == 0:
                shown = []
            yield from ((f"v{v}", f, k, float(at[k, 0]), float(at[k, 1])) for k in shown) if shown else [(f"v{v}", f, None, None, None)]


KIND = "video string, frame long, det long, x double, y double"


def model(rows):
    out, trackers = [], {}
    for (v, f), part in itertools.groupby(sorted(rows, key=lambda r: r[:2]), key=lambda r: r[:2]):
        part = sorted(p for p in part if p[2] is not None)
        made = trackers.setdefault(v, tracking.Tracker()).rows([(p[3], p[4]) for p in part])
        out += [(v, f, part[c][2], i) for c, i, *_ in made]
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 5])
def test_batch_equals_model(spark, parts):
    rows = list(walks())
    got = tracking.track(spark.createDataFrame(rows, KIND).repartition(parts)).select("video", "frame", "det", "track_id").collect()
    assert sorted(map(tuple, got)) == model(rows)


def test_stream_equals_batch(spark, tmp_path):
    rows = list(walks())
    src = tmp_path / "in"
    src.mkdir()
    for i, cut in enumerate(((1, 10), (11, 11), (12, 30))):
        lines = [json.dumps(dict(zip(("video", "frame", "det", "x", "y"), r))) for r in rows if cut[0] <= r[1] <= cut[1]]
        (src / f"{i}.json").write_text("\n".join(lines))
        import os

        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(src))
    q = live.track_stream(stream).writeStream.format("memory").queryName("tracks").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = spark.sql("select video, frame, det, track_id from tracks").collect()
    assert sorted(map(tuple, got)) == model(rows)


def test_sessions_and_gate(spark, tmp_path):
    start = 1_700_000_000
    rows = [("a", start + s) for s in (0, 1, 4, 8, 20)]
    df = spark.createDataFrame(rows, "video string, t long").select("video", F.timestamp_seconds("t").alias("ts"))
    df.write.json(str(tmp_path / "s"))
    stream = spark.readStream.schema("video string, ts timestamp").json(str(tmp_path / "s"))
    q = live.detection_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["n"] for r in spark.sql("select n from sessions where n > 1").collect()] == [3]
    control = spark.createDataFrame([("a", start + 1, True), ("a", start + 8, False)], "video string, t long, enabled boolean")
    kept = live.gated(df, control.select("video", F.timestamp_seconds("t").alias("ts"), "enabled"))
    assert kept.count() == 2
    assert live.frame_rate(df).filter("n > 0").count() > 0


BOX = "video string, frame long, det long, x1 int, y1 int, x2 int, y2 int, cls string, conf double, source string"


def merged(spark, rows, **kw):
    df = spark.createDataFrame([("v", 1, i, *r) for i, r in enumerate(rows)], BOX)
    return [r.asDict() for r in geometry.stream_columns(geometry.merge(df, **kw)).collect()]


@pytest.mark.parametrize("mode,cls,other", [("confidence", "run", "cat"), ("motion", "run", "cat"), ("static", "cat", "")])
def test_merge_hand_case(spark, mode, cls, other):
    (m,) = merged(spark, [(0, 0, 20, 20, "cat", 0.6, "static"), (10, 10, 30, 30, "run", 0.8, "motion")], dominant=mode)
    assert (m["cls"], m["combined_cls"]) == (cls, other)


def test_merge_of_one_source(spark):
    (m,) = merged(spark, [(0, 0, 20, 20, "run", 0.6, "motion"), (5, 5, 25, 25, "sit", 0.7, "motion")])
    assert (m["primary_motion_class"], m["primary_static_class"], m["primary_static_conf"]) == ("sit", "run", 0.6)


def python_merge(rows, dominant, distance, overlap):
    def score(a, b):
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        area = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
        return w * h / area if area > 0 else 0.0

    out = []
    for d in sorted(rows, key=lambda r: (r["source"] != "static", r["det"])):
        box = [d[c] for c in ("x1", "y1", "x2", "y2")]
        for m in out:
            c = lambda b: ((b[0] + b[2]) // 2, (b[1] + b[3]) // 2)
            if np.hypot(c(box)[0] - c(m["box"])[0], c(box)[1] - c(m["box"])[1]) < distance or score(box, m["box"]) > overlap:
                same = dominant == "confidence" or d["source"] == m["source"]
                if d["conf"] > m["conf"] if same else d["source"] == dominant:
                    m.update(other=m["cls"], cls=d["cls"], conf=d["conf"], box=box, source=d["source"])
                break
        else:
            out.append({"box": box, "cls": d["cls"], "conf": d["conf"], "source": d["source"], "other": ""})
    return out


@pytest.mark.parametrize("mode", ["confidence", "static", "motion"])
def test_merge_equals_model(spark, mode):
    boxes = V.boxes(spark, SF)
    by = {}
    for r in boxes.collect():
        by.setdefault((r["video"], r["frame"]), []).append(r.asDict())
    want = sorted((*f, *m["box"], m["cls"], m["source"], m["other"]) for f, rows in by.items() for m in python_merge(rows, mode, 12.0, 0.6))
    got = geometry.merge(boxes, mode, 12.0, 0.6).select("video", "frame", "x1", "y1", "x2", "y2", "cls", "source", "combined_cls").collect()
    assert sorted(map(tuple, got)) == want


def test_suppression_hand_case(spark):
    rows = [(0, 0, 10, 10, "a", 0.9), (2, 2, 8, 8, "b", 0.8), (5, 0, 15, 10, "c", 0.7)]
    df = spark.createDataFrame([("v", 1, i, *r, "static") for i, r in enumerate(rows)], BOX)
    once = geometry.suppress(df)
    assert sorted(r["cls"] for r in once.collect()) == ["a", "c"]
    assert sorted(map(tuple, geometry.suppress(once).collect())) == sorted(map(tuple, once.collect()))


def test_detector_and_routing(spark):
    px = [0] * 16
    px[5] = px[6] = 255
    frames = spark.createDataFrame([("v", 1, px), ("v", 2, [0] * 16)], "video string, frame long, px array<int>")
    found = detect.detect(frames, detect.bright_spots(4), "static")
    (r,) = found.collect()
    assert (r["x1"], r["y1"], r["x2"], r["y2"], r["source"]) == (1, 1, 3, 2, "static")
    import pandas as pd

    model = {"static:spot": lambda p: pd.DataFrame({"secondary_class": ["big"] * len(p), "secondary_conf": [0.7] * len(p)})}
    route = detect.secondary_route(F.col("source"), F.col("cls"), ["spot"], [], [])
    assert detect.classify(found, model, route).first()["secondary_class"] == "big"
    none = detect.secondary_route(F.col("source"), F.col("cls"), ["spot"], [], ["spot"])
    assert detect.classify(found, model, none).first()["secondary_class"] == "spot"


def test_track_objects_equals_model(spark):
    """The registered query against merging and tracking in plain Python, video by video."""
    from ethospark.plans.queries import QUERIES

    by = {}
    for r in V.boxes(spark, SF).collect():
        by.setdefault(r["video"], {}).setdefault(r["frame"], []).append(r.asDict())
    want = []
    for v, seen in by.items():
        t = tracking.Tracker(15.0)
        for f in range(13):
            points = [((m["box"][0] + m["box"][2]) // 2, (m["box"][1] + m["box"][3]) // 2) for m in python_merge(seen.get(f, []), "confidence", 12.0, 0.6)]
            want += [(v, f, c, i) for c, i, *_ in t.rows(points)]
    got = QUERIES["track_objects"](spark, SF).select("video", "frame", "det", "track_id").collect()
    assert len(by) > 1 and sorted(map(tuple, got)) == sorted(want)


def test_queries_without_sql_run(spark):
    from ethospark.plans.queries import QUERIES
    from ethospark.plans.sql import SQL

    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, SF).count() > 0
