"""Registered queries: each applies the engine's operators to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import augment, budget, dataset, geometry, motion, rebuild, tracking
from . import views as V

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def obs(s: SparkSession, d: str) -> DataFrame:
    return budget.tracking_rows(V.raw_obs(s, d))


def meta(s: SparkSession, d: str) -> DataFrame:
    return budget.metadata_rows(V.metadata(s, d), "line_no")


@query
def tracking_rows_behavior(s, d):
    return obs(s, d).groupBy("video_filename", "behaviour").agg(F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@query
def behavior_frames_long(s, d):
    return budget.frames_by_behaviour(obs(s, d))


@query
def behavior_transitions(s, d):
    return budget.transitions(obs(s, d))


@query
def activity_budget_individual(s, d):
    return budget.individual_budget(obs(s, d), meta(s, d), V.videos(s, d), min_presence=0.045, rounded=False)


@query
def dominant_behavior(s, d):
    return budget.individual_budget(obs(s, d), rounded=False).select("video_filename", "track_id", "dominant_behavior_time", "dominant_behavior_count")


@query
def stranger_flags(s, d):
    tracks = budget.flagged(budget.per_track(obs(s, d), []), meta(s, d), V.videos(s, d), 0.045, 0.15, 30.0)
    return tracks.select("video_filename", "track_id", "presence", "border_entry", "manual_exclude", "auto_flagged", "flag_reason", "individual_type")


@query
def activity_budget_suspects(s, d):
    return budget.suspects(obs(s, d), meta(s, d), V.videos(s, d), min_presence=0.045, rounded=False)


@query
def member_stranger_tally(s, d):
    return budget.tallies(budget.individual_budget(obs(s, d), meta(s, d), V.videos(s, d), domain=[], min_presence=0.045))


@query
def analysis_window_budget(s, d):
    rows = budget.limited(obs(s, d), budget.window_frames(20.0, 30.0))
    return budget.frames_by_behaviour(rows).drop("seconds")


@query
def group_type_from_name(s, d):
    name = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_brand"), F.lit("_x_"), F.col("p_type"), F.lit(".MP4"))
    return V.table(s, d, "part").select("p_partkey", X.group_type(name, "_", 3).alias("group_type"), X.group_type(name, "_", 9).alias("missing_type"))


@query
def metadata_override_join(s, d):
    cams = V.videos(s, d).join(meta(s, d), "video_filename", "left")
    kind = X.group_type(F.col("video_filename"), "_", 4, F.col("group_type"))
    return cams.select("video_filename", F.coalesce("group_id", F.lit("")).alias("group_id"), kind.alias("group_type"), F.coalesce(F.size("excluded"), F.lit(0)).cast("bigint").alias("n_excluded"))


@query
def video_extension_priority(s, d):
    n = F.col("s_suppkey")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".mkv", ".avi", ".mp4", ".MP4", ".mov")]), (n % 5 + 1).cast("int"))
    files = V.table(s, d, "supplier").select(F.concat(F.lit("clip"), (n % 17).cast("string"), ext).alias("name"), (n % 2).alias("tree"))
    stems = s.range(20).select(F.concat(F.lit("clip"), F.col("id").cast("string")).alias("stem"))
    return budget.video_files(stems, files)


@query
def frame_timecode(s, d):
    frame = F.col("o_orderkey") * 37
    return V.table(s, d, "orders").select("o_orderkey", X.timecode(frame, F.lit(30.0)).alias("timecode"), X.timecode(frame, F.lit(0.0)).alias("no_rate"))


@query
def box_norm_to_pixel(s, d):
    c = [F.col(x) for x in ("xc", "yc", "bw", "bh")]
    held, free = (X.pixel_box(*c, F.lit(640), F.lit(480), clamp=k) for k in (True, False))
    names = ("x1", "y1", "x2", "y2")
    return V.labels(s, d).select("line_no", *[v.alias(n) for n, v in zip(names, held)], *[v.alias(f"free_{n}") for n, v in zip(names, free)])


@query
def box_pixel_to_norm(s, d):
    made = X.normalised_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(640), F.lit(480))
    return V.boxes(s, d).select("det", *[v.alias(n) for n, v in zip(("xc", "yc", "bw", "bh"), made)])


@query
def box_overlap_pairs(s, d):
    return geometry.overlap_pairs(V.boxes(s, d)).select("frame", "a_det", "b_det", "overlap")


@query
def merge_candidate_pairs(s, d):
    return geometry.merge_candidates(V.boxes(s, d), 12.0, 0.6).select("frame", "a_det", "b_det")


@query
def nms_keep(s, d):
    return geometry.suppress(V.boxes(s, d), 0.4).select("frame", "det", "conf")


@query
def merge_detections_confidence(s, d):
    return geometry.stream_columns(geometry.merge(V.boxes(s, d), "confidence", 12.0, 0.6))


@query
def merge_detections_static(s, d):
    return geometry.stream_columns(geometry.merge(V.boxes(s, d), "static", 12.0, 0.6))


@query
def merge_detections_motion(s, d):
    return geometry.stream_columns(geometry.merge(V.boxes(s, d), "motion", 12.0, 0.6))


def _tracks_and_detections(s, d):
    b = V.boxes(s, d)
    here = b.select("video", "frame", "det", X.centroid(F.col("x1"), F.col("x2")).alias("x"), X.centroid(F.col("y1"), F.col("y2")).alias("y"))
    tracks = here.filter("det % 3 = 0").select("video", F.col("frame"), F.col("det").alias("track"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return tracks, here.filter("det % 3 <> 0")


@query
def cost_matrix(s, d):
    return geometry.distances(*_tracks_and_detections(s, d)).select("frame", "track", "det", "distance")


@query
def nearest_track(s, d):
    return geometry.nearest_track(*_tracks_and_detections(s, d), gate=9.0).select("frame", "det", F.coalesce("track", F.lit(-1)).alias("track"), "distance")


@query
def topmost_box(s, d):
    return geometry.topmost(V.boxes(s, d), F.lit(100), F.lit(100))


@query
def drawn_boxes(s, d):
    b = V.boxes(s, d)
    c = X.drawn_box(F.col("x2"), F.col("y1"), F.col("x1"), F.col("y2"), F.lit(110), F.lit(110))
    made = b.select("det", *[v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), c)])
    return made.filter((F.col("x2") - F.col("x1") > 5) & (F.col("y2") - F.col("y1") > 5))


@query
def canvas_transform(s, d):
    return V.boxes(s, d).select("det", X.to_video(F.col("x1"), F.lit(1.5), F.lit(70)).alias("vx"), X.to_canvas(F.col("x1"), F.lit(1.5)).alias("cx"), X.rescaled(F.col("det"), F.lit(500), F.lit(333)).alias("tick"), X.progress(F.col("det"), F.lit(1), F.lit(1000)).alias("percent"))


def _order_videos(s, d):
    return V.table(s, d, "orders").select(F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("video"), (F.col("o_orderkey") % 41).alias("n_frames"))


@query
def frame_pool(s, d):
    return dataset.frame_pool(_order_videos(s, d), 10)


@query
def unannotated_pool(s, d):
    labelled = V.table(s, d, "labels").select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video"), (F.col("doc_id") % 30).alias("frame"))
    return dataset.unannotated(dataset.frame_pool(_order_videos(s, d), 10), labelled)


@query
def annotated_frames_map(s, d):
    items = V.table(s, d, "labels").select(F.concat(F.lit("clip_"), F.expr("doc_id div 50").cast("string"), F.lit("_"), F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("doc_id").cast("string"))).alias("basename"))
    return dataset.annotated_map(items).select("label", F.size("frames").cast("bigint").alias("n"), F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


@query
def next_annotated_wrap(s, d):
    frames = V.table(s, d, "labels").select(F.concat(F.lit("clip_"), F.expr("doc_id div 50").cast("string")).alias("label"), F.col("doc_id").alias("frame"))
    return dataset.neighbours_with_wrap(frames)


@query
def basename_parse(s, d):
    name = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.when(F.col("p_partkey") % 7 == 0, "x9").otherwise(F.col("p_size").cast("string")))
    label, frame = X.basename_parts(name)
    return V.table(s, d, "part").select("p_partkey", label.alias("label"), F.coalesce(frame, F.lit(-1)).alias("frame"))


@query
def crop_name_parse(s, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("a_b"), (k % 3).cast("string"), F.lit("_"), k.cast("string"), F.lit("_"), (k % 19 - 4).cast("string"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("_"), (k % 23).cast("string"))))
    label, *numbers = X.crop_parts(name)
    return V.table(s, d, "part").select("p_partkey", label.alias("label"), *[F.coalesce(c, F.lit(-99)).alias(n) for c, n in zip(numbers, ("frame", "x1", "y1"))])


@query
def crop_link_tolerance(s, d):
    b = V.boxes(s, d).select(F.col("det").alias("box"), "video", "frame", F.lit("c").alias("cls"), "x1", "y1")
    crops = b.select((F.col("box") * 2 + 1).alias("crop"), "video", "frame", "cls", (F.col("x1") + F.col("box") % 5 - 2).cast("int").alias("x1"), (F.col("y1") + F.col("box") % 7 - 3).cast("int").alias("y1"), F.concat(F.lit("s"), F.col("box").cast("string")).alias("secondary"))
    return dataset.link_crops(b, crops).select("box", "secondary")


@query
def image_label_mask_join(s, d):
    docs, lab = V.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("basename")), V.table(s, d, "labels")
    return dataset.with_labels_and_masks(docs, lab.select(F.col("doc_id").cast("string").alias("basename")), lab.filter("toxic = 1").select(F.col("doc_id").cast("string").alias("basename")))


@query
def annotation_listing(s, d):
    images = V.labels(s, d).withColumn("priority", F.when(F.col("stream") == "static", 0).otherwise(2) + F.when(F.col("split") == "val", 1).otherwise(0))
    return dataset.listing(images.select("basename", "stream", "split", "priority").distinct())


@query
def video_for_item_prefix(s, d):
    videos = V.table(s, d, "supplier").select(F.concat(F.lit("/in/"), F.col("s_name"), F.lit(".mp4")).alias("path"), F.lower("s_name").alias("stem"))
    items = V.table(s, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.expr("substring(s_name, 1, length(s_name) - 1)")).alias("label")).distinct()
    return dataset.video_for_item(items, videos)


@query
def frame_alignment(s, d):
    g = V.grey(s, d)
    frames = g.select("video", F.row_number().over(Window.partitionBy("video").orderBy("frame")).cast("bigint").alias("frame"), "px")
    wanted = frames.select(F.concat(F.col("video").cast("string"), F.lit("_"), F.col("frame").cast("string")).alias("item"), "video", (F.col("frame") + 1 - F.col("frame") % 3).alias("frame"), "px")
    return dataset.align_frames(frames, wanted)


@query
def class_distribution(s, d):
    return dataset.class_distribution(V.labels(s, d))


@query
def dataset_tallies_rollup(s, d):
    return dataset.tallies(V.labels(s, d).select("stream", "split", "basename").distinct())


@query
def augmentation_type_counts(s, d):
    return dataset.augmentation_types(V.labels(s, d).select("stream", "split", "basename").distinct())


@query
def last_epoch_metrics_f1(s, d):
    text = lambda c: c.cast("string")
    log = V.table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("run"), (F.col("l_linenumber").cast("bigint") * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("epoch"), F.when(F.col("l_linenumber") % 2 == 0, "n/a").otherwise(text(F.col("l_discount"))).alias("p_new"), text(F.col("l_tax")).alias("p_old"), text(F.col("l_tax")).alias("r"),
    )
    return dataset.last_epoch(log, "run", "epoch", {"precision": ["p_new", "p_old"], "recall": ["r"]})


@query
def segment_dsl_explode(s, d):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    many = F.concat(n, F.lit(","), (F.col("p_size") + k % 4).cast("string"), F.lit(" | "), (k % 9).cast("string"), F.lit("|"))
    text = F.when(k % 3 == 0, many).when(k % 3 == 1, n).otherwise("")
    return V.table(s, d, "part").select("p_partkey", F.posexplode(X.segments(text)).alias("segment", "g")).select("p_partkey", F.col("segment").cast("bigint").alias("segment"), "g.kind", "g.lo", "g.hi")


@query
def class_and_colour_lists(s, d):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    classes = F.when(k % 3 == 0, F.concat(F.lit("a"), n, F.lit(", b ,,c"))).when(k % 3 == 1, " 0 ").otherwise("")
    colours = F.when(k % 3 == 0, F.concat(n, F.lit(", 2,3;4,5;x,y,z;7,8,"), n)).when(k % 3 == 1, F.concat(F.lit("9,9,"), n)).otherwise("")
    flat = F.transform(X.colour_list(colours), lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ","))
    return V.table(s, d, "part").select("p_partkey", F.array_join(X.class_list(classes), "|").alias("classes"), F.array_join(flat, ";").alias("colours"), X.is_populated(classes).alias("populated"))


@query
def label_flip(s, d):
    h, v = (augment.flipped_labels(V.labels(s, d), p) for p in ("flip_h", "flip_v"))
    return h.select(F.lit("flip_h").alias("parameter"), "line_no", "xc", "yc").union(v.select(F.lit("flip_v"), "line_no", "xc", "yc"))


@query
def target_class_filter(s, d):
    items = V.labels(s, d).select("basename").distinct().union(s.range(3).select(F.concat(F.lit("bare_"), F.col("id").cast("string"))))
    return augment.has_target_class(items, V.labels(s, d), [2, 5])


@query
def augment_plan_hash(s, d):
    items = V.table(s, d, "documents").select(F.concat(F.lit("d_"), F.col("doc_id").cast("string")).alias("basename"))
    params = s.createDataFrame([("brightness", 0.5, "0.5,0.8|1.2,1.6", False), ("blur", 0.3, "3,7", True), ("flip_h", 0.4, "1", False)], "parameter string, probability double, dsl string, whole boolean")
    return augment.plan(items, params.withColumn("segments", X.segments(F.col("dsl"))), 0.6, seed=7)


def _joined(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


@query
def seq_frame_diff(s, d):
    return motion.sequential_walk(V.grey(s, d)).select("video", "frame", *[_joined(f"d{i}").alias(f"d{i}") for i in range(3)])


@query
def exp_frame_diff(s, d):
    return motion.exponential_walk(V.grey(s, d)).select("video", "frame", *[_joined(f"d{i}").alias(f"d{i}") for i in range(3)])


def _planes(s, d, tail):
    made = motion.false_colour(motion.sequential_walk(V.grey(s, d)), 0.7, (2.0, 3.0, 4.0), 5, tail)
    return made.select("video", "frame", *[_joined(c).alias(c) for c in ("blue", "green", "red")])


@query
def false_color_plain(s, d):
    return _planes(s, d, False)


@query
def false_color_chromatic(s, d):
    return _planes(s, d, True)


@query
def frame_skip_sample(s, d):
    return motion.sampled(obs(s, d), 2).select("video_filename", "frame", "track_id")


@query
def window_ending_at(s, d):
    frames = obs(s, d).select(F.col("video_filename").alias("video"), "frame", "row_no")
    targets = frames.select("video", F.col("frame").alias("target"))
    return motion.window_ending_at(frames, targets, 5, 1).select("video", "target", "frame", "row_no")


@query
def rolling_fps(s, d):
    e = V.table(s, d, "events").select("event_id", "user_id", "ts")
    return motion.rolling_rate(e, "user_id", "ts", 3600.0).select("event_id", "recent")


@query
def mask_fill(s, d):
    box = F.array(F.struct((F.col("frame") % 5).cast("int").alias("x1"), F.lit(1).alias("y1"), (F.col("frame") % 5 + 2).cast("int").alias("x2"), F.lit(4).alias("y2")))
    return V.grey(s, d).select("video", "frame", _joined(motion.masked(F.col("px"), 8, box)).alias("px"))


@query
def padded_crop(s, d):
    made = motion.crop(F.col("px"), 8, 8, (F.col("frame") % 8).cast("int"), (F.col("frame") % 3).cast("int"), 4)
    return V.grey(s, d).select("video", "frame", _joined(made).alias("px"))


def _files(s, d):
    n = V.table(s, d, "part").withColumn("k", F.col("p_partkey"))
    label = n.select(F.lit("label").alias("kind"), F.concat(F.lit("v_"), F.col("k").cast("string")).alias("name"))
    crops = n.select(F.lit("crop").alias("kind"), F.concat(F.lit("v_"), F.col("k").cast("string"), F.lit("_4_"), (F.col("k") % 9).cast("string")).alias("name"))
    return label.union(crops)


@query
def delete_set_exact(s, d):
    return dataset.deletions(_files(s, d), _targets(s, d))


def _targets(s, d):
    return V.table(s, d, "supplier").select(F.concat(F.lit("v_"), F.col("s_suppkey").cast("string")).alias("basename"))


@query
def delete_set_prefix(s, d):
    return dataset.deletions(_files(s, d), _targets(s, d), prefix=True)


@query
def backup_ordinal(s, d):
    names = V.table(s, d, "nation").filter("n_nationkey <> 4").select(F.concat(F.lit("model_backup"), F.col("n_nationkey").cast("string")).alias("name"))
    return dataset.next_ordinal(names, "model")


@query
def model_directories(s, d):
    n = V.table(s, d, "nation").select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "model_").otherwise("annot_"), F.lower("n_name"), F.when(F.col("n_nationkey") % 3 == 0, "_backup2").otherwise("")).alias("name"))
    return n.filter(X.is_model_directory(F.col("name"), "model_"))


@query
def hotkey_conflicts(s, d):
    return dataset.hotkey_conflicts(V.table(s, d, "nation").select(F.substring("n_name", 1, 1).alias("hotkey")))


@query
def settings_diff(s, d):
    n = V.table(s, d, "nation")
    old = n.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    new = n.filter("n_nationkey <> 3").select(F.col("n_name").alias("key"), (F.col("n_regionkey") + F.col("n_nationkey") % 2).cast("string").alias("value"))
    return dataset.settings_diff(old, new)


@query
def case_insensitive_class_sort(s, d):
    p = V.table(s, d, "part").groupBy(F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("name")).agg(F.min("p_partkey").alias("idx"))
    return dataset.sorted_classes(p)


@query
def window_length_rule(s, d):
    c = V.table(s, d, "part").select("p_partkey", (F.col("p_size") % 11 / 10).alias("a"), (F.col("p_partkey") % 11 / 10).alias("b"))
    return c.select("p_partkey", X.window_length(F.col("a"), F.col("b"), F.lit("exponential"), F.lit(2)).alias("frames"), X.window_length(F.col("a"), F.col("b"), F.lit("sequential"), F.lit(0)).alias("sequential"))


@query
def label_tally_first_bad(s, d):
    c = V.table(s, d, "conversations").select(F.col("conv_id").alias("basename"), F.col("turn").alias("line_no"), F.when(F.col("turn") == F.col("conv_id") % 5, "bad 1").otherwise(F.concat(F.col("turn").cast("string"), F.lit(" 0.5"))).alias("text"))
    return dataset.first_bad_aborts(c).groupBy("basename").agg(F.count("*").alias("lines"), F.sum("cls").alias("total"))


@query
def log_text_predicates(s, d):
    c = V.table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit("/50 x"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit("% | x"))).otherwise(F.concat(F.lit("\x1b[31m"), F.col("p_name"), F.lit("\x1b[0m"))).alias("t"))
    return c.select("p_partkey", X.is_progress_line(F.col("t")).alias("progress"), X.strip_ansi(F.col("t")).alias("plain"))


@query
def detection_sessions(s, d):
    """Sessions of each user with gaps up to six hours; the window is a microsecond longer as equal gaps still join."""
    e = V.table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    w = F.session_window("ts", "6 hours 1 microsecond")
    made = e.groupBy("user_id", w).agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return made.select("user_id", "n", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"))


@query
def conversation_role_transitions(s, d):
    c = V.table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("video_filename"), F.lit(0).cast("bigint").alias("track_id"), F.col("turn").alias("frame"), F.col("turn").alias("row_no"), F.col("role").alias("behaviour"))
    return budget.transitions(c).groupBy("behaviour").agg(F.sum("transitions").alias("transitions"), F.count("*").alias("conversations"))


@query
def track_objects(s, d):
    """Identities of the merged detections; every sampled frame counts, also without detections."""
    here = geometry.merge(V.boxes(s, d), "confidence", 12.0, 0.6).select("video", "frame", "det", X.centroid(F.col("x1"), F.col("x2")).alias("x"), X.centroid(F.col("y1"), F.col("y2")).alias("y"))
    frames = V.boxes(s, d).select("video").distinct().select("video", F.explode(F.expr("sequence(0L, 12L)")).alias("frame"))
    return tracking.track(tracking.with_frame_axis(here, frames), gate=15.0)


@query
def rebuild_items(s, d):
    """Label keys of both streams with the clips they are rebuilt from."""
    keys = rebuild.items(*[V.labels(s, d).filter(F.col("stream") == k) for k in ("static", "motion")])
    ext = F.when(F.col("n_nationkey") % 2 == 0, ".mp4").otherwise(".AVI")
    clips = V.table(s, d, "nation").select(F.concat(F.lit("clip"), (F.col("n_nationkey") % 4).cast("string"), ext).alias("name"))
    return rebuild.with_clips(keys, clips.withColumn("path", F.concat(F.lit("/clips/"), F.col("name")))).drop("rank")


@query
def videos_with_annotations(s, d):
    videos = V.table(s, d, "supplier").select(F.concat(F.lit("clip"), F.col("s_suppkey").cast("string")).alias("stem"), F.concat(F.lit("/in/"), F.col("s_name")).alias("path"))
    return dataset.videos_with_annotations(videos, V.labels(s, d))


@query
def union_by_normalised_path(s, d):
    """Two listings of the same parts, the second under roundabout paths and with parts of its own."""
    p, k = V.table(s, d, "part"), F.col("p_partkey")
    name = F.concat(F.lit("clip"), k.cast("string"), F.lit(".mp4"))
    first = p.select(F.concat(F.lit("/in/a/"), name).alias("path"), F.lit("clips").alias("source"), k)
    roundabout = F.when(k % 2 == 0, F.concat(F.lit("/in//b/../a/./"), name)).otherwise(F.concat(F.lit("/in/b/"), name))
    return dataset.union_by_path(first, p.select(roundabout.alias("path"), F.lit("more").alias("source"), k))


@query
def joint_class_domain(s, d):
    n = V.table(s, d, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, "motion").otherwise("static").alias("stream"), "n_name", "n_nationkey")
    position = F.row_number().over(Window.partitionBy("stream").orderBy("n_nationkey")) - 1
    return dataset.class_domain(n.select("stream", position.cast("bigint").alias("position"), F.col("n_name").alias("name")))


@query
def newest_run(s, d):
    o = V.table(s, d, "orders").select(F.concat(F.lit("/runs/train"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").alias("modificationTime"))
    return dataset.newest(o).select("path")


@query
def sorted_basenames(s, d):
    return dataset.sorted_basenames(V.labels(s, d))


@query
def clamped_steps(s, d):
    o = V.table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).alias("frame"), F.lit(90).cast("bigint").alias("n"))
    return o.select("o_orderkey", *[X.stepped(F.col("frame"), k, F.col("n")).alias(f"by_{name}") for k, name in ((-10, "back10"), (-1, "back1"), (1, "on1"), (10, "on10"))])


@query
def masks_of_either_stream(s, d):
    lab = V.table(s, d, "labels").select(F.col("doc_id").cast("string").alias("basename"), "quality", "toxic")
    box = lambda v: F.array(F.struct(*[F.lit(v + i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]))
    static, moving = lab.filter("quality = 1").select("basename", box(0).alias("boxes")), lab.filter("toxic = 1").select("basename", box(10).alias("boxes"))
    return dataset.masks_of_either(static, moving).select("basename", F.expr("boxes[0].x1").alias("x1"))


@query
def augmented_file_counts(s, d):
    return dataset.augmented_files(V.labels(s, d).select(F.col("stream").alias("kind"), F.col("basename").alias("name")).distinct())


@query
def label_files_by_stream(s, d):
    from ..sources import writers

    b = V.boxes(s, d).select(F.concat("video", F.lit("_"), F.col("frame").cast("string")).alias("basename"), "det", F.col("cls").cast("int").alias("cls"), "x1", "y1", "x2", "y2")
    made = writers.label_lines_by_stream(b, 6, 512, 256)
    return made.select("stream", "basename", F.size(F.split("text", "\n")).cast("bigint").alias("lines"), F.array_join(F.transform(F.split("text", "\n"), lambda t: F.split(t, " ")[0]), ",").alias("classes"))


@query
def recording_frames(s, d):
    """Every event is a frame of its user's camera, purchases are detections; recordings go on for six hours after one."""
    from ..streaming import live

    e = V.table(s, d, "events").select("event_id", F.col("user_id").alias("video"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    made = live.recordings(e.select("event_id", "video", "ts"), e.filter("event_type = 'purchase'"), 6 * 3600.0, 24 * 3600.0)
    return made.select("event_id", "video", "recording", F.unix_micros("started").alias("started_us"), F.unix_micros("stopped").alias("stopped_us"))


@query
def resized_frames(s, d):
    return V.grey(s, d).select("video", "frame", _joined(motion.resized(F.col("px"), 8, 8, 4, 16)).alias("px"))


@query
def rebuilt_windows(s, d):
    """Differences at every third frame from the window of four frames, every second one, that ends there."""
    g = V.grey(s, d)
    made = motion.windows_walk(g, g.filter("frame % 3 = 0").select("video", F.col("frame").alias("target")), 4, 1, exponential=False)
    return made.select("video", F.col("target").alias("frame"), *[_joined(f"d{i}").alias(f"d{i}") for i in range(3)])


@query
def tracks_within_gate(s, d):
    return geometry.within(*_tracks_and_detections(s, d), gate=9.0).groupBy("frame", "det").agg(F.count("*").alias("tracks"), F.sum("track").alias("track_sum"))


@query
def zoomed_crops(s, d):
    made = motion.zoomed(F.col("px"), 8, 8, (F.col("frame") % 8).cast("int"), (F.col("frame") % 5).cast("int"), 4)
    return V.grey(s, d).select("video", "frame", _joined(made).alias("px"))
