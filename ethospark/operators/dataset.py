"""Queries on an annotation dataset whose file names are keys: pools, listings, links, tallies, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def frame_pool(videos: DataFrame, window: int) -> DataFrame:
    """(video, frame) for every frame that has a whole window before it and two frames after: window - 1 to n - 3."""
    good = videos.filter(F.col("n_frames") - 3 >= window - 1)
    return good.select("video", F.explode(F.sequence(F.lit(window - 1).cast("bigint"), F.col("n_frames").cast("bigint") - 3)).alias("frame"))


def unannotated(pool: DataFrame, annotated: DataFrame) -> DataFrame:
    return pool.join(annotated, ["video", "frame"], "left_anti")


def pick(pool: DataFrame, seed: int = 0) -> DataFrame:
    """One frame by a seeded hash: the same at any partitioning."""
    return pool.orderBy(F.xxhash64("video", "frame", F.lit(seed)), "video", "frame").limit(1)


def annotated_map(items: DataFrame) -> DataFrame:
    """Label to its sorted frames; names without a frame are left out."""
    label, frame = X.basename_parts(F.col("basename"))
    return items.select(label.alias("label"), frame.alias("frame")).na.drop().groupBy("label").agg(F.array_sort(F.collect_set("frame")).alias("frames"))


def neighbours_with_wrap(frames: DataFrame) -> DataFrame:
    """Per label and frame the next and the previous annotated frame; past the ends it starts over."""
    w = Window.partitionBy("label").orderBy("frame")
    whole = Window.partitionBy("label")
    return frames.distinct().select(
        "label", "frame",
        F.coalesce(F.lead("frame").over(w), F.min("frame").over(whole)).alias("next_frame"),
        F.coalesce(F.lag("frame").over(w), F.max("frame").over(whole)).alias("previous_frame"),
    )


def listing(images: DataFrame) -> DataFrame:
    """One row per basename, of the directory that comes first (``priority``)."""
    return images.groupBy("basename").agg(F.min_by(F.struct("stream", "split"), "priority").alias("d")).select("basename", "d.*")


def with_labels_and_masks(images: DataFrame, labels: DataFrame, masks: DataFrame) -> DataFrame:
    """Images with whether a label and a mask of the same basename exist."""
    has = lambda df, name: df.select("basename").distinct().withColumn(name, F.lit(True))
    out = images.join(has(labels, "l"), "basename", "left").join(has(masks, "m"), "basename", "left")
    return out.withColumn("has_label", F.coalesce("l", F.lit(False))).withColumn("has_mask", F.coalesce("m", F.lit(False))).drop("l", "m")


def video_for_item(items: DataFrame, videos: DataFrame) -> DataFrame:
    """Each label's video: the same stem in any case, else a stem that the label starts; the least path of equals.

    Prefixes are matched by equality on those prefixes of a stem that are as long as a label, so this is an equi-join
    and not a nested loop.
    """
    stems = videos.select("path", F.lower("stem").alias("stem"))
    prefixes = stems.select("path", F.explode(_fitting(items, "label", F.length("stem"))).alias("n"), "stem").select("path", F.expr("substring(stem, 1, n)").alias("key"), (F.col("n") < F.length("stem")).cast("int").alias("rank"))
    own = items.withColumn("key", F.lower("label"))
    best = own.join(prefixes, "key").groupBy("label").agg(F.min(F.struct("rank", "path")).alias("b"))
    return items.join(best, "label", "left").withColumn("path", F.col("b.path")).drop("b")


def _fitting(names: DataFrame, column: str, longest: Column) -> Column:
    """Array of the lengths that names have, up to the longest one; there are no more than a file name has characters."""
    lengths = sorted(r[0] for r in names.select(F.length(column)).distinct().collect() if r[0])
    return F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= longest)


def videos_with_annotations(videos: DataFrame, items: DataFrame) -> DataFrame:
    """Videos (stem, ...) of which some frame is annotated: the stem is a basename's label, augmented ones left out."""
    label = F.regexp_replace("basename", "_[^_]*$", "")
    originals = items.filter(~X.is_augmented(F.col("basename")) & F.col("basename").contains("_"))
    return videos.join(originals.select(label.alias("stem")).distinct(), "stem", "left_semi")


def class_domain(classes: DataFrame) -> DataFrame:
    """Joint class ids of both streams: classes (stream, position, name) with the motion ones after the static ones."""
    n_static = classes.filter(F.col("stream") == "static").count()
    return classes.withColumn("id", F.col("position") + F.when(F.col("stream") == "motion", n_static).otherwise(0))


def union_by_path(*listings: DataFrame) -> DataFrame:
    """All listings (path, ...) in order, each normalised path once, of the first listing that has it."""
    both = None
    for i, files in enumerate(listings):
        files = files.withColumns({"path": X.normalised_path(F.col("path")), "_order": F.lit(i)})
        both = files if both is None else both.unionByName(files)
    rest = [c for c in both.columns if c not in ("path", "_order")]
    first = F.min_by(F.struct(*rest), "_order") if rest else F.min("_order")
    return both.groupBy("path").agg(first.alias("f")).select("path", *[F.col(f"f.{c}").alias(c) for c in rest])


def newest(files: DataFrame) -> DataFrame:
    """The last changed file or run folder (path, modificationTime); the greatest path of equals."""
    return files.agg(F.max(F.struct("modificationTime", "path")).alias("f")).filter("f is not null").select("f.path", "f.modificationTime")


def sorted_basenames(items: DataFrame) -> DataFrame:
    return items.select("basename").distinct().orderBy("basename")


def masks_of_either(static: DataFrame, moving: DataFrame) -> DataFrame:
    """Masks (basename, boxes) of the static stream where it has a mask file, else of the motion stream."""
    m = moving.select("basename", F.col("boxes").alias("_m"))
    return static.join(m, "basename", "full").select("basename", F.coalesce("boxes", "_m").alias("boxes"))


def augmented_files(files: DataFrame) -> DataFrame:
    """What a bulk deletion of augmented files takes, counted by kind before it is confirmed."""
    return files.filter(X.is_augmented(F.col("name"))).groupBy("kind").agg(F.count("*").alias("files"))


def link_crops(boxes: DataFrame, crops: DataFrame, tolerance: int = 2) -> DataFrame:
    """Secondary class of boxes from crop files named by their corner.

    boxes: box, video, frame, cls, x1, y1; crops: crop (scan order), video, frame, cls, x1, y1, secondary. A crop whose
    corner is exact goes to all boxes there; else to the first box of the nearest in order of dx, then dy, within the
    tolerance. Later crops overwrite earlier ones. The neighbourhood is an equi-join on the shifted corner.
    """
    key = ["video", "frame", "cls"]
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-tolerance, tolerance + 1) for dy in range(-tolerance, tolerance + 1)])
    moved = crops.select("crop", *key, "secondary", F.col("x1").alias("cx"), F.col("y1").alias("cy"), F.explode(shifts).alias("s"))
    moved = moved.select("*", (F.col("cx") + F.col("s.dx")).alias("x1"), (F.col("cy") + F.col("s.dy")).alias("y1"), (F.expr("s.dx = 0 and s.dy = 0")).alias("exact"))
    hits = moved.join(boxes, [*key, "x1", "y1"])
    order = F.struct((~F.col("exact")).alias("far"), F.col("s.dx").alias("dx"), F.col("s.dy").alias("dy"), "box")
    w = Window.partitionBy("crop")
    hits = hits.withColumn("order", order).withColumn("best", F.min("order").over(w))
    chosen = hits.filter(F.col("exact") | (F.col("best.far") & (F.col("order") == F.col("best"))))
    linked = chosen.groupBy("box").agg(F.max_by("secondary", "crop").alias("secondary"))
    return boxes.join(linked, "box", "left")


def align_frames(frames: DataFrame, wanted: DataFrame, reach: int = 1) -> DataFrame:
    """Which of the frames around a named one looks most like a stored image, by mean absolute difference.

    frames: video, frame, px; wanted: item, video, frame, px. The first of equals in the order f - 1, f, f + 1.
    """
    asked = wanted.select("item", "video", F.col("frame").alias("named"), F.col("px").alias("want"), F.explode(F.sequence(F.col("frame") - reach, F.col("frame") + reach)).alias("frame"))
    scored = asked.join(frames, ["video", "frame"]).withColumn("score", mean_difference(F.col("want"), F.col("px")))
    return scored.groupBy("item").agg(F.min(F.struct("score", "frame")).alias("b"), F.max("named").alias("named")).select("item", "named", F.col("b.frame").alias("frame"), F.col("b.score").alias("score"))


def mean_difference(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("bigint")), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return total / F.size(a)


def class_distribution(labels: DataFrame, low: float = 10.0) -> DataFrame:
    """Boxes of each stream and class, share and whether it is low; augmented files don't count."""
    counted = labels.filter(~X.is_augmented(F.col("basename"))).groupBy("stream", "cls").agg(F.count("*").alias("boxes"))
    pct = 100 * F.col("boxes") / F.sum("boxes").over(Window.partitionBy("stream"))
    return counted.withColumn("pct", pct).withColumn("low", F.col("pct") < low)


def tallies(images: DataFrame) -> DataFrame:
    """Original and augmented images of each stream and split, with the totals; null means all."""
    aug = X.is_augmented(F.col("basename"))
    return images.rollup("stream", "split").agg(
        F.count_if(~aug).alias("originals"), F.count_if(aug).alias("augmented"), F.count_distinct(F.when(~aug, F.col("basename"))).alias("unique_originals")
    )


def augmentation_types(images: DataFrame) -> DataFrame:
    return images.filter(X.is_augmented(F.col("basename"))).groupBy(X.augmentation_type(F.col("basename")).alias("augmentation")).agg(F.count("*").alias("files"))


def last_epoch(log: DataFrame, run: str, epoch: str, metrics: dict[str, list[str]]) -> DataFrame:
    """Epochs and the last row's metrics of each run, by the first name that has a number, and F1."""
    last = log.groupBy(run).agg(F.count("*").alias("epochs"), F.max_by(F.struct(*log.columns), F.col(epoch)).alias("r"))
    out = last.select(run, "epochs", *[X.first_number(*[F.col(f"r.{c}") for c in names]).alias(m) for m, names in metrics.items()])
    return out.withColumn("f1", X.f1(F.col("precision"), F.col("recall"))) if {"precision", "recall"} <= set(metrics) else out


def deletions(files: DataFrame, targets: DataFrame, prefix: bool = False) -> DataFrame:
    """Files (kind, name) that go with the target basenames: label, mask and image by name, crops by their key.

    ``prefix``: crops go by prefix, as older tools do, which also takes the crops of frame 123 with those of 12.
    """
    crop = F.col("kind") == "crop"
    label, frame, _, _ = X.crop_parts(F.col("name"))
    exact = F.when(crop, F.concat(label, F.lit("_"), frame.cast("string"))).otherwise(F.col("name"))
    if not prefix:
        return files.withColumn("key", exact).join(targets.select(F.col("basename").alias("key")), "key", "left_semi").drop("key")
    prefixes = F.transform(_fitting(targets, "basename", F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n))
    keys = F.when(crop, prefixes).otherwise(F.array("name"))
    many = files.withColumn("key", F.explode(keys))
    return many.join(targets.select(F.col("basename").alias("key")), "key", "left_semi").select(*files.columns).distinct()


def remaining(files: DataFrame, gone: DataFrame) -> DataFrame:
    """What a rewrite keeps after deletions."""
    return files.join(gone, files.columns, "left_anti")


def next_ordinal(names: DataFrame, base: str) -> DataFrame:
    """The least n from 1 for which ``<base>_backup<n>`` is free: the first gap of the used ones."""
    used = names.select(X.number(F.nullif(F.regexp_extract("name", f"^{base}_backup([0-9]+)$", 1), F.lit("")), "bigint").alias("n")).filter("n > 0").distinct()
    candidates = used.select((F.col("n") + 1).alias("n")).union(used.sparkSession.range(1, 2).select(F.col("id").alias("n")))
    return candidates.join(used, "n", "left_anti").agg(F.min("n").alias("ordinal"))


def hotkey_conflicts(hotkeys: DataFrame, reserved: tuple[str, ...] = ("u", "g")) -> DataFrame:
    """Hotkeys that are not one character, reserved, or used twice in any case."""
    key = F.lower(F.trim("hotkey"))
    return hotkeys.groupBy(key.alias("hotkey")).agg(F.count("*").alias("uses")).filter((F.col("uses") > 1) | (F.length("hotkey") != 1) | F.col("hotkey").isin(*reserved))


def settings_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose value differs between two (key, value) tables, absent ones included."""
    a, b = old.select("key", F.col("value").alias("old")), new.select("key", F.col("value").alias("new"))
    return a.join(b, "key", "full").filter(~F.col("old").eqNullSafe(F.col("new")))


def split_by_key(items: DataFrame, share: float, key: str = "basename") -> DataFrame:
    """Train or val by a hash of the key, so a repeated save never moves an item."""
    return items.withColumn("split", F.when(F.pmod(F.xxhash64(key), F.lit(10_000)) < int(share * 10_000), "val").otherwise("train"))


def needs_training(counts: DataFrame) -> DataFrame:
    """Models whose image count differs from the recorded one, or has none."""
    return counts.withColumn("retrain", ~F.col("images").eqNullSafe(F.col("recorded")))


def sorted_classes(classes: DataFrame) -> DataFrame:
    """Case-insensitive order of (name, idx), ties by place, with the new index."""
    w = Window.orderBy(F.lower("name"), "idx")  # a class list: a handful of rows
    return classes.withColumn("position", (F.row_number().over(w) - 1).cast("bigint"))


def first_bad_aborts(lines: DataFrame) -> DataFrame:
    """Label lines (basename, line_no, text) before the first whose first token is no integer."""
    token = F.get(F.split(F.trim("text"), r"\s+"), F.lit(0))
    lines = lines.filter(F.trim("text") != "").withColumn("cls", X.number(token, "int"))
    bad = F.max(F.col("cls").isNull().cast("int")).over(Window.partitionBy("basename").orderBy("line_no"))
    return lines.withColumn("bad", bad).filter("bad = 0").drop("bad")
