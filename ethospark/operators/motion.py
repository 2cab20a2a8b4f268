"""Frame sampling, temporal differences and false-colour motion images on arrays of grey values.

Frames are rows (video, frame, px) with px an array of 0-255. Lags are windows over a video's frames; the exponential
memory is a fold in frame order, rounded to whole grey values at every step as its result depends on that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.frames import neighbours
from ..sources.frames import resized as resized_array


#: Frames of a video that one walk takes, at least.
STRETCH = 1000
#: Windows to a bin of frames: a fourth of the frames is in two bins, and a target is compared with five windows of frames.
BIN = 4


def sampled(frames: DataFrame, skip: int = 0, frame: str = "frame") -> DataFrame:
    """Frame 1 seeds the memory; then every (skip + 1)-th from frame 2 on is processed."""
    return frames.filter((F.col(frame) >= 2) & ((F.col(frame) - 2) % (skip + 1) == 0))


def window_ending_at(frames: DataFrame, targets: DataFrame, window: int, skip: int = 0) -> DataFrame:
    """The sampled frames of the window that ends exactly at each target (video, target); shorter at the video's start.

    An equi-join on bins of ``BIN`` windows with a range condition: a target is shuffled once, not once for each frame of its
    window, and a frame once, or twice if windows of the next bin hold it. A target before frame 0 is an error.
    """
    step, reach = skip + 1, (window - 1) * (skip + 1)
    width = max(BIN * reach, step)
    part = lambda c: F.floor(c / width)
    both = F.array_distinct(F.array(part(F.col("frame")), part(F.try_add(F.col("frame").cast("bigint"), F.lit(reach)))))
    start = F.greatest(F.col("t.target") - reach, F.col("t.target") % step)
    early = F.raise_error(F.concat(F.lit("no window ends at frame "), F.col("t.target").cast("string"))).cast("boolean")
    shown = frames.withColumn("_part", F.explode(both)).alias("f")
    asked = targets.alias("t").filter(F.when(F.col("t.target") < start, early).otherwise(F.lit(True)))
    same = (F.col("t.video") == F.col("f.video")) & (part(F.col("t.target")) == F.col("f._part"))
    sampled_too = F.pmod("t.target", F.lit(step)) == F.pmod("f.frame", F.lit(step))
    found = asked.join(shown, same & sampled_too & F.col("f.frame").between(start, F.col("t.target")))
    rest = [f"f.`{c}`" for c in frames.columns if c not in ("video", "frame")]
    return found.select("t.video", F.col("f.frame").cast("bigint").alias("frame"), "t.target", *rest)


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def sequential_differences(frames: DataFrame) -> DataFrame:
    """d0, d1, d2: absolute differences to one, two and three frames before; before the start, to the first.

    One window, for short series; ``sequential_walk`` is for whole videos.
    """
    w = Window.partitionBy("video").orderBy("frame")
    first = F.first("px").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lagged = frames.select("*", *[F.coalesce(F.lag("px", k).over(w), first).alias(f"_l{k}") for k in (1, 2, 3)])
    return lagged.select(*frames.columns, *[difference(F.col("px"), F.col(f"_l{k}")).alias(f"d{k - 1}") for k in (1, 2, 3)])


def blended(memory: Column, now: Column, weight: float) -> Column:
    """weight x memory + (1 - weight) x now, rounded half to even and held to 0-255."""
    return F.zip_with(memory, now, lambda e, g: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(F.lit(weight) * e + F.lit(1.0 - weight) * g).cast("int"))))


def exponential_differences(frames: DataFrame, exp_a: float = 0.5, exp_b: float = 0.8) -> DataFrame:
    """d0 to the frame before, d1 and d2 to two exponential memories as they were before this frame.

    The first frame seeds the memories. One fold per video over the array of its frames, for short series such as the
    windows of a rebuild; ``exponential_walk`` does the same for whole videos of any length.
    """
    item = F.struct(F.col("frame").cast("bigint").alias("frame"), F.col("px").cast("array<int>").alias("px"))
    videos = frames.groupBy("video").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kind = "struct<last:array<int>,ea:array<int>,eb:array<int>,out:array<struct<frame:bigint,d0:array<int>,d1:array<int>,d2:array<int>>>>"
    first = F.element_at("all", 1)["px"]
    start = F.struct(first.alias("last"), first.alias("ea"), first.alias("eb"), F.array().cast(kind[kind.index("out:") + 4 : -1]).alias("out")).cast(kind)

    def step(acc: Column, f: Column) -> Column:
        made = F.struct(f["frame"].alias("frame"), *[difference(f["px"], acc[m]).alias(d) for m, d in (("last", "d0"), ("ea", "d1"), ("eb", "d2"))])
        return F.struct(
            f["px"].alias("last"), blended(acc["ea"], f["px"], exp_a).alias("ea"), blended(acc["eb"], f["px"], exp_b).alias("eb"),
            F.concat(acc["out"], F.array(made)).alias("out"),
        )

    done = F.aggregate("all", start, step)
    return videos.select("video", F.explode(done["out"]).alias("o")).select("video", "o.*")


def exponential_walk(frames: DataFrame, exp_a: float = 0.5, exp_b: float = 0.8) -> DataFrame:
    """:func:`exponential_differences` for whole videos, as a walk (:func:`_walk`)."""
    mixed = lambda memory, g: (g, remembered(memory[1], g, exp_a), remembered(memory[2], g, exp_b))
    return _walk(frames, mixed)


def sequential_walk(frames: DataFrame) -> DataFrame:
    """:func:`sequential_differences` for whole videos, as a walk that holds the last three frames."""
    return _walk(frames, lambda memory, g: (g, *memory[:2]))


def _walk(frames: DataFrame, after) -> DataFrame:
    """video, frame, px, d0, d1, d2: rows dealt by video and sorted by frame, a task walks through them and holds one frame and
    the three that it is compared with; ``after(memory, frame)`` are those for the next one."""
    kind = dict(frames.dtypes)["video"]
    dealt = frames.select("video", F.col("frame").cast("bigint").alias("frame"), F.col("px").cast("array<int>").alias("px"))
    dealt = dealt.repartition("video").sortWithinPartitions("video", "frame")

    def run(batches):
        key = memory = None
        for batch in batches:
            out = []
            for video, frame, px in zip(*(c.to_pylist() for c in batch.columns)):
                g = np.array(px, float)
                if memory is None or video != key:
                    key, memory = video, (g, g, g)
                out.append((video, frame, *[x.astype(np.int32) for x in (g, *[np.abs(g - m) for m in memory])]))
                memory = after(memory, g)
            if out:
                columns = list(zip(*out))
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()), *[pa.array(list(c), ints) for c in columns[2:]]],
                    names=["video", "frame", "px", "d0", "d1", "d2"],
                )

    return dealt.mapInArrow(run, f"video {kind}, frame bigint, px array<int>, d0 array<int>, d1 array<int>, d2 array<int>")


def windows_walk(frames: DataFrame, targets: DataFrame, window: int, skip: int = 0, exponential: bool = True, exp_a: float = 0.5, exp_b: float = 0.8) -> DataFrame:
    """video, target, px, d0, d1, d2: the differences at each target (video, target) from the window of frames that ends there.

    Equal to differences over :func:`window_ending_at`, in one walk: frames are dealt by stretches of ``STRETCH`` frames of
    a video and sorted, a ring holds the frames of one window, and each target is computed as the walk passes it. A stretch
    begins with the frames of the window before it, so a frame is shuffled once, but for those few, and a long video is dealt to many tasks.
    Targets without a frame of their own have no row.
    """
    kind = dict(frames.dtypes)["video"]
    step, reach = skip + 1, (window - 1) * (skip + 1)
    stretch = max(STRETCH, 4 * reach)
    part = lambda c: F.floor(F.col(c) / stretch)
    asked = targets.select("video", F.col("target").cast("bigint").alias("frame")).distinct()
    asked = asked.select("video", part("frame").alias("part"), "frame", F.lit(None).cast("array<int>").alias("px"))
    # a frame also serves windows that end in the next stretch
    both = F.array_distinct(F.array(part("frame"), F.floor((F.col("frame") + reach) / stretch)))
    shown = frames.select("video", F.explode(both).alias("part"), F.col("frame").cast("bigint").alias("frame"), F.col("px").cast("array<int>").alias("px"))
    shown = shown.filter("px is not null").join(asked.select("video", "part").distinct(), ["video", "part"], "left_semi")
    dealt = shown.unionByName(asked)
    dealt = dealt.repartition("video", "part").sortWithinPartitions("video", "part", "frame", F.col("px").isNull())
    ints = pa.list_(pa.int32())
    names = ["video", "target", "px", "d0", "d1", "d2"]

    def run(batches):
        key, ring = None, {}
        for batch in batches:
            out = []
            for video, at, frame, px in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (video, at):
                    key, ring = (video, at), {}
                for old in [f for f in ring if f < frame - reach]:
                    del ring[old]
                if px is not None:
                    ring[frame] = np.array(px, float)
                elif frame in ring:
                    first = max(frame - reach, frame % step)
                    series = [ring[f] for f in range(first, frame + 1, step) if f in ring]
                    out.append((video, frame, series[-1].astype(np.int32), *at_end(series, exponential, exp_a, exp_b)))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()), *[pa.array(list(c), ints) for c in columns[2:]]], names=names
                )

    return dealt.mapInArrow(run, f"video {kind}, target bigint, px array<int>, d0 array<int>, d1 array<int>, d2 array<int>")


def remembered(memory: np.ndarray, now: np.ndarray, weight: float) -> np.ndarray:
    """:func:`blended` on arrays."""
    return np.clip(np.rint(weight * memory + (1.0 - weight) * now), 0, 255)


def at_end(series: list[np.ndarray], exponential: bool, exp_a: float, exp_b: float) -> list[np.ndarray]:
    """The three differences at the last frame of a series whose first frame seeds the memory."""
    last = series[-1]
    if exponential:
        before, ea, eb = (series[0],) * 3
        for g in series[:-1]:
            before, ea, eb = g, remembered(ea, g, exp_a), remembered(eb, g, exp_b)
        past = (before, ea, eb)
    else:
        past = [series[max(0, len(series) - 1 - k)] for k in (1, 2, 3)]
    return [np.abs(last - m).astype(np.int32) for m in past]


def held(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), c.cast("int")))


def false_colour(frames: DataFrame, lum: float = 0.7, multipliers: tuple[float, float, float] = (2.0, 2.0, 2.0), threshold: int = 0, chromatic_tail: bool = False) -> DataFrame:
    """Planes blue, green and red of px, d0, d1, d2; multipliers are given for red, green and blue.

    Plain: each plane is grey x lum + difference x multiplier - threshold, rounded half to even and held to 0-255, with
    blue from d0, green from d1 and red from d2. Chromatic tail: the differences are first cut down by each other,
    blue to d0 - d1, green to d1 - d0, red to d2 - d1, none below 0.
    """
    cut = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(F.lit(0), x - y))
    d0, d1, d2 = F.col("d0"), F.col("d1"), F.col("d2")
    planes = (cut(d0, d1), cut(d1, d0), cut(d2, d1)) if chromatic_tail else (d0, d1, d2)
    mix = lambda d, m: F.zip_with("px", d, lambda g, x: held(F.rint(g * F.lit(float(lum)) + x * F.lit(float(m)) - F.lit(float(threshold)))))
    names = ("blue", "green", "red")
    return frames.withColumns({n: mix(d, m) for n, d, m in zip(names, planes, reversed(multipliers))})


def masked(px: Column, width: int, boxes: Column, value: int = 128) -> Column:
    """Fill rectangles (structs x1, y1, x2, y2, both ends inside) of a row-major image.

    Each box adds four corners to a table of differences, whose sums along both axes count the boxes over each pixel, so
    the cost is that of the pixels and the boxes, not of their product. Boxes may leave the image; null boxes are none.
    """

    @F.pandas_udf("array<int>")
    def fill(images: pd.Series, rectangles: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else filled(np.asarray(p), width, r, value) for p, r in zip(images, rectangles)])

    return fill(px.cast("array<int>"), boxes)


def filled(px: np.ndarray, width: int, boxes, value: int) -> np.ndarray:
    height = -(-len(px) // width)
    corners = np.zeros((height + 1, width + 1), np.int32)
    for b in boxes if boxes is not None else ():
        if b is None or any(b[c] is None for c in ("x1", "y1", "x2", "y2")):
            continue
        x1, y1, x2, y2 = max(0, b["x1"]), max(0, b["y1"]), min(width, b["x2"] + 1), min(height, b["y2"] + 1)
        if x1 < x2 and y1 < y2:
            corners[y1, x1] += 1
            corners[y2, x1] -= 1
            corners[y1, x2] -= 1
            corners[y2, x2] += 1
    covered = corners.cumsum(0).cumsum(1)[:height, :width].ravel()[: len(px)] > 0
    return np.where(covered, value, px)


def resized(px: Column, width: int, height: int, new_width: int, new_height: int) -> Column:
    """A row-major grey image in another size: each new pixel from the two nearest of its row and column, by their distance,
    rounded half up. Columns only; ``sources.frames.resized`` is the same on arrays."""
    (left, right, fx), (top, bottom, fy) = neighbours(width, new_width, width / new_width), neighbours(height, new_height, height / new_height)
    table = lambda values: F.array(*[F.lit(v) for v in values.tolist()])
    across = F.zip_with(table(fx), F.arrays_zip(table(left).alias("a"), table(right).alias("b")), lambda f, p: F.struct(f.alias("f"), p["a"].alias("a"), p["b"].alias("b")))
    down = F.zip_with(table(fy), F.arrays_zip(table(top).alias("a"), table(bottom).alias("b")), lambda f, p: F.struct(f.alias("f"), p["a"].alias("a"), p["b"].alias("b")))

    def along(row: Column, x: Column) -> Column:
        at = lambda c: F.get(px, (row * width + c).cast("int")).cast("double")
        return at(x["a"]) * (1 - x["f"]) + at(x["b"]) * x["f"]

    value = lambda y, x: F.floor(along(y["a"], x) * (1 - y["f"]) + along(y["b"], x) * y["f"] + 0.5).cast("int")
    return F.flatten(F.transform(down, lambda y: F.transform(across, lambda x: value(y, x))))


def zoomed(px: Column, width: int, height: int, cx: Column, cy: Column, size: int) -> Column:
    """A square around a centre, cut off where it leaves the image and then resized to the given size; black if nothing is left."""

    @F.pandas_udf("array<int>")
    def made(images: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        half, out = size // 2, []
        for p, x, y in zip(images, xs, ys):
            part = None if p is None else np.asarray(p, np.uint8).reshape(height, width)[max(0, y - half) : max(0, y + half), max(0, x - half) : max(0, x + half)]
            out.append(part if part is None else (resized_array(part, size, size) if part.size else np.zeros((size, size), np.uint8)).ravel().astype(np.int32))
        return pd.Series(out)

    return made(px.cast("array<int>"), cx.cast("int"), cy.cast("int"))


def crop(px: Column, width: int, height: int, cx: Column, cy: Column, size: int, fill: int = 0) -> Column:
    """A square of the given size around a centre, filled where it leaves the image."""
    left, top = cx - size // 2, cy - size // 2
    at = lambda i: (left + i % size, top + F.floor(i / size).cast("int"))

    def value(i: Column) -> Column:
        x, y = at(i)
        return F.when((x >= 0) & (x < width) & (y >= 0) & (y < height), F.get(px, (y * width + x).cast("int"))).otherwise(F.lit(fill))

    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), value)


def rolling_rate(events: DataFrame, key: str, ts: str, seconds: float = 1.0) -> DataFrame:
    """Rows of the trailing interval, both ends included."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-int(seconds * 1_000_000), Window.currentRow)
    return events.withColumn("_us", micros).withColumn("recent", F.count("*").over(w)).drop("_us")
