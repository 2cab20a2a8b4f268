"""Augmentation plans and their effect on labels, images and names; reproducible, as every draw is a hash of its key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Parameters that change colours, which motion images cannot bear.
COLOUR = ("brightness", "contrast", "saturation", "hue", "temperature")


def draw(*key) -> Column:
    """Uniform in [0, 1) from a key."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / F.lit(float(1 << 40))


def plan(items: DataFrame, parameters: DataFrame, probability: float, seed: int = 0, motion: bool = False) -> DataFrame:
    """The augmented copies of each item: basename, parameter, segment, value, name.

    parameters: parameter, probability, segments (array of kind, lo, hi), whole (round to odd). An item passes the
    global gate, then each parameter its own; a parameter gives one copy for each of its segments.
    """
    rows = [r for r in parameters.collect() if not (motion and r["parameter"] in COLOUR)]  # a dozen settings
    if not rows:
        return items.select("basename").limit(0).selectExpr("basename", "'' as parameter", "0L as segment", "0D as value", "'' as name")
    ends = lambda s: F.struct(F.lit(s["kind"]).alias("kind"), F.lit(float(s["lo"])).alias("lo"), F.lit(float(s["hi"])).alias("hi"))
    settings = F.array(
        *[
            F.struct(
                F.lit(r["parameter"]).alias("parameter"), F.lit(float(r["probability"])).alias("probability"),
                F.lit(bool(r["whole"])).alias("whole"), F.array(*[ends(s) for s in r["segments"]]).alias("segments"),
            )
            for r in rows
        ]
    )
    key = ["basename", F.lit(seed)]
    chosen = items.filter(~X.is_augmented(F.col("basename"))).filter(draw(*key, F.lit("gate")) < probability)
    each = chosen.select("basename", F.explode(settings).alias("p")).select("basename", "p.*").filter(draw(*key, "parameter") < F.col("probability"))
    copies = each.select("basename", "parameter", "whole", F.size("segments").alias("n"), F.posexplode("segments").alias("segment", "s"))
    value = F.col("s.lo") + (F.col("s.hi") - F.col("s.lo")) * draw(*key, "parameter", "segment", F.lit("value"))
    value = F.when(F.col("whole"), 2 * F.floor(value / 2) + 1).otherwise(value)
    name = X.augmented_name(F.col("basename"), F.col("parameter"), F.col("segment"), F.col("n"))
    return copies.select("basename", "parameter", F.col("segment").cast("bigint").alias("segment"), value.alias("value"), name.alias("name"))


def flipped_labels(labels: DataFrame, parameter: str) -> DataFrame:
    """Labels of a flipped image; every other augmentation leaves them."""
    axis = {"flip_h": "xc", "flip_v": "yc"}.get(parameter)
    return labels.withColumn(axis, 1 - F.col(axis)) if axis else labels


def flipped_line(line: Column, parameter: str) -> Column:
    """A label line's text after a flip, with six decimals; lines with fewer than five fields stay as they are."""
    part = F.split(F.trim(line), r"\s+")
    axis = {"flip_h": 1, "flip_v": 2}.get(parameter)
    if axis is None:
        return line
    value = lambda i: 1 - part[i].cast("double") if i == axis else part[i].cast("double")
    fields = [part[0], *[F.format_string("%.6f", value(i)) for i in (1, 2, 3, 4)]]
    return F.when(F.size(part) >= 5, F.concat_ws(" ", *fields)).otherwise(line)


def has_target_class(items: DataFrame, labels: DataFrame, targets: list[int]) -> DataFrame:
    """Items to augment: all without a filter; else those without labels or with a label of a target class."""
    if not targets:
        return items
    known = labels.groupBy("basename").agg(F.bool_or(F.col("cls").isin(*targets)).alias("hit"))
    return items.join(known, "basename", "left").filter(F.coalesce("hit", F.lit(True))).drop("hit")


def blend(plain: Column, v: Column, value: Column) -> Column:
    """From the plain value (at 0) through the pixel's own (at 1) and beyond; cut to whole grey values, held to 0-255."""
    mixed = plain + value.cast("float") * (v - plain)
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(mixed).cast("int")))


def whole(value: Column) -> Column:
    """A setting that counts whole steps: cut toward zero."""
    return value.cast("int")


def blurred(px: Column, width: int, value: Column) -> Column:
    """A Gaussian of the value's odd whole radius (as standard deviation), by three extended box filters; edges repeat."""

    @F.arrow_udf("array<int>")
    def run(images: pa.Array, values: pa.Array) -> pa.Array:
        made = [None if image is None or v is None else gaussian(np.array(image).reshape(-1, width), v).ravel() for image, v in zip(images.to_pylist(), values.to_pylist())]
        return pa.array(made, pa.list_(pa.int32()))

    odd = F.greatest(F.lit(1), whole(value))
    return run(px, F.when(odd % 2 == 0, odd - 1).otherwise(odd))


def gaussian(image: np.ndarray, radius: int) -> np.ndarray:
    """Three passes along either axis of a box with fractional ends whose variance is a third of the Gaussian's."""
    third = radius * radius / 3
    inner = int((np.sqrt(12 * third + 1) - 1) / 2)
    # with ends of weight w, (2 inner + 1 + 2 w) third = inner (inner + 1) (2 inner + 1) / 3 + 2 w (inner + 1)^2
    n = 2 * inner + 1
    end = n * (inner * (inner + 1) / 3 - third) / (2 * (third - (inner + 1) ** 2))
    kernel = np.array([end, *[1.0] * n, end]) / (n + 2 * end)
    made = image.astype(float)
    for axis in (1, 0):
        for _ in range(3):
            size, reach = made.shape[axis], inner + 1
            padded = np.pad(made, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], "edge")
            made = sum(w * np.take(padded, range(k, k + size), axis) for k, w in enumerate(kernel))
    return np.clip(np.floor(made + 0.5), 0, 255).astype(np.int32)


def changed_pixels(px: Column, width: int, parameter: str, value: Column, key: Column | None = None) -> Column:
    """Pixel arithmetic on a grey image. ``key`` names the image, so that each has its own noise."""
    held = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c.cast("int")))
    n = F.size(px)
    height = F.floor(n / width)
    at = lambda index: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(px, index(i).cast("int")))
    if parameter == "brightness":
        return F.transform(px, lambda v: blend(F.lit(0), v, value))
    if parameter == "contrast":
        mean = F.floor(F.aggregate(px, F.lit(0).cast("bigint"), lambda s, v: s + v) / n + 0.5).cast("int")
        return F.transform(px, lambda v: blend(mean, v, value))
    if parameter == "flip_h":
        return F.when(value != 0, at(lambda i: F.floor(i / width) * width + (width - 1 - i % width))).otherwise(px)
    if parameter == "flip_v":
        return F.when(value != 0, at(lambda i: (height - 1 - F.floor(i / width)) * width + i % width)).otherwise(px)
    if parameter == "noise":
        most = whole(value)
        shift = lambda i: F.floor(draw(F.lit("noise") if key is None else key, i) * (2 * most + 1)) - most
        return F.transform(px, lambda v, i: held(v + shift(i)))
    if parameter == "blur":
        return blurred(px, width, value)
    if parameter == "sharpness":  # against a smoothed image: a 3 x 3 mean with five parts of the middle, edges as they are

        def smooth(v: Column, i: Column) -> Column:
            x, y = i % width, F.floor(i / width)
            near = [F.get(px, (i + dy * width + dx).cast("int")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
            inside = (x > 0) & (x < width - 1) & (y > 0) & (y < height - 1)
            return F.when(inside, F.floor((sum(near[1:], near[0]) + 5 * v) / 13 + 0.5).cast("int")).otherwise(v)

        return F.transform(px, lambda v, i: blend(smooth(v, i), v, value))
    if parameter == "shear":  # about the middle row; what comes from outside is black, between two pixels is mixed

        def from_row(i: Column) -> Column:
            y = F.floor(i / width)
            x = i % width + 0.5 + value * (y + 0.5) - value * height / 2
            left = F.floor(x - 0.5)
            pixel = lambda c: F.get(px, (y * width + F.greatest(F.lit(0), F.least(F.lit(width - 1), c))).cast("int"))
            mixed = pixel(left) + (x - 0.5 - left) * (pixel(left + 1) - pixel(left))
            return F.when((x >= 0) & (x < width), F.floor(mixed).cast("int")).otherwise(0)

        return F.transform(F.sequence(F.lit(0), n - 1), from_row)
    raise ValueError(f"unknown parameter {parameter!r} for grey images")


def changed_colours(b: Column, g: Column, r: Column, parameter: str, value: Column) -> list[Column]:
    """Saturation, hue and temperature of one pixel's channels, 0-255."""
    held = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c.cast("int")))
    if parameter == "temperature":
        return [held(b - whole(value)), g, held(r + whole(value))]
    if parameter == "saturation":  # against the luminance of ITU-R BT.601
        grey = F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).cast("int")
        return [blend(grey, c, value) for c in (b, g, r)]
    if parameter == "hue":  # whole steps of two degrees on eight-bit hue, saturation and value
        top, low = F.greatest(b, g, r), F.least(b, g, r)
        chroma = top - low
        h = F.when(chroma == 0, F.lit(0.0)).when(top == r, (g - b) / chroma).when(top == g, (b - r) / chroma + 2).otherwise((r - g) / chroma + 4)
        turned = F.pmod(F.rint(F.pmod(h, F.lit(6.0)) * 30) + whole(value), F.lit(180.0)) / 30
        share = F.when(top == 0, F.lit(0.0)).otherwise(F.rint(255.0 * chroma / top) / 255)
        side = F.floor(turned).cast("int")
        rest = turned - side
        low, down, up = (F.rint(top * (1 - share * k)) for k in (F.lit(1.0), rest, 1 - rest))
        top = F.rint(F.lit(1.0) * top)
        pick = lambda *v: held(F.element_at(F.array(*v), side + 1))
        return [pick(low, low, up, top, top, down), pick(up, top, top, down, low, low), pick(top, down, low, low, up, top)]
    raise ValueError(f"unknown parameter {parameter!r} for colours")
