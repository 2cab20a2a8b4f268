"""Pixel kernels and plans against models in plain Python."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ethospark.functions import exprs as X
from ethospark.operators import augment


def image(n=7, m=6, seed=1):
    r = random.Random(seed)
    return [[r.randrange(256) for _ in range(n)] for _ in range(m)]


def changed(spark, img, parameter, value, key=None):
    flat = [v for row in img for v in row]
    c = augment.changed_pixels(F.col("px"), len(img[0]), parameter, F.lit(value), None if key is None else F.lit(key))
    made = spark.createDataFrame([(flat,)], "px array<int>").select(c.alias("c")).first()["c"]
    return [made[i : i + len(img[0])] for i in range(0, len(made), len(img[0]))]


def cut(v):
    return max(0, min(255, int(v)))


@pytest.mark.parametrize("value", [0.0, 0.5, 1.0, 1.5])
def test_brightness_contrast_sharpness(spark, value):
    img = image()
    f = np.float32(value)
    mix = lambda plain, v: cut(np.float32(plain) + f * np.float32(v - plain)) if np.float32(plain) + f * np.float32(v - plain) > 0 else 0
    assert changed(spark, img, "brightness", value) == [[mix(0, v) for v in row] for row in img]
    mean = int(sum(map(sum, img)) / 42 + 0.5)
    assert changed(spark, img, "contrast", value) == [[mix(mean, v) for v in row] for row in img]
    smooth = [row[:] for row in img]
    for y in range(1, 5):
        for x in range(1, 6):
            near = sum(img[y + b][x + a] for a in (-1, 0, 1) for b in (-1, 0, 1)) + 4 * img[y][x]
            smooth[y][x] = int(near / 13 + 0.5)
    assert changed(spark, img, "sharpness", value) == [[mix(s, v) for s, v in zip(p, q)] for p, q in zip(smooth, img)]
    if value == 1.0:
        assert all(changed(spark, img, k, value) == img for k in ("brightness", "contrast", "sharpness"))


@pytest.mark.parametrize("value", [-0.4, 0.0, 0.3])
def test_shear(spark, value):
    img = image()
    want = []
    for y, row in enumerate(img):
        out = []
        for x in range(7):
            at = x + 0.5 + value * (y + 0.5) - value * 6 / 2
            left = math.floor(at - 0.5)
            a, b = (row[max(0, min(6, k))] for k in (left, left + 1))
            out.append(int(a + (at - 0.5 - left) * (b - a)) if 0 <= at < 7 else 0)
        want.append(out)
    assert changed(spark, img, "shear", value) == want
    if value == 0:
        assert want == img


def test_blur_is_a_gaussian(spark):
    """By its value: variance of a blurred point is the squared radius, even values step down, wider is flatter."""
    n = 61
    point = [[0] * n for _ in range(n)]
    point[30][30] = 255 * 40  # over 255, so that the tails are not rounded away
    flat = np.array(point)
    for radius in (1, 3, 5):
        made = augment.gaussian(flat * 1.0, radius) * 1.0
        line = np.array(augment.gaussian(np.tile([0] * 30 + [255] + [0] * 30, (3, 1)), radius))[1].astype(float)
        at = np.arange(n) - 30
        want = 255 * np.exp(-(at**2) / (2 * radius**2)) / (radius * math.sqrt(2 * math.pi))
        assert np.abs(line - want).max() < 0.04 * 255 / radius + 1 and made.sum() > 0
    img = image(9, 9)
    assert changed(spark, img, "blur", 4.0) == changed(spark, img, "blur", 3.9) == augment.gaussian(np.array(img), 3).tolist()
    assert changed(spark, img, "blur", 0.2) == augment.gaussian(np.array(img), 1).tolist()
    same = [[90] * 9 for _ in range(9)]
    assert changed(spark, same, "blur", 5.0) == same


def test_noise_depends_on_the_image(spark):
    grey = [[128] * 20 for _ in range(20)]
    a, b, again = (np.array(changed(spark, grey, "noise", 9.7, k)) for k in ("a", "b", "a"))
    assert (a == again).all() and (a != b).any() and a.min() == 119 and a.max() == 137
    assert changed(spark, image(), "noise", 0.0, "a") == image()


def test_flips(spark):
    img = image()
    assert changed(spark, img, "flip_h", 1.0) == [r[::-1] for r in img] and changed(spark, img, "flip_v", 1.0) == img[::-1]
    assert changed(spark, img, "flip_h", 0.0) == img


def colours(spark, pixels, parameter, value):
    df = spark.createDataFrame(pixels, "b int, g int, r int")
    made = augment.changed_colours(F.col("b"), F.col("g"), F.col("r"), parameter, F.lit(value))
    return [tuple(r) for r in df.select(*[c.alias(n) for c, n in zip(made, "bgr")]).collect()]


def test_colours(spark):
    import colorsys

    r = random.Random(2)
    some = [tuple(r.randrange(256) for _ in range(3)) for _ in range(300)] + [(0, 0, 0), (255, 255, 255), (7, 7, 7)]
    assert colours(spark, some, "temperature", 12.9) == [(cut(b - 12), g, cut(q + 12)) for b, g, q in some]
    grey = lambda b, g, q: int(0.299 * q + 0.587 * g + 0.114 * b + 0.5)
    assert colours(spark, some, "saturation", 0.0) == [(grey(*p),) * 3 for p in some]
    assert colours(spark, some, "saturation", 1.0) == some
    for turn in (0.0, 25.0, 170.0):
        for (b, g, q), got in zip(some, colours(spark, some, "hue", turn)):
            h, s, v = colorsys.rgb_to_hsv(q / 255, g / 255, b / 255)
            want = colorsys.hsv_to_rgb((h + turn / 180) % 1, s, v)
            # a hue in whole steps of two degrees is off by a degree, a sixtieth of the chroma
            assert all(abs(255 * w - c) <= 2 + (max(b, g, q) - min(b, g, q)) / 50 for w, c in zip(want[::-1], got))


def draw(*key):
    """Spark's hash of a key's columns, text and 32-bit numbers, one after the other."""
    h = 42
    for k in key:
        h = xxhash.xxh64_intdigest(k.encode() if isinstance(k, str) else int(k).to_bytes(4, "little"), seed=h)
    return (h % (1 << 40)) / (1 << 40)


def test_plan_equals_model(spark):
    params = [("brightness", 0.5, [(0.5, 0.8), (1.2, 1.6)], False), ("blur", 0.3, [(3.0, 7.0)], True), ("flip_h", 0.4, [(1.0, 1.0)], False)]
    names = [f"d_{i}" for i in range(400)] + ["d_1_aug_blur"]
    want = []
    for n in names:
        if "_aug_" in n or draw(n, 7, "gate") >= 0.6:
            continue
        for p, share, segments, odd in params:
            if draw(n, 7, p) < share:
                for i, (lo, hi) in enumerate(segments):
                    v = lo + (hi - lo) * draw(n, 7, p, i, "value")
                    v = 2 * math.floor(v / 2) + 1 if odd else v
                    want.append((n, p, i, v, f"{n}_aug_{p}" + (f"_{i}" if len(segments) > 1 else "")))
    kind = "parameter string, probability double, segments array<struct<kind:string,lo:double,hi:double>>, whole boolean"
    table = spark.createDataFrame([(p, s, [("range", lo, hi) for lo, hi in segments], odd) for p, s, segments, odd in params], kind)
    got = augment.plan(spark.createDataFrame([(n,) for n in names], "basename string"), table, 0.6, seed=7).collect()
    places = lambda rows: sorted((*r[:3], round(float(r[3]), 9), r[4]) for r in rows)
    assert len(want) > 200 and places(got) == places(want)


def test_progress_lines_and_control_sequences(spark):
    lines = {
        " 12% |####  | 3/25": True, "100%|": True, "% |": False, "a% |": False, "50 % |": False, "50%  x": False, "5%| and 7%": True,
        "   3/50 loss": True, "\t3/50\tx": True, "3/50 loss": False, " 3/50": False, " 3/50x y": False, " /50 x": False, " 3/ x": False, " 1/2/3 x": False, "": False,
    }
    df = spark.createDataFrame([(k,) for k in lines], "t string")
    assert {r[0]: r[1] for r in df.select("t", X.is_progress_line(F.col("t"))).collect()} == lines
    coded = {"\x1b[31mred\x1b[0m": "red", "\x1b[2K\x1b[1Gx": "x", "\x1b[?25lhid\x1b[?25h": "hid", "\x1b[1;2 qe": "e", "\x1b]0;t": "\x1b]0;t", "[31m": "[31m", "\x1b[>0cz": "z"}
    df = spark.createDataFrame([(k,) for k in coded], "t string")
    assert {r[0]: r[1] for r in df.select("t", X.strip_ansi(F.col("t"))).collect()} == coded
    got = spark.range(1).select(X.progress(F.lit(5), F.lit(1), F.lit(200)).alias("p")).first()["p"]
    assert got == 5.0
