"""Whitening of embeddings by two-pass covariance.

1. Every entry becomes a whole number, ``floor(SCALE * c) + OFFSET``; sums of those are exact, so the mean is known as the fraction S / n.
2. A second pass centres before it multiplies: n * x - S is a whole number too, divided by n once. Each batch adds
   its outer products by one matrix product; a row for each partition goes into ``treeAggregate``, whose depth grows with the
   number of partitions, so that neither a task nor the driver gets more than ``FAN_IN`` matrices or so.
3. LAPACK's symmetric solver gives the eigenvectors on the driver, where a matrix of dimension by dimension is all there is.
   The projection, components by dimension, is broadcast; both are bounded by ``DIMENSION``, beyond which it is an error.
4. The covariance of what comes out is measured by a third pass, centred batch by batch; its distance from the
   identity is a column of the result.

The table is read once for its length, once for each pass and once for the result; one that isn't cheap to read again, or
not the same each time, should be written first. No row is shuffled.

Defined results: vectors that are null or empty or hold null or non-finite entries are dropped, and so are those of
another length than the commonest (of equally common ones the longest); entries beyond ``LIMIT`` count as that limit;
repeated rows are rows; a null id stays null. Components whose eigenvalue is no more than rounding (equal vectors,
dimensions that depend on each other) have a null ``whitened`` and are left out of ``identity_error``, which is null if none
is left. ``deviation`` is null where it doesn't fit a long. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Whole numbers are at most this far from zero before the offset is added.
LIMIT = 2**62
#: The largest length of a vector; a matrix of that many rows has 128 MB.
DIMENSION = 4096
#: Matrices that are merged at a time.
FAN_IN = 16
#: Vectors as doubles and their products that a task holds at a time, in bytes.
BLOCK = 16 << 20


def whole(vectors: pa.Array, d: int) -> np.ndarray:
    """(rows, d) of longs from a list array without nulls whose lists have d entries."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        made = np.clip(np.floor(SCALE * flat), -LIMIT, LIMIT).astype(np.int64)
    return (made + OFFSET).reshape(-1, d)


def exact_sums(x: np.ndarray) -> list[int]:
    if len(x) and max(int(x.max()), -int(x.min())) > 2**62 // len(x):
        x = x.astype(object)
    return [int(s) for s in x.sum(0)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: longs, or Python's own numbers where longs don't hold it."""
    most = max(int(x.max()), -int(x.min())) if x.size else 0
    if n * most + max(map(abs, sums)) < 2**63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squared(c: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows, null beyond a long."""
    if c.dtype != object and c.size and max(int(c.max()), -int(c.min())) >= math.isqrt(2**63 // c.shape[1]):
        c = c.astype(object)
    return [int(s) if s < 2**63 else None for s in (c * c).sum(1)]


def blocks(batches, column: int, d: int):
    """(batch, rows, matrix of longs) in blocks of bounded size."""
    step = max(1, BLOCK // (8 * d))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, whole(part.column(column), d)


def merged(partial: DataFrame, plus):
    """Merge a row for each partition in a tree; None if there is none."""
    rows = partial.rdd
    depth = max(2, math.ceil(math.log(max(2, rows.getNumPartitions()), FAN_IN)))
    either = lambda a, b: b if a is None else a if b is None else plus(a, b)
    return rows.treeAggregate(None, lambda a, row: either(a, (row[0], bytes(row[1]), bytes(row[2]))), either, depth)


def add_moments(a: tuple, b: tuple) -> tuple:
    """Counts, means and sums of centred products of two parts, put together."""
    n, (ma, mb) = a[0] + b[0], (np.frombuffer(x[1]) for x in (a, b))
    gap = mb - ma
    products = np.frombuffer(a[2]) + np.frombuffer(b[2]) + (np.outer(gap, gap) * (a[0] * b[0] / n)).ravel()
    return n, (ma + gap * (b[0] / n)).tobytes(), products.tobytes()


def moments(parts):
    """One row, or none, from matrices of doubles: n, mean, centred products."""
    total = None
    for y in parts:
        if len(y):
            mean = y.mean(0)
            own = (len(y), mean.tobytes(), ((y - mean).T @ (y - mean)).ravel().tobytes())
            total = own if total is None else add_moments(total, own)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(total, PART)], names=["n", "a", "b"])


PART, PART_SCHEMA = (pa.int64(), pa.binary(), pa.binary()), "n bigint, a binary, b binary"


def whiten(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = docs.sparkSession
    small_batches(spark)
    finite = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = docs.filter(finite & (F.size(vector_col) > 0)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    d = common["d"]
    if d > DIMENSION:
        raise ValueError(f"vectors of {d} entries; at most {DIMENSION} are supported")
    rows = rows.filter(F.size("v") == d)
    vectors = rows.select("v")

    def summed(batches):
        n, total = 0, [0] * d
        for _, x in blocks(batches, 0, d):
            n, total = n + len(x), [a + b for a, b in zip(total, exact_sums(x))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([repr(total).encode()], pa.binary()), pa.array([b""], pa.binary())], names=["n", "a", "b"])

    def add_sums(a, b):
        sums = [[int(s) for s in x[1][1:-1].split(b",")] for x in (a, b)]
        return a[0] + b[0], repr([p + q for p, q in zip(*sums)]).encode(), b""

    n, listed, _ = merged(vectors.mapInArrow(summed, PART_SCHEMA), add_sums)
    sums = [int(s) for s in listed[1:-1].split(b",")]

    def products(batches):
        total, count = np.zeros((d, d)), 0
        for _, x in blocks(batches, 0, d):
            y = centred(x, n, sums).astype(np.float64) / n
            total, count = total + y.T @ y, count + len(y)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=["n", "a", "b"])

    def add_products(a, b):
        return a[0] + b[0], (np.frombuffer(a[1]) + np.frombuffer(b[1])).tobytes(), b""

    _, raw, _ = merged(vectors.mapInArrow(products, PART_SCHEMA), add_products)
    covariance = np.frombuffer(raw).reshape(d, d) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    sound = values > max(0.0, float(values[0])) * d * np.finfo(float).eps
    scaled = axes[:, sound] / np.sqrt(values[sound])
    k, n_sound = len(values), int(sound.sum())
    explained = [float(v) / trace if trace > 0 else 0.0 for v in values]
    sent = spark.sparkContext.broadcast((sums, scaled))

    def projected(x):
        own_sums, projection = sent.value
        c = centred(x, n, own_sums)
        return c, (c.astype(np.float64) / n) @ projection

    error = None
    if n_sound:
        measured = vectors.mapInArrow(lambda batches: moments(projected(x)[1] for _, x in blocks(batches, 0, d)), PART_SCHEMA)
        found = np.frombuffer(merged(measured, add_moments)[2]).reshape(n_sound, n_sound) / n
        error = float(np.abs(found - np.eye(n_sound)).max())

    def result(batches):
        for part, x in blocks(batches, 1, d):
            c, y = projected(x)
            m = len(x)
            white = np.full((m, k), np.nan)
            white[:, sound] = y
            every = lambda value, t: pa.array([value], t).take(pa.array(np.zeros(m * k, np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    every(n, pa.int64()),
                    pa.array(squared(c), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(white.ravel(), mask=np.tile(~sound, m)),
                    pa.array(np.tile(explained, m)),
                    every(error, pa.float64()),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(result, schema).withColumnRenamed("id", id_col)
