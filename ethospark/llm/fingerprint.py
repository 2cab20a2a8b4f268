"""Document fingerprints by order min-hash.

A text is the set of its k-mers of code points, each with its occurrence number, so repeats count. Under each of
``SLOTS`` random orders the ``TUPLE`` least elements are taken, put back into text order and hashed: two texts
agree in a slot with a probability that falls with their edit distance, as it needs the same k-mers in the same
order. A fingerprint is the slots' hashes in fixed-width hexadecimal (16 bits each); the likeness of two is their share of equal
slots.

Ids can be of any type with an order. Documents are put in order without a global sort: cut points, pairs of id and
text hash taken from a bounded sample of the table, divide it into ranges.

Defined results: a null or empty text has the empty fingerprint, which is like itself (1) and unlike any other
(0); a text shorter than a k-mer is one element; equal texts have equal fingerprints; rows without an id come
first, ties in the id are ordered by a hash of the text, so rows that share an id are spread as well and only rows equal in
both stay together; a table of one row is its own neighbour; an empty table gives an empty table; other columns are
not read; bytes that are no UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, text_of

KMER, TUPLE, SLOTS = 5, 2, 64
#: Rows sampled for each range's cut point, about.
SAMPLED = 20
#: Elements hashed at once: the working set stays in a core's cache however long the text.
BLOCK = 1 << 17

#: Bits of a word that hold a place; the others hold the k-mer's hash.
PLACES = np.uint64(22)

_ODD = np.random.default_rng(11).integers(0, 2**31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def elements(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-numbered k-mers, and their places in the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(1, len(points) - KMER + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(KMER, len(points))):
        h = (h + points[k : n + k]) * _MIX
    # equal k-mers next to each other, in text order
    kmer = _spread(h) >> PLACES
    if n >> int(PLACES):
        place = np.argsort(kmer, kind="stable")
        kmer = kmer[place]
    else:  # the same with the places in the low bits, which sorts faster
        both = np.sort((kmer << PLACES) | np.arange(n, dtype=np.uint64))
        place, kmer = (both & np.uint64((1 << int(PLACES)) - 1)).astype(np.int64), both >> PLACES
    at = np.arange(n)
    starts = np.empty(n, bool)
    starts[0] = True
    np.not_equal(kmer[1:], kmer[:-1], out=starts[1:])
    occurrence = at - np.maximum.accumulate(np.where(starts, at, 0))
    return _spread(kmer + occurrence.astype(np.uint64) * _MIX), place


def fingerprint(text: str | None) -> str:
    if not text:
        return ""
    x, place = elements(text)
    low, n = x.astype(np.uint32), len(x)
    take = min(TUPLE, n)
    rows = max(1, BLOCK // n)
    picked = np.empty((SLOTS, take), np.int64)
    for i in range(0, SLOTS, rows):
        y = low[None, :] * _ODD[i : i + rows, None]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x846CA68B)
        own = np.arange(len(y))
        for t in range(take):
            best = y.argmin(1)
            picked[i : i + rows, t] = best
            y[own, best] = np.uint32(0xFFFFFFFF)
    order = np.argsort(place[picked], axis=1)
    tuples = x[np.take_along_axis(picked, order, 1)]
    h = _SLOT.copy()
    for t in range(take):
        h = _spread(h * _MIX + tuples[:, t])
    return (h >> np.uint64(48)).astype(np.uint16).tobytes().hex()


def likeness(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(bytes.fromhex(a), np.uint16)
    return float((x == np.frombuffer(bytes.fromhex(b), np.uint16)).mean())


def cut_points(keyed: DataFrame, pieces: int) -> list[tuple]:
    """At most ``pieces`` pairs (id, h) of the table that divide it evenly, the least pair first; ascending."""
    n = keyed.count()
    wanted = SAMPLED * pieces
    sample = (
        keyed.filter(F.pmod(F.xxhash64("id", "h"), F.lit(1_000_000)) <= 1_000_000 * wanted // max(n, 1))
        .select("id", "h")
        .distinct()
        .limit(4 * wanted)
    )
    least = keyed.orderBy("id", "h").select("id", "h").limit(1).collect()
    some = sorted({sort_key(r["id"], r["h"]) for r in sample.collect()} | {sort_key(r["id"], r["h"]) for r in least})
    return sorted({some[0], *(some[len(some) * k // pieces] for k in range(1, pieces))}) if some else []


def sort_key(i, h) -> tuple:
    """Orders as Spark does: null ids first."""
    return (i is not None, i if i is not None else 0, h)


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt by ranges of id and text hash, and sorted, each range followed by a copy of the next one's first row.

    The cut points are rows of the table, so a range's first row is known and goes to both ranges in the same shuffle;
    the least row follows the last range. Columns: bucket, guest (1 for such a copy), id, text.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    cuts = spark.sparkContext.broadcast(cut_points(keyed, 2 * partitions(spark)))

    @F.arrow_udf("array<struct<bucket:int,guest:int>>")
    def homes(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        known, out = cuts.value, []
        last = len(known) - 1
        for i, h in zip(ids.to_pylist(), hashes.to_pylist()):
            key = sort_key(i, h)
            bucket = bisect_right(known, key) - 1
            own = [{"bucket": bucket, "guest": 0}]
            if known[bucket] == key:  # the first of its range
                own.append({"bucket": bucket - 1 if bucket else last, "guest": 1})
            out.append(own)
        return pa.array(out, pa.list_(pa.struct([("bucket", pa.int32()), ("guest", pa.int32())])))

    return (
        keyed.withColumn("at", F.explode(homes("id", "h")))
        .select("at.bucket", "at.guest", "id", "h", "text")
        .repartition(partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "guest", "id", "h")
        .drop("h")
    )


def with_successor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every whole text and its edited text, whose second half is the start of the next document.

    id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next. One shuffle; a task holds two rows.
    """
    kind = dict(docs.dtypes)[id_col]
    ids = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(ids), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [id_col, "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None
        with np.errstate(over="ignore"):
            for batch in batches:
                out: list[tuple] = []
                columns = [c.cast(pa.binary()) if k == 3 else c for k, c in enumerate(batch.columns)]
                for bucket, guest, i, raw in zip(*(c.to_pylist() for c in columns)):
                    text = text_of(raw)
                    mark = fingerprint(text)
                    if held is not None and held[0] == bucket and not held[1]:
                        _, _, j, own, own_mark = held
                        half = len(own) // 2
                        edited = own[: len(own) - half] + text[:half]
                        made = fingerprint(edited)
                        out.append((j, len(own), edited, own_mark, made, likeness(own_mark, made), likeness(own_mark, mark)))
                    held = (bucket, guest, i, text, mark)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=names)

    small_batches(docs.sparkSession)
    return in_order(docs, id_col, text_col).mapInArrow(
        run,
        f"`{id_col}` {kind}, n_chars bigint, edited string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )
