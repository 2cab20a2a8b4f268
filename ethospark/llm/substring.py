"""Exact substring deduplication by seed and extend: every word of a passage of ``WINDOW`` words that is found twice goes.

1. Seeds. Of the ``REACH`` runs of ``SEED`` words in a window, the one with the least hash is the window's anchor
   (winnowing). Equal windows have equal anchors at the same offset, so passages that share a window share an anchor.
   Anchors are counted over all documents; those found once can't belong to a repeat.
2. Extension. The windows of one anchor follow each other; together they are its span, the anchor with as many
   words to the left and right as those windows reach. A span that is found twice is repeated as a whole. Where an anchor
   has several different spans, copies begin or end nearby: their windows, a word further to either side each, are compared
   one by one, once for each different span. Nothing is made for pairs of occurrences, so an anchor of a million occurrences costs
   a million rows.
3. Maximal repeats. Repeated windows that follow each other are one passage; its words are removed.

Windows are judged on the input, so all copies go, the first one too. Words and windows are compared by 64-bit hashes
of words, 128 bits for spans and for anchor with window.

Memory: a task holds one batch of texts, one text in segments of ``SEGMENT`` bytes as words, and a byte for each word of
it. Shuffles: anchors with their counts, spans of repeated anchors, and each text once with the places of its repeats.
Results of earlier steps are functions of the texts alone, so a lost part is made again as it was.

Defined results: a null or blank text has no words; repeated rows are copies of each other, as are rows that share an
id; a text under ``WINDOW`` words keeps all of them; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import arrow_map, checkpointed, join_by_key, small_batches
from .dedup import mixed

WINDOW, SEED = 35, 12
#: Bytes of a text that become words at a time.
SEGMENT = 4 << 20
#: Words of texts that are worked on at a time, about, and texts of a batch that become Python objects at a time.
CHUNK, ROWS = 1 << 15, 1000
SPAN = ["s1", "s2"]
#: Different spans of an anchor that are compared in one row.
KINDS = 64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C15
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def segments(text: bytes | None):
    """Lists of words that together are the text's words."""
    text, at = text or b"", 0
    while at < len(text):
        end = at + SEGMENT
        if end < len(text):
            space = _SPACE.search(text, end)
            end = space.start() if space else len(text)
        yield text[at:end].split()
        at = end


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


@dataclass
class Chunk:
    """Words of several texts one after the other: hashes, and for each piece of a text its row, how many words it has, and the
    place of its first word in the text."""

    ids: np.ndarray
    rows: np.ndarray
    sizes: np.ndarray
    places: np.ndarray


def chunks(column, extra: int):
    """The words of texts in chunks of ``CHUNK`` words or so; a piece of a long text begins with the last ``extra`` words of the one before."""
    ids, rows, sizes, places = [], [], [], []

    def made():
        return Chunk(np.concatenate(ids), np.array(rows), np.array(sizes), np.array(places))

    for row, text in enumerate(column):
        place, rest = 0, np.empty(0, np.uint64)
        for words in segments(text):
            own = np.concatenate([rest, word_ids(words)]) if len(rest) else word_ids(words)
            ids.append(own)
            rows.append(row)
            sizes.append(len(own))
            places.append(place)
            keep = min(extra, len(own))
            place, rest = place + len(own) - keep, own[len(own) - keep :]
            if sum(sizes) >= CHUNK:
                yield made()
                ids, rows, sizes, places = [], [], [], []
    if ids:
        yield made()


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    if len(_POWERS[0]) <= n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(2 * n + 1, base, np.uint64)
            step[0] = 1
            _POWERS[i] = np.cumprod(step, dtype=np.uint64)
    return _POWERS


class Rolling:
    """Hashes of runs of words, each in constant time."""

    def __init__(self, ids: np.ndarray):
        up, self.down = powers(len(ids) + 1)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(ids * up[: len(ids)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


class Runs:
    """The anchors of the texts in a chunk, each with its run of windows: the anchor's hash and place, the run's first and last window
    (not included) in the chunk."""

    def __init__(self, chunk: Chunk, window: int, seed: int, wanted: np.ndarray | None = None):
        """``wanted``: a sorted array of the anchors that count; all if there is none."""
        ids, reach, n = chunk.ids, window - seed + 1, max(0, len(chunk.ids) - window + 1)
        self.chunk, self.window, self.ids = chunk, window, mixed(ids)
        self.rolling = Rolling(self.ids)
        self.anchor, self.start, self.end, self.at = np.empty((4, 0), np.int64)
        if not n:
            return
        place = np.arange(len(ids) - seed + 1)
        gram = self.rolling.of(place, place + seed)
        # the least hash first, of equal ones the leftmost
        least, size = (gram >> np.uint64(32) << np.uint64(32)) | place.astype(np.uint64), 1
        while 2 * size <= reach:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        least = np.minimum(least[:n], least[reach - size : reach - size + n])
        ends = np.repeat(np.cumsum(chunk.sizes), chunk.sizes)
        whole = np.flatnonzero(np.arange(n) + window <= ends[:n])  # windows that lie in one text
        if not len(whole):
            return
        at = (least[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(whole) != 1)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(whole)]]) - 1
        self.start, self.end, self.at = whole[first], whole[last] + 1, at[first]
        self.anchor = gram[self.at].astype(np.int64)
        if wanted is not None:
            here = np.searchsorted(wanted, self.anchor)
            here = wanted[np.minimum(here, len(wanted) - 1)] == self.anchor if len(wanted) else np.zeros(len(here), bool)
            self.anchor, self.start, self.end, self.at = self.anchor[here], self.start[here], self.end[here], self.at[here]

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of what a run holds, and where its anchor is in it."""
        shape = mixed(((self.end - self.start) * 4096 + self.at - self.start).astype(np.uint64))
        last = self.end + self.window - 1
        both = self.rolling, Rolling(mixed(self.ids ^ _OTHER))
        s1, s2 = (mixed(r.of(self.start, last) + shape).astype(np.int64) for r in both)
        return s1, s2

    def windows(self, some: np.ndarray) -> pa.ListArray:
        """A hash for each window of some runs, of its words and its anchor's place in it."""
        sizes = self.end[some] - self.start[some]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(offsets[-1]) + np.repeat(self.start[some] - offsets[:-1], sizes)
        shift = np.repeat(self.at[some], sizes) - place + 1
        made = mixed(self.rolling.of(place, place + self.window) + mixed(shift.astype(np.uint64))).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(made))

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The text of a run, by its row, and its first window's place in it."""
        begin = np.cumsum(self.chunk.sizes) - self.chunk.sizes
        piece = np.searchsorted(begin, self.start, "right") - 1
        return self.chunk.rows[piece], self.start - begin[piece] + self.chunk.places[piece]


def each_run(batches, window: int, seed: int, wanted: np.ndarray | None):
    """(rows of the batch, :class:`Runs`) for the texts of Arrow batches, whose last column they are."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            column = part.column(part.num_columns - 1)
            with np.errstate(over="ignore"):
                for chunk in chunks(column.cast(pa.binary()).to_pylist(), window - 1):
                    yield part, Runs(chunk, window, seed, wanted)


def first_of_each(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the different rows of some columns are for the first time, and how many there are of each."""
    order = np.lexsort(columns)
    if not len(order):
        return order, order
    new = np.concatenate([[True], np.any([np.diff(c[order]) != 0 for c in columns], axis=0)])
    begin = np.flatnonzero(new)
    return order[begin], np.diff(np.concatenate([begin, [len(order)]]))


def repeated_anchors(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """anchor, n: those found more than once in the whole table."""

    def run(batches):
        for _, runs in each_run(batches, window, seed, None):
            anchor, n = np.unique(runs.anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], names=["anchor", "n"])

    made = texts.select("text").mapInArrow(run, "anchor bigint, n bigint")
    return made.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")


def spans_of(texts: DataFrame, sent, window: int, seed: int) -> DataFrame:
    """anchor, s1, s2, n, windows: the different spans of the sent anchors (of all anchors if none are sent)."""

    def run(batches):
        for _, runs in each_run(batches, window, seed, sent.value if sent is not None else None):
            s1, s2 = runs.spans()
            some, n = first_of_each(s1, s2)
            columns = [pa.array(runs.anchor[some]), pa.array(s1[some]), pa.array(s2[some]), pa.array(n), runs.windows(some)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "s1", "s2", "n", "windows"])

    return texts.select("text").mapInArrow(run, "anchor bigint, s1 bigint, s2 bigint, n bigint, windows array<bigint>")


def spans_asked(texts: DataFrame, sent, window: int, seed: int) -> DataFrame:
    """k1, k2, start, s1, s2: where such spans begin in each text (k1, k2)."""

    def run(batches):
        for part, runs in each_run(batches, window, seed, sent.value if sent is not None else None):
            row, start = runs.rows()
            keys = [part.column(i).take(pa.array(row)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(start), *map(pa.array, runs.spans())], names=["k1", "k2", "start", "s1", "s2"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 bigint, k2 bigint, start bigint, s1 bigint, s2 bigint")


def repeated_windows(spans: DataFrame) -> DataFrame:
    """s1, s2, mask: which of the windows of a span are found elsewhere, as bits.

    The spans of an anchor with up to ``KINDS`` of them are compared in one row; windows of other anchors are counted one by one.
    """
    kinds = checkpointed(spans.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    several = join_by_key(spans, kinds, "anchor", "kinds")
    few = several.filter(F.col("kinds") <= KINDS).groupBy("anchor").agg(F.collect_list(F.struct(*SPAN, "n", "windows")).alias("all"))
    partly = few.select("all").mapInArrow(compared, "s1 bigint, s2 bigint, mask bigint")
    hot = kinds.filter(F.col("kinds") > KINDS)
    if not hot.isEmpty():
        each = join_by_key(spans, hot, "anchor", "kinds").select("anchor", *SPAN, "n", F.posexplode("windows").alias("bit", "window"))
        # a window of a span that is found twice is repeated anyway, but counts for others
        count = each.groupBy("anchor", "window").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
        found = checkpointed(count.filter("total > 1 and rows > 1").select(F.struct("anchor", "window").alias("w"), "rows"))
        alone = each.filter("n = 1").select(*SPAN, "bit", F.struct("anchor", "window").alias("w"))
        bits = join_by_key(alone, found, "w", "rows").select(*SPAN, F.expr("shiftleft(1L, bit)").alias("m"))
        partly = partly.unionByName(bits.groupBy(*SPAN).agg(F.bit_or("m").alias("mask")))
    whole = spans.filter("n > 1").select(*SPAN, F.expr("shiftleft(1L, size(windows)) - 1").alias("mask"))
    return whole.unionByName(partly)


def compared(batches):
    """s1, s2, mask of the spans that are found once, from rows with all spans of an anchor."""
    for batch in batches:
        out = [], [], []
        for spans in batch.column(0).to_pylist():
            total = Counter()
            for x in spans:
                for w in x["windows"]:
                    total[w] += x["n"]
            for x in spans:
                mask = sum(1 << i for i, w in enumerate(x["windows"]) if total[w] > 1) if x["n"] == 1 else 0
                if mask:
                    for values, v in zip(out, (x["s1"], x["s2"], mask)):
                        values.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["s1", "s2", "mask"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """id, n_words, n_removed, repeats (array of start, end: the maximal repeats in words), kept (the other words as UTF-8)."""
    if not 1 <= seed <= window or window - seed > 61:
        raise ValueError("a seed has 1 to window words, and at most 61 fewer than a window")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    small_batches(own.sparkSession)
    anchors = checkpointed(repeated_anchors(own, window, seed))
    small = 8 * anchors.count() <= common.SENT_BYTES
    sent = None
    if small:
        known = np.sort(anchors.select("anchor").toArrow().column(0).to_numpy())
        sent = own.sparkSession.sparkContext.broadcast(known)
    spans = spans_of(own, sent, window, seed)
    spans = spans if small else join_by_key(spans, anchors.withColumnRenamed("n", "size"), "anchor", "size").drop("size")
    spans = spans.groupBy("anchor", *SPAN).agg(F.sum("n").alias("n"), F.any_value("windows").alias("windows"))
    masks = checkpointed(repeated_windows(checkpointed(spans)))

    # rows equal in id and text have equal results and share a key
    keys = [F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "id").alias("k2")]

    asks = spans_asked(own.select(*keys, "text"), sent, window, seed)
    # a span that very many texts share is split by the join
    found = asks.join(masks, SPAN).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "mask")).alias("found"))
    kind = dict(own.dtypes)["id"]

    def told(ids, column, found):
        out = [], [], [], []
        for text, have in zip(column, found):
            for values, made in zip(out, without(text, [(x["start"], x["mask"]) for x in have or ()], window)):
                values.append(made)
        return ids, *out

    whole = own.select(*keys, "id", "text").join(found, ["k1", "k2"], "left").select("id", "text", "found")
    schema = f"id {kind}, n_words bigint, n_removed bigint, repeats array<struct<start: bigint, end: bigint>>, kept binary"
    return arrow_map(whole, told, schema).withColumnRenamed("id", id_col)


def without(text: bytes | None, found: list[tuple[int, int]], window: int) -> tuple:
    """n_words, n_removed, the maximal repeats, and the words that are left, given (first window, bits) of its spans."""
    starts = sorted({start + bit for start, mask in found for bit in range(mask.bit_length()) if mask >> bit & 1})
    merged: list[list[int]] = []
    for start in starts:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = start + window
        else:
            merged.append([start, start + window])
    n, kept, at = 0, [], 0
    for words in segments(text):
        first = 0
        while at < len(merged) and merged[at][0] < n + len(words):
            kept.extend(words[first : max(first, merged[at][0] - n)])
            first = min(len(words), merged[at][1] - n)
            if merged[at][1] > n + len(words):
                break
            at += 1
        kept.extend(words[first:])
        n += len(words)
    removed = sum(end - start for start, end in merged)
    return n, removed, [{"start": s, "end": e} for s, e in merged], b" ".join(kept)
