"""Near-duplicate groups by min-max hashing, every link confirmed on the full shingle sets.

1. One pass makes, per document, its set's size, a 128-bit signature of the set and ``bands`` band keys. Each
   permutation gives two signature values, its minimum and its maximum, so a band of four values costs two hash
   evaluations per shingle.
2. Documents with equal sets are one class, which gets a number of its own; one document's text stands for it from here on.
3. Classes that share a band key form a bucket. Every class is compared with one other, that
   whose buckets are fullest among all it shares one with, which connects most of what can be. From here on only pairs that aren't connected yet count, and
   buckets whose members all are connected are gone.
4. Small buckets are compared pair by pair. In a large bucket every
   member is compared with one hub, the member whose other buckets are fullest. A link that involves a member which is
   not linked to the hub forces an overlap of the two
   members' differences from the hub (see :func:`difference_keys`), so shared rare elements of those differences
   are the keys of the next, smaller buckets, if a member is not connected to the hub. This repeats until no bucket is
   left: no pair that shares a bucket is given up but those that links connect already, and no bucket emits its pairs.
5. Links are contracted to components along random priorities, so chains take logarithmically many rounds.

There are as many bands as keep the probability that a pair at the threshold misses all of them, (1 - p**4) ** bands,
under ``MISSED``: 20 for the default 85 %, 28 for 80 %.

Defined results: a null or blank text has an empty set, size 0, and is linked with nothing; equal sets (ties,
repeated rows) share a component; rows that share an id but not a text are documents of their own, each in the
component of its text; a null id is never a component; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, join_by_key, sent_if_small, stored, veiled

PER_BAND, MISSED = 2, 5e-7
#: Similarity as a percentage, and words in a shingle, unless a caller gives others.
PERCENT, WIDTH = 85, 3
#: Buckets with at most this many pairs that aren't connected are compared pair by pair.
COMPARISONS = 1000
#: The same for buckets of differences, where most pairs fall to the places of their shared element: what two sets
#: can still share from there on must reach what a link needs.
PLACED = 60_000
#: Members of a hub that are looked at, about, before its members' differences are put in order.
SAMPLE = 32

#: Tables of ids are written in so many times fewer files than the shuffles have partitions.
WIDE, SMALL = 4, 16

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_C = np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted set of 64-bit shingle hashes of a UTF-8 text, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(ids) - width + 1
    made = ids[:n].copy()
    for k in range(1, width):
        made = mixed(made) + ids[k : n + k] * _A
    return np.unique(mixed(made))


def permutations(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_max(elements: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """(permutations, 2): the least and the greatest value under each permutation."""
    out = np.empty((len(multipliers), 2), np.uint64)
    step = max(1, 1 << 16 >> max(0, int(len(elements)).bit_length()))
    for i in range(0, len(multipliers), step):
        y = elements[None, :] * multipliers[i : i + step, None]
        y ^= y >> np.uint64(29)
        y *= _C
        out[i : i + step, 0] = y.min(1)
        out[i : i + step, 1] = y.max(1)
    return out


def bands_for(percent: int) -> int:
    """The least number of bands that a pair at the threshold misses with a probability under ``MISSED``."""
    hit = (percent / 100) ** (2 * PER_BAND)
    return 1 if hit >= 1 else math.ceil(math.log(MISSED) / math.log1p(-hit))


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, the signature of the set (two longs), band keys."""
    n_bands = bands_for(percent)
    multipliers = permutations(n_bands * PER_BAND)
    salts = mixed(np.arange(1, n_bands + 1, dtype=np.uint64))

    def run(ids, texts):
        n, first, second, bands = [], [], [], []
        with np.errstate(over="ignore"):
            for text in texts:
                s = shingles(text, width)
                n.append(len(s))
                first.append(int(mixed(s ^ _B).sum(dtype=np.uint64).astype(np.int64)))
                second.append(int(mixed(s + _C).sum(dtype=np.uint64).astype(np.int64)))
                if not len(s):
                    bands.append([])
                    continue
                rows = min_max(s, multipliers).reshape(n_bands, -1)
                key = salts.copy()
                for j in range(rows.shape[1]):
                    key = mixed(key * _A + rows[:, j])
                bands.append(key.astype(np.int64))
        return ids, n, first, second, bands

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(
        docs.select(F.col(id_col).alias("id"), text_col),
        run,
        f"id {kind}, n_shingles bigint, sig_a bigint, sig_b bigint, bands array<bigint>",
    )


def linked(a: np.ndarray, b: np.ndarray, common: int | None = None, percent: int = PERCENT) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True)) if common is None else common
    return 100 * common >= percent * (len(a) + len(b) - common)


def difference_keys(
    own: np.ndarray, hub: np.ndarray, is_linked: bool, common: np.ndarray, percent: int = PERCENT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The elements by which a hub's member finds its further links: ``half``, ``rest`` and ``far``.

    Any order of elements that is fixed for the hub will do; rare ones come first: those the member adds to the hub,
    then the hub's, at last those that ``common`` lists as frequent among its members' differences.

    With p the threshold, let c = (1 - p) / (1 + p) and e = (1 - p) / p; at 85 % they are 3/37 and 3/17.

    Half and rest are first elements of the symmetric difference D from the hub. A link of u and v means
    |D_u ^ D_v| <= c (|u| + |v|), so they share at least (|D_u| + |D_v| - c (|u| + |v|)) / 2 elements of those.
    With v not linked to the hub, |D_v| > c (|v| + |hub|) makes that more than (|D_u| + c (|hub| - |u|)) / 2, and
    two sets that share so many have a common one in ``half``. If u isn't linked and v is,
    |D_v| >= |D_u| - c (|u| + |v|) and |v| <= |u| / p make it |D_u| - e |u|, as c (1 + 1 / p) = e, which must not be over
    |D_v| <= c (|v| + |hub|); they meet in u's half and rest, and v's half.

    Far is for two members whose D are both over 2 e of the hub, rounded up to a hundredth (36 % at 85 %): a link shares
    p |u| elements, so they meet in the first |u| - p |u| + 1 elements of the sets themselves, which are rare then. Any
    limit is right, it only divides the work. Such a member needs half and rest only for partners that are nearer, so
    not if its D is over that by more than e |u|.
    """
    added = np.setdiff1d(own, hub, assume_unique=True)
    removed = np.setdiff1d(hub, own, assume_unique=True)
    whole = np.concatenate([added, removed])
    n, d, none = len(own), len(whole), own[:0]

    def ordered(elements: np.ndarray, new: np.ndarray) -> np.ndarray:
        late = ~np.isin(elements, new) + 2 * np.isin(elements, common)
        return elements[np.lexsort((mixed(elements), late))]

    order = ordered(whole, added)
    gap, sum_ = 100 - percent, 100 + percent
    half = d - max(1, (sum_ * d + gap * (len(hub) - n)) // (2 * sum_) + 1) + 1
    half = min(d, max(0, half))
    if is_linked:
        return order[:half], none, none
    far, limit = none, -(-200 * gap // percent) * len(hub)
    if 100 * d > limit:
        far = ordered(own, added)[: n - -(-percent * n // 100) + 1]
        if 100 * percent * d > percent * limit + 100 * gap * n:
            return none, none, far
    least = max(1, -((gap * n - percent * d) // percent))
    if percent * sum_ * least > gap * (100 * n + percent * len(hub)):
        return order[:half], none, far
    return order[:half], order[half : max(half, d - least + 1)], far


def frequent_differences(sample: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """b, common: elements in the differences of at least a quarter of a hub's sampled members.

    They only order the elements of a difference, so the sample decides about work and not about results.
    """
    kind = dict(sample.dtypes)["b"]

    def run(b, text_a, text_b):
        out = []
        with np.errstate(over="ignore"):
            for x, y in zip(text_a, text_b):
                out.append(np.setxor1d(shingles(x, width), shingles(y, width), assume_unique=True).astype(np.int64))
        return b, out

    d = arrow_map(with_texts(sample, texts).select("b", "text_a", "text_b"), run, f"b {kind}, d array<bigint>")
    n = sample.groupBy("b").agg(F.count("*").alias("n"))
    return (
        d.select("b", F.explode("d").alias("e"))
        .groupBy("b", "e")
        .agg(F.count("*").alias("c"))
        .filter("c > 1")
        .join(n, "b")
        .filter("4 * c >= n")
        .groupBy("b")
        .agg(F.collect_list("e").alias("common"))
    )


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    return pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"
    )


def compare(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Confirm pairs (a, b, hub, common) on full sets: a, b, linked, and for hub rows the keys of a's difference, its
    size d and a's size n."""
    kind = dict(pairs.dtypes)["a"]
    joined = with_texts(pairs, texts).select(
        "a", "b", "hub", F.xxhash64("b").alias("salt"), "common", "text_a", "text_b"
    )

    def run(a, b, hub, salt, common, text_a, text_b):
        found, half, rest, far, sizes, last, set_b = [], [], [], [], [], None, None
        with np.errstate(over="ignore"):
            for is_hub, s, c, x, y in zip(hub, salt, common, text_a, text_b):
                if y != last or set_b is None:
                    last, set_b = y, shingles(y, width)
                set_a = shingles(x, width)
                found.append(linked(set_a, set_b, percent=percent))
                keys = (set_b[:0],) * 3
                if is_hub:
                    late = np.array(c or [], np.int64).astype(np.uint64)
                    keys = difference_keys(set_a, set_b, found[-1], late, percent)
                common_n = len(np.intersect1d(set_a, set_b, assume_unique=True)) if is_hub else 0
                sizes.append((len(set_a) + len(set_b) - 2 * common_n, len(set_a)))
                for out, k, kind_of in zip((half, rest, far), keys, (_B, _B, _C)):
                    out.append(mixed(k ^ mixed(np.array([s], np.int64).astype(np.uint64) ^ kind_of)).astype(np.int64))
        return a, b, found, half, rest, far, [x[0] for x in sizes], [x[1] for x in sizes]

    return arrow_map(
        joined, run, f"a {kind}, b {kind}, linked boolean, half array<bigint>, rest array<bigint>, far array<bigint>, d bigint, n bigint"
    )


def connected(reps: DataFrame, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """id, label: of each class that shares a band key with another, the least class that links connect it to.

    reps: id (the class's number), doc and h (a document of it: id and hash of its text), bands; docs: doc, h, text.
    """
    rows = reps.select("id", F.explode("bands").alias("key"))
    full = checkpointed(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), WIDE)
    rows = checkpointed(join_by_key(rows, full, "key", "n"), WIDE)
    score = checkpointed(rows.groupBy("id").agg(F.sum("n").alias("score")), SMALL)
    wanted = reps.select("id", "doc", "h").join(sent_if_small(score.select("id")), "id", "left_semi")
    texts = docs.join(sent_if_small(checkpointed(wanted, SMALL), "48"), ["doc", "h"]).select("id", "text")
    texts = checkpointed(texts, WIDE)  # a scan that both sides of a comparison can share one shuffle of
    if not texts.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():  # equal rows: one is enough
        texts = checkpointed(texts.dropDuplicates(["id"]), WIDE)
    alone = [F.lit(False).alias("hub"), F.lit(None).cast("array<bigint>").alias("common")]
    first = lambda c: F.max(F.struct(*c)).alias("first")
    scored = rows.join(sent_if_small(score), "id")
    fullest = checkpointed(scored.groupBy("key").agg(first(["score", "id"]), F.count("*").alias("size")), WIDE)
    fullest = join_by_key(rows, fullest, "key", "size").groupBy("id").agg(F.max("first").alias("first")).filter("first.id <> id")
    done = stored(compare(fullest.select(F.col("id").alias("a"), F.col("first.id").alias("b"), *alone), texts, width, percent))
    labels = joined(checkpointed(score.select("id", F.col("id").alias("label")), SMALL), done)
    done.unpersist()
    # open: not connected to the hub that made the key; peer: meets its like; need, left: what a link must and can still share
    place = [F.lit(None).cast("double").alias(c) for c in ("need", "left")]
    rows = rows.select("key", "id", F.lit(True).alias("open"), F.lit(True).alias("peer"), *place)
    most, kept = COMPARISONS, None
    while True:
        rows = rows.join(sent_if_small(labels), "id")
        apart = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        apart = checkpointed(apart.filter("lo < hi").select("key", "n"), SMALL)
        rows = checkpointed(join_by_key(rows, apart, "key", "n").drop("n"), WIDE)
        if kept is not None:
            kept.unpersist()
        if rows.isEmpty():
            return labels
        counts = [("n_peer", "open and peer"), ("n_rest", "open and not peer"), ("n_shut", "not open")]
        stats = (
            rows.groupBy("key", "label")
            .agg(*(F.count_if(F.expr(is_one)).alias(c) for c, is_one in counts))
            .groupBy("key")
            .agg(
                *(F.sum(c).alias(c) for c, _ in counts),
                F.expr("sum(n_peer * n_peer)").alias("like"),
                F.expr("sum((n_peer + n_rest) * n_shut)").alias("like_shut"),
            )
            .selectExpr(
                "key",
                "n_peer + n_rest + n_shut as n",
                "(n_peer * n_peer - like) / 2 + (n_peer + n_rest) * n_shut - like_shut as work",
            )
            .filter("work > 0")
        )
        # one row of each key against rows of which one key can have a great part: the keys are sent, or the hot ones
        tagged = checkpointed(join_by_key(rows, checkpointed(stats, SMALL), "key", "n"), WIDE)
        small, large = tagged.filter(F.col("work") <= most), tagged.filter(F.col("work") > most)
        # The hub is the member that comes first by score and id, or one that comes first in another bucket of a
        # member: so a group's buckets share one. Members always come after their hub, hence the first hub of each
        # level after that of the level before, and the levels end.
        sized = [first(["score", "id"]), F.first("n").alias("n_hub")]
        hubs = checkpointed(large.join(score, "id").groupBy("key").agg(*sized), SMALL)
        known = join_by_key(large, hubs, "key", "n_hub").groupBy("id").agg(F.max("first").alias("first"))
        sized = [F.max("first").alias("first"), F.first("n").alias("n_hub")]
        hubs = checkpointed(large.join(known, "id").groupBy("key").agg(*sized), SMALL)
        large = join_by_key(large, hubs.select("key", F.col("first.id").alias("hub"), "n_hub"), "key", "n_hub")
        pairs = (
            small.alias("x")
            .join(
                small.alias("y"),
                F.expr(
                    "x.key = y.key and x.label <> y.label and ((x.open and x.peer and y.open and y.peer and x.id < y.id)"
                    " or (x.open and not y.open))"
                    " and coalesce(x.need + y.need <= least(x.left, y.left) + 1e-6, true)"
                ),
            )
            .select(F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b"))
            .distinct()
            .select("a", "b", *alone)
        )
        stars = large.filter("id <> hub").groupBy(F.col("id").alias("a"), F.col("hub").alias("b")).agg(F.max("n").alias("n"))
        stars = checkpointed(stars, SMALL)
        if stars.isEmpty():
            done = stored(compare(pairs, texts, width, percent))
            labels = joined(labels, done)
            done.unpersist()
            return labels
        sample = stars.filter(F.expr(f"pmod(xxhash64(a), greatest(1, n div {SAMPLE})) = 0"))
        common = frequent_differences(sample.select("a", "b"), texts, width)
        told = stars.join(common, "b", "left").select("a", "b", F.lit(True).alias("hub"), "common")
        done = stored(compare(pairs.unionByName(told), texts, width, percent))
        labels = joined(labels, done)

        def keyed(c: str, peer: bool, need, left):
            return F.transform(
                c,
                lambda k, i: F.struct(
                    k.alias("key"), F.lit(peer).alias("peer"), need.alias("need"), (left - i).cast("double").alias("left")
                ),
            )

        n, d = F.col("n"), F.col("d")
        near = ((100 + percent) * d - (100 - percent) * n) / F.lit(2.0 * (100 + percent))
        keys = F.concat(
            keyed("half", True, near, d),
            keyed("rest", False, near, d - F.size("half")),
            keyed("far", True, n * F.lit(percent / (100.0 + percent)), n),
        )
        # of a hub's members all have keys if one is not connected to it
        ends = labelled(stars.select("a", "b"), labels)
        ends = checkpointed(ends.select("a", "b", F.expr("label_a <> label_b").alias("open")), SMALL)
        wanted = sent_if_small(checkpointed(ends.filter("open").select("b").distinct(), SMALL))
        ends = sent_if_small(checkpointed(ends.join(wanted, "b", "left_semi"), SMALL))
        rows = done.filter("size(half) + size(far) > 0").join(ends, ["a", "b"])
        rows = rows.select(F.col("a").alias("id"), "open", F.explode(keys).alias("e")).filter("open or e.peer")
        rows = kept = stored(rows.select("e.key", "id", "open", "e.peer", "e.need", "e.left"))
        done.unpersist()
        most = PLACED


def labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    labels = sent_if_small(labels)
    return pairs.join(labels.select(F.col("id").alias("a"), F.col("label").alias("label_a")), "a").join(
        labels.select(F.col("id").alias("b"), F.col("label").alias("label_b")), "b"
    )


def joined(labels: DataFrame, done: DataFrame) -> DataFrame:
    """The labels (id, label) when what is linked in ``done`` is connected as well."""
    pairs = labelled(done.filter("linked").select("a", "b"), labels).filter("label_a <> label_b")
    pairs = checkpointed(pairs.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), SMALL)
    if pairs.isEmpty():
        return labels
    new = sent_if_small(checkpointed(components(pairs), SMALL).withColumnRenamed("id", "label"))
    return checkpointed(labels.join(new, "label", "left").select("id", F.coalesce("component", "label").alias("label")), SMALL)


def components(edges: DataFrame) -> DataFrame:
    """id, component: the least id that can be reached, for every id that occurs in a link (a, b)."""
    edges = checkpointed(edges, SMALL)
    labels = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().select("id", F.col("id").alias("label"))
    labels = checkpointed(labels, SMALL)
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        both = both.union(both.select("u", "u"))
        chosen = checkpointed(both.groupBy("u").agg(F.min_by("v", F.xxhash64("v")).alias("to")), SMALL)
        edges = checkpointed(
            edges.join(chosen.select(F.col("u").alias("a"), F.col("to").alias("p")), "a")
            .join(chosen.select(F.col("u").alias("b"), F.col("to").alias("q")), "b")
            .filter("p <> q")
            .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
            .distinct(),
            SMALL,
        )
        labels = checkpointed(
            labels.join(chosen.select(F.col("u").alias("label"), "to"), "label", "left").select(
                "id", F.coalesce("to", "label").alias("label")
            ),
            SMALL,
        )
    least = checkpointed(labels.groupBy("label").agg(F.min("id").alias("component")), SMALL)
    return labels.join(sent_if_small(least), "label").select("id", "component")


def classified(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc (the id), h (hash of the text), n_shingles and component, a row for each document."""
    own = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    wide = stored(sketch(own.withColumn("row", F.struct("doc", "h")), "row", "text", width, percent).select("id.*", "n_shingles", "sig_a", "sig_b", "bands"))
    signature = ["n_shingles", "sig_a", "sig_b"]
    reps = wide.filter("n_shingles > 0 and doc is not null").groupBy(*signature)
    reps = reps.agg(F.min(F.struct("doc", "h")).alias("d"), F.first("bands").alias("bands"))
    reps = checkpointed(reps.select(*signature, "d.*", "bands", F.monotonically_increasing_id().alias("id")), WIDE)
    made = checkpointed(wide.select("doc", "h", *signature))
    wide.unpersist()
    found = connected(reps.select("id", "doc", "h", "bands"), own, width, percent).select("id", F.col("label").alias("component"))
    classes = reps.select(*signature, "id", "doc").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    classes = checkpointed(classes, SMALL)
    least = classes.filter("component <> id").select("component").distinct().join(classes, "component")
    least = checkpointed(least.groupBy("component").agg(F.min("doc").alias("least")), SMALL)
    classes = classes.join(sent_if_small(least), "component", "left").select(*signature, F.coalesce("least", "doc").alias("component"))
    some = made.filter("n_shingles > 0").join(classes, signature, "left").select("doc", "h", "n_shingles", "component")
    return some.unionByName(made.filter("n_shingles = 0").select("doc", "h", "n_shingles", F.col("doc").alias("component")))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    return classified(docs, id_col, text_col, width, percent).select(
        F.col("doc").alias(id_col), "n_shingles", F.col("component").alias("component_id"), is_kept().alias("kept")
    )


def is_kept():
    return F.coalesce(F.col("doc") == F.col("component"), F.col("doc").isNull())


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """The documents that stand for their groups, with all their columns; of rows equal in id and text, one.

    Rows without an id belong to no group; of those with equal texts, one stays.
    """
    given = docs.columns
    docs, at = veiled(docs)
    id_col, text_col = at[id_col], at[text_col]
    gone = classified(docs, id_col, text_col, width, percent).filter(~is_kept()).select(F.col("doc").alias("_gone"), F.col("h").alias("_text"))
    is_gone = (F.col(id_col) == F.col("_gone")) & (F.xxhash64(text_col) == F.col("_text"))
    kept = docs.join(sent_if_small(checkpointed(gone.distinct(), SMALL), "24"), is_gone, "left_anti")
    again = docs.groupBy(id_col, F.xxhash64(text_col).alias("_h")).agg(F.count("*").alias("n")).filter("n > 1")
    again = checkpointed(again.select(F.col(id_col).alias("_id"), "_h"), SMALL)
    if not again.isEmpty():  # no row need be compared otherwise
        same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_h"))
        again = sent_if_small(again, "24")
        once = kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.toDF(*given)
