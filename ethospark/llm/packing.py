"""Packing into optimal length buckets: the fewest pad tokens for a given number of buckets.

Lengths are counted exactly over the whole table. Bucket boundaries come from an exact dynamic programme over that
histogram; its layers are minima of lines in order of slope, so each takes linear time. The histogram is the one
thing that the driver holds: documents of n different lengths have n * n / 2 tokens at least, so n grows with the root
of the corpus at most.

Batches take ``budget`` tokens: a bucket of boundary b fills batches of max(1, budget // b) documents. Rows with equal
id and length are counted first and get neighbouring places. Those groups are dealt to ``SHARDS`` shards by a hash of id and
length and ordered within them; a place is the sum of what is before in the shard plus the sizes of the shards before.
So a length that many documents share is spread, only the table of shard sizes is gathered, and the result depends
neither on the order nor on the partitions of the input. The places of a row that repeats more than ``RUN`` times are made
in runs of that many, which are dealt to all tasks, so such a row is no task's burden either.

Defined results: a null or blank text has length 0 and is packed in the first bucket; repeated rows take places of
their own; with fewer lengths than buckets each length is a bucket; a document longer than the budget is a batch by
itself; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from array import array
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, partitions, words

BUCKETS, BUDGET, SHARDS = 12, 16_384, 4096
#: Places of equal rows that are made at once.
RUN = 100_000


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper ends of the buckets that minimise the sum over documents of boundary minus length.

    With C documents up to a boundary at L, the last bucket after a boundary with C' costs L (C - C') less its lengths;
    over the earlier boundary that is a line in L of slope -C', so a layer is a lower envelope. The lengths' own sum
    is the same for all choices and is left out.
    """
    histogram = sorted((max(0, n), c) for n, c in histogram if c > 0)
    if not histogram:
        return []
    lengths = [n for n, _ in histogram]
    upto, total = [0], 0
    for _, c in histogram:
        total += c
        upto.append(total)
    n = len(lengths)
    best = [lengths[j] * upto[j + 1] for j in range(n)]
    back: list[array] = []
    for _ in range(1, min(buckets, n)):
        layer, choice, hull = best[:], array("q", [-1]) * n, deque()
        for j in range(n):
            if j:  # the earlier boundary may now be j - 1: cost best[j - 1] - lengths[j] * upto[j]
                slope, icept = -upto[j], best[j - 1]
                while len(hull) > 1:
                    (s1, i1, _), (s2, i2, _) = hull[-2], hull[-1]
                    if (icept - i1) * (s1 - s2) <= (i2 - i1) * (s1 - slope):
                        hull.pop()
                    else:
                        break
                hull.append((slope, icept, j - 1))
                x = lengths[j]
                while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                    hull.popleft()
                cost = hull[0][0] * x + hull[0][1] + x * upto[j + 1]
                if cost < layer[j]:
                    layer[j], choice[j] = cost, hull[0][2]
        back.append(choice)
        best = layer
    ends, at = [], n - 1
    for choice in reversed(back):
        ends.append(lengths[at])
        if choice[at] < 0:
            break
        at = choice[at]
    else:
        ends.append(lengths[at])
    return sorted(set(ends))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length=None,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """id, n_tokens, bucket, boundary, pad, batch (within the bucket), slot (within the batch).

    ``length``: a column of token counts; by default the number of words.
    """
    n = F.size(words(text_col)) if length is None else length
    sized = docs.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("bigint").alias("n_tokens"))
    sized = checkpointed(sized.groupBy("id", "n_tokens").agg(F.count("*").alias("n")))
    histogram = sized.groupBy("n_tokens").agg(F.sum("n"), F.max("n")).collect()  # grows with the corpus's root at most
    ends = optimal_boundaries([(r[0], r[1]) for r in histogram], buckets) or [0]
    bucket = F.lit(len(ends) - 1)
    for i in reversed(range(len(ends) - 1)):
        bucket = F.when(F.col("n_tokens") <= ends[i], i).otherwise(bucket)
    boundary = F.element_at(F.array(*[F.lit(e).cast("bigint") for e in ends]), F.col("bucket") + 1)
    shard = F.pmod(F.xxhash64("id", "n_tokens"), F.lit(SHARDS))
    dealt = sized.withColumn("bucket", bucket).withColumn("shard", shard)
    sizes = dealt.groupBy("bucket", "shard").agg(F.sum("n").alias("in_shard"))  # buckets x shards rows at most
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(
        "bucket", "shard", F.sum("in_shard").over(earlier(Window.partitionBy("bucket").orderBy("shard"))).alias("before")
    )
    inside = F.sum("n").over(earlier(Window.partitionBy("bucket", "shard").orderBy("id", "n_tokens")))
    ranked = dealt.withColumn("inside", inside).join(F.broadcast(before), ["bucket", "shard"])
    first = F.coalesce("before", F.lit(0)) + F.coalesce("inside", F.lit(0))
    runs = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / RUN)),
        lambda k: F.struct((first + k * RUN).alias("start"), F.least(F.col("n") - k * RUN, F.lit(RUN)).alias("n")),
    )
    ranked = ranked.withColumn("boundary", boundary).withColumn("run", F.explode(runs))
    if max((r[2] for r in histogram), default=0) > RUN:
        ranked = ranked.repartition(partitions(docs.sparkSession), "id", "n_tokens", "run.start")
    capacity = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1))), F.lit(1))
    return (
        ranked.withColumn("rank", F.explode(F.sequence(F.col("run.start"), F.col("run.start") + F.col("run.n") - 1)))
        .withColumn("batch", F.floor(F.col("rank") / capacity).cast("bigint"))
        .withColumn("slot", (F.col("rank") - F.col("batch") * capacity).cast("bigint"))
        .select(
            F.col("id").alias(id_col), "n_tokens", F.col("bucket").cast("int").alias("bucket"), "boundary",
            (F.col("boundary") - F.col("n_tokens")).alias("pad"), "batch", "slot",
        )
    )
