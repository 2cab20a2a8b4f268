"""A trie of conversation prefixes, without making it: every node belongs to its smallest member.

A node is a sequence of first turns; its members are the conversations that start with it. The smallest member owns
the node. A conversation that owns a node owns all deeper ones on its path, as their members are fewer, so what it
owns is a suffix of its path, and (owner, depth) names a node.

1. Turns are put in order by a range sort with as many partitions as there are rows for; a partition is numbered, rebuilt and hashed by arrays.
   Prefix hashes are polynomials modulo 2**127 - 1 over hashes of turns, so the parts of a conversation that lies across partitions
   are put together from a summary of each partition (:class:`Part`), of which the driver holds one each.
2. A group-by prefix gives owner, members and the longest member's length; a group-by owner gives where its suffix begins, and whether
   it ends in a childless node.
3. With that, each occurrence of a turn says how many of its conversation's words from there on are owned by others, whether the next node
   is owned, and whether the leaf is. One group-by prefix sums those: words of occurrences less words of nodes, children, leaves.
4. Ids that end at a node are sorted by ranges, joined to texts in parts, and each node's parts are hashed in order as a stream.

Nodes with many members (the root, a common first turn) are summed in every partition first, and a conversation of any
number of turns lies across as many partitions as it needs.

Defined results: a null role or text is empty, a null turn comes first; turns with equal numbers are in order of the SHA-256
of their bytes (role's length, colon, role, text); equal turns that repeat are turns of their own. Rows without a
conv_id are no conversation. An empty table has no node, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_by_key, partitions, sent_if_small, words

GROUP, HEADS = 20, 4
PRIME, BASE = 2**127 - 1, int.from_bytes(hashlib.sha256(b"prefix").digest()[:15], "big")
#: Turns of a partition, about, and equal turns that are made at once.
PART_ROWS, RUN = 200_000, 1000
#: Ids in a part of the text that is hashed.
IDS = 1000
#: Occurrences in a batch.
ROWS = 20_000
PATHS = "conv_id bigint, depth bigint, prefix binary, parent binary, words bigint, upto bigint, length bigint, total bigint"


def heads(conv_id: int) -> int:
    """How many first turns a conversation takes from its group's first one."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def base_of(conv_id: int) -> int:
    """The conversation that its group begins with; a remainder has the sign of the id."""
    return conv_id - (conv_id % GROUP if conv_id >= 0 else -(-conv_id % GROUP))


def extended(prefix: int, turn: int) -> int:
    return (prefix * BASE + turn + 1) % PRIME


@dataclass
class Fragment:
    """Consecutive turns of one conversation: how many, the first of them (hash, words), and all of them hashed and counted."""

    conv: int
    n: int = 0
    first: list = field(default_factory=list)
    hashed: int = 0
    words: int = 0

    def add(self, turn: int, n_words: int) -> None:
        if self.n < HEADS:
            self.first.append((turn, n_words))
        self.n, self.hashed, self.words = self.n + 1, extended(self.hashed, turn), self.words + n_words


@dataclass
class Part:
    """What other partitions must know of one: its first and last conversation, and the turns of the last group's base."""

    first: Fragment
    last: Fragment
    base: int
    head: list


class Path:
    """A rebuilt conversation: the first turns of its group's base, then its own without as many."""

    def __init__(self, conv: int, head: list):
        own_base = conv == base_of(conv)
        self.conv, self.seen, self.depth, self.prefix, self.parent, self.upto = conv, 0, 0, 0, 0, 0
        self.skip = 0 if own_base else heads(conv)
        self.taken = [] if own_base else head[: self.skip]

    def step(self, turn: int, n_words: int) -> None:
        self.parent, self.prefix = self.prefix, extended(self.prefix, turn)
        self.depth, self.upto = self.depth + 1, self.upto + n_words

    def start(self) -> Path:
        for turn in self.taken:
            self.step(*turn)
        return self

    def jump(self, own: Fragment) -> None:
        """Many steps at once."""
        left = own.first[: min(own.n, max(0, self.skip - self.seen))]
        n, dropped = own.n - len(left), 0
        for turn, _ in left:
            dropped = extended(dropped, turn)
        power = pow(BASE, n, PRIME)
        self.prefix = ((self.prefix - dropped) * power + own.hashed) % PRIME
        self.seen, self.depth = self.seen + own.n, self.depth + n
        self.upto += own.words - sum(w for _, w in left)


def prepared(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, digest, words, copy: turns, equal ones numbered."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    raw = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), F.unhex(F.sha2(raw.cast("binary"), 256)).alias("digest"),
        F.size(words(text_col)).alias("words"),
    )
    rows = rows.groupBy("conv_id", "turn", "digest").agg(F.first("words").alias("words"), F.count("*").alias("n"))
    rows = checkpointed(rows)
    most = rows.agg(F.max("n")).first()[0] or 0
    runs = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / RUN))
    rows = rows.withColumn("run", F.explode(runs))
    if most > RUN:  # one row stands for many, which are made in all tasks then
        rows = rows.repartition(partitions(rows.sparkSession), "conv_id", "turn", "digest", "run")
    last = F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1
    return rows.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, last))).drop("run", "n")


def in_order(rows: DataFrame) -> DataFrame:
    """Sorted by ranges: groups, in each the base first, conversations, turns. Written, so that the cuts stay."""
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    rows = rows.select("*", base.alias("base"), (F.col("conv_id") != base).alias("later"))
    order = ["base", "later", "conv_id", F.col("turn").asc_nulls_first(), "digest", "copy"]
    n = max(partitions(rows.sparkSession), -(-rows.count() // PART_ROWS))
    made = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return checkpointed(made.select("conv_id", "digest", "words", F.spark_partition_id().alias("part")))


def turns_in(batches):
    """(part, conversation, hash of a turn, its words)."""
    for batch in batches:
        for conv, digest, n_words, part in zip(*(c.to_pylist() for c in batch.columns)):
            yield part, conv, int.from_bytes(digest[:15], "big"), n_words


def summary(batches):
    """The number of a partition and its :class:`Part`."""
    first = last = base = None
    head: list = []
    for part, conv, turn, n_words in turns_in(batches):
        if last is None or conv != last.conv:
            last = Fragment(conv)
            first = first or last
            if base_of(conv) != base:
                base, head = base_of(conv), []
        last.add(turn, n_words)
        if conv == base and len(head) < HEADS:
            head.append((turn, n_words))
    if last is not None:
        raw = pickle.dumps(Part(first, last, base, head))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([raw], pa.binary())], names=["part", "raw"])


def put_together(parts: list[tuple[int, Part]]) -> tuple[dict, dict]:
    """By partition: the path that the one before ended with, its group's base and head. By conversation at an edge: its whole length and words."""
    before, whole = {}, {}
    path, base, head = None, None, []
    for number, part in sorted(parts, key=lambda x: x[0]):
        before[number] = (path, base, head)
        if path is not None and path.conv == part.first.conv:
            path = pickle.loads(pickle.dumps(path))
        else:
            path = Path(part.first.conv, head if base_of(part.first.conv) == base else []).start()
        path.jump(part.first)
        whole[path.conv] = (path.depth, path.upto)
        head = ((head if base == part.base else []) + part.head)[:HEADS]
        base = part.base
        if part.last.conv != part.first.conv:
            path = Path(part.last.conv, head).start()
            path.jump(part.last)
            whole[path.conv] = (path.depth, path.upto)
    return before, whole


def paths(batches, before: dict, whole: dict):
    """The occurrences of one partition; what lies across partitions is taken up from the one before."""
    names, kinds = zip(*(x.split() for x in PATHS.split(", ")))
    types = [pa.int64() if kind == "bigint" else pa.binary() for kind in kinds]
    out: list[list] = [[] for _ in names]
    path, base, head, at = None, None, [], 0

    def row(n_words: int):
        made = (path.conv, path.depth, path.prefix.to_bytes(16, "big"), path.parent.to_bytes(16, "big"), n_words, path.upto)
        for values, v in zip(out, made):
            values.append(v)

    def ended():
        length, total = whole.get(path.conv, (path.depth, path.upto))
        out[6].extend([length] * (len(out[0]) - len(out[6])))
        out[7].extend([total] * (len(out[0]) - len(out[7])))

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=list(names))

    for part, conv, turn, n_words in turns_in(batches):
        if base is None:
            path, base, head = before[part]
            path, head = pickle.loads(pickle.dumps(path)), list(head)
        if path is None or conv != path.conv:
            if path is not None:
                ended()
            if len(out[0]) >= ROWS:
                yield batch()
                out = [[] for _ in names]
            if base_of(conv) != base:
                base, head = base_of(conv), []
            path = Path(conv, head)
            row(0)
            for taken in path.taken:
                path.step(*taken)
                row(taken[1])
        if len(out[0]) >= ROWS and conv in whole:  # elsewhere a conversation's length is known at its end
            ended()
            yield batch()
            out = [[] for _ in names]
        if conv == base and len(head) < HEADS:
            head.append((turn, n_words))
        path.seen += 1
        if path.seen > path.skip:
            path.step(turn, n_words)
            row(n_words)
    if path is not None and out[0]:
        ended()
        yield batch()


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each turn of each rebuilt conversation and one of depth 0: conv_id, depth, hashes of the prefix and of the one before it,
    words of the turn and of the prefix, and the conversation's length and words."""
    rows = in_order(prepared(turns, conv_col, turn_col, role_col, text_col))
    found = rows.mapInArrow(summary, "part int, raw binary").collect()  # one of each partition
    sent = rows.sparkSession.sparkContext.broadcast(put_together([(r["part"], pickle.loads(r["raw"])) for r in found]))
    return rows.mapInArrow(lambda batches: paths(batches, *sent.value), PATHS)


def digests(ends: DataFrame) -> DataFrame:
    """prefix, ends_sha256: of the decimal ids that end at a node, in numerical order with commas between them."""

    def joined(batches):
        prefix, ids = None, []

        def part():
            return pa.RecordBatch.from_arrays(
                [pa.array([prefix], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["prefix", "first", "ids"]
            )

        for batch in batches:
            for p, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (p != prefix or len(ids) == IDS):
                    yield part()
                    ids = []
                prefix = p
                ids.append(conv)
        if ids:
            yield part()

    def hashed(batches):
        prefix, state = None, None

        def made():
            return pa.RecordBatch.from_arrays([pa.array([prefix], pa.binary()), pa.array([state.hexdigest()])], names=["prefix", "ends_sha256"])

        for batch in batches:
            for p, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if p != prefix:
                    if state is not None:
                        yield made()
                    prefix, state = p, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state is not None:
            yield made()

    n = partitions(ends.sparkSession)
    parts = ends.select("prefix", "conv_id").repartitionByRange(n, "prefix", "conv_id").sortWithinPartitions("prefix", "conv_id")
    parts = parts.mapInArrow(joined, "prefix binary, first bigint, ids string")
    parts = parts.repartition(n, "prefix").sortWithinPartitions("prefix", "first")
    return parts.mapInArrow(hashed, "prefix binary, ends_sha256 string")


def nodes(paths: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = checkpointed(paths)
    known = paths.groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("length").alias("longest"), F.first("words").alias("words"), F.first("upto").alias("upto"))
    # by owner: the depth of its first node, the words above that, whether it ends in a leaf
    owned = known.groupBy("conv_id").agg(
        F.min("depth").alias("since"), F.min(F.col("upto") - F.col("words")).alias("above"), F.max(F.col("longest") == F.col("depth")).alias("leaf")
    )
    owned = checkpointed(owned)
    # a conversation of very many turns is split by the join; those that own nothing have no row in owned
    marked = paths.join(sent_if_small(owned, "40"), "conv_id", "left").withColumns(
        {"since": F.coalesce("since", F.col("length") + 1), "above": F.coalesce("above", "total"), "leaf": F.coalesce("leaf", F.lit(False))}
    )
    others = F.greatest(F.col("above") - (F.col("upto") - F.col("words")), F.lit(0))
    final = marked.groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.count("*").alias("n_convs"),
        F.count_if(F.expr("depth + 1 >= since and depth < length")).alias("n_children"), F.count_if("leaf").alias("n_leaves"),
        F.sum(others).alias("saved_tokens"), F.min_by("since", "conv_id").alias("since"),
    )
    final = checkpointed(final)
    # where a suffix begins, the parent belongs to another
    tops = final.filter("depth > 0 and depth = since").select("prefix", "parent")
    above = final.filter("n_children > 0").select(F.col("prefix").alias("parent"), F.col("conv_id").alias("owner"), "n_children")
    tops = join_by_key(tops, above, "parent", "n_children").select("prefix", "owner")
    ends = digests(paths.filter("depth = length"))
    return final.join(tops, "prefix", "left").join(ends, "prefix", "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("owner", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
