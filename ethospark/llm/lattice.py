"""Language-model scores from a subword lattice: the probability of a text over all its segmentations.

Every word, with its word mark in front, is a lattice of vocabulary pieces; the log-space forward recursion sums
over all paths, so a text's probability is the marginal one, not that of its best segmentation. Any code point can
also be spelt in byte pieces, so every text has a probability. Pieces never cross a word's start, which makes a
text's probability the product of its words' and of one end.

Each training word is one more arc, over the whole word. Its weight is its count less a discount, the same for all (Ney's
estimate from the words seen once and twice); the discounts are the weight of the arcs of pieces, which thereby spell what
was never seen. Probabilities of all words and of the end sum to 1 at most.

The vocabulary is an existing one; its pieces are not changed. Their weights are fitted to the different training words, each
once as its discount is, by expectation-maximisation over the lattices. Without ``free`` the file's scores are kept: a piece's
log-weight is its score times one factor, normalised. The factor is 1 for a file whose scores are log-probabilities. A merge
vocabulary's file gives negative ranks, of which only the scale is open: there the factor is fitted.

Word counts are gathered in one pass with a bounded table per task and summed by key; lattices run once per
distinct word. Texts meet the counts in blocks of about ``BLOCK_BYTES``, dealt by a hash of id and text; of rows equal in both one is scored: each block asks once for each of its
distinct words, by 64-bit hash, so no task needs the vocabulary of the corpus and no row per token is shuffled.

Defined results: a null, empty or blank text is one end token; bytes that are no UTF-8 are scored as U+FFFD; a null id is trained on; with no training text all
counts are 0; repeated rows score alike; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, doc_hash_mod, new_token, partitions, per_worker, sent_if_small, small_batches, text_of

#: Text of one block, and entries of a task's count table before it is emptied.
BLOCK_BYTES, TABLE = 24 << 20, 300_000
#: Equal rows that are made at once.
RUN = 100_000
#: Rounds of expectation-maximisation, and what every piece is credited with beyond its expected count.
ROUNDS, CREDIT = 2, 0.1
#: Bounds of a training word's discount, also where no word was seen once.
DISCOUNTS = 0.1, 0.9
#: Scores from here on are no log-probabilities of a piece, but mark one that is never used.
NEVER = -1e8
MARK = "▁"
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Words with more code points take the scalar path.
WIDE = 64
#: Words at a time, so that their lattices stay in a core's cache.
IN_CACHE = 2000


class Lattice:
    """Weights of the pieces, and the forward and backward recursions over batches of words."""

    def __init__(self, pieces: list[str], log_weight: np.ndarray):
        self.size = len(pieces)
        self.weight = np.asarray(log_weight, np.float64)
        self.byte = np.full(256, -1)
        known: dict[str, int] = {}
        for i, p in enumerate(pieces):
            if len(p) == 6 and p.startswith("<0x"):
                self.byte[int(p[3:5], 16)] = i
            elif p and not (p.startswith("<") and p.endswith(">")) and MARK not in p[1:]:
                known.setdefault(p, i)
        self.known, self.longest = known, max(map(len, known), default=1)
        hashes = np.array([self._hash(np.array([ord(c) for c in p], np.uint64)) for p in known], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(known.values()))[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashes * _MUL) >> np.uint64(44)] = True
        self.byte_weight = self.weight[self.byte]

    @staticmethod
    def _hash(points: np.ndarray) -> int:
        h = np.uint64(0)
        for c in points:
            h = h * _MUL + c + np.uint64(1)
        return h

    def spelt(self, points: np.ndarray) -> np.ndarray:
        """Log-weight of each code point spelt in byte pieces."""
        out = np.zeros(len(points))
        for raw, n in self._utf8(points):
            out += np.where(n, self.byte_weight[raw], 0.0)
        return out

    @staticmethod
    def _utf8(p: np.ndarray):
        """The four possible bytes of each code point's UTF-8, and whether it has them."""
        size = 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
        for k in range(4):
            shift = 6 * np.maximum(size - 1 - k, 0)
            body = p >> shift
            yield np.where(k == 0, lead | (body & np.where(size == 1, 0x7F, 0x3F)), 0x80 | (body & 0x3F)), size > k

    def arcs(self, flat: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(code points, longest): the piece that ends at each code point and has that length, or -1."""
        out = np.full((len(flat), self.longest), -1, np.int32)
        h, power = np.zeros(len(flat), np.uint64), np.uint64(1)
        codes = flat.astype(np.uint64) + np.uint64(1)
        for n in range(1, min(self.longest, len(flat)) + 1):
            # the hash of the piece one code point longer at its front
            h[n - 1 :] = h[n - 1 :] + codes[: len(flat) - n + 1] * power
            power = power * _MUL
            at = np.flatnonzero((place >= n - 1) & self.maybe[(h * _MUL) >> np.uint64(44)])
            found = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            hit = self.hashes[found] == h[at]
            out[at[hit], n - 1] = self.ids[found[hit]]
        return out

    def batch(self, words: list[str], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probability of each word; with counts, also the expected counts of all pieces."""
        expected = None if counts is None else np.zeros(self.size)
        if len(words) > IN_CACHE:
            cuts = range(0, len(words), IN_CACHE)
            parts = [self.batch(words[i : i + IN_CACHE], None if counts is None else counts[i : i + IN_CACHE]) for i in cuts]
            return np.concatenate([p[0] for p in parts]), None if counts is None else sum(p[1] for p in parts)
        out = np.zeros(len(words))
        marked = [MARK + w for w in words]
        size = np.array([len(w) for w in marked])
        for i in np.flatnonzero(size > WIDE):
            out[i] = self.one(marked[i], expected, 0 if counts is None else counts[i])
        order = np.flatnonzero(size <= WIDE)
        order = order[np.argsort(-size[order], kind="stable")]
        if not len(order):
            return out, expected
        size = size[order]
        text = "".join([marked[i] for i in order])
        flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(len(flat)) - np.repeat(start, size)
        arc = self.arcs(flat, place)
        arc = arc[:, : max(1, int(np.flatnonzero((arc >= 0).any(0)).max(initial=0)) + 1)]  # no longer piece occurs
        weight = np.where(arc >= 0, self.weight[arc], -np.inf)
        spelt = self.spelt(flat)
        single = weight[:, 0].copy()
        weight[:, 0] = np.logaddexp(single, spelt)
        far, n = int(size[0]), arc.shape[1]
        active = [int(np.searchsorted(-size, -t, side="right")) for t in range(far + 1)]
        alpha = np.full((len(order), far + 1 + n), -np.inf)  # shifted by n, so that no index is negative
        alpha[:, n] = 0.0
        for t in range(1, far + 1):
            a = active[t]
            terms = alpha[:a, t : t + n][:, ::-1] + weight[start[:a] + t - 1]
            top = terms.max(1)
            alpha[:a, n + t] = top + np.log(np.exp(terms - top[:, None]).sum(1))
        total = alpha[np.arange(len(order)), n + size]
        out[order] = total
        if counts is None:
            return out, None
        beta = np.full((len(order), far + 1), -np.inf)
        beta[np.arange(len(order)), size] = 0.0
        share = np.zeros((len(flat), n))
        times = np.asarray(counts, float)[order]
        for t in range(far, 0, -1):
            a = active[t]
            rows = start[:a] + t - 1
            onward = weight[rows] + beta[:a, t][:, None]
            back = alpha[:a, t : t + n][:, ::-1]
            share[rows] = np.exp(onward + back - total[:a, None]) * times[:a, None]
            for k in range(1, min(n, t) + 1):
                np.logaddexp(beta[:a, t - k], onward[:, k - 1], out=beta[:a, t - k])
        bytes_share = share[:, 0] * np.exp(spelt - weight[:, 0])
        share[:, 0] -= bytes_share
        hit = arc >= 0
        expected += np.bincount(arc[hit], share[hit], self.size)
        for raw, has in self._utf8(flat):
            expected += np.bincount(self.byte[raw[has]], bytes_share[has], self.size)
        return out, expected

    def one(self, word: str, expected: np.ndarray | None, times: float) -> float:
        """The same for one word of any length; memory in proportion to it."""
        spelt = self.spelt(np.array([ord(c) for c in word], np.int64))
        n = len(word)
        alpha = np.full(n + 1, -np.inf)
        alpha[0] = 0.0
        into: list[list[tuple[int, int, float]]] = []
        for t in range(1, n + 1):
            arcs = [(t - 1, -1, spelt[t - 1])]
            for k in range(1, min(self.longest, t) + 1):
                i = self.known.get(word[t - k : t])
                if i is not None:
                    arcs.append((t - k, i, self.weight[i]))
            terms = [alpha[s] + w for s, _, w in arcs]
            top = max(terms)
            alpha[t] = top + np.log(sum(np.exp(x - top) for x in terms))
            into.append(arcs)
        if expected is not None:
            beta = np.full(n + 1, -np.inf)
            beta[n] = 0.0
            for t in range(n, 0, -1):
                for s, i, w in into[t - 1]:
                    part = np.exp(alpha[s] + w + beta[t] - alpha[n]) * times
                    beta[s] = np.logaddexp(beta[s], w + beta[t])
                    if i >= 0:
                        expected[i] += part
                    else:
                        for b in word[s:t].encode("utf-8", "surrogatepass"):
                            expected[self.byte[b]] += part
        return float(alpha[n])


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """The pieces of a sentencepiece file and their scores, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids], np.array([model.get_score(i) for i in ids])


def are_ranks(scores: np.ndarray) -> bool:
    """Whether scores are whole numbers, as a merge vocabulary's ranks are and log-probabilities are not."""
    return bool((scores == np.round(scores)).all())


def weights(scores: np.ndarray, factor: float) -> np.ndarray:
    """Scores times a factor as log-probabilities."""
    w = np.where(scores > NEVER, scores * factor, -np.inf)
    return w - np.logaddexp.reduce(w)


def fitted_factor(scores: np.ndarray, expected: np.ndarray) -> float:
    """The factor under which the mean score is that of the expected counts, which makes these most likely."""
    used = scores > NEVER
    wanted = float((expected * np.where(used, scores, 0)).sum() / max(expected.sum(), 1e-9))
    low, high = 1e-9, 10.0
    for _ in range(100):
        middle = (low * high) ** 0.5
        mean = float((np.exp(weights(scores, middle))[used] * scores[used]).sum())
        low, high = (middle, high) if mean < wanted else (low, middle)
    return low


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (in the training texts), hash: every word of every text."""

    def run(batches):
        kept: Counter = Counter()
        other: set = set()

        def out():
            words = list(kept) + [w for w in other if w not in kept]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([kept[w] for w in words], pa.int64())],
                names=["word", "c"],
            )

        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for text, trained in zip(texts, batch.column(1).to_pylist()):
                words = (text or b"").lower().split()
                for i in range(0, len(words), TABLE):
                    (kept if trained else other).update(words[i : i + TABLE])
                    if len(kept) + len(other) >= TABLE:
                        yield out()
                        kept.clear()
                        other.clear()
        if kept or other:
            yield out()

    small_batches(docs.sparkSession)
    made = docs.select("text", "trained").mapInArrow(run, "word binary, c bigint")
    return made.groupBy("word").agg(F.sum("c").alias("c"))


def fitted(words: DataFrame, ends: int, pieces: list[str], scores: np.ndarray, rounds: int, free: bool = False) -> np.ndarray:
    """Weights of the pieces from their scores; ranks are scaled by the training words, each once. ``free`` fits each weight."""
    weight = weights(scores, 1.0)
    if not free and not are_ranks(scores):
        return weight
    if are_ranks(scores):
        weight = weights(scores, 4 / max(1.0, float(-scores[scores > NEVER].min(initial=0))))
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast((pieces, weight))

        def run(batches, sent=sent):
            lattice, total = Lattice(*sent.value), np.zeros(len(sent.value[0]))
            with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                for batch in batches:
                    total += lattice.batch(list(map(text_of, batch.column(0).to_pylist())), np.ones(batch.num_rows))[1]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["piece", "n"])

        made = words.filter("c > 0").select("word").mapInArrow(run, "piece bigint, n double")
        counts = np.full(len(pieces), CREDIT if free else 0.0)
        for row in made.groupBy("piece").agg(F.sum("n").alias("n")).collect():  # a row for each piece at most
            counts[row["piece"]] += row["n"]
        counts[pieces.index("</s>")] += ends
        sent.unpersist()
        if free:
            weight = np.log(counts) - np.log(counts.sum())
        elif counts.any():
            weight = weights(scores, fitted_factor(scores, counts))
    return weight


def discount(once: int, twice: int) -> float:
    """What a training word's count is lessened by, from the numbers of words seen once and twice."""
    low, high = DISCOUNTS
    return min(high, max(low, once / max(1, once + 2 * twice)))


def word_weights(counts: np.ndarray, spelt: np.ndarray, less: float, left: float, total: float) -> np.ndarray:
    """Log-probabilities of words: the arc over the whole word and the arcs of pieces, which share the weight ``left``."""
    return np.logaddexp(np.log(np.maximum(counts - less, 0)), np.log(left) + spelt) - np.log(total)


def places(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where words are among the sorted ones of a block's answers; all of them must be."""
    at = np.searchsorted(hashes, wanted)
    if len(at) and (at.max() >= len(hashes) or (hashes[at] != wanted).any()):
        raise RuntimeError("a block's answers lack a word of its texts")
    return at


def expanded(scored: DataFrame, again: DataFrame) -> DataFrame:
    """A row for each of the equal rows; those of a row that repeats very often are made in runs, in all tasks."""
    n = F.coalesce("n", F.lit(1)).cast("bigint")
    same = scored["id"].eqNullSafe(again["id"]) & (scored["h"] == again["h"])
    rows = scored.join(sent_if_small(again, "32"), same, "left").select(scored["*"], n.alias("n"))
    rows = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / RUN))))
    if (again.agg(F.max("n")).first()[0] or 0) > RUN:
        rows = rows.repartition(partitions(rows.sparkSession), "id", "h", "run")
    last = F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1
    return rows.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, last)))


def score(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    fold: int = 10,
    rounds: int = ROUNDS,
    free: bool = True,
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    held = F.coalesce(doc_hash_mod(id_col, fold) == 0, F.lit(False))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~held).alias("trained"))
    size = docs.agg(F.sum(F.octet_length("text")), F.count_if("trained")).first()
    ends = size[1]
    words = checkpointed(word_counts(docs))
    total = words.agg(F.sum("c"), *[F.count_if(x) for x in (F.col("c") > 0, F.col("c") == 1, F.col("c") == 2)]).first()
    n, v = (total[0] or 0) + ends, (total[1] or 0) + (ends > 0)
    less = discount(total[2], total[3])
    left, mass = less * total[1] + CREDIT, n + 2 * CREDIT
    end_lp = float(np.log((ends + CREDIT) / mass))
    pieces, scores = vocabulary(path)
    scores[pieces.index("</s>")] = -np.inf  # no word's piece
    weight = fitted(words, 0, pieces, scores, rounds, free)
    sent = spark.sparkContext.broadcast((pieces, weight))
    token = new_token()

    def weigh(batches):
        lattice = per_worker(token, lambda: Lattice(*sent.value))
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            for batch in batches:
                raw = batch.column(0).to_pylist()
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw)).astype(np.int64)
                spelt = lattice.batch(list(map(text_of, raw)))[0]
                lp = word_weights(batch.column(1).to_numpy(zero_copy_only=False), spelt, less, left, mass)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), batch.column(1), pa.array(lp)], names=["hash", "c", "lp"])

    weighed = words.mapInArrow(weigh, "hash bigint, c bigint, lp double")
    blocks = max(1, -(-(size[0] or 0) // BLOCK_BYTES))
    # a row's block depends on the row alone, so what it asks for is what it is told, also if a part is made again; of
    # equal rows, which would all be in one block, one is scored
    again = docs.groupBy("id", F.xxhash64("text").alias("h")).agg(F.count("*").alias("n")).filter("n > 1")
    again = checkpointed(again)
    repeated = not again.isEmpty()
    once = docs.dropDuplicates(["id", "text"]) if repeated else docs
    hashed = F.xxhash64("text").alias("h")
    dealt = once.select("id", "text", "trained", hashed, F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block"))
    dealt = dealt.repartition(max(partitions(spark), 1), "block")

    def ask(group: pa.Table) -> pa.Table:
        asked: set = set()
        for text in group.column("text").cast(pa.binary()).to_pylist():
            asked.update((text or b"").lower().split())
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, asked), np.uint64, len(asked)).astype(np.int64)
        block = group.column("block")[0].as_py()
        return pa.table([pa.array([block] * len(hashes), pa.int64()), pa.array(hashes)], names=["block", "hash"])

    asked = dealt.groupBy("block").applyInArrow(ask, "block bigint, hash bigint")
    answers = asked.join(weighed, "hash").select("block", "hash", "c", "lp")
    bottom = n + 0.1 * (v + 1)

    def add_up(texts: pa.Table, told: pa.Table) -> pa.Table:
        hashes = told.column("hash").to_numpy()
        order = np.argsort(hashes)
        hashes = hashes[order]
        c, lp = told.column("c").to_numpy()[order], told.column("lp").to_numpy()[order]
        base = np.log10((c + 0.1) / bottom)
        rows = []
        for text in texts.column("text").cast(pa.binary()).to_pylist():
            own, known = iter((text or b"").lower().split()), int(ends > 0)
            tokens, low, high = 1, float(np.log10((ends + 0.1) / bottom)), end_lp
            while part := list(islice(own, 100_000)):
                at = places(hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(part)).astype(np.int64))
                tokens, known = tokens + len(part), known + int((c[at] > 0).sum())
                low, high = low + float(base[at].sum()), high + float(lp[at].sum())
            rows.append((tokens, known, low, high / np.log(10)))
        made = list(zip(*rows))
        return pa.table(
            [texts.column("id"), texts.column("h"), texts.column("trained"), *(pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.int64(), pa.float64(), pa.float64())))],
            names=["id", "h", "trained", "n_tokens", "n_known", "base_score", "score"],
        )

    out = (
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(add_up, f"id {kind}, h bigint, trained boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    )
    if repeated:
        out = expanded(out, again)
    return out.select(
        F.col("id").alias(id_col),
        (~F.col("trained")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
