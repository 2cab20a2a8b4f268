"""Language identification by a linear-chain conditional random field over words.

Every word is labelled: affixes, character n-grams and the lexicon of the training words are hashed features,
transitions between labels are learnt, and forward-backward gives each word's posterior, so runs of another
language inside a text show as such. A run without white space of over ``LONGEST`` characters (scripts without spaces,
words joined by other marks) is cut where the class of characters changes and after ``LONGEST`` characters, and its
pieces are words. A document's language is the label with the greatest mean posterior over its words, weighted by
their letters; that mean is the score.

The field is fitted on a bounded sample of labelled rows (``per_lang`` documents of each language, ``WINDOWS`` in all, windows of
``SPAN`` words, cut before they reach the driver), spliced at random so that labels change inside sequences. More than
``MAX_LABELS`` labels are an error. Gradients are summed over groups of sequences, so the driver holds the weights, the sample and
one group's lattices, of about ``LATTICE`` values. Prediction reads whole texts: documents are cut into blocks of ``BLOCK`` words that
are run in step, first as transfer matrices, then with the exact vectors at their edges, so one long text costs no
more per word than many short ones. A text over ``WORDS_AT_ONCE`` words is run in parts of that size, forward to know
the vectors between them and then backward, so a worker's matrices are bounded.

Defined results: a null text, an empty one and one without a letter are ``und`` with score 0; a null label is not
learnt from; without any labelled text every document is ``und``; with one label, or under ``SEQUENCE`` words of
labelled text, there is nothing to tell apart and every text with a letter gets the first label by name; equal texts get equal
results; an empty table gives an empty table; other columns are not read; bytes that are no UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_map, checkpointed, doc_hash_mod, new_token, per_worker, sent_if_small, text_of

FEATURES = 1 << 15
PER_LANG, SPAN, SEQUENCE, STEPS = 250, 160, 64, 60
BLOCK, WORDS_AT_ONCE, MEMO = 32, 60_000, 200_000
#: Windows of all languages together, labels at most, and values of a group's lattices while the field is fitted.
WINDOWS, MAX_LABELS, LATTICE = 4000, 256, 4 << 20
UNKNOWN = "und"
#: Characters of a word at most; longer runs make several words.
LONGEST = 40

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def letters_in(word: str) -> int:
    return len(word) if word.isalpha() else sum(map(str.isalpha, word))


def character_class(c: str, before: int) -> int:
    """0 no letter, 1 Latin, 2 other scripts up to U+2E7F, 3 those beyond; a mark goes with the character before it."""
    if not c.isalpha():
        return before if unicodedata.category(c)[0] == "M" else 0
    return 1 if c < "\u0250" or "\u1e00" <= c < "\u1f00" else 2 if c < "\u2e80" else 3


def split(text: str) -> list[str]:
    """The lower-cased words of a text, long runs in pieces."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out: list[str] = []
    for word in words:
        if len(word) <= LONGEST:
            out.append(word)
            continue
        start, last = 0, -1
        for i, c in enumerate(word):
            now = character_class(c, last)
            if i - start == LONGEST or (now != last and i > start):
                out.append(word[start:i])
                start = i
            last = now
        out.append(word[start:])
    return out


def features(words: list[str], lexicon: frozenset) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, and the word each belongs to.

    N-grams of one to three characters of the marked word, prefixes and suffixes up to three characters, and the
    word itself if it is in the lexicon.
    """
    marked = [f"^{w}$" for w in words]
    size = np.array([len(w) for w in marked])
    point = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(point)) - start[owner]
    hashed, owners = [], []

    def add(h, kind, own):
        h = (h ^ np.uint64(kind)) * _B
        hashed.append(((h ^ (h >> np.uint64(29))) * _A) >> np.uint64(64 - 15))
        owners.append(own)

    h = np.zeros(len(point), np.uint64)
    for n in (1, 2, 3):
        h[: len(point) - n + 1] = h[: len(point) - n + 1] * _A + point[n - 1 :] + np.uint64(1)
        inside = place + n <= size[owner]
        add(h[inside], n, owner[inside])
        for kind, at in ((10 + n, start + 1), (20 + n, start + size - 1 - n)):
            fits = size - 2 >= n
            add(h[at[fits]], kind, np.flatnonzero(fits))
    known = [i for i, w in enumerate(words) if w in lexicon]
    crc = np.array([zlib.crc32(words[i].encode("utf-8", "surrogatepass")) for i in known], np.uint64)
    add(crc, 30, np.array(known, np.int64))
    return np.concatenate(hashed).astype(np.int64), np.concatenate(owners)


@dataclass
class Field:
    labels: list[str]
    weight: np.ndarray  # (features, labels)
    transition: np.ndarray  # (labels, labels), log
    start: np.ndarray
    lexicon: frozenset = field(default_factory=frozenset)

    def __post_init__(self):
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((MEMO, len(self.labels)))
        self.letters = np.zeros(MEMO, np.int64)

    def emissions(self, words: list[str]) -> np.ndarray:
        feature, owner = features(words, self.lexicon)
        return np.stack(
            [np.bincount(owner, self.weight[feature, k], len(words)) for k in range(len(self.labels))], 1
        )

    def look_up(self, words: list[str]) -> np.ndarray:
        """Rows of the memo for the words; it is emptied when it cannot hold those that are new."""
        new = list(set(words).difference(self.memo))
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(set(words))
        if new:
            at = np.arange(len(self.memo), len(self.memo) + len(new))
            self.memo.update(zip(new, at.tolist()))
            self.letters[at] = list(map(letters_in, new))
            with np.errstate(over="ignore"):
                self.rows[at] = self.emissions(new) * (self.letters[at] > 0)[:, None]
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def posteriors(self, emission: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Forward-backward over documents laid end to end: (words, labels)."""
        return self.run(emission, sizes)[0]

    def run(
        self, emission: np.ndarray, sizes: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors, the forward vector at the last word, the backward vector before the first.

        The vectors are those of a part of a document, which comes alone, with the forward vector ``before`` it (None at the start of a document) and the
        backward vector ``after`` it; with ``after`` empty only the forward vector is made.
        """
        n_labels = emission.shape[1]
        x = np.exp(emission - emission.max(1, keepdims=True))
        t = np.exp(self.transition - self.transition.max())
        start = np.exp(self.start - self.start.max()) if before is None else before
        blocks = -(-sizes // BLOCK)
        n = int(blocks.sum())
        first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        doc = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(n) - first[doc]
        at = begin[doc][:, None] + nth[:, None] * BLOCK + np.arange(BLOCK)
        real = at < (begin + sizes)[doc][:, None]
        xs = np.where(real[:, :, None], x[np.minimum(at, len(x) - 1)], 1.0)
        is_first = (nth == 0) & (before is None)
        scale = lambda a: a / a.max(tuple(range(1, a.ndim)), keepdims=True)
        whole = np.broadcast_to(np.eye(n_labels), (n, n_labels, n_labels)).copy()
        for k in range(BLOCK):
            moved = (whole.reshape(-1, n_labels) @ t).reshape(whole.shape)
            if k == 0:
                moved[is_first] = whole[is_first]
            made = scale(moved * xs[:, k, None, :])
            whole = np.where(real[:, k, None, None], made, whole)
        enter, leave = np.empty((n, n_labels)), np.ones((n, n_labels))
        enter[first] = start
        for k in range(1, int(blocks.max(initial=0))):
            b = first[blocks > k] + k
            enter[b] = scale(np.einsum("bi,bij->bj", enter[b - 1], whole[b - 1]))
        end = scale((enter[-1] @ whole[-1])[None, :])[0]
        if after is not None:
            if not len(after):
                return x[:0], end, after
            leave[-1] = after
        for k in range(int(blocks.max(initial=0)) - 2, -1, -1):
            b = first[blocks > k + 1] + k
            leave[b] = scale(np.einsum("bij,bj->bi", whole[b + 1], leave[b + 1]))
        alpha = np.empty(xs.shape)
        v = enter
        for k in range(BLOCK):
            moved = v @ t
            if k == 0:
                moved[is_first] = v[is_first]
            v = np.where(real[:, k, None], scale(moved * xs[:, k]), v)
            alpha[:, k] = v
        v = leave
        for k in range(BLOCK - 1, -1, -1):
            alpha[:, k] *= v
            v = np.where(real[:, k, None], scale((xs[:, k] * v) @ t.T), v)
        gamma = alpha[real]
        return gamma / gamma.sum(1, keepdims=True), end, v[0]

    def long(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Of a document of any length: the sums of posteriors by letters, and its letters."""
        cuts = range(0, len(words), WORDS_AT_ONCE)
        vectors: list[np.ndarray | None] = [None]
        for c in cuts:
            part = words[c : c + WORDS_AT_ONCE]
            vectors.append(self.run(self.rows[self.look_up(part)], np.array([len(part)]), vectors[-1], np.empty(0))[1])
        total, counted, after = np.zeros(len(self.labels)), 0, np.ones(len(self.labels))
        for c, before in zip(reversed(cuts), reversed(vectors[:-1])):
            part = words[c : c + WORDS_AT_ONCE]
            at = self.look_up(part)
            letters = self.letters[at]
            gamma, _, after = self.run(self.rows[at], np.array([len(part)]), before, after)
            total += gamma.T @ letters
            counted += int(letters.sum())
        return total, counted

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        held: list[list[str]] = []
        for text in [*texts, None]:
            if held and (text is None or sum(map(len, held)) >= WORDS_AT_ONCE):
                out += self._label(held)
                held = []
            if text is not None:
                held.append(split(text))
        return out

    def _label(self, docs: list[list[str]]) -> list[tuple[str, float]]:
        result = [(UNKNOWN, 0.0)] * len(docs)
        if not self.labels:
            return result
        sums: dict[int, tuple[np.ndarray, float]] = {i: self.long(d) for i, d in enumerate(docs) if len(d) > WORDS_AT_ONCE}
        short = [i for i, d in enumerate(docs) if 0 < len(d) <= WORDS_AT_ONCE]
        if short:
            sizes = np.array([len(docs[i]) for i in short])
            at = self.look_up([w for i in short for w in docs[i]])
            letters = self.letters[at].astype(float)
            gamma = self.posteriors(self.rows[at], sizes) * letters[:, None]
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            sums |= dict(zip(short, zip(np.add.reduceat(gamma, begin), np.add.reduceat(letters, begin))))
        for i, (total, n) in sums.items():
            if n:
                best = int(total.argmax())
                result[i] = (self.labels[best], float(min(1.0, total[best] / n)))
        return result


def splice(rows: list[tuple[str, str]], labels: list[str], rng: np.random.Generator) -> tuple[list[list[str]], np.ndarray]:
    """Sequences of ``SEQUENCE`` words from runs of 4 to 32 words of labelled texts in random order, and labels."""
    runs: list[tuple[list[str], int]] = []
    for text, lang in rows:
        words = split(text)
        while words:
            n = int(rng.integers(4, 33))
            runs.append((words[:n], labels.index(lang)))
            words = words[n:]
    order = rng.permutation(len(runs))
    words = [w for i in order for w in runs[i][0]]
    marks = np.array([runs[i][1] for i in order for _ in runs[i][0]], np.int64)
    n = max(1, len(words) // SEQUENCE)
    return [words[i * SEQUENCE : (i + 1) * SEQUENCE] for i in range(n)], marks[: n * SEQUENCE]


class Group:
    """Some sequences with their words' features: what one pass of forward-backward takes, and the gradient it gives."""

    def __init__(self, sequences: list[list[str]], y: np.ndarray, lexicon: frozenset, n_labels: int):
        self.n_seq, self.y = len(sequences), y
        flat = [w for s in sequences for w in s]
        types, token = np.unique(np.array(flat, dtype=object), return_inverse=True)
        with np.errstate(over="ignore"):
            feature, owner = features(list(types), lexicon)
        spelt = np.array(list(map(has_letter, types)))[owner]
        self.feature, self.owner, self.n_types = feature[spelt], owner[spelt], len(types)
        self.by_place = token.reshape(self.n_seq, SEQUENCE).T
        self.token = self.by_place.ravel()
        self.one_hot = np.eye(n_labels)

    def expected(self, weight: np.ndarray, trans: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
        """Expected less observed features, expected pairs, and expected less observed first labels."""
        per_type = np.stack([np.bincount(self.owner, w[self.feature], self.n_types) for w in weight])
        x = np.exp(per_type - per_type.max(0))[:, self.by_place].transpose(1, 0, 2)  # (place, label, sequence)
        t = np.exp(trans)
        alpha, beta = np.empty_like(x), np.ones_like(x)
        v = np.exp(start) * x[0]
        for k in range(SEQUENCE):
            v = v if k == 0 else (t.T @ v) * x[k]
            v = v / v.sum(0)
            alpha[k] = v
        pairs = np.zeros_like(trans)
        for k in range(SEQUENCE - 2, -1, -1):
            ahead = x[k + 1] * beta[k + 1]
            whole = ((t.T @ alpha[k]) * ahead).sum(0)
            pairs += t * ((alpha[k] / whole) @ ahead.T)
            beta[k] = t @ ahead
            beta[k] /= beta[k].sum(0)
        alpha *= beta
        alpha /= alpha.sum(1, keepdims=True)
        alpha -= self.one_hot[:, self.y.T].transpose(1, 0, 2)
        wrong = alpha.transpose(1, 0, 2).reshape(len(weight), -1)
        spelt = np.stack([np.bincount(self.feature, np.bincount(self.token, w, self.n_types)[self.owner], FEATURES) for w in wrong])
        return [spelt, pairs, wrong[:, : self.n_seq].sum(1, keepdims=True)]


def fit(rows: list[tuple[str, str]], seed: int = 3) -> Field:
    """Maximum conditional likelihood with an L2 penalty, by Adam on all sequences at once, in groups."""
    labels = sorted({lang for _, lang in rows})
    n_labels = len(labels)
    empty = Field(labels, np.zeros((FEATURES, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    sequences, marks = splice(rows, labels, np.random.default_rng(seed))
    sequences = [s for s in sequences if len(s) == SEQUENCE]
    if not sequences or n_labels < 2:
        return empty
    n_seq = len(sequences)
    n = n_seq * SEQUENCE
    y = marks[:n].reshape(n_seq, SEQUENCE)
    lexicon = frozenset(w for w, c in Counter(w for s in sequences for w in s).items() if c >= 3)
    step = max(1, LATTICE // (SEQUENCE * n_labels))
    groups = [Group(sequences[i : i + step], y[i : i + step], lexicon, n_labels) for i in range(0, n_seq, step)]
    # labels come first in every array, so that the sums over them run along whole rows
    values = [np.zeros((n_labels, FEATURES)), np.zeros((n_labels, n_labels)), np.zeros((n_labels, 1))]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    pairs = np.zeros((n_labels, n_labels))
    np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
    for step in range(1, STEPS + 1):
        weight, trans, _ = values
        total = None
        for group in groups:
            own = group.expected(*values)
            total = own if total is None else [a + b for a, b in zip(total, own)]
        spelt, expected, begun = total
        gradients = [spelt / n + 1e-6 * weight, (expected - pairs) / n + 1e-5 * trans, begun / n]
        for v, g, m, s in zip(values, gradients, first, second):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    weight, trans, start = values
    return Field(labels, np.ascontiguousarray(weight.T), trans, start[:, 0], lexicon)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> list[tuple[str, str]]:
    """At most ``per_lang`` (window of a text, lang) of each language, fewer if there are so many that it would be over ``WINDOWS``, in an order that depends on ids and texts only.

    Rows are dealt by a hash of id and text to ``per_lang`` slots of their language, of which each keeps its least hash;
    the few texts so chosen are cut to ``SPAN`` words (of ``LONGEST`` characters at most) and collected.
    """
    docs = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("l"), F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("o")
    )
    n_labels = docs.select("l").distinct().limit(MAX_LABELS + 1).count()
    if n_labels > MAX_LABELS:
        raise ValueError(f"over {MAX_LABELS} different labels")
    per_lang = max(1, min(per_lang, WINDOWS // max(1, n_labels)))
    slot = F.pmod(F.xxhash64("o"), F.lit(per_lang))
    chosen = checkpointed(docs.groupBy("l", slot.alias("slot")).agg(F.min("o").alias("o")).select("l", "o"), 16)
    words = F.split(F.trim(F.regexp_replace("t", SPACES, " ")), " ")
    start = F.pmod(F.shiftright("o", 8), F.greatest(F.size(words) - SPAN, F.lit(1)))
    window = F.substring(F.array_join(F.slice(words, start.cast("int") + 1, SPAN), " "), 1, SPAN * (LONGEST + 1))
    rows = (
        docs.join(sent_if_small(chosen), ["l", "o"])  # per_lang rows of each language
        .select("l", "o", window.alias("w"))
        .groupBy("l", "o")
        .agg(F.first("w").alias("w"))
        .collect()
    )
    return [(r["w"], r["l"]) for r in sorted(rows, key=lambda r: (r["l"], r["o"]))]


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    held_out=None,
    per_lang: int = PER_LANG,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """id, kept columns, held_out, lang_pred, score. Documents for which ``held_out`` is true are not learnt from."""
    spark = docs.sparkSession
    held = F.coalesce(held_out if held_out is not None else doc_hash_mod(id_col, 3) == 1, F.lit(False))
    model = fit(sample(docs.filter(~held), id_col, text_col, lang_col, per_lang))
    sent = spark.sparkContext.broadcast((model.labels, model.weight.astype(np.float32), model.transition, model.start, model.lexicon))
    token = new_token()

    sent_columns = (*keep, *(() if text_col in keep else (text_col,)))  # the text goes over once
    place = sent_columns.index(text_col)

    def run(ids, held, *others):
        model = per_worker(token, lambda: Field(*sent.value))
        made = model.label([text_of(t) for t in others[place]])
        return ids, held, *others[: len(keep)], [m[0] for m in made], [m[1] for m in made]

    kinds = dict(docs.dtypes)
    kept = "".join(f"`k_{c}` {kinds[c]}, " for c in keep)
    return arrow_map(
        docs.select(id_col, held.alias("held_out"), *[F.col(c).alias(f"k_{c}") for c in sent_columns]),
        run,
        f"`{id_col}` {kinds[id_col]}, held_out boolean, {kept}lang_pred string, score double",
    ).withColumnsRenamed({f"k_{c}": c for c in keep})
