"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a span classifier decides.

The rules find e-mail addresses, IP addresses, card and phone numbers; those spans always stay. Further candidates
are names after a form of address or an introduction, names that the gazetteer lists with the capitalised word after
them, spelt-out addresses ("jo at mail dot org"), long numbers, and account or identity numbers. The gazetteer is a set or
a table of first names, of at most ``MAX_NAMES``. On every candidate, the rules' own spans included, six labelers vote for, against or
not at all: form, check digits, gazetteer, context before, context that speaks against, plainness.

Votes are summed by pattern over the whole corpus (at most 3**6 patterns of each kind), so expectation-maximisation of the labelers'
reliabilities sees every candidate and runs on a table of fixed size. A logistic classifier on hashed features of
the span and its context is then trained on a bounded sample of candidates, with the posteriors as soft labels, and
judges the candidates that overlap no rule span; those it accepts are added under their own kind, the likeliest first
where they overlap. All scans take linear time: each starts at a mark (``@``, a digit's first place, a title) that it cannot
start at again.

Defined results: a null or empty text has no spans; repeated rows get equal spans; an empty table gives an empty
table; other columns are not read by ``spans`` and kept by ``redact``. Spans are code points of the whole text;
bytes that are no UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Taken, arrow_map, new_token, per_worker, text_of

#: Fixed values of the rules: the parts of an address before and after its @, IP addresses, cards, phones.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
RULES = ("email", "ip", "card", "phone")
KINDS = (*RULES, "name", "spelt", "number", "account")

NAME = re.compile(
    r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame|my name is|ich heiße|me llamo|je m'appelle)"
    r"\.?\x20([A-ZÀ-Þ][a-zß-ÿ'-]+(?:\x20[A-ZÀ-Þ][a-zß-ÿ'-]+)?)"
)
SPELT = re.compile(
    r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+[\x20(\[]{1,3}(?:at|AT)[\x20)\]]{1,3}[A-Za-z0-9-]{1,63}+"
    r"[\x20(\[]{1,3}(?:dot|DOT)[\x20)\]]{1,3}[A-Za-z]{2,6}\b"
)
#: Two capitalised words in a row, the first of which may be in the gazetteer.
PAIR = re.compile(r"\b([A-ZÀ-Þ][a-zß-ÿ'-]{1,40}+)\x20[A-ZÀ-Þ][a-zß-ÿ'-]{1,40}+")
NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9][0-9\x20().-]{5,24}[0-9](?![0-9A-Za-z])")
ACCOUNT = re.compile(r"\b(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}|[0-9]{3}-[0-9]{2}-[0-9]{4})\b")
MAYBE_NAME = re.compile(r"Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Monsieur|Madame|name is|heiße|llamo|appelle")
DIGIT = re.compile(r"[0-9]")
FOR = re.compile(r"(?i)tel|phone|call|fon|mail|contact|card|karte|iban|konto|account|ssn|name|address|passport|born")
AGAINST = re.compile(r"(?i)version|licen|release|isbn|page|price|order|total|id[:=#]|token|password|secret|key|v$")
#: First names of a table at most.
MAX_NAMES = 1_000_000
#: First names, as a gazetteer where none is given.
GAZETTEER = frozenset(
    "Anna Ben Carlos Carmen Charlotte Claire David Elena Emma Emily Felix Hans Jack James Jan Jane John José Juan Julia"
    " Karl Laura Lena Louis Lucas Lucía Luis Marie María Martin Mary Max Michael Nina Noah Olivia Paul Peter Pierre"
    " Robert Sarah Sofia Sophie Thomas William".split()
)
LABELERS = 6
FEATURES, SAMPLE_ROWS, NEAR = 1 << 13, 6000, 32


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def count_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def addresses(text: str) -> list[tuple[int, int]]:
    """The e-mail addresses from left to right: what stands before an @ belongs to that one alone."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def rule_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the rules' spans, by start and kind. Failing matches are dropped, without a retry."""
    out = [(s, "email", e) for s, e in addresses(text)]
    if DIGIT.search(text):
        out += [
            (m.start(), "ip", m.end()) for m in IP.finditer(text) if all(len(q) < 4 and int(q or 0) <= 255 for q in (p.lstrip("0") for p in m[0].split(".")))
        ]
        for m in CARD.finditer(text):
            digits = count_digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), "card", m.end()))
        if "+" in text:
            out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(count_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def soft_candidates(text: str, rules: list[tuple[int, str, int]], gazetteer: frozenset) -> list[tuple[int, str, int]]:
    """Further candidates that overlap no rule span; they may overlap one another."""
    found: set[tuple[int, str, int]] = set()
    if MAYBE_NAME.search(text):
        found.update((m.start(1), "name", m.end(1)) for m in NAME.finditer(text))
    at = 0
    while m := PAIR.search(text, at):
        if m[1] in gazetteer:
            found.add((m.start(), "name", m.end()))
        at = m.end() if m[1] in gazetteer else m.end(1)
    if "dot" in text or "DOT" in text:
        found.update((m.start(), "spelt", m.end()) for m in SPELT.finditer(text))
    if DIGIT.search(text):
        found.update((m.start(), "account", m.end()) for m in ACCOUNT.finditer(text))
        found.update((m.start(), "number", m.end()) for m in NUMBER.finditer(text) if len(count_digits(m[0])) >= 7)
    taken = Taken((s, e) for s, _, e in rules)
    return sorted(c for c in found if not taken.overlaps(c[0], c[2]))


def votes(text: str, start: int, kind: str, end: int, gazetteer: frozenset) -> tuple[int, ...]:
    """Each labeler's vote: 1 personal, -1 not, 0 none."""
    span, before, after = text[start:end], text[max(0, start - NEAR) : start], text[end : end + 8]
    digits = count_digits(span)
    form = 1 if kind in RULES or kind in ("spelt", "account", "name") else -1 if re.match(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", span) else 0
    if kind == "card" or kind == "number" and len(digits) >= 12:
        check = 1 if luhn(digits) else -1
    elif kind == "account" and span[0].isalpha():
        turned = "".join(str(int(c, 36)) for c in span[4:] + span[:4])
        check = 1 if int(turned) % 97 == 1 else -1
    else:
        check = 0
    words = re.findall(r"[^\W\d_]+", span)
    listed = 1 if any(w.capitalize() in gazetteer for w in words) else 0
    plain = 1 if len(set(digits)) >= 5 or "@" in span else -1 if digits and len(set(digits)) <= 2 else 0
    against = -1 if AGAINST.search(before[-16:]) or after[:1] in ("%", "€", "$") else 0
    return form, check, listed, 1 if FOR.search(before) else 0, against, plain


def features(text: str, start: int, kind: str, end: int) -> list[int]:
    """Hashed features: kind, shape and its n-grams, length, words before and after."""
    span = text[start:end]
    shape = re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "0", re.sub(r"[A-ZÀ-Þ]", "A", span)))
    short = re.sub(r"(.)\1+", r"\1", shape)
    names = [f"k{kind}", f"s{kind}{short}", f"n{kind}{len(count_digits(span))}"]
    names += [f"g{shape[i : i + 3]}" for i in range(len(shape) - 2)]
    names += [f"b{w.lower()}" for w in re.findall(r"\w+", text[max(0, start - NEAR) : start])[-3:]]
    names += [f"a{w.lower()}" for w in re.findall(r"\w+", text[end : end + 16])[:1]]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in names]


@dataclass
class Model:
    """The labelers' reliabilities and the span classifier."""

    accuracy: np.ndarray  # (labelers, 3 votes, 2 classes)
    prior: float
    weight: np.ndarray
    gazetteer: frozenset

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        log = np.log(np.array([1 - self.prior, self.prior]))[None, :].repeat(len(patterns), 0)
        for j in range(LABELERS):
            log = log + np.log(self.accuracy[j, patterns[:, j] + 1])
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(1)

    def accepts(self, text: str, start: int, kind: str, end: int) -> float:
        z = float(self.weight[features(text, start, kind, end)].sum())
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Expectation-maximisation for labelers that err independently given the class, from the majority's vote.

    A vote for keeps at least even odds in favour of the class (a labeler is taken to be better than chance).
    """
    p = 1 / (1 + np.exp(-1.5 * patterns.sum(1)))
    accuracy, prior = np.full((LABELERS, 3, 2), 1 / 3), 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts], 1)
        prior = float(np.clip(weight[:, 1].sum() / max(weight.sum(), 1e-9), 0.02, 0.98))
        for j in range(LABELERS):
            for v in (-1, 0, 1):
                accuracy[j, v + 1] = weight[patterns[:, j] == v].sum(0) + 1.0
            accuracy[j] /= accuracy[j].sum(0)
            accuracy[j, 2, 1] = max(accuracy[j, 2, 1], accuracy[j, 2, 0])
            accuracy[j, 0, 0] = max(accuracy[j, 0, 0], accuracy[j, 0, 1])
        p = Model(accuracy, prior, np.zeros(0), frozenset()).posterior(patterns)
    return accuracy, prior


def train(rows: list[tuple[list[int], float]], epochs: int = 12) -> np.ndarray:
    """Logistic regression on soft labels by AdaGrad."""
    weight, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-6)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, y = rows[i]
            q = 1 / (1 + np.exp(-np.clip(weight[at].sum(), -30, 30)))
            for k in at:
                g = (q - y) + 1e-4 * weight[k]
                squares[k] += g * g
                weight[k] -= 0.3 * g / np.sqrt(squares[k])
    return weight


def names_of(gazetteer: frozenset | DataFrame) -> frozenset:
    """The first names of a set, or of a table's first column."""
    if not isinstance(gazetteer, DataFrame):
        return gazetteer
    rows = gazetteer.select(F.col(gazetteer.columns[0]).alias("n")).filter("n is not null").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"a gazetteer of over {MAX_NAMES} names")
    return frozenset(r["n"] for r in rows)


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gazetteer: frozenset | DataFrame = GAZETTEER
) -> Model:
    """Count all candidates' votes, estimate reliabilities, train the classifier on at most ``SAMPLE_ROWS`` candidates."""

    gazetteer = names_of(gazetteer)
    names = docs.sparkSession.sparkContext.broadcast(gazetteer)

    def run(texts):
        out, known = [], names.value
        for raw in texts:
            text = text_of(raw)
            rules = rule_spans(text)
            for s, k, e in [*rules, *soft_candidates(text, rules, known)]:
                pattern = sum((v + 1) * 3**j for j, v in enumerate(votes(text, s, k, e, known)))
                at = text[max(0, s - NEAR) : e + 16]
                out.append((KINDS.index(k), pattern, at, s - max(0, s - NEAR), e - max(0, s - NEAR)))
        return list(zip(*out)) if out else ([], [], [], [], [])

    found = arrow_map(docs.select(text_col), run, "kind int, pattern int, near string, s int, e int")
    # candidates are few and short; one narrow pass gives both the counts of all and a bounded sample of each pattern
    order = F.xxhash64("near", "s")
    rows = (
        found.withColumn("salt", F.pmod(order, F.lit(64)))
        .groupBy("kind", "pattern", "salt")
        .agg(F.count("*").alias("n"), F.min_by(F.struct("near", "s", "e"), order).alias("one"))
        .collect()
    )
    digits = lambda p: [p // 3**j % 3 - 1 for j in range(LABELERS)]
    if not rows:
        return Model(np.full((LABELERS, 3, 2), 1 / 3), 0.5, np.zeros(FEATURES), gazetteer)
    patterns = np.array([digits(r["pattern"]) for r in rows])
    counts = np.array([r["n"] for r in rows], float)
    accuracy, prior = estimate(patterns, counts)
    model = Model(accuracy, prior, np.zeros(FEATURES), gazetteer)
    soft = model.posterior(patterns)
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["salt"], rows[i]["kind"], rows[i]["pattern"]))[:SAMPLE_ROWS]
    model.weight = train(
        [(features(rows[i]["one"]["near"], rows[i]["one"]["s"], KINDS[rows[i]["kind"]], rows[i]["one"]["e"]), float(soft[i])) for i in order]
    )
    return model


def all_spans(text: str, model: Model) -> list[tuple[int, str, int, float | None]]:
    rules = rule_spans(text)
    out = [(s, k, e, None) for s, k, e in rules]
    soft = [(model.accepts(text, s, k, e), s, k, e) for s, k, e in soft_candidates(text, rules, model.gazetteer)]
    taken = Taken()
    for q, s, k, e in sorted(soft, key=lambda c: (-c[0], c[1], KINDS.index(c[2]))):
        if q > 0.5 and taken.add(s, e):
            out.append((s, k, e, q))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """id and spans: kind, start, end, score (null for the rules' own), by start and kind."""
    model = model or fit(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    token = new_token()

    def run(ids, texts):
        model = per_worker(token, lambda: sent.value)
        made = [all_spans(text_of(t), model) for t in texts]
        return ids, [[{"kind": k, "start": s, "end": e, "score": q} for s, k, e, q in m] for m in made]

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(
        docs.select(id_col, text_col),
        run,
        f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>",
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """The same rows and columns, each span replaced by its kind in angle brackets; overlapping spans as one."""
    model = model or fit(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    token, place = new_token(), docs.columns.index(text_col)

    def run(*columns):
        model = per_worker(token, lambda: sent.value)
        out = []
        for raw in columns[place]:
            if raw is None:
                out.append(None)
                continue
            text, parts, at = text_of(raw), [], 0
            for s, k, e, _ in all_spans(text, model):
                if s >= at:
                    parts += [text[at:s], f"<{k}>"]
                at = max(at, e)
            out.append("".join([*parts, text[at:]]))
        return *columns[:place], out, *columns[place + 1 :]

    return arrow_map(docs, run, ", ".join(f"`{c}` {k}" for c, k in docs.dtypes))
