"""Secret scan: fixed rules, and a character convolutional network over every candidate and its context.

Candidates are the rules' findings and all runs of 16 or more key characters. The network reads the end of the left
context, the candidate and the start of the right context as characters, with a mark on the candidate's own. A
candidate over ``OWN`` characters is read whole, in windows of ``OWN`` that overlap by half, between the same contexts;
its score is the greatest of its windows', and training follows the window that is greatest at the time. It is
trained on labelled findings: candidates of a bounded sample of documents, labelled by the rules, together with
generated secrets of other shapes and look-alikes (plain words, numbers, identifiers), alone and in long runs, set
into the sample's contexts, with the tell-tale keyword left out of half of them. Scores are calibrated by logistic scaling on a held-out
part; per character class, the threshold is the greatest that keeps ``RECALL`` of the held-out secrets (of all
of them for a class that has none).

Rule findings always stay; a candidate that overlaps none and passes its threshold is added with kind ``net``.

Defined results: a null or empty text has no findings; repeated rows get equal findings; an empty table gives an
empty table; other columns are not read; bytes that are no UTF-8 are read as U+FFFD. Spans are code points of the
whole text.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Taken, arrow_map, new_token, per_worker, text_of

#: Fixed values of the rules.
ASSIGN = re.compile(
    r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "net")
CANDIDATE, LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}"), re.compile(r"\S{16,}")
KEYWORD = re.compile(r"(?ai:passw|secret|token|api)")

LEFT, OWN, RIGHT = 24, 40, 8
WINDOW = LEFT + OWN + RIGHT
ALPHABET, EMBED, FILTERS, SPAN = 97, 8, 24, 5
#: Windows scored at a time, and characters of the parts in which a sample's token is sent.
AT_ONCE, SENT = 2048, 200
SAMPLE_DOCS, SAMPLE_ROWS, GENERATED, EPOCHS, RECALL = 4000, 3000, 1500, 6, 0.98


def rule_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the rules' findings, in order."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of all runs of key characters that are long enough."""
    return [
        (run.start() + m.start(), run.start() + m.end())
        for run in LONG.finditer(text)
        for m in CANDIDATE.finditer(run[0])
    ]


def value_of(text: str, start: int, end: int) -> tuple[int, int]:
    """The part of a rule's finding that the network judges: its longest run of key characters."""
    m = max(CANDIDATE.finditer(text[start:end]), key=lambda m: len(m[0]), default=None)
    return (start + m.start(), start + m.end()) if m else (start, end)


def window(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - LEFT) : start], text[start:end], text[end : end + RIGHT]


def character_class(token: str) -> int:
    """0 hexadecimal, 1 letters and digits, 2 with other characters."""
    return 0 if re.fullmatch(r"[0-9a-fA-F]+", token) else 1 if token.isalnum() else 2


def pieces(token: str, size: int = OWN, step: int = OWN // 2) -> list[str]:
    """Overlapping parts of ``size`` characters that cover the token; the last one ends with it."""
    last = max(0, len(token) - size)
    return [token[i : i + size] for i in [*range(0, last, step), last]]


def encoded(left: str, token: str, right: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of one window's characters, and which of them are the candidate's; longer tokens come in ``pieces``."""
    token = token[:OWN]
    text = left[-LEFT:].rjust(LEFT, "\0") + token.ljust(OWN, "\0") + right[:RIGHT].ljust(RIGHT, "\0")
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(raw == 0, 0, np.where((raw >= 32) & (raw < 127), raw - 31, 96))
    own = np.zeros(WINDOW)
    own[LEFT : LEFT + len(token)] = 1.0
    return codes, own


class Network:
    """Embedding, one convolution, maxima over the candidate and over its context, logistic output."""

    def __init__(self, seed: int = 4):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.5, (ALPHABET, EMBED)),
            "k": r.normal(0, 0.2, (SPAN * (EMBED + 1), FILTERS)),
            "c": np.zeros(FILTERS),
            "o": r.normal(0, 0.2, 2 * FILTERS),
            "b": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, np.full(3, 0.5)

    def forward(self, codes: np.ndarray, own: np.ndarray):
        p, n = self.p, len(codes)
        x = np.concatenate([p["e"][codes], own[:, :, None]], 2)
        wide = np.lib.stride_tricks.sliding_window_view(x, SPAN, 1).transpose(0, 1, 3, 2).reshape(n, WINDOW - SPAN + 1, -1)
        h = np.maximum(wide @ p["k"] + p["c"], 0.0)
        inside = own[:, SPAN // 2 : SPAN // 2 + h.shape[1]] > 0
        top = np.concatenate([np.where(inside[:, :, None], h, 0).max(1), np.where(inside[:, :, None], 0, h).max(1)], 1)
        return wide, h, inside, top, top @ p["o"] + p["b"]

    def step(self, codes, own, y, state, t, rate=0.01):
        p, n = self.p, len(codes)
        wide, h, inside, top, z = self.forward(codes, own)
        dz = (1 / (1 + np.exp(-z)) - y) / n
        g = {"o": top.T @ dz, "b": dz.sum(keepdims=True)}
        dtop = dz[:, None] * p["o"]
        dh = np.zeros_like(h)
        rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        for part, mask in ((slice(0, FILTERS), inside), (slice(FILTERS, None), ~inside)):
            at = np.where(mask[:, :, None], h, 0).argmax(1)
            dh[rows, at, cols] += dtop[:, part] * ((h[rows, at, cols] > 0) & mask[rows, at])
        flat = dh.reshape(-1, FILTERS)
        g["k"], g["c"] = wide.reshape(len(flat), -1).T @ flat, flat.sum(0)
        dx = (flat @ p["k"].T).reshape(n, h.shape[1], SPAN, EMBED + 1)[..., :EMBED]
        g["e"] = np.zeros_like(p["e"])
        for k in range(SPAN):
            np.add.at(g["e"], codes[:, k : k + h.shape[1]].ravel(), dx[:, :, k].reshape(-1, EMBED))
        for key in p:
            m, s = state.setdefault(key, (np.zeros_like(p[key]), np.zeros_like(p[key])))
            m += 0.1 * (g[key] - m)
            s += 0.01 * (g[key] ** 2 - s)
            p[key] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)

    def probability(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.forward(codes[i : i + 256], own[i : i + 256])[4] for i in range(0, len(codes), 256)])
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def score(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        """The probability of each candidate (left, token, right): the greatest of its windows'."""
        out, made, owner = np.zeros(len(rows)), [], []

        def flush():
            if made:
                np.maximum.at(out, owner, self.probability(*(np.stack(v) for v in zip(*made))))
                made.clear()
                owner.clear()

        for i, (left, token, right) in enumerate(rows):
            for piece in pieces(token):
                made.append(encoded(left, piece, right))
                owner.append(i)
                if len(made) == AT_ONCE:
                    flush()
        flush()
        return out


def generated(rng: random.Random, n: int, contexts: list[tuple[str, str]]) -> list[tuple[str, str, str, int]]:
    """Labelled findings of shapes that the rules do not know, and look-alikes."""
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum = lower + lower.upper() + digits
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: "".join(rng.choice(lower) + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    secret = [
        lambda: pick(alnum, rng.randint(20, 44)),
        lambda: pick(alnum + "+/", rng.choice([24, 32, 40, 44, 64])) + rng.choice(["", "=", "=="]),
        lambda: rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "key-"]) + pick(alnum, rng.randint(20, 36)),
        lambda: pick(digits + "ABCDEF", rng.choice([24, 32, 40])),
        lambda: pick(digits + "abcdef", rng.choice([16, 18, 20, 22])),
        lambda: "AKIA" + pick(lower.upper() + digits, 16),
    ]
    plain = [
        lambda: "".join(word() for _ in range(rng.randint(4, 8))),
        lambda: "".join(word() for _ in range(4)).upper(),
        lambda: "-".join(word() for _ in range(rng.randint(3, 6))),
        lambda: "_".join(word() for _ in range(rng.randint(3, 6))) + rng.choice(["", "1", "_v2"]),
        lambda: "/".join(word() for _ in range(rng.randint(3, 6))),
        lambda: pick(digits, rng.randint(16, 20)),
        lambda: rng.choice("=-_") * rng.randint(16, 40),
        lambda: "".join(word().capitalize() for _ in range(rng.randint(4, 7))),
        lambda: f"20{pick(digits, 2)}-0{pick('123456789', 1)}-{pick('12', 1)}{pick(digits, 1)}_{pick(digits, 6)}",
    ]
    leads = ["key = ", "auth: ", "Bearer ", 'secret="', "token=", "credentials ", "password: "]
    out = []
    for _ in range(n):
        left, right = rng.choice(contexts) if contexts else ("", "")
        lead = rng.choice(leads) if rng.random() < 0.5 else ""
        out.append((left + lead, rng.choice(secret)(), right, 1))
        left, right = rng.choice(contexts) if contexts else ("", "")
        out.append((left, rng.choice(plain)(), right, 0))
    return out


def long_runs(rng: random.Random, n: int, made: list[tuple[str, str, str, int]]) -> list[tuple[str, str, str, int]]:
    """Labelled runs over one window from generated findings: look-alikes joined, and the same around a secret."""
    secret, plain = ([r for r in made if r[3] == label] for label in (1, 0))
    out = []
    for label in (1, 0) * n:
        parts = [rng.choice(plain)[1] for _ in range(rng.randint(3, 6))]
        if label:
            parts.insert(rng.randint(0, len(parts)), rng.choice(secret)[1])
        left, _, right, _ = rng.choice(plain)
        out.append((left, rng.choice("/=_-").join(parts), right, label))
    return out


def fit(rows: list[tuple[str, str, str, int]], seed: int = 4) -> Network:
    """Train, calibrate and set the thresholds; a fifth of the rows, by a hash of the text, is held out for that."""
    net = Network(seed)
    if not rows:
        return net
    cut = [pieces(r[1]) for r in rows]
    made = [encoded(r[0], piece, r[2]) for r, parts in zip(rows, cut) for piece in parts]
    codes, own = np.stack([m[0] for m in made]), np.stack([m[1] for m in made])
    count = np.array([len(parts) for parts in cut])
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(rows)), count)

    def greatest(which: np.ndarray) -> np.ndarray:
        """For each of the rows, its window with the greatest probability."""
        best = first[which]
        several = which[count[which] > 1]
        if len(several):
            at = np.flatnonzero(np.isin(owner, several))
            q = net.probability(codes[at], own[at])
            order = at[np.lexsort((-at, q, owner[at]))]
            top = dict(zip(owner[order].tolist(), order.tolist()))
            best = np.array([top.get(i, b) for i, b in zip(which.tolist(), best.tolist())])
        return best

    y = np.array([r[3] for r in rows], float)
    kind = np.array([character_class(r[1]) for r in rows])
    held = np.array([zlib.crc32(r[1].encode("utf-8", "surrogatepass")) % 5 == 0 for r in rows])
    rng, state, t = np.random.default_rng(seed), {}, 0
    train = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            if len(part):
                t += 1
                at = greatest(part)
                net.step(codes[at], own[at], y[part], state, t)
    if not held.any():
        return net
    at = greatest(np.flatnonzero(held))
    z = net.forward(codes[at], own[at])[4]
    a, b, target = 1.0, 0.0, y[held] * 0.98 + 0.01
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a -= 0.05 * ((q - target) * z).mean()
        b -= 0.05 * (q - target).mean()
    net.scale, net.shift = float(a), float(b)
    q = net.probability(codes[at], own[at])
    secret = y[held] > 0
    for c in range(3):
        own_class = secret & (kind[held] == c)
        good = np.sort(q[own_class if own_class.any() else secret])
        if len(good):
            net.threshold[c] = good[int((1 - RECALL) * len(good))]
    return net


def labelled(docs: DataFrame, id_col: str, text_col: str) -> list[tuple[str, str, str, int]]:
    """Candidates of about ``SAMPLE_DOCS`` documents, labelled by the rules; at most ``SAMPLE_ROWS`` of either label.

    A token over ``SENT`` characters makes several rows, parts that overlap by a window, and so none of it is left out.
    """
    n = docs.count()
    order = F.pmod(F.xxhash64(F.col(id_col), F.lit("secrets")), F.lit(1_000_000))
    cut = min(1_000_000, 1 + 1_000_000 * SAMPLE_DOCS // max(n, 1))

    def run(orders, texts):
        out = []
        for o, raw in zip(orders, texts):
            text = text_of(raw)
            rules = rule_spans(text)
            taken = Taken((s, e) for s, _, e in rules)
            spans = [(s, e, 1) for s, _, e in rules]
            spans += [(s, e, 0) for s, e in candidates(text) if not taken.overlaps(s, e)]
            for s, e, label in spans:
                if label:  # the value alone, as the network meets it elsewhere
                    s, e = value_of(text, s, e)
                left, token, right = window(text, s, e)
                out += [(o, left, part, right, label) for part in pieces(token, SENT, SENT - OWN)]
        return list(zip(*out)) if out else ([], [], [], [], [])

    found = arrow_map(
        docs.select(order.alias("o"), text_col).filter(F.col("o") < cut),
        run,
        "o bigint, lead string, token string, tail string, label int",
    )
    rows = []
    for label in (0, 1):
        rows += found.filter(F.col("label") == label).orderBy("o", "token", "lead").limit(SAMPLE_ROWS).collect()
    return [(r[1], r[2], r[3], r[4]) for r in rows]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans: kind, start, end, score (the network's probability), by start and kind."""
    rows = labelled(docs, id_col, text_col)
    contexts = [(r[0], r[2]) for r in rows if not r[3]]
    made = generated(random.Random(4), GENERATED, contexts)
    net = fit(rows + made + long_runs(random.Random(5), GENERATED // 5, made))
    sent = docs.sparkSession.sparkContext.broadcast(net)
    token = new_token()

    def run(ids, texts):
        net = per_worker(token, lambda: sent.value)
        found, windows, asked = [], [], []
        for i, raw in enumerate(texts):
            text = text_of(raw)
            rules = rule_spans(text)
            taken = Taken((s, e) for s, _, e in rules)
            found.append([])
            for s, k, e in rules:
                windows.append(window(text, *value_of(text, s, e)))
                asked.append((i, s, e, k, -1))
            for s, e in candidates(text):
                if not taken.overlaps(s, e):
                    windows.append(window(text, s, e))
                    asked.append((i, s, e, "net", character_class(text[s:e])))
        if asked:
            for (i, s, e, k, c), q in zip(asked, net.score(windows)):
                if c < 0 or q >= net.threshold[c]:
                    found[i].append((s, k, e, float(q)))
        order = lambda x: (x[0], KINDS.index(x[1]))
        return ids, [[{"kind": k, "start": s, "end": e, "score": q} for s, k, e, q in sorted(f, key=order)] for f in found]

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(
        docs.select(id_col, text_col),
        run,
        f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>",
    )
