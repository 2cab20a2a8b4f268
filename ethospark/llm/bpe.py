"""Byte-pair encoding as a streaming transducer with bounded lookahead, and an incremental decoder.

The transducer reads a pre-token of any length in pieces. How far a merge decision can depend on what follows is a
property of the merge list alone (:func:`sufficient_lookahead`), so tokens that end further than that from the end
of the buffer are final and leave it: besides the text itself and its ids, the state is one buffer of about a window
of symbols however long the text. Decoding is a byte-to-text machine that is fed the ids in bounded pieces.

Nulls and empty texts give no ids and an empty text; repeated rows give repeated results; columns other than the
id and the text are not read; bytes that are no UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from array import array
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame

from .common import arrow_map, new_token, per_worker, text_of

#: Fixed values of the vocabulary's own pre-tokenizer: contractions, letter runs, single digits, symbol runs.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What a tokenizer file must say besides its vocabulary, merges and added tokens; other settings are refused.
SETTINGS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PRE_TOKEN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
WHITE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: Entries of the memo of chunks; it is emptied when full, so a worker's memory is bounded.
MEMO = 200_000
#: Symbols up to which a run is merged by looking at all of its pairs each time, which is faster for words.
SHORT = 48
#: The tokenizer file is sent to the executors; larger files are refused.
MAX_FILE = 64 << 20
#: Ids that the decoder is fed at a time.
PIECE = 4096


def read_spec(spec: str) -> dict:
    """The tokenizer file's content; a setting that this module doesn't implement is an error."""
    content = json.loads(spec)
    odd = [k for k, v in SETTINGS.items() if content.get(k) != v] + [k for k, v in MODEL.items() if content["model"].get(k, v) != v]
    odd += [t["content"] for t in content["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
    if odd:
        raise ValueError(f"the tokenizer file has settings that are not supported: {', '.join(odd)}")
    return content


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: printable Latin-1 stands for itself, the rest moves up from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(moved)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols to the right of a token that can decide whether the token stands.

    A merge of (a, b) is put in doubt from the right only by an earlier merge that takes b, or something on the
    right edge of a or b, together with its right neighbour; that one again only by still earlier ones. In rank
    order, ``reach[x]`` is how far beyond x's end the merges with x at the left, ranked so far, have to see.
    """
    reach: dict[str, int] = {}
    edge: dict[str, tuple[str, ...]] = {}
    length: dict[str, int] = {}

    def symbols(x: str) -> int:
        return length.setdefault(x, 1)

    for a, b in merges:
        n = symbols(b)
        far = max(
            [n]
            + [reach.get(x, 0) for x in edge.get(a, (a,))]
            + [n + reach.get(x, 0) for x in edge.get(b, (b,))]
        )
        whole = a + b
        length.setdefault(whole, symbols(a) + n)
        edge.setdefault(whole, (whole, *edge.get(b, (b,))))
        reach[a] = max(reach.get(a, 0), far)
    return max(reach.values(), default=0) + max(length.values(), default=1)


class Merges:
    """The merge list, and the encoding of one bounded run of symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges)
        self.window = 4 * self.lookahead

    def apply(self, parts: list[str]) -> list[str]:
        """The lowest-ranked pair first, the leftmost among equals, until no pair is in the list."""
        if len(parts) > SHORT:
            return self.apply_long(parts)
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts


    def apply_long(self, parts: list[str]) -> list[str]:
        """The same by a heap of (rank, place) over linked places; pairs that are gone stay in it until their turn comes."""
        rank, n = self.rank.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := rank(pair)) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if not parts[i] or j == n or rank((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((parts[i], parts[k]))) is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank((parts[h], parts[i]))) is not None:
                heappush(heap, (r, h))
        return [p for p in parts if p]


class Transducer:
    """Feed the symbols of one pre-token; stable tokens come out as soon as nothing that follows can change them."""

    def __init__(self, merges: Merges):
        self.merges, self.buffer = merges, []

    def feed(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        m = self.merges
        for i in range(0, len(symbols), m.window):
            self.buffer += symbols[i : i + m.window]
            if len(self.buffer) > m.window + m.lookahead:
                parts, end, keep = m.apply(list(self.buffer)), 0, len(self.buffer) - m.lookahead
                for p in parts:
                    if end + len(p) > keep:
                        break
                    end += len(p)  # every symbol is one character before the word's end
                    out.append(m.vocab[p])
                self.buffer = self.buffer[end:]
        return out

    def whole(self, symbols: list[str]) -> list[int]:
        """A pre-token that fits in the buffer."""
        self.buffer = symbols
        return self.finish()

    def finish(self) -> list[int]:
        if not self.buffer:
            return []
        self.buffer[-1] += self.merges.end
        parts, self.buffer = self.merges.apply(self.buffer), []
        vocab = self.merges.vocab
        return [vocab[p] for p in parts if p in vocab]


class Encoder:
    """Normalises, cuts into pre-tokens and encodes; the same ids as the tokenizer file's own library gives."""

    def __init__(self, spec: str):
        model = read_spec(spec)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.merges = Merges(model["model"]["vocab"], merges, model["model"].get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.marks = "".join(sorted({t[0] for t in self.special}))
        self.pre = regex.compile(PRE_TOKEN)
        self.bytes = byte_symbols()
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, list[int]] = {}

    def chunk(self, text: str) -> bytes:
        """Ids of a run without white space, packed; a special token's string inside it is that token."""
        ids: list[int] = []
        for part in self.cut.split(text) if any(c in text for c in self.marks) else (text,):
            if part in self.special:
                ids.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for word in (part,) if part.isalpha() and part.isascii() else (m[0] for m in self.pre.finditer(part)):
                made = self.words.get(word)
                if made is None:
                    run, step = Transducer(self.merges), self.merges.window
                    if 4 * len(word) <= step:
                        made = run.whole(self.symbols(word))
                    else:  # of any length: only a window of its symbols is there at a time
                        made = [i for at in range(0, len(word), step) for i in run.feed(self.symbols(word[at : at + step]))]
                        made += run.finish()
                    if len(word) < 40:
                        if len(self.words) >= MEMO:
                            self.words.clear()
                        self.words[word] = made
                ids += made
        return array("I", ids).tobytes()

    def symbols(self, word: str) -> list[str]:
        return list(map(self.bytes.__getitem__, word.encode()))

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        out, memo = [], self.memo
        for run in WHITE.split(text) if odd else text.split():
            made = memo.get(run)
            if made is None:
                made = self.chunk(run)
                if len(run) < 40:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[run] = made
            out.append(made)
        return b"".join(out)


class Decoder:
    """Incremental: ids in, text out. The state is an unfinished UTF-8 sequence, and whether anything came yet.

    A token adds bytes. With ``surface`` they are what the library's decoding of a file without a decoder gives: a
    space and the token's own spelling, without the space for the first token. Otherwise they are the bytes that the
    spelling stands for, a word's end being a space.
    """

    def __init__(self, spec: str, surface: bool = False):
        content = read_spec(spec)
        names = {i: t for t, i in content["model"]["vocab"].items()} | {t["id"]: t["content"] for t in content["added_tokens"]}
        special = {t["id"] for t in content["added_tokens"]}
        value, end = {c: bytes([b]) for b, c in enumerate(byte_symbols())}, content["model"].get("end_of_word_suffix") or ""
        self.token: dict[int, bytes] = {}
        for i, name in names.items():
            if surface:
                self.token[i] = b" " + name.encode()
                continue
            body = name.removesuffix(end) if end and i not in special else name
            raw = name.encode() if i in special else b"".join(value.get(c, c.encode()) for c in body)
            self.token[i] = raw + (b" " if body != name else b"")
        self.lead, self.started = int(surface), False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        raw = b"".join(map(self.token.__getitem__, ids))
        if raw and not self.started:
            raw, self.started = raw[self.lead :], True
        return self.state.decode(raw)

    def finish(self) -> str:
        tail = self.state.decode(b"", final=True)
        self.state.reset()
        self.started = False
        return tail

    def decode(self, ids) -> str:
        """All ids of a text, a bounded piece at a time."""
        return "".join([*(self.feed(ids[at : at + PIECE]) for at in range(0, len(ids), PIECE)), self.finish()])


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", surface: bool = True) -> DataFrame:
    """Encode every whole text and decode it again: id, ids (packed little-endian uint32), decoded."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > MAX_FILE:
        raise ValueError(f"tokenizer file of {len(spec)} characters; at most {MAX_FILE}")
    read_spec(spec)
    sent, token = docs.sparkSession.sparkContext.broadcast(spec), new_token()

    def run(ids, texts):
        encoder, decoder = per_worker(token, lambda: (Encoder(sent.value), Decoder(sent.value, surface)))
        packed, decoded = [], []
        for text in texts:
            packed.append(encoder.encode(text_of(text)))
            decoded.append(decoder.decode(array("I", packed[-1])))
        return ids, packed, decoded

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids binary, decoded string")
