"""Conversation prefixes against a plain dictionary of tuples; conversations across partitions; edges."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from ethospark.llm import queries, trie

KIND = "conv_id long, turn long, role string, text string, depth int, prefix string"


def slow(rows):
    """The definition; rows are (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[conv].append(((turn is not None, turn or 0, tie), role, text))
    own = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
        built[c] = base[:h] + own[c][h:]
    members = defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    saved, children, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, who in members.items():
        words = len(node[-1][1].encode().split()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * words
        if node:
            children[node[:-1]] += 1
    for node in members:
        if not children[node]:
            for d in range(len(node) + 1):
                leaves[node[:d]] += 1
    out = []
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def fast(spark, rows, parts=4):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], KIND).repartition(parts)
    return sorted((tuple(r) for r in trie.nodes(trie.rebuilt(frame)).collect()), key=str)


def made(seed, n, longest, kinds):
    r = random.Random(seed)
    text = lambda: " ".join(r.choice("abc") for _ in range(r.randrange(kinds)))
    rows = []
    for c in r.sample(range(-45, 130), n):
        for t in range(r.randrange(longest + 1)):
            rows.append((c, r.choice([t, t, None]), r.choice(["u", "v", None]), r.choice([text(), text(), None])))
    return rows + rows[: n // 2]


@pytest.mark.parametrize("part_rows", [3, 200_000])
def test_equals_definition(spark, monkeypatch, part_rows):
    monkeypatch.setattr(trie, "PART_ROWS", part_rows)
    monkeypatch.setattr(trie, "IDS", 2)
    monkeypatch.setattr(trie, "ROWS", 2)
    rows = made(part_rows, 90, 4, 3)
    assert fast(spark, rows) == slow(rows)


def test_long_conversations_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(trie, "PART_ROWS", 40)
    monkeypatch.setattr(trie, "RUN", 7)
    rows = [(c, t, "u", "x y" if t < 150 else f"z{c % 3}") for c in (0, 3, 7, 19, 20, 21, 61) for t in range(160)]
    rows += [(40, None, "u", "same") for _ in range(90)] + [(41, None, "u", "same") for _ in range(60)] + made(1, 30, 3, 2)
    assert fast(spark, rows) == slow(rows)


def test_cuts_anywhere():
    """Partitions of any size put a conversation together as one partition does."""
    r = random.Random(4)
    rows = [(c, r.randrange(5), r.randrange(9)) for c in (0, 1, 2, 5, 20, 40, 43) for _ in range(r.choice([1, 2, 3, 4, 9, 30]))]

    class Batch:
        def __init__(self, part, rows):
            self.columns = [Column(x) for x in zip(*[(c, (t).to_bytes(16, "big"), w, part) for c, t, w in rows])]

    class Column(list):
        def to_pylist(self):
            return list(self)

    def whole(cuts):
        cuts = [0, *cuts, len(rows)]
        parts = [(i, rows[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        found = [b.to_pydict() for p in parts for b in trie.summary([Batch(*p)])]
        before, edges = trie.put_together([(f["part"][0], trie.pickle.loads(f["raw"][0])) for f in found])
        return [x for p in parts for b in trie.paths([Batch(*p)], before, edges) for x in zip(*b.to_pydict().values())]

    plain = whole([])
    assert len(plain) > len(rows)
    for k in [1, 2, 5, 20] * 10:
        assert whole(sorted(r.sample(range(1, len(rows)), k))) == plain
    assert whole(range(1, len(rows))) == plain


def test_edges(spark):
    assert fast(spark, []) == []
    rows = [(None, 1, "u", "a"), (5, None, None, None), (5, 0, "u", ""), (5, 0, "u", ""), (7, 1, "u", "w " * 50_000), (25, 3, "u", "a b"), (45, 9, "u", "a b")]
    assert fast(spark, rows) == slow(rows)


def test_query(spark):
    t = pq.read_table("/root/testdata/sf0.001/conversations.parquet").to_pydict()
    made = queries.op12_prefix_trie(spark, "/root/testdata/sf0.001")
    assert made.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in made.collect()), key=str) == slow(zip(t["conv_id"], t["turn"], t["role"], t["text"]))
