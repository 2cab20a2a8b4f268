"""Ids that many rows share, and very long runs without white space."""

import random
import time

import pytest
from tokenizers import Tokenizer

from ethospark.llm import bpe, dedup
from ethospark.llm.queries import tokenizer_path

WORDS = [f"w{i}" for i in range(400)]


def components(rows, percent=85):
    """doc_id, n_shingles, component_id of each row, by all pairs."""
    sets = [{" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w := (t or "").split()) >= 3 else ({" ".join(w)} if w else set()) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def text(start, n=60, odd=None):
    own = WORDS[start : start + n]
    return " ".join([odd, *own[1:]] if odd else own)


@pytest.mark.parametrize("times", [1, 3])
def test_ids_with_several_texts(spark, times):
    rows = [(7, text(0)), (7, text(100)), (9, text(100, odd="x")), (9, text(200)), (3, text(200, odd="y")), (5, text(0)), (5, None), (7, "")] * times
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == components(rows)
    kept = dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "-") for r in kept) == sorted([(5, text(0)), (5, "-"), (7, text(100)), (3, text(200, odd="y")), (7, "-")])


def test_no_product_of_rows_that_share_ids(spark):
    """Two ids with very many texts each: as many comparisons as pairs, whatever the rows."""
    n = 3000
    rows = spark.range(n).selectExpr("0L as doc_id", "concat_ws(' ', transform(sequence(1, 30), i -> concat('a', id, '_', i))) as text")
    rows = rows.union(spark.range(n).selectExpr("1L", "concat_ws(' ', transform(sequence(1, 30), i -> concat(if(i = 1, 'x', 'a'), id, '_', i)))"))
    joined = []
    real = dedup.compare

    def counted(pairs, texts, *more):
        joined.append(dedup.with_texts(pairs, texts).count())
        return real(pairs, texts, *more)

    dedup.compare = counted
    try:
        got = dedup.near_duplicates(rows)
        found = got.groupBy("doc_id", "component_id").count().collect()
    finally:
        dedup.compare = real
    assert sorted(map(tuple, found)) == [(0, 0, n), (1, 0, n)] and sum(joined) <= 1.2 * n


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_copies_are_compared_a_few_times(spark, width, percent):
    """Groups of 24 near copies and some of which only the next is linked: few comparisons a text, not one for each pair."""
    r, rows = random.Random(width), []
    for g in range(25):
        base = [f"g{g}_{i}" for i in range(120)]
        for _ in range(24):
            own = base[:]
            own[r.randrange(120)] = f"n{len(rows)}"
            rows.append((len(rows), " ".join(own)))
        for k in range(1, 4):  # each differs from the one before it by three words
            rows.append((len(rows), " ".join([f"c{g}_{i}" if i < 3 * k else w for i, w in enumerate(base)])))
    joined, real = [], dedup.compare

    def counted(pairs, texts, *more):
        joined.append(pairs.count())
        return real(pairs, texts, *more)

    dedup.compare = counted
    try:
        got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()
    finally:
        dedup.compare = real
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == [(i, 121 - width, i - i % 27) for i in range(len(rows))]
    assert sum(joined) <= 3 * len(rows)


@pytest.mark.parametrize("piece", ["a", "abcdefgh", "the", "zq", "ab1é"])
def test_long_runs_equal_the_library(piece):
    path = tokenizer_path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read())
    library = Tokenizer.from_file(path)
    for n in (30, 47, 49, 130, 2288, 9000):
        run = (piece * n)[:n]
        got = list(memoryview(encoder.encode(run)).cast("I"))
        assert got == library.encode(run, add_special_tokens=False).ids


def test_a_megabyte_of_one_letter():
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read())
    began = time.process_time()
    encoder.encode("a" * 1_000_000)
    assert time.process_time() - began < 15
