"""The pipeline's stages: what they keep, what they change, and that they take any documents."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from ethospark.llm import langid, packing, pii, quality
from ethospark.llm.common import doc_hash_mod

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        if name != "packing":
            assert made.columns == first.columns
            assert made.join(docs, "doc_id", "left_anti").count() == 0
            assert made.filter(F.length("text") != F.col("n_chars")).count() == 0
        assert made.count() <= docs.count()
        docs = made
    assert [r["doc_id"] for r in docs.orderBy("doc_id").collect()] == [r["doc_id"] for r in corpus_pipeline.run(spark, SF).orderBy("doc_id").collect()]
    assert docs.count() > 0.7 * first.count()


def test_odd_documents(spark, docs):
    made = docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, made, SF)
        if name != "packing":
            assert made.columns == docs.columns
    assert {r["doc_id"] for r in made.collect()} >= {4}


def test_no_documents(spark, none):
    made = none
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, made, SF)
    assert made.count() == 0


def posterior_mean(field, text):
    """Language and score of a text by the plain forward-backward recursion, word by word."""
    words = langid.split(text or "")
    letters = np.array([sum(c.isalpha() for c in w) for w in words], float)
    if not letters.sum():
        return "und", 0.0
    with np.errstate(over="ignore"):
        e = field.emissions(words) * (letters > 0)[:, None]
    x, t, start = np.exp(e - e.max(1, keepdims=True)), np.exp(field.transition), np.exp(field.start)
    alpha, beta = [start * x[0]], [np.ones(len(start))]
    for k in range(1, len(words)):
        v = (alpha[-1] @ t) * x[k]
        alpha.append(v / v.sum())
    for k in range(len(words) - 1, 0, -1):
        v = t @ (x[k] * beta[-1])
        beta.append(v / v.sum())
    gamma = np.array(alpha) * np.array(beta[::-1])
    total = (gamma / gamma.sum(1, keepdims=True)).T @ letters
    return field.labels[int(total.argmax())], total.max() / letters.sum()


def shingled(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def private(text):
    digits = lambda t: [int(c) for c in t if c.isdigit()]
    luhn = lambda d: sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(d[::-1])) % 10 == 0
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+){3}", text) if all(int(v) < 256 for v in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([ -]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_brute_force(spark):
    """Every stage against plain Python on the stage's own input; with lines that are boilerplate and near copies."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    footer = F.concat("text", F.lit("\nRead the terms of the service at our site"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, footer).otherwise(F.col("text"))).withColumn("source", F.lit("s"))
    near = docs.filter("doc_id % 5 = 0 and length(text) > 300").withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.concat("text", F.lit(" more words")))
    docs = docs.unionByName(near).withColumn("n_chars", F.length("text").cast("bigint")).cache()
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: (r["text"], r["lang"], r["source"]) for r in df.collect()}

    have = rows(docs)
    labelled = docs.filter(doc_hash_mod("doc_id", 3) != 1)
    field = langid.fit(langid.sample(labelled, "doc_id", "text", "lang", langid.PER_LANG))
    field = langid.Field(field.labels, field.weight.astype(np.float32), field.transition, field.start, field.lexicon)
    want = {}
    for i, (t, _, s) in have.items():
        lang, score = posterior_mean(field, t)
        if lang != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            want[i] = (t, lang, s)
    made = stage["language"](spark, docs, SF).cache()
    assert rows(made) == want and 0 < len(want)

    normal = lambda line: " ".join(line.split()).lower()
    seen = {}
    for t, _, s in want.values():
        lines = [normal(x) for x in (t or "").split("\n") if x.split()]
        for x in set(lines):
            seen.setdefault((s, x), set()).add(tuple(lines))
    frequent = {k for k, v in seen.items() if len(v) > quality.MAX_DOCS}
    left = {}
    for i, (t, lang, s) in want.items():
        w = (t or "").split()
        count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(5)}
        stays = [x for x in (t or "").split("\n") if (s, normal(x)) not in frequent]
        n = sum(len(x.split()) for x in stays)
        if len(w) >= 10 and 100 * len(again) <= 20 * len(w) and (n == len(w) or (n >= 10 and 100 * n >= 30 * len(w))):
            left[i] = ("\n".join(stays), lang, s)
    made = stage["quality"](spark, made, SF).cache()
    assert frequent and rows(made) == left and len(left) < len(want)

    sets = {i: shingled(t) for i, (t, _, _) in left.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    alone = {i: left[i] for i in ids if root(i) == i}
    made = stage["near_duplicates"](spark, made, SF).cache()
    assert rows(made) == alone and len(alone) < len(left)

    model = pii.fit(made)
    clean, changed = {}, 0
    for i, (t, lang, s) in alone.items():
        spans = private(t)
        taken = [(a, b) for a, b, _ in spans]
        soft = sorted((-model.accepts(t, a, k, b), a, b, k) for a, k, b in pii.soft_candidates(t, [(a, k, b) for a, b, k in spans], model.gazetteer))
        for q, a, b, k in soft:
            if -q > 0.5 and not any(a < d and c < b for c, d in taken):
                spans.append((a, b, k))
                taken.append((a, b))
        out, at = "", 0
        for a, b, k in sorted(spans, key=lambda x: (x[0], pii.KINDS.index(x[2]))):
            out, at = (out + t[at:a] + f"<{k}>", b) if a >= at else (out, max(at, b))
        changed += bool(spans)
        clean[i] = (out + t[at:], lang, s)
    made = stage["privacy"](spark, made, SF).cache()
    assert rows(made) == clean and changed

    sizes = {i: len(t.split()) for i, (t, _, _) in clean.items()}
    h = sorted(Counter(sizes.values()).items())
    best = {j: sum(c * (h[j][0] - n) for n, c in h[: j + 1]) for j in range(len(h))}
    for _ in range(packing.BUCKETS - 1):
        best = {j: min([best[j]] + [best[i] + sum(c * (h[j][0] - n) for n, c in h[i + 1 : j + 1]) for i in range(j)]) for j in best}
    packs = stage["packing"](spark, made, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in packs} == sizes and len(packs) == len(sizes)
    assert sum(r["pad"] for r in packs) == best[len(h) - 1] and all(r["boundary"] - r["n_tokens"] == r["pad"] >= 0 for r in packs)
    places = {(r["bucket"], r["batch"], r["slot"]) for r in packs}
    assert len(places) == len(packs) and all(r["slot"] < max(1, packing.BUDGET // max(1, r["boundary"])) for r in packs)
    assert {(r["bucket"], r["boundary"]) for r in packs} == {(b, max(r["n_tokens"] for r in packs if r["bucket"] == b)) for b in {r["bucket"] for r in packs}}


def test_every_stage_is_computed_once(spark, monkeypatch, tmp_path):
    """Rows that a stage produces over the whole run are the rows of its table."""
    counts = {name: spark.sparkContext.accumulator(0) for name, _ in corpus_pipeline.STAGES}

    def counted(name, stage):
        def run(spark, docs, sf_dir):
            made, count = stage(spark, docs, sf_dir), counts[name]

            def through(batches):
                for b in batches:
                    count.add(b.num_rows)
                    yield b

            return made.mapInArrow(through, made.schema)

        return name, run

    docs, want = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        want[name] = docs.count()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(*s) for s in corpus_pipeline.STAGES])
    assert len(corpus_pipeline.run(spark, SF).collect()) == want["packing"]
    assert {name: c.value for name, c in counts.items()} == want
