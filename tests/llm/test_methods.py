"""The methods' own parts of op4 and op8, span by span and verdict by verdict, against plain loops with the same fitted models."""

import math
import random

import numpy as np
import pytest

from ethospark.llm import queries, secrets, urls

SF = "/root/testdata/sf0.001"


def test_op8_verdicts_of_the_regression(spark, monkeypatch):
    kept, real = [], urls.train
    monkeypatch.setattr(urls, "train", lambda rows: kept.append(real(rows)) or kept[-1])
    made = queries.op8_url_regression(spark, SF).collect()
    (weight, bias), a, b, mask = kept[0], int(urls._A), int(urls._B), (1 << 64) - 1

    def grams(text, salt):
        points = [ord(c) for c in f"^{text}$"]
        for n in urls.NGRAMS:
            for i in range(len(points) - n + 1):
                h = 0
                for p in points[i : i + n]:
                    h = (h * a + p + 1) & mask
                x = ((h ^ (salt * 8 + n)) * b) & mask
                yield (((x ^ (x >> 31)) * a) & mask) >> (64 - 15)

    judged = 0
    for r in made:
        at = [*grams(r.host, 1), *grams(r.path, 2)]
        p = 1 / (1 + math.exp(-(sum(weight[i] for i in at) / math.sqrt(max(1, len(at))) + bias)))
        assert r.block_probability == pytest.approx(p, abs=1e-9)
        if r.rule is None:
            judged += 1
            assert r.verdict == ("block" if p > 0.5 else "allow") or abs(p - 0.5) < 1e-9
    assert judged >= 30


def plain_probability(net, left, token, right):
    """The greatest over a candidate's windows, one filter and one place at a time."""
    best = 0.0
    for piece in secrets.pieces(token):
        codes, own = secrets.encoded(left, piece, right)
        e, k, c, o = (net.p[x] for x in "ekco")
        top = [[0.0] * secrets.FILTERS, [0.0] * secrets.FILTERS]
        for at in range(secrets.WINDOW - secrets.SPAN + 1):
            x = [v for j in range(at, at + secrets.SPAN) for v in [*e[codes[j]], own[j]]]
            inside = 0 if own[at + secrets.SPAN // 2] > 0 else 1
            for f in range(secrets.FILTERS):
                h = max(0.0, float(np.dot(x, k[:, f])) + c[f])
                top[inside][f] = max(top[inside][f], h)
        z = float(np.dot(np.concatenate(top), o) + net.p["b"][0])
        best = max(best, 1 / (1 + math.exp(-min(30, max(-30, net.scale * z + net.shift)))))
    return best


def test_op4_spans_of_the_network(spark, monkeypatch):
    kept, real = [], secrets.fit
    monkeypatch.setattr(secrets, "fit", lambda rows, *more: kept.append(real(rows, *more)) or kept[-1])
    r = random.Random(8)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts = [f"see {pick(alnum, r.randint(18, 60))} and ghp_{pick(alnum, 30)} or some-{pick('abcde', 6)}-{pick('abcde', 9)}-word, /usr/share/{pick('xyz', 12)}/lib" for _ in range(25)]
    texts += ["token = " + pick(alnum, 30), "", None, "plain words only"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    planted = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    made = {x.doc_id: x.spans for x in secrets.scan(docs.union(planted)).collect()}
    net, found = kept[0], 0
    for i, text in enumerate(texts):
        text = text or ""
        rules = secrets.rule_spans(text)
        want = []
        for s, e in secrets.candidates(text):
            if all(e <= a or s >= b for a, _, b in rules):
                q = plain_probability(net, *secrets.window(text, s, e))
                limit = net.threshold[secrets.character_class(text[s:e])]
                if q >= limit or abs(q - limit) < 1e-9:
                    want.append((s, e))
        got = [(x["start"], x["end"]) for x in made[10**9 + i] if x["kind"] == "net"]
        assert got == sorted(want)
        found += len(got)
    assert 25 <= found < 75
