"""URL filter: host and path rules first, else logistic regression on hashed character n-grams of host and path.

The regression is trained from a small labelled table of URLs, at most ``MAX_LABELLED`` different hosts and paths of it
(chosen by their hash; of contradicting labels block counts); by default those URLs that a rule decides. Host and path are parsed and the rules matched by Spark's
own functions; the regression reads batches of URLs.

Defined results: a null URL or one without ``://`` has an empty host and path and is judged by the regression, as
is any URL that no rule fits; with labels of one kind only, or none, the verdict is the commoner one (else allow);
repeated rows are judged alike; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, new_token, per_worker, small_batches, text_of

FEATURES, NGRAMS, MAX_LABELLED, EPOCHS = 1 << 15, (3, 4, 5), 4000, 40
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def parsed(df: DataFrame, url_col: str) -> DataFrame:
    """Add host and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    df = df.withColumn("host", F.regexp_extract(url, pattern, 1)).withColumn("path", F.regexp_extract(url, pattern, 2))
    return df.withColumn("host", ascii_lower("host"))


def with_rule(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Add the longest rule that fits and its verdict; rules are (verdict, host and path prefix)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def features(texts: list[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of marked strings, and the string each belongs to."""
    marked = [f"^{t}$" for t in texts]
    size = np.array([len(t) for t in marked], np.int64)
    point = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), size)
    left = (np.cumsum(size) - 1)[owner] - np.arange(len(point)) + 1
    at, who = [], []
    h = np.zeros(len(point), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(NGRAMS) + 1):
            h[: len(point) - n + 1] = h[: len(point) - n + 1] * _A + point[n - 1 :] + np.uint64(1)
            if n in NGRAMS:
                inside = left >= n
                x = (h[inside] ^ np.uint64(salt * 8 + n)) * _B
                at.append((((x ^ (x >> np.uint64(31))) * _A) >> np.uint64(64 - 15)).astype(np.int64))
                who.append(owner[inside])
    return np.concatenate(at), np.concatenate(who)


def of_urls(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = features(hosts, 1), features(paths, 2)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def train(rows: list[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch Adam with an L2 penalty; features count by the root of their number."""
    weight, bias = np.zeros(FEATURES), np.zeros(1)
    y = np.array([r[2] for r in rows], float)
    if not len(rows) or y.min() == y.max():
        return weight, 1.0 if len(rows) and y.min() == 1 else -1.0
    at, who = of_urls([r[0] for r in rows], [r[1] for r in rows])
    scale = 1 / np.sqrt(np.bincount(who, minlength=len(rows)))
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in (weight, bias)]
    for t in range(1, EPOCHS + 1):
        z = np.bincount(who, weight[at], len(rows)) * scale + bias
        d = (1 / (1 + np.exp(-z)) - y) / len(rows)
        for v, g, (m, s) in zip((weight, bias), (np.bincount(at, (d * scale)[who], FEATURES) + 1e-6 * weight, d.sum()), state):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return weight, float(bias[0])


def labelled_sample(table: DataFrame, size: int) -> list[tuple[str, str, int]]:
    """At most ``size`` different rows (host, path, 1 for block) of a table of host, path and label."""
    table = table.withColumn("o", F.xxhash64("host", "path"))
    n = table.agg(F.approx_count_distinct("o")).first()[0]
    rows = (
        table.filter(F.pmod("o", F.lit(1_000_000)) < min(1_000_000, 1 + 1_500_000 * size // max(n, 1)))
        .groupBy("o", "host", "path")
        .agg(F.max((F.col("label") == "block").cast("int")).alias("block"))
        .orderBy("o", "host", "path")
        .limit(size)
        .collect()
    )
    return [(r["host"], r["path"], r["block"] or 0) for r in rows]


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    labels: DataFrame | None = None,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """id, host, path, rule, verdict, block_probability (of the regression). ``labels``: url and label (block, allow)."""
    ruled = with_rule(parsed(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u")), "u"), rules)
    table = (
        parsed(labels, "url").select("host", "path", "label")
        if labels is not None
        else ruled.filter("rule is not null").select("host", "path", F.col("rule_verdict").alias("label"))
    )
    model = train(labelled_sample(table, max_labelled))
    sent = pages.sparkSession.sparkContext.broadcast(model)
    token = new_token()
    kind = dict(pages.dtypes)[id_col]

    def run(batches):
        weight, bias = per_worker(token, lambda: sent.value)
        for batch in batches:
            if batch.num_rows:
                hosts, paths = ([text_of(t) for t in batch.column(c).cast(pa.binary()).to_pylist()] for c in (1, 2))
                at, who = of_urls(hosts, paths)
                n = np.maximum(np.bincount(who, minlength=len(hosts)), 1)
                z = np.bincount(who, weight[at], len(hosts)) / np.sqrt(n) + bias
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(1 / (1 + np.exp(-z)))], names=[*batch.schema.names, "p"]
                )

    small_batches(pages.sparkSession)
    made = ruled.select("id", "host", "path", "rule", "rule_verdict").mapInArrow(
        run, f"id {kind}, host string, path string, rule string, rule_verdict string, p double"
    )
    own = F.when(F.col("p") > 0.5, "block").otherwise("allow")
    return made.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", own).alias("verdict"),
        F.col("p").alias("block_probability"),
    )
