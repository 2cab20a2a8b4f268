"""Quality rules from cross-document line frequency; DataFrame functions only.

Lines are normalised (lower case, white space collapsed) and hashed. Per host and line, the distinct documents are
counted. A line above the limit is boilerplate and is removed; a document that keeps too few of its words is
depleted and rejected, as is one that fails the base rules on its own text.

Documents of a host whose normalised lines are all equal are one document: a group of exact copies counts once in
every line it has. Near copies are different documents here; whoever wants them to count once removes them before.

One pass over the texts leaves a narrow record per document (counts, line hashes); everything else, the shuffles
too, works on those records. A hot line is summed before each shuffle, and the lines above the limit are sent to the
records if they are small, else joined with hot lines apart.

Defined results: a null or blank text has no words and fails the base rules; a null host is a host of its own;
repeated rows are judged alike, each on its own row; an empty table gives an empty table; other columns are kept
by ``clean_documents`` and not read by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, join_by_key, sent_if_small, veiled

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
#: A line in more than so many distinct documents of a host is boilerplate.
MAX_DOCS = 20
#: A document that keeps fewer words, or less than this percentage of them, is depleted.
LEFT_WORDS, LEFT_PERCENT = 10, 30


def line_words(text):
    """Per line of a text its words."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n", -1),
        lambda line: F.filter(F.split(line, SPACES, -1), lambda w: w != ""),
    )


def repeat_words(words: str, df: DataFrame) -> DataFrame:
    """Add n_repeat_words: words inside a five-word window that the text has twice or more.

    Windows are hashed to 64 bits; sorted with their places, equal neighbours are repeats. Of each repeated window
    the words not covered by the one before count.
    """
    n = F.size(words)
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn(
        "_w",
        F.when(
            n >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.greatest(n, F.lit(WINDOW)) - WINDOW),
                lambda i: F.xxhash64(*[F.col("_h")[i + k] for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_w")) < F.size("_w"),
            F.array_sort(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    tail = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    pairs = F.zip_with("_s", tail("_s"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("_p", F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))))
    gaps = F.zip_with("_p", tail("_p"), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_h", "_w", "_s", "_p")


def records(docs: DataFrame, id_col: str, text_col: str, host_col: str, keep: list[str]) -> DataFrame:
    """Per document: the base counts, a hash of all its normalised lines, and hash and number of words of each line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(
        *[F.col(c).alias(f"k_{c}") for c in keep],
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(host_col), F.col(host_col).isNull()).alias("host"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("raw"),
        line_words(text).alias("lw"),
    )
    df = df.withColumn("n_dup_lines", (F.size("raw") - F.size(F.array_distinct("raw"))).cast("bigint")).drop("raw")
    df = df.withColumn("lw", F.filter("lw", lambda ws: F.size(ws) > 0)).withColumn("words", F.flatten("lw"))
    df = repeat_words("words", df)
    df = df.withColumn(
        "lines",
        F.transform("lw", lambda ws: F.struct(F.xxhash64(F.lower(F.array_join(ws, " "))).alias("line"), F.size(ws).alias("n"))),
    )
    return df.select(
        *[f"k_{c}" for c in keep],
        "id",
        "host",
        F.size("words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.xxhash64("lines").alias("whole"),
        "lines",
    )


def frequent_lines(made: DataFrame, max_docs: int) -> DataFrame:
    """(host, line) that more than ``max_docs`` distinct documents of the host have, how many, and in how many rows."""
    each = made.select("host", "whole", F.explode(F.array_distinct(F.transform("lines", lambda e: e["line"]))).alias("line"))
    counted = each.groupBy("host", "line", "whole").agg(F.count("*").alias("n"))
    return (
        counted.groupBy("host", "line")
        .agg(F.count("*").alias("documents"), F.sum("n").alias("n_rows"))
        .filter(F.col("documents") > max_docs)
    )


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: the base counts, base_failed, removed_words, boilerplate (hashes of its removed lines), kept."""
    made = records(docs, id_col, text_col, host_col, list(keep))
    made = checkpointed(made.withColumn("row", F.monotonically_increasing_id()))
    rows = made.select("row", "host", F.explode("lines").alias("e")).select("row", F.struct("host", "e.line").alias("at"), "e.line", "e.n")
    frequent = frequent_lines(made, max_docs).select(F.struct("host", "line").alias("at"), "n_rows")
    lost = (
        join_by_key(rows, checkpointed(frequent, 4), "at", "n_rows")
        .groupBy("row")
        .agg(F.sum("n").alias("removed_words"), F.collect_set("line").alias("boilerplate"))
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & (
        (left < LEFT_WORDS) | (100 * left < LEFT_PERCENT * F.col("n_words"))
    )
    return (
        made.drop("lines", "whole")
        .join(lost, "row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("bigint"))
        .withColumn("boilerplate", F.coalesce("boilerplate", F.array().cast("array<bigint>")))
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & ~depleted)
        .select(
            F.col("id").alias(id_col), *[F.col(f"k_{c}").alias(c) for c in keep], "n_words", "word_chars", "n_symbols",
            "n_dup_lines", "n_repeat_words", "removed_words", "boilerplate", "base_failed", "kept",
        )
    )


def clean_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS
) -> DataFrame:
    """The kept documents with all their columns and without their boilerplate lines.

    Texts are not shuffled for it: what is rejected or changed comes back by id and text hash.
    """
    given = docs.columns
    docs, at = veiled(docs)
    id_col, text_col, host_col = at[id_col], at[text_col], at[host_col]
    print_of = F.xxhash64(text_col, F.col(text_col).isNull())
    judged = judge(docs.withColumn("_print", print_of), id_col, text_col, host_col, max_docs, ("_print", host_col))
    changed = judged.filter(~F.col("kept") | (F.size("boilerplate") > 0)).select(
        F.col(id_col).alias("_id"), "_print", F.col(host_col).alias("_host"), F.col("kept").alias("_kept"), "boilerplate"
    )
    changed = checkpointed(changed.distinct(), 4)
    same = (
        F.col(id_col).eqNullSafe(F.col("_id"))
        & (print_of == F.col("_print"))
        & F.col(host_col).eqNullSafe(F.col("_host"))
    )
    out = docs.join(sent_if_small(changed, "64 + 8 * size(boilerplate)"), same, "left").filter(F.coalesce("_kept", F.lit(True)))
    line_hash = lambda line: F.xxhash64(
        F.lower(F.array_join(F.filter(F.split(line, SPACES, -1), lambda w: w != ""), " "))
    )
    stays = F.filter(
        F.split(F.col(text_col), "\n", -1), lambda line: ~F.array_contains("boilerplate", line_hash(line))
    )
    text = F.when(F.size("boilerplate") > 0, F.array_join(stays, "\n")).otherwise(F.col(text_col))
    return out.withColumn(text_col, text).select(*docs.columns).toDF(*given)
