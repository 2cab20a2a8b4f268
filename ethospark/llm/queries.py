"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dedup, fingerprint, langid, lattice, packing, pii, quality, secrets, substring, trie, urls, whiten
from .common import span_digest, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return made.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_min_max_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("boilerplate")


def op1_order_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprint.with_successor(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op6_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def counted_spans(made: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> for the rules' kinds, the digest of their spans, all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return made.withColumn("base", base).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(span_digest("base").cast("binary"), 256).alias("base_sha256"),
        span_digest("spans").alias("spans"),
    )


def op4_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted_spans(secrets.scan(table(spark, sf_dir, "documents")), ("assign", "access", "hex"))


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted_spans(pii.spans(table(spark, sf_dir, "documents")), pii.RULES)


def op7_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


#: Fixed rules of the query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op8_url_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op11_covariance_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring.repeats(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_length_buckets": op7_length_buckets, "op8_url_regression": op8_url_regression, "op5_weak_supervision": op5_weak_supervision, "op4_secret_network": op4_secret_network, "op3_crf_language": op3_crf_language, "op6_subword_lattice": op6_subword_lattice, "op1_order_min_hash": op1_order_min_hash, "op2_line_frequency": op2_line_frequency, "op10_min_max_dedup": op10_min_max_dedup, "op9_bpe_transducer": op9_bpe_transducer, "op11_covariance_whitening": op11_covariance_whitening, "op12_prefix_trie": op12_prefix_trie, "op13_seed_extend": op13_seed_extend}
#: Words of a text as DuckDB has them.
WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op2_line_frequency": rf"""
with d as (select doc_id, source, coalesce(text, '') as t, {WORDS.format("coalesce(text, '')")} as w,
       list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as raw from documents),
g as (select doc_id, w, list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) as g from d),
gu as (select doc_id, unnest(g) as x, unnest(range(1, len(g) + 1)) as i from g),
gr as (select doc_id, i from gu qualify count(*) over (partition by doc_id, x) > 1),
gc as (select doc_id, sum(least(5, coalesce(i - p, 5))) as n from (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from gr) group by 1),
ln as (select doc_id, source, list_transform(raw, lambda l: {WORDS.format("l")}) as lw from d),
ls as (select doc_id, source, unnest(lw) as ws, generate_subscripts(lw, 1) as i from ln),
lx as (select doc_id, source, i, lower(array_to_string(ws, ' ')) as line, len(ws) as n from ls),
k as (select doc_id, list(line order by i) as whole from lx group by 1),
f as (select source, line from lx join k using (doc_id) group by 1, 2 having count(distinct whole) > 20),
r as (select doc_id, sum(n) as n from lx join f on lx.line = f.line and lx.source is not distinct from f.source group by 1),
b as (select d.doc_id, len(d.w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(raw) - len(list_distinct(raw)) as n_dup_lines,
       coalesce(gc.n, 0)::bigint as n_repeat_words, coalesce(r.n, 0)::bigint as removed_words
       from d left join gc using (doc_id) left join r using (doc_id)),
c as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b)
select *, not base_failed and not (removed_words > 0 and (n_words - removed_words < 10 or 100 * (n_words - removed_words) < 30 * n_words)) as kept from c""",
    "op10_min_max_dedup": f"""
with recursive w as (select doc_id, {WORDS.format(LOWER.format("text"))} as w from documents),
s as (select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])))
             when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as x from s),
j as (select a.doc_id as a, b.doc_id as b, any_value(a.n) + any_value(b.n) as n, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from j where 100 * c >= 85 * (n - c)),
bi as (select a, b from l union select b, a from l),
r as (select a as doc_id, b as to_id from bi union select r.doc_id, bi.b from r join bi on r.to_id = bi.a),
m as (select doc_id, min(to_id) as m from r group by 1)
select s.doc_id, len(s.s) as n_shingles, least(s.doc_id, coalesce(m.m, s.doc_id)) as component_id,
       s.doc_id = least(s.doc_id, coalesce(m.m, s.doc_id)) as kept
from s left join m using (doc_id)""",
    "op12_prefix_trie": rf"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
o as (select conv_id, list(struct_pack(r := role, t := text) order by turn nulls first, sha256(strlen(role) || ':' || role || text)) as own from t group by 1),
h as (select conv_id, own, conv_id - conv_id % 20 as base, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda crc, byte:
       list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) as crc from o),
hh as (select conv_id, own, base, xor(crc, 4294967295) % 4 as h from h),
b as (select x.conv_id, list_concat(coalesce(y.own, [])[1:x.h], x.own[x.h + 1:]) as path from hh x left join hh y on y.conv_id = x.base),
p as (select conv_id, unnest(range(0, len(path) + 1)) as depth, path from b),
k as (select conv_id, depth, len(path) as length, md5(path[1:depth]::varchar) || depth as node, md5(path[1:depth - 1]::varchar) || (depth - 1) as above,
       case when depth > 0 then len({WORDS.format("path[depth].t")}) else 0 end as words from p),
n as (select node, any_value(above) as above, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words, list(conv_id order by conv_id) filter (length = depth) as ends from k group by node, depth),
c as (select above, count(*) as n_children from n where depth > 0 group by 1),
m as (select n.*, coalesce(c.n_children, 0) as n_children from n left join c on c.above = n.node),
s as (select x.node, sum((m.n_convs - 1) * m.words) as saved_tokens, count(*) filter (m.n_children = 0) as n_leaves
      from (select distinct u.node, v.node as low from k u join k v on u.conv_id = v.conv_id and u.depth <= v.depth) x join m on m.node = x.low group by 1)
select m.conv_id, m.depth, q.conv_id as parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(coalesce(array_to_string(m.ends, ','), '')) as ends_sha256
from m join s using (node) left join m q on q.node = m.above and m.depth > 0""",
    "op13_seed_extend": rf"""
with d as (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
a as (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d),
k as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) as k from a),
r as (select doc_id, i from k qualify count(*) over (partition by k) > 1),
g as (select doc_id, list(i order by i) as starts from r group by 1),
p as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from d),
c as (select p.doc_id, p.i, x, max(r.i) over (partition by p.doc_id order by p.i rows between 34 preceding and current row) as s from p left join r on r.doc_id = p.doc_id and r.i = p.i),
o as (select doc_id, count(s) as n_removed, string_agg(x, ' ' order by i) filter (s is null) as kept from c group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join o using (doc_id)""",
}
