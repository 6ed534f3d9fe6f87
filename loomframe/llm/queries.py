"""One query for each operator over its whole table, with the SQL twins that exist."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import (
    bpe, decontam, exact_dedup, langid, minhash, prefix_trie, secrets, sentencepieces, token_counts, toxicity, url_filter, warc, whitening,
)

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

# The rules of the URL contract, and names of hosts whose URLs are listed.
ALLOW, BLOCK = ["org/", "com/fr/"], ["example.org/es/", "example.org/en/1", "com/de/"]
LISTED_HOSTS = r"://([^/?#]*\.)?(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\."

#: Categories of the chain in order, over the table ``labels``.
CATEGORIES = {
    "low_quality": "quality = 0",
    "toxic": "toxic = 1",
    "toxic_low_quality": "toxic = 1 and quality = 0",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").filter(F.col("url").rlike(LISTED_HOSTS))
    return url_filter.judge_urls(pages, listed, ALLOW, BLOCK)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = langid.identify(docs, langid.learn(docs))
    return named.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES), ["toxic"])


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.piece_digests(table(spark, sf_dir, "documents"), PIECES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash, op2_decontamination, op3_token_counts, op4_url_filter, op5_bpe, op6_language, op7_secrets, op8_warc,
        op9_exact_dedup, op10_toxicity, op11_whitening, op12_prefix_trie, op13_sentencepiece,
    )
}

_URL_PARTS = r"""
with parts as (
  select page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
named as (
  select *, case when host <> '' then regexp_replace(host, '^(www|m)\.', '')
            || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') end as canonical
  from parts),
listed as (
  select distinct canonical from named
  where canonical is not null
    and regexp_matches(url, '://([^/?#]*\.)?(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.')),
rules(rule, name, start, verdict) as (values
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
  ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
fitted as (
  select page_id, url, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from named join rules on (host = name or ends_with(host, '.' || name)) and starts_with(path, start)
  group by page_id, url)
select n.page_id, n.host, n.path, f.rule,
       coalesce(f.verdict, case when l.canonical is not null then 'block' else 'allow' end) as verdict,
       l.canonical is not null as listed
from named n left join fitted f on n.page_id = f.page_id left join listed l on n.canonical = l.canonical
"""

_MINHASH = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end)) as s
  from words),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
both_ways as (select a, b from links union select b, a from links),
reached(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, e.b from reached r join both_ways e on r.other = e.a)
select d.doc_id, coalesce(z.n, 0)::bigint as n_shingles, min(r.other) as component_id, d.doc_id = min(r.other) as kept
from documents d join reached r on r.doc_id = d.doc_id left join sizes z on z.doc_id = d.doc_id group by d.doc_id, z.n
"""

_WARC = """
with p as (
  select page_id, encode(coalesce(html, '')) as body, sha256(coalesce(html, '')) as digest from pages),
f as (select *, octet_length(body)::bigint as n, min(page_id) over (partition by digest) as first from p)
select page_id, n as payload_bytes, digest as payload_digest,
       case when n >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
       case when n >= 100 and first <> page_id then first end as refers_to
from f
"""

_EXACT = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256 order by n desc, doc_id)
"""

_TRIE = """
with turns as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as said,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
coded as (
  -- crc32: each byte enters, then eight shifts, each with the polynomial if a one falls out
  select c, max(pos) as m, c - c % 100 as first,
         xor(list_reduce(list_transform(range(1, length(c::varchar) + 1), lambda i: ascii(substr(c::varchar, i, 1))::bigint), lambda crc, byte:
               list_reduce(range(8), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(crc, byte)),
             4294967295::bigint), 4294967295) % 6 as h
  from turns group by c),
parts as (
  select k.c, t.pos as place, t.role, t.said from coded k join turns t on t.c = k.first and t.pos <= k.h
  union all
  select k.c, 1000 + t.pos, t.role, t.said from coded k join turns t on t.c = k.c and t.pos > k.h),
steps as (
  select c, row_number() over (partition by c order by place) as d, length(said)::bigint as n,
         sha256(length(role)::varchar || ':' || role || ':' || said) as g
  from parts),
paths as (
  select c, d, n, sha256(string_agg(g, ',') over (partition by c order by d)) as path from steps
  union all select c, 0, 0, '' from coded),
sizes as (select c, max(d) as total from paths group by c),
nodes as (
  select p.path, p.d, min(p.c) as low, count(*) as convs, max(p.n) as n,
         sha256(coalesce(string_agg(p.c::varchar, ',' order by p.c) filter (p.d = z.total), '')) as ends
  from paths p join sizes z on z.c = p.c group by p.path, p.d),
above as (
  select v.path, v.d, v.low, v.n, v.convs, a.path as top, a.d as top_d from nodes v join paths a on a.c = v.low and a.d <= v.d),
children as (select top as path, count(*) as k from above where top_d = d - 1 group by top),
sums as (
  select a.top as path, sum(case when c.k is null then 1 else 0 end)::bigint as leaves, sum((a.convs - 1) * a.n)::bigint as saved
  from above a left join children c on c.path = a.path group by a.top)
select v.low as conv_id, v.d as depth, p.low as parent_conv_id, v.convs as n_convs, coalesce(c.k, 0)::bigint as n_children,
       s.leaves as n_leaves, s.saved as saved_tokens, v.ends as ends_sha256
from nodes v join sums s on s.path = v.path left join children c on c.path = v.path
left join above a on a.path = v.path and a.top_d = v.d - 1 left join nodes p on p.path = a.top
"""

#: Operators 2, 3, 5, 6, 7, 10, 11 and 13 are beyond SQL (edit distance of all windows, encoders, offsets of
#: matches, trained models, eigenvectors); their tests compare them with brute force, the libraries or held-out rows.
ORACLE: dict[str, str] = {
    "op1_minhash": _MINHASH, "op4_url_filter": _URL_PARTS, "op8_warc": _WARC, "op9_exact_dedup": _EXACT, "op12_prefix_trie": _TRIE,
}
