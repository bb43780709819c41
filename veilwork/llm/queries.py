"""One query for each training-data operator, with its DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from veilwork.llm import hard_negatives, hnsw, html_text, line_quality, mixing, packing, pieces, prefix_trie, simhash, token_blocks, toxicity, url_filter, warc
from veilwork.llm.common import table

URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def model_bytes(path: str) -> bytes:
    """A tokenizer's file, read on the driver and sent along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.digests(pieces.encode_decode(table(spark, sf_dir, "documents"), model))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.documents.select("doc_id", "size", "source_size", "target", "taken")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.embedding_components(table(spark, sf_dir, "embeddings"))


def op8_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = model_bytes(public_tokenizers.path("word_bpe_49k.json")).decode()
    return token_blocks.token_table(table(spark, sf_dir, "documents"), model)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = model_bytes(public_tokenizers.path("word_bpe_49k.json")).decode()
    return packing.packed_pieces(table(spark, sf_dir, "documents"), model)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_url_filters, op2_quality_rules, op3_simhash_near_dedup, op4_sentencepiece, op5_warc, op6_mixing, op7_embedding_near_dedup,
            op8_token_blocks, op9_toxicity, op10_html_extraction, op11_hard_negatives, op12_packing, op13_prefix_trie,
        )
    }


OP1_SQL = """
with parts as (
  select page_id, instr(url, '://') as p, url from pages
), rest as (
  select page_id, case when p > 0 then substr(url, p + 3) else '' end as r from parts
), split as (
  select page_id,
    translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path
  from rest
), rules(rh, rp, v) as (
  values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits as (
  select page_id, rh || rp as rule, v,
    row_number() over (partition by page_id order by length(rh || rp) desc, length(rh) desc) as n
  from split, rules
  where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
)
select s.page_id, s.host, s.path, f.rule, coalesce(f.v, 'allow') as verdict
from split s left join fits f on f.page_id = s.page_id and f.n = 1
"""

OP2_SQL = r"""
with d as (
  select doc_id, source, coalesce(text, '') as t from documents
), w as (
  select doc_id, source, t, list_filter(string_split(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') as ws from d
), pos as (
  select doc_id, unnest(ws) as word, unnest(range(len(ws))) as i from w
), tri as (
  select doc_id, i, word as a, lead(word, 1) over o as b, lead(word, 2) over o as c
  from pos window o as (partition by doc_id order by i)
), rep as (
  select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from tri where c is not null
), covered as (
  select doc_id, count(distinct i + k) as n_repeat_words
  from rep, (values (0), (1), (2)) o(k) where n > 1 group by doc_id
), ls as (
  select doc_id, source, unnest(string_split(t, chr(10))) as line from d
), dup as (
  select doc_id, count(*) - count(distinct line) as n_dup_lines
  from ls where regexp_matches(line, '[^ \t-\r]') group by doc_id
), norm as (
  select doc_id, source, trim(regexp_replace(regexp_replace(lower(line), '[ \t-\r]+', ' ', 'g'), '[0-9]', '0', 'g')) as line from ls
), counted as (
  select *, len(string_split(line, ' ')) as n from norm where line <> ''
), freq as (
  select source, line from counted group by all having count(distinct doc_id) > 20
), gone as (
  select doc_id, sum(n) as removed_words from counted s
  where exists (select 1 from freq f where f.source is not distinct from s.source and f.line = s.line) group by doc_id
), s as (
  select w.doc_id, cast(len(ws) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    cast(coalesce(removed_words, 0) as bigint) as removed_words
  from w left join dup using (doc_id) left join covered using (doc_id) left join gone using (doc_id)
), b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s
)
select *, not base_failed and n_words - removed_words >= 0.3 * n_words as kept from b
"""


# base32 of a SHA-1: eight groups of 20 bits, four letters each
OP5_SQL = """
with p as (
  select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as h from pages
), d as (
  select page_id, octet_length(b) as n,
    list_transform(range(8), lambda i: cast('0x' || substr(h, 5 * i + 1, 5) as bigint)) as v, h, b
  from p
), e as (
  select page_id, n, b,
    list_aggregate(list_transform(v, lambda x:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), 'string_agg', '') as payload_digest,
    max(page_id) over (partition by b) as keeper
  from d
)
select page_id, n as payload_bytes, payload_digest,
  case when page_id = keeper then 'response' else 'revisit' end as record_type,
  case when page_id <> keeper then keeper end as refers_to
from e
"""

OP6_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) as bigint) as size,
    md5('17|' || doc_id) as k
  from documents
), t as (
  select source, sum(size) as s, row_number() over (order by source is null, encode(source)) - 1 as r from d group by source
), w as (
  select *, cast([3, 1, 2][r % 3 + 1] as double) as w, cast(2 * s as double) as cap from t
), l as (
  select *, (1.5::double * sum(s) over () - coalesce(sum(cap) over o, 0)) / (sum(w) over () - coalesce(sum(w) over o, 0)) as level
  from w window o as (order by cap / w, r rows between unbounded preceding and 1 preceding)
), v as (
  select *, (select level from l where level * w <= cap order by cap / w, r limit 1) as final from l
), g as (
  select source, cast(s as bigint) as source_size, least(cap, coalesce(final * w, cap)) as target from v
), q as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as rounds from g
), laid as (
  select d.doc_id, d.size, q.*, sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and current row) as upto,
    cast(round(target - rounds * source_size) as bigint) as rest
  from d join q on d.source is not distinct from q.source
)
select doc_id, size, source_size, target,
  cast(rounds * size + greatest(0, least(rest, upto) - (upto - size)) as bigint) as taken
from laid
"""


OP11_SQL = """
with v as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
), p as (
  select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5
), n as (
  select p.a as anchor_id, p.b as positive_id, s.b as negative_id, p.score as positive_score, s.score as negative_score,
    cast(row_number() over (partition by p.a, p.b order by s.score desc, s.b) as int) as rank
  from p join s on s.a = p.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""

# crc32 bit by bit: 3988292384 is the reversed polynomial
OP13_SQL = """
with t as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as p,
    coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), s as (
  select c, count(*) as own, c - c % 5 as base,
    xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::bigint) % 9 as h
  from t group by c
), r as (
  select s.c, s.own, s.h, s.base, least(s.h, coalesce(b.own, 0)) as taken from s left join s b on b.c = s.base
), u as (
  select r.c, t.p, role, text from r join t on t.c = r.base and t.p < r.h
  union all
  select r.c, r.taken + t.p - r.h, role, text from r join t on t.c = r.c and t.p >= r.h
), k as (
  select c, list({'role': role, 'text': text} order by p) as turns, count(*) as n from u group by c
  union all
  select c, [], 0 from r where c not in (select c from u)
), x as (
  select c, n, d, md5(turns[1:d]::varchar || '|' || d) as key, case when d > 0 then turns[d].text end as text
  from (select c, n, turns, unnest(range(n + 1)) as d from k)
), nodes as (
  select d, key, min(c) as conv_id, count(*) as n_convs, octet_length(encode(coalesce(first(text), ''))) as bytes,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '')) as ends_sha256
  from x group by d, key
), up as (
  select v.d, v.key, w.conv_id as parent_conv_id, w.key as parent
  from nodes v join x on x.c = v.conv_id and x.d = v.d - 1 join nodes w on w.d = x.d and w.key = x.key
), kids as (
  select parent, count(*) as n_children from up group by parent
), under as (
  select w.d, w.key, count(*) filter (l.n_children is null) as n_leaves, sum((v.n_convs - 1) * v.bytes) as saved_tokens
  from nodes v join x on x.c = v.conv_id and x.d <= v.d join nodes w on w.d = x.d and w.key = x.key left join kids l on l.parent = v.key
  group by w.d, w.key
)
select n.conv_id, cast(n.d as bigint) as depth, u.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children,
  cast(b.n_leaves as bigint) as n_leaves, cast(b.saved_tokens as bigint) as saved_tokens, n.ends_sha256
from nodes n left join up u on u.d = n.d and u.key = n.key left join kids k on k.parent = n.key join under b on b.d = n.d and b.key = n.key
"""


def oracle_sql() -> dict:
    return {"op11_hard_negatives": OP11_SQL, "op13_prefix_trie": OP13_SQL, "op1_url_filters": OP1_SQL, "op2_quality_rules": OP2_SQL, "op5_warc": OP5_SQL, "op6_mixing": OP6_SQL}
