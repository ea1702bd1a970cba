"""Queries of the operators over the whole test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tradewright.llm import ann, bpe, conversations, mixing, phrases, quality, secrets, simhash, suffix_dedup, token_counts, topk, toxicity, warc
from tradewright.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.report(table(spark, sf_dir, "documents"))


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_byte_bpe, op3_warc, op4_exact_top_k, op5_token_counts, op6_suffix_array_dedup, op7_simhash, op8_nearest_neighbours, op9_toxicity, op10_mixing, op11_phrases, op12_secret_scans, op13_conversation_repair)}

OP3 = """
with p as (select page_id, sha1(coalesce(html, '')) payload_digest, octet_length(encode(coalesce(html, '')))::bigint payload_bytes from pages),
r as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end last from p)
select page_id, payload_bytes, payload_digest, case when last is not null and page_id is distinct from last then 'revisit' else 'response' end record_type,
    case when page_id is distinct from last then last end refers_to from r
"""

OP4 = """
with v as (select vec_id, min(embedding) e from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id),
w as (select vec_id, list_transform(e, lambda x: floor(256 * x::double)) e from v),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint score from w q join w c on q.vec_id <> c.vec_id
    and len(q.e) = len(c.e) where q.vec_id % 50 = 0)
select query_id, rank::int rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 5
"""


def _mixing_sql(shards: int = 16, blocks: int = 4096, seed: int = 10) -> str:
    tree = ""
    levels = shards.bit_length() - 1
    for i in range(levels):
        tree += f""",
    t{i + 1} as (select skey, block, shard * 2 + (case when row_number() over (partition by shard order by md5('{seed}-{i}|' || skey || '|' || block), skey, block)
        > count(*) over (partition by shard) // 2 then 1 else 0 end) shard from t{i})"""
    return rf"""
    with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
        coalesce('s' || source, 'n') skey, md5(coalesce(doc_id::varchar, '')) draw from documents),
    s0 as (select skey, any_value(source) source, sum(size)::bigint source_size from d group by skey),
    s1 as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double weight, 2.0::double * source_size most from s0),
    s2 as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(most) over (order by most / weight, source nulls last
            rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by most / weight, source nulls last
            rows between current row and unbounded following) as lev from s1),
    s3 as (select coalesce((select lev from s2 where lev * weight <= most order by most / weight, source nulls last limit 1), 'infinity'::double) lev),
    s as (select skey, source_size, least(most, s3.lev * weight) target from s2, s3),
    w as (select greatest(sum(target) / {blocks}, 1.0) bw from s),
    t0 as (select skey, unnest(range(0, floor(target / bw)::bigint + 1)) block, 0 shard from s, w where target > 0){tree},
    p as (select d.doc_id, d.size, d.skey, s.source_size, s.target, w.bw, coalesce(sum(d.size) over (partition by d.skey order by d.draw, d.doc_id
        rows between unbounded preceding and 1 preceding), 0)::bigint a from d join s using (skey), w),
    c as (select *, case when size > 0 then a + size / 2 <= target else true end x1,
        case when size > 0 then a + source_size + size / 2 <= target else false end x2 from p),
    b as (select *, floor(least(a, target) / bw)::bigint b1, floor(least(a + source_size, target) / bw)::bigint b2 from c)
    select b.doc_id, size, source_size, target, (size * (x1::int + x2::int))::bigint taken,
        case when x1 then coalesce(u.shard, 0) end::int shard_1, case when x2 then coalesce(v.shard, 0) end::int shard_2
    from b left join t{levels} u on u.skey = b.skey and u.block = b1 left join t{levels} v on v.skey = b.skey and v.block = b2
    """


def _secrets_sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    found = " union all ".join(
        f"""select rid, {i} as nr, '{r.kind}' kind, unnest(range(1, len(h) + 1)) i, unnest(list_transform(h, lambda x: length(x))) len, unnest(list_transform(s[:len(h)], lambda x: length(x))) gap,
        unnest(list_transform(g, lambda x: length(x))) measured, {r.least} least from (select rid, regexp_extract_all(t, {quoted(r.pattern)}) h,
        regexp_split_to_array(t, {quoted(r.pattern)}) s, regexp_extract_all(t, {quoted(r.pattern)}, {r.measured}) g from d)""" for i, r in enumerate(secrets.RULES))
    n = len(secrets.BASE)
    counts = ", ".join(f"count(*) filter (where kind = '{r.kind}') n_{r.kind}" for r in secrets.BASE)
    return f"""
    with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
    m as ({found}),
    p as (select *, (sum(gap + len) over (partition by rid, nr order by i))::bigint stop from m),
    f as (select rid, nr, kind, stop - len as first, kind || ':' || (stop - len) || ':' || stop span from p where measured >= least),
    a as (select rid, {counts}, coalesce(string_agg(span, ',' order by first, nr) filter (where nr < {n}), '') base, string_agg(span, ',' order by first, nr) spans from f group by rid)
    select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
    from d left join a using (rid)"""


OP11 = r"""
with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from p),
s as (select lang, sum(len(ws))::bigint n from w group by lang),
g as (select lang, ws, unnest(range(1, len(ws) + 1)) i from w),
f as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') phrase, count(*)::hugeint a from g, (select unnest([1, 2, 3, 4]) k) where i + k - 1 <= len(ws) group by all having count(*) >= 30),
c as (select lang, k, phrase, a, string_split(phrase, ' ') ws from f where k > 1),
x as (select lang, phrase, ws, a, unnest(range(1, k)) cutting, k from c),
y as (select x.lang, x.phrase, x.a, x.cutting, l.a l, r.a r, 2000000 * x.a // (l.a + r.a) score from x join f l on l.lang = x.lang and l.phrase = array_to_string(ws[1:cutting], ' ')
    join f r on r.lang = x.lang and r.phrase = array_to_string(ws[cutting + 1:x.k], ' ')),
z as (select lang, phrase, a, min({'score': score, 'cutting': cutting, 'l': l, 'r': r}) m from y group by all),
h as (select lang, a, k, ws, unnest(range(1, k + 1)) i from c where k > 2),
e as (select lang, array_to_string(ws[i:i + size - 1], ' ') phrase, max(a) longer from h, (select unnest([2, 3]) size) where size < k and i + size - 1 <= k group by all),
v as (select z.* from z left join e using (lang, phrase) where longer is null or 100 * longer < 80 * a),
o as (select *, row_number() over (partition by lang order by m.score desc, a desc, phrase) pos from v)
select lang, pos::bigint rank, phrase, a::bigint a, m.l::bigint l, m.r::bigint r, n, m.score::bigint score from o join s using (lang) where pos <= 2000
"""


SQL = {"op3_warc": OP3, "op4_exact_top_k": OP4, "op10_mixing": _mixing_sql(), "op11_phrases": OP11, "op12_secret_scans": _secrets_sql()}
