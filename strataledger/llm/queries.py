"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataledger.llm.subword_classifier import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataledger.llm.mixing import mix_documents

    return mix_documents(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataledger.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataledger.llm.subword_classifier import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataledger.llm.token_files import token_index

    return token_index(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataledger.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataledger.llm.top_k import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataledger.llm.language_model import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataledger.llm.warc import read_records, record_index, write_archive

    return record_index(read_records(spark, write_archive(_table(spark, sf_dir, "pages"))))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataledger.llm.decontamination import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataledger.llm.merkle import verify_documents

    return verify_documents(_table(spark, sf_dir, "documents"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataledger.llm.near_vectors import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataledger.llm.fill_in_middle import digests

    return digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_token_files": op5_token_files,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_top_k": op7_top_k,
    "op8_language_model": op8_language_model,
    "op9_warc": op9_warc,
    "op10_decontamination": op10_decontamination,
    "op11_merkle": op11_merkle,
    "op12_near_vectors": op12_near_vectors,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, '') || 'mix-1' || coalesce(md5(text), '')) as k
  from documents
), sources as (
  select source, sum(size)::bigint as source_size from sized group by source
), ranked as (
  select source, source_size, (source_size * 2)::double as cap,
    ([5.0::double, 2.0, 1.0])[((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as w,
    (sum(source_size) over ())::double * 1.5::double as total
  from sources
), levels as (
  select *, cap / w as filled,
    (total - coalesce(sum(cap) over (order by cap / w, source rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by cap / w, source rows between current row and unbounded following) as lev
  from ranked
), chosen as (
  select *, (select arg_min(lev, (filled, source)) from levels where lev <= filled) as c from levels
), targets as (
  select source, source_size, coalesce(case when filled <= c then cap else w * c end, cap) as target from chosen
), placed as (
  select s.doc_id, s.size, t.source_size, t.target,
    case when t.source_size > 0 then floor(floor(t.target) / t.source_size) else 0 end as epochs,
    coalesce(sum(s.size) over (partition by s.source order by s.k, s.size
      rows between unbounded preceding and 1 preceding), 0) as ahead
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - ahead)))::bigint as taken
from placed
""",
    "op7_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)
), r as (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 20
""",
    "op9_warc": """
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as n from pages
), g as (select html, max(page_id) as first_id from p group by html)
select p.page_id, p.n as payload_bytes, sha1(p.html) as payload_digest,
  case when p.n >= 1000 and p.page_id is distinct from g.first_id then 'revisit' else 'response' end as record_type,
  case when p.n >= 1000 and p.page_id is distinct from g.first_id then g.first_id end as refers_to
from p join g on p.html = g.html
""",
    "op10_decontamination": f"""
with d as (select doc_id, row_number() over () as r, coalesce({_WORDS}, []) as w from documents),
b as (select item_id, coalesce({_WORDS}, []) as w from benchmark),
bw as (
  select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') as win
  from (select item_id, w, m, unnest(range(1, len(w) - m + 2)) as i
        from (select item_id, w, least(10, len(w)) as m from b where len(w) > 0))
), lens as (select distinct m from bw),
dw as (
  select r, m, i, array_to_string(w[i:i + m - 1], ' ') as win
  from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i from d, lens where len(w) >= m)
), hits as (select dw.r, dw.i, dw.m, bw.item_id from dw join bw on dw.m = bw.m and dw.win = bw.win),
n as (select r, count(distinct pos)::bigint as n_hit from (select r, unnest(range(i, i + m)) as pos from hits) group by r),
s as (
  select r, count(*)::bigint as n_items, string_agg(x, ',' order by x) as names
  from (select distinct r, item_id::varchar as x from hits where item_id is not null) group by r
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n.n_hit, 0)::bigint as n_hit,
  coalesce(s.n_items, 0)::bigint as n_items, sha256(coalesce(s.names, '')) as items_sha256,
  coalesce(n.n_hit, 0) > 0 as contaminated
from d left join n using (r) left join s using (r)
""",
}

_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

ORACLE_SQL["op11_merkle"] = f"""
with recursive d as (
  select doc_id, coalesce('=' || lang, '-') as grp, {_LEAF} as head, text, doc_id::varchar as t from documents
), crc as (  -- CRC-32 of the decimal id, a bit at a time
  select t, 4294967295::ubigint as c, 0 as k from (select distinct t from d where t is not null)
  union all
  select t, case when k % 9 = 0 then xor(c, ascii(t[k // 9 + 1])::ubigint)
                 when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end, k + 1
  from crc where k < 9 * len(t)
), shown as (
  select t, xor(c, 4294967295::ubigint) % 3 = 0 as tampered from crc where k = 9 * len(t)
), hashed as (
  select doc_id, grp, sha256(head || {_FIELD.format("text")}) as leaf,
    sha256(head || case when tampered
      then coalesce(strlen(text)::varchar || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')
      else {_FIELD.format("text")} end) as shown
  from d left join shown using (t)
), leaves as (
  select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as place,
    count(*) over (partition by grp) as n from hashed
), nodes as (
  select grp, place, n, leaf as node, 0 as lvl from leaves
  union all
  select grp, place // 8, max((n + 7) // 8), sha256(string_agg(node, '' order by place)), max(lvl) + 1
  from nodes where n > 1 group by grp, place // 8
), subroots as (
  select grp, node as subroot, row_number() over (order by grp) - 1 as place, count(*) over () as n from nodes where n = 1
), tops as (
  select place, n, subroot as node, 0 as lvl from subroots
  union all
  select place // 8, max((n + 7) // 8), sha256(string_agg(node, '' order by place)), max(lvl) + 1
  from tops where n > 1 group by place // 8
), lower_steps as (
  select a.grp, a.place, a.lvl, coalesce(string_agg(b.node, '' order by b.place) filter (b.place < a.place), '') as l,
    coalesce(string_agg(b.node, '' order by b.place) filter (b.place > a.place), '') as r
  from nodes a join nodes b on a.grp = b.grp and a.lvl = b.lvl and a.place // 8 = b.place // 8
  where a.n > 1 group by a.grp, a.place, a.lvl
), upper_steps as (
  select a.place, a.lvl, coalesce(string_agg(b.node, '' order by b.place) filter (b.place < a.place), '') as l,
    coalesce(string_agg(b.node, '' order by b.place) filter (b.place > a.place), '') as r
  from tops a join tops b on a.lvl = b.lvl and a.place // 8 = b.place // 8
  where a.n > 1 group by a.place, a.lvl
), low as (
  select grp, place as id, place, 0 as lvl, shown as node, '' as proof from leaves
  union all
  select f.grp, f.id, f.place // 8, f.lvl + 1, sha256(s.l || f.node || s.r), f.proof || s.l || s.r
  from low f join lower_steps s on f.grp = s.grp and f.place = s.place and f.lvl = s.lvl
), high as (
  select f.grp, f.id, s.subroot, s.place, 0 as lvl, f.node, f.proof
  from (select *, max(lvl) over (partition by grp, id) as last from low) f join subroots s on f.grp = s.grp
  where f.lvl = f.last
  union all
  select f.grp, f.id, f.subroot, f.place // 8, f.lvl + 1, sha256(s.l || f.node || s.r), f.proof || s.l || s.r
  from high f join upper_steps s on f.place = s.place and f.lvl = s.lvl
), folded as (
  select * from (select *, max(lvl) over (partition by grp, id) as last from high) where lvl = last
), top as (select node as root from tops where n = 1)
select l.doc_id, l.leaf, f.subroot, top.root, sha256(f.proof) as proof_sha256, f.node as folded_root, f.node = top.root as verified
from leaves l join folded f on l.grp = f.grp and l.place = f.id cross join top
"""

ORACLE_SQL["op12_near_vectors"] = """
with recursive v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: x::double) as e,
    coalesce(len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as sound
  from embeddings
), links as (
  select a.r, b.r as s, a.vec_id as a_id, b.vec_id as b_id
  from (from v where sound) a join (from v where sound) b on a.r <> b.r and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95
), reach as (
  select r, s, b_id from links
  union
  select reach.r, links.s, links.b_id from reach join links on reach.s = links.r
), first as (select r, min(b_id) as least from reach group by r),
n as (select r, count(*) as n_links from links group by r)
select vec_id, coalesce(n_links, 0)::bigint as n_links, least(vec_id, first.least) as component_id,
  vec_id is not distinct from least(vec_id, first.least) as kept
from v left join n using (r) left join first using (r)
"""

ORACLE_SQL["op13_fill_in_middle"] = """
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as w,
    sha256('1:' || coalesce(doc_id::varchar, '')) as h
  from documents
), drawn as (
  select *, len(w) as n, ('0x' || h[1:8])::bigint % (len(w) + 1) as a, ('0x' || h[9:16])::bigint % (len(w) + 1) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
        or ('0x' || h[17:24])::bigint % 100 >= 90 then 'plain'
      when ('0x' || h[25:32])::bigint % 100 < 20 then 'spm' else 'psm' end as form
  from t
), cut as (
  select *, coalesce(array_to_string(w[1:least(a, b)], ''), '') as p,
    coalesce(array_to_string(w[least(a, b) + 1:greatest(a, b)], ''), '') as m,
    coalesce(array_to_string(w[greatest(a, b) + 1:], ''), '') as s
  from drawn
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then len(p) end as prefix_chars,
  case when form <> 'plain' then len(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from cut
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
