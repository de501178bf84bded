"""SQL that must give the same rows as the queries of this subpackage."""

from __future__ import annotations

_PLAN = """
w as (select config_id, lower(trim(name, e' \\t\\n\\r')) as name, max(weight_gb) as weight_gb from sampling_sources
      where weight_gb > 0 and not isnan(weight_gb) and trim(name, e' \\t\\n\\r') <> '' group by 1, 2),
plan as (select w.*, t.weight_sum, c.target_total_gb * 1e9::double * w.weight_gb / t.weight_sum as target_bytes, c.seed, c.min_chars, c.max_chars, c.max_repeats
         from w join (select config_id, sum(weight_gb) as weight_sum from w group by 1) t using (config_id) join sampling_configs c using (config_id)),
sized as (select doc_id, source as name, length(text) as chars, strlen(text) as bytes from documents where text is not null),
have as (select p.config_id, p.name, sum(bytes)::bigint as available_bytes from plan p join sized s on s.name = p.name and chars between min_chars and max_chars group by 1, 2),
rates as (select p.*, coalesce(available_bytes, 0) as available_bytes,
                 case when coalesce(available_bytes, 0) > 0 then least(target_bytes / available_bytes, max_repeats::double) else 0.0::double end as rate
          from plan p left join have using (config_id, name)),
mixed as (select * from (
            select r.config_id, r.name, doc_id, bytes::bigint as bytes,
                   (floor(rate)::int + case when ('0x' || substr(sha256(concat(seed, ':', r.config_id, ':', doc_id)), 1, 16))::ubigint::double / 18446744073709551616::double < rate - floor(rate) then 1 else 0 end)::int as copies
            from rates r join sized s on s.name = r.name and chars between min_chars and max_chars where rate > 0) where copies > 0)"""

_GROUPS = """
ids as (select doc_id from documents union select doc_id from canonical_documents),
e as (select distinct canonical_id as a, duplicate_id as b from duplicate_edges
      where lower(trim(reason, e' \\t\\n\\r')) in ('exact', 'near') and canonical_id <> duplicate_id
        and canonical_id in (from ids) and duplicate_id in (from ids)),
both_ways as (select a, b from e union select b, a from e),
reach as (select a as v, a as r from both_ways union select b, r from reach join both_ways on a = v),
groups as (select v as doc_id, min(r) as group_id from reach group by 1)"""

_SPLIT = """case lower(trim(split, e' \\t\\n\\r')) when 'train' then 1 when 'training' then 1 when 'trn' then 1 when 'tr' then 1 when 'validation' then 2 when 'valid' then 2 when 'val' then 2 when 'dev' then 2
  when 'diagnostic' then 4 when 'diagnostics' then 4 when 'diag' then 4 else 0 end"""

ORACLE: dict[str, str] = {
    "p1_torn": f"""with recursive keyed as (select doc_id, 'c' || nullif(lower(trim(cluster_id, e' \\t\\n\\r')), '') as c, case when trim(parent_document_id, e' \\t\\n\\r') <> '' then 'p' || parent_document_id end as p, {_SPLIT} as bit from documents),
ties as (select distinct c as a, p as b from keyed where c is not null and p is not null), both_ways as (select a, b from ties union select b, a from ties),
reach as (select a as v, a as r from both_ways union select b, r from reach join both_ways on a = v), top as (select v, min(r) as r from reach group by 1),
of_doc as (select k.*, coalesce(t.r, k.c, k.p, 'r' || doc_id) as component from keyed k left join top t on t.v = coalesce(k.c, k.p)),
per as (select component, c, count(*) as n, bit_or(bit) as bits from of_doc group by 1, 2),
comp as (select component, count(c) as clusters, sum(n) as n, bit_or(bits) as bits, max(case when c is not null then bit_count(bits) else 0 end) as worst from per group by 1)
select count(*) as components, coalesce(sum(clusters), 0)::bigint as clusters, coalesce(sum(n), 0)::bigint as records, count(*) filter (worst < 2) as torn_only_by_links from comp where bit_count(bits) >= 2""",
    "p1_found": r"""
select lower(trim(cluster_id, e' \t\n\r')) as cluster_id from (select cluster_id, case lower(trim(split, e' \t\n\r')) when 'train' then 1 when 'training' then 1 when 'trn' then 1
  when 'tr' then 1 when 'validation' then 2 when 'valid' then 2 when 'val' then 2 when 'dev' then 2 when 'diagnostic' then 3 when 'diagnostics' then 3 when 'diag' then 3 end as s from documents)
where trim(cluster_id, e' \t\n\r') <> '' group by 1 having count(distinct s) >= 2""",
    "p2_found": r"""
select doc_id from documents where regexp_matches(text, '[^\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}]')
and (raw_tokens is null or cleaned_tokens is null or raw_tokens <= 0 or cleaned_tokens < 0 or cleaned_tokens > raw_tokens
     or raw_tokens > strlen(text) or raw_tokens * 40 < length(text))""",
    "p3_found": r"""
select doc_id, case when list_max(list_transform(regexp_split_to_array(text, '[\n.!?。！？]'), lambda x: length(x))) > 6000 then 1 else 0 end::int as forced
from documents where length(text) > 6000""",
    "p7_found": f"with recursive {_GROUPS} select doc_id, group_id from groups",
    "p7_regroup": f"""with recursive {_GROUPS}
select d.doc_id, coalesce(g.group_id, d.doc_id) as group_id, g.group_id is not null as linked,
       nullif(lower(trim(d.cluster_id, e' \\t\\n\\r')), '') as recorded_cluster from documents d left join groups g using (doc_id)""",
    "p5_found": f"with {_PLAN} select config_id, name from rates where available_bytes * max_repeats < target_bytes",
    "p5_mix": f"with {_PLAN} select config_id, name, doc_id, bytes, copies from mixed",
    "p5_shares": f"""with {_PLAN},
got as (select config_id, name, sum(bytes * copies)::bigint as mixed_bytes, sum(copies)::bigint as mixed_records from mixed group by 1, 2)
select r.config_id, r.name, round(weight_gb / weight_sum, 9) as target_share, round(rate, 6) as rate, coalesce(mixed_records, 0)::bigint as mixed_records,
       coalesce(mixed_bytes, 0)::bigint as mixed_bytes, round(coalesce(mixed_bytes / sum(mixed_bytes) over (partition by r.config_id), 0.0), 9) as actual_share
from rates r left join got using (config_id, name)""",
}

_NORM = r"trim(regexp_replace(lower(text), '[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ')"
_SIDES = f"m as (select doc_id, {_SPLIT} as bit, parent_document_id as parent, {_NORM} as norm from documents)"

ORACLE |= {
    "p6_members": f"with {_SIDES} select doc_id, md5(norm) as text_class, case bit when 1 then 'train' when 2 then 'validation' else 'diagnostic' end as split_key from m where bit > 0 and length(norm) >= 60",
    "p6_found": f"""with {_SIDES},
g as materialized (select distinct doc_id, bit, substr(norm, i::int, 13) as gram from (select doc_id, bit, norm, unnest(range(1, length(norm) - 11)) as i from m where bit > 0 and length(norm) >= 60)),
n as (select doc_id, count(*) as n from g group by 1), c as (select a.doc_id as e, b.doc_id as t, count(*) as common from g a join g b using (gram) where a.bit > 1 and b.bit = 1 group by 1, 2),
p as (select e, t from c join n x on x.doc_id = e join n y on y.doc_id = t where common * 5 >= 4 * (x.n + y.n - common)
  union select a.doc_id, b.doc_id from m a join m b using (parent) where a.bit > 1 and b.bit = 1 and trim(parent, e' \\t\\n\\r') <> '')
select least(e, t) as doc_a, greatest(e, t) as doc_b from p""",
}
