"""Conversations: messages, policy, keys, quotas, holdout, rendering, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.operators import conversations as cv
from siltworks.operators import dedup, segments, selection
from siltworks.runtime import table


def _raw(s, d) -> DataFrame:
    """Each delivered conversation once."""
    return table(s, d, "sft_results").dropDuplicates(["sample_id"]).select("sample_id", "source_id", "source_group", "category", "reasoning_mode", "messages")


def _policy(s, d) -> DataFrame:
    return cv.content_policy(_raw(s, d))


def _accepted(s, d) -> DataFrame:
    return _policy(s, d).where("reject is null").withColumn("category", F.coalesce("category", F.lit("none")))


def _messages(s, d):
    m = _raw(s, d).select("sample_id", cv.normalise_messages(F.col("messages")).alias("m"))
    return m.select("sample_id", F.coalesce(F.size("m"), F.lit(0)).alias("kept"), F.coalesce(cv.turns(F.col("m"), "user"), F.lit(0)).alias("user_turns"), F.coalesce(cv.is_multi_turn(F.col("m")), F.lit(False)).alias("multi_turn"))


def _policy_report(s, d):
    return _policy(s, d).select("sample_id", F.coalesce("reject", F.lit("accepted")).alias("outcome"), "dropped_system", "reasoning")


def _stripped(s, d):
    p = cv.content_policy(_raw(s, d), strip_reasoning=True)
    return p.select("sample_id", F.coalesce("reject", F.lit("accepted")).alias("outcome"), F.coalesce(cv.characters(F.col("policy_messages"), "assistant"), F.lit(0)).alias("assistant_chars"))


def _gates(s, d):
    return cv.char_gates(_accepted(s, d), 200, 1500, 20).select("sample_id", cv.characters(F.col("policy_messages")).alias("chars"))


def _content_dedup(s, d):
    return dedup.first_of_each(_accepted(s, d).withColumn("key", cv.content_key(F.col("policy_messages"), 3)), F.col("key"), "sample_id").select("sample_id", "key")


def _bottom_k(s, d):
    return selection.bottom_k(_accepted(s, d), "category", selection.order_key(42, F.col("source_group"), F.col("sample_id")), 25, "sample_id").select("category", "sample_id")


def _holdout(s, d):
    return selection.stratified_holdout(_accepted(s, d).select("sample_id", "category"), "category", 0.05, selection.order_key(7, F.col("sample_id")), "sample_id").select("sample_id", "category", "holdout")


def _retained(s, d):
    """Reasoning conversations are kept with probability 0.4, all others always."""
    a = _accepted(s, d)
    return a.where(~F.col("reasoning") | (selection.order_key(45, F.col("source_group"), F.col("sample_id")) < 0.4)).select("sample_id", "reasoning")


def _quota_members(s, d):
    quotas = _accepted(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("category")
    return _accepted(s, d).join(quotas, "category", "left_semi").select("sample_id", "category")


def _two_caps(s, d):
    a = _accepted(s, d).select("sample_id", "category", "source_group", selection.order_key(1, F.col("sample_id")).alias("k"))
    cats = {"en_general": 40, "en_math": 20, "zh_general": 40, "zh_math": 20}
    groups = {"hermitbox_en": 30, "openledger_en": 30, "taleschool_zh": 30, "reasonwell_zh": 30}
    return selection.greedy_two_caps(a, "k", "category", "source_group", cats, groups).select("sample_id", "category", "source_group")


def _rendered(s, d):
    a = _accepted(s, d).select("sample_id", cv.render(F.col("policy_messages")).alias("text"), cv.assistant_spans(F.col("policy_messages")).alias("spans"))
    return a.select("sample_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"), F.size("spans").alias("spans"), F.aggregate("spans", F.lit(0), lambda x, y: x + y["to"] - y["from"]).alias("trained_chars"))


def _masked(s, d):
    """Labels with one token per character: the trained ones are those inside an assistant span."""
    a = _accepted(s, d).select("sample_id", segments.encoded(cv.render(F.col("policy_messages"))).alias("ids"), cv.assistant_spans(F.col("policy_messages")).alias("spans"))
    a = a.select("sample_id", F.size("ids").alias("tokens"), F.explode(F.array(cv.labels_by_spans(F.col("ids"), F.col("spans")))).alias("labels"))
    return a.select("sample_id", "tokens", F.size(F.array_remove("labels", -100)).alias("loss_tokens"), F.aggregate("labels", F.lit(0).cast("long"), lambda x, y: x + y).alias("label_sum"))


def _report(s, d):
    a = _accepted(s, d).select("category", "source_group", "reasoning", cv.is_multi_turn(F.col("policy_messages")).alias("multi"), cv.characters(F.col("policy_messages")).alias("chars"))
    return a.groupingSets([[], [F.col("category")], [F.col("source_group")], [F.col("reasoning")]], "category", "source_group", "reasoning").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("chars").alias("chars"), F.sum(F.col("multi").cast("long")).alias("multi_turn"), F.round(F.avg(F.col("multi").cast("double")), 6).alias("multi_share")
    )


def _rejects(s, d):
    return _policy(s, d).where("reject is not null").groupBy("reject").agg(F.count(F.lit(1)).alias("samples"))


def _history(s, d):
    a = _accepted(s, d).select("sample_id", F.transform("policy_messages", lambda x: F.length(x["content"])).alias("sizes"))
    return a.select("sample_id", cv.fit_history(F.col("sizes"), 500).cast("int").alias("kept_turns"))


QUERIES = {
    "sft_messages": _messages,
    "sft_policy": _policy_report,
    "sft_policy_stripped": _stripped,
    "sft_rejects": _rejects,
    "sft_char_gates": _gates,
    "sft_content_dedup": _content_dedup,
    "sft_category_bottom_k": _bottom_k,
    "sft_holdout": _holdout,
    "sft_reasoning_retention": _retained,
    "sft_quota_members": _quota_members,
    "sft_two_caps": _two_caps,
    "sft_rendered": _rendered,
    "sft_label_mask": _masked,
    "sft_report": _report,
    "sft_history": _history,
}

_S = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[{_S}]+|[{_S}]+$', '', 'g')"


_ROLE = f"case lower({_strip_sql('m.role')}) when 'human' then 'user' when 'user' then 'user' when 'gpt' then 'assistant' when 'assistant' then 'assistant' when 'system' then 'system' when 'tool' then 'tool' end"
_BASE = f"""
raw as (select * from sft_results qualify row_number() over (partition by sample_id order by ingested_at) = 1),
msg as (select sample_id, i, {_ROLE} as role, coalesce({_strip_sql('m.content')}, '') as content from (select sample_id, generate_subscripts(messages, 1) as i, unnest(messages) as m from raw)),
tag as (select sample_id, i, role, case when role = 'assistant' then replace(replace(replace(replace(content, '<think>', '<|think|>'), '<|begin_of_thought|>', '<|think|>'), '</think>', '<|/think|>'), '<|end_of_thought|>', '<|/think|>') else content end as content from msg where role is not null),
kept as (select * from tag where role <> 'system'),
per as (select r.sample_id, r.source_group, coalesce(r.category, 'none') as category, coalesce(dropped, 0)::int as dropped_system, coalesce(reasoning, false) as reasoning,
        case when bad then 'malformed_reasoning' when hollow then 'empty_assistant' when users is not true or answers is not true then 'missing_role' end as reject
        from raw r left join (select sample_id, count(*) filter (role = 'system') as dropped from msg group by 1) using (sample_id)
        left join (select sample_id, bool_or(role = 'assistant' and contains(content, '<|think|>')) as reasoning,
            bool_or(role = 'assistant' and (length(content) - length(replace(content, '<|think|>', ''))) / 9 <> (length(content) - length(replace(content, '<|/think|>', ''))) / 10) as bad,
            bool_or(role = 'assistant' and content = '') as hollow, bool_or(role = 'user') as users, bool_or(role = 'assistant') as answers from kept group by 1) using (sample_id)),
ok as (select * from per where reject is null)"""
_U = "('0x' || substr(sha256({0}), 1, 16))::ubigint::double / 18446744073709551616::double"
_TEXT = "'<|im_start|>' || role || e'\\n' || content || e'<|im_end|>\\n'"

ORACLE: dict[str, str] = {
    "sft_messages": f"""with {_BASE}, m as (select sample_id, count(*) as kept, count(*) filter (role = 'user') as u, count(*) filter (role = 'assistant') as a from msg where role in ('user', 'assistant', 'system') and content <> '' group by 1)
select sample_id, case when u > 0 and a > 0 then kept else 0 end::int as kept, case when u > 0 and a > 0 then u else 0 end::int as user_turns, coalesce(u > 1 and a > 1, false) as multi_turn from raw left join m using (sample_id)""",
    "sft_policy": f"with {_BASE} select sample_id, coalesce(reject, 'accepted') as outcome, dropped_system, reasoning from per",
    "sft_policy_stripped": f"""with {_BASE},
s as (select sample_id, i, role, case when role = 'assistant' then regexp_replace({_strip_sql("regexp_replace(content, '(?s)<\\|think\\|>.*?<\\|/think\\|>', '', 'g')")}, e'\\n{{{{3,}}}}', e'\\n\\n', 'g') else content end as content from kept)
select r.sample_id, case when p.reject = 'malformed_reasoning' then p.reject when coalesce(bool_or(s.role = 'assistant' and s.content = ''), false) then 'empty_assistant' when p.reject = 'missing_role' then p.reject else 'accepted' end as outcome,
coalesce(sum(length(s.content)) filter (s.role = 'assistant'), 0)::int as assistant_chars from raw r join per p using (sample_id) left join s on s.sample_id = r.sample_id group by r.sample_id, p.reject""".replace("{{3,}}", "{3,}"),
    "sft_rejects": f"with {_BASE} select reject, count(*) as samples from per where reject is not null group by 1",
    "sft_char_gates": f"with {_BASE} select sample_id, sum(length(content))::int as chars from kept join ok using (sample_id) group by 1 having sum(length(content)) between 200 and 1500 and coalesce(sum(length(content)) filter (role = 'user'), 0) >= 20",
    "sft_content_dedup": f"""with {_BASE}, k as (select sample_id, sha256('3' || chr(0) || string_agg(role || chr(0) || content, chr(0) order by i)) as key from kept join ok using (sample_id) group by 1)
select min(sample_id) as sample_id, key from k group by key""",
    "sft_category_bottom_k": f"with {_BASE} select category, sample_id from ok qualify row_number() over (partition by category order by {_U.format("concat('42:', source_group, ':', sample_id)")}, sample_id) <= 25",
    "sft_holdout": f"""with {_BASE}, n as (select category, count(*) as n from ok group by 1)
select sample_id, category, n >= 2 and row_number() over (partition by category order by {_U.format("concat('7:', sample_id)")}, sample_id) <= least(greatest(round_even(n * 0.05, 0), 1), n - 1) as holdout from ok join n using (category)""",
    "sft_reasoning_retention": f"with {_BASE} select sample_id, reasoning from ok where not reasoning or {_U.format("concat('45:', source_group, ':', sample_id)")} < 0.4",
    "sft_quota_members": f"with {_BASE} select sample_id, category from ok where category in (select category from ok group by 1 having count(*) >= 20)",
    "sft_rendered": f"""with {_BASE} select sample_id, length(string_agg({_TEXT}, '' order by i))::int as chars, sha256(string_agg({_TEXT}, '' order by i)) as digest,
count(*) filter (role = 'assistant')::int as spans, sum(length(content) + 10) filter (role = 'assistant')::int as trained_chars from kept join ok using (sample_id) group by 1""",
    "sft_label_mask": f"""with {_BASE}, t as (select sample_id, sum(length({_TEXT})) as tokens, sum(length(content) + 10) filter (role = 'assistant') as loss_tokens,
sum(list_sum(list_transform(regexp_extract_all(content || '<|im_end|>', '(?s).'), lambda c: unicode(c)))) filter (role = 'assistant') as s from kept join ok using (sample_id) group by 1)
select sample_id, tokens::int as tokens, loss_tokens::int as loss_tokens, (s - 100 * (tokens - loss_tokens))::bigint as label_sum from t""",
    "sft_report": f"""with {_BASE}, a as (select category, source_group, reasoning, count(*) filter (role = 'user') > 1 and count(*) filter (role = 'assistant') > 1 as multi, sum(length(content)) as chars
from kept join ok using (sample_id) group by sample_id, category, source_group, reasoning)
select category, source_group, reasoning, count(*) as samples, sum(chars)::bigint as chars, sum(multi::int)::bigint as multi_turn, round(avg(multi::int), 6) as multi_share
from a group by grouping sets ((), (category), (source_group), (reasoning))""",
    "sft_history": f"""with {_BASE}, r as (select sample_id, i, sum(length(content)) over (partition by sample_id order by i desc rows between unbounded preceding and current row) as s from kept join ok using (sample_id))
select sample_id, greatest(count(*) filter (s <= 500), 1)::int as kept_turns from r group by 1""",
}

ORACLE |= {
    "sft_two_caps": f"""with recursive {_BASE}, c as (select sample_id, category, source_group, list_position(['en_general', 'en_math', 'zh_general', 'zh_math'], category) as ci,
list_position(['hermitbox_en', 'openledger_en', 'taleschool_zh', 'reasonwell_zh'], source_group) as gi, {_U.format("concat('1:', sample_id)")} as k from ok),
o as (select *, row_number() over (order by k) as i from c where ci > 0 and gi > 0),
f as (select 0::bigint as i, null::varchar as sample_id, null::varchar as category, null::varchar as source_group, false as taken, [40, 20, 40, 20] as caps, [30, 30, 30, 30] as groups
  union all select o.i, o.sample_id, o.category, o.source_group, f.caps[o.ci] > 0 and f.groups[o.gi] > 0,
  case when f.caps[o.ci] > 0 and f.groups[o.gi] > 0 then [f.caps[1] - (o.ci = 1)::int, f.caps[2] - (o.ci = 2)::int, f.caps[3] - (o.ci = 3)::int, f.caps[4] - (o.ci = 4)::int] else f.caps end,
  case when f.caps[o.ci] > 0 and f.groups[o.gi] > 0 then [f.groups[1] - (o.gi = 1)::int, f.groups[2] - (o.gi = 2)::int, f.groups[3] - (o.gi = 3)::int, f.groups[4] - (o.gi = 4)::int] else f.groups end
  from f join o on o.i = f.i + 1)
select sample_id, category, source_group from f where taken""",
}
