"""Datasets on disk, typed samples and their batches, adapters, budgets: each query writes or builds what it names and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.config import Preparation, Windows
from siltworks.functions.text import fold_name
from siltworks.operators import adapters, sampling, schema, segments, selection, tasks
from siltworks.operators import conversations as cv
from siltworks.plans import prepare
from siltworks.plans.corpus import _CLEAN, _SPLITS, _WINDOWS, LEAST, OVERLAP, SIZE, _U, _windows_sql, accepted
from siltworks.plans.dialogue import _BASE, _TEXT, _accepted, _raw
from siltworks.runtime import shared_dir, table
from siltworks.sources import readers, sinks

GATES = (20, 1500, 3000)  # tokens of all answers, of one answer, of a conversation
QUOTAS = {"en_general": 100, "zh_general": 100, "en_math": 5, "none": 1, "absent": 10}
PROMPT, ANSWER, BATCH = 512, 512, 8


def _place(s, name: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _prepared_datasets(s, d) -> DataFrame:
    """Runs the whole preparation, then sums up what the written datasets hold."""
    folder = _place(s, "datasets")
    out = prepare.prepare(s, table(s, d, "documents"), folder, "corpus", "1", Preparation(windows=Windows(SIZE, OVERLAP, LEAST)))
    parts = None
    for split in out["splits"]:
        rows = schema.from_storage(sinks.read_dataset(s, f"{folder}/{split}"), "doc_id long, loss_tokens int").withColumn("split", F.lit(split))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.groupBy("split").agg(
        F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("samples"), F.sum(F.size("input_ids")).alias("input_tokens"),
        F.sum(F.size(F.filter("labels", lambda x: x != segments.IGNORE))).alias("loss_tokens"), F.sum("loss_tokens").alias("recorded_loss_tokens"),
    )


def _line_round_trip(s, d) -> DataFrame:
    folder = _place(s, "lines")
    sinks.write_lines(table(s, d, "documents").select("doc_id", "text", "source"), folder)
    return readers.read_json_lines(s, [folder], "doc_id long, text string, source string").select("doc_id", "source", F.sha2("text", 256).alias("digest"))


def _document_samples(s, d) -> DataFrame:
    docs = table(s, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("sample_id"), F.lit("corpus").alias("dataset_id"), F.col("source_name").alias("source_id"), F.col("parent_document_id").alias("document_id"), "text", "n_chars", "source_priority")


def _storage_round_trip(s, d) -> DataFrame:
    stored = schema.to_storage(_document_samples(s, d), "document")
    return schema.from_storage(stored, "document_id string, text string, n_chars long, source_priority int").select("sample_id", "source_id", "document_id", F.sha2("text", 256).alias("digest"), "n_chars", "source_priority")


def _first_turns(s, d) -> DataFrame:
    """First question and first answer of every accepted conversation, numbered in the order of their ids."""
    first = lambda role: F.get(F.filter("policy_messages", lambda x: x["role"] == role), F.lit(0))
    a = _accepted(s, d).select("sample_id", F.array(first("user")).alias("prompt_messages"), first("assistant")["content"].alias("answer"))
    return segments.batches(a, "sample_id", BATCH)


def _total(c: str):
    return F.aggregate(F.flatten(c), F.lit(0).cast("long"), lambda a, x: a + x)


def _preference(s, d) -> DataFrame:
    p = _first_turns(s, d).select("batch", "place", F.col("sample_id").alias("pair_id"), "prompt_messages", F.col("answer").alias("chosen"), F.concat(F.lit("no "), "answer").alias("rejected"), F.lit(1).alias("preference_label"))
    b = tasks.preference_batch(tasks.preference(p, ANSWER), "batch", "place")
    return b.select("batch", F.size("pair_id").alias("pairs"), F.size(F.get("chosen_ids", F.lit(0))).alias("width"), _total("chosen_ids").alias("chosen_sum"), _total("rejected_ids").alias("rejected_sum"), F.size(F.filter(F.flatten("chosen_labels"), lambda x: x != -100)).alias("chosen_loss"))


def _reward(s, d) -> DataFrame:
    p = _first_turns(s, d).select("batch", "place", "prompt_messages", F.col("answer").alias("response"), (F.length("answer") / 100).alias("reward_label"), F.when(F.length("answer") % 2 == 0, F.col("place")).alias("ranking_label"))
    b = tasks.reward_batch(tasks.reward(p, ANSWER), "batch", "place")
    return b.select("batch", F.size(F.get("input_ids", F.lit(0))).alias("width"), _total("input_ids").alias("id_sum"), F.round(F.aggregate("reward_label", F.lit(0.0), lambda a, x: a + x), 6).alias("rewards"), F.size(F.filter("ranking_label", lambda x: x == -1)).alias("unranked"))


def _trajectory(s, d) -> DataFrame:
    p = _first_turns(s, d).select("batch", "place", "sample_id", "prompt_messages", F.col("answer").alias("response"), F.array_repeat(F.lit(0.5), F.least(F.length("answer") + 1, F.lit(ANSWER))).alias("rewards"))
    b = tasks.trajectory_batch(tasks.trajectory(p, ANSWER), "batch", "place")
    return b.select("batch", F.size("sample_id").alias("samples"), F.size(F.get("rewards", F.lit(0))).alias("longest_response"), _total("response_mask").alias("response_tokens"), F.aggregate(F.flatten("rewards"), F.lit(0.0), lambda a, x: a + x).alias("rewards"))


def _sft_batches(s, d) -> DataFrame:
    a = segments.batches(_accepted(s, d).select("sample_id", F.col("policy_messages").alias("messages")), "sample_id", BATCH)
    b = tasks.sft_batch(tasks.sft(a, 1 << 30), "batch", "place", multiple=8)
    return b.select("batch", F.size("sample_id").alias("samples"), F.size(F.get("input_ids", F.lit(0))).alias("width"), _total("attention_mask").alias("tokens"), _total("loss_mask").alias("loss_tokens"))


def _token_gates(s, d) -> DataFrame:
    return cv.token_gates(_accepted(s, d), *GATES, segments.code_points)


def _sampling_counters(s, d) -> DataFrame:
    p = table(s, d, "documents").where("text is not null").select("doc_id", "source", F.octet_length("text").cast("long").alias("bytes"), F.length("text").alias("chars"))
    targets = p.groupBy("source").agg((F.sum("bytes") * 0.25).alias("target"))
    return sampling.sampling_counters(p, "source", "bytes", "chars", 60, 6000, targets, 7, validation=0.1)


def _step_budget(s, d) -> DataFrame:
    w = segments.sliding_windows(accepted(s, d).select("doc_id", "n"), "n", SIZE, OVERLAP, LEAST)
    samples, tokens = w.agg(F.count(F.lit(1)), F.sum("input_tokens")).first()
    b = selection.step_budget(samples, tokens, 4, 2, 2, target_tokens=1_000_000)
    return s.createDataFrame([(b["steps"], b["samples_per_step"], round(b["mean_tokens"], 6))], "steps long, samples_per_step long, mean_tokens double")


def _source_differences(s, d) -> DataFrame:
    """Sources that a plan names and the corpus lacks, and the other way round."""
    return sinks.differing_keys(table(s, d, "sampling_sources").select(fold_name(F.col("name")).alias("source")), table(s, d, "documents").select("source"), "source")


def _numbered(s, d) -> DataFrame:
    return segments.global_rank(_raw(s, d).select("sample_id", "messages"), "sample_id").withColumnRenamed("rank", "ordinal")


def _adapted(s, d) -> DataFrame:
    """Conversations through the text of a foreign format and back by its adapter."""
    text = F.to_json(F.transform("messages", lambda x: F.struct(x["role"].alias("from"), x["content"].alias("value"))))
    raw = _numbered(s, d).select("ordinal", text.alias("conversations"))
    a = adapters.conversations(raw, "foreign", "group", lambda m: F.lit("general"))
    return a.select("sample_id", F.size("messages").alias("messages"), F.aggregate("messages", F.lit(0), lambda n, x: n + F.length(x["content"])).alias("chars"))


def _instructions(s, d) -> DataFrame:
    turns = _first_turns(s, d).withColumn("ordinal", F.col("batch") * BATCH + F.col("place"))
    raw = turns.select("ordinal", F.get("prompt_messages", F.lit(0))["content"].alias("instruction"), F.when(F.col("place") % 2 == 0, F.lit(" more ")).alias("input"), F.col("answer").alias("output"), F.col("place").alias("score"))
    a = adapters.instruction(raw, "plain", "group", F.lit("general"), least_score=2)
    return a.select("sample_id", F.length(F.get("messages", F.lit(0))["content"]).alias("asked"), F.length(F.get("messages", F.lit(1))["content"]).alias("answered"))


def _transcripts(s, d) -> DataFrame:
    turns = _first_turns(s, d).withColumn("ordinal", F.col("batch") * BATCH + F.col("place"))
    text = F.concat(F.lit("[Human]: "), F.get("prompt_messages", F.lit(0))["content"], F.lit("<eoh> [MOSS]: "), "answer", F.lit("<eoa>"))
    a = adapters.tagged_transcript(turns.select("ordinal", text.alias("plain_text")), "tagged", "group", F.lit("general"))
    return a.select("sample_id", F.size("messages").alias("messages"), F.length(F.get("messages", F.lit(1))["content"]).alias("answered"))


def _boundaries(s, d) -> DataFrame:
    """Changes of document between neighbouring tokens of each micro-batch."""
    b = segments.batches(accepted(s, d).select("doc_id", "n"), "doc_id", 8).where("n > 0")
    return b.groupBy("batch").agg((F.count(F.lit(1)) - 1).alias("boundaries"), F.sum("n").alias("tokens"))


def _shards(s, d) -> DataFrame:
    r = segments.global_rank(accepted(s, d).select("doc_id"), "doc_id")
    return r.groupBy(sinks.shard_number(F.col("rank") - 1, 100).alias("shard")).agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


QUERIES = {
    "prepared_datasets": _prepared_datasets,
    "line_round_trip": _line_round_trip,
    "storage_round_trip": _storage_round_trip,
    "document_problems": lambda s, d: schema.problems(_document_samples(s, d), "document"),
    "preference_batches": _preference,
    "reward_batches": _reward,
    "trajectory_batches": _trajectory,
    "sft_batches": _sft_batches,
    "sft_token_gates": lambda s, d: _token_gates(s, d).select("sample_id", "assistant_tokens", "sequence_tokens", "token_reject"),
    "sft_token_report": lambda s, d: cv.token_report(_token_gates(s, d).where("token_reject is null"), QUOTAS),
    "sampling_counters": _sampling_counters,
    "step_budget": _step_budget,
    "source_differences": _source_differences,
    "adapted_conversations": _adapted,
    "adapted_instructions": _instructions,
    "adapted_transcripts": _transcripts,
    "document_boundaries": _boundaries,
    "shard_numbers": _shards,
}

_ORD = lambda text: f"coalesce(list_sum(list_transform(regexp_extract_all({text}, '(?s).'), lambda c: unicode(c))), 0)"
_TURNS = f"""with {_BASE}, f as (select sample_id, min_by(content, i) filter (role = 'user') as prompt, min_by(content, i) filter (role = 'assistant') as answer from kept join ok using (sample_id) group by 1),
o as (select *, row_number() over (order by sample_id) - 1 as r, e'<|im_start|>user\\n' || prompt || e'<|im_end|>\\n<|im_start|>assistant\\n' as shown from f),
t as (select *, r // {BATCH} as batch, r % {BATCH} as place, least(length(shown), {PROMPT}) as p_n, {_ORD(f"right(shown, {PROMPT})")} as p_sum, least(length(answer) + 1, {ANSWER}) as a_n,
  {_ORD(f"left(answer, {ANSWER})")} + case when length(answer) < {ANSWER} then 2 else 0 end as a_sum from o)"""
_TOKENS = f"""with {_BASE}, g as (select sample_id, any_value(category) as category, coalesce(sum(length(content)) filter (role = 'assistant'), 0)::int as assistant_tokens, max(length(content)) filter (role = 'assistant') as longest, sum(length({_TEXT}))::int as sequence_tokens
  from kept join ok using (sample_id) group by 1),
h as (select *, case when assistant_tokens < {GATES[0]} then 'assistant_too_short' when longest > {GATES[1]} then 'assistant_too_long' when sequence_tokens > {GATES[2]} then 'sequence_too_long' when longest is null then 'nothing_trained' end as token_reject from g)"""

ORACLE: dict[str, str] = {
    "prepared_datasets": f"""with recursive {_windows_sql(_SPLITS, 'splits')} select split, count(distinct doc_id) as documents, count(*) as samples, sum(end_token - start_token + bos + eos)::bigint as input_tokens, sum(new_tokens + eos)::bigint as loss_tokens, sum(new_tokens + eos)::bigint as recorded_loss_tokens from w group by 1""",
    "line_round_trip": "select doc_id, source, sha256(text) as digest from documents",
    "storage_round_trip": "select doc_id::varchar as sample_id, source_name as source_id, parent_document_id as document_id, sha256(text) as digest, n_chars, source_priority from documents",
    "document_problems": """select doc_id::varchar as sample_id, 'source_id is blank' as problem from documents where (trim(source_name) <> '') is not true union all select doc_id::varchar, 'document_id is blank' from documents where (trim(parent_document_id) <> '') is not true
union all select doc_id::varchar, 'text is missing' from documents where text is null""",
    "preference_batches": f"""{_TURNS}, n as (select *, {_ORD(f"left('no ' || answer, {ANSWER})")} + case when length(answer) + 3 < {ANSWER} then 2 else 0 end as r_sum, least(length(answer) + 4, {ANSWER}) as r_n from t where trim(answer) <> '')
select batch, count(*)::int as pairs, max(p_n + greatest(a_n, r_n))::int as width, sum(p_sum + a_sum)::bigint as chosen_sum, sum(p_sum + r_sum)::bigint as rejected_sum, sum(a_n)::int as chosen_loss from n group by 1""",
    "reward_batches": f"""{_TURNS} select batch, max(p_n + a_n)::int as width, sum(p_sum + a_sum)::bigint as id_sum, round(sum(length(answer) / 100), 6) as rewards, sum((length(answer) % 2 = 1)::int)::int as unranked from t where trim(answer) <> '' group by 1""",
    "trajectory_batches": f"""{_TURNS} select batch, count(*)::int as samples, max(a_n)::int as longest_response, sum(a_n)::bigint as response_tokens, sum(a_n * 0.5::double) as rewards from t where trim(answer) <> '' group by 1""",
    "sft_batches": f"""with {_BASE}, c as (select sample_id, sum(length({_TEXT}) + (role = 'assistant')::int) as n, sum(length(content) + 1) filter (role = 'assistant') as l from kept join ok using (sample_id) group by 1),
o as (select *, (row_number() over (order by sample_id) - 1) // {BATCH} as batch from c)
select batch, count(*)::int as samples, (ceil(max(n) / 8.0) * 8)::int as width, sum(n)::bigint as tokens, sum(l)::bigint as loss_tokens from o group by 1""",
    "sft_token_gates": f"{_TOKENS} select sample_id, assistant_tokens, sequence_tokens, token_reject from h",
    "sft_token_report": f"""{_TOKENS}, k as (select category, count(*) as samples, sum(assistant_tokens) as a, sum(sequence_tokens) as t from h where token_reject is null group by 1),
q(category, quota) as (values {', '.join(f"('{k}', {v})" for k, v in QUOTAS.items())})
select coalesce(k.category, q.category) as category, coalesce(samples, 0)::bigint as samples, coalesce(a, 0)::bigint as assistant_tokens, coalesce(t, 0)::bigint as tokens, coalesce(quota, 0)::bigint as quota,
round(coalesce(t / (select sum(t) from k), 0), 9) as token_share, greatest(coalesce(quota, 0) - coalesce(samples, 0), 0)::bigint as underfilled from k full join q on k.category = q.category""",
    "sampling_counters": f"""with p as (select doc_id, source, strlen(text) as b, length(text) as c from documents where text is not null), g as (select source, sum(b) * 0.25::double as target from p group by 1),
h as (select source, sum(b) as have from p where c between 60 and 6000 group by 1),
k as (select p.*, {_U.format("concat('8:', source, ':', doc_id)")} < 0.1 as val from p join h using (source) join g using (source) where c between 60 and 6000 and {_U.format("concat('7:', source, ':', doc_id)")} < target / have),
m as (select source, count(*) as n, sum(b) as b, count(*) filter (not val) as tn, coalesce(sum(b) filter (not val), 0) as tb, count(*) filter (val) as vn, coalesce(sum(b) filter (val), 0) as vb from k group by 1)
select p.source, count(*) as records, sum(p.b)::bigint as input_bytes, sum((c < 60)::int)::bigint as short_records, sum((c > 6000)::int)::bigint as long_records, sum((c between 60 and 6000)::int)::bigint as eligible_records, coalesce(sum(p.b) filter (c between 60 and 6000), 0)::bigint as eligible_bytes,
coalesce(any_value(m.n), 0)::bigint as selected_records, coalesce(any_value(m.b), 0)::bigint as selected_bytes, coalesce(any_value(tn), 0)::bigint as train_records, coalesce(any_value(tb), 0)::bigint as train_bytes, coalesce(any_value(vn), 0)::bigint as validation_records, coalesce(any_value(vb), 0)::bigint as validation_bytes,
coalesce(any_value(target), 0.0)::double as target_bytes, greatest(coalesce(any_value(target), 0.0) - coalesce(any_value(m.b), 0), 0)::double as missing_bytes from p left join m on m.source = p.source left join g on g.source = p.source group by 1""",
    "step_budget": f"""with {_WINDOWS}, t as (select count(*) as n, sum(end_token - start_token + bos + eos) as k from w) select greatest(1, ceil(1000000 / (16 * k / n::double)) + 1)::bigint as steps, 16::bigint as samples_per_step, round(k / n::double, 6) as mean_tokens from t""",
    "source_differences": """with a as (select distinct nullif(lower(trim(name, e' \\t\\n\\r')), '') as source from sampling_sources), b as (select distinct source from documents)
select source, 'missing' as state from a where source is not null and source not in (select source from b where source is not null) union all select source, 'unexpected' from b where source is not null and source not in (select source from a where source is not null)""",
    "adapted_conversations": f"""with {_BASE}, n as (select sample_id, row_number() over (order by sample_id) as r from raw), m as (select sample_id, count(*) as k, sum(length(content)) as c, count(*) filter (role = 'user') as u, count(*) filter (role = 'assistant') as a from msg where role is not null and content <> '' group by 1)
select 'foreign-' || lpad(r::varchar, 8, '0') as sample_id, k::int as messages, c::int as chars from m join n using (sample_id) where u > 0 and a > 0""",
    "adapted_instructions": f"""{_TURNS} select 'plain-' || lpad(r::varchar, 8, '0') as sample_id, (length(prompt) + case when place % 2 = 0 then 6 else 0 end)::int as asked, length(answer)::int as answered from t where place >= 2 and prompt <> '' and answer <> ''""",
    "adapted_transcripts": f"""{_TURNS} select 'tagged-' || lpad(r::varchar, 8, '0') as sample_id, 2::int as messages, length(answer)::int as answered from t where prompt <> '' and answer <> ''""",
    "document_boundaries": f"with {_CLEAN}, r as (select n, (row_number() over (order by doc_id) - 1) // 8 as batch from accepted) select batch, count(*) - 1 as boundaries, sum(n)::bigint as tokens from r group by 1",
    "shard_numbers": f"with {_CLEAN}, r as (select doc_id, (row_number() over (order by doc_id) - 1) // 100 as shard from accepted) select shard, count(*) as rows, min(doc_id) as first, max(doc_id) as last from r group by 1",
}
