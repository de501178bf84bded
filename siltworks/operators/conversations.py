"""Conversations: message normalisation, content policy, gates, rendering, masks, report. Messages are ARRAY<STRUCT<role, content>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.cleaning import strip_space

# fixed values: role synonyms and reasoning marks
ROLES = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "system": "system", "tool": "tool"}
OPEN, CLOSE = "<|think|>", "<|/think|>"
OTHER_OPEN, OTHER_CLOSE = ("<think>", "<|begin_of_thought|>"), ("</think>", "<|end_of_thought|>")


def map_role(role: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.try_element_at(table, F.lower(strip_space(role)))


def normalise_messages(messages: Column) -> Column:
    """Known roles under one name, contents stripped, blank ones and unknown roles left out; null where no user or no assistant is left."""
    m = F.transform(messages, lambda x: F.struct(map_role(x["role"]).alias("role"), strip_space(x["content"]).alias("content")))
    m = F.filter(m, lambda x: x["role"].isin("user", "assistant", "system") & (F.coalesce(x["content"], F.lit("")) != ""))
    return F.when(F.exists(m, lambda x: x["role"] == "user") & F.exists(m, lambda x: x["role"] == "assistant"), m)


def reasoning_tags(content: Column) -> Column:
    """One spelling of the reasoning marks."""
    for old in OTHER_OPEN:
        content = F.replace(content, F.lit(old), F.lit(OPEN))
    for old in OTHER_CLOSE:
        content = F.replace(content, F.lit(old), F.lit(CLOSE))
    return content


def _count(content: Column, mark: str) -> Column:
    return (F.length(content) - F.length(F.replace(content, F.lit(mark), F.lit("")))) / len(mark)


def balanced(content: Column) -> Column:
    return _count(content, OPEN) == _count(content, CLOSE)


def content_policy(df: DataFrame, messages: str = "messages", drop_system: bool = True, strip_reasoning: bool = False) -> DataFrame:
    """Adds ``policy_messages``, ``dropped_system``, ``reasoning``, ``reject`` (malformed_reasoning, empty_assistant, missing_role or null)."""
    m = F.coalesce(F.col(messages), F.array().cast(df.schema[messages].dataType))
    named = F.transform(m, lambda x: F.struct(map_role(x["role"]).alias("role"), F.coalesce(strip_space(x["content"]), F.lit("")).alias("content")))
    kept = F.filter(named, lambda x: x["role"].isNotNull() & ~((x["role"] == "system") & F.lit(drop_system)))
    tagged = F.transform(kept, lambda x: F.struct(x["role"].alias("role"), F.when(x["role"] == "assistant", reasoning_tags(x["content"])).otherwise(x["content"]).alias("content")))

    def finish(x: Column) -> Column:
        c = F.regexp_replace(x["content"], r"(?s)<\|think\|>.*?<\|/think\|>", "") if strip_reasoning else x["content"]
        c = F.regexp_replace(strip_space(c), "\n{3,}", "\n\n") if strip_reasoning else c
        return F.struct(x["role"].alias("role"), F.when(x["role"] == "assistant", c).otherwise(x["content"]).alias("content"))

    out = df.withColumn("_named", named).withColumn("_tagged", tagged).withColumn("policy_messages", F.transform("_tagged", finish))
    return (
        out.withColumn("dropped_system", F.when(F.lit(drop_system), F.size(F.filter("_named", lambda x: x["role"] == "system"))).otherwise(0))
        .withColumn("reasoning", F.exists("_tagged", lambda x: (x["role"] == "assistant") & F.contains(x["content"], F.lit(OPEN))))
        .withColumn(
            "reject",
            F.when(F.exists("_tagged", lambda x: (x["role"] == "assistant") & ~balanced(x["content"])), "malformed_reasoning")
            .when(F.exists("policy_messages", lambda x: (x["role"] == "assistant") & (x["content"] == "")), "empty_assistant")
            .when(~(F.exists("policy_messages", lambda x: x["role"] == "user") & F.exists("policy_messages", lambda x: x["role"] == "assistant")), "missing_role"),
        ).drop("_named", "_tagged")
    )


def turns(messages: Column, role: str) -> Column:
    return F.size(F.filter(messages, lambda x: x["role"] == role))


def is_multi_turn(messages: Column) -> Column:
    return (turns(messages, "user") > 1) & (turns(messages, "assistant") > 1)


def characters(messages: Column, role: str | None = None) -> Column:
    m = messages if role is None else F.filter(messages, lambda x: x["role"] == role)
    return F.aggregate(m, F.lit(0), lambda a, x: a + F.length(x["content"]))


def char_gates(df: DataFrame, low: int, high: int, least_user: int, messages: str = "policy_messages") -> DataFrame:
    """Total characters within [low, high] and at least ``least_user`` by the user."""
    return df.where(characters(F.col(messages)).between(low, high) & (characters(F.col(messages), "user") >= least_user))


def content_key(messages: Column, seed: int = 0) -> Column:
    """SHA-256 over seed and all roles and contents."""
    return F.sha2(F.concat(F.lit(f"{seed}\x00"), F.array_join(F.transform(messages, lambda x: F.concat(x["role"], F.lit("\x00"), x["content"])), "\x00")), 256)


def render(messages: Column, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """START role LF content END LF for every message."""
    return F.array_join(F.transform(messages, lambda x: F.concat(F.lit(start), x["role"], F.lit("\n"), x["content"], F.lit(end + "\n"))), "")


def assistant_spans(messages: Column, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """Character spans [from, to) of the assistant contents with their end mark in the rendered text."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        head = s["at"] + F.lit(len(start)) + F.length(x["role"]) + 1
        stop = head + F.length(x["content"]) + F.lit(len(end))
        span = F.array(F.struct(head.cast("int").alias("from"), stop.cast("int").alias("to")))
        return F.struct((stop + 1).cast("int").alias("at"), F.when(x["role"] == "assistant", F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(messages, zero, step, lambda s: s["spans"])


def mask_by_spans(offsets: Column, spans: Column) -> Column:
    """1 for each token whose first character lies in a span."""
    return F.transform(offsets, lambda o: F.exists(spans, lambda s: (s["from"] <= o) & (o < s["to"])).cast("int"))


def labels_by_mask(ids: Column, mask: Column) -> Column:
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(-100))


def labels_by_spans(ids: Column, spans: Column) -> Column:
    """Labels of a text with one token per character: those inside the spans, which are in order and apart, all others ignored. Expressions run per span only."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        return F.struct(x["to"].alias("at"), F.concat(s["out"], F.array_repeat(F.lit(-100), x["from"] - s["at"]), F.slice(ids, x["from"] + 1, x["to"] - x["from"])).alias("out"))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.array_repeat(F.lit(-100), F.size(ids) - s["at"])))


def chat_template(messages: Column, generation: bool = False, keep_reasoning: bool = True) -> Column:
    """Rendered conversation without empty messages, reasoning optional, a prompt for the answer at the end on demand."""
    m = F.filter(messages, lambda x: F.coalesce(x["content"], F.lit("")) != "")
    if not keep_reasoning:
        m = F.transform(m, lambda x: F.struct(x["role"].alias("role"), F.regexp_replace(x["content"], r"(?s)<\|think\|>.*?<\|/think\|>\n*", "").alias("content")))
    return F.concat(render(m), F.lit("<|im_start|>assistant\n" if generation else ""))


def fit_history(sizes: Column, budget: int) -> Column:
    """Number of newest turns whose sizes sum to at most ``budget``; the newest always stays. One pass from the newest turn on."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        total = s["sum"] + x
        return F.struct(total.alias("sum"), (s["kept"] + F.when(total <= budget, 1).otherwise(0)).alias("kept"))

    return F.greatest(F.aggregate(F.reverse(sizes), start, step, lambda s: s["kept"]), F.least(F.size(sizes), F.lit(1)))


def token_gates(df: DataFrame, least_answer: int, most_answer: int, longest: int, encode, messages: str = "policy_messages") -> DataFrame:
    """Adds ``assistant_tokens``, ``sequence_tokens`` and ``token_reject`` (assistant_too_short, assistant_too_long, sequence_too_long, nothing_trained or null):
    the answers together have at least ``least_answer`` tokens, each at most ``most_answer``, the rendered conversation at most ``longest``, and some answer
    is trained. ``encode`` turns a text into its tokens."""
    answers = F.transform(F.filter(messages, lambda x: x["role"] == "assistant"), lambda x: F.size(encode(x["content"])))
    d = df.withColumn("_answers", answers).withColumn("sequence_tokens", F.size(encode(render(F.col(messages)))))
    d = d.withColumn("assistant_tokens", F.aggregate("_answers", F.lit(0), lambda a, x: a + x))
    reject = (
        F.when(F.col("assistant_tokens") < least_answer, "assistant_too_short").when(F.exists("_answers", lambda n: n > most_answer), "assistant_too_long")
        .when(F.col("sequence_tokens") > longest, "sequence_too_long").when(F.size("_answers") == 0, "nothing_trained")
    )
    return d.withColumn("token_reject", reject).drop("_answers")


def token_report(df: DataFrame, quotas: dict[str, int], by: str = "category") -> DataFrame:
    """Per group: samples, tokens, the share of all tokens, and by how many samples its quota is missed. Groups of the quotas without samples are listed too."""
    wanted = df.sparkSession.createDataFrame(sorted(quotas.items()), f"{by} string, quota long")
    have = df.groupBy(by).agg(F.count(F.lit(1)).alias("samples"), F.sum("assistant_tokens").alias("assistant_tokens"), F.sum("sequence_tokens").alias("tokens"))
    total = have.agg(F.sum("tokens").alias("t")).scalar()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = have.join(wanted, by, "full_outer").select(by, *[zero(c) for c in ("samples", "assistant_tokens", "tokens", "quota")])
    return out.withColumn("token_share", F.round(F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)), 9)).withColumn("underfilled", F.greatest(F.col("quota") - F.col("samples"), F.lit(0)))
