"""Raw record formats to conversations: {sample_id, source_id, source_group, category, messages}. Each adapter is a select and a filter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.cleaning import strip_space
from siltworks.operators.conversations import CLOSE, OPEN, map_role, turns

PAIRS = "array<struct<from:string,value:string,role:string,content:string,human:string,assistant:string>>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages_from(conversation: Column) -> Column:
    """Messages of ``[{from|role, value|content}]`` or ``[{human, assistant}]`` items (struct PAIRS): known roles, stripped, blanks dropped."""
    two = lambda x: F.array(F.struct(F.lit("user").alias("role"), x["human"].alias("content")), F.struct(F.lit("assistant").alias("role"), x["assistant"].alias("content")))
    one = lambda x: F.array(F.struct(map_role(F.coalesce(x["from"], x["role"])).alias("role"), F.coalesce(x["value"], x["content"]).alias("content")))
    flat = F.flatten(F.transform(conversation, lambda x: F.when(x["human"].isNotNull() | x["assistant"].isNotNull(), two(x)).otherwise(one(x))))
    clean = F.transform(flat, lambda x: F.struct(x["role"].alias("role"), strip_space(x["content"]).alias("content")))
    return F.filter(clean, lambda x: x["role"].isNotNull() & (F.coalesce(x["content"], F.lit("")) != ""))


def decode(conversation: Column) -> Column:
    """The same from a JSON string."""
    return messages_from(F.from_json(conversation, PAIRS))


def has_roles(m: Column, *roles: str) -> Column:
    def one(role: str) -> Column:
        return F.exists(m, lambda x: x["role"] == role)

    out = F.lit(True)
    for r in roles:
        out = out & one(r)
    return F.coalesce(out, F.lit(False))


def text_sample(m: Column, n: int = 4000) -> Column:
    return F.lower(F.left(F.array_join(F.transform(m, lambda x: x["content"]), "\n"), F.lit(n)))


def _finish(df: DataFrame, name: str, group: str, category: Column, m: Column, ident: Column | None = None, ordinal: str = "ordinal") -> DataFrame:
    number = F.concat(F.lit(f"{name}-"), F.lpad(F.col(ordinal).cast("string"), 8, "0"))
    return df.select((number if ident is None else F.coalesce(ident, number)).alias("sample_id"), F.lit(name).alias("source_id"), F.lit(group).alias("source_group"), category.alias("category"), m.alias("messages"))


def think(reasoning: Column, answer: Column) -> Column:
    return F.concat(F.lit(OPEN), reasoning, F.lit(CLOSE + "\n"), answer)


def instruction(df: DataFrame, name: str, group: str, category: Column, least_score: int | None = None) -> DataFrame:
    """instruction [+ blank line + input] asks, output answers; both must be non-empty, and ``score`` at least ``least_score`` where given."""
    ask = F.concat_ws("\n\n", *[F.when(strip_space(F.col(c)) != "", strip_space(F.col(c))) for c in ("instruction", "input")])
    answer = strip_space(F.col("output"))
    ok = (F.coalesce(strip_space(F.col("instruction")), F.lit("")) != "") & (F.coalesce(answer, F.lit("")) != "")
    df = df.where(ok if least_score is None else ok & (F.coalesce(F.col("score"), F.lit(-1)) >= least_score))
    return _finish(df, name, group, category, F.array(message("user", ask), message("assistant", answer)))


# fixed values: where ready conversations are found, in this order
CONVERSATION_KEYS = ("messages", "conversations", "conversation")


def conversation_column(df: DataFrame) -> str:
    """The column that holds the conversation; none is an error."""
    for c in CONVERSATION_KEYS:
        if c in df.columns:
            return c
    raise ValueError(f"none of {CONVERSATION_KEYS} is a column")


def conversations(df: DataFrame, name: str, group: str, category: Callable[[Column], Column], column: str | None = None, system: str | None = None, least_user_turns: int = 1) -> DataFrame:
    """A list of items, or the list as JSON, in ``column`` or else in the first of the usual columns; a system text may go first. Needs user and assistant."""
    column = column or conversation_column(df)
    c = F.col(column)
    m = decode(c) if df.schema[column].dataType.simpleString() == "string" else messages_from(c)
    if system:
        first = F.when(F.coalesce(strip_space(F.col(system)), F.lit("")) != "", F.array(message("system", strip_space(F.col(system))))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
        m = F.concat(first, m)
    d = df.withColumn("_m", m).where(has_roles(F.col("_m"), "user", "assistant") & (turns(F.col("_m"), "user") >= least_user_turns))
    return _finish(d, name, group, category(F.col("_m")), F.col("_m"))


def reasoning(df: DataFrame, name: str, group: str, category: Column, problem: str, thought: str, solution: str, accept: Column | None = None, ident: str | None = None) -> DataFrame:
    """Problem asks; thought between reasoning marks and the solution answer. All three must be non-empty, and ``accept`` true where given."""
    cols = {k: strip_space(F.col(k)) for k in (problem, thought, solution)}
    ok = F.lit(True)
    for c in cols.values():
        ok = ok & (F.coalesce(c, F.lit("")) != "")
    d = df.where(ok if accept is None else ok & F.coalesce(accept, F.lit(False)))
    return _finish(d, name, group, category, F.array(message("user", cols[problem]), message("assistant", think(cols[thought], cols[solution]))), None if ident is None else F.col(ident))


def verified(df: DataFrame, name: str, group: str, category: Column) -> DataFrame:
    """Ready messages that passed at least one check (``correctness_count`` above 0), under their ``uuid``."""
    m = F.transform("messages", lambda x: F.struct(map_role(x["role"]).alias("role"), strip_space(x["content"]).alias("content")))
    return _finish(df.where(F.coalesce(F.col("correctness_count"), F.lit(0)) > 0).withColumn("_m", m).where(has_roles(F.col("_m"), "user", "assistant")), name, group, category, F.col("_m"), F.col("uuid"))


def tagged_transcript(df: DataFrame, name: str, group: str, category: Column, column: str = "plain_text") -> DataFrame:
    """``[Human]: ...<eoh> [MOSS]: ...<eoa>`` turns of one text."""
    who = F.regexp_extract_all(F.col(column), F.lit(r"\[(Human|MOSS)\]:"), F.lit(1))
    parts = F.slice(F.split(F.col(column), r"\[(?:Human|MOSS)\]:"), 2, 1 << 20)
    m = F.zip_with(who, parts, lambda r, t: F.struct(F.when(r == "Human", "user").otherwise("assistant").alias("role"), strip_space(F.regexp_replace(t, "<eo[ha]>", "")).alias("content")))
    d = df.withColumn("_m", F.filter(m, lambda x: x["content"] != "")).where(has_roles(F.col("_m"), "user", "assistant"))
    return _finish(d, name, group, category, F.col("_m"))


#: Keyword classes for conversations without a category.
KEYWORDS = {"code": r"```|\b(?:python|javascript|java|c\+\+|sql|function|algorithm|program)\b", "math": r"\b(?:equation|integral|theorem|prove|algebra|geometry|probability|calculate)\b", "science": r"\b(?:physics|chemistry|biology|molecule|quantum|species)\b"}


def by_keywords(m: Column, prefix: str = "en_", other: str = "general") -> Column:
    sample = text_sample(m)
    out = F.when(sample.rlike(KEYWORDS["code"]), prefix + "code")
    for k in ("math", "science"):
        out = out.when(sample.rlike(KEYWORDS[k]), prefix + k)
    return out.otherwise(prefix + other)


ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "instruction": instruction, "conversations": conversations, "reasoning": reasoning, "verified": verified, "tagged_transcript": tagged_transcript,
}


def register(name: str, adapter: Callable[..., DataFrame]) -> None:
    """Adds a format; a name in use is an error."""
    if name in ADAPTERS:
        raise ValueError(f"{name} is registered")
    ADAPTERS[name] = adapter
