"""Typed training samples and their batches. The encoder is an expression ``text -> array<int>``; code points by default."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.segments import IGNORE, code_points, pad_right, padded_length, truncate

Encoder = Callable[[Column], Column]
NONE = lambda: F.array().cast("array<int>")


@dataclass(frozen=True)
class Marks:
    """Special tokens are configuration."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    eos: int = 2
    pad: int = 0


def _prompt(messages: Column, marks: Marks) -> Column:
    body = F.array_join(F.transform(messages, lambda x: F.concat(F.lit(marks.start), x["role"], F.lit("\n"), x["content"], F.lit(marks.end + "\n"))), "")
    return F.concat(body, F.lit(f"{marks.start}assistant\n"))


def sft(df: DataFrame, longest: int, encode: Encoder = code_points, marks: Marks = Marks(), side: str = "left", train_on_eos: bool = True) -> DataFrame:
    """input_ids, labels, loss_mask: head, content and tail of each turn are encoded one by one, assistant contents (and their EOS) are trained. Rows without a
    trained token are dropped."""

    def turn(x: Column) -> Column:
        head, body = encode(F.concat(F.lit(marks.start), x["role"], F.lit("\n"))), encode(x["content"])
        tail = encode(F.lit(marks.end + "\n"))
        own = x["role"] == "assistant"
        eos = F.when(own, F.array(F.lit(marks.eos))).otherwise(NONE())
        ids = F.concat(head, body, eos, tail)
        mask = F.concat(F.array_repeat(F.lit(0), F.size(head)), F.array_repeat(own.cast("int"), F.size(body)), F.array_repeat((own & F.lit(train_on_eos)).cast("int"), F.size(eos)), F.array_repeat(F.lit(0), F.size(tail)))
        return F.struct(ids.alias("ids"), mask.alias("mask"))

    t = df.withColumn("_t", F.transform("messages", turn))
    t = t.withColumn("input_ids", truncate(F.flatten(F.transform("_t", lambda x: x["ids"])), longest, side)).withColumn("loss_mask", truncate(F.flatten(F.transform("_t", lambda x: x["mask"])), longest, side))
    t = t.withColumn("labels", F.zip_with("input_ids", "loss_mask", lambda i, m: F.when(m == 1, i).otherwise(IGNORE)))
    return t.where(F.exists("loss_mask", lambda m: m == 1)).drop("_t")


def preference(df: DataFrame, longest: int, encode: Encoder = code_points, marks: Marks = Marks()) -> DataFrame:
    """prompt_ids, chosen_ids, rejected_ids; responses end with EOS and are cut to ``longest``. Blank responses are dropped."""
    ok = (F.trim("chosen") != "") & (F.trim("rejected") != "") & F.coalesce(F.col("preference_label"), F.lit(1)).isin(0, 1)
    answer = lambda c: truncate(F.concat(encode(F.col(c)), F.array(F.lit(marks.eos))), longest, "right")
    return df.where(ok).withColumns({"prompt_ids": truncate(encode(_prompt(F.col("prompt_messages"), marks)), longest), "chosen_ids": answer("chosen"), "rejected_ids": answer("rejected")})


def reward(df: DataFrame, longest: int, encode: Encoder = code_points, marks: Marks = Marks()) -> DataFrame:
    """prompt_ids, response_ids; the reward must be a finite number."""
    finite = F.col("reward_label").isNotNull() & ~F.isnan("reward_label") & (F.abs("reward_label") < float("inf"))
    return df.where(finite & (F.trim("response") != "")).withColumns({"prompt_ids": truncate(encode(_prompt(F.col("prompt_messages"), marks)), longest), "response_ids": truncate(F.concat(encode(F.col("response")), F.array(F.lit(marks.eos))), longest, "right")})


def trajectory(df: DataFrame, longest: int, encode: Encoder = code_points, marks: Marks = Marks(), series: tuple[str, ...] = ("rewards", "advantages", "old_log_probs", "reference_log_probs", "values")) -> DataFrame:
    """prompt_ids, response_ids; per-token series must be empty or as long as the response."""
    d = df.where(F.trim("response") != "").withColumns({"prompt_ids": truncate(encode(_prompt(F.col("prompt_messages"), marks)), longest), "response_ids": truncate(F.concat(encode(F.col("response")), F.array(F.lit(marks.eos))), longest, "right")})
    ok = F.lit(True)
    for c in series:
        if c in df.columns:
            ok = ok & (F.coalesce(F.size(c), F.lit(0)).isin(0, -1) | (F.size(c) == F.size("response_ids")))
    return d.where(ok)


def batch(df: DataFrame, by: str, place: str, arrays: dict[str, Column | int], multiple: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per batch: each array padded on the right to the longest of the batch, rounded up to ``multiple``; ``keep`` columns are listed in order."""
    names = list(arrays)
    longest = df.groupBy(by).agg(padded_length(F.max(F.greatest(*[F.size(n) for n in names]) if len(names) > 1 else F.size(names[0])), multiple).alias("_len"))
    d = df.join(longest, by)
    for n, pad in arrays.items():
        d = d.withColumn(n, pad_right(F.col(n), F.col("_len"), pad if isinstance(pad, Column) else F.lit(pad)))
    rows = F.sort_array(F.collect_list(F.struct(place, *names, *keep)))
    g = d.groupBy(by).agg(rows.alias("_r"))

    def listed(name: str) -> Column:
        return F.transform("_r", lambda r: r[name]).alias(name)

    return g.select(by, *[listed(n) for n in (*names, *keep)])


def pretraining_batch(df: DataFrame, by: str, place: str, pad: int = 0, multiple: int = 1) -> DataFrame:
    d = df.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    return batch(d, by, place, {"input_ids": pad, "labels": IGNORE, "attention_mask": 0}, multiple, ("sample_id",)).withColumn("sample_id", F.array_distinct("sample_id"))


def padding_free(df: DataFrame, by: str, place: str) -> DataFrame:
    """One flat sequence per batch with the boundaries of its samples."""
    g = df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(place, "input_ids", "labels"))).alias("_r"))
    zero = F.array(F.lit(0))
    ends = F.aggregate("_r", zero, lambda a, r: F.concat(a, F.array(F.element_at(a, -1) + F.size(r["input_ids"]))))
    return g.select(by, F.flatten(F.transform("_r", lambda r: r["input_ids"])).alias("input_ids"), F.flatten(F.transform("_r", lambda r: r["labels"])).alias("labels"), ends.alias("boundaries"))


def preference_batch(df: DataFrame, by: str, place: str, pad: int = 0) -> DataFrame:
    """Prompt and response joined, labels only on the response. A pair id found twice in a batch is an error."""
    d = df
    for side in ("chosen", "rejected"):
        d = d.withColumn(f"{side}_labels", F.concat(F.array_repeat(F.lit(IGNORE), F.size("prompt_ids")), f"{side}_ids")).withColumn(f"{side}_ids", F.concat("prompt_ids", f"{side}_ids"))
    out = batch(d, by, place, {"chosen_ids": pad, "chosen_labels": IGNORE, "rejected_ids": pad, "rejected_labels": IGNORE}, 1, ("pair_id",))
    twice = F.size(F.array_distinct("pair_id")) < F.size("pair_id")
    return out.withColumn("pair_id", F.when(twice, F.raise_error(F.lit("a pair id is used twice in a batch")).cast("array<string>")).otherwise(F.col("pair_id")))


def sft_batch(df: DataFrame, by: str, place: str, pad: int = 0, multiple: int = 1) -> DataFrame:
    """Padded batch with labels, loss mask and attention mask."""
    d = df.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    return batch(d, by, place, {"input_ids": pad, "labels": IGNORE, "loss_mask": 0, "attention_mask": 0}, multiple, ("sample_id",))


def trajectory_batch(df: DataFrame, by: str, place: str, pad: int = 0, series: tuple[str, ...] = ("rewards", "advantages", "old_log_probs", "reference_log_probs", "values")) -> DataFrame:
    """Prompt and response joined, a mask of the response, and each per-token series padded with 0.0 to the longest response; an absent series is all zeros."""
    have = [c for c in series if c in df.columns]
    d = df.withColumn("input_ids", F.concat("prompt_ids", "response_ids")).withColumn("response_mask", F.concat(F.array_repeat(F.lit(0), F.size("prompt_ids")), F.array_repeat(F.lit(1), F.size("response_ids"))))
    d = d.withColumn("_n", F.size("response_ids")).join(df.groupBy(by).agg(F.max(F.size("response_ids")).alias("_longest")), by)
    for c in have:
        d = d.withColumn(c, pad_right(F.coalesce(F.col(c), F.array().cast("array<double>")), F.col("_longest"), F.lit(0.0)))
    return batch(d, by, place, {"input_ids": pad, "response_mask": 0}, 1, (*have, "sample_id") if "sample_id" in df.columns else tuple(have))


def reward_batch(df: DataFrame, by: str, place: str, pad: int = 0) -> DataFrame:
    d = df.withColumn("input_ids", F.concat("prompt_ids", "response_ids")).withColumn("ranking_label", F.coalesce("ranking_label", F.lit(-1)))
    return batch(d, by, place, {"input_ids": pad}, 1, ("reward_label", "ranking_label"))


# Invariants of stored samples, as boolean expressions.


def token_ids_ok(ids: Column, vocabulary: int, labels: bool = False) -> Column:
    return F.coalesce(F.forall(ids, lambda t: ((t >= 0) & (t < vocabulary)) | (F.lit(labels) & (t == IGNORE))), F.lit(False))


def mask_ok(mask: Column) -> Column:
    return F.coalesce(F.forall(mask, lambda t: t.isin(0, 1)), F.lit(False))


def finite_ok(values: Column) -> Column:
    return F.coalesce(F.forall(values, lambda t: ~F.isnan(t) & (F.abs(t) < float("inf"))), F.lit(False))


def aligned(*arrays: Column) -> Column:
    out = F.lit(True)
    for a in arrays[1:]:
        out = out & (F.size(arrays[0]) == F.size(a))
    return out


def sft_ok(ids: Column, labels: Column, mask: Column) -> Column:
    return aligned(ids, labels, mask) & mask_ok(mask) & F.forall(F.zip_with(labels, mask, lambda x, m: (m == 1) | (x == IGNORE)), lambda b: b)


def shape_ok(shape: Column, flat: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x) == F.size(flat)


def token_counts(ids: Column, mask: Column, labels: Column) -> tuple[Column, Column]:
    """(input tokens, loss tokens): attended positions, or all where there is no mask; labels that count, or all where there are none."""
    n = F.size(ids)
    return F.when(F.coalesce(F.size(mask), F.lit(0)) > 0, F.aggregate(mask, F.lit(0), lambda a, x: a + x)).otherwise(n), F.when(labels.isNull(), n).otherwise(F.size(F.filter(labels, lambda x: x != IGNORE)))


def select_inputs(df: DataFrame, *names: str) -> DataFrame:
    """The columns a model takes, absent optional ones left out."""
    return df.select(*[n for n in names if n in df.columns])


@dataclass(frozen=True)
class Task:
    """What a task's samples are, how raw records become them, and which ways of packing and batching go with them."""

    sample_type: str
    build: Callable[..., DataFrame] | None
    batch: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    packing: frozenset[str] = frozenset()
    batching: frozenset[str] = frozenset()


TASKS: dict[str, Task] = {}


def register(name: str, task: Task) -> None:
    """Adds a task; blank names and names in use are errors."""
    if not name.strip() or not task.sample_type.strip():
        raise ValueError("a task and its sample type need names")
    if name in TASKS:
        raise ValueError(f"{name} is registered")
    TASKS[name] = task


def task(name: str) -> Task:
    if name not in TASKS:
        raise ValueError(f"unknown task {name!r}, known are {sorted(TASKS)}")
    return TASKS[name]


# fixed values: task names, sample types and strategies
_FAMILIES = {
    ("pretraining", "cpt"): Task("pretraining", None, pretraining_batch, ("input_ids", "labels", "attention_mask", "segment_ids", "position_ids"), frozenset({"stream"}), frozenset({"fixed_length"})),
    ("sft", "instruction_tuning"): Task("sft", sft, sft_batch, ("input_ids", "labels", "attention_mask", "loss_mask", "segment_ids", "position_ids"), frozenset({"sample_isolated"}), frozenset({"fixed_length", "padding_free"})),
    ("preference", "dpo", "ipo", "kto"): Task("preference", preference, preference_batch, ("chosen_ids", "chosen_labels", "rejected_ids", "rejected_labels"), batching=frozenset({"preference_pair"})),
    ("reward",): Task("reward", reward, reward_batch, ("input_ids", "reward_label", "ranking_label"), batching=frozenset({"reward_pair"})),
    ("rlhf", "ppo", "grpo"): Task("trajectory", trajectory, trajectory_batch, ("input_ids", "response_mask", "rewards", "advantages", "old_log_probs", "reference_log_probs", "values"), batching=frozenset({"trajectory"})),
}
for _names, _task in _FAMILIES.items():
    for _name in _names:
        register(_name, _task)
