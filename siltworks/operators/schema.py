"""Invariants of stored samples as named checks, and the layout in which samples are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.operators.tasks import aligned, finite_ok, mask_ok, shape_ok, token_ids_ok

IDENTIFIERS = ("sample_id", "dataset_id", "source_id")

#: Array columns of each sample type with the type of their items; all other fields are metadata.
ARRAYS: dict[str, dict[str, str]] = {
    "document": {"input_ids": "int"},
    "pretraining": {"input_ids": "int", "labels": "int", "attention_mask": "int", "document_ids": "int"},
    "text_sequence": {"input_ids": "int", "labels": "int", "loss_mask": "int"},
    "sft": {"input_ids": "int", "labels": "int", "loss_mask": "int"},
    "preference": {"prompt_ids": "int", "chosen_ids": "int", "rejected_ids": "int"},
    "reward": {"prompt_ids": "int", "response_ids": "int"},
    "trajectory": {"prompt_ids": "int", "response_ids": "int", "rewards": "double", "advantages": "double", "old_log_probs": "double", "reference_log_probs": "double", "values": "double"},
}


def identifier_ok(c: Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _optional(ok: Column, c: Column) -> Column:
    return c.isNull() | ok


def checks(kind: str, columns: list[str], vocabulary: int = 2**31 - 1) -> dict[str, Column]:
    """Name of each invariant of a sample type to the expression that must hold; only columns that are there are checked, but those an item can't do without must be."""
    col = F.col
    out = {f"{c} is blank": identifier_ok(col(c)) for c in IDENTIFIERS if c in columns}
    arrays = [c for c in ARRAYS.get(kind, {}) if c in columns]
    for c in arrays:
        if ARRAYS[kind][c] == "double":
            out[f"{c} isn't finite"] = _optional(finite_ok(col(c)), col(c))
        elif c.endswith("mask"):
            out[f"{c} isn't 0 or 1"] = _optional(mask_ok(col(c)), col(c))
        else:
            out[f"{c} is out of range"] = _optional(token_ids_ok(col(c), vocabulary, labels=c == "labels"), col(c))
    if kind == "document":
        out["document_id is blank"] = identifier_ok(col("document_id"))
        out["text is missing"] = col("text").isNotNull()
    elif kind in ("pretraining", "text_sequence", "sft"):
        out["input_ids are empty"] = F.coalesce(F.size("input_ids"), F.lit(0)) > 0
        for c in arrays[1:]:
            # an empty list of document ids counts as absent
            size = F.coalesce(F.size(c), F.lit(0))
            out[f"{c} aren't aligned"] = col(c).isNull() | aligned(col("input_ids"), col(c)) | ((size == 0) & F.lit(c == "document_ids"))
    elif kind in ("preference", "reward", "trajectory"):
        for c in arrays[:3] if kind == "preference" else arrays[:2]:
            out[f"{c} are empty"] = F.coalesce(F.size(c), F.lit(0)) > 0
        if kind == "preference" and "preference_label" in columns:
            out["preference_label isn't 0 or 1"] = _optional(col("preference_label").isin(0, 1), col("preference_label"))
        if kind == "reward":
            out["reward_label isn't finite"] = F.coalesce(~F.isnan("reward_label") & (F.abs("reward_label") < float("inf")), F.lit(False))
        for c in arrays[2:] if kind == "trajectory" else []:
            out[f"{c} aren't aligned"] = F.coalesce(F.size(c), F.lit(0)).isin(0, -1) | aligned(col("response_ids"), col(c))
    elif kind == "multimodal":
        out["shape and values differ"] = shape_ok(col("shape"), col("values"))
    else:
        raise ValueError(f"unknown sample type {kind!r}")
    return out


def problems(df: DataFrame, kind: str, key: str = "sample_id", vocabulary: int = 2**31 - 1) -> DataFrame:
    """(key, problem) of every invariant that a row breaks, all of them in one pass."""
    named = checks(kind, df.columns, vocabulary)
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in named.items()]))
    return df.select(key, F.explode(bad).alias("problem"))


def validated(df: DataFrame, kind: str, policy: str = "skip", vocabulary: int = 2**31 - 1) -> tuple[DataFrame, DataFrame]:
    """(valid rows, broken rows with ``problem``, the first one); with policy ``error`` the valid side fails on the first broken row."""
    if policy not in ("skip", "error"):
        raise ValueError("policy is skip or error")
    first = F.lit(None).cast("string")
    for name, ok in reversed(checks(kind, df.columns, vocabulary).items()):
        first = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(first)
    marked = df.withColumn("problem", first)
    if policy == "error":
        valid = marked.where(F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("invalid sample: "), "problem")).cast("boolean")))
    else:
        valid = marked.where("problem is null")
    return valid.drop("problem"), marked.where("problem is not null")


def with_identifiers(df: DataFrame, dataset: str, source: str, ordinal: str) -> DataFrame:
    """Fills absent or blank ``sample_id`` (dataset, hyphen, eight-digit ordinal), ``dataset_id`` and ``source_id``."""
    given = lambda c: F.when(F.trim(c) != "", F.trim(c)) if c in df.columns else F.lit(None).cast("string")
    number = F.concat(F.lit(f"{dataset}-"), F.lpad(F.col(ordinal).cast("string"), 8, "0"))
    return df.withColumns({"sample_id": F.coalesce(given("sample_id"), number), "dataset_id": F.coalesce(given("dataset_id"), F.lit(dataset)), "source_id": F.coalesce(given("source_id"), F.lit(source))})


def to_storage(df: DataFrame, kind: str) -> DataFrame:
    """Identifiers and arrays as columns, everything else as one JSON text ``metadata``."""
    arrays = [c for c in ARRAYS[kind] if c in df.columns]
    ids = [c for c in IDENTIFIERS if c in df.columns]
    other = [c for c in df.columns if c not in arrays and c not in ids]
    return df.select(*ids, *arrays, (F.to_json(F.struct(*other), {"ignoreNullFields": "false"}) if other else F.lit("{}")).alias("metadata"))


def from_storage(df: DataFrame, fields: str) -> DataFrame:
    """Stored rows with the named metadata fields (a schema text) as columns again."""
    kind = T._parse_datatype_string(fields)
    parsed = df.withColumn("_m", F.from_json("metadata", kind))
    return parsed.select(*[c for c in df.columns if c != "metadata"], *[F.col("_m")[f.name].alias(f.name) for f in kind.fields])


def stored_schema(kind: str) -> T.StructType:
    """Schema of stored samples of a type."""
    fields = [*[f"{c} string" for c in IDENTIFIERS], *[f"{c} array<{t}>" for c, t in ARRAYS[kind].items()], "metadata string"]
    return T._parse_datatype_string(", ".join(fields))
