"""Problem 2: token budget per source, language and domain.

Every text is encoded once by the chosen vocabulary (loaded once per Python worker, texts encoded in batches); only the count and
the few columns that are needed leave Python. Recorded counts are judged against the exact one. The exact counts are kept as a table,
and the sums are one CUBE over canonical source, language and domain of that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.text import fold_name, not_blank, strip
from siltworks.llm.tokenizers import BYTE_BPE, DEFAULT_DIR, batch_encoder
from siltworks.runtime import Stage

COUNT = "n_tokens"
BATCH_TEXTS, BATCH_CHARS = 256, 2_000_000  # texts encoded at once; a text above the second bound is a batch of its own


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, tokenizer: str = BYTE_BPE, folder: str = DEFAULT_DIR) -> DataFrame:
    """``keep`` columns plus ``n_tokens`` (int). Null and empty texts have 0 tokens. The text itself doesn't come back from Python."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    if COUNT in keep:
        raise ValueError(f"{COUNT} is taken")
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(COUNT, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(tokenizer, folder)
        for b in batches:
            n: list[int] = []
            for texts in text_batches(b.column(len(keep))):
                n.extend(map(len, encode(texts)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int32())], names=[*keep, COUNT])

    return df.select(*keep, F.col(text)).mapInArrow(run, schema)


def text_batches(column: pa.Array) -> Iterator[list[str]]:
    """The texts in order, some at a time, null as empty."""
    held, size = [], 0
    for i in range(len(column)):
        t = column[i].as_py() or ""
        if held and (len(held) >= BATCH_TEXTS or size + len(t) > BATCH_CHARS):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def canonical_source(name: Column) -> Column:
    """One spelling per source: trimmed, lower case, no file ending, blanks and hyphens as underscore; blank becomes null."""
    s = F.regexp_replace(F.lower(strip(name)), r"\.(jsonl|parquet|json)(\.gz)?$", "")
    s = F.regexp_replace(s, r"[\s\-]+", "_")
    return F.when(s != "", s)


def canonical_language(name: Column) -> Column:
    """zh, en or code for the known spellings, else the trimmed lower-case name; blank becomes null."""
    s = F.regexp_replace(F.lower(strip(name)), "_", "-")
    return (
        F.when(s.rlike("^(zh|ch|cn|chi|zho|chinese|mandarin)(-.*)?$"), "zh")
        .when(s.rlike("^(en|eng|english)(-.*)?$"), "en")
        .when(s.rlike("^(code|python|java|sql|rust|javascript)$"), "code")
        .when(s != "", s)
    )


def wrong_counts(raw: Column, cleaned: Column, exact: Column, chars: Column, octets: Column) -> Column:
    """True where the recorded counts of a non-blank text cannot be right.

    A recorded count that equals the exact one needs no bounds of the bytes: they hold for it. Any other must lie between 1 and the bytes of the text;
    both must not be below one per 40 characters, and the cleaned count lies between 0 and the raw one."""
    off = (raw != exact) & ((raw <= 0) | (raw > octets))
    return F.coalesce(raw.isNull() | cleaned.isNull() | off | (cleaned < 0) | (cleaned > raw) | (raw * 40 < chars), F.lit(True))


def token_report(docs: DataFrame, tokenizer: str = BYTE_BPE, folder: str = DEFAULT_DIR) -> DataFrame:
    """One row per document: exact count (``n_tokens``), canonical source and language, the recorded raw count and whether the recorded counts are unusable.

    Null and blank texts have no recorded count to judge (``counts_wrong`` is false); repeated rows count each."""
    marked = docs.select(
        "doc_id", "text",
        F.coalesce(canonical_source(F.col("source_name")), canonical_source(F.col("source")), F.lit("unknown")).alias("source_key"),
        F.coalesce(canonical_language(F.col("language")), canonical_language(F.col("lang")), F.lit("unknown")).alias("language_key"),
        F.col("raw_tokens").alias("recorded_tokens"), F.col("cleaned_tokens").alias("recorded_cleaned"),
        F.length("text").alias("chars"), F.octet_length("text").alias("octets"), not_blank(F.col("text")).alias("has_text"),
    )
    keep = ["doc_id", "source_key", "language_key", "recorded_tokens", "recorded_cleaned", "chars", "octets", "has_text"]
    counted = count_tokens(marked, keep=keep, tokenizer=tokenizer, folder=folder)
    wrong = F.col("has_text") & wrong_counts(F.col("recorded_tokens"), F.col("recorded_cleaned"), F.col(COUNT), F.col("chars"), F.col("octets"))
    return counted.select("doc_id", "source_key", "language_key", "recorded_tokens", COUNT, wrong.alias("counts_wrong"))


def token_cube(docs: DataFrame, sources: DataFrame, tokenizer: str = BYTE_BPE, folder: str = DEFAULT_DIR) -> DataFrame:
    """Documents, exact tokens, recorded tokens and unusable records for every combination of source, language and domain, null standing for all.

    The exact counts are kept as a table first. It is summed by source and language before the domain is joined, so only a handful of rows is cubed."""
    counts = Stage(docs.sparkSession, "tokens").keep(token_report(docs, tokenizer, folder))
    domain = sources.select(canonical_source(F.col("name")).alias("source_key"), fold_name(F.col("domain")).alias("domain")).where("source_key is not null").groupBy("source_key").agg(F.min("domain").alias("domain"))
    base = counts.groupBy("source_key", "language_key").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col(COUNT).cast("long")).alias("tokens"),
        F.sum(F.when(~F.col("counts_wrong"), F.col("recorded_tokens"))).alias("recorded"), F.sum(F.col("counts_wrong").cast("long")).alias("wrong"),
    )
    return (
        base.join(domain, "source_key", "left").withColumn("domain", F.coalesce("domain", F.lit("unknown")))
        .cube("source_key", "language_key", "domain")
        .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.coalesce(F.sum("recorded"), F.lit(0)).alias("recorded_tokens"), F.sum("wrong").alias("wrong_counts"), F.grouping_id().alias("level"))
    )


def found(docs: DataFrame) -> DataFrame:
    return token_report(docs).where("counts_wrong").select("doc_id")
