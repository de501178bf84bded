"""Raw records from files: JSON lines (plain or gz), JSON arrays, Parquet. Each reader keeps path and ordinal of the record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.operators.segments import global_rank
from siltworks.runtime import Stage
from siltworks.sources.files import resolve

__all__ = ["resolve"]


def with_ordinal(df: DataFrame, path: str = "_path", line: str = "_line") -> DataFrame:
    """Adds ``ordinal``, the number of the record within its file from 0: the place of its first byte orders the records, so files of any size are numbered in pieces."""
    st = Stage(df.sparkSession, "ordinal")
    kept = st.keep(df)
    ranked = global_rank(kept.select(F.struct(path, line).alias("_at")), "_at")
    first = ranked.groupBy(F.col(f"_at.{path}").alias(path)).agg(F.min("rank").alias("_first"))
    number = ranked.select(F.col(f"_at.{path}").alias(path), F.col(f"_at.{line}").alias(line), "rank").join(first, path).select(path, line, (F.col("rank") - F.col("_first")).alias("ordinal"))
    return kept.join(number, [path, line])


def read_json_lines(spark: SparkSession, paths: list[str], schema: str | T.StructType, lenient: bool = False) -> DataFrame:
    """Parsed objects with ``_path``, ``_line`` (a number that grows along a file; see :func:`with_ordinal`) and ``_bad``. Blank lines are skipped, a byte order mark is dropped. A line that isn't an object is an error, or with
    ``lenient`` a row with ``_bad`` true that callers count and drop."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(paths).select(F.regexp_replace("value", "^﻿", "").alias("line"), F.col("_metadata.file_path").alias("_path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("_line")).where(F.col("line").rlike(r"\S"))
    marked = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.select("_path", "_line", "line", F.from_json("line", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull() | ~F.col("line").rlike(r"^\s*\{")
    if not lenient:
        bad = F.when(bad, F.raise_error(F.concat(F.lit("not a JSON object in "), "_path", F.lit(": "), F.substring("line", 1, 80))).cast("boolean")).otherwise(F.lit(False))
    return parsed.select("_path", "_line", bad.alias("_bad"), *[F.col("r")[f.name].alias(f.name) for f in schema.fields])


def read_json_array(spark: SparkSession, path: str, schema: str, prefix: str = "") -> DataFrame:
    """Elements of a top-level JSON array, or of the array under a dotted prefix."""
    item = T._parse_datatype_string(schema)
    if not prefix:
        return spark.read.schema(item).option("multiLine", True).json(path)
    kind: T.DataType = T.ArrayType(item)
    for part in reversed(prefix.split(".")):
        kind = T.StructType([T.StructField(part, kind)])
    return spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode(F.col(prefix)).alias("r")).select("r.*")


def read_any(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Files of mixed formats under one schema, columns pruned at the scan."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    parquet = [p for p in paths if p.endswith(".parquet")]
    lines = [p for p in paths if not p.endswith(".parquet")]
    parts = []
    if parquet:
        parts.append(spark.read.parquet(*parquet).select(*names, F.col("_metadata.file_path").alias("_path")))
    if lines:
        parts.append(read_json_lines(spark, lines, schema).drop("_bad").select(*names, "_path"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluation_texts(df: DataFrame, language: str = "unknown", source: str = "eval", longest: int | None = None) -> DataFrame:
    """(text, language, source) of evaluation records; absent or blank languages and sources get the defaults, blank texts are left out, and of equal (cut) texts of
    one file the first by its cut text's digest stays once."""
    named = lambda c, other: F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit(other)).alias(c)
    text = F.left("text", F.lit(longest)) if longest else F.col("text")
    return df.where(F.col("text").rlike(r"(?U)\S")).select(text.alias("text"), named("language", language), named("source", source)).dropDuplicates(["text"])


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt) of a text file, one per line, or of JSON lines with ``prompt``; blank ones are left out, a JSON line without a prompt is an error."""
    if path.endswith((".jsonl", ".jsonl.gz", ".ndjson")):
        p = read_json_lines(spark, [path], "prompt string").select("prompt")
        p = p.withColumn("prompt", F.when(F.col("prompt").isNull(), F.raise_error(F.lit("a line has no prompt")).cast("string")).otherwise(F.col("prompt")))
    else:
        p = spark.read.text(path).select(F.col("value").alias("prompt"))
    return p.where(F.col("prompt").rlike(r"(?U)\S"))


def texts(df: DataFrame, key: str = "text", epochs: int = 1, longest: int | None = None) -> DataFrame:
    """Non-blank texts, cut to ``longest`` characters, the whole list ``epochs`` times."""
    t = df.where(F.col(key).rlike(r"(?U)\S")).select(F.col(key).alias("text"))
    if longest:
        t = t.select(F.left("text", F.lit(longest)).alias("text"))
    return t if epochs == 1 else t.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def source_from_path(path: Column) -> Column:
    """Name of the file without folder, ending and a four-digit part number."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(?:\.jsonl)?(?:\.gz)?(?:\.parquet)?$", 1), r"_\d{4}$", "")


def display_name(source: Column) -> Column:
    last = F.substring_index(F.regexp_replace(source, "/+$", ""), "/", -1)
    return F.when(F.coalesce(last, F.lit("")) == "", "<unknown>").otherwise(last)


def language_from_name(source: Column) -> Column:
    """zh, code or en by parts of a source name, in this order, else unknown."""
    s = F.lower(source)
    return F.when(s.rlike("_ch|_zh|chinese"), "ch").when(s.contains("code"), "code").when(s.rlike("_en|english"), "en").otherwise("unknown")


def stratified_lines(df: DataFrame, position: str, n: int, key: Column, buckets_of: str = "_path") -> DataFrame:
    """One record from each of n equal stretches of every file: the one with the smallest key."""
    total = df.groupBy(buckets_of).agg(F.count(F.lit(1)).alias("_t"))
    d = df.join(total, buckets_of).withColumn("_b", F.floor(F.col(position) * n / F.col("_t"))).withColumn("_k", key)
    best = d.groupBy(buckets_of, "_b").agg(F.min(F.struct("_k", position)).alias("_m")).select(buckets_of, F.col(f"_m.{position}").alias(position))
    return d.join(best, [buckets_of, position], "left_semi").drop("_t", "_b", "_k")
