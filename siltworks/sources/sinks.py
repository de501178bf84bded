"""Datasets on disk: Parquet shards with a manifest that names, counts and checks them; published by one rename."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators.selection import bottom_k
from siltworks.operators.skew import broadcast_if_small
from siltworks.sources.files import Files

FORMAT = "parquet"
# fixed values: keys of a manifest
KEYS = ["schema_version", "format", "dataset_id", "sample_type", "version", "created_at", "sample_count", "shards", "parent_version", "metadata", "content_hash"]
MANIFEST = "_manifest.json"
SHARD_BYTES_MAX = 2**31 - 1  # a digest is taken of a shard as one value


class DatasetError(Exception):
    """A dataset on disk isn't what its manifest says."""


def content_hash(manifest: dict) -> str:
    body = {k: v for k, v in manifest.items() if k != "content_hash"}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _shards(spark: SparkSession, folder: str) -> list[dict]:
    """Name, size, digest and rows of each shard: digests are taken by tasks, only these few values come back."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    digests = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    rows = spark.read.parquet(folder).groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name")).agg(F.count(F.lit(1)).alias("samples"))
    return [r.asDict() for r in digests.join(rows, "name", "left").na.fill(0).orderBy("name").collect()]


def write_dataset(df: DataFrame, folder: str, dataset_id: str, sample_type: str, version: str, parent_version: str | None = None, order: str | None = None, rows_per_shard: int = 50_000, metadata: dict | None = None) -> dict:
    """Writes into a staging folder beside ``folder``, adds the manifest and renames. An existing folder or an empty table is an error; nothing stays behind."""
    spark, files = df.sparkSession, Files(df.sparkSession)
    if files.exists(folder):
        raise FileExistsError(folder)
    staging = f"{folder}.staging-{uuid.uuid4().hex[:8]}"
    try:
        out = df.repartitionByRange(order).sortWithinPartitions(order) if order else df
        out.write.option("maxRecordsPerFile", rows_per_shard).option("compression", "zstd").parquet(staging)
        shards = _shards(spark, staging)
        if not sum(s["samples"] for s in shards):
            raise DatasetError("refusing to publish an empty dataset")
        if any(s["bytes"] > SHARD_BYTES_MAX for s in shards):
            raise DatasetError("a shard is too large: use fewer rows per shard")
        manifest = dict(zip(KEYS, [1, FORMAT, dataset_id, sample_type, version, datetime.now(UTC).isoformat(), sum(s["samples"] for s in shards), shards, parent_version, metadata or {}], strict=False))
        manifest["content_hash"] = content_hash(manifest)
        files.write(f"{staging}/{MANIFEST}", json.dumps(manifest, ensure_ascii=False, indent=1))
        publish(spark, staging, folder)
        return manifest
    except BaseException:
        files.delete(staging)
        raise


def publish(spark: SparkSession, staging: str, folder: str, patience: float = 2.0) -> None:
    """Renames a finished folder into place, never over an existing one. A file system that refuses for a moment is asked again until ``patience`` seconds are over."""
    files, until, pause = Files(spark), time.monotonic() + patience, 0.1
    while True:
        if files.exists(folder):
            raise FileExistsError(folder)
        if files.rename(staging, folder):
            return
        if time.monotonic() + pause > until:
            raise DatasetError(f"can't publish {folder}")
        time.sleep(pause)


def load_manifest(spark: SparkSession, folder: str) -> dict:
    manifest = json.loads(Files(spark).read(f"{folder}/{MANIFEST}"))
    if set(manifest) != set(KEYS):
        raise DatasetError(f"unexpected or missing keys: {sorted(set(manifest) ^ set(KEYS))}")
    if manifest["content_hash"] != content_hash(manifest):
        raise DatasetError("the manifest was changed")
    if manifest["sample_count"] != sum(s["samples"] for s in manifest["shards"]):
        raise DatasetError("counts don't add up")
    return manifest


def verify(spark: SparkSession, folder: str) -> dict:
    """The manifest, after every shard's size, digest and rows were compared with it."""
    manifest = load_manifest(spark, folder)
    if _shards(spark, folder) != manifest["shards"]:
        raise DatasetError("shards differ from the manifest")
    return manifest


def read_dataset(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with ``global_index`` in shard order; only the wanted columns are read."""
    offsets, at = [], 0
    for s in load_manifest(spark, folder)["shards"]:
        offsets.append((s["name"], at))
        at += s["samples"]
    table = broadcast_if_small(spark.createDataFrame(offsets, "_name string, _offset long"))  # one row per shard
    df = spark.read.parquet(folder)
    df = df.select(*(columns or df.columns), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("_name"), F.col("_metadata.row_index").alias("_row")) if _has_row_index(df) else df
    return df.join(table, "_name").withColumn("global_index", F.col("_offset") + F.col("_row")).drop("_name", "_offset", "_row")


def _has_row_index(df: DataFrame) -> bool:
    return "row_index" in df.select("_metadata").schema[0].dataType.names


def rows_at(spark: SparkSession, folder: str, positions: list[int], columns: list[str] | None = None) -> DataFrame:
    """Single rows by their global index, negative ones counting from the end; an index out of range is an error. Only the shards that hold them are read."""
    shards = load_manifest(spark, folder)["shards"]
    total = sum(s["samples"] for s in shards)
    at = [p + total if p < 0 else p for p in positions]
    if any(not 0 <= p < total for p in at):
        raise IndexError(f"{positions} of {total}")
    out, first = None, 0
    for s in shards:
        own = [p - first for p in at if first <= p < first + s["samples"]]
        if own:
            df = spark.read.parquet(f"{folder}/{s['name']}")
            part = df.select(*(columns or df.columns), (F.col("_metadata.row_index") + first).alias("global_index")).where(F.col("_metadata.row_index").isin(own))
            out = part if out is None else out.unionByName(part)
        first += s["samples"]
    return out


def shard_number(index: Column, rows_per_shard: int) -> Column:
    """Stable number of the shard of a row by its global index."""
    return F.floor(index / rows_per_shard).cast("long")


def part_ranges(total: int, parts: int) -> list[tuple[int, int]]:
    """``parts`` neighbouring ranges that cover 0..total, as even as can be, the first ones larger by one; empty ones are left out."""
    size, more = divmod(total, parts)
    cuts = [i * size + min(i, more) for i in range(parts + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def merge_parts(parts: list[DataFrame], order: str) -> DataFrame:
    """Rows of several parts in the order of parts, then of ``order`` within a part: adds ``part``, by which a writer sorts."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out.repartitionByRange("part", order).sortWithinPartitions("part", order)


def selected(df: DataFrame, chosen: DataFrame, index: str = "global_index") -> DataFrame:
    """Rows of a dataset whose global index is in a selection."""
    return df.join(chosen.select(index), index, "left_semi")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both, a stored one replaced by the new one of its key; new rows must be unique by key."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def insert_missing(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both, a new one only where its key isn't stored yet; new rows must be unique by key."""
    return stored.unionByName(new.join(stored.select(key), key, "left_anti"))


def differing_keys(wanted: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(key, state) of the keys that are missing from ``got`` or unexpected in it; null keys are left out."""
    a, b = (d.where(F.col(key).isNotNull()).select(key).distinct() for d in (wanted, got))
    both = a.withColumn("_w", F.lit(1)).join(b.withColumn("_g", F.lit(1)), key, "full_outer")
    return both.where(F.col("_w").isNull() | F.col("_g").isNull()).select(key, F.when(F.col("_g").isNull(), "missing").otherwise("unexpected").alias("state"))


def preview(df: DataFrame, by: str, title: str, text: str, rows: int = 3, width: int = 300) -> str:
    """A page in Markdown with the first ``rows`` rows of each group in the order of their text's hash, texts cut to ``width``."""
    shown = bottom_k(df.select(by, F.left(text, F.lit(width)).alias("_t")).distinct(), by, F.xxhash64("_t").cast("double"), rows, "_t")
    groups: dict = {}
    for r in shown.orderBy(by, "_t").collect():  # rows per group are few, and so are groups of a report
        groups.setdefault(r[by], []).append(r["_t"])
    lines = [f"# {title}", ""]
    for name, items in groups.items():
        lines += [f"## {name}", "", *[f"- {x}".replace("\n", " ") for x in items], ""]
    return "\n".join(lines)


def write_lines(df: DataFrame, folder: str) -> None:
    """One JSON object per line, absent values left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(folder)


class Stages:
    """Finished stages of a run, one marker file each, so that a restarted run goes on behind the last.

    A run has an identity (its configuration and inputs); a folder with stages of another identity is an error, or with ``restart`` is cleared."""

    def __init__(self, spark: SparkSession, folder: str, identity: dict | None = None, restart: bool = False):
        self.files, self.folder = Files(spark), folder.rstrip("/")
        mark = hashlib.sha256(json.dumps(identity or {}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
        where = f"{self.folder}/identity"
        if restart and self.files.exists(self.folder):
            self.files.delete(self.folder)
        self.files.make(self.folder)
        if not self.files.exists(where):
            self.files.write(where, mark)
        elif self.files.read(where) != mark:
            raise DatasetError(f"{folder} holds a run of another configuration")

    def done(self, name: str) -> bool:
        return self.files.exists(f"{self.folder}/{name}.done")

    def finish(self, name: str, note: str = "") -> None:
        path = f"{self.folder}/{name}.done"
        self.files.delete(path + ".tmp")
        self.files.write(path + ".tmp", note)
        self.files.rename(path + ".tmp", path)

    def note(self, name: str) -> str:
        return self.files.read(f"{self.folder}/{name}.done")
