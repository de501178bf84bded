"""End-to-end preparation of a corpus: clean, deduplicate, split, cut into samples, write datasets, report. Finished stages are found again after a restart."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.config import Preparation
from siltworks.operators import cleaning, dedup, schema, segments
from siltworks.sources import sinks
from siltworks.sources.files import Files

SPLITS = ("train", "validation", "diagnostic")


def split_samples(docs: DataFrame, config: Preparation, encode=segments.encoded) -> DataFrame:
    """Samples of prepared documents (doc_id, text, source, cluster, split): token windows with identifiers and counts."""
    w = config.windows
    ids = docs.select("doc_id", "source", "cluster", "split", encode(F.col("text")).alias("ids"))
    s = segments.segment_samples(ids, "ids", w.size, w.overlap, w.least)
    return s.select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":segment-"), F.lpad(F.col("segment_index").cast("string"), 5, "0")).alias("sample_id"), F.col("source").alias("source_id"), "split",
        "input_ids", "labels", "doc_id", "cluster", "segment_index", "input_tokens", "loss_tokens",
    )


def prepare(spark: SparkSession, docs: DataFrame, folder: str, dataset_id: str, version: str, config: Preparation = Preparation(), restart: bool = False, encode=segments.encoded, rows_per_shard: int = 50_000) -> dict:
    """Writes ``folder``/train, /validation and /diagnostic with a manifest each, and ``manifest.json`` over all of them; returns that.

    ``docs`` has doc_id, text, source, parent_document_id and source_priority. A run that was interrupted goes on behind its last finished stage; a finished split is
    taken as it is if its manifest still verifies. A folder of another configuration or version is an error unless ``restart`` clears it. A split without
    documents has no dataset."""
    files, root = Files(spark), folder.rstrip("/")
    identity = {"dataset": dataset_id, "version": version, "config": repr(config), "rows_per_shard": rows_per_shard}
    if restart:
        for part in (*SPLITS, "manifest.json"):
            files.delete(f"{root}/{part}")
    stages = sinks.Stages(spark, f"{root}/_stages", identity, restart)
    clean_at, ready_at = f"{root}/_stages/clean", f"{root}/_stages/ready"
    if not stages.done("clean"):
        cleaned = cleaning.clean(docs.select("doc_id", "text", "source", "parent_document_id", "source_priority"))
        cleaned.drop("text").write.mode("overwrite").parquet(clean_at)
        stages.finish("clean")
    cleaned = spark.read.parquet(clean_at)
    ok, refused = cleaning.quarantine(cleaned)
    ok = ok.withColumnRenamed("clean_text", "text")
    if not stages.done("ready"):
        clusters = dedup.assign_clusters(ok, dedup.duplicate_groups(ok))
        ok.join(clusters, "doc_id").write.mode("overwrite").parquet(ready_at)
        stages.finish("ready")
    ready = spark.read.parquet(ready_at)
    torn = dedup.leak_audit(ready, "cluster", "split").limit(1).count()
    if torn:
        raise sinks.DatasetError("a cluster lies in several splits")
    parts: dict[str, dict] = {}
    samples = split_samples(ready, config, encode)
    for split in SPLITS:
        at = f"{root}/{split}"
        if not stages.done(split):
            files.delete(at)
            own = schema.to_storage(samples.where(F.col("split") == split).withColumn("dataset_id", F.lit(dataset_id)), "pretraining")
            if own.limit(1).count():
                sinks.write_dataset(own, at, dataset_id, "pretraining", version, order="sample_id", rows_per_shard=rows_per_shard, metadata=totals(samples.where(F.col("split") == split)))
            stages.finish(split)
        if files.exists(at):
            manifest = sinks.verify(spark, at)
            parts[split] = {"path": split, "content_hash": manifest["content_hash"], "samples": manifest["sample_count"], **manifest["metadata"]}
    reasons = {r["reason"]: r["n"] for r in refused.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = ready.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("doc_id") == F.col("canonical_id"), 1)).alias("c")).first()
    out = {"schema_version": 1, "dataset_id": dataset_id, "version": version, "documents": {"accepted": kept["n"], "canonical": kept["c"], "refused": reasons}, "splits": parts}
    out["content_hash"] = sinks.content_hash(out)
    if not files.exists(f"{root}/manifest.json"):
        files.write(f"{root}/manifest.json", json.dumps(out, ensure_ascii=False, indent=1))
    return out


def totals(samples: DataFrame) -> dict:
    """Counts that a split's manifest carries; the step budget is read from them."""
    r = samples.agg(F.countDistinct("doc_id").alias("documents"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("loss_tokens"), F.lit(0)).alias("loss_tokens")).first()
    return {k: int(v) for k, v in r.asDict().items()}
