"""From a written dataset to batches: read, sample, pack, batch, as a configuration says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.config import ConfigurationError, Data
from siltworks.operators import sampling, segments, selection
from siltworks.operators.tasks import padding_free, task
from siltworks.sources import sinks


def ordered(df: DataFrame, config: Data, epoch: int, rank: int = 0, world: int = 1) -> DataFrame:
    """Rows of one rank in one epoch with their ``position`` (from 1 per rank)."""
    s = config.sampling
    if s.shuffle and s.strategy != "sequential":
        ranked = sampling.epoch_order(df, s.seed, epoch, "global_index")
    else:
        ranked = df.withColumn("position", F.col("global_index") + 1)
    own = sampling.rank_share(ranked, "position", rank, world, drop_last=s.drop_last, pad=s.pad_to_world_size and not s.drop_last)
    return own.withColumn("position", (F.floor((F.col("position") - 1) / world) + 1).cast("long"))


def batches(spark: SparkSession, config: Data, split: str = "train", epoch: int = 0, rank: int = 0, world: int = 1) -> DataFrame:
    """One row per batch of a rank: the task's arrays, packed and padded as configured.

    A stream is cut into sequences per micro-batch (a short last one is left out with ``drop_last_remainder``); isolated samples share a sequence and never lie in two."""
    config.check()
    folder, t = config.storage.path_for(split), task(config.task)
    if config.storage.verify_checksums:
        sinks.verify(spark, folder)
    manifest = sinks.load_manifest(spark, folder)
    if manifest["sample_type"] != t.sample_type:
        raise ConfigurationError(f"{folder} holds {manifest['sample_type']} samples, the task needs {t.sample_type}")
    if manifest["dataset_id"] != config.dataset_id:
        raise ConfigurationError(f"{folder} holds the dataset {manifest['dataset_id']}")
    rows = ordered(sinks.read_dataset(spark, folder), config, epoch, rank, world)
    size, p = config.batching.micro_batch_size, config.packing
    if p.enabled and p.strategy == "stream":
        # one row per position, so ties can't occur unless a rank repeats its own rows; those have positions of their own
        packed = segments.stream_pack(rows, "position", "input_ids", p.max_seq_length, size)
        if p.drop_last_remainder:
            packed = packed.where(F.size("input_ids") == p.max_seq_length)
        one = packed.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("sequence", "input_ids", "labels"))).alias("_r"))
        width = segments.padded_length(F.array_max(F.transform("_r", lambda r: F.size(r["input_ids"]))), p.pad_to_multiple_of)
        pad = lambda c, v: F.transform("_r", lambda r: segments.pad_right(r[c], F.col("_w"), F.lit(v))).alias(c)
        return one.withColumn("_w", width).select("batch", pad("input_ids", config.pad_id), pad("labels", segments.IGNORE))
    placed = segments.batches(rows, "position", size)
    if p.enabled:
        sized = placed.withColumn("_n", F.size("input_ids"))
        placed = segments.isolated_pack(sized, "batch", "place", "_n", p.max_seq_length).drop("_n")
    if config.batching.strategy == "padding_free":
        return padding_free(placed, "batch", "place")
    return t.batch(placed, "batch", "place", config.pad_id) if t.sample_type != "pretraining" else t.batch(placed, "batch", "place", config.pad_id, config.batching.pad_to_multiple_of)


def budget(spark: SparkSession, config: Data, accumulate: int, world: int, target_tokens: int | None = None, epochs: float = 1.0) -> dict:
    """Steps of a run over the train split, by the counts of its manifest; where it has none, by the tokens of its rows."""
    manifest = sinks.load_manifest(spark, config.storage.path_for("train"))
    tokens = manifest["metadata"].get("input_tokens")
    if tokens is None:
        tokens = sinks.read_dataset(spark, config.storage.path_for("train"), ["input_ids"]).agg(F.sum(F.size("input_ids"))).first()[0] or 0
    return selection.step_budget(manifest["sample_count"], int(tokens), config.batching.micro_batch_size, accumulate, world, target_tokens, epochs)
