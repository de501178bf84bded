"""Problem 5: mixing sources to target weights.

Bytes are summed per source, a repetition rate follows per plan and source, and each record is emitted ``floor(rate)``
times plus one hash-seeded Bernoulli copy with the probability of the fraction. Everything that grows with the corpus is
one narrow pass with map-side combining; what is joined to it is the plan table (a few rows per plan), whose join with
a third of all rows in one source needs no shuffle of the documents by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import fold_name, unit_hash
from siltworks.operators.skew import broadcast_if_small
from siltworks.runtime import Stage

PLAN_ROWS_MAX = 20_000  # the plan table is written by hand; beyond this it is joined by a shuffle instead of a broadcast


def plan_targets(configs: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per plan and source with its target.

    Names are trimmed and lower-cased, repeated rows count once (differing weights of one name: the largest), rows with
    null, zero or negative weight, blank names or unknown plans take no part. The target is
    ``target_total_gb * 1e9 * weight / sum(weights of the plan)``.
    """
    weights = (
        sources.select("config_id", fold_name(F.col("name")).alias("name"), F.col("weight_gb").cast("double").alias("weight_gb"))
        .where("name is not null and weight_gb > 0 and not isnan(weight_gb)")
        .groupBy("config_id", "name")
        .agg(F.max("weight_gb").alias("weight_gb"))
    )
    total = weights.groupBy("config_id").agg(F.sum("weight_gb").alias("weight_sum"))
    plan = configs.select("config_id", "target_total_gb", "seed", "min_chars", "max_chars", "max_repeats").dropDuplicates(["config_id"])
    return (
        weights.join(total, "config_id")
        .join(plan, "config_id")
        .withColumn("target_bytes", F.col("target_total_gb") * F.lit(1e9) * F.col("weight_gb") / F.col("weight_sum"))
    )


def _sized(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", F.col("source").alias("name"), F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))


def _in_range() -> Column:
    return (F.col("chars") >= F.col("min_chars")) & (F.col("chars") <= F.col("max_chars"))


def source_rates(docs: DataFrame, configs: DataFrame, sources: DataFrame) -> DataFrame:
    """Per plan and source: target, available bytes (texts within the plan's length bounds), repetition rate and whether the target
    can be reached with ``max_repeats``. A source without eligible text has rate 0 and cannot reach; null texts have no bytes;
    a null ``max_repeats`` counts as 1."""
    plan = Stage(docs.sparkSession, "plan").keep(plan_targets(configs, sources))
    # lengths are first reduced to one row per source and plan bounds: the bounds are few, the documents many
    bounds = broadcast_if_small(plan.select("config_id", "name", "min_chars", "max_chars"), PLAN_ROWS_MAX)
    have = (
        _sized(docs).join(bounds, "name").where(_in_range())
        .groupBy("config_id", "name")
        .agg(F.sum("bytes").alias("available_bytes"), F.count(F.lit(1)).alias("records"))
    )
    repeats = F.coalesce("max_repeats", F.lit(1)).cast("double")
    need = F.col("target_bytes") / F.col("available_bytes")
    return (
        plan.join(have, ["config_id", "name"], "left")
        .withColumn("available_bytes", F.coalesce("available_bytes", F.lit(0).cast("long")))
        .withColumn("records", F.coalesce("records", F.lit(0).cast("long")))
        .withColumn("reachable", F.col("available_bytes") * repeats >= F.col("target_bytes"))
        .withColumn("rate", F.when(F.col("available_bytes") > 0, F.least(need, repeats)).otherwise(F.lit(0.0)))
    )


def copies(rate: Column, seed: Column, config_id: Column, doc_id: Column) -> Column:
    """floor(rate) copies plus one with the probability of the fraction, drawn from the hash of seed, plan and record."""
    whole = F.floor(rate).cast("int")
    draw = unit_hash(F.concat_ws(":", seed.cast("string"), config_id, doc_id.cast("string")))
    return whole + F.when(draw < rate - whole, 1).otherwise(0)


def kept_rates(docs: DataFrame, configs: DataFrame, sources: DataFrame) -> DataFrame:
    """:func:`source_rates` as a table: one row per plan and source, computed by one pass over the documents."""
    return Stage(docs.sparkSession, "rates").keep(source_rates(docs, configs, sources))


def mix(docs: DataFrame, configs: DataFrame, sources: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """(config_id, name, doc_id, bytes, copies) of every record that a plan uses at least once."""
    rates = kept_rates(docs, configs, sources) if rates is None else rates
    used = rates.select("config_id", "name", "seed", "rate", "min_chars", "max_chars").where("rate > 0")
    return (
        _sized(docs).join(broadcast_if_small(used, PLAN_ROWS_MAX), "name").where(_in_range())
        .select("config_id", "name", "doc_id", "bytes", copies(F.col("rate"), F.col("seed"), F.col("config_id"), F.col("doc_id")).alias("copies"))
        .where("copies > 0")
    )


def mix_shares(docs: DataFrame, configs: DataFrame, sources: DataFrame) -> DataFrame:
    """Reached against planned: bytes emitted per plan and source, and the share each has of its plan."""
    st = Stage(docs.sparkSession, "shares")
    rates = kept_rates(docs, configs, sources)
    got = st.keep(mix(docs, configs, sources, rates).groupBy("config_id", "name").agg(F.sum(F.col("bytes") * F.col("copies")).alias("mixed_bytes"), F.sum("copies").alias("mixed_records")))
    total = got.groupBy("config_id").agg(F.sum("mixed_bytes").alias("plan_bytes"))
    return (
        rates.join(got, ["config_id", "name"], "left").join(total, "config_id", "left")
        .select(
            "config_id", "name",
            F.round(F.col("weight_gb") / F.col("weight_sum"), 9).alias("target_share"),
            F.round("rate", 6).alias("rate"),
            F.coalesce("mixed_records", F.lit(0)).cast("long").alias("mixed_records"),
            F.coalesce("mixed_bytes", F.lit(0)).cast("long").alias("mixed_bytes"),
            F.round(F.coalesce(F.col("mixed_bytes") / F.col("plan_bytes"), F.lit(0.0)), 9).alias("actual_share"),
        )
    )


def unreachable_sources(docs: DataFrame, configs: DataFrame, sources: DataFrame) -> DataFrame:
    return source_rates(docs, configs, sources).where(~F.col("reachable")).select("config_id", "name")
