"""Sampling and mixing. Randomness is the hash of seed and record, so every result is repeatable and independent of partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.operators.segments import global_rank, running_sum
from siltworks.operators.selection import order_key
from siltworks.operators.skew import broadcast_if_small
from siltworks.runtime import Stage


def bernoulli_to_target(df: DataFrame, group: str, size: str, targets: DataFrame, seed: int, key: str = "doc_id", validation: float = 0.0) -> DataFrame:
    """Keeps each record with probability target / available size of its group, and routes it to train or validation by a second draw.

    ``targets`` has (group, target); a target above what is available keeps all."""
    have = df.groupBy(group).agg(F.sum(size).alias("_have")).join(targets, group)
    out = df.join(broadcast_if_small(have), group).where(order_key(seed, F.col(group), F.col(key)) < F.col("target") / F.col("_have"))
    return out.withColumn("routed", F.when(order_key(seed + 1, F.col(group), F.col(key)) < validation, "validation").otherwise("train")).drop("_have", "target")


def weighted_without_replacement(df: DataFrame, weight: str, k: int, seed: int, key: str = "doc_id") -> DataFrame:
    """k rows, the larger the weight the likelier: the largest u ** (1 / w). Rows with null or non-positive weight never come."""
    u = F.greatest(order_key(seed, F.col(key)), F.lit(1e-12))
    return df.where(F.col(weight) > 0).withColumn("priority", F.pow(u, 1 / F.col(weight))).orderBy(F.desc("priority"), key).limit(k)


def weighted_with_replacement(df: DataFrame, weight: str, n: int, seed: int, key: str) -> DataFrame:
    """n draws from a weighted table: (draw, key). Draw i falls into the cumulated weight of exactly one row; rows with null or non-positive weight never come.

    Weights are cumulated over ranges. Draws and intervals meet by cells of the unit interval, of which there are about as many as rows, so no row is compared with
    all draws and a heavy row is spread over its cells. An empty table gives no draw."""
    w = Stage(df.sparkSession, "draws").keep(df.where(F.col(weight) > 0).select(key, weight))
    m, total = w.agg(F.count(F.lit(1)), F.sum(weight)).first()
    if not m:
        return w.select(F.lit(0).cast("long").alias("draw"), key)
    cells = min(max(m, 64), 1 << 20)
    ends = running_sum(w, key, F.col(weight)).join(w, key).select(key, (F.col("before") / total).alias("_lo"), ((F.col("before") + F.col(weight)) / total).alias("_hi"))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    spans = ends.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("u", order_key(seed, F.col("draw"))).withColumn("_cell", cell(F.col("u")))
    # rounding can leave a gap at a boundary: the first row that ends above the draw is the one
    return draws.join(spans, "_cell").where("u < _hi").groupBy("draw").agg(F.min_by(key, "_hi").alias(key))


def mix_sources(df: DataFrame, group: str, weights: DataFrame, weight: str, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """n draws: a source by weight, then a record of it at a uniform place: (draw, group, key). Records of empty sources are never asked for."""
    ranked = global_rank(df.withColumn("_o", F.concat_ws("\x00", group, F.lpad(F.col(key).cast("string"), 20, "0"))), "_o")
    span = ranked.groupBy(group).agg(F.min("rank").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    some = weights.join(span.select(group), group, "left_semi")
    draws = weighted_with_replacement(some, weight, n, seed, group).join(broadcast_if_small(span), group)
    draws = draws.withColumn("rank", F.col("_lo") + F.floor(order_key(seed + 1, F.col("draw")) * F.col("_n")).cast("long")).select("draw", group, "rank")
    return draws.join(ranked.select("rank", key), "rank").select("draw", group, key)


def epoch_order(df: DataFrame, seed: int, epoch: int, key: str = "doc_id") -> DataFrame:
    """Adds ``position`` 1..n: the order of one epoch."""
    return global_rank(df.withColumn("_k", F.concat(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")), 256), F.col(key).cast("string"))), "_k").withColumnRenamed("rank", "position").drop("_k")


def rank_share(df: DataFrame, position: str, rank: int, world: int, drop_last: bool = False, pad: bool = False) -> DataFrame:
    """Every ``world``-th row from ``rank`` on (positions from 1). ``drop_last`` keeps the ranks equal by leaving rows out, ``pad`` by repeating the rank's own
    first rows."""
    out = df.where(F.pmod(F.col(position) - 1, F.lit(world)) == rank)
    if not (drop_last or pad):
        return out
    total = df.count()
    if drop_last:
        return out.where(F.col(position) <= total // world * world)
    own = len(range(rank, total, world))
    short = -(-total // world) - own
    if not short or not own:
        return out
    local = out.withColumn("_l", F.floor((F.col(position) - 1) / world))
    return out.unionByName(local.where(F.col("_l") < short).drop("_l"))


def wrap_to(df: DataFrame, position: str, n: int) -> DataFrame:
    """(draw, ...) n rows that run through the positions 1..m again and again."""
    m = df.count()
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (F.pmod("id", F.lit(max(m, 1))) + 1).alias(position))
    return draws.join(df, position)


def buffered_shuffle(df: DataFrame, position: str, window: int, seed: int) -> DataFrame:
    """Adds ``shuffled``: rows are shuffled within neighbouring blocks of ``window`` positions, as a bounded buffer would."""
    block = F.floor((F.col(position) - 1) / window)
    n = F.row_number().over(W.partitionBy("_b").orderBy(order_key(seed, F.col(position)), position))
    return df.withColumn("_b", block).withColumn("shuffled", (F.col("_b") * window + n).cast("long")).drop("_b")


def skip_rows(df: DataFrame, position: str, n: int) -> DataFrame:
    return df.where(F.col(position) > n)


def sampling_counters(df: DataFrame, group: str, size: str, chars: str, low: int, high: int, targets: DataFrame, seed: int, key: str = "doc_id", validation: float = 0.0) -> DataFrame:
    """Per group what a Bernoulli sample to target bytes saw and took: records, short, long, eligible records and bytes, selected ones, those for train and validation,
    the target and what is missing of it. Groups without a target select nothing."""
    fits = F.col(chars).between(low, high)
    seen = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("records"), F.sum(size).alias("input_bytes"), F.sum(F.when(F.col(chars) < low, 1).otherwise(0)).alias("short_records"), F.sum(F.when(F.col(chars) > high, 1).otherwise(0)).alias("long_records"),
        F.sum(fits.cast("int")).alias("eligible_records"), F.sum(F.when(fits, F.col(size)).otherwise(0)).alias("eligible_bytes"),
    )
    took = bernoulli_to_target(df.where(fits), group, size, targets, seed, key, validation)
    train = F.col("routed") == "train"
    got = took.groupBy(group).agg(
        F.count(F.lit(1)).alias("selected_records"), F.sum(size).alias("selected_bytes"), F.sum(train.cast("int")).alias("train_records"), F.sum(F.when(train, F.col(size)).otherwise(0)).alias("train_bytes"),
        F.sum((~train).cast("int")).alias("validation_records"), F.sum(F.when(~train, F.col(size)).otherwise(0)).alias("validation_bytes"),
    )
    out = seen.join(got, group, "left").join(targets.select(group, F.col("target").cast("double").alias("target_bytes")), group, "left")
    return out.na.fill(0).withColumn("missing_bytes", F.greatest(F.col("target_bytes") - F.col("selected_bytes"), F.lit(0.0)))
