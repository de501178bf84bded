"""Quotas, budgets and top-k selection."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.functions.text import unit_hash
from siltworks.operators.segments import running_sum
from siltworks.operators.skew import broadcast_if_small
from siltworks.runtime import Stage

ROWS_PER_SLICE = 250_000
FOLD_ROWS = 200_000  # rows of (key, size) that one task may fold
REALLOCATION_SHARE = 0.01  # fixed value: largest share of the target that may move between sources


def largest_remainder(df: DataFrame, name: str, weight: str, target: int) -> DataFrame:
    """(name, quota) of a small table: whole parts first, what is left goes to the largest remainders, ties by name."""
    total = F.sum(weight).over(W.partitionBy())
    raw = df.select(name, (F.lit(target) * F.col(weight) / total).alias("_raw")).withColumn("_whole", F.floor("_raw").cast("long"))
    left = F.lit(target) - F.sum("_whole").over(W.partitionBy())
    place = F.row_number().over(W.orderBy(F.desc(F.col("_raw") - F.col("_whole")), name))
    return raw.select(name, (F.col("_whole") + F.when(place <= left, 1).otherwise(0)).cast("long").alias("quota"))


def rebalance(quotas: DataFrame, available: DataFrame, name: str, target: int) -> DataFrame:
    """(name, quota, available, effective): missing tokens move to sources with a surplus, in proportion to it, if they are at most one percent of the target
    and the whole is available; otherwise quotas stay. Small tables: one row per source."""
    one = W.partitionBy()
    t = quotas.join(available, name, "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))
    t = t.withColumn("_lack", F.greatest(F.col("quota") - F.col("available"), F.lit(0))).withColumn("_over", F.greatest(F.col("available") - F.col("quota"), F.lit(0)))
    lack, over = F.sum("_lack").over(one), F.sum("_over").over(one)
    t = t.withColumn("_move", (lack > 0) & (lack <= target * REALLOCATION_SHARE) & (F.sum("available").over(one) >= target) & (over >= lack))
    t = t.withColumn("_raw", F.when(F.col("_move") & (F.col("_over") > 0), lack * F.col("_over") / over).otherwise(F.lit(0.0))).withColumn("_inc", F.floor("_raw").cast("long"))
    rest = F.when(F.col("_move"), lack - F.sum("_inc").over(one)).otherwise(0)
    place = F.row_number().over(W.orderBy(F.desc(F.col("_over") > 0), F.desc(F.col("_raw") - F.col("_inc")), name))
    eff = F.when(F.col("_move"), F.col("quota") - F.col("_lack") + F.col("_inc") + F.when((F.col("_over") > 0) & (place <= rest), 1).otherwise(0)).otherwise(F.col("quota"))
    return t.withColumn("effective", eff.cast("long")).select(name, "quota", "available", "effective")


def within_budget(df: DataFrame, group: str, key: Column, size: str, quota: DataFrame, quota_column: str = "quota") -> DataFrame:
    """Rows of each group in the order of ``key`` while the sum of the sizes before them is below the group's quota (the last may overshoot).

    ``key`` must be uniform in [0, 1). Running sums are taken in two steps, over slices of the key and within a slice. A slice of a group with all rows would
    hold about ``ROWS_PER_SLICE`` rows, whatever the table. Rows meet what lies in front of their slice by (group, slice), so no group is one task."""
    slices = max(1, -(-df.count() // ROWS_PER_SLICE))
    d = df.withColumn("_key", key).withColumn("_slice", F.floor(F.col("_key") * slices).cast("int"))
    sums = d.groupBy(group, "_slice").agg(F.sum(size).alias("_s")).join(quota.select(group, quota_column), group)
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(W.partitionBy(group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # slices in front of which the quota is spent already are out before the rows are sorted
    open_ = before.where(F.col("_before") < F.col(quota_column)).drop("_s")
    inside = F.coalesce(F.sum(size).over(W.partitionBy(group, "_slice").orderBy("_key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = d.join(open_, [group, "_slice"]).withColumn("_inside", inside)
    return out.where(F.col("_before") + F.col("_inside") < F.col(quota_column)).drop("_slice", "_before", "_inside", quota_column).withColumnRenamed("_key", "selection_key")


def bottom_k(df: DataFrame, group: str, key: Column, k: int | Column, tie: str, slices: int = 32) -> DataFrame:
    """The k rows of each group with the smallest key, ties by a unique column. A first cut per (group, slice of rows) keeps at most k rows of each slice."""
    d = df.withColumn("_key", key).withColumn("_slice", F.pmod(F.xxhash64(tie), F.lit(slices)))
    k = F.lit(k) if isinstance(k, int) else k
    first = d.withColumn("_n", F.row_number().over(W.partitionBy(group, "_slice").orderBy("_key", tie))).where(F.col("_n") <= k)
    return first.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy("_key", tie))).where(F.col("_n") <= k).drop("_n", "_slice", "_key")


def stratified_holdout(df: DataFrame, stratum: str, ratio: float, key: Column, tie: str) -> DataFrame:
    """Adds ``holdout``: in each stratum of N >= 2 rows the clamp(round half even(N * ratio), 1, N - 1) rows with the smallest key."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")).withColumn("_take", F.when(F.col("_n") < 2, 0).otherwise(F.least(F.greatest(F.bround(F.col("_n") * ratio), F.lit(1)), F.col("_n") - 1)).cast("long"))
    d = df.join(broadcast_if_small(counts.select(F.col(stratum).alias("_s"), "_take")), F.col(stratum).eqNullSafe(F.col("_s")))
    picked = bottom_k(d, stratum, key, F.col("_take"), tie).select(F.col(tie).alias("_tie")).withColumn("_hit", F.lit(True))
    return d.join(picked, F.col(tie) == F.col("_tie"), "left").withColumn("holdout", F.col("_hit").isNotNull()).drop("_s", "_take", "_tie", "_hit")


def greedy_two_caps(df: DataFrame, key: str, first: str, second: str, first_caps: dict, second_caps: dict) -> DataFrame:
    """Rows in key order are taken while both their caps have room. The winners of either cap alone bound the candidates (sum of the caps), and those few
    narrow rows are folded in one task, which the sequential rule requires."""
    caps1 = F.create_map(*[x for k, v in first_caps.items() for x in (F.lit(k), F.lit(v))])
    # a row can only be taken if it is among the first sum(second caps) of its first group or the first sum(first caps) of its second
    limit = sum(first_caps.values()) + sum(second_caps.values())
    few = df.where(F.col(first).isin(list(first_caps)) & F.col(second).isin(list(second_caps)) & F.element_at(caps1, F.col(first)).isNotNull())
    few = few.withColumn("_n", F.row_number().over(W.partitionBy(first, second).orderBy(key))).where(F.col("_n") <= limit).drop("_n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left1, left2, keep = dict(first_caps), dict(second_caps), []
        for a, b in zip((pdf := pdf.sort_values(key, kind="stable"))[first], pdf[second], strict=True):
            ok = left1.get(a, 0) > 0 and left2.get(b, 0) > 0
            if ok:
                left1[a] -= 1
                left2[b] -= 1
            keep.append(ok)
        return pdf[pd.Series(keep, index=pdf.index, dtype=bool)]

    return few.groupBy(F.lit("all")).applyInPandas(run, few.schema)


def first_fit(df: DataFrame, key: str, size: str, budget: int) -> DataFrame:
    """Rows in key order (unique), each taken if it still fits the budget; sizes are positive, null sizes never fit.

    All rows up to the first that doesn't fit are taken by a running sum over ranges; then only the rows behind it that fit what is left matter, and so on, each round
    with less budget and fewer rows. Once at most ``FOLD_ROWS`` narrow rows are left, one task folds them."""
    st = Stage(df.sparkSession, "fit")
    left, taken = budget, []
    rest = st.keep(df.select(key, size).where(F.col(size) <= left))
    while rest.count() > FOLD_ROWS:
        run = st.keep(running_sum(rest, key, F.col(size)).join(rest, key))
        over = run.where(F.col("before") + F.col(size) > left).agg(F.min(key)).first()[0]
        head = run if over is None else run.where(F.col(key) < over)
        taken.append(head.select(key))
        left -= head.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        rest = st.keep(rest.where((F.lit(False) if over is None else F.col(key) > over) & (F.col(size) <= left)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        room, keep = left, []
        for n in (pdf := pdf.sort_values(key, kind="stable"))[size]:
            ok = n <= room
            room -= n if ok else 0
            keep.append(ok)
        return pdf[pd.Series(keep, index=pdf.index, dtype=bool)][[key]]

    got = rest.groupBy(F.lit("all")).applyInPandas(fold, rest.select(key).schema)
    for t in taken:
        got = got.unionByName(t)
    return df.join(got, key, "left_semi")


def byte_targets(weights: dict[str, float], total_gb: float) -> dict[str, int]:
    """round half even(total * 1e9 * w / sum(w)) per source."""
    s = math.fsum(weights.values())
    return {k: round(total_gb * 1e9 * w / s) for k, w in weights.items()}


def order_key(seed: int, *parts: Column) -> Column:
    """Uniform key in [0, 1) of a seed and identifying columns: stands in for a shuffle everywhere."""
    return unit_hash(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def mixture(weights: dict[str, float] | None = None, manifest: dict | None = None) -> dict[str, float]:
    """Shares of sources that sum to 1, from given weights or from a sampling manifest (a list ``sources``, each with ``target_bytes`` or else ``weight_gb``).

    Exactly one of both; blank or repeated names and weights that aren't positive are errors."""
    if (weights is None) == (manifest is None):
        raise ValueError("give weights or a manifest")
    pairs = list(weights.items()) if weights is not None else [(s.get("name") or "", s.get("target_bytes", s.get("weight_gb"))) for s in manifest.get("sources") or []]
    names = [str(n).strip() for n, _ in pairs]
    if not pairs or "" in names or len(set(names)) < len(names):
        raise ValueError("sources need distinct names")
    values = [float(w) for _, w in pairs]
    if min(values) <= 0:
        raise ValueError("weights must be positive")
    total = math.fsum(values)
    return {n: w / total for n, w in zip(names, values, strict=True)}


def step_budget(samples: int, tokens: int, micro_batch: int, accumulate: int, world: int, target_tokens: int | None = None, epochs: float = 1.0) -> dict:
    """Optimizer steps of a run: as many as ``epochs`` passes have whole steps, or what ``target_tokens`` need at the mean tokens per sample, rounded up, and one."""
    if samples <= 0 or tokens <= 0:
        raise ValueError("the dataset has no tokens")
    batch = micro_batch * accumulate * world
    steps = int(samples * epochs) // batch
    if target_tokens is not None:
        steps = max(1, math.ceil(target_tokens / (batch * tokens / samples)) + 1)
    elif steps <= 0:
        raise ValueError("the dataset has no whole step")
    return {"steps": steps, "samples_per_step": batch, "mean_tokens": tokens / samples, "target_tokens": target_tokens or int(tokens * epochs)}
