"""Counters, distributions and quality reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.operators.segments import global_rank

#: Quantile rules differ on purpose; each keeps its own name.


def nearest_rank(x: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) within group (order by {x})")


def interpolated(x: str, p: float) -> Column:
    return F.percentile(x, p)


def floor_index(df: DataFrame, group: str, x: str, ps: list[float]) -> DataFrame:
    """(group, p<percent>...): the value at index int((n - 1) * p) of the sorted values, found by counting per value, so a large group isn't collected."""
    hist = df.where(F.col(x).isNotNull()).groupBy(group, x).agg(F.count(F.lit(1)).alias("_c"))
    upto = hist.withColumn("_upto", F.sum("_c").over(W.partitionBy(group).orderBy(x))).withColumn("_n", F.sum("_c").over(W.partitionBy(group)))
    return upto.groupBy(group).agg(*[F.min(F.when(F.col("_upto") > F.floor((F.col("_n") - 1) * p), F.col(x))).alias(f"p{round(p * 100)}") for p in ps], F.max(x).alias("largest"))


def weighted_quantile(df: DataFrame, value: str, count: str, p: float) -> DataFrame:
    """One row: the first value whose cumulated count reaches total * p."""
    per = df.groupBy(value).agg(F.sum(count).alias("_c"))
    run = per.withColumn("_upto", F.sum("_c").over(W.orderBy(value))).withColumn("_t", F.sum("_c").over(W.partitionBy()))
    return run.where(F.col("_upto") >= F.col("_t") * p).agg(F.min(value).alias("quantile"))


def shares(df: DataFrame, group: str, measure: str, reference: dict[str, float] | None = None) -> DataFrame:
    """Share of each group in the whole and its difference from a reference share."""
    per = df.groupBy(group).agg(F.sum(measure).alias("total"))
    out = per.withColumn("share", F.round(F.col("total") / F.sum("total").over(W.partitionBy()), 9))
    if reference:
        table = F.create_map(*[F.lit(x) for kv in reference.items() for x in kv])
        out = out.withColumn("delta", F.round(F.col("share") - F.coalesce(F.try_element_at(table, F.col(group)), F.lit(0.0)), 9))
    return out


def entropy_and_gini(counts: DataFrame, n: str) -> DataFrame:
    """One row over (item, n): items, total, entropy in bits, normalised entropy, Gini coefficient. Ranks come from a histogram of counts, which is small."""
    hist = counts.groupBy(n).agg(F.count(F.lit(1)).alias("m"))
    c = F.col(n)
    h = hist.withColumn("before", F.coalesce(F.sum("m").over(W.orderBy(n).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranks = F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2  # sum of the ranks of the items with this count
    s = h.agg(F.sum("m").alias("items"), F.sum(c * F.col("m")).alias("total"), F.sum(F.col("m") * c * F.log2(c)).alias("clogc"), F.sum(ranks * c).alias("rc"))
    ent = F.log2("total") - F.col("clogc") / F.col("total")
    return s.select(
        F.col("items").cast("long").alias("items"), F.col("total").cast("long").alias("total"), F.round(ent, 6).alias("entropy_bits"),
        F.round(F.when(F.col("items") > 1, ent / F.log2("items")).otherwise(0.0), 6).alias("normalised_entropy"),
        F.round((2 * F.col("rc")) / (F.col("items") * F.col("total")) - (F.col("items") + 1) / F.col("items"), 6).alias("gini"),
    )


#: Character classes of the text profile, ASCII and explicit ranges so that every engine agrees.
PROFILE_CLASSES = {"latin": "[A-Za-z]", "digits": "[0-9]", "cjk": r"[\x{4E00}-\x{9FFF}]", "ascii_space": "[ \t\n\r]", "ascii_punctuation": r"[!-/:-@\[-`{-~]"}


def text_profile(df: DataFrame, text: str = "text", by: tuple[str, ...] = ("language", "source")) -> DataFrame:
    """Character-class ratios overall and per grouping column, in one pass over the texts by GROUPING SETS."""
    counts = {k: (F.length(text) - F.length(F.regexp_replace(text, p, ""))) for k, p in PROFILE_CLASSES.items()}
    base = df.where(F.col(text).isNotNull()).select(*by, F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), *[v.alias(k) for k, v in counts.items()])
    sets = [[], *[[F.col(b)] for b in by]]
    ratio = lambda k: F.round(F.coalesce(F.try_divide(F.sum(k), F.sum("chars")), F.lit(0.0)), 9).alias(f"{k}_ratio")
    return base.groupingSets(sets, *[F.col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("texts"), F.sum("chars").alias("chars"), F.sum("bytes").alias("bytes"), *[ratio(k) for k in counts], F.round(F.coalesce(F.try_divide(F.sum("bytes"), F.sum("chars")), F.lit(0.0)), 9).alias("bytes_per_char"),
    )


def rating(value: Column, strong: float, reasonable: float, smaller_is_better: bool = False) -> Column:
    better = (lambda a, b: a <= b) if smaller_is_better else (lambda a, b: a >= b)
    return F.when(better(value, F.lit(strong)), "strong").when(better(value, F.lit(reasonable)), "reasonable").otherwise("weak")


def overlap(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """One row: distinct keys of both sides, shared ones, and their share of the smaller side."""
    a, b = left.select(key.alias("k")).where("k is not null").distinct(), right.select(key.alias("k")).where("k is not null").distinct()
    both = a.select("k", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select("k", F.lit(0).alias("l"), F.lit(1).alias("r"))).groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    s = both.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("left_items"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_items"), F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("shared"))
    return s.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("shared"), F.least("left_items", "right_items")), F.lit(0.0)), 9))


def loss_summary(df: DataFrame, loss: str, tokens: str, bytes_: str | None = None) -> DataFrame:
    """Token-weighted cross entropy (nats), perplexity, largest loss and bits per byte. One row."""
    t, s = F.sum(tokens), F.sum(F.col(loss) * F.col(tokens))
    cols = [F.round(s / t, 6).alias("cross_entropy"), F.round(F.exp(s / t), 6).alias("perplexity"), F.round(F.max(loss), 6).alias("largest")]
    if bytes_:
        cols.append(F.round(s / (F.sum(bytes_) * F.log(F.lit(2.0))), 6).alias("bits_per_byte"))
    return df.agg(*cols)


def recent_window(df: DataFrame, order: str, value: str, n: int = 100, block: int = 100_000) -> DataFrame:
    """Per row mean, variance (population) and first-to-last change of the last n values in the order of a unique column.

    Rows are numbered over ranges and cut into blocks; the last n - 1 rows of a block are also read in front of the next one, so no task sees the whole table."""
    ranked = global_rank(df.select(order, value), order)
    here = F.floor((F.col("rank") - 1) / block)
    ahead = F.floor((F.col("rank") + n - 2) / block)
    d = ranked.withColumn("_own", here).withColumn("_block", F.explode(F.array_distinct(F.array(here, ahead))))
    w = W.partitionBy("_block").orderBy("rank").rowsBetween(-(n - 1), 0)
    out = d.withColumn("window_mean", F.avg(value).over(w)).withColumn("window_variance", F.var_pop(value).over(w)).withColumn("window_change", F.col(value) - F.first(value).over(w))
    return out.where(F.col("_own") == F.col("_block")).drop("_own", "_block", "rank")


def early_stop(values: Column, patience: int, min_delta: float = 0.0, mode: str = "min") -> Column:
    """Index (from 1) at which training stops for want of improvement, null if it doesn't; an ordered fold over a series of evaluations."""
    sign = 1.0 if mode == "min" else -1.0
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("stop"))

    def step(s: Column, v: Column) -> Column:
        better = v * sign < s["best"] - min_delta
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        i = s["i"] + 1
        return F.struct(F.when(better, v * sign).otherwise(s["best"]).alias("best"), bad.alias("bad"), i.alias("i"), F.coalesce(s["stop"], F.when(bad >= patience, i)).alias("stop"))

    return F.aggregate(F.transform(values, lambda x: x.cast("double")), start, step, lambda s: s["stop"])


def ema(values: Column, alpha: float) -> Column:
    """Exponential moving average at the end of a series; the first value starts it."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, v: F.when(a.isNull(), v).otherwise(a * (1 - alpha) + v * alpha))


def character_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) of all characters of all texts. Each task counts its batches, so a few thousand rows per batch are shuffled, not one per character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(0x110000, np.int64)
            for t in batch.column(0):
                cp = np.frombuffer(t.as_py().encode("utf-32-le", "surrogatepass"), np.uint32)
                total[: 0 if not len(cp) else int(cp.max()) + 1] += np.bincount(cp) if len(cp) else 0
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(map(chr, used), pa.string()), pa.array(total[used], pa.int64())], names=["token", "n"])

    return df.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
