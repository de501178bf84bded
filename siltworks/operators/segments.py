"""Token windows, segment samples, packing and batches as array expressions."""

from __future__ import annotations


from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.operators.skew import broadcast_if_small
from siltworks.runtime import Stage

ROWS_PER_RANGE = 250_000
IGNORE = -100  # fixed value: label that takes no part in the loss


def code_points(text: Column) -> Column:
    """Array of code points: the encoder that needs no vocabulary. An expression, so it may stand inside others; for a whole column :func:`encoded` is far cheaper."""
    return F.transform(F.split(text, ""), lambda c: F.ascii(c))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def encoded(text: pa.Array) -> pa.Array:
    """Code points of a column of texts; null stays null. Bytes become one flat array of numbers per batch, without an object per character."""
    parts = [b"" if t is None else t.encode("utf-32-le", "surrogatepass") for t in text.to_pylist()]
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
    flat = np.frombuffer(b"".join(parts), np.uint32).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=text.is_null())


def window_count(n: Column, size: int, overlap: int) -> Column:
    """Number of windows of ``size`` with ``overlap`` over n tokens; 0 for none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    stride = size - overlap
    return F.when(n < 1, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / stride)).cast("int")


def sliding_windows(df: DataFrame, n: str, size: int = 2046, overlap: int = 128, least: int = 32) -> DataFrame:
    """One row per window: segment_index, start_token, end_token, overlap_tokens, new_tokens and flags. Closed form, no state."""
    stride = size - overlap
    k = window_count(F.col(n), size, overlap)
    out = df.withColumn("segments", k).where("segments > 0").withColumn("segment_index", F.explode(F.expr("sequence(0, segments - 1)")))
    start = F.col("segment_index") * stride
    out = out.withColumn("start_token", start).withColumn("end_token", F.least(start + size, F.col(n)).cast("int"))
    first, last = F.col("segment_index") == 0, F.col("segment_index") == F.col("segments") - 1
    out = out.withColumn("overlap_tokens", F.when(first, 0).otherwise(F.least(F.lit(overlap), F.col("end_token") - F.col("start_token"))).cast("int"))
    out = out.withColumn("new_tokens", (F.col("end_token") - F.col("start_token") - F.col("overlap_tokens")).cast("int"))
    return out.withColumns(
        {
            "has_bos": first, "has_eos": last, "short_document": F.col(n) < least, "long_document": F.col(n) > size,
            "tail_fragment": last & ~first & (F.col("new_tokens") < least),
            "input_tokens": (F.col("end_token") - F.col("start_token") + first.cast("int") + last.cast("int")).cast("int"),
            "loss_tokens": (F.col("new_tokens") + last.cast("int")).cast("int"),
        }
    )


def segment_samples(df: DataFrame, ids: str, size: int = 2046, overlap: int = 128, least: int = 32, bos: int = 1, eos: int = 2) -> DataFrame:
    """Windows with their arrays: input ids (BOS on the first, EOS on the last) and labels (BOS and repeated tokens ignored)."""
    w = sliding_windows(df.withColumn("token_count", F.size(ids)), "token_count", size, overlap, least)
    content = F.slice(F.col(ids), F.col("start_token") + 1, F.col("end_token") - F.col("start_token"))
    none = F.array().cast("array<int>")
    head, tail = F.when(F.col("has_bos"), F.array(F.lit(bos))).otherwise(none), F.when(F.col("has_eos"), F.array(F.lit(eos))).otherwise(none)
    fresh = F.slice(F.col(ids), F.col("start_token") + F.col("overlap_tokens") + 1, F.col("new_tokens"))
    return w.withColumn("input_ids", F.concat(head, content, tail)).withColumn(
        "labels", F.concat(F.when(F.col("has_bos"), F.array(F.lit(IGNORE))).otherwise(none), F.array_repeat(F.lit(IGNORE), F.col("overlap_tokens")), fresh, tail)
    )


def truncate(ids: Column, n: int, side: str = "left") -> Column:
    """The last (``left`` is cut) or first n tokens."""
    if side == "left":
        return F.when(F.size(ids) <= n, ids).otherwise(F.slice(ids, -n, n))
    return F.slice(ids, 1, n)


def pad_right(x: Column, length: Column, value: Column) -> Column:
    return F.concat(x, F.array_repeat(value, F.greatest(length - F.size(x), F.lit(0))))


def padded_length(longest: Column, multiple: int) -> Column:
    return (F.ceil(longest / multiple) * multiple).cast("int")


def batches(df: DataFrame, order: str, size: int, drop_last: bool = False, by: str | None = None) -> DataFrame:
    """Adds ``batch`` and ``place`` in the order of a unique column. Numbering is by range: counts per range are summed, rows are numbered within
    their range, so no single task orders the table."""
    ranked = global_rank(df, order)
    out = ranked.withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("long")).withColumn("place", F.pmod(F.col("rank") - 1, F.lit(size)).cast("int"))
    if drop_last:
        full = df.count() // size
        out = out.where(F.col("batch") < full)
    return out.drop("rank")


def running_sum(df: DataFrame, order: str, value: Column) -> DataFrame:
    """(order, before): the sum of ``value`` over all rows in front, in the order of a unique column; narrow rows only.

    The ranges are drawn from a sample, so the partitioned rows are written once: summing and numbering must see the same ranges. Their number follows
    from the number of rows, so a range stays of one size whatever the table."""
    st = Stage(df.sparkSession, "running")
    ranges = max(1, -(-df.count() // ROWS_PER_RANGE))
    parts = df.select(order, value.alias("_v")).repartitionByRange(ranges, order).withColumn("_part", F.spark_partition_id())
    upto = F.coalesce(F.sum("_v").over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = st.keep(parts.withColumn("_in", upto))
    sums = parts.groupBy("_part").agg(F.sum("_v").alias("_s"))
    # one row per range
    front = sums.withColumn("_front", F.coalesce(F.sum("_s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    return parts.join(broadcast_if_small(st.keep(front)), "_part").select(order, (F.col("_front") + F.col("_in")).alias("before"))


def global_rank(df: DataFrame, order: str) -> DataFrame:
    """Adds ``rank`` 1, 2, ... in the order of a unique column. Only that column is sorted by range; wide rows meet their rank in a join."""
    ranks = running_sum(df, order, F.lit(1).cast("long")).select(order, (F.col("before") + 1).alias("rank"))
    return ranks if df.columns == [order] else df.join(ranks, order)


def stream_pack(df: DataFrame, order: str, ids: str, length: int, size: int, encode: Callable[[Column], Column] | None = None) -> DataFrame:
    """Concatenates the ids of each micro-batch of ``size`` rows and cuts at ``length``; labels ignore the first token of a document inside a sequence. The tail is
    kept short. One micro-batch is the unit, so memory is bounded by it.

    (batch, sequence, input_ids, labels, document_ids). Expressions run per document; tokens are only sliced and joined. With ``encode``, an encoder that works
    character by character, the column ``ids`` holds texts: they are far smaller than their tokens, so they are what is shuffled."""
    b = batches(df, order, size)
    count_of = F.size if encode is None else F.length
    one = b.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("place", ids))).alias("rows"))
    # the start of each document in the joined ids, empty ones left out
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<place:int,start:int,stop:int>>").alias("runs"))

    def run(s: Column, r: Column) -> Column:
        n = count_of(r[ids])
        one_run = F.array(F.struct(r["place"].cast("int").alias("place"), s["at"].alias("start"), (s["at"] + n).alias("stop")))
        return F.struct((s["at"] + n).alias("at"), F.when(n > 0, F.concat(s["runs"], one_run)).otherwise(s["runs"]).alias("runs"))

    parts = F.transform("rows", lambda r: r[ids])
    joined = F.flatten(parts) if encode is None else encode(F.array_join(parts, ""))
    out = one.select("batch", joined.alias("ids"), F.aggregate("rows", begin, run, lambda s: s["runs"]).alias("runs")).where(F.size("ids") > 0)

    def cut(k: Column) -> Column:
        lo, hi = k * length, (k + 1) * length
        inside = F.transform(F.filter("runs", lambda r: (r["start"] < hi) & (r["stop"] > lo)), lambda r: F.struct(r["place"].alias("place"), F.greatest(r["start"], lo).alias("from"), F.least(r["stop"], hi).alias("to")))
        # only the cut stretch goes on: a row of each sequence must not carry all ids of its micro-batch
        return F.struct(k.alias("sequence"), F.slice("ids", lo + 1, F.lit(length)).alias("input_ids"), F.transform(inside, lambda r: F.struct(r["place"].alias("place"), (r["from"] - lo).alias("from"), (r["to"] - r["from"]).alias("n"))).alias("inside"))

    count = F.ceil(F.size("ids") / length).cast("int")
    out = out.select("batch", F.explode(F.transform(F.sequence(F.lit(0), count - 1), cut)).alias("c")).select("batch", "c.*")
    ignore = F.array(F.lit(IGNORE))
    fresh = F.transform("inside", lambda r: F.when(r["from"] > 0, F.concat(ignore, F.slice("input_ids", r["from"] + 2, r["n"] - 1))).otherwise(F.slice("input_ids", r["from"] + 1, r["n"])))
    owners = F.transform("inside", lambda r: F.array_repeat(r["place"], r["n"]))
    return out.select("batch", "sequence", "input_ids", F.flatten(fresh).alias("labels"), F.flatten(owners).alias("document_ids"))


def isolated_pack(df: DataFrame, group: str, order: str, size: str, capacity: int) -> DataFrame:
    """Next-fit packing of whole samples per group in order: adds ``sequence``. A sample above the capacity is an error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        at, used, out = 0, 0, []
        for n in pdf[size]:
            if n > capacity:
                raise ValueError(f"a sample of {n} exceeds the capacity {capacity}")
            if used and used + n > capacity:
                at, used = at + 1, 0
            used += n
            out.append(at)
        return pdf.assign(sequence=pd.Series(out, index=pdf.index, dtype="int64"))

    return df.groupBy(group).applyInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, sequence long")


def position_ids(segments: Column) -> Column:
    """Positions that restart at each change of segment; padding (negative) has position 0 and doesn't end a run."""
    start = F.struct(F.lit(None).cast("int").alias("seg"), F.lit(0).alias("next"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        x = x.cast("int")
        same = s["seg"].eqNullSafe(x)
        here = F.when(same, s["next"]).otherwise(0)
        kept = F.struct(s["seg"].alias("seg"), s["next"].alias("next"), F.concat(s["out"], F.array(F.lit(0))).alias("out"))
        moved = F.struct(x.alias("seg"), (here + 1).alias("next"), F.concat(s["out"], F.array(here)).alias("out"))
        return F.when(x < 0, kept).otherwise(moved)

    return F.aggregate(segments, start, step, lambda s: s["out"])


def combined_segments(segment: Column, document: Column) -> Column:
    """One id per (segment, document): (segment + 1) * 1000003 + document, padding stays -1."""
    return F.zip_with(segment, document, lambda s, d: F.when((s < 0) & (d < 0), F.lit(-1)).otherwise((s.cast("long") + 1) * 1000003 + d))


def visible(segments: Column, mask: Column) -> Column:
    """For each position the number of positions it may attend to: earlier or same, same non-negative segment, unmasked."""
    return F.transform(segments, lambda s, i: F.size(F.filter(F.sequence(F.lit(0), i), lambda j: (s >= 0) & (F.get(segments, j) == s) & (F.get(mask, j) == 1))))


def visible_pairs(n: Column) -> Column:
    """Sum of :func:`visible` over a segment of n unmasked positions, without its arrays."""
    return (n.cast("long") * (n.cast("long") + 1) / 2).cast("long")


def packing_efficiency(lengths: DataFrame, order: str, n: str, size: int, length: int) -> DataFrame:
    """Padding of micro-batches of ``size`` rows packed into sequences of ``length``; an incomplete last batch is dropped. One row."""
    per = batches(lengths.select(order, n), order, size, drop_last=True).groupBy("batch").agg(F.sum(n).alias("t"))
    seqs = F.greatest(F.lit(1), F.ceil(F.col("t") / length))
    out = per.agg((F.count(F.lit(1)) * size).alias("raw_samples"), F.coalesce(F.sum("t"), F.lit(0)).alias("content_tokens"), F.coalesce(F.sum(seqs), F.lit(0)).cast("long").alias("packed_sequences"))
    pad = F.col("packed_sequences") * length
    return out.withColumn("padded_tokens", pad).withColumn("padding_tokens", pad - F.col("content_tokens")).withColumn(
        "padding_ratio", F.round(F.when(pad > 0, (pad - F.col("content_tokens")) / pad).otherwise(0.0), 9)
    )


def optimizer_steps(lengths: DataFrame, order: str, n: str, size: int, length: int, accumulate: int, world: int) -> DataFrame:
    """Mean tokens per optimizer step of ``size * accumulate * world`` rows. One row."""
    micro = accumulate * world
    total = lengths.count() // (size * micro)
    per = batches(lengths.select(order, n), order, size).groupBy("batch").agg(F.sum(n).alias("t")).where(F.col("batch") < total * micro)
    seqs = F.greatest(F.lit(1), F.ceil(F.col("t") / length)).cast("long")
    agg = per.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("content"), F.coalesce(F.sum(seqs), F.lit(0)).alias("seqs"))
    steps = F.lit(total)
    return agg.select(
        steps.cast("long").alias("steps"), F.round(F.when(steps > 0, F.col("content") / steps).otherwise(0.0), 6).alias("mean_content_tokens"),
        F.round(F.when(steps > 0, F.col("seqs") * length / steps).otherwise(0.0), 6).alias("mean_padded_tokens"),
        F.round(F.when(steps > 0, F.col("seqs") / steps).otherwise(0.0), 6).alias("mean_sequences"),
    )


