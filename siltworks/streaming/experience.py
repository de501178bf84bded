"""Online sources: a bounded buffer per key, a stream mixed with stored rows, and a resumable pass over a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltworks.operators.selection import order_key


def bounded_buffer(stream: DataFrame, key: str, value: str, capacity: int) -> DataFrame:
    """(key, contents, seen): after each micro-batch the last ``capacity`` values of every key, oldest first, and how many came in all.

    State per key is bounded by the capacity; values of one micro-batch are ordered by value, so a replayed batch gives the same buffer."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen = state.get if state.exists else ([], 0)
        held = list(held)
        for f in frames:
            new = sorted(f[value].tolist())
            held = (held + new)[-capacity:]
            seen += len(new)
        state.update((held, seen))
        yield pd.DataFrame({key: [k[0]], "contents": [held], "seen": [seen]})

    kind, item = stream.schema[key].dataType.simpleString(), stream.schema[value].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, contents array<{item}>, seen long", f"contents array<{item}>, seen long", "update", GroupStateTimeout.NoTimeout)


def hybrid(stream: DataFrame, stored: DataFrame, online_share: float, seed: int, key: str) -> DataFrame:
    """Stream rows drawn with probability ``online_share``, the others replaced by the stored row with their number (``slot``), if there is one.

    ``stored`` has the stream's columns and ``slot`` 0..m-1 and must be a static table."""
    m = stored.count()
    drawn = stream.withColumn("_online", order_key(seed, F.col(key)) < online_share)
    online = drawn.where("_online").drop("_online").withColumn("origin", F.lit("online"))
    offline = drawn.where("not _online").select(F.pmod(F.xxhash64(key), F.lit(max(m, 1))).alias("slot")).join(stored, "slot").drop("slot").withColumn("origin", F.lit("offline"))
    return online.unionByName(offline)


def resume(df: DataFrame, position: str, epoch_size: int, state: dict, identity: str) -> DataFrame:
    """Rows of the running epoch that a cursor {identity, consumed} has not yet passed. ``identity`` names the table and its version (a manifest's content hash); a cursor
    of another one, or without any, is an error."""
    if state.get("identity") != identity:
        raise ValueError(f"the cursor belongs to {state.get('identity')!r}, not to {identity!r}")
    return df.where(F.col(position) > state.get("consumed", 0) % max(epoch_size, 1))


def start(identity: str) -> dict:
    """A cursor at the beginning of a table."""
    return {"identity": identity, "consumed": 0, "epoch": 0}


def advance(state: dict, rows: int, epoch_size: int) -> dict:
    consumed = state.get("consumed", 0) + rows
    return state | {"consumed": consumed, "epoch": consumed // max(epoch_size, 1)}


def counted(stream: DataFrame, name: str = "throughput") -> DataFrame:
    """Counters of rows and bytes observed while the stream runs; listeners read them by name."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.to_json(F.struct(*stream.columns)))).alias("bytes"))


def windowed_counts(stream: DataFrame, ts: str, group: str, width: str, late: str) -> DataFrame:
    """Events per time window and group with a watermark; later events than that are dropped by the engine."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), group).agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("start"), group, "events")
