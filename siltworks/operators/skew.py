"""Joins on keys of which a few hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1 / 256
ROWS_OF_ONE_TASK = 100_000


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, least: int = 1000) -> list:
    """Keys that hold more than ``share`` of all rows (so at most ``1 / share`` keys): counted with map-side combining, exact. A table of which one task could hold
    all rows has none: its joins need no care."""
    total = df.count()
    if total <= ROWS_OF_ONE_TASK:
        return []
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in counts.where(F.col("_n") > max(total * share, least)).select(key).collect()]


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None, merge: bool = False) -> DataFrame:
    """``left.join(right, key, how)`` for inner, left, left_semi and left_anti with ``right`` unique on ``key``.

    Rows of ``left`` with a hot key meet the at most ``1 / HOT_SHARE`` rows of ``right`` with those keys by broadcast, a proven bound;
    all other rows take the shuffled join. No row is dropped or repeated. ``merge`` forbids the optimizer to broadcast the other rows of ``right`` on
    an estimate, for tables that are rewritten in rounds."""
    hot = hot_keys(left, key) if hot is None else hot
    other = right.hint("merge") if merge else right
    if not hot:
        return left.join(other, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(right.where(F.col(key).isin(hot)))
    return left.where(~is_hot).join(other, key, how).unionByName(left.where(is_hot).join(few, key, how))


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The table with a broadcast hint if it has at most ``most`` rows, which is counted; else as it is, so that the join is shuffled.

    Meant for tables of groups or files: the table should be kept or cheap, as it is counted first."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
