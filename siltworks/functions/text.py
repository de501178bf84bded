"""String expressions shared by the operators. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Removes white space (Unicode sense) at both ends; null stays null."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def fold_name(c: Column) -> Column:
    """Trimmed, lower case, blank becomes null."""
    s = F.lower(strip(c))
    return F.when(s != "", s)


def not_blank(c: Column) -> Column:
    """True where the text holds at least one character that is not white space; null counts as blank."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def unit_hash(c: Column) -> Column:
    """Uniform double in [0, 1) from the first 64 bits of SHA-256, the same on every engine."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))
