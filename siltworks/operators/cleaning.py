"""Text cleaning, validation and quarantine."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: White space in the Unicode sense, spelled out because engines disagree on \s.
SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CONTROL = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"


@dataclass(frozen=True)
class CleaningRules:
    form: str = "NFC"
    min_chars: int = 1
    max_chars: int = 200_000
    collapse_space: bool = True
    remove_control: bool = True
    oversize: str = "skip"  # or "truncate"


@pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _unstable_class(form: str) -> str:
    """Characters whose presence can make a text differ from its normal form: marks, second parts of syllables, and all that the form itself changes."""
    spans: list[list[int]] = []
    for i in [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x1D100, 0x1D800), *range(0x1F100, 0x1F300), *range(0x2F800, 0x2FA20)]:
        if not unicodedata.is_normalized(form, chr(i)):
            if spans and spans[-1][1] == i - 1:
                spans[-1][1] = i
            else:
                spans.append([i, i])
    # most characters are told apart by one range test, the others by groups of spans behind the range they cover
    groups = [spans[i : i + 16] for i in range(0, len(spans), 16)]
    parts = "".join(f"[\\x{{{g[0][0]:x}}}-\\x{{{g[-1][1]:x}}}&&[{''.join(f'\\x{{{a:x}}}-\\x{{{b:x}}}' for a, b in g)}]]" for g in groups)
    return r"[[^\x{0}-\x{9F}\x{4E00}-\x{9FFF}]&&[\p{M}\x{1160}-\x{11FF}" + parts + "]]"


_CLASS: dict[str, str] = {}


def normalise(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form. Only texts with a character that can change reach Python; the others go in and out as null."""
    pattern = _CLASS.setdefault(form, _unstable_class(form))
    return F.coalesce({"NFC": _nfc, "NFKC": _nfkc}[form](F.when(text.rlike(pattern), text)), text)


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_text(text: Column, rules: CleaningRules = CleaningRules()) -> Column:
    """Normal form, line ends, NUL and control characters, white space; not yet the length rules."""
    c = normalise(text, rules.form)
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\x00", "")
    if rules.remove_control:
        c = F.regexp_replace(c, CONTROL, "")
    if rules.collapse_space:
        inner = SPACE.replace(r"\x{09}-\x{0D}", r"\x{09}\x{0B}-\x{0D}")
        c = F.regexp_replace(c, f"[{inner}]+", " ")
        c = F.regexp_replace(c, " *\n *", "\n")
        c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return strip_space(c)


def clean(df: DataFrame, text: str = "text", rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Adds ``clean_text`` (null where rejected) and ``reason`` (accepted, empty, length)."""
    if {"_cleaned", "clean_text", "reason"} & set(df.columns):
        raise ValueError("clean_text and reason are taken")
    # one row in, one row out: the generator keeps the optimizer from copying the whole chain into every later use of its result
    out = df.select("*", F.explode(F.array(clean_text(F.col(text), rules))).alias("_cleaned"))
    n = F.length("_cleaned")
    if rules.oversize == "truncate":
        out = out.withColumn("_cleaned", F.when(n > rules.max_chars, F.regexp_replace(F.substring("_cleaned", 1, rules.max_chars), f"[{SPACE}]+$", "")).otherwise(F.col("_cleaned")))
    reason = F.when(F.col("_cleaned").isNull() | (n == 0), "empty").when((n > rules.max_chars) | (n < rules.min_chars), "length").otherwise("accepted")
    return out.withColumn("reason", reason).withColumn("clean_text", F.when(F.col("reason") == "accepted", F.col("_cleaned"))).drop("_cleaned")


def quarantine(df: DataFrame, policy: str = "skip") -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of a cleaned table; with policy ``error`` the accepted side fails on the first refused row."""
    if policy not in ("skip", "error"):
        raise ValueError("policy is skip or error")
    ok = F.col("reason") == "accepted"
    if policy == "error":
        return df.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("refused: "), F.col("reason"))).cast("boolean"))), df.where(~ok)
    return df.where(ok), df.where(~ok)


def length_gate(df: DataFrame, low: int, high: int, text: str = "text", by: str = "source") -> DataFrame:
    """Eligible, short and long records per group by length in code points; null texts count as short."""
    n = F.coalesce(F.length(text), F.lit(0))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.when(n.between(low, high), 1).otherwise(0)).alias("eligible"),
        F.sum(F.when(n < low, 1).otherwise(0)).alias("short"), F.sum(F.when(n > high, 1).otherwise(0)).alias("long"),
    )
