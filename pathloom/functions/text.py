"""Column functions that turn item attributes into prompt text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, NumericType


def usable_text(value: Column, numeric: bool = False) -> Column:
    """False for null, the empty string, the text 'nan', and for numbers 0 and NaN."""
    if numeric:
        return value.isNotNull() & (value != 0) & ~F.isnan(value.cast("double"))
    return value.isNotNull() & ~value.isin("", "nan")


def _usable_field(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, BooleanType):
        return F.coalesce(F.col(name), F.lit(False))
    return usable_text(F.col(name), isinstance(kind, NumericType))


def shown_number(value: Column) -> Column:
    """A double as the shortest decimal text: plain from 0.0001 up to 1e16, else with exponent (1e+16, 1e-05)."""
    java = value.cast("string")
    plain = F.rtrim(java.cast("decimal(38,18)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    exponent = F.regexp_replace(F.regexp_replace(java, r"\.0E", "E"), r"E(-?)([0-9])$", "E$10$2")
    exponent = F.regexp_replace(F.regexp_replace(exponent, "E-", "e-"), "E", "e+")
    within = (F.abs(value) >= 1e-4) & (F.abs(value) < 1e16)
    return F.when(value == 0, java).when(within, plain).otherwise(F.when(java.contains("E"), exponent).otherwise(java))


def _shown(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (DoubleType, FloatType)):
        return shown_number(F.col(name).cast("string").cast("double"))
    return F.initcap(F.col(name).cast("string")) if isinstance(kind, BooleanType) else F.col(name).cast("string")


def item_prompt_text(df: DataFrame, keys: Sequence[str], prompt: str, present: Column | None = None) -> Column:
    """``prompt`` followed by 'key: value' for each usable key, without separators.

    Rows for which ``present`` is false (no item information) get the empty string.
    """
    parts = [
        F.when(_usable_field(df, k), F.concat(F.lit(f"{k}: "), _shown(df, k))).otherwise(F.lit(""))
        for k in keys
    ]
    text = F.concat(F.lit(prompt), *parts)
    return text if present is None else F.when(present, text).otherwise(F.lit(""))


def composite_key(first: Column, second: Column, separator: str = "_") -> Column:
    """``first_second``; null if either part is null."""
    return F.concat(first.cast("string"), F.lit(separator), second.cast("string"))
