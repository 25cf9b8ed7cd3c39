"""Display strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_place(v: Column) -> Column:
    """A number >= 0 as C's %.1f gives it: its binary value rounded, ties to even (Java rounds its shortest digits, ties up)."""
    low = F.floor(v * 10)
    # Twentieths in the middle of two tenths. 20 v less them, in steps that are each exact near them.
    middle = (2 * low + 1).cast("double")
    over = 4 * v - (middle - 16 * v)
    tenths = F.when((over > 0) | ((over == 0) & (low % 2 == 1)), low + 1).otherwise(low)
    return F.format_string("%d.%d", F.floor(tenths / 10), tenths % 10)


def human_count(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000, F.concat(one_place(n / F.lit(1e6)), F.lit(" M")))
        .when(n >= 1_000, F.concat(one_place(n / F.lit(1e3)), F.lit(" k")))
        .otherwise(n.cast("string"))
    )


def display_name(name: Column, index: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("scan "), index.cast("string"))).otherwise(name)


def name_or_unnamed(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("(unnamed)")).otherwise(name)
